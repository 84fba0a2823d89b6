"""Legacy archives: ARC written, converted to WARC, and read back.

An ARC file is a run of records, each a header line and as many bytes as the line declares. The
version block at the head of a file (or of any file appended to it) says which fields the lines
have: five in version 1; ten, with result code, checksum, location, offset and file name, in
version 2. The converter parses that as a stream, takes the HTTP head off, and synthesises what WARC asks for: a record id
(a UUID from the archive's own name, the record's place and its content, so that a rerun writes the same), the date in ISO 8601,
the type, block and payload digests, and for each repeated payload a revisit of the one record that holds it. A version
block becomes a warcinfo record; a record without an HTTP head (a DNS answer, say) a resource of its own content type.

Archives hold about ``archive_bytes`` of pages, dealt to them by a hash, and are at least as many as the cores; a task writes
several, one after the other, so the shuffle has no more partitions than the session sets. Spark hands a reader a whole
compressed file; it is unpacked and parsed record by record. All files are written and read by Spark, in the shared folder; a
record's bytes pass through Spark's text writer, whose line end is the record's end that the format asks for.

Defined results: a null html is an empty payload; rows with a null page id take part, are written
without an id, and are the response only where their payload has no other id; if the largest id of a payload
is on several rows, one of them is the response; pages of any length are one record each; an empty table gives archives
without pages and an empty result; other columns are never read, whatever their names.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from copperleaf.cluster import BROADCAST_ROWS, HOT_SHARE, join_counted, materialise, scratch_path

# The header fields of the two versions of ARC, and the terms of WARC 1.1.
ARC_FIELDS = {
    1: ["url", "ip", "date", "mime", "length"],
    2: ["url", "ip", "date", "mime", "status", "checksum", "location", "offset", "filename", "length"],
}
ARC_NAMES = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
WARC_VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_END = "\r\n\r\n"
#: Of our own archives; what other servers send under names like it says nothing.
PAGE_FIELD = "X-Copperleaf-Page-Id"
#: Archives whose records one task sorts before it writes them.
SORTED = 4
#: Bytes of records that a reader hands on at once.
BATCH_BYTES = 2 << 20
#: Spark's text writer as archives need it; the fast level costs some bytes and saves half of the time.
GZIP = {"compression": "gzip", "zlib.compress.level": "BEST_SPEED"}


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


# --- ARC -------------------------------------------------------------------------------------


def version_block(version: int, name: str, date: str) -> bytes:
    body = f"{version} 0 copperleaf\n{ARC_NAMES[version]}\n".encode()
    tail = ["200", "-", "-", "0", name] if version == 2 else []
    head = " ".join([f"filedesc://{name}", "0.0.0.0", date, "text/plain", *tail, str(len(body))])
    return head.encode() + b"\n" + body


def arc_record(version: int, url: str, date: str, block: bytes, name: str, status: int = 200) -> bytes:
    url = re.sub(r"\s", "%20", url or "") or "-"  # a header line is split at spaces
    tail = [str(status), "-", "-", "0", name] if version == 2 else []
    head = " ".join([url, "127.0.0.1", date, "text/html", *tail, str(len(block))])
    return head.encode() + b"\n" + block


#: A page may have any address; a version block also says what fields the lines have.
VERSION_BLOCK = re.compile(rb"(\d{1,9}) \d+ [^\n]*\nURL IP-address Archive-date ")


def page_number(value: str | None) -> int | None:
    """A page id, or None for whatever else a field of that name holds."""
    return int(value) if value and re.fullmatch(r"-?[0-9]{1,18}", value) else None


def _exactly(stream: io.BufferedIOBase, n: int, what: str) -> bytes:
    got = stream.read(n)
    if len(got) < n:
        raise ValueError(f"{what} declares {n} bytes, {len(got)} are left")
    return got


def parse_arc(data: bytes | io.BufferedIOBase) -> Iterator[dict]:
    """The records of one or several ARC files, one after the other, version blocks too; raises ValueError where one is cut."""
    stream = io.BytesIO(data) if isinstance(data, bytes) else data
    version, name, place = None, "", 0
    while raw := stream.readline():
        if not raw.strip(b"\r\n"):
            continue
        if not raw.endswith(b"\n"):
            raise ValueError("header line not ended")
        line = raw.decode("utf-8", "replace").rstrip("\r\n").split(" ")
        body = _exactly(stream, int(line[-1]), "record")
        place += 1
        block_of = VERSION_BLOCK.match(body) if line[0].startswith("filedesc://") else None
        if block_of:
            version, name, place = int(block_of[1]), line[0], 0
            if version not in ARC_FIELDS:
                raise ValueError(f"ARC version {version}")
            yield dict(zip(ARC_FIELDS[1], [*line[:4], line[-1]], strict=True)) | {"version": version, "block": body, "archive": name, "place": 0}
        elif version is None:
            raise ValueError("no version block")
        else:
            names = ARC_FIELDS[version]
            if len(line) != len(names):
                raise ValueError(f"{len(line)} fields, version {version} has {len(names)}")
            yield dict(zip(names, line, strict=True)) | {"version": version, "block": body, "archive": name, "place": place}


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """HTTP head with its empty line, and payload; a block without a head is all payload."""
    if not block.startswith(b"HTTP/"):
        return b"", block
    end = block.find(b"\r\n\r\n")
    return (block, b"") if end < 0 else (block[: end + 4], block[end + 4 :])


def http_field(head: bytes, name: str) -> str | None:
    found = re.search(rb"(?im)^" + name.encode() + rb":[ \t]*([^\r\n]*)", head)
    return found[1].decode("utf-8", "replace").strip() if found else None


# --- WARC ------------------------------------------------------------------------------------


def iso_date(date: str) -> str:
    """14 digits, or the 12 or 8 of old crawlers, as ISO 8601 in UTC."""
    d = date.ljust(14, "0")
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(archive: str, place: int, url: str, date: str, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{archive} {place} {url} {date} {digest}')}>"


def warc_record(rec: dict, revisit_of: str | None) -> bytes:
    """Bytes of a record without its end."""
    kind = "revisit" if revisit_of else rec["kind"]
    block = rec["head"] if revisit_of else rec["head"] + rec["payload"]
    if kind == "warcinfo":
        block = f"format: WARC File Format 1.1\r\ndescription: converted from {rec['url']}\r\n".encode()
    payload = kind in ("response", "revisit", "resource")
    fields = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", rec["record_id"]),
        ("WARC-Date", iso_date(rec["date"])),
        *([("WARC-Target-URI", rec["url"]), ("WARC-IP-Address", rec["ip"]), ("WARC-Payload-Digest", f"sha1:{rec['digest']}")] if payload else [("WARC-Filename", rec["url"].removeprefix("filedesc://"))]),
        ("WARC-Block-Digest", f"sha1:{sha1_base32(block)}"),
        *([("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", revisit_of)] if revisit_of else []),
        *([(PAGE_FIELD, str(rec["page_id"]))] if rec["page_id"] is not None else []),
        ("Content-Type", {"warcinfo": "application/warc-fields", "resource": rec["mime"]}.get(kind, "application/http; msgtype=response")),
        ("Content-Length", str(len(block))),
    ]
    return "\r\n".join([WARC_VERSION, *(f"{k}: {v}" for k, v in fields), "", ""]).encode() + block


def revisit_parts(rec: dict) -> tuple[bytes, bytes]:
    """A response as a revisit, up to the id that it refers to and from there on. No field before that one holds a line end."""
    before, after = warc_record(rec, "?").split(b"\r\nWARC-Refers-To: ?", 1)
    return before + b"\r\nWARC-Refers-To: ", after


def parse_warc(data: bytes | io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of each record, by declared lengths."""
    stream = io.BytesIO(data) if isinstance(data, bytes) else data
    while first := stream.readline():
        if not first.startswith(b"WARC/"):
            raise ValueError(f"no record at {first[:40]!r}")
        fields: dict[str, str] = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode().rstrip("\r\n").partition(": ")
            fields[name] = value
        yield fields, _exactly(stream, int(fields["Content-Length"]), "record")
        _exactly(stream, len(RECORD_END), "record end")


# --- Spark -----------------------------------------------------------------------------------


def _unzipped(path: str, data: bytes) -> io.BufferedIOBase:
    return gzip.GzipFile(fileobj=io.BytesIO(data)) if path.endswith(".gz") else io.BytesIO(data)


def _files(spark, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "part-*").load(path).select("path", "content")


def _read(files: DataFrame, parse, schema: str, kinds: list[pa.DataType], row, size) -> DataFrame:
    """A row of ``schema`` for each record that ``parse`` finds in the files and ``row`` does not make None of, handed on
    in batches of about BATCH_BYTES by ``size``."""
    names = [x.split()[0] for x in schema.split(", ")]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[tuple] = []
        held = 0
        for batch in batches:
            for name, data in zip(batch.column(0), batch.column(1), strict=True):
                for record in parse(_unzipped(name.as_py(), data.as_py())):
                    made.append(row(record))
                    held += size(record)
                    if held >= BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], k) for i, k in enumerate(kinds)], names=names)
                        made, held = [], 0
        yield pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], k) for i, k in enumerate(kinds)], names=names)

    return files.mapInArrow(task, schema)


def write_arc(
    pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", archive_bytes: int = 256 << 20, date: str = "20240101000000", min_archives: int | None = None
) -> None:
    """Pages as gzipped ARC files; even archives in version 1, odd ones in version 2."""
    spark = pages.sparkSession
    size = pages.agg(F.coalesce(F.sum(F.octet_length(F.coalesce(F.col(html_col), F.lit("")))), F.lit(0))).first()[0]
    archives = max(min_archives or spark.sparkContext.defaultParallelism, -(-size // archive_bytes))
    slim = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    dealt = slim.select(F.pmod(F.xxhash64("id", "url", F.octet_length("html")), F.lit(archives)).alias("archive"), F.lit(1).alias("part"), "id", "url", "html")
    none = F.lit(None).cast("string")
    heads = spark.range(archives).select(F.col("id").alias("archive"), F.lit(0).alias("part"), F.lit(None).cast("long").alias("id"), none.alias("url"), none.alias("html"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for archive, part, page, url, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                version, name = 1 + archive % 2, f"copperleaf-{archive:06d}.arc.gz"
                if not part:
                    made.append(version_block(version, name, date).removesuffix(b"\n"))
                    continue
                payload = (html or "").encode()
                head = ["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}", *([f"{PAGE_FIELD}: {page}"] if page is not None else []), "", ""]
                made.append(arc_record(version, url, date, "\r\n".join(head).encode() + payload, name))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(made, pa.binary())], names=["archive", "part", "id", "record"])

    records = heads.unionByName(dealt).mapInArrow(task, "archive long, part int, id long, record binary").withColumn("record", F.col("record").cast("string"))
    # sorted last: so the writer finds its order by archive there, and leaves the records of one as they stand
    # a task sorts the session's share of the bytes, and no more than those of a few archives
    tasks = int(-(-size // (SORTED * archive_bytes)))
    dealt_out = records.repartition(tasks, "archive") if tasks > int(spark.conf.get("spark.sql.shuffle.partitions")) else records.repartition("archive")
    ordered = dealt_out.sortWithinPartitions("archive", "part", "id", "record").select("archive", "record")
    ordered.write.options(**GZIP).option("lineSep", "\n").partitionBy("archive").text(path)


ARC_ROWS = "kind string, page_id long, url string, ip string, date string, mime string, version int, head binary, payload binary, digest string, record_id string"


def read_arc(spark, path: str) -> DataFrame:
    """A row for each record of the ARC files in a folder: a response, a resource, or the warcinfo of a version block."""

    def row(r: dict) -> tuple:
        r = _arc_fields(r)
        return tuple(r[x.split()[0]] for x in ARC_ROWS.split(", "))

    kinds = [pa.string(), pa.int64(), *[pa.string()] * 4, pa.int32(), pa.binary(), pa.binary(), pa.string(), pa.string()]
    return _read(_files(spark, path), parse_arc, ARC_ROWS, kinds, row, lambda r: len(r["block"]))


def _arc_fields(r: dict) -> dict:
    """What a row of ARC_ROWS has, of a record as it is parsed."""
    http = r["block"].startswith(b"HTTP/")
    head, payload = split_http(r["block"])
    digest = sha1_base32(payload)
    kind = "warcinfo" if r["place"] == 0 else "response" if http else "resource"
    page = page_number(http_field(head, PAGE_FIELD)) if http else None
    return r | {"kind": kind, "page_id": page, "head": head, "payload": payload, "digest": digest, "record_id": record_id(r["archive"], r["place"], r["url"], r["date"], digest)}


def convert(spark, arc_path: str, warc_path: str, min_bytes: int = 0) -> None:
    """ARC files to gzipped WARC files; of the responses with equal payloads one with the largest page id holds the bytes.

    A task parses an archive and makes both forms of a response, whole and as a revisit; the join takes one, so that records pass through
    one Python process and not two. Which record holds the bytes is found on (digest, ids) alone, summed on the map side. The payloads are not shuffled as long as there are
    no more repeated payloads than are broadcast; beyond that, each file's records are shuffled by their digest.
    """
    files = _files(spark, arc_path)
    ids = "kind string, digest string, page_id long, record_id string, bytes long"
    sized = lambda r: (r["kind"], r["digest"], r["page_id"], r["record_id"], len(r["payload"]))
    known = _read(files, parse_arc, ids, [pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()], lambda r: sized(_arc_fields(r)), lambda r: 256)
    slim = materialise(known.filter("kind = 'response'").drop("kind"), "arc-ids")
    held = slim.filter(F.col("bytes") >= min_bytes).groupBy("digest").agg(F.max(F.struct("page_id", "record_id")).alias("m"), F.count("*").alias("n"))
    held = materialise(held.filter("n > 1").select(F.col("digest").alias("_digest"), F.col("m.record_id").alias("_holder"), "n"), "arc-originals")

    def both(r: dict) -> tuple:
        r = _arc_fields(r)
        parts = revisit_parts(r) if r["kind"] == "response" else (None, None)
        return r["kind"], r["digest"], r["record_id"], warc_record(r, None), *parts

    rows = "kind string, digest string, record_id string, record binary, before binary, after binary"
    records = _read(files, parse_arc, rows, [*[pa.string()] * 3, *[pa.binary()] * 3], both, lambda r: len(r["block"]) + 1024)
    revisits = (F.col("kind") == "response") & (F.col("record_id") != F.col("_holder"))
    record = F.when(revisits, F.concat("before", F.col("_holder").cast("binary"), "after")).otherwise(F.col("record"))
    _with_holders(records, held).select(record.cast("string").alias("record")).write.options(**GZIP).option("lineSep", RECORD_END).text(warc_path)


def _with_holders(records: DataFrame, held: DataFrame) -> DataFrame:
    """``records`` with the holder of their payload, if another has it too. The holders are broadcast if they are few; else just those of the
    commonest payloads are, of which there are at most 1 / HOT_SHARE, and the other records are shuffled by their digest."""
    same = F.col("digest") == F.col("_digest")
    if held.count() <= BROADCAST_ROWS:
        return records.join(F.broadcast(held), same, "left")
    least = HOT_SHARE * (held.agg(F.sum("n")).first()[0] or 0)
    hot = records.join(F.broadcast(held.filter(F.col("n") > least)), same, "left")
    rest = hot.filter("_digest IS NULL").drop(*held.columns).join(held.filter(F.col("n") <= least), same, "left")
    return hot.filter("_digest IS NOT NULL").unionByName(rest)


WARC_ROWS = "page_id long, record_id string, record_type string, url string, date string, content_type string, payload_bytes long, payload_digest string, refers_to_id string"


def read_warc(spark, path: str, with_payload: bool = False) -> DataFrame:
    """A row for each record; a revisit has no payload and so no size of its own (``with_referred`` adds that of the record it stands for)."""

    def row(record: tuple[dict[str, str], bytes]) -> tuple:
        f, block = record
        if f["WARC-Block-Digest"] != f"sha1:{sha1_base32(block)}":
            raise ValueError(f"block digest of {f['WARC-Record-ID']}")
        payload = None if f["WARC-Type"] == "revisit" else split_http(block)[1] if f["WARC-Type"] == "response" else block
        page, digest = f.get(PAGE_FIELD), f.get("WARC-Payload-Digest")
        made = (page_number(page), f["WARC-Record-ID"], f["WARC-Type"], f.get("WARC-Target-URI"), f["WARC-Date"], f["Content-Type"], None if payload is None else len(payload), digest and digest.removeprefix("sha1:"), f.get("WARC-Refers-To"))
        return (*made, payload) if with_payload else made

    kinds = [pa.int64(), *[pa.string()] * 5, pa.int64(), pa.string(), pa.string(), *[pa.binary()] * with_payload]
    return _read(_files(spark, path), parse_warc, WARC_ROWS + ", payload binary" * with_payload, kinds, row, lambda r: len(r[1]) + 512)


def with_referred(rows: DataFrame) -> DataFrame:
    """``rows`` of a written table with refers_to, the page id that a revisit refers to, and the size of that payload as its own."""
    asked = rows.filter("refers_to_id IS NOT NULL").groupBy(F.col("refers_to_id").alias("_asked")).agg(F.count("*").alias("_n"))
    held = rows.filter("record_type = 'response'").join(asked, F.col("record_id") == F.col("_asked")).select(F.col("record_id").alias("_id"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("_bytes"), "_n")
    found = join_counted(rows.filter("refers_to_id IS NOT NULL"), "refers_to_id", materialise(held, "warc-held"), "_id", "_n")
    plain = rows.filter("refers_to_id IS NULL").withColumn("refers_to", F.lit(None).cast("long"))
    return plain.unionByName(found.withColumn("payload_bytes", F.col("_bytes")).select(*plain.columns))


def op5_arc_to_warc(spark, sf_dir: str) -> DataFrame:
    return through_archives(spark, spark.read.parquet(f"{sf_dir}/pages.parquet"))


def through_archives(spark, pages: DataFrame) -> DataFrame:
    arc, warc = scratch_path(spark, "arc"), scratch_path(spark, "warc")
    write_arc(pages, arc)
    convert(spark, arc, warc)
    back = materialise(read_warc(spark, warc).filter("record_type <> 'warcinfo'"), "warc-rows")
    return with_referred(back).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP5_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS top, row_number() OVER (PARTITION BY coalesce(html, '') ORDER BY page_id DESC NULLS LAST) = 1 AS holds FROM pages
), h AS (
  SELECT *, sha1(html) AS hex, encode(html) AS raw FROM p
)
SELECT page_id, CAST(octet_length(raw) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(
    (CAST('0x' || substr(hex, 1 + 5 * (i // 4), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS INT), 1)), '') AS payload_digest,
  CASE WHEN holds THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN NOT holds THEN top END AS refers_to
FROM h
"""
