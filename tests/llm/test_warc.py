import pytest
from pyspark.sql import functions as F

from copperleaf.llm import warc


def test_versions_lengths_and_cut_files():
    block = b"HTTP/1.1 200 OK\r\nX: 1\r\n\r\nbody\n\nfiledesc://not-a-header 1\r\n\r\n"
    one = warc.version_block(1, "a", "20240101000000") + b"\n" + warc.arc_record(1, "http://a/ b", "20240101000000", block, "a") + b"\n"
    two = warc.version_block(2, "b", "20240101000000") + b"\n" + warc.arc_record(2, "", "199601020304", b"", "b") + b"\n"
    got = list(warc.parse_arc(one + two))
    assert [(r["version"], r["place"]) for r in got] == [(1, 0), (1, 1), (2, 0), (2, 1)] and got[0]["url"] == "filedesc://a"
    got = [r for r in got if r["place"]]
    assert [(r["version"], r["url"], r["block"]) for r in got] == [(1, "http://a/%20b", block), (2, "-", b"")]
    assert got[1]["status"] == "200" and warc.iso_date(got[1]["date"]) == "1996-01-02T03:04:00Z"
    assert warc.split_http(block) == (block[:25], block[25:]) and warc.split_http(b"plain") == (b"", b"plain")
    for cut in (one[:-20], b"no version 3\nabc", one.replace(b" text/html", b""), warc.version_block(1, "a", "2").replace(b"1 0", b"7 0")):
        with pytest.raises(ValueError):
            list(warc.parse_arc(cut))


PAGES = [(1, "http://a", "<p>x</p>"), (2, "http://b", "<p>x</p>"), (3, "http://c d", None), (4, None, ""), (5, "http://e", "é\r\n\r\nWARC/1.1\r\n\r\n" * 100000), (6, "http://f", "alone"), (6, "http://f", "alone"), (None, "http://g", "<p>x</p>"), (None, None, "nobody")]


def test_round_trip_of_odd_pages(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("digest", "archive", "part", "record", "id", "_n", "refers_to")})
    got = sorted(map(tuple, warc.through_archives(spark, df).collect()), key=str)
    want, seen = [], set()
    for i, _, html in PAGES:
        data = (html or "").encode()
        top = max((j for j, _, h in PAGES if (h or "") == (html or "") and j is not None), default=None)
        holds = i == top and (i, html) not in seen
        seen.add((i, html))
        want.append((i, len(data), warc.sha1_base32(data), "response" if holds else "revisit", None if holds else top))
    assert got == sorted(want, key=str)
    assert warc.through_archives(spark, df.limit(0)).count() == 0


def test_payloads_come_back_whole(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    arc, out = warc.scratch_path(spark, "arc"), warc.scratch_path(spark, "warc")
    warc.write_arc(df, arc, archive_bytes=1 << 17)
    warc.convert(spark, arc, out, min_bytes=6)
    got = {r["page_id"]: r for r in warc.read_warc(spark, out, with_payload=True).collect() if r["page_id"]}
    assert bytes(got[5]["payload"]) == PAGES[4][2].encode()
    assert got[1]["record_type"] == "revisit" and got[1]["refers_to_id"] == got[2]["record_id"] and got[1]["payload"] is None
    assert {got[i]["record_type"] for i in (3, 4)} == {"response"}
    assert {r["version"] for r in warc.read_arc(spark, arc).collect()} == {1, 2}


def test_other_records_keep_their_type(spark):
    from copperleaf.cluster import scratch_path

    dns, page = b"20240101000000\nexample.org. IN A 1.2.3.4\n", b"HTTP/1.1 200 OK\r\nContent-Length: 9999\r\n\r\nsame"
    line = lambda url, mime, block: f"{url} 127.0.0.1 20240101000000 {mime} {len(block)}\n".encode() + block + b"\n"
    data = warc.version_block(1, "old.arc", "20240101000000") + b"\n" + line("dns:example.org", "text/dns", dns) + line("http://a", "text/html", page) + line("http://b", "text/html", page) + line("http://c", "text/plain", b"same")
    arc, out = scratch_path(spark, "arc"), scratch_path(spark, "warc")
    spark.createDataFrame([(data.decode(),)], "value string").coalesce(1).write.option("lineSep", "\n").text(arc)
    warc.convert(spark, arc, out)
    rows = warc.materialise(warc.read_warc(spark, out), "rows")
    got = {r["url"]: r for r in warc.with_referred(rows).collect()}
    assert {u: (r["record_type"], r["payload_bytes"]) for u, r in got.items() if u and u[0] == "d" or u == "http://c"} == {"dns:example.org": ("resource", len(dns)), "http://c": ("resource", 4)}
    assert got["dns:example.org"]["content_type"] == "text/dns" and got["http://c"]["content_type"] == "text/plain"
    # a wrong length in the HTTP head changes nothing, for the revisit either
    assert sorted(got[u]["record_type"] for u in ("http://a", "http://b")) == ["response", "revisit"] and {got[u]["payload_bytes"] for u in ("http://a", "http://b")} == {4}
    assert [r["record_type"] for r in got.values() if r["url"] is None] == ["warcinfo"]
    again = scratch_path(spark, "warc")
    warc.convert(spark, arc, again)
    assert {r["record_id"] for r in warc.read_warc(spark, again).collect()} == {r["record_id"] for r in rows.collect()}


def test_pages_of_any_address_and_foreign_page_ids(spark):
    pages = [(1, "filedesc://copperleaf-000000.arc.gz", "<p>x</p>"), (2, "filedesc://x 1", None), (3, "http://a", "1 0 me\nURL IP-address Archive-date x"), (4, "filedesc://b", "1 0 me\nURL IP-address Archive-date x")]
    got = sorted(map(tuple, warc.through_archives(spark, spark.createDataFrame(pages, "page_id long, url string, html string")).collect()))
    same = warc.sha1_base32(pages[2][2].encode())
    assert [(r[0], r[3], r[4]) for r in got] == [(1, "response", None), (2, "response", None), (3, "revisit", 4), (4, "response", None)] and got[2][2] == got[3][2] == same
    foreign = b"HTTP/1.1 200 OK\r\nX-Page-Id: abc\r\n" + warc.PAGE_FIELD.encode() + b": 12x\r\n\r\nbody"
    data = warc.version_block(1, "old.arc", "20240101000000") + b"\n" + warc.arc_record(1, "http://a", "20240101000000", foreign, "old.arc") + b"\n"
    arc, out = warc.scratch_path(spark, "arc"), warc.scratch_path(spark, "warc")
    spark.createDataFrame([(data.decode(),)], "value string").coalesce(1).write.option("lineSep", "\n").text(arc)
    warc.convert(spark, arc, out)
    rows = [r for r in warc.read_warc(spark, out).collect() if r["record_type"] == "response"]
    assert [(r["page_id"], r["payload_bytes"]) for r in rows] == [(None, 4)]
    assert [warc.page_number(x) for x in (None, "", "7", "-7", "٣", "1" * 30, "0x1", " 7")] == [None, None, 7, -7, None, None, None, None]


def test_repeated_payloads_beyond_the_broadcast(spark, monkeypatch):
    pages = spark.range(3000).select(F.col("id").alias("page_id"), F.lit("http://a").alias("url"), F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("p"), (F.col("id") % 1400).cast("string"))).alias("html"))
    want = sorted(map(tuple, warc.through_archives(spark, pages).collect()))
    monkeypatch.setattr(warc, "BROADCAST_ROWS", 3)
    monkeypatch.setattr(warc, "HOT_SHARE", 0.1)
    monkeypatch.setattr(warc, "SORTED", 0.001)
    assert sorted(map(tuple, warc.through_archives(spark, pages).collect())) == want
