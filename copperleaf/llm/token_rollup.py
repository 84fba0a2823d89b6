"""Token totals by source, language and tokenizer version, kept up to date by signed deltas.

A batch is a table of deltas: an insert adds a document and its tokens, a delete takes both away, a
revised count takes away the old tokens and adds the new. A commit sums a batch on the map side to one row for each
key, writes it to a folder of its own and moves that to the batch's place; the move fails where the place is taken,
so of several writers of a batch one commits, and replays never count twice. Totals are the sum over committed batches.

``compact`` replaces batches by their sum in steps that may each be the last: the sum is written to a new
folder, a numbered manifest that names it and the ids in it is moved into place, and only then are old folders
deleted. A reader goes by the highest manifest, which lists every id that was ever folded in, so ids stay committed. The batches are
listed once and just those are summed and named, so a batch that commits meanwhile stays a batch; of several that compact at once one
switches, and deletes only what older manifests named; a sum of one that died before its switch is left behind.

A tokenizer's version is its name and the start of the SHA-256 of its file. Counts are made in Arrow batches, a
document at a time, with the tokenizer loaded once for each worker. Long runs of white space are cut out and encoded on their own,
since the pattern's lookahead takes a step of the machine's stack for each sign; the pieces are the same.

Defined results: null source, language or version is a key of its own; null texts and counts are 0 tokens; texts of any
length are counted whole; repeated rows count as often as they are there; an empty batch commits and changes nothing;
keys with no documents and tokens left are not in the totals; other columns are never read, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator
from functools import lru_cache
from urllib.parse import quote, unquote

import pyarrow as pa
import tiktoken
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from copperleaf.cluster import join_counted, materialise, scratch_path

KEYS = ["source", "lang", "version"]
SCHEMA = "source string, lang string, version string, n_docs long, n_tokens long"


def deltas(docs: DataFrame, version: str, docs_delta: int, tokens: Column) -> DataFrame:
    """One signed row for each document: docs_delta is 1, -1, or 0 for a revised count."""
    return docs.select("source", "lang", F.lit(version).alias("version"), F.lit(docs_delta).cast("long").alias("n_docs"), F.coalesce(tokens.cast("long"), F.lit(0)).alias("n_tokens"))


def inserts(docs: DataFrame, version: str, tokens: Column) -> DataFrame:
    return deltas(docs, version, 1, tokens)


def deletes(docs: DataFrame, version: str, tokens: Column) -> DataFrame:
    return deltas(docs, version, -1, -tokens)


def revisions(docs: DataFrame, version: str, old: Column, new: Column) -> DataFrame:
    return deltas(docs, version, 0, F.coalesce(new.cast("long"), F.lit(0)) - F.coalesce(old.cast("long"), F.lit(0)))


def _summed(rows: DataFrame) -> DataFrame:
    sums = rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    return sums.filter("n_docs <> 0 OR n_tokens <> 0")


class Rollup:
    """A folder of committed batches, in any file system that Spark writes to and that renames at once."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    # -- files

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _names(self, folder: str) -> list[str]:
        fs, p = self._fs(folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def _move(self, source: str, target: str) -> bool:
        """Whether ``source`` is at ``target`` now; False, and nothing moved, where the target is taken."""
        jvm = self.spark._jvm
        paths = [self._fs(x)[1] for x in (source, target)]
        fs = self._fs(source)[0]
        fs.mkdirs(paths[1].getParent())
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(paths[0]).toUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            files.rename(*[fs.makeQualified(p) for p in paths], none)
        except Py4JJavaError as e:
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                fs.delete(paths[0], True)
                return False
            raise
        return True

    def _delete(self, path: str) -> None:
        fs, p = self._fs(path)
        fs.delete(p, True)

    # -- state

    def _place(self, batch_id: str) -> str:
        return f"{self.path}/batches/{quote(batch_id, safe='')}"

    def _manifest(self) -> tuple[int, str | None, set[str]]:
        """Number of the highest manifest, the folder of its sum, and the ids in that sum."""
        found = self._names(f"{self.path}/manifests")
        if not found:
            return 0, None, set()
        return int(found[-1]), *self._read_manifest(found[-1])

    def _read_manifest(self, name: str) -> tuple[str, set[str]]:
        # ids of batches, which are as many as commits and not as documents
        lines = [r["value"] for r in self.spark.read.text(f"{self.path}/manifests/{name}").collect()]
        return next(x[5:] for x in lines if x.startswith("base=")), {unquote(x[3:]) for x in lines if x.startswith("id=")}

    def _state(self) -> tuple[int, str | None, set[str], list[str]]:
        """The highest manifest, and the ids of the batches beside its sum, all of one moment."""
        while True:
            number, base, folded = self._manifest()
            beside = sorted(b for b in map(unquote, self._names(f"{self.path}/batches")) if b not in folded)
            if self._names(f"{self.path}/manifests")[-1:] == ([f"{number:012d}"] if number else []):
                return number, base, folded, beside

    def batches(self) -> list[str]:
        """Ids of the committed batches that are not folded into a sum."""
        return self._state()[3]

    def committed(self, batch_id: str) -> bool:
        fs, p = self._fs(self._place(batch_id))
        return fs.exists(p) or batch_id in self._manifest()[2]

    # -- changes

    def commit(self, batch_id: str, batch: DataFrame) -> bool:
        """Whether this call committed the batch; False if it was committed before, or by another writer."""
        if self.committed(batch_id):
            return False
        made = f"{self.path}/writing/{uuid.uuid4().hex}"
        _summed(batch).write.parquet(made)
        return self._move(made, self._place(batch_id))

    def _sum_of(self, base: str | None, ids: list[str]) -> DataFrame:
        paths = [self._place(b) for b in ids] + ([f"{self.path}/sums/{base}"] if base else [])
        return _summed(self.spark.read.schema(SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMA))

    def totals(self) -> DataFrame:
        _, base, _, ids = self._state()
        return self._sum_of(base, ids)

    def compact(self) -> bool:
        """Fold the batches that are committed now into one sum; False if another call did so meanwhile."""
        number, base, folded, ids = self._state()
        made = self._write_sum(base, ids)
        if not self._switch(number + 1, made, folded | set(ids)):
            self._delete(f"{self.path}/sums/{made}")
            return False
        return self._sweep()

    def _write_sum(self, base: str | None, ids: list[str]) -> str:
        made = uuid.uuid4().hex
        self._sum_of(base, ids).write.parquet(f"{self.path}/sums/{made}")
        return made

    def _switch(self, number: int, base: str, ids: set[str]) -> bool:
        made = f"{self.path}/writing/{uuid.uuid4().hex}"
        lines = [f"base={base}", *(f"id={quote(i, safe='')}" for i in sorted(ids))]
        self.spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(made)
        return self._move(made, f"{self.path}/manifests/{number:012d}")

    def _sweep(self) -> bool:
        """Delete what the highest manifest has made needless, as far as a manifest ever named it; after a death the next call does it."""
        _, base, folded = self._manifest()
        for b in map(unquote, self._names(f"{self.path}/batches")):
            if b in folded:
                self._delete(self._place(b))
        for m in self._names(f"{self.path}/manifests")[:-1]:
            old = self._read_manifest(m)[0]
            if old != base:
                self._delete(f"{self.path}/sums/{old}")
            self._delete(f"{self.path}/manifests/{m}")
        return True


# -- counting


#: White space as the tokenizer's patterns have it, in runs that are cut out; the end of a pattern that makes them pieces of their own.
RUN = 4096
WHITE_RUN = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % RUN)
RUN_RULE = r"|\s+(?!\S)|\s+"


@lru_cache(maxsize=8)
def _encoding(ranks: bytes, pattern: str) -> tiktoken.Encoding:
    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=table, special_tokens={})


def count_tokens(text: str, ranks: bytes, pattern: str) -> int:
    """As many as ``encode_ordinary`` gives. A run of white space before a sign is one piece without its last sign, and one at the end is a piece:
    that is what the pattern's rule for it says, if it has that rule, and nothing else of the pattern looks ahead."""
    encoding, total, start = _encoding(ranks, pattern), 0, 0
    if pattern.endswith(RUN_RULE):
        for run in WHITE_RUN.finditer(text):
            end = run.end() if run.end() == len(text) else run.end() - 1
            total += len(encoding.encode_ordinary(text[start : run.start()])) + len(_encoding(ranks, r"\s+").encode_ordinary(text[run.start() : end]))
            start = end
    return total + len(encoding.encode_ordinary(text[start:]))


def version_of(path: str) -> str:
    with open(path, "rb") as f:
        return f"{path.rpartition('/')[2]}@{hashlib.sha256(f.read()).hexdigest()[:12]}"


def with_token_counts(rows: DataFrame, texts: list[str], paths: dict[str, str], pattern: str) -> DataFrame:
    """``rows`` without the columns ``texts``, with ``<text>_<name>`` for each of them and each tokenizer file.

    The files are read on the driver and broadcast: their size is that of the vocabulary.
    """
    files = {}
    for name, path in paths.items():
        with open(path, "rb") as f:
            files[name] = f.read()
    shared = rows.sparkSession.sparkContext.broadcast(files)
    carried = [c for c in rows.columns if c not in texts]
    made = [f"{t}_{n}" for t in texts for n in paths]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            counts = []
            for t in texts:
                column = batch.column(batch.schema.get_field_index(t))
                counts += [pa.array([count_tokens(x.as_py(), ranks, pattern) if x.is_valid else None for x in column], pa.int64()) for ranks in known.values()]
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in carried], *counts], names=[*carried, *made])

    return rows.mapInArrow(task, rows.select(*carried, *[F.lit(None).cast("long").alias(c) for c in made]).schema)


def op3_token_rollup(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    paths = {"a": public_tokenizers.path("byte_bpe_50k.tiktoken"), "b": public_tokenizers.path("byte_bpe_multi_50k.tiktoken")}
    return feed(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), paths, public_tokenizers.PATTERN)


def feed(spark, docs: DataFrame, paths: dict[str, str], pattern: str) -> DataFrame:
    """A feed over all documents: inserts, a second tokenizer version, a replay of it, revised counts of the documents whose
    bars are taken out, deletes of every document whose text a smaller id has too, and a compaction."""
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select("doc_id", "source", "lang", F.md5(text).alias("digest"), text.alias("old"), F.when(text.contains("|"), F.translate(text, "|", "")).alias("new"))
    counted = materialise(with_token_counts(slim, ["old", "new"], paths, pattern), "counts")
    first = counted.groupBy(F.col("digest").alias("_digest")).agg(F.min("doc_id").alias("_first"), F.count("*").alias("_rows"))
    copies = materialise(join_counted(counted, "digest", materialise(first, "firsts"), "_digest", "_rows").filter("doc_id > _first"), "copies")
    rollup = Rollup(spark, scratch_path(spark, "rollup"))
    versions = {n: version_of(p) for n, p in paths.items()}
    for n, v in versions.items():
        rollup.commit(f"insert {v}", inserts(counted, v, F.col(f"old_{n}")))
    rollup.commit(f"insert {v}", inserts(counted, v, F.col(f"old_{n}")))
    revised = counted.filter("new_a IS NOT NULL")
    for n, v in versions.items():
        rollup.commit(f"revise {v}", revisions(revised, v, F.col(f"old_{n}"), F.col(f"new_{n}")))
        rollup.commit(f"delete {v}", deletes(copies, v, F.coalesce(f"new_{n}", f"old_{n}")))
    rollup.compact()
    return rollup.totals()
