"""Fill-in-middle: each text is cut in three by hashes of its id, and the parts are put in another order.

The work is DuckDB SQL inside ``mapInArrow``: pieces of an Arrow batch are registered as a table, and one statement hashes the
ids, extracts the text's units and puts the parts together, so no row goes through Python. A text is first extracted as
blocks of up to BLOCK units, and only the two blocks that are cut as single units: a list of all units would take sixteen
bytes for each. A piece has at most PIECE_BYTES of text, or one row, so the memory of a task does not grow with its batches.

Nothing is shuffled; a row depends on its id and text alone, so a lost executor's rows come out the same.

Defined results: a null text is empty and so plain; a null id is hashed as the empty string; bytes that are no UTF-8 are
replaced by U+FFFD first; rows that repeat give equal rows; texts of any length are cut whole; an empty table gives an empty
table; other columns are never read, whatever their names. A text that contains a mark stays plain, so every output can be undone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import duckdb
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = MARKS = ("<P>", "<S>", "<M>")
#: Units, code points, of a block; RE2 counts repeats up to 1,000.
BLOCK = 64
PIECE_BYTES = 4 << 20

# A block as a list of its units; parts of a list of blocks, from a unit on or up to one.
MACROS = f"""
CREATE MACRO units(block) AS regexp_extract_all(coalesce(block, ''), '(?s).');
CREATE MACRO few(block, a, b) AS array_to_string(list_slice(units(block), a + 1, b), '');
CREATE MACRO whole(blocks, a, b) AS array_to_string(list_slice(blocks, a + 1, b), '');
CREATE MACRO part(blocks, a, b) AS CASE
  WHEN a // {BLOCK} = b // {BLOCK} THEN few(blocks[a // {BLOCK} + 1], a % {BLOCK}, b % {BLOCK})
  ELSE few(blocks[a // {BLOCK} + 1], a % {BLOCK}, {BLOCK}) || whole(blocks, a // {BLOCK} + 1, b // {BLOCK}) || few(blocks[b // {BLOCK} + 1], 0, b % {BLOCK})
END;
CREATE MACRO digits(hash, i) AS CAST('0x' || substr(hash, 8 * i - 7, 8) AS BIGINT);
"""


def _statement(seed: int, fim_percent: int, spm_percent: int) -> str:
    held = " OR ".join(f"contains(text, '{m}')" for m in MARKS)
    return f"""
WITH cut AS (
  SELECT place, text, regexp_extract_all(text, '(?s).{{1,{BLOCK}}}') AS blocks, sha256('{seed}:' || id) AS hash FROM piece
), sized AS (
  SELECT *, CASE WHEN len(blocks) = 0 THEN 0 ELSE {BLOCK} * (len(blocks) - 1) + length(blocks[len(blocks)]) END AS n FROM cut
), placed AS (
  SELECT place, text, blocks, n,
    least(digits(hash, 1) % (n + 1), digits(hash, 2) % (n + 1)) AS a, greatest(digits(hash, 1) % (n + 1), digits(hash, 2) % (n + 1)) AS b,
    CASE WHEN n = 0 OR {held} OR digits(hash, 3) % 100 >= {fim_percent} THEN 'plain' WHEN digits(hash, 4) % 100 < {spm_percent} THEN 'spm' ELSE 'psm' END AS form
  FROM sized
), parts AS (
  SELECT place, n, form, a, b, CASE WHEN form = 'plain' THEN text END AS text,
    CASE WHEN form <> 'plain' THEN part(blocks, 0, a) END AS p, CASE WHEN form <> 'plain' THEN part(blocks, a, b) END AS m, CASE WHEN form <> 'plain' THEN part(blocks, b, n) END AS s
  FROM placed
)
SELECT n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  CASE form WHEN 'psm' THEN '{PREFIX}' || p || '{SUFFIX}' || s || '{MIDDLE}' || m WHEN 'spm' THEN '{SUFFIX}' || s || '{PREFIX}' || p || '{MIDDLE}' || m ELSE text END AS output
FROM parts ORDER BY place
"""


def _pieces(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most PIECE_BYTES of text, or one row."""
    sizes = pc.binary_length(batch.column(column)).to_pylist()
    start = total = 0
    for i, size in enumerate(sizes):
        if i > start and total + size > PIECE_BYTES:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield batch.slice(start)


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, fim_percent: int = 90, spm_percent: int = 20) -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output) for each row; lengths are in code points and null in plain rows."""
    slim = docs.select(
        F.col(id_col).alias("own"), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.make_valid_utf8(F.coalesce(text_col, F.lit(""))).alias("text")
    )
    statement = _statement(int(seed), int(fim_percent), int(spm_percent))
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with duckdb.connect(config={"threads": 1, "temp_directory": ""}) as db:
            db.execute(MACROS)
            for batch in batches:
                for piece in _pieces(batch, 2):
                    rows = pa.table([pa.array(range(len(piece)), pa.int32()), piece.column(1), piece.column(2)], names=["place", "id", "text"])
                    db.register("piece", rows)
                    made = db.sql(statement).to_arrow_table().combine_chunks()
                    db.unregister("piece")
                    cells = [made.column(i).cast(k).combine_chunks() for i, k in enumerate(kinds)]
                    yield pa.RecordBatch.from_arrays([piece.column(0), *cells], names=["id", *made.column_names])

    kind = docs.schema[id_col].dataType.simpleString()
    return slim.mapInArrow(task, f"id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored_text(output: Column | str, form: Column | str) -> Column:
    """The text that ``fill_in_middle`` made ``output`` from."""
    output, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))
    parts = F.split(output, "|".join(map(re.escape, MARKS)), -1)
    psm, spm = F.concat(parts[1], parts[3], parts[2]), F.concat(parts[2], parts[3], parts[1])
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op11_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    made = fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    digest, restored = F.sha2("output", 256), F.sha2(restored_text("output", "form"), 256)
    return made.select(F.col("id").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars", digest.alias("output_sha256"), restored.alias("restored_sha256"))


OP11_SQL = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS hash FROM documents
), h AS (
  SELECT doc_id, text, n, list_transform([1, 9, 17, 25], lambda i: CAST('0x' || substr(hash, i, 8) AS BIGINT)) AS h FROM d
), c AS (
  SELECT doc_id, text, n, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
    CASE WHEN n = 0 OR regexp_matches(text, '<[PSM]>') OR h[3] % 100 >= 90 THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM h
), o AS (
  SELECT *, substr(text, 1, a) AS p, substr(text, a + 1, b - a) AS m, substr(text, b + 1) AS s FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE text END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM o
"""
