"""Readers and writers of the corpus files: JSON lines, CSV exports, trees of JSON files, splits and per-configuration tables."""

from __future__ import annotations

import warnings
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORRUPT = "_corrupt_record"


def read_jsonl(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """One object a line, blank lines skipped; a line that is none stops the job that reads it."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_jsonl_tolerant(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """As ``read_jsonl``, but a line that is no object is a row of nulls with the line in ``_corrupt_record``."""
    known = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    held = T.StructType([*known.fields, T.StructField(CORRUPT, T.StringType())])
    return spark.read.schema(held).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).json(path)


def read_jsonl_files(spark: SparkSession, glob: str, schema: str | T.StructType, name: str = "file") -> DataFrame:
    """All files that match, bad lines dropped, with the file's name; sort by it where an order is needed."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(glob).withColumn(name, F.col("_metadata.file_name"))


def write_jsonl(rows: DataFrame, path: str, append: bool = False) -> None:
    rows.write.mode("append" if append else "overwrite").json(path)


def update_records(base: DataFrame, patch: DataFrame, key: str = "ad_id") -> DataFrame:
    """``base`` with the patch's values in the rows that it names, and ``touched``: columns of the patch replace, maps are merged one level
    deep with the patch's entries on top. A null in the patch is no value."""
    ours = base.columns
    values = [c for c in patch.columns if c != key]
    renamed = patch.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_new_{c}") for c in values], F.lit(True).alias("_there"))
    joined = base.join(renamed, F.col(key) == F.col("_key"), "left")

    def merged(c: str) -> Column:
        old, new = F.col(c), F.col(f"_new_{c}")
        if isinstance(base.schema[c].dataType, T.MapType):
            kept = F.map_filter(old, lambda k, _: ~F.coalesce(F.map_contains_key(new, k), F.lit(False)))
            return F.when(new.isNull(), old).when(old.isNull(), new).otherwise(F.map_concat(kept, new))
        return F.coalesce(new, old)

    added = [F.col(f"_new_{c}").alias(c) for c in values if c not in ours]
    return joined.select(*[merged(c).alias(c) if c in values else F.col(c) for c in ours], *added, F.coalesce("_there", F.lit(False)).alias("touched"))


def flattened(rows: DataFrame, prefixes: dict[str, str] | None = None, maps: dict[str, tuple[str, list[str]]] | None = None, dropped: Iterable[str] = ("raw_data", "demographics")) -> DataFrame:
    """Scalar columns only: structs as prefixed columns, arrays as JSON text (empty for none), the stated keys of maps as columns
    (column: (prefix, keys)), and blobs dropped."""
    prefixes, maps = prefixes or {}, maps or {}
    out: list[Column] = []
    for field in rows.schema:
        name, kind = field.name, field.dataType
        if name in dropped:
            continue
        if name in maps:
            out += [F.col(name)[k].alias(f"{maps[name][0]}_{k}") for k in maps[name][1]]
        elif isinstance(kind, T.StructType):
            out += [F.col(f"{name}.{c}").alias(f"{prefixes.get(name, name)}_{c}") for c in kind.fieldNames()]
        elif isinstance(kind, T.ArrayType):
            out.append(F.when(F.size(name) > 0, F.to_json(name)).otherwise("").alias(name))
        elif not isinstance(kind, T.MapType):
            out.append(F.col(name))
    return rows.select(*out)


def read_csv(spark: SparkSession, path: str, schema: str, nulls: tuple[str, ...] = ("", "NA")) -> DataFrame:
    """A CSV file with a header; every one of ``nulls`` is null before the columns get their types."""
    known = T.StructType.fromDDL(schema)
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in known])
    raw = spark.read.schema(text).option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    value = lambda c: F.when(~F.col(c).isin(*nulls), F.col(c))
    return raw.select(*[value(f.name).try_cast(f.dataType).alias(f.name) for f in known])


# What an export's headers are called, in any case.
CAMPAIGN_HEADERS = {"ad name": "ad_name", "impressions": "impressions", "link clicks": "clicks", "amount spent (usd)": "spend_usd", "amount spent": "spend_usd"}
ALL_CLICKS = "clicks (all)"
CAMPAIGN_TYPES = {"ad_name": "string", "impressions": "bigint", "clicks": "bigint", "spend_usd": "double"}


def campaign_columns(headers: list[str]) -> dict[str, str]:
    """Column of the export for each column we know; all clicks stand in only where link clicks are not named before them."""
    found: dict[str, str] = {}
    for h in headers:
        lower = h.lower().strip()
        name = CAMPAIGN_HEADERS.get(lower) or ("clicks" if lower == ALL_CLICKS and "clicks" not in found else None)
        if name:
            found[name] = h
    missing = sorted(set(CAMPAIGN_TYPES) - set(found))
    if missing:
        raise ValueError(f"columns {missing} are missing; there are {headers}")
    return found


def read_campaign(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.option("header", True).option("inferSchema", False).csv(path)
    return raw.select(*[F.col(f"`{h}`").cast(CAMPAIGN_TYPES[n]).alias(n) for n, h in campaign_columns(raw.columns).items()])


def read_tree(spark: SparkSession, root: str, schema: str, keys: list[str]) -> DataFrame:
    """A file of one JSON object for each key, its folders and name being the key: root/<key 1>/.../<last key>.json."""
    pattern = "/".join(["([^/]+)"] * len(keys)) + r"\.json$"
    rows = spark.read.schema(schema).option("recursiveFileLookup", True).option("multiLine", True).option("pathGlobFilter", "*.json").json(root)
    return rows.select("*", *[F.url_decode(F.regexp_extract(F.col("_metadata.file_path"), pattern, i + 1)).alias(k) for i, k in enumerate(keys)])


def write_split(rows: DataFrame, root: str, name: str) -> None:
    """One folder for each part of the split, so that a reader of one part opens no other."""
    rows.write.mode("overwrite").partitionBy("split").parquet(f"{root}/{name}")


def read_split(spark: SparkSession, root: str, name: str, part: str | None = None) -> DataFrame:
    rows = spark.read.parquet(f"{root}/{name}")
    return rows if part is None else rows.filter(F.col("split") == part)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def write_config(rows: DataFrame, root: str, config: str) -> None:
    rows.write.mode("overwrite").parquet(f"{root}/{config}.parquet")


def read_configs(spark: SparkSession, root: str, configs: list[str]) -> DataFrame:
    """The tables of the configurations that are there, one below the other, with types widened; warns of others, raises without any."""
    there = [c for c in configs if exists(spark, f"{root}/{c}.parquet")]
    for c in sorted(set(configs) - set(there)):
        warnings.warn(f"no table of configuration {c} in {root}", stacklevel=2)
    if not there:
        raise FileNotFoundError(f"no table of {configs} in {root}")
    return concatenated([spark.read.parquet(f"{root}/{c}.parquet").withColumn("config", F.lit(c)) for c in there])


def concatenated(frames: list[DataFrame]) -> DataFrame:
    """One below the other by name; a missing column is null, and numbers of different types become doubles."""
    kinds: dict[str, set[str]] = {}
    for f in frames:
        for name, kind in f.dtypes:
            kinds.setdefault(name, set()).add(kind)
    to = {n: next(iter(k)) if len(k) == 1 else "double" if k <= {"tinyint", "smallint", "int", "bigint", "float", "double"} else "string" for n, k in kinds.items()}
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [f.select(*[F.col(n).cast(to[n]).alias(n) for n in f.columns]) for f in frames])


def cached(spark: SparkSession, root: str, keys: list[str], build, key: str = "platform") -> DataFrame:
    """The table in ``root``, a folder for each value of ``key``; built only where a folder of ``keys`` is missing."""
    if not all(exists(spark, f"{root}/{key}={k}") for k in keys):
        build().write.mode("overwrite").partitionBy(key).parquet(root)
    return spark.read.parquet(root)


def file_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count("*").alias("n"))
