"""What every job needs from the cluster: the shared folder, written tables, safe column names."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"
FALLBACK_DIR = "/tmp/checkpoints"
#: Rows of a few numbers each that are broadcast at most: some 50 MB.
BROADCAST_ROWS = 1_000_000
#: A key with more than this share of all rows is hot; so there are at most 10,000 hot keys.
HOT_SHARE = 1e-4


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is the one the cluster names in ``spark.checkpoint.dir``, else the session's checkpoint
    folder. Only where neither is set in a local session (a test) is a local folder used and set.
    """
    context = spark.sparkContext
    named = context.getConf().get(CHECKPOINT_KEY) or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local"):
            raise ValueError(f"{CHECKPOINT_KEY} names no folder that the driver and all executors share")
        named = FALLBACK_DIR
        context.setCheckpointDir(named)
    return named.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; it does not exist yet."""
    return f"{shared_dir(spark)}/copperleaf/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, rows_per_file: int = 0) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again.

    This cuts the lineage, survives the loss of any executor, and gives the planner the true
    size of the table, so that a join is broadcast only below the session's threshold. Files of few rows
    are for few large rows that are to be read by tasks of their own; 0 sets no limit.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("maxRecordsPerFile", rows_per_file).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_if_small(keys: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A written table of keys, marked for broadcast if it has at most ``most`` rows.

    A larger one comes back as it is; the planner then shuffles both sides by the key.
    """
    return F.broadcast(keys) if keys.count() <= most else keys


def join_counted(left: DataFrame, left_key: str, right: DataFrame, right_key: str, rows: str) -> DataFrame:
    """Inner join with a written table of unique keys that says in ``rows`` how many rows of ``left`` each key has.

    Hot keys, at most 1 / HOT_SHARE of them, are broadcast and so joined where their rows lie; the rows of
    the others are shuffled, and none of those keys has more than HOT_SHARE of all rows.
    """
    total = right.agg(F.sum(rows)).first()[0] or 0
    hot = F.broadcast(right.filter(F.col(rows) > total * HOT_SHARE))
    rest = right.filter(F.col(rows) <= total * HOT_SHARE)
    same = F.col(left_key) == F.col(right_key)
    return left.join(hot, same).unionByName(left.join(hot.select(right_key), same, "left_anti").join(rest, same))


def drop_scratch(spark: SparkSession) -> bool:
    """Delete all tables that ``materialise`` has written; only between jobs."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/copperleaf")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """For each name one that ``df`` has no column of, whatever the case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out
