"""Pages of many queries as one stream: each query's cursor, pages and done flag as keyed state, and each ad once, the first time it is seen.

A call is a row: (query, page, last_hit, has_next, ads). It becomes a row of the query and a row for each ad, and one stateful
operator keeps both kinds of state: for a query how far it is, for an ad that it was seen. Keys are dealt out to BUCKETS by their hash, and a bucket keeps its
keys in a map, so that Python is called once for a bucket and batch, not once for a key; of a batch it reads and writes only the keys that came. State lives in RocksDB beside the heap; with a
time to live, ads that were not seen for so long count as new. A stream that dies between or within batches goes on from its checkpoint and writes the same rows.

A query is done when there is no next page, no cursor or nothing on the page; later calls of it change nothing. A query that is not done and whose
cursor is lost starts anew at page 1: so it is asked for, and a call of page 1 is taken. A row with ``restored`` sets where its query stands, as a
checkpoint from elsewhere says.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

CALL = "query string, page int, last_hit string, has_next boolean, ads array<string>, restored struct<pages_fetched:int,last_hit:string,done:boolean>"
ROW = "kind string, key string, query string, page int, calls long, pages_fetched int, last_hit string, done boolean, next_page int"


COLUMNS = [c.split()[0] for c in ROW.split(", ")]
#: Groups of keys of each kind. A task holds the calls of one of them in one batch, and of its ads the distinct ones.
BUCKETS = 1024


class _Sweep(StatefulProcessor):
    def __init__(self, keep_ms: int | None):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.queries = handle.getMapState("queries", "key string", "calls long, pages_fetched int, last_hit string, done boolean")
        self.seen = handle.getMapState("seen", "key string", "page int", self.keep_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        made = self._ads(rows) if key[0] == "ad" else self._calls(rows)
        if made:
            yield pd.DataFrame(made, columns=COLUMNS, dtype=object)

    def _ads(self, rows: Iterator[pd.DataFrame]) -> list[tuple]:
        first: dict[str, tuple] = {}
        for came in rows:
            came = came[["key", "text", "page"]].fillna({"page": np.inf}).sort_values(["text", "page"]).drop_duplicates("key")
            for ad, *shown in came.itertuples(index=False, name=None):
                if ad not in first or shown < first[ad]:
                    first[ad] = shown
        made = []
        for ad, (query, page) in first.items():
            if not self.seen.containsKey((ad,)):
                page = None if page == np.inf else int(page)
                self.seen.updateValue((ad,), (page,))
                made.append(("ad", ad, query, page, None, None, None, None, None))
        return made

    def _calls(self, rows: Iterator[pd.DataFrame]) -> list[tuple]:
        made = []
        came = pd.concat(list(rows)).sort_values(["key", "page"], na_position="first")
        fields = ["key", "page", "text", "ends", "restored_pages"]
        for name, its in groupby(came[fields].itertuples(index=False, name=None), key=itemgetter(0)):
            calls, pages, hit, done = self.queries.getValue((name,)) or (0, 0, None, False)
            for _, page, last_hit, ends, restored_pages in its:
                if restored_pages == restored_pages:
                    pages, hit, done = int(restored_pages), last_hit, bool(ends)
                    calls += 1
                    continue
                lost = pages > 0 and hit is None
                if done or page != (1 if lost else pages + 1):
                    continue  # a call again, or of another page than was asked for
                pages, hit, done, calls = int(page), last_hit, bool(ends), calls + 1
            self.queries.updateValue((name,), (calls, pages, hit, done))
            ask = None if done else 1 if hit is None else pages + 1
            made.append(("query", name, name, None, calls, pages, hit, done, ask))
        return made

    def close(self) -> None:
        pass


def swept(calls: DataFrame, keep_ms: int | None = None) -> DataFrame:
    """Rows of kind ad, one for each ad when it is first seen, with its query and page; and of kind query, how a query stands after a batch that called it:
    its calls so far, pages, cursor, whether it is done, and the page that it asks for next."""
    page = F.struct(F.lit("query").alias("kind"), F.col("query").alias("key"))
    ads = F.transform(F.coalesce("ads", F.array().cast("array<string>")), lambda a: F.struct(F.lit("ad").alias("kind"), a.alias("key")))
    each = F.explode(F.concat(F.array(page), F.filter(ads, lambda a: F.coalesce(a["key"], F.lit("")) != "")))
    # few columns, since each costs Python time for each row: text is an ad's query or a call's cursor, and a restored call brings its own cursor and end
    set_, pages = F.col("restored.pages_fetched").isNotNull(), F.col("restored.pages_fetched").cast("double")
    ends = ~F.coalesce("has_next", F.lit(False)) | F.col("last_hit").isNull() | (F.coalesce(F.size("ads"), F.lit(0)) <= 0)
    rows = calls.filter(F.col("query").isNotNull()).select(each.alias("e"), "query", "page", F.when(set_, F.col("restored.last_hit")).otherwise(F.col("last_hit")).alias("hit"), F.when(set_, F.coalesce("restored.done", F.lit(False))).otherwise(ends).alias("ends"), F.coalesce(pages, F.lit(float("nan"))).alias("restored_pages"))
    text = F.when(F.col("e.kind") == "ad", F.col("query")).otherwise(F.col("hit")).alias("text")
    rows = rows.select("e.kind", F.pmod(F.hash("e.key"), F.lit(BUCKETS)).alias("bucket"), "e.key", "page", text, "ends", "restored_pages")
    mode = "None" if keep_ms is None else "ProcessingTime"
    return rows.groupBy("kind", "bucket").transformWithStateInPandas(_Sweep(keep_ms), outputStructType=ROW, outputMode="Append", timeMode=mode)


def run_sweep(calls: DataFrame, path: str, checkpoint: str, keep_ms: int | None = None) -> None:
    """Take in what is there now, and stop; rows are added to the table in ``path`` once, however often a batch is run."""
    query = swept(calls, keep_ms).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start()
    query.awaitTermination()


def first_seen(rows: DataFrame) -> DataFrame:
    return rows.filter("kind = 'ad'").select(F.col("key").alias("ad_id"), "query", "page")


def standing(rows: DataFrame) -> DataFrame:
    """(query, calls, pages_fetched, last_hit, done, next_page): each query after its last call."""
    last = rows.filter("kind = 'query'").groupBy("key").agg(F.max_by(F.struct("pages_fetched", "last_hit", "done", "next_page"), "calls").alias("l"), F.max("calls").alias("calls"))
    return last.select(F.col("key").alias("query"), "calls", "l.*")
