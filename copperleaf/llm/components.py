"""Connected components of a graph given as edges, by alternating star contractions.

Each round replaces every edge by one to the smallest known neighbour, first on the side of the
larger nodes, then of the smaller ones; the graph ends as stars around the smallest node of each
component, after a number of rounds that grows with the logarithm of the graph's diameter. A round
is two aggregations and two joins, in which hubs are broadcast and the other nodes shuffled; its edges are written to the shared
folder, so a lost executor costs one round at most and nothing is gathered on the driver but a count and a checksum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from copperleaf.cluster import join_counted, materialise


def _with_least(edges: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """The edges with ``m``, the smallest neighbour of their u; and (_u, m, n). The neighbours of a hub are joined where they lie."""
    least = materialise(edges.groupBy(F.col("u").alias("_u")).agg(F.min("v").alias("m"), F.count("*").alias("n")), name)
    return join_counted(edges, "u", least, "_u", "n"), least


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both, "least-of-all")[0].filter("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    edges = materialise(edges, "large-star")
    known, least = _with_least(edges, "least")
    down = known.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return down.unionByName(least.select(F.col("_u").alias("u"), F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): each node that an edge names, with the smallest node of its component.

    Nulls and loops are ignored; repeated and reversed edges are the same edge; no edges give an
    empty table. The smallest node of a component is in the result as its own root.
    """
    directed = edges.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v"))
    links = materialise(directed.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") > F.col("v"))).distinct(), "links")
    sign = None
    while True:
        now = links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == sign or now[0] == 0:
            break
        sign, links = now, materialise(_small_star(_large_star(links)), "links")
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
