"""Connected components by alternating large-star and small-star rounds, in DataFrame operations only.

Every round joins the edges with each node's smallest neighbour. That is aggregated before its shuffle and dealt anew, so
the join meets plain exchanges with a unique side, and Spark splits the edges of a hub among tasks. Once a round begins with
no more than ``SMALL`` edges, which is counted, its edges are one partition and nothing is shuffled (their aggregates are
broadcast, of a few MB at most). Rounds end when the set of edges no longer changes, after O(log^2 n) of them. Each round's
edges are cut by a reliable checkpoint. Nothing is collected but a count and a checksum of the edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from territory.llm.common import cut, plain

#: Most edges that are handled in one partition.
SMALL = 1 << 18


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def _oriented(a: str, b: str):
    return F.greatest(a, b).alias("u"), F.least(a, b).alias("v")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge; component is the smallest node it reaches.

    Edges with a null end and loops are ignored, repeated edges count once; no edges give no rows.
    """
    e = cut(edges.select(F.col(a).alias("__a"), F.col(b).alias("__b")).where("__a <> __b").select(*_oriented("__a", "__b")).distinct())
    seen = _signature(e)
    while seen[0]:
        small = seen[0] <= SMALL
        dealt = (lambda df: df) if small else (lambda df: plain(df, "u"))
        sym = (e.coalesce(1) if small else e).select(F.expr("inline(array(struct(u, v), struct(v as u, u as v)))"))
        low = sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = sym.where("v > u").join(dealt(low), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        e = cut(large.join(dealt(low), "u").select(F.expr("inline(array(struct(u, m as v), struct(v as u, m as v)))")).where("u <> v").distinct())
        now = _signature(e)
        if now == seen:
            break
        seen = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
