"""Connected components of an edge table, as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftpool.llm.common import cut, forget


def _with_min(pairs: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """``pairs`` (u, v) with m, the smallest of u and its partners, and the written
    minima. These are combined on the map side and written, so that both sides of the
    join are plain shuffles, which adaptive execution may split at a hot u."""
    low = cut(pairs.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), name)
    return pairs.join(low.hint("merge"), "u"), low


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns u, v): root is the
    smallest node its component holds. Alternates large-star and small-star
    rounds, which turn every component into a star in a logarithmic number of
    rounds; no component is ever gathered. Self-loops, repeated edges and null
    ends are dropped; a node without a partner has no row. Runs jobs."""
    e = (edges.select("u", "v").where("u is not null and v is not null and u <> v")
         .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    e = cut(e, "edges")
    if e.isEmpty():
        return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    before = None
    for _ in range(max_rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        starred, first = _with_min(both, "large")
        large = cut(starred.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(),
                    "large-star")
        small, second = _with_min(large, "small")
        small = (small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
                 .union(small.select("u", F.col("m").alias("v"))).distinct())
        e, old = cut(small, "small-star"), e
        forget(old, first, large, second)  # a round reads its predecessor's edges alone
        # order-free digest of the edge set; equal in two rounds: nothing moved
        now = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")),
                    F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = e.select(F.col("v").alias("node")).distinct()
    return (e.select(F.col("u").alias("node"), F.col("v").alias("root"))
            .union(roots.select("node", F.col("node").alias("root"))))
