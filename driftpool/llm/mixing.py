"""Mixing sources to target weights (operator 10, DataFrame functions only).

Method: each source's rows are hashed into at most ``BLOCKS`` blocks. The words a
source owes the mix become an exact quota of block draws: whole passes over its
blocks, then as much of one more, permuted pass as comes nearest to the target. A binary
splitting tree shares the quotas out: every node splits its vector of quotas
between two halves of the output shards by a multivariate-hypergeometric draw
(source by source, from the conditional distributions, by inversion with hashed
uniforms), so that each shard is a random sample of the mix of exactly its size.
The shards then take disjoint runs of each source's permuted draws, and rows are
shuffled within their shard. All of it is a function of the seed: reruns agree.

Only block and quota tables (sources x blocks, whatever the rows) are ranked or
gathered; rows meet them in one join on (source, block), where a hot source is
spread over its blocks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from driftpool.llm.common import WORD, cut, table

QUERY_NAME = "op10_mix_sources"
ORACLE_SQL = None  # hashed draws have no SQL counterpart; tests hold them against brute force
BLOCKS, SHARDS, SEED = 4096, 64, 42
WEIGHTS, MAX_REPEATS = (5, 2, 1), 3
BROADCAST_BYTES = 32 * 1024 * 1024


def n_words(text: Column) -> Column:
    """Words of the whole text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _block(id_col: str, text_col: str) -> Column:
    """Block of a row: by its id, or by its text where the id is null."""
    own, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    key = F.when(own.isNull(), F.xxhash64(F.lit(-1), text)).otherwise(F.xxhash64(F.lit(0), own))
    return F.pmod(F.xxhash64(F.lit(SEED), key), F.lit(BLOCKS)).cast("int")


def targets(sizes: DataFrame) -> DataFrame:
    """sizes: one row per source (source, source_size). Adds ``rank`` (by code
    point, null last), and ``target``: all sources' words shared by the repeating
    weights; a target stops at MAX_REPEATS times its source's size and the excess
    is shared again by weight until none is above.

    That is water filling: with sources in order of cap / weight, the level is the
    largest of (words left after the caps before) / (weights from here on)."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]),
                          (F.pmod(F.col("rank"), F.lit(len(WEIGHTS))) + 1).cast("int"))
    t = (sizes.withColumn("rank", F.row_number().over(by_name) - 1)
         .withColumn("weight", weight).withColumn("cap", F.col("source_size") * MAX_REPEATS))
    fill = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    every = Window.partitionBy()
    before = F.coalesce(F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    onward = F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing))
    t = t.withColumn("step", (F.sum("source_size").over(every) - before) / onward)
    t = t.withColumn("level", F.max("step").over(every))
    return t.select("source", "rank", "source_size", F.least(
        F.col("cap").cast("double"), F.col("level") * F.col("weight")).alias("target"))


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def _ln_factorial(x: Column) -> Column:
    """ln x! by Stirling's series at x + 8, to about 1e-12."""
    z = x + F.lit(8.0)
    below = (x + 1.0) * (x + 2.0) * (x + 3.0) * (x + 4.0) * (x + 5.0) * (x + 6.0) * (x + 7.0)
    return ((z - 0.5) * F.ln(z) - z + 0.5 * math.log(2 * math.pi) + 1.0 / (z * 12.0)
            - 1.0 / (z * z * z * 360.0) + 1.0 / (z * z * z * z * z * 1260.0) - F.ln(below))


def _ln_choose(n: Column, k: Column) -> Column:
    return _ln_factorial(n) - _ln_factorial(k) - _ln_factorial(n - k)


def hypergeometric(good: Column, total: Column, need: Column, u: Column) -> Column:
    """The number of good items among ``need`` drawn from ``total`` without return,
    by inversion of the uniform ``u``. The search covers the mean +- 8 standard
    deviations and 8 items, beyond which the mass is below double precision."""
    def spread(a):
        p = a.good / F.greatest(a.total, F.lit(1.0))
        mean = a.need * p
        var = mean * (1.0 - p) * (a.total - a.need) / F.greatest(a.total - 1.0, F.lit(1.0))
        wide = F.sqrt(F.greatest(var, F.lit(0.0))) * 8.0 + 8.0
        low = F.greatest(F.lit(0.0), a.need - (a.total - a.good), F.floor(mean - wide).cast("double"))
        high = F.least(a.need, a.good, F.ceil(mean + wide).cast("double"))
        return F.struct(a.good.alias("good"), a.total.alias("total"), a.need.alias("need"),
                        low.alias("low"), high.alias("high"), a.u.alias("u"))

    def walk(a):
        at_low = F.exp(_ln_choose(a.good, a.low) + _ln_choose(a.total - a.good, a.need - a.low)
                       - _ln_choose(a.total, a.need))
        start = F.struct(at_low.alias("p"), a.u.alias("left"), a.low.alias("k"))

        def step(s, k):
            up = (s.p * (a.good - k) * (a.need - k)
                  / ((k + 1.0) * (a.total - a.good - a.need + k + 1.0)))
            more = (s.left >= s.p) & (s.k == k)
            return F.struct(F.when(more, up).otherwise(s.p).alias("p"),
                            F.when(more, s.left - s.p).otherwise(s.left).alias("left"),
                            F.when(more, k + 1.0).otherwise(s.k).alias("k"))

        ks = F.transform(F.sequence(a.low.cast("long"), a.high.cast("long")), lambda k: k.cast("double"))
        inner = F.filter(ks, lambda k: k < a.high)
        return F.aggregate(inner, start, step, lambda s: s.k)

    args = F.struct(*[c.cast("double").alias(n) for c, n in (
        (good, "good"), (total, "total"), (need, "need"), (u, "u"))])
    return _let(_let(args, spread), walk)


def _uniform(*key: Column) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(1 << 53)).cast("double") / F.lit(float(1 << 53))


def _left_half(quotas: Column, node: Column, level: int, seed: int) -> Column:
    """The quotas of a node's left half: half its draws, rounded down, as a
    multivariate-hypergeometric sample of the node's quotas."""
    total = F.aggregate(quotas, F.lit(0).cast("long"), lambda s, q: s + q)
    start = F.struct(total.cast("double").alias("rest"),
                     F.floor(total / F.lit(2)).cast("double").alias("need"),
                     F.array().cast("array<bigint>").alias("got"))
    numbered = F.transform(quotas, lambda q, i: F.struct(q.alias("q"), i.alias("i")))

    def one(s, x):
        u = _uniform(F.lit(seed), F.lit(level), node, x.i)
        k = hypergeometric(x.q, s.rest, s.need, u)
        return _let(F.struct(k.alias("k"), s.alias("s"), x.alias("x")), lambda v: F.struct(
            (v.s.rest - v.x.q).alias("rest"), (v.s.need - v.k).alias("need"),
            F.concat(v.s.got, F.array(v.k.cast("long"))).alias("got")))

    return F.aggregate(numbered, start, one, lambda s: s.got)


def split_quotas(quotas: DataFrame, shards: int, seed: int = SEED) -> DataFrame:
    """quotas: one row per source (rank from 0, quota). (shard, rank, quota) for
    every output shard; a source's quotas add up exactly. ``shards`` is a power of
    two. A node of the tree is one row with an array of one number a source."""
    if shards < 1 or shards & (shards - 1):
        raise ValueError("shards must be a power of two")
    pairs = F.sort_array(F.collect_list(F.struct("rank", "quota")))
    nodes = quotas.agg(pairs.alias("p")).select(
        F.lit(0).cast("long").alias("shard"), F.transform("p", lambda x: x.quota).alias("qs"))
    for level in range(shards.bit_length() - 1):
        halves = nodes.withColumn("left", _left_half(F.col("qs"), F.col("shard"), level, seed))
        rest = F.zip_with("qs", "left", lambda a, b: a - b)
        nodes = halves.select(F.inline(F.array(
            F.struct((F.col("shard") * 2).alias("shard"), F.col("left").alias("qs")),
            F.struct((F.col("shard") * 2 + 1).alias("shard"), rest.alias("qs")))))
    return nodes.select("shard", F.posexplode("qs").alias("rank", "quota"))


def plan(rows: DataFrame, shards: int = SHARDS, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """rows: source, block, size. (draws, sources): draws has a row (source, block,
    pass, shard) for each time a block is taken, sources the targets. Runs jobs;
    both tables are written, at most 3 x sources x BLOCKS and one row a source."""
    blocks = cut(rows.groupBy("source", "block").agg(F.sum("size").alias("words")), "blocks")
    sizes = blocks.groupBy("source").agg(F.sum("words").alias("source_size"))
    sources = cut(targets(sizes), "targets")
    names = sources.select(F.col("source").alias("name"), "rank", "source_size", "target")
    owed = (blocks.join(names, F.col("source").eqNullSafe(F.col("name")))
            .withColumn("passes", F.when(F.col("source_size") > 0, F.floor(
                F.col("target") / F.col("source_size"))).otherwise(0).cast("int"))
            .withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size")))
    order = lambda turn: F.xxhash64(F.lit(seed), "rank", turn, "block")
    # one more pass: blocks in permuted order, each that still fits, then the one
    # block nearest to what is left; at most BLOCKS entries an array
    turn = owed.groupBy("rank").agg(F.first("rest").alias("rest"), F.sort_array(F.collect_list(
        F.struct(order(F.col("passes")).alias("o"), "block", "words"))).alias("all"))
    none = F.struct(F.col("rest").alias("left"), F.array().cast("array<int>").alias("got"))
    fit = F.aggregate("all", none, lambda s, x: F.when(x.words <= s.left, F.struct(
        (s.left - x.words).alias("left"), F.concat(s.got, F.array(x.block)).alias("got"))).otherwise(s))
    turn = turn.select("rank", fit.alias("fit")).select("rank", "fit.left", "fit.got")
    owed = owed.join(turn, "rank").withColumn("fits", F.array_contains("got", F.col("block")))
    miss = F.abs(F.col("words") - F.col("left"))
    near = F.row_number().over(Window.partitionBy("rank").orderBy(
        "fits", miss, order(F.col("passes")), "block"))
    owed = owed.withColumn("more", (F.col("fits") | ((near == 1) & (miss < F.col("left")))).cast("int"))
    turns = F.col("passes") + F.col("more")
    draws = (owed.where(turns > 0)
             .select("source", "rank", "block", F.explode(F.sequence(F.lit(0), turns - 1)).alias("pass"))
             .withColumn("draw", F.row_number().over(Window.partitionBy("rank").orderBy(
                 "pass", order(F.col("pass")), "block")) - 1))
    draws = cut(draws, "draws")
    quotas = draws.groupBy("rank").agg(F.count(F.lit(1)).alias("quota"))
    quotas = sources.select("rank").join(quotas, "rank", "left").na.fill(0, ["quota"])
    runs = cut(split_quotas(quotas, shards, seed), "shard-quotas").where("quota > 0")
    ahead = F.coalesce(F.sum("quota").over(Window.partitionBy("rank").orderBy("shard").rowsBetween(
        Window.unboundedPreceding, -1)), F.lit(0))
    slots = (runs.withColumn("from", ahead)
             .select("rank", "shard", F.explode(F.sequence(
                 F.col("from"), F.col("from") + F.col("quota") - 1)).alias("draw")))
    return (cut(draws.join(slots, ["rank", "draw"]).select("source", "block", "pass", "shard"),
                "draws-by-shard"), sources)


def _sized(df: DataFrame, id_col: str, source_col: str, text_col: str) -> DataFrame:
    return cut(df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").alias("source"),
                         _block(id_col, text_col).alias("block"),
                         n_words(F.col(f"`{text_col}`")).alias("size")), "sizes")


def _beside(small: DataFrame, row_bytes: int) -> DataFrame:
    """Hinted for broadcast where its measured size allows, else for a merge join."""
    fits = small.count() * row_bytes <= BROADCAST_BYTES
    return F.broadcast(small) if fits else small.hint("merge")


def mix_counts(df: DataFrame, id_col: str = "doc_id", source_col: str = "source",
               text_col: str = "text", shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """One row per row of ``df``: id, size, source_size, target (its source's) and
    taken, the words the mix takes of it, repeats counted.

    Null text has size 0; null sources form one source, last. Rows repeated with
    their id are drawn together. A source without words has target 0 and an empty
    table gives none. Other columns are ignored. Runs jobs."""
    rows = _sized(df, id_col, source_col, text_col)
    draws, sources = plan(rows, shards, seed)
    times = draws.groupBy(F.col("source").alias("s"), F.col("block").alias("b")).agg(
        F.count(F.lit(1)).alias("times"))
    names = sources.select(F.col("source").alias("name"), "source_size", "target")
    out = (rows.join(_beside(cut(times, "times"), 64), F.col("source").eqNullSafe(F.col("s"))
                     & (F.col("block") == F.col("b")), "left")
           .join(_beside(names, 64), F.col("source").eqNullSafe(F.col("name"))))
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target",
                      (F.col("size") * F.coalesce("times", F.lit(0))).alias("taken"))


def mix(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
        shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """The mix itself: the rows of ``df``, each as often as it is drawn, with its
    output ``shard`` and ``pass`` (columns of those names are replaced), in random
    order within a shard. See ``mix_counts`` for nulls, ties and empty tables.
    Runs jobs for the plan."""
    draws, _ = plan(_sized(df, id_col, source_col, text_col), shards, seed)
    draws = draws.select(F.col("source").alias("__s"), F.col("block").alias("__b"),
                         F.col("pass").alias("__p"), F.col("shard").alias("__shard"))
    rows = df.drop("shard", "pass").withColumn("__block", _block(id_col, text_col))
    out = rows.join(_beside(draws, 64), F.col(f"`{source_col}`").eqNullSafe(F.col("__s"))
                    & (F.col("__block") == F.col("__b")))
    key = F.xxhash64(F.lit(seed), "__shard", "__p", F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))
    # a shard is spread over tasks by its random key, so that none must fit in one
    out = (out.withColumn("__key", key)
           .repartition("__shard", F.pmod("__key", F.lit(64)))
           .sortWithinPartitions("__shard", "__key"))
    own = [F.col(f"`{c}`") for c in df.columns if c.lower() not in ("shard", "pass")]
    return out.select(*own, F.col("__shard").alias("shard"), F.col("__p").alias("pass"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_counts(table(spark, sf_dir, "documents"))
