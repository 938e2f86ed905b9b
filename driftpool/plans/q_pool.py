"""Attention pooling, padded day sequences and the pooling gap."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftpool import fixtures as fx
from driftpool.functions.vectors import explode_elements
from driftpool.operators import pooling
from driftpool.plans.oracle import sql
from driftpool.plans.registry import register

R = 6
DIM = 64


def score_weights(dim: int = DIM) -> list[float]:
    """The pooling head's parameters for the queries: a fixed rule, not data."""
    return [((i % 7) - 3) / 10.0 for i in range(dim)]


def weights_df(spark, dim: int = DIM):
    return spark.createDataFrame([(score_weights(dim),)], "w array<double>")


_W_SQL = "SELECT [" + ", ".join(f"CAST({x!r} AS DOUBLE)" for x in score_weights()) + "] AS w"

_ATT = """
WITH sc AS (SELECT series, day, vec_id, v, list_dot_product(CAST(v AS DOUBLE[]), w) AS score
            FROM vecs, wt),
mx AS (SELECT series, day, max(score) AS m FROM sc GROUP BY series, day),
e AS (SELECT sc.series, sc.day, sc.v, exp(sc.score - mx.m) AS wt
      FROM sc JOIN mx ON sc.series = mx.series AND sc.day = mx.day)
SELECT series, day, CAST(i AS INTEGER) AS i, sum(wt * x) / sum(wt) AS x, count(*) AS n_items
FROM (SELECT series, day, wt, unnest(range(len(v))) AS i, unnest(v) AS x FROM e)
GROUP BY series, day, i"""

_MEAN_I = """
SELECT series, day, CAST(i AS INTEGER) AS i, avg(x) AS x, count(*) AS n_items
FROM (SELECT series, day, unnest(range(len(v))) AS i, unnest(v) AS x FROM vecs)
GROUP BY series, day, i"""


def _attention(spark, sf_dir):
    return pooling.attention_pool(fx.vecs(spark, sf_dir), weights_df(spark))


@register("attention_pool", sql(f"SELECT series, day, n_items, i, round(x, {R}) AS x FROM ({_ATT})",
                                "vecs", extra=[("wt", _W_SQL)]), dates="day")
def q_attention_pool(spark, sf_dir):
    return explode_elements(_attention(spark, sf_dir), ["series", "day", "n_items"])


@register("pooling_gap", sql("""
SELECT a.series, a.day, m.n_items, round(avg((a.x - m.x) * (a.x - m.x)), 9) AS gap
FROM att a JOIN mean_i m ON a.series = m.series AND a.day = m.day AND a.i = m.i
WHERE m.n_items >= 2
GROUP BY a.series, a.day, m.n_items""", "vecs",
                             extra=[("wt", _W_SQL), ("att", _ATT), ("mean_i", _MEAN_I)]),
          dates="day")
def q_pooling_gap(spark, sf_dir):
    mean = pooling.daily_mean_vector(fx.vecs(spark, sf_dir))
    g = pooling.pooling_gap(_attention(spark, sf_dir), mean)
    return g.select("series", "day", "n_items", F.round("gap", 9).alias("gap"))


@register("padded_daily_sequences", sql(f"""
SELECT series, day, CAST(n AS INTEGER) AS length, CAST(max(n) OVER () AS INTEGER) AS padded_len,
       CAST(n AS INTEGER) AS mask_ones, round(CAST(first_v0 AS DOUBLE), {R}) AS first_v0,
       round(CAST(last_v0 AS DOUBLE), {R}) AS last_v0
FROM (SELECT series, day, count(*) AS n, arg_min(v[1], (ts, vec_id)) AS first_v0,
             arg_max(v[1], (ts, vec_id)) AS last_v0
      FROM vecs GROUP BY series, day HAVING count(*) >= 2)""", "vecs"), dates="day")
def q_padded_daily_sequences(spark, sf_dir):
    p = pooling.padded_daily_sequences(fx.vecs(spark, sf_dir))
    return p.select("series", "day", "length", F.size("seq").alias("padded_len"),
                    F.aggregate("mask", F.lit(0), lambda a, x: a + x).alias("mask_ones"),
                    F.round(F.col("seq")[0][0].cast("double"), R).alias("first_v0"),
                    F.round(F.col("seq")[F.col("length") - 1][0].cast("double"), R).alias("last_v0"))


@register("daily_sequence_positions", sql("""
SELECT series, day, CAST(row_number() OVER (PARTITION BY series, day ORDER BY ts, vec_id) - 1 AS BIGINT) AS pos,
       vec_id, CAST(count(*) OVER (PARTITION BY series, day) AS BIGINT) AS length,
       CAST(max(n) OVER () AS BIGINT) AS padded_len
FROM (SELECT *, count(*) OVER (PARTITION BY series, day) AS n FROM vecs)
WHERE n >= 2""", "vecs"), dates="day")
def q_daily_sequence_positions(spark, sf_dir):
    """A14 long form: item positions per multi-item day (skew-safe)."""
    p = pooling.daily_sequence_positions(fx.vecs(spark, sf_dir))
    return p.select("series", "day", "pos", "vec_id", "length", "padded_len")


_BATCHED = f"""
SELECT series, day, length, batch, CAST(ceil(max(length) OVER (PARTITION BY batch) / CAST({pooling.CHUNK} AS DOUBLE))
       * {pooling.CHUNK} AS BIGINT) AS padded_len
FROM (SELECT series, day, n AS length,
             CAST((row_number() OVER (ORDER BY series, day) - 1) // {pooling.BATCH_DAYS} AS BIGINT) AS batch
      FROM (SELECT series, day, count(*) AS n FROM vecs GROUP BY series, day HAVING count(*) >= 2))"""


@register("padded_sequence_batches", sql(f"""
SELECT d.series, d.day, d.batch, d.chunk, d.length, d.padded_len,
       CAST(greatest(0, least({pooling.CHUNK}, d.length - d.chunk * {pooling.CHUNK})) AS INTEGER) AS mask_ones,
       {pooling.CHUNK} AS positions, round(coalesce(c.x, 0), 4) AS checksum
FROM (SELECT *, unnest(range(padded_len // {pooling.CHUNK})) AS chunk FROM batched) d
LEFT JOIN (SELECT series, day, (pos - 1) // {pooling.CHUNK} AS chunk,
                  sum(((pos - 1) % {pooling.CHUNK} + 1) * list_sum(list_transform(v,
                      lambda x, i: CAST(x AS DOUBLE) * i))) AS x
           FROM (SELECT *, row_number() OVER (PARTITION BY series, day ORDER BY ts, vec_id) AS pos FROM vecs)
           GROUP BY 1, 2, 3) c
  ON c.series = d.series AND c.day = d.day AND c.chunk = d.chunk""", "vecs",
                                        extra=[("batched", _BATCHED)]), dates="day")
def q_padded_sequence_batches(spark, sf_dir):
    """A14 as padded batches; the checksum weighs every element by its place."""
    p = pooling.padded_sequence_batches(fx.vecs(spark, sf_dir), dim=DIM)
    row = lambda x: F.aggregate(F.transform(x, lambda e, i: e.cast("double") * (i + 1)),
                                F.lit(0.0), lambda a, e: a + e)
    total = F.aggregate(F.transform("seq", lambda x, i: row(x) * (i + 1)), F.lit(0.0), lambda a, e: a + e)
    return p.select("series", "day", "batch", "chunk", "length", "padded_len",
                    F.aggregate("mask", F.lit(0), lambda a, x: a + x).alias("mask_ones"),
                    F.size("seq").alias("positions"), F.round(total, 4).alias("checksum"))
