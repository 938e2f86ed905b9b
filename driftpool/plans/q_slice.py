"""First slice: for each day with news and a bar, the mean news vector and
whether the next bar rose (A01, W01, W02, J01)."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftpool import fixtures as fx
from driftpool.functions.vectors import explode_elements
from driftpool.operators import features, joins, pooling
from driftpool.plans.oracle import sql
from driftpool.plans.registry import register

R = 6

MEAN_SQL = """
SELECT series, day, count(*) AS n_items, CAST(i AS INTEGER) AS i, avg(x) AS x
FROM (SELECT series, day, unnest(range(len(v))) AS i, unnest(v) AS x FROM vecs)
GROUP BY series, day, i
"""


def labelled_bars(spark, sf_dir, drop_unknown=True):
    b = features.next_day_change(fx.bars(spark, sf_dir))
    return features.direction_label(b, drop_unknown=drop_unknown)


def daily_vectors_with_direction(spark, sf_dir):
    """The flagship: pooled vector per day joined with the next-day direction."""
    pooled = pooling.daily_mean_vector(fx.vecs(spark, sf_dir))
    lb = labelled_bars(spark, sf_dir).select("series", "day", "next_change", "label")
    return joins.daily_vector_price_join(pooled, lb)


@register("daily_mean_vector", sql(f"""
SELECT series, day, n_items, i, round(x, {R}) AS x FROM ({MEAN_SQL})""", "vecs"), dates="day")
def q_daily_mean_vector(spark, sf_dir):
    pooled = pooling.daily_mean_vector(fx.vecs(spark, sf_dir))
    return explode_elements(pooled, ["series", "day", "n_items"])


@register("next_day_change", sql(f"""
SELECT series, day, round(change_pct, {R}) AS change_pct,
       round(lead(change_pct) OVER (PARTITION BY series ORDER BY day), {R}) AS next_change
FROM bars_multi""", "bars_multi"), dates="day")
def q_next_day_change(spark, sf_dir):
    b = features.next_day_change(fx.bars(spark, sf_dir, multi=True))
    return b.select("series", "day", F.round("change_pct", R).alias("change_pct"),
                    F.round("next_change", R).alias("next_change"))


@register("direction_label", sql("""
SELECT series, day, CAST(coalesce(nc > 0, false) AS INTEGER) AS label, nc IS NOT NULL AS known
FROM (SELECT series, day, lead(change_pct) OVER (PARTITION BY series ORDER BY day) AS nc
      FROM bars_multi)""", "bars_multi"), dates="day")
def q_direction_label(spark, sf_dir):
    """``label`` with NULL next change -> 0; ``known`` = false marks the rows the
    drop-unknown variant removes."""
    b = features.next_day_change(fx.bars(spark, sf_dir, multi=True))
    return features.direction_label(b).select(
        "series", "day", "label", F.col("next_change").isNotNull().alias("known"))


@register("daily_vector_price_join", sql(f"""
SELECT m.series, m.day, m.n_items, round(b.nc, {R}) AS next_change,
       CAST(b.nc > 0 AS INTEGER) AS label, m.i, round(m.x, {R}) AS x
FROM ({MEAN_SQL}) m
JOIN (SELECT series, day, lead(change_pct) OVER (PARTITION BY series ORDER BY day) AS nc
      FROM bars) b ON m.series = b.series AND m.day = b.day
WHERE b.nc IS NOT NULL""", "vecs", "bars"), dates="day")
def q_daily_vector_price_join(spark, sf_dir):
    j = daily_vectors_with_direction(spark, sf_dir)
    j = j.withColumn("next_change", F.round("next_change", R))
    return explode_elements(j, ["series", "day", "n_items", "next_change", "label"])
