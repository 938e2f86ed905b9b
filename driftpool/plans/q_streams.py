"""Streaming queries (T01-T03): the stream runs to completion over the fixture
split into time-ordered files; the query returns the resulting sink table."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from driftpool import fixtures as fx
from driftpool.functions.vectors import explode_elements
from driftpool.plans.oracle import sql
from driftpool.plans.q_slice import MEAN_SQL, R
from driftpool.plans.registry import register
from driftpool.session import shared_path
from driftpool.streaming import streams

N_FILES = 4
REPLAY_BEFORE = "1995-03-01"  # rows of the first months are sent again


def _feed(spark, df, name, day_col):
    src = shared_path(spark, name)
    streams.write_time_chunks(df, src, day_col, N_FILES)
    return src


@register("stream_intake", sql("""
SELECT channel_id, message_id, date, text FROM news WHERE text IS NOT NULL AND text <> ''""", "news"),
          timestamps="date")
def q_stream_intake(spark, sf_dir):
    """T01 over the news split in time-ordered files, then run again over a
    replay of the first months: every key lands once."""
    news = fx.news(spark, sf_dir).withColumn("_d", F.to_date("date"))
    src = _feed(spark, news, "news-stream", "_d")
    schema = spark.read.parquet(src).schema
    base = shared_path(spark, "intake")
    target, ckpt = os.path.join(base, "table"), os.path.join(base, "ckpt")
    streams.stream_intake(spark, src, schema, target, ckpt).awaitTermination()
    # a replayed file (same rows again) arrives later: nothing new lands
    (spark.read.parquet(src).where(F.col("_d") < F.lit(REPLAY_BEFORE).cast("date"))
     .write.mode("append").parquet(src))
    streams.stream_intake(spark, src, schema, target, ckpt).awaitTermination()
    return streams.read_intake(spark, target, schema).select("channel_id", "message_id", "date", "text")


def _vec_stream(spark, sf_dir):
    vecs = fx.vecs(spark, sf_dir).select("series", "vec_id", "ts", "day", "v")
    src = _feed(spark, vecs, "vec-stream", "day")
    return src, spark.read.parquet(src).schema


@register("stream_daily_pool", sql("""
SELECT series, day, count(*) AS n_items FROM vecs
WHERE CAST(day AS TIMESTAMP) + INTERVAL 2 DAY <= (SELECT max(ts) FROM vecs)
GROUP BY series, day""", "vecs"), dates="day")
def q_stream_daily_pool(spark, sf_dir):
    """Days closed by the watermark (1 day behind the newest item):
    a day [d, d+1) is final once the newest item is at least d + 2 days."""
    src, schema = _vec_stream(spark, sf_dir)
    base = shared_path(spark, "daily-pool")
    out, ckpt = os.path.join(base, "out"), os.path.join(base, "ckpt")
    streams.stream_daily_pool(spark, src, schema, out, ckpt).awaitTermination()
    return streams.read_batches(spark, out).select("series", "day", "n_items")


def _run_pool(spark, sf_dir):
    """(source folder, its schema, sink, checkpoint) of the pool stream, run over the feed."""
    src, schema = _vec_stream(spark, sf_dir)
    base = shared_path(spark, "daily-pool")
    out, ckpt = os.path.join(base, "out"), os.path.join(base, "ckpt")
    streams.stream_daily_pool(spark, src, schema, out, ckpt).awaitTermination()
    return src, schema, out, ckpt


@register("stream_daily_pool_vectors", sql(f"""
SELECT series, day, n_items, i, round(x, {R}) AS x FROM ({MEAN_SQL})
WHERE CAST(day AS TIMESTAMP) + INTERVAL 2 DAY <= (SELECT max(ts) FROM vecs)""", "vecs"), dates="day")
def q_stream_daily_pool_vectors(spark, sf_dir):
    """Every element of the closed days' mean vectors."""
    _, _, out, _ = _run_pool(spark, sf_dir)
    return explode_elements(streams.read_batches(spark, out), ["series", "day", "n_items"])


@register("stream_pool_accounting", sql(f"""
SELECT series, day, n * (1 + again) AS n_source, CASE WHEN closed THEN n ELSE 0 END AS n_pooled,
       CASE WHEN closed THEN n * again ELSE 0 END AS n_late,
       CASE WHEN closed THEN 0 ELSE n * (1 + again) END AS n_open, 0 AS n_undated
FROM (SELECT series, day, count(*) AS n, CAST(day < DATE '{REPLAY_BEFORE}' AS INTEGER) AS again,
             CAST(day AS TIMESTAMP) + INTERVAL 2 DAY <= (SELECT max(ts) FROM vecs) AS closed
      FROM vecs GROUP BY series, day)""", "vecs"), dates="day")
def q_stream_pool_accounting(spark, sf_dir):
    """Rows read, pooled, late and still open per day, after the rows of the first
    months came again behind the watermark."""
    src, schema, out, ckpt = _run_pool(spark, sf_dir)
    (spark.read.schema(schema).parquet(src).where(F.col("day") < F.lit(REPLAY_BEFORE).cast("date"))
     .write.mode("append").parquet(src))
    streams.stream_daily_pool(spark, src, schema, out, ckpt).awaitTermination()
    return streams.pool_accounting(spark.read.schema(schema).parquet(src), streams.read_batches(spark, out))


@register("stream_score")
def q_stream_score(spark, sf_dir):
    """Each closed day scored by the direction forest."""
    from driftpool.plans.q_models import forest_model

    model, _ = forest_model(spark, sf_dir)
    src, schema = _vec_stream(spark, sf_dir)
    base = shared_path(spark, "stream-score")
    out, ckpt = os.path.join(base, "out"), os.path.join(base, "ckpt")
    streams.stream_score(spark, src, schema, model, out, ckpt).awaitTermination()
    return streams.read_batches(spark, out)
