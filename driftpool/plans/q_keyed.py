"""Keyed ingest, backlog, sampling and date-aligned joins (S02, J02-J06, A03,
A04, A11-A13, L01, L02)."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftpool import fixtures as fx
from driftpool.functions.vectors import explode_elements
from driftpool.operators import features, filters, joins, metrics, pooling, splits
from driftpool.plans.oracle import DUP_ORDER, sql
from driftpool.plans.q_clean import PREV_DAY_NOW
from driftpool.plans.registry import register
from driftpool.session import shared_path
from driftpool.sources import keyed

R = 6

_S02 = f"""
SELECT * EXCLUDE (rn_) FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {DUP_ORDER}) AS rn_
  FROM lineitem) f
WHERE (rn_ = 1 OR l_orderkey IS NULL OR l_linenumber IS NULL)
  AND NOT EXISTS (SELECT 1 FROM dup_target t
                  WHERE t.l_orderkey = f.l_orderkey AND t.l_linenumber = f.l_linenumber)"""


def _to_insert(spark, sf_dir):
    return keyed.insert_if_absent(fx.dup_batch(spark, sf_dir), fx.dup_target(spark, sf_dir),
                                  fx.DUP_KEY, fx.DUP_ORDINAL)


@register("insert_if_absent", sql(_S02, "dup_target"), timestamps="l_shipdate")
def q_insert_if_absent(spark, sf_dir):
    return _to_insert(spark, sf_dir)


@register("insert_if_absent_counts", sql(f"""
SELECT (SELECT count(*) FROM lineitem) AS batch_rows, count(*) AS inserted,
       (SELECT count(*) FROM lineitem) - count(*) AS skipped
FROM ({_S02})""", "dup_target"))
def q_insert_if_absent_counts(spark, sf_dir):
    return keyed.insert_counts(fx.dup_batch(spark, sf_dir), _to_insert(spark, sf_dir))


@register("append_bucketed", sql(f"SELECT * FROM dup_target UNION ALL ({_S02})", "dup_target"),
          timestamps="l_shipdate")
def q_append_bucketed(spark, sf_dir):
    """S02 into a table kept bucketed by its key: an earlier load, then the whole batch,
    then the batch once more, of which nothing is new."""
    path = shared_path(spark, "keyed-table")
    batch, key, ordinal = fx.dup_batch(spark, sf_dir), fx.DUP_KEY, fx.DUP_ORDINAL
    keyed.append_bucketed(fx.dup_target(spark, sf_dir), path, key, ordinal, buckets=8)
    keyed.append_bucketed(batch, path, key, ordinal, buckets=8)
    full = batch.where(F.col(key[0]).isNotNull() & F.col(key[1]).isNotNull())
    return keyed.append_bucketed(full, path, key, ordinal, buckets=8)


_BACKLOG = """
SELECT * FROM news n WHERE NOT EXISTS (
  SELECT 1 FROM news_done d WHERE d.channel_id = n.channel_id AND d.message_id = n.message_id)"""


def _backlog(spark, sf_dir):
    return joins.untranslated_backlog(fx.news(spark, sf_dir), fx.news_done(spark, sf_dir))


@register("untranslated_backlog", sql(_BACKLOG, "news_done"), timestamps="date")
def q_untranslated_backlog(spark, sf_dir):
    return _backlog(spark, sf_dir)


@register("backlog_count", sql(f"SELECT count(*) AS n_backlog FROM ({_BACKLOG})", "news_done"))
def q_backlog_count(spark, sf_dir):
    return joins.backlog_count(_backlog(spark, sf_dir))


@register("newest_backlog_batch", sql(f"""
{_BACKLOG}
ORDER BY date DESC NULLS FIRST, channel_id DESC, message_id DESC LIMIT 256""", "news_done"),
          timestamps="date")
def q_newest_backlog_batch(spark, sf_dir):
    return joins.newest_backlog_batch(_backlog(spark, sf_dir), k=256)


SAMPLE_SEED = 42


@register("seeded_sample", sql(f"""
SELECT message_id, channel_id FROM news
ORDER BY md5('{SAMPLE_SEED}:' || CAST(message_id AS VARCHAR)), message_id LIMIT 100""", "news"))
def q_seeded_sample(spark, sf_dir):
    s = splits.seeded_sample(fx.news(spark, sf_dir), 100, SAMPLE_SEED, "message_id")
    return s.select("message_id", "channel_id")


# ---- joins ----------------------------------------------------------------

_LBARS = """
SELECT series, day, price, change_pct, nc AS next_change,
       CAST(coalesce(nc > 0, false) AS INTEGER) AS label
FROM (SELECT *, lead(change_pct) OVER (PARTITION BY series ORDER BY day) AS nc FROM bars)"""


def _labelled_bars(spark, sf_dir):
    b = features.direction_label(features.next_day_change(fx.bars(spark, sf_dir)))
    return b.select("series", "day", "price", "change_pct", "next_change", "label")


def _fanout(spark, sf_dir):
    return joins.news_price_fanout_join(fx.vecs(spark, sf_dir), _labelled_bars(spark, sf_dir))


@register("news_price_fanout_join", sql(f"""
SELECT v.vec_id, v.day, b.price, round(b.change_pct, {R}) AS change_pct,
       round(b.next_change, {R}) AS next_change, b.label
FROM vecs v JOIN lbars b ON v.series = b.series AND v.day = b.day""", "vecs", "bars",
                                        extra=[("lbars", _LBARS)]), dates="day")
def q_news_price_fanout_join(spark, sf_dir):
    j = _fanout(spark, sf_dir)
    return j.select("vec_id", "day", "price", F.round("change_pct", R).alias("change_pct"),
                    F.round("next_change", R).alias("next_change"), "label")


def _vec_digest(v="v"):
    return [F.size(v).alias("dim"),
            F.size(F.filter(v, lambda x: x != 0)).alias("n_nonzero"),
            F.round(F.col(v)[0].cast("double"), R).alias("v_first"),
            F.round(F.element_at(v, -1).cast("double"), R).alias("v_last")]


def _duck_digest(v="v"):
    return (f"CAST(len({v}) AS INTEGER) AS dim, CAST(len(list_filter({v}, lambda x: x <> 0)) AS INTEGER) "
            f"AS n_nonzero, round(CAST({v}[1] AS DOUBLE), {R}) AS v_first, "
            f"round(CAST({v}[len({v})] AS DOUBLE), {R}) AS v_last")


_FIRST = """
SELECT series, day, v FROM (
  SELECT series, day, v, row_number() OVER (PARTITION BY series, day ORDER BY ts, vec_id) AS rn
  FROM vecs) WHERE rn = 1"""
_ZERO = "list_transform(range((SELECT max(len(v)) FROM vecs)), lambda x: CAST(0 AS DOUBLE))"


@register("first_vector_of_day", sql(f"SELECT series, day, {_duck_digest()} FROM first_v",
                                     "vecs", extra=[("first_v", _FIRST)]), dates="day")
def q_first_vector_of_day(spark, sf_dir):
    f = pooling.first_vector_of_day(fx.vecs(spark, sf_dir))
    return f.select("series", "day", *_vec_digest())


@register("news_same_day_or_zero", sql(f"""
SELECT series, day, has_news, {_duck_digest()} FROM (
  SELECT b.series, b.day, f.v IS NOT NULL AS has_news,
         coalesce(CAST(f.v AS DOUBLE[]), {_ZERO}) AS v
  FROM bars b LEFT JOIN first_v f ON b.series = f.series AND b.day = f.day)""",
                                       "vecs", "bars", extra=[("first_v", _FIRST)]), dates="day")
def q_news_same_day_or_zero(spark, sf_dir):
    j = joins.news_same_day_or_zero(fx.bars(spark, sf_dir), fx.vecs(spark, sf_dir))
    return j.select("series", "day", "has_news", *_vec_digest())


@register("news_prev_bar_or_zero", sql(f"""
SELECT series, day, has_news, {_duck_digest()} FROM (
  SELECT b.series, b.day, f.v IS NOT NULL AS has_news,
         coalesce(CAST(f.v AS DOUBLE[]), {_ZERO}) AS v
  FROM (SELECT *, lag(day) OVER (PARTITION BY series ORDER BY day) AS prev_day FROM bars) b
  LEFT JOIN first_v f ON b.series = f.series AND b.prev_day = f.day)""",
                                       "vecs", "bars", extra=[("first_v", _FIRST)]), dates="day")
def q_news_prev_bar_or_zero(spark, sf_dir):
    j = joins.news_prev_bar_or_zero(fx.bars(spark, sf_dir), fx.vecs(spark, sf_dir))
    return j.select("series", "day", "has_news", *_vec_digest())


_MEAN_I = """
SELECT series, day, CAST(i AS INTEGER) AS i, avg(x) AS x, count(*) AS n_items
FROM (SELECT series, day, unnest(range(len(v))) AS i, unnest(v) AS x FROM vecs)
GROUP BY series, day, i"""


@register("news_same_day_mean_required", sql(f"""
SELECT b.series, b.day, b.price, m.n_items, m.i, round(m.x, {R}) AS x
FROM bars b JOIN mean_i m ON b.series = m.series AND b.day = m.day""",
                                             "vecs", "bars", extra=[("mean_i", _MEAN_I)]),
          dates="day")
def q_news_same_day_mean_required(spark, sf_dir):
    j = joins.news_same_day_mean_required(fx.bars(spark, sf_dir), fx.vecs(spark, sf_dir))
    return explode_elements(j, ["series", "day", "price", "n_items"])


# ---- A04, A11, A12 ----------------------------------------------------------

@register("window_mean_or_zero", sql(f"""
SELECT (SELECT count(*) FROM vecs WHERE ts >= TIMESTAMP '1995-01-01' AND ts < TIMESTAMP '1995-01-02')
       AS n_items, CAST(i AS INTEGER) AS i, round(avg(x), {R}) AS x
FROM (SELECT unnest(range(len(v))) AS i, unnest(v) AS x FROM vecs
      WHERE ts >= TIMESTAMP '1995-01-01' AND ts < TIMESTAMP '1995-01-02')
GROUP BY i""", "vecs"))
def q_window_mean_or_zero(spark, sf_dir):
    """Mean vector of the vectors stamped on the previous day of PREV_DAY_NOW."""
    v = fx.vecs(spark, sf_dir).withColumnRenamed("vec_id", "message_id")
    sel = filters.previous_day_news(v, PREV_DAY_NOW, date="ts", ordered=False)
    m = pooling.window_mean_or_zero(sel, dim=64)
    return explode_elements(m, ["n_items"])


_PROFILE_COLS = ["vec_id", "day", "price", "change_pct", "next_change", "label"]


def _duck_profile():
    parts = [f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL) AS n_nulls FROM fan"
             for c in _PROFILE_COLS]
    return f"""
SELECT s.n_rows, s.min_date, s.max_date, p.column_name, p.n_nulls
FROM (SELECT count(*) AS n_rows, min(day) AS min_date, max(day) AS max_date FROM fan) s,
     ({' UNION ALL '.join(parts)}) p"""


@register("data_profile", sql(_duck_profile(), "vecs", "bars", extra=[
    ("lbars", _LBARS),
    ("fan", "SELECT v.vec_id, v.day, b.price, b.change_pct, b.next_change, b.label FROM vecs v "
            "JOIN lbars b ON v.series = b.series AND v.day = b.day")]),
          dates=("min_date", "max_date"))
def q_data_profile(spark, sf_dir):
    return metrics.data_profile(_fanout(spark, sf_dir).select(*_PROFILE_COLS), "day")


@register("daily_digest", sql("""
SELECT day, n_news, rank, message_id FROM (
  SELECT CAST(date AS DATE) AS day, message_id,
         count(*) OVER (PARTITION BY CAST(date AS DATE)) AS n_news,
         row_number() OVER (PARTITION BY CAST(date AS DATE)
                            ORDER BY date DESC NULLS FIRST, message_id DESC) AS rank
  FROM news) WHERE rank <= 10""", "news"), dates="day")
def q_daily_digest(spark, sf_dir):
    d = metrics.daily_digest(fx.news(spark, sf_dir), k=10)
    e = d.select("day", "n_news", F.explode("top").alias("t"))
    return e.select("day", "n_news", F.col("t.rank").cast("long").alias("rank"),
                    F.col("t.message_id").alias("message_id"))
