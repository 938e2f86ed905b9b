"""Date-aligned joins of news/vectors with bars (J01-J06) and key anti-joins.

Bars are one row per (series, day): their size is bounded by the calendar, not
by the data. Where vectors meet them, the calendar side is written and counted
first (``measured``) and broadcast up to ``MAX_BROADCAST_DAYS`` rows, so that vectors
keep their scan partitions; beyond that both sides are shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftpool.session import write_shared

#: rows of a calendar side that are broadcast at most (some 100 bytes each)
MAX_BROADCAST_DAYS = 200_000


def measured(calendar: DataFrame, max_rows: int = MAX_BROADCAST_DAYS) -> DataFrame:
    """``calendar``, written and counted (jobs): with a broadcast hint if it has at
    most ``max_rows`` rows, else to be merged. Results are the same either way."""
    rows = write_shared(calendar, "calendar")
    return F.broadcast(rows) if rows.count() <= max_rows else rows.hint("merge")


def daily_vector_price_join(pooled: DataFrame, labelled_bars: DataFrame,
                            keys=("series", "day")) -> DataFrame:
    """Pooled day vectors joined to bars (inner) with the direction label."""
    return pooled.join(labelled_bars, list(keys), "inner")


def news_price_fanout_join(items: DataFrame, bars: DataFrame, keys=("series", "day"),
                           check_overlap: bool = False,
                           max_broadcast: int = MAX_BROADCAST_DAYS) -> DataFrame:
    """Every news row carries its day's bar, features and label (inner,
    many-to-one). The bars are measured first: items are not shuffled while the bars
    can be broadcast. ``check_overlap`` fails loudly when no day matches (one cheap
    ``isEmpty`` probe)."""
    out = items.join(measured(bars, max_broadcast), list(keys), "inner")
    if check_overlap and out.isEmpty():
        raise ValueError("no item falls on a day of the bars")
    return out


def _attach_or_zero(bars: DataFrame, vecs: DataFrame, on_day: str, keys, v: str, dim: int | None,
                    max_broadcast: int) -> DataFrame:
    """``bars`` with the first vector of the day in ``on_day``, or a zero vector.

    Each day's first item is found by its time and id alone and measured; while these
    can be broadcast, the vectors meet them in their scan partitions, and one vector
    a day goes on. The width is ``dim``, or read off those."""
    series, order = keys[0], ["ts", "vec_id"]
    first = (vecs.where(F.col(v).isNotNull()).groupBy(*keys)
             .agg(F.min(F.struct(*order)).alias("_first"))
             .select(*[F.col(k).alias(f"_{k}") for k in keys], "_first"))
    first = measured(first, max_broadcast)
    same = ((F.col(series) == F.col(f"_{series}")) & (F.col(keys[1]) == F.col(f"_{keys[1]}"))
            & F.struct(*order).eqNullSafe(F.col("_first")))
    # rows repeated with time and id: one of them
    day_vecs = write_shared(vecs.join(first, same).groupBy(F.col(series), F.col(keys[1]).alias(on_day))
                            .agg(F.min(v).alias(v)), "day-vectors")
    width = day_vecs.select(F.max(F.size(v))).scalar() if dim is None else F.lit(dim)
    joined = bars.join(day_vecs, [series, on_day], "left").withColumn("_dim", width)
    return (joined.withColumn("has_news", F.col(v).isNotNull())
            .withColumn(v, F.coalesce(F.col(v).cast("array<double>"),
                                      F.array_repeat(F.lit(0.0), F.col("_dim"))))
            .drop("_dim"))


def news_same_day_or_zero(bars: DataFrame, vecs: DataFrame, keys=("series", "day"), v: str = "v",
                          dim: int | None = None, max_broadcast: int = MAX_BROADCAST_DAYS) -> DataFrame:
    """Each bar gets the first vector of its own day, else a zero vector."""
    return _attach_or_zero(bars, vecs, keys[1], list(keys), v, dim, max_broadcast)


def news_prev_bar_or_zero(bars: DataFrame, vecs: DataFrame, keys=("series", "day"), v: str = "v",
                          dim: int | None = None, max_broadcast: int = MAX_BROADCAST_DAYS) -> DataFrame:
    """As J04 with the day of the *previous bar* (previous trading day);
    the first bar of a series gets the zero vector."""
    from driftpool.operators.features import bar_window

    b = bars.withColumn("prev_day", F.lag("day").over(bar_window(keys[0], keys[1])))
    return _attach_or_zero(b, vecs, "prev_day", list(keys), v, dim, max_broadcast)


def news_on_day_or_zero(rows: DataFrame, vecs: DataFrame, on_day: str, keys=("series", "day"),
                        v: str = "v", dim: int | None = None,
                        max_broadcast: int = MAX_BROADCAST_DAYS) -> DataFrame:
    """J04/J05 for rows that name the day whose first vector they get."""
    return _attach_or_zero(rows, vecs, on_day, list(keys), v, dim, max_broadcast)


def news_same_day_mean_required(bars: DataFrame, vecs: DataFrame, keys=("series", "day"),
                                v: str = "v") -> DataFrame:
    """Each bar gets its day's mean vector; bars without news drop out."""
    from driftpool.operators.pooling import daily_mean_vector

    return bars.join(daily_mean_vector(vecs, keys, v), list(keys), "inner")


def untranslated_backlog(source: DataFrame, target: DataFrame,
                         key=("channel_id", "message_id")) -> DataFrame:
    """Source rows with no target row for the same key (NOT EXISTS)."""
    return source.join(target.select(*key), list(key), "left_anti")


def backlog_count(backlog: DataFrame) -> DataFrame:
    """Number of backlog rows."""
    return backlog.agg(F.count(F.lit(1)).alias("n_backlog"))


def newest_backlog_batch(backlog: DataFrame, k: int = 256, date: str = "date",
                         key=("channel_id", "message_id")) -> DataFrame:
    """The k newest backlog rows (NULL dates first, as PostgreSQL sorts
    DESC); ties broken by key. Planned as TakeOrderedAndProject: each task
    keeps its own top k, only k rows per task reach the final merge."""
    order = [F.desc_nulls_first(date)] + [F.desc(c) for c in key]
    return backlog.orderBy(*order).limit(k)
