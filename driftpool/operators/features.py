"""Bar time-series features (W01-W13). One window spec per series ordered by
day; Catalyst evaluates same-spec windows in one Window operator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from driftpool.functions.nullsafe import join_groups


def bar_window(series: str = "series", order: str = "day"):
    return Window.partitionBy(series).orderBy(order)


def next_day_change(bars: DataFrame, keep_last: bool = True) -> DataFrame:
    """Next bar's change_pct as ``next_change``; last row NULL (or dropped)."""
    out = bars.withColumn("next_change", F.lead("change_pct", 1).over(bar_window()))
    return out if keep_last else out.where(F.col("next_change").isNotNull())


def direction_label(df: DataFrame, drop_unknown: bool = False) -> DataFrame:
    """1 if next_change > 0 else 0. NULL next_change -> 0, or the row is
    dropped with ``drop_unknown``."""
    if drop_unknown:
        df = df.where(F.col("next_change").isNotNull())
    return df.withColumn("label", F.coalesce((F.col("next_change") > 0).cast("int"), F.lit(0)))


def ternary_label(df: DataFrame, low: float = -1.5, high: float = 1.5) -> DataFrame:
    """0 if next_change < low, 2 if > high, else 1 (NULL -> 1); strict."""
    nc = F.col("next_change")
    return df.withColumn("target", F.when(nc < low, 0).when(nc > high, 2).otherwise(1))


def _full(x: Column, frame, n: int) -> Column:
    """Value only when the frame holds n non-NULL inputs (pandas rolling)."""
    return F.when(F.count(x).over(frame) == n, F.lit(True))


def rolling_mean(x: Column, n: int, series: str = "series", order: str = "day") -> Column:
    frame = bar_window(series, order).rowsBetween(-(n - 1), 0)
    return F.when(_full(x, frame, n), F.avg(x).over(frame))


def price_ma_ratio(price: str = "price", n: int = 20) -> Column:
    """Price / n-bar mean (full frame); zero mean -> NULL."""
    ma = rolling_mean(F.col(price), n)
    return F.try_divide(F.col(price), F.when(ma != 0, ma))


def volatility_3day(change: str = "change_pct", n: int = 3) -> Column:
    """Sample std of |change| over n bars (full frame), clipped [0, 100],
    NULL -> 0."""
    from driftpool.functions.clean import clip, finite_or_zero

    x = F.abs(F.col(change))
    frame = bar_window().rowsBetween(-(n - 1), 0)
    sd = F.when(_full(x, frame, n), F.stddev_samp(x).over(frame))
    return finite_or_zero(clip(sd, 0.0, 100.0))


def rsi(price: str = "price", n: int = 14) -> Column:
    """Simple-mean RSI. gain/loss means over n deltas (full frame);
    loss 0 and gain > 0 -> 100; both 0 -> NULL."""
    delta = F.col(price) - F.lag(price).over(bar_window())
    return _rsi_from_delta(delta, n)


def _rsi_from_delta(delta: Column, n: int) -> Column:
    # greatest/least skip NULLs, so keep the NULL delta NULL explicitly
    gain = F.when(delta.isNotNull(), F.greatest(delta, F.lit(0.0)))
    loss = F.when(delta.isNotNull(), -F.least(delta, F.lit(0.0)))
    g, lo = rolling_mean(gain, n), rolling_mean(loss, n)
    return (F.when((lo == 0) & (g > 0), F.lit(100.0))
            .when(lo != 0, 100.0 - 100.0 / (1.0 + g / lo)))


def true_range(high="high", low="low", price="price", prev_close: bool = False) -> Column:
    """max(H - L, |H - P|, |L - P|) with the same bar's price (or the previous
    close with ``prev_close``)."""
    p = F.lag(price).over(bar_window()) if prev_close else F.col(price)
    return F.greatest(F.col(high) - F.col(low), F.abs(F.col(high) - p), F.abs(F.col(low) - p))


def atr(n: int = 14, prev_close: bool = False) -> Column:
    """Mean true range over n bars (full frame)."""
    return rolling_mean(true_range(prev_close=prev_close), n)


def pct_change(x: str, k: int = 1) -> Column:
    """x / lag(x, k) - 1 with IEEE division: a zero base gives +-Inf (NaN for
    0/0), as pandas does; NULL where there is no base."""
    base = F.lag(x, k).over(bar_window())
    cur = F.col(x)
    ieee = (F.when(cur > 0, F.lit(float("inf"))).when(cur < 0, F.lit(float("-inf")))
            .otherwise(F.lit(float("nan"))))
    return F.when(base == 0, ieee).otherwise(F.try_divide(cur, base) - 1)


def volume_change(vol: str = "vol") -> Column:
    """Volume pct change (k = 1); Inf / NaN / NULL -> 0."""
    from driftpool.functions.clean import finite_or_zero

    return finite_or_zero(pct_change(vol, 1))


def momentum(price: str = "price", k: int = 5) -> Column:
    """Price pct change over k bars, clipped [-5, 5] (Inf clips to the
    bound), NaN / NULL -> 0."""
    from driftpool.functions.clean import finite_or_zero

    x = pct_change(price, k)
    clipped = F.when(F.isnan(x), x).otherwise(F.least(F.greatest(x, F.lit(-5.0)), F.lit(5.0)))
    return finite_or_zero(F.when(x.isNotNull(), clipped))


FEATURES = ["price_range", "day_of_week", "month", "volatility_3day", "volume_change",
            "momentum_5", "price_ma_ratio", "rsi_14", "atr_14"]


def bar_feature_table(bars: DataFrame) -> DataFrame:
    """The nine model features and the ternary target; rows with a NULL
    indicator (or price input) are removed. All windows share one spec
    (partition by series, order by day)."""
    from driftpool.functions.clean import day_of_week, price_range

    b = next_day_change(bars)
    out = b.select(
        "series", "day", "price", "open", "high", "low", "vol", "change_pct", "next_change",
        price_range("high", "low", "price").alias("price_range"),
        day_of_week("day").alias("day_of_week"),
        F.month("day").alias("month"),
        volatility_3day().alias("volatility_3day"),
        volume_change().alias("volume_change"),
        momentum().alias("momentum_5"),
        price_ma_ratio().alias("price_ma_ratio"),
        rsi().alias("rsi_14"),
        atr().alias("atr_14"))
    out = ternary_label(out)
    return out.na.drop(subset=["price", "open", "high", "low", "vol", "change_pct",
                               "price_ma_ratio", "rsi_14", "atr_14"])


SEQ_FEATURES = ["price", "open", "high", "low", "vol", "change_pct"]


def lookback_sequences(bars: DataFrame, lookback: int = 30, features=tuple(SEQ_FEATURES),
                       target: str = "price", vecs: DataFrame | None = None,
                       news_policy: str = "none") -> DataFrame:
    """For bar i >= L: the features of bars i-L .. i-1 in order (current
    bar excluded) and target = ``target`` of bar i.

    news_policy: 'none' (all windows), 'same_day_or_zero' (J04),
    'prev_bar_or_zero' (J05), 'same_day_mean_required' (J06 - windows are cut
    over the full bar list first, then bars without news drop out; column
    ``n_items`` counts their news).
    """
    w = bar_window()
    frame = w.rowsBetween(-lookback, -1)
    seq = F.collect_list(F.struct(*[F.col(c).alias(c) for c in features])).over(frame)
    cut = (bars.withColumn("seq", seq)
           .withColumn("_rn", F.row_number().over(w))
           .where(F.col("_rn") > lookback)
           .select("series", "day", "seq", F.col(target).alias("target")))
    if news_policy == "none" or vecs is None:
        return cut
    from driftpool.operators import joins

    if news_policy == "same_day_mean_required":
        return joins.news_same_day_mean_required(cut, vecs)
    if news_policy == "same_day_or_zero":
        return joins.news_same_day_or_zero(cut, vecs)
    if news_policy == "prev_bar_or_zero":
        # the previous bar is one of all bars, not of the windows cut from them
        prev = bars.withColumn("_prev", F.lag("day").over(bar_window())).select("series", "day", "_prev")
        return joins.news_on_day_or_zero(join_groups(cut, prev, ["series", "day"]), vecs, "_prev").drop("_prev")
    raise ValueError(news_policy)


def _stats(df: DataFrame, cols, group, train_col):
    src = df.where(F.col(train_col)) if train_col else df
    return src.groupBy(*group).agg(*[a for c in cols for a in (
        F.min(c).alias(f"_min_{c}"), F.max(c).alias(f"_max_{c}"))])


def minmax_scale(df: DataFrame, cols, group=("series",), train_col: str | None = None,
                 keep_stats: bool = False) -> DataFrame:
    """(x - min) / (max - min) per column and group, fit on all rows (or
    on rows where ``train_col`` is true); a constant column maps to 0. The stats
    are one row per group, joined back."""
    st = _stats(df, cols, group, train_col)
    out = join_groups(df, st, list(group), "left")
    for c in cols:
        rng = F.col(f"_max_{c}") - F.col(f"_min_{c}")
        out = out.withColumn(c, F.when(rng == 0, F.lit(0.0)).otherwise(
            (F.col(c) - F.col(f"_min_{c}")) / rng))
    if not keep_stats:
        out = out.drop(*[f"_{s}_{c}" for c in cols for s in ("min", "max")])
    return out


def minmax_inverse(df: DataFrame, cols) -> DataFrame:
    """Scaled -> original: s * (max - min) + min, using the stats columns
    kept by ``minmax_scale(keep_stats=True)``."""
    out = df
    for c in cols:
        out = out.withColumn(c, F.col(c) * (F.col(f"_max_{c}") - F.col(f"_min_{c}"))
                             + F.col(f"_min_{c}"))
    return out


def standard_scale(df: DataFrame, cols, group=("series",), train_col: str | None = None) -> DataFrame:
    """(x - mean) / population std per column, fit on ``train_col`` rows;
    a constant column maps to 0."""
    src = df.where(F.col(train_col)) if train_col else df
    st = src.groupBy(*group).agg(*[a for c in cols for a in (
        F.avg(c).alias(f"_mu_{c}"), F.stddev_pop(c).alias(f"_sd_{c}"))])
    out = join_groups(df, st, list(group), "left")
    for c in cols:
        sd = F.col(f"_sd_{c}")
        out = out.withColumn(c, F.when(sd == 0, F.lit(0.0)).otherwise(
            (F.col(c) - F.col(f"_mu_{c}")) / sd))
    return out.drop(*[f"_{s}_{c}" for c in cols for s in ("mu", "sd")])
