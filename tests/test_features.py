
import datetime as dt

import pytest
from pyspark.sql import functions as F

from driftpool.operators import features as W
from driftpool.operators import joins

D0 = dt.date(2024, 1, 1)


def bars_of(spark, prices, series="s", changes=None, vols=None):
    rows = []
    for i, p in enumerate(prices):
        ch = None if changes is None else changes[i]
        v = 1.0 if vols is None else vols[i]
        rows.append((series, D0 + dt.timedelta(days=i), p, p, p, p, p, v, ch))
    return spark.createDataFrame(rows, "series string, day date, open double, high double, low double, "
                                       "price double, close double, vol double, change_pct double")


def test_labels_on_last_row_and_bounds(spark):
    b = bars_of(spark, [1.0] * 5, changes=[None, 0.0, -1.5, 1.5, 2.0])
    t = W.ternary_label(W.next_day_change(b)).orderBy("day").collect()
    assert [r.target for r in t] == [1, 1, 1, 2, 1]  # strict bounds; last row (NULL) -> 1
    d = W.direction_label(W.next_day_change(b)).orderBy("day").collect()
    assert [r.label for r in d] == [0, 0, 1, 1, 0]
    assert W.direction_label(W.next_day_change(b), drop_unknown=True).count() == 4


def rsi_of(spark, prices):
    b = bars_of(spark, prices)
    return [r.r for r in b.select("day", W.rsi().alias("r")).orderBy("day").collect()]


def test_rsi_cases(spark):
    const = rsi_of(spark, [5.0] * 16)
    assert const[14] is None and const[15] is None  # both means 0 -> NULL
    rising = rsi_of(spark, [float(i) for i in range(16)])
    assert rising[13] is None and rising[14] == 100.0  # first valid at bar n + 1
    mixed = [1, 2, 1, 2, 1, 2, 1, 2, 1, 2, 1, 2, 1, 2, 1]
    r = rsi_of(spark, [float(x) for x in mixed])
    # deltas +1 x7, -1 x7: means equal -> RSI 50
    assert r[14] == pytest.approx(50.0)


def test_short_series_gives_nulls(spark):
    b = bars_of(spark, [1.0, 2.0, 3.0])
    row = b.select(W.price_ma_ratio().alias("m"), W.atr().alias("a")).collect()
    assert all(r.m is None and r.a is None for r in row)


def test_volume_change_zero_volume(spark):
    b = bars_of(spark, [1.0, 1.0, 1.0], vols=[0.0, 5.0, 0.0])
    got = [r.v for r in b.select("day", W.volume_change().alias("v")).orderBy("day").collect()]
    assert got == [0.0, 0.0, -1.0]  # first: no base; 5/0: Inf -> 0


def test_lookback_window_edges(spark):
    L = 3
    b = bars_of(spark, [1.0, 2.0, 3.0]).unionByName(bars_of(spark, [1.0, 2.0, 3.0, 4.0], series="t"))
    seqs = W.lookback_sequences(b, L).collect()
    assert len(seqs) == 1  # exactly L bars -> no row; L + 1 bars -> one row
    r = seqs[0]
    assert r.series == "t" and r.target == 4.0 and [x.price for x in r.seq] == [1.0, 2.0, 3.0]


def test_prev_bar_news_over_weekend(spark):
    # bars Fri 2024-01-05 and Mon 2024-01-08; news on Friday only
    fri, mon = dt.date(2024, 1, 5), dt.date(2024, 1, 8)
    bars = spark.createDataFrame([("s", fri, 1.0), ("s", mon, 2.0)], "series string, day date, price double")
    vecs = spark.createDataFrame([("s", 1, dt.datetime(2024, 1, 5, 9), fri, [1.0, 2.0])],
                                 "series string, vec_id long, ts timestamp_ntz, day date, v array<float>")
    out = {r.day: r for r in joins.news_prev_bar_or_zero(bars, vecs).collect()}
    assert out[mon].has_news and list(out[mon].v) == [1.0, 2.0]
    assert not out[fri].has_news and list(out[fri].v) == [0.0, 0.0]  # first bar of the series
    same = {r.day: r for r in joins.news_same_day_or_zero(bars, vecs).collect()}
    assert same[fri].has_news and not same[mon].has_news


def test_minmax_round_trip_and_constant(spark):
    b = bars_of(spark, [3.0, 5.0, 9.0]).withColumn("const", F.lit(7.0))
    s = W.minmax_scale(b, ["price", "const"], keep_stats=True)
    rows = s.orderBy("day").collect()
    assert [r.price for r in rows] == [0.0, pytest.approx(1 / 3), 1.0]
    assert all(r.const == 0.0 for r in rows)
    back = W.minmax_inverse(s, ["price"]).orderBy("day").collect()
    assert [r.price for r in back] == pytest.approx([3.0, 5.0, 9.0])
