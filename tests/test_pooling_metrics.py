"""Pooling and metric edge cases (FIXTURES.md §3)."""

import datetime as dt

import numpy as np
import pytest

from driftpool.operators import joins, metrics, pooling

D = dt.date(2024, 1, 1)
VSCHEMA = "series string, vec_id long, ts timestamp_ntz, day date, v array<float>"


def vecs(spark, rows):
    return spark.createDataFrame(rows, VSCHEMA)


def test_attention_single_equal_and_overflow(spark):
    t = dt.datetime(2024, 1, 1, 9)
    rows = [("s", 1, t, D, [1.0, 2.0]),                                # single item day
            ("s", 2, t, D + dt.timedelta(1), [1.0, 0.0]),              # equal scores
            ("s", 3, t, D + dt.timedelta(1), [3.0, 0.0]),
            ("s", 4, t, D + dt.timedelta(2), [1000.0, 0.0]),           # score 1000
            ("s", 5, t, D + dt.timedelta(2), [0.0, 1.0])]
    w = spark.createDataFrame([([0.0, 0.0],)], "w array<double>")
    got = {r.day: list(r.v) for r in pooling.attention_pool(vecs(spark, rows), w).collect()}
    assert got[D] == pytest.approx([1.0, 2.0])
    assert got[D + dt.timedelta(1)] == pytest.approx([2.0, 0.0])       # equal weights = mean
    w2 = spark.createDataFrame([([1.0, 0.0],)], "w array<double>")
    got2 = {r.day: list(r.v) for r in pooling.attention_pool(vecs(spark, rows), w2).collect()}
    assert got2[D + dt.timedelta(2)] == pytest.approx([1000.0, 0.0])   # no overflow


def test_window_mean_empty_is_zero(spark):
    empty = vecs(spark, []).where("false")
    r = pooling.window_mean_or_zero(empty, dim=3).first()
    assert r.n_items == 0 and list(r.v) == [0.0, 0.0, 0.0]


def test_padded_sequences_mask(spark):
    t = dt.datetime(2024, 1, 1, 9)
    rows = [("s", 1, t, D, [1.0]), ("s", 2, t + dt.timedelta(hours=1), D, [2.0]),
            ("s", 3, t, D + dt.timedelta(1), [5.0]), ("s", 4, t, D + dt.timedelta(1), [6.0]),
            ("s", 5, t, D + dt.timedelta(1), [7.0]), ("s", 6, t, D + dt.timedelta(2), [9.0])]
    out = {r.day: r for r in pooling.padded_daily_sequences(vecs(spark, rows)).collect()}
    assert set(out) == {D, D + dt.timedelta(1)}  # single-item day excluded
    assert [list(x) for x in out[D].seq] == [[1.0], [2.0], [0.0]] and list(out[D].mask) == [1, 1, 0]


def test_report_with_absent_classes(spark):
    df = spark.createDataFrame([(0, 0), (0, 0), (1, 0), (2, 0)], "y_true int, y_pred int")
    rep = {r.label: r for r in metrics.classification_report(df, [0, 1, 2]).collect()}
    assert rep["1"].precision == 0.0 and rep["1"].recall == 0.0 and rep["1"].f1 == 0.0
    assert rep["0"].precision == pytest.approx(0.5) and rep["0"].recall == 1.0
    assert rep["accuracy"].f1 == pytest.approx(0.5) and rep["accuracy"].support == 4
    cm = metrics.confusion_matrix(df, [0, 1, 2]).collect()
    assert len(cm) == 9 and sum(r.n for r in cm) == 4
    dist = {r.label: r.n for r in metrics.class_distribution(df.withColumnRenamed("y_true", "label"),
                                                             [0, 1, 2, 3]).collect()}
    assert dist == {0: 2, 1: 1, 2: 1, 3: 0}


def test_regression_batches(spark):
    rows = [(i, float(i), float(i) + (1.0 if i < 64 else 3.0)) for i in range(100)]
    df = spark.createDataFrame(rows, "k long, y_true double, y_pred double")
    m = metrics.regression_metrics(df, ["k"], batch_size=64).first()
    assert m.mae == pytest.approx((64 * 1 + 36 * 3) / 100)
    assert m.loss == pytest.approx((1.0 + 9.0) / 2)  # mean of the two batch MSEs
    assert m.huber == pytest.approx((64 * 0.5 + 36 * 2.5) / 100)


def softmax_pool(items, w):
    """numpy: softmax-weighted mean of each day's vectors"""
    out = {}
    for day in {d for d, _ in items}:
        v = np.array([x for d, x in items if d == day], float)
        s = v @ w
        e = np.exp(s - s.max())
        out[day] = (len(v), (e[:, None] * v).sum(0) / e.sum())
    return out


@pytest.mark.parametrize("spread", [1.0, 60.0, 2000.0, 1e6])
def test_attention_over_any_range_of_scores(spark, spread):
    """Scores far below the day's largest, negative ones, and steps that one day spans."""
    r = np.random.default_rng(int(spread))
    items = [(D + dt.timedelta(int(i % 3)), [float(x) for x in (r.uniform(-spread, spread), r.normal())])
             for i in range(120)]
    items += [(D + dt.timedelta(4), [10.0 * i, 1.0]) for i in range(200)]
    df = vecs(spark, [("s", i, dt.datetime(2024, 1, 1), d, v) for i, (d, v) in enumerate(items)])
    w = spark.createDataFrame([([1.0, 0.5],)], "w array<double>")
    items = [(d, np.float32(v).astype(float)) for d, v in items]
    want = softmax_pool(items, np.array([1.0, 0.5]))
    got = {x.day: x for x in pooling.attention_pool(df.repartition(7), w).collect()}
    assert got.keys() == want.keys()
    for day, (n, v) in want.items():
        assert got[day].n_items == n and list(got[day].v) == pytest.approx(v, rel=1e-9, abs=1e-9)


def test_attention_scores_once_in_one_scan(spark, tmp_path):
    df = vecs(spark, [("s", i, dt.datetime(2024, 1, 1), D, [float(i), 1.0]) for i in range(50)])
    df.write.parquet(str(tmp_path / "v"))
    w = spark.createDataFrame([([1.0, 0.5],)], "w array<double>")
    out = pooling.attention_pool(spark.read.parquet(str(tmp_path / "v")), w)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1
    optimized = out._jdf.queryExecution().optimizedPlan().toString()
    assert optimized.count("zip_with(") == 1


def test_padded_batches_equal_brute_force(spark):
    r = np.random.default_rng(3)
    rows, sizes = [], [1, 2, 9, 3, 1, 4, 17, 2, 2, 8, 5]
    for k, n in enumerate(sizes):
        for i in range(n):
            rows.append((None if k == 3 else "s", len(rows), dt.datetime(2024, 1, 1) + dt.timedelta(hours=int(r.integers(5))),
                         D + dt.timedelta(k), [float(len(rows)), 1.0]))
    got = pooling.padded_sequence_batches(vecs(spark, rows), chunk=4, batch_days=3).collect()
    days = {}
    for s, i, ts, day, v in rows:
        days.setdefault((s is not None, s, day), []).append((ts, i, v))
    several = [k for k in sorted(days, key=lambda k: (k[0], k[1] or "", k[2])) if len(days[k]) >= 2]
    want = []
    for at in range(0, len(several), 3):
        batch = several[at:at + 3]
        chunks = -(-max(len(days[k]) for k in batch) // 4)
        for k in batch:
            seq = [v for _, _, v in sorted(days[k])]
            for c in range(chunks):
                own = seq[c * 4:c * 4 + 4]
                want.append((str(k[1]), k[2], at // 3, c, len(seq), chunks * 4,
                             own + [[0.0, 0.0]] * (4 - len(own)), [1] * len(own) + [0] * (4 - len(own))))
    assert sorted((str(x.series), x.day, x.batch, x.chunk, x.length, x.padded_len,
                   [list(v) for v in x.seq], list(x.mask)) for x in got) == sorted(want)
    assert pooling.padded_sequence_batches(vecs(spark, []), dim=2).count() == 0


def test_news_meets_bars_either_way(spark):
    """Bars broadcast or merged, and a calendar beyond the bound: the same rows; while they
    are broadcast no vector is shuffled."""
    rows = [("s", i, dt.datetime(2024, 1, 1) + dt.timedelta(hours=i % 7), D + dt.timedelta(i % 4),
             None if i == 0 else [float(i), 1.0]) for i in range(40)]
    v = vecs(spark, rows)
    bars = spark.createDataFrame([("s", D + dt.timedelta(k), float(k)) for k in range(2, 7)] + [("t", D, 0.0)],
                                 "series string, day date, price double")
    for fn in (joins.news_same_day_or_zero, joins.news_prev_bar_or_zero):
        one, two = (sorted(map(str, fn(bars, v, max_broadcast=n).collect())) for n in (10, 0))
        assert one == two and len(one) == 6
        assert one == sorted(map(str, fn(bars, v, dim=2).collect()))
    same = {x.day: x for x in joins.news_same_day_or_zero(bars.where("series = 's'"), v).collect()}
    first = {}
    for s, i, ts, day, x in sorted(rows, key=lambda x: (x[2], x[1])):
        if x is not None:
            first.setdefault(day, x)
    for day, x in same.items():
        assert x.has_news == (day in first) and list(x.v) == first.get(day, [0.0, 0.0])
    fan = [joins.news_price_fanout_join(v, bars, max_broadcast=n) for n in (10, 0)]
    a, b = (sorted(map(str, f.collect())) for f in fan)
    assert a == b and len(a) == 20
    plans = [f._jdf.queryExecution().executedPlan().toString() for f in fan]
    assert "BroadcastHashJoin" in plans[0] and "hashpartitioning" not in plans[0]
    assert "SortMergeJoin" in plans[1]
