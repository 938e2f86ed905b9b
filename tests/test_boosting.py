"""Boosting side by side: against plain boosting in numpy, and what the callers rely on."""

import pickle

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftpool.operators import boosting as B
from driftpool.operators import models


def data(spark, n=300, classes=2, seed=0):
    r = np.random.default_rng(seed)
    x = r.integers(0, 12, (n, 3)) / 4.0  # few values: every one has its own bin
    signal = x[:, 0] + (x[:, 1] > 1.5) * 2 - x[:, 2] * 0.3
    y = np.digitize(signal, np.quantile(signal, np.arange(1, classes) / classes)).astype(float)
    flip = r.random(n) < 0.1
    y[flip] = r.integers(0, classes, flip.sum())
    role = np.where(r.random(n) < 0.75, B.TRAIN, B.TEST)
    rows = [(i, [float(v) for v in x[i]], float(y[i]), [int(role[i]), int(3 - role[i])]) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, features array<double>, label double, roles array<int>")
    return df, x, y, role


def plain(x, y, train, loss, classes, rounds, rate, depth):
    """One ensemble by recursion over raw values; margins of all rows after each round."""
    k = classes if loss == "softmax" else 1
    if loss == "squared":
        base = [y[train].mean()]
    else:
        share = [np.mean(y[train] == c) for c in range(k)] if loss == "softmax" else [y[train].mean()]
        base = [np.log(s) if loss == "softmax" else np.log(s / (1 - s)) for s in share]
    m = np.tile(np.array(base), (len(y), 1))
    out = [m.copy()]

    def grow(rows, g, h, level, into):
        into[rows] = g[rows & train].sum() / (h[rows & train].sum() + B.RIDGE)
        own = rows & train
        G, H = g[own].sum(), h[own].sum()
        best = (0, None)
        if level < depth:
            for f in range(x.shape[1]):
                for v in np.unique(x[train, f])[:-1]:
                    left = own & (x[:, f] <= v)
                    gl, hl = g[left].sum(), h[left].sum()
                    if hl < B.LEAST or H - hl < B.LEAST:
                        continue
                    gain = round(gl ** 2 / (hl + B.RIDGE) + (G - gl) ** 2 / (H - hl + B.RIDGE)
                                 - G ** 2 / (H + B.RIDGE), 9)
                    if gain > best[0]:
                        best = (gain, (f, v))
        if best[1]:
            f, v = best[1]
            grow(rows & (x[:, f] <= v), g, h, level + 1, into)
            grow(rows & (x[:, f] > v), g, h, level + 1, into)

    for _ in range(rounds):
        g, h = B.gradients(loss, m[:, None, :], y)
        step = np.zeros_like(m)
        for c in range(k):
            into = np.zeros(len(y))
            grow(np.ones(len(y), bool), g[:, 0, c], h[:, 0, c], 0, into)
            step[:, c] = into
        m = m + rate * step
        out.append(m.copy())
    return out


@pytest.mark.parametrize("rows", [100, 1000])
@pytest.mark.parametrize("loss, classes", [("logistic", 2), ("softmax", 3), ("squared", 4)])
def test_equals_plain_boosting(spark, monkeypatch, loss, classes, rows):
    """Two roles and two shapes: side by side in several blocks, over a checkpoint, and
    each in a task of its own."""
    monkeypatch.setattr(B, "ROWS_PER_BLOCK", rows)
    monkeypatch.setattr(B, "CUT_EVERY", 3)
    df, x, y, role = data(spark, classes=classes)
    plans = [B.Plan(7, 0.3, 3, 0), B.Plan(4, 0.5, 2, 1), B.Plan(5, 0.1, 1, 0)]
    k = classes if loss == "softmax" else 1
    got = B.fit_boosters(df, plans, loss, classes=k, key="id")
    for i, p in enumerate(plans):
        train = role == (B.TRAIN if p.role == 0 else B.TEST)
        want = plain(x, y, train, loss, k, p.rounds, p.rate, p.depth)
        for t in (0, 1, p.rounds):
            assert np.allclose(got.margins(x, i, t), want[t], atol=1e-8)
        for t in range(p.rounds + 1):
            each, right = B.losses(loss, want[t][:, None, :], y)
            for j, own in enumerate((train, ~train)):
                assert got.history[t, i, j, 0] == own.sum()
                assert got.history[t, i, j, 1] == pytest.approx(each[own].mean(), abs=1e-8)
                assert got.history[t, i, j, 2] == pytest.approx(right[own].mean())


def test_ternary_probabilities_and_falling_loss(spark):
    df, *_ = data(spark, classes=3)
    df = df.withColumn("is_train", F.col("id") % 5 != 0).withColumnRenamed("label", "target")
    model = models.ternary_boost(df, max_iter=40, step=0.2, max_depth=3, stable_key="id")
    out = model.transform(df.where("not is_train").withColumn("prediction", F.lit("x"))).collect()
    assert out and all(abs(sum(r.probability) - 1) < 1e-9 and len(r.probability) == 3 for r in out)
    assert all(r.prediction == int(np.argmax(r.probability)) for r in out)
    loss = model.history[:, 0, 0, 1]
    assert (np.diff(loss) < 0).all()
    assert np.mean([r.prediction == r.target for r in out]) > 0.6
    again = models.ternary_boost(df.repartition(5), max_iter=40, step=0.2, max_depth=3, stable_key="id")
    assert np.array_equal(again.history, model.history)


def test_staged_trials_score_as_fits_of_their_own(spark):
    df, *_ = data(spark)
    trials = [{"max_depth": 2, "step": 0.3, "max_iter": 2}, {"max_depth": 2, "step": 0.3, "max_iter": 9},
              {"max_depth": 3, "step": 0.1, "max_iter": 5}]
    table = models.param_search_gbt(df, 2, trials, stable_key="id").collect()
    for t, row in zip(trials, table):
        alone = models.param_search_gbt(df, 2, [t], stable_key="id").first()
        assert row.mean_score == pytest.approx(alone.mean_score) and row.n_folds == 2
    assert sum(r.is_best for r in table) == 1
    assert max(r.mean_score for r in table) == next(r.mean_score for r in table if r.is_best)


def test_staged_trials_cover_the_ranges():
    trials = models.draw_staged_trials(30, seed=1)
    assert len(trials) == 30 and trials == models.draw_staged_trials(30, seed=1)
    assert len({(t["max_depth"], t["step"]) for t in trials}) == 6
    for k, (lo, hi) in models.GBT_SPACE.items():
        assert all(lo <= t[k] <= hi for t in trials)


def test_best_iteration_is_restored(spark):
    df, x, y, role = data(spark, classes=6, seed=3)
    df = df.withColumn("fit_part", F.col("roles")[0] == B.TRAIN).withColumnRenamed("label", "target")
    fitted = models.boost_history(df, [(0.1, 1), (1.0, 6)], 30, stable_key="id")
    table = fitted.history_table(spark)
    assert table.count() == 2 * 31
    best = table.where("is_best").collect()
    assert len(best) == 1
    low = table.agg(F.min("valid_loss")).first()[0]
    scored = models.restore_best(fitted, df.where("not fit_part"))
    loss = scored.agg(F.avg(F.pow(F.col("prediction") - F.col("target"), 2))).first()[0]
    assert best[0].valid_loss == low == pytest.approx(loss)
    # the deep, fast one overfits: its last iteration is not its best
    assert fitted.best_round(1) < 30


def test_roles_of_expanding_folds(spark):
    rows = [(1, 1, "train"), (1, 2, "train"), (2, 1, "test"), (2, 2, "train"), (3, 2, "test")]
    got = models.fold_roles(spark.createDataFrame(rows, "id int, fold int, role string"), ["id"], 3)
    assert {r.id: list(r.roles) for r in got.collect()} == {1: [1, 1, 0], 2: [2, 1, 0], 3: [0, 2, 0]}


def test_nothing_to_fit(spark):
    df, *_ = data(spark, 20)
    with pytest.raises(ValueError):
        B.fit_boosters(df.where("false"), [B.Plan(1, 0.1, 1)], "logistic")
    with pytest.raises(ValueError):
        B.fit_boosters(df.withColumn("roles", F.array(F.lit(B.TEST))), [B.Plan(1, 0.1, 1)], "logistic")
    # one label only, and constant features: no tree splits, the shares are the answer
    flat = df.withColumn("label", F.lit(1.0)).withColumn("features", F.array(F.lit(1.0)))
    got = B.fit_boosters(flat.withColumn("roles", F.array(F.lit(B.TRAIN))), [B.Plan(3, 0.1, 2)], "logistic")
    assert got.transform(flat).where("prediction = 1").count() == 20


def test_no_sums_reach_the_driver(spark, monkeypatch):
    """Several blocks: what a job brings to the driver does not hold the bins' sums."""
    from pyspark import RDD

    sizes, real = [], RDD.collect

    def collect(self):
        got = real(self)
        sizes.append(len(pickle.dumps(got)))
        return got

    monkeypatch.setattr(B, "ROWS_PER_BLOCK", 100)
    monkeypatch.setattr(RDD, "collect", collect)
    df, *_ = data(spark, 400)
    plans = [B.Plan(3, 0.1, 3, role) for role in (0, 1)]
    got = B.fit_boosters(df, plans, "logistic", key="id")
    assert len(got.rounds) == 3 and (got.rounds[0][0].feature[:, 0] >= 0).all()
    # the deepest level alone has 2 x 4 nodes x 3 features x 32 bins x 2 doubles: 12 KB
    assert sizes and max(sizes) < 6000


def test_more_ensembles_than_blocks_grow_in_one_job(spark, monkeypatch):
    """Several blocks, and more ensembles than those: no job for each level of a tree."""
    def refuse(*args):
        raise AssertionError("a job for each level")

    monkeypatch.setattr(B, "ROWS_PER_BLOCK", 100)
    monkeypatch.setattr(B, "_grow", refuse)
    df, x, y, role = data(spark)
    plans = [B.Plan(6, 0.3, 3, 0), B.Plan(4, 0.5, 2, 1), B.Plan(5, 0.1, 1, 0), B.Plan(3, 0.2, 4, 1)]
    got = B.fit_boosters(df, plans, "logistic", key="id")
    for i, p in enumerate(plans):
        train = role == (B.TRAIN if p.role == 0 else B.TEST)
        want = plain(x, y, train, "logistic", 2, p.rounds, p.rate, p.depth)
        assert np.allclose(got.margins(x, i), want[-1], atol=1e-8)


@pytest.mark.parametrize("loss, classes", [("logistic", 2), ("softmax", 3), ("squared", 4)])
def test_sums_are_exact_in_any_order(spark, monkeypatch, loss, classes):
    """Blocks of any size, in tasks of their own or side by side: the very same trees."""
    df, *_ = data(spark, classes=classes, seed=2)
    if loss == "squared":
        df = df.withColumn("label", F.col("label") * 1234.567)
    plans = [B.Plan(5, 0.3, 4, role) for role in (0, 1, 0, 1)]
    k = classes if loss == "softmax" else 1
    fits = []
    for rows, most in ((1000, B.BYTES_ALONE), (100, B.BYTES_ALONE), (100, 0), (40, 0)):
        monkeypatch.setattr(B, "ROWS_PER_BLOCK", rows)
        monkeypatch.setattr(B, "BYTES_ALONE", most)
        fits.append(B.fit_boosters(df, plans, loss, classes=k, key="id"))
    for got in fits[1:]:
        for (trees, live), (other, _) in zip(fits[0].rounds, got.rounds, strict=True):
            assert len(live) == len(plans) * k and (trees.feature[:, 0] >= 0).all()
            for name in ("feature", "cut", "value"):
                assert np.array_equal(getattr(trees, name), getattr(other, name))


@pytest.mark.parametrize("paired", [1, 10 ** 9])
@pytest.mark.parametrize("features", [1, 4, 5])
def test_histogram(monkeypatch, features, paired):
    monkeypatch.setattr(B, "ROWS_PAIRED", paired)
    r = np.random.default_rng(5)
    bins = r.integers(0, B.BINS, (200, features)).astype(np.uint8)
    rows, slot = np.flatnonzero(r.random(200) < 0.5), r.integers(0, 3, 200)
    weight = r.integers(-9, 9, 200) + 1j * r.integers(0, 9, 200)
    got = B.histogram(B.paired(bins), features, rows, slot[rows], 3, weight[rows])
    want = np.zeros((3, features, B.BINS), complex)
    for i in rows:
        want[slot[i], np.arange(features), bins[i]] += weight[i]
    assert np.array_equal(got, want)
    whole = B.histogram(B.paired(bins), features, None, 0, 1, weight)
    assert whole.shape == (1, features, B.BINS) and (whole.sum(2) == weight.sum()).all()
