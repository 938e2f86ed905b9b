"""Forests and boosting: partitions follow the rows, trees are wrapped when asked for."""

import random

import pytest
from pyspark.sql import functions as F

from driftpool.operators import models


@pytest.fixture(scope="module")
def rows(spark):
    r = random.Random(5)
    data = [(i, i % 3, r.randrange(2), [r.random() for _ in range(4)]) for i in range(48)]
    return models.as_features(spark.createDataFrame(data, "id int, fold int, label int, v array<double>"), "v")


@pytest.mark.parametrize("fit", [
    lambda d: models.random_forest(d, num_trees=4, max_depth=3, stable_key="id"),
    lambda d: models.gbt(d, max_iter=4, max_depth=2, stable_key="id")])
def test_a_fit_wraps_no_tree(rows, fit):
    model = fit(rows)
    assert "trees" not in vars(model)
    assert len(model.trees) == model.getNumTrees == 4
    assert model.transform(rows).where("prediction in (0, 1)").count() == 48


def test_the_search_does_not_follow_the_session(spark, rows, monkeypatch):
    monkeypatch.setattr(models, "RF_SPACE", {"num_trees": (3, 6), "max_depth": (2, 3)})
    before, got = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for n in ("8", "13"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            got.append(models.param_search(rows, "fold", n_trials=3, keep=("id",), stable_key="id").collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got[0] == got[1] and sum(r.is_best for r in got[0]) == 1


def test_partitions_follow_the_rows(spark, rows, monkeypatch):
    dealt, fit = [], models.fit_cached
    monkeypatch.setattr(models, "LEAST_PARTS", 2)
    monkeypatch.setattr(models, "fit_cached", lambda e, d: dealt.append(d.rdd.getNumPartitions()) or fit(e, d))
    for size in (65_536, 16, 1):
        monkeypatch.setattr(models, "ROWS_PER_BLOCK", size)
        models.gbt(rows, max_iter=2, max_depth=2, stable_key="id")
    most = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert dealt == [2, 3, most] and models.row_parts(rows.where(F.lit(False))) == 2
