"""A NULL key, label, day or vector is a value like any other: no row is lost."""

import pytest
from pyspark.sql import functions as F

from driftpool.functions import clean
from driftpool.functions.ranking import row_number_in_group
from driftpool.operators import features, metrics, pooling, splits
from driftpool.sources import io, keyed


def labelled(spark, n=30):
    return spark.createDataFrame([(i, None if i % 3 == 0 else i % 3) for i in range(n)], "rid long, lab int")


def test_ranks_and_splits_keep_null_labels(spark):
    df = labelled(spark)
    got = row_number_in_group(df, ["lab"], ["rid"]).collect()
    by = {}
    for r in got:
        by.setdefault(r.lab, []).append((r.rid, r.rank))
    assert {k: len(v) for k, v in by.items()} == {None: 10, 1: 10, 2: 10}
    assert all([k for _, k in sorted(v)] == list(range(1, 11)) for v in by.values())
    assert splits.stratified_split(df, "lab", 1, "rid").where("is_test").count() == 6
    folds = splits.stratified_folds(df, "lab", 5, order=["rid"]).collect()
    assert len(folds) == 30
    assert all(sum(1 for r in folds if r.fold == f and r.lab == c) == 2 for f in range(5) for c in (None, 1, 2))
    ranked = splits.chronological_order(df, ["rid"], group=["lab"])
    assert splits.chrono_split(ranked, 0.2, ["lab"]).where("not train_a").count() == 6
    assert splits.expanding_folds(ranked, 4, group=["lab"]).where("role = 'test'").count() == 24


def test_scales_keep_null_series(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 2.0), ("a", 6.0)], "series string, x double")
    got = sorted((str(r.series), r.x) for r in features.minmax_scale(df, ["x"]).collect())
    assert got == [("None", 0.0), ("None", 1.0), ("a", 0.0), ("a", 1.0)]
    assert sorted(r.x for r in features.standard_scale(df, ["x"]).collect()) == [-1.0, -1.0, 1.0, 1.0]


def vectors(spark):
    rows = [("a", None, 1, [1.0, 0.0], 1), ("a", None, 2, [0.0, 1.0], 2), ("a", 1, 3, [2.0, 2.0], 3),
            ("a", 1, 4, None, 4), (None, 2, 5, [4.0, 0.0], 5), ("b", 9, 6, None, 6)]
    return spark.createDataFrame(rows, "series string, day int, vec_id long, v array<float>, ts int")


def test_pools_keep_null_days_and_skip_null_vectors(spark):
    v = vectors(spark)
    w = spark.createDataFrame([([0.0, 0.0],)], "w array<double>")
    mean = {(r.series, r.day): (r.n_items, r.v) for r in pooling.daily_mean_vector(v).collect()}
    assert mean == {("a", None): (2, [0.5, 0.5]), ("a", 1): (1, [2.0, 2.0]), (None, 2): (1, [4.0, 0.0])}
    att = lambda: {(r.series, r.day): (r.n_items, r.v) for r in pooling.attention_pool(v, w).collect()}
    assert att() == mean


def test_attention_pool_does_not_shuffle_vectors(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1")
    try:
        n = spark.range(2000).select(F.lit("a").alias("series"), (F.col("id") % 2).alias("day"),
                                     F.array(F.col("id").cast("float"), F.lit(1.0).cast("float")).alias("v"))
        w = spark.createDataFrame([([0.001, 0.0],)], "w array<double>")
        plan = pooling.attention_pool(n, w)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Join" not in plan  # states are shuffled, one for each day and step


def test_padded_day_of_any_length(spark):
    n = 10_000
    v = spark.range(n).select(F.lit("a").alias("series"), F.lit(1).alias("day"), F.col("id").alias("ts"),
                              F.col("id").alias("vec_id"), F.array(F.col("id").cast("float")).alias("v"))
    r = pooling.padded_daily_sequences(v).first()
    assert r.length == n and r.seq[0] == [0.0] and r.seq[-1] == [float(n - 1)] and sum(r.mask) == n


def test_reports_count_labels_outside_the_list(spark):
    df = spark.createDataFrame([(0, 0), (0, 5), (1, 1), (None, 1)], "y_true int, y_pred int")
    rep = {r.label: r for r in metrics.classification_report(df, [0, 1, 2]).collect()}
    assert rep["accuracy"].f1 == 0.5 and rep["accuracy"].support == 4
    assert rep["5"].support == 0 and rep["2"].support == 0 and rep[None].support == 1
    cm = {(r.y_true, r.y_pred): r.n for r in metrics.confusion_matrix(df, [0, 1, 2]).collect()}
    assert len(cm) == 11 and cm[0, 5] == 1 and cm[None, 1] == 1 and cm[2, 2] == 0
    dist = {r.y_true: r.n for r in metrics.class_distribution(df, [0, 7], "y_true").collect()}
    assert dist == {0: 2, 1: 1, 7: 0, None: 1}


def test_digest_keeps_messages_without_a_date(spark):
    df = spark.sql("SELECT * FROM VALUES (1L, CAST(NULL AS TIMESTAMP_NTZ), 'x'), (2L, NULL, 'y'), "
                   "(3L, TIMESTAMP_NTZ '2020-01-01 01:00:00', 'z') AS t(message_id, date, text)")
    got = {r.day: (r.n_news, [t.message_id for t in r.top]) for r in metrics.daily_digest(df, 1).collect()}
    assert len(got) == 2 and got[None] == (2, [2])


def test_unreadable_target_raises_and_writes_nothing(spark, tmp_path):
    path = tmp_path / "t"
    batch = spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "k long, o long, s string")
    assert keyed.append_if_absent(batch, str(path), ["k"], ["o"]).count() == 2
    (path / "part-broken.parquet").write_bytes(b"no parquet")
    before = sorted(p.name for p in path.iterdir())
    with pytest.raises(Exception, match="(?s).*"):
        keyed.append_if_absent(batch, str(path), ["k"], ["o"]).count()
    assert sorted(p.name for p in path.iterdir() if p.name.endswith(".parquet")) == [
        x for x in before if x.endswith(".parquet")]


def test_sql_file_returns_rows_whatever_it_begins_with(spark, tmp_path):
    for i, text in enumerate(("-- a comment\nSELECT 3 AS y;", "(SELECT 3 AS y)", "/* c */ WITH t AS "
                              "(SELECT 3 AS y) SELECT * FROM t", "FROM VALUES (3) AS t(y)")):
        f = tmp_path / f"{i}.sql"
        f.write_text(text)
        assert [tuple(r) for r in io.sql_file_query(spark, str(f)).collect()] == [(3,)]
    f = tmp_path / "c.sql"
    f.write_text("-- note\nCREATE OR REPLACE TEMP VIEW seen AS SELECT 1 AS x")
    assert tuple(io.sql_file_query(spark, str(f)).first()) == ("create", "ok")


def test_checks_on_values(spark):
    df = spark.createDataFrame([(1.0, [1.0, 2.0], 2), (None, None, 2)], "x double, v array<double>, n int")
    ok = df.select(clean.finite_or_fail("x").alias("x"), clean.checked_vector("v", "n").alias("v"))
    assert [tuple(r) for r in ok.collect()] == [(1.0, [1.0, 2.0]), (None, None)]
    for bad in (float("inf"), float("nan")):
        with pytest.raises(Exception, match="not finite"):
            df.select(clean.finite_or_fail(F.lit(bad))).collect()
    with pytest.raises(Exception, match="stored size"):
        df.select(clean.checked_vector("v", F.lit(3))).collect()
