"""S02 on a bucketed table: same rows as the plain way, stored keys not shuffled."""

import random

import pytest
from pyspark.sql import functions as F

from driftpool.sources import keyed

SCHEMA = "payload string, a long, ord int, b string"  # key columns are not the first ones


def rows(seed, n):
    r = random.Random(seed)
    return [(f"{seed}-{i}", r.choice([None, *range(40)]), r.randrange(5), r.choice([None, "x", "y'z", "ü"]))
            for i in range(n)]


@pytest.mark.parametrize("threshold", ["-1", "32m"])
def test_equals_the_plain_append(spark, tmp_path, threshold):
    """The stored keys merged bucket by bucket, and broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    plain, bucketed = str(tmp_path / "plain"), str(tmp_path / "it's bucketed")
    for seed in (1, 2, 3):
        batch = spark.createDataFrame(rows(seed, 300), SCHEMA)
        p = keyed.append_if_absent(batch, plain, ["a", "b"], ["ord"])
        b = keyed.append_bucketed(batch, bucketed, ["a", "b"], ["ord"], buckets=4)
        assert sorted(map(str, p.collect())) == sorted(map(str, b.collect()))
    assert keyed.append_bucketed(batch.where("false"), bucketed, ["a", "b"], ["ord"], 4).count() == p.count()
    # files are plain Parquet: any reader sees the table
    assert spark.read.parquet(bucketed).count() == p.count()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_only_the_batch_is_shuffled_and_it_is_read_once(spark, tmp_path):
    path, src = str(tmp_path / "t"), str(tmp_path / "batch")
    spark.createDataFrame(rows(1, 300), SCHEMA).write.parquet(src)
    batch = spark.read.parquet(src)
    table = keyed.append_bucketed(batch, path, ["a", "b"], ["ord"], buckets=4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = keyed.insert_if_absent(batch, table, ["a", "b"], ["ord"])._jdf.queryExecution().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    physical = plan.split("== Physical Plan ==")[1]
    scans = [line for line in physical.splitlines() if "FileScan" in line]
    assert len(scans) == 2 and sum("Bucketed: true" in s for s in scans) == 1
    lines = physical.splitlines()
    at = next(i for i, line in enumerate(lines) if "Bucketed: true" in line)
    depth = len(lines[at]) - len(lines[at].lstrip(" :|+-*("))
    above = []
    for line in reversed(lines[:at]):  # from the bucketed scan up to the join
        own = len(line) - len(line.lstrip(" :|+-*("))
        if own < depth:
            above.append(line)
            depth = own
        if "SortMergeJoin" in line:
            break
    assert "SortMergeJoin" in above[-1] and not any("Exchange" in line for line in above)


def test_null_keys_all_pass_and_ties_are_broken(spark):
    batch = spark.createDataFrame([("p", None, 1, "x")] * 3 + [("b", 1, 1, "x"), ("a", 1, 1, "x")], SCHEMA)
    got = keyed.first_per_key(batch, ["a", "b"], ["ord"])
    assert sorted(r.payload for r in got.collect()) == ["a", "p", "p", "p"]
    assert got.columns == batch.columns
    assert keyed.first_per_key(batch.where(F.lit(False)), ["a", "b"], ["ord"]).count() == 0


def test_every_column_is_shuffled_once(spark):
    first = keyed.first_per_key(spark.createDataFrame(rows(1, 50), SCHEMA), ["a", "b"], ["ord"])
    node = first._jdf.queryExecution().executedPlan().initialPlan()
    while not node.nodeName().startswith("Exchange"):
        node = node.children().apply(0)
    sent = node.schema().catalogString()
    assert [sent.count(f"{c}:") for c in ("payload", "ord", "a", "b")] == [1, 1, 1, 1]


def test_first_rows_are_those_of_a_sort(spark):
    batch = rows(7, 400) + [(None, 3, None, "x"), (None, 3, 0, "x"), ("", 3, 0, "x")]
    got = keyed.first_per_key(spark.createDataFrame(batch, SCHEMA), ["a", "b"], ["ord"]).collect()
    low = lambda v: (v is not None, v)
    first = {}
    for p, a, o, b in sorted(batch, key=lambda r: (low(r[2]), low(r[0]))):
        first.setdefault((a, b), (p, a, o, b))
    full = [r for r in batch if r[1] is None or r[3] is None]
    want = full + [r for k, r in first.items() if None not in k]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_a_key_may_be_a_float_or_an_ordinal(spark):
    batch = spark.createDataFrame([(-0.0, 2, "p"), (0.0, 3, "q"), (1.5, 9, "r"), (1.5, 8, "s")],
                                  "k double, o int, p string")
    got = keyed.first_per_key(batch, ["k"], ["k", "o"]).collect()
    assert sorted(map(str, map(tuple, got))) == ["(-0.0, 2, 'p')", "(1.5, 8, 's')"]
