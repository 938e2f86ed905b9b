"""S02 insert-if-absent: duplicates in the batch, against the target, NULL key
parts, count identity and a second run (FIXTURES.md §3)."""

import os
import uuid

from driftpool.sources import keyed

SCHEMA = "a long, b long, ord int, payload string"


def test_insert_if_absent_cases(spark):
    batch = spark.createDataFrame([
        (1, 1, 2, "late dup"), (1, 1, 1, "first"), (2, 2, 1, "in target"),
        (None, 3, 1, "null key 1"), (None, 3, 2, "null key 2"), (4, 4, 1, "new")], SCHEMA)
    target = spark.createDataFrame([(2, 2, 0, "old")], SCHEMA)
    out = keyed.insert_if_absent(batch, target, ["a", "b"], ["ord"])
    got = sorted(r.payload for r in out.collect())
    assert got == sorted(["first", "null key 1", "null key 2", "new"])
    c = keyed.insert_counts(batch, out).first()
    assert (c.batch_rows, c.inserted, c.skipped) == (6, 4, 2)


def test_second_run_inserts_nothing(spark, tmp_path):
    path = os.path.join(str(tmp_path), f"t-{uuid.uuid4().hex}")
    batch = spark.createDataFrame([(1, 1, 1, "x"), (1, 1, 2, "y"), (2, 1, 1, "z")], SCHEMA)
    t1 = keyed.append_if_absent(batch, path, ["a", "b"], ["ord"])
    assert t1.count() == 2
    t2 = keyed.append_if_absent(batch, path, ["a", "b"], ["ord"])
    assert t2.count() == 2
    assert sorted(r.payload for r in t2.collect()) == ["x", "z"]
