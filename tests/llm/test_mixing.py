import random
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from driftpool.llm import mixing
from tests.llm.helpers import docs, odd_rows, words


def water(sizes):
    """Targets by sharing the excess again and again; sizes in source order."""
    w = [float(mixing.WEIGHTS[i % 3]) for i in range(len(sizes))]
    total, target, full = float(sum(sizes)), [0.0] * len(sizes), set()
    while True:
        rest = total - sum(3 * sizes[i] for i in full)
        open_ = [i for i in range(len(sizes)) if i not in full]
        share = sum(w[i] for i in open_)
        for i in open_:
            target[i] = rest * w[i] / share
        over = {i for i in open_ if target[i] > 3 * sizes[i]}
        if not over:
            return target
        for i in over:
            target[i] = 3.0 * sizes[i]
        full |= over


def test_targets_equal_repeated_sharing(spark):
    r = random.Random(5)
    for n in (1, 2, 3, 7, 30):
        sizes = [r.choice([0, 1, 10, 100, 1000, 10**6]) for _ in range(n)] + [50]
        df = spark.createDataFrame([(f"s{i:03}", x) for i, x in enumerate(sizes[:-1])]
                                   + [(None, sizes[-1])], "source string, source_size long")
        got = {row.source: row.target for row in mixing.targets(df).collect()}
        names = [f"s{i:03}" for i in range(n)] + [None]
        assert np.allclose([got[x] for x in names], water(sizes), rtol=1e-12)


def test_hypergeometric_equals_the_distribution(spark):
    from math import comb

    cases = [(5, 12, 6), (0, 9, 4), (9, 9, 4), (3, 40, 39), (300, 700, 350)]
    n = 4000
    df = spark.range(n).withColumn("u", (F.col("id") + 0.5) / n)
    for good, total, need in cases:
        k = mixing.hypergeometric(*[F.lit(x) for x in (good, total, need)], F.col("u"))
        got = Counter(int(r[0]) for r in df.select(k).collect())
        ks = range(max(0, need - total + good), min(good, need) + 1)
        p = {k: comb(good, k) * comb(total - good, need - k) / comb(total, need) for k in ks}
        # stratified uniforms: every count is within one of its expectation
        assert all(abs(got[k] - n * p[k]) <= 2 for k in ks) and sum(got.values()) == n


def test_quotas_are_split_exactly(spark):
    quotas = [40, 0, 7, 1, 900]
    df = spark.createDataFrame(list(enumerate(quotas)), "rank int, quota long")
    rows = mixing.split_quotas(df, 16).collect()
    by_shard, by_rank = defaultdict(int), defaultdict(int)
    for r in rows:
        assert r.quota >= 0
        by_shard[r.shard] += r.quota
        by_rank[r.rank] += r.quota
    assert [by_rank[i] for i in range(5)] == quotas
    assert len(by_shard) == 16 and max(by_shard.values()) - min(by_shard.values()) <= 1
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.split_quotas(df, 16).collect()))


def big(spark):
    r = random.Random(2)
    rows = [(i, words(i, r.randrange(1, 80)), "en", r.choice(["a", "a", "a", "b", "c", None]))
            for i in range(600)]
    return rows, docs(spark, rows)


def test_counts_come_near_targets(spark):
    rows, df = big(spark)
    got = mixing.mix_counts(df).collect()
    assert len(got) == len(rows)
    src = {i: s for i, _, _, s in rows}
    sizes, taken, target = Counter(), Counter(), {}
    for r in got:
        s = src[r.doc_id]
        sizes[s] += r.size
        taken[s] += r.taken
        target[s] = r.target
        assert r.taken % max(1, r.size) == 0 and r.taken <= 3 * r.size
    order = ["a", "b", "c", None]
    assert np.allclose([target[s] for s in order], water([sizes[s] for s in order]))
    assert all(abs(taken[s] - target[s]) <= 0.01 * target[s] + 5 for s in order)
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix_counts(df).collect()))


def test_the_mix_holds_what_the_counts_say(spark):
    rows, df = big(spark)
    counts = {r.doc_id: r.taken // max(1, r.size) for r in mixing.mix_counts(df).collect()}
    out = mixing.mix(df, shards=8)
    assert out.columns == [*df.columns, "shard", "pass"]
    got = out.collect()
    assert Counter(r.doc_id for r in got) == Counter({i: n for i, n in counts.items() if n})
    assert {r.shard for r in got} == set(range(8))
    # a document is taken once a pass
    assert len({(r.doc_id, r["pass"]) for r in got}) == len(got)


def test_odd_rows(spark):
    rows = odd_rows()
    got = mixing.mix_counts(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    assert all(r.size == 0 and r.taken == 0 for r in got if r.doc_id in (1, 2, 3))
    assert {r.size for r in got if r.doc_id == 9} == {7}
    assert mixing.mix_counts(docs(spark, [])).count() == 0
    assert mixing.mix(docs(spark, [])).count() == 0
    alone = mixing.mix_counts(docs(spark, [(1, None, None, None), (2, "", "en", "a")])).collect()
    assert [(r.taken, r.target) for r in alone] == [(0, 0.0)] * 2
    assert mixing.mix(docs(spark, rows)).count() >= 1
