import random

import pytest
import xxhash

from driftpool.llm import simhash
from driftpool.llm.components import components
from tests.llm.helpers import docs, odd_rows, words


def brute_fp(text, k=3):
    w = [x.translate({c: c + 32 for c in range(65, 91)}).encode() for x in
         __import__("re").findall(r"[^\x20\x09-\x0D]+", text or "")]
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(b" ".join(w[i:i + k]), 42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_groups(fps):
    """{fp: smallest fp reachable over links of at most two bits}"""
    fps, root = sorted(set(fps)), {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[i + 1:]:
            if bin(a ^ b).count("1") <= 2:
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {x: find(x) for x in fps}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_fingerprint_equals_brute_force():
    for t in [None, "", "  ", "A", "A b", "A b\x0bC", "Ä É x y z", words(4, 400), words(5, 70_000)]:
        got = simhash.fingerprint(t.encode() if t is not None else None, 3)
        assert got & (1 << 64) - 1 == brute_fp(t)


def test_links_and_components_equal_brute_force(spark):
    r = random.Random(3)
    fps = {0, (1 << 64) - 1, 1, 3, 7, 1 << 63, r.getrandbits(64)}
    for _ in range(60):  # clusters: flips of up to three bits, chains, and single ones
        x = r.getrandbits(64)
        fps.add(x)
        for _ in range(r.randrange(6)):
            y = x
            for _ in range(r.randrange(1, 4)):
                y ^= 1 << r.randrange(64)
            fps.add(y)
            x = r.choice([x, y])
    want = brute_groups(fps)
    df = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    got = {r.fp & (1 << 64) - 1: r.root & (1 << 64) - 1 for r in simhash.roots(df).collect()}
    by = {}
    for x in fps:
        by.setdefault(want[x], set()).add(got[x])
    assert got.keys() == fps and all(len(v) == 1 for v in by.values())
    assert len({next(iter(v)) for v in by.values()}) == len(by)
    # links are real: no two fingerprints further apart than two bits
    assert all(bin((a ^ b) & (1 << 64) - 1).count("1") <= 2 for a, b in simhash.links(df).collect())


def test_a_dense_group_costs_rows_not_pairs(spark):
    center = 0x123456789ABCDEF0
    ball = {center} | {center ^ 1 << i for i in range(64)} | {center ^ 3 << i for i in range(63)}
    df = spark.createDataFrame([(signed(x),) for x in ball], "fp long")
    assert simhash.links(df).count() <= 65 * len(ball)
    assert {r.root for r in simhash.roots(df).collect()}.__len__() == 1


def test_near_duplicates_with_odd_rows(spark):
    rows = odd_rows()
    got = simhash.near_duplicates(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    want = brute_groups([brute_fp(t) for _, t, _, _ in rows])
    low = {}
    for i, t, _, _ in rows:
        if i is not None:
            g = want[brute_fp(t)]
            low[g] = min(low.get(g, i), i)
    expect = sorted((str(i), f"{brute_fp(t):016x}", str(low.get(want[brute_fp(t)]))) for i, t, _, _ in rows)
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == expect


def test_keep_one_leaves_one_row_of_each_group(spark):
    rows = odd_rows() + [(None, "only here", "en", "a"), (None, "only here", "en", "a")]
    df = docs(spark, rows)
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    want = brute_groups([brute_fp(t) for _, t, _, _ in rows])
    assert kept.count() == len(set(want.values()))
    assert {r.doc_id for r in kept.collect()} == {1, 4, 5, 6, 8, 9, None}


def test_empty_table(spark):
    assert simhash.near_duplicates(docs(spark, [])).count() == 0
    assert simhash.keep_one(docs(spark, [])).count() == 0


@pytest.mark.parametrize("n", [1, 2, 50])
def test_components_of_chains_and_stars(spark, n):
    chain = [(i, i + 1) for i in range(n)]
    star = [(1000, 1001 + i) for i in range(n)]
    e = spark.createDataFrame(chain + star + [(5000, 5000), (None, 1), (3, 2)], "u long, v long")
    got = {r.node: r.root for r in components(e).collect()}
    want = {i: 0 for i in range(max(n + 1, 4) if n > 2 else n + 1)}
    for i in range(n + 1):
        want[1000 + i] = 1000
    if n <= 2:  # (3, 2) joins the chain only where the chain reaches 2
        want.update({2: 0, 3: 0} if n == 2 else {2: 2, 3: 2})
    assert got == want


def test_query_at_sf001(spark):
    sf = "/root/testdata/sf0.001"
    got = simhash.query(spark, sf).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    want = brute_groups([brute_fp(t) for t in texts.values()])
    low = {}
    for i, t in texts.items():
        g = want[brute_fp(t)]
        low[g] = min(low.get(g, i), i)
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in got} == {
        (i, f"{brute_fp(t):016x}", low[want[brute_fp(t)]]) for i, t in texts.items()}
