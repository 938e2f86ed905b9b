import numpy as np
import pyarrow as pa
import pytest

from driftpool.llm import ann


def frame(spark, x, ids=None):
    ids = range(len(x)) if ids is None else ids
    return spark.createDataFrame([(int(i), [float(y) for y in v], "l", 1) for i, v in zip(ids, x)],
                                 "vec_id long, embedding array<float>, list string, shard int")


def brute(x, ids, q, k=10):
    d = np.sqrt(((x - x[q]) ** 2).sum(1))
    d[ids == ids[q]] = np.inf
    order = np.lexsort((ids, d))[:min(k, int(np.isfinite(d).sum()))]
    return [(int(ids[i]), d[i]) for i in order]


def recall(spark, x):
    x = np.asarray(x, np.float32).astype(float)
    df, ids, got = frame(spark, x), np.arange(len(x)), {}
    for r in ann.search(df, df.where("vec_id % 20 = 0")).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got.keys() == {i for i in range(len(x)) if i % 20 == 0}
    hits = 0
    for q, found in got.items():
        want = brute(x, ids, q)
        assert len(found) == len(want) and found == sorted(found, key=lambda p: (p[1], p[0]))
        assert all(abs(s - np.sqrt(((x[i] - x[q]) ** 2).sum())) < 1e-12 for i, s in found)
        hits += len({i for i, _ in found} & {i for i, _ in want}) / len(want)
    return hits / len(got)


@pytest.mark.parametrize("kind", ["sphere", "clusters"])
def test_recall_against_brute_force(spark, kind):
    r = np.random.default_rng(1)
    x = r.normal(size=(4000, 32))
    if kind == "clusters":
        x = r.normal(size=(40, 32))[r.integers(0, 40, 4000)] * 4 + x
    x /= np.linalg.norm(x, axis=1)[:, None]
    assert recall(spark, x) >= 0.9


def test_a_third_of_all_rows_alike(spark, monkeypatch):
    monkeypatch.setattr(ann, "SHARD_ROWS", 50)
    r = np.random.default_rng(2)
    x = r.normal(size=(900, 8))
    x[::3] = x[0]
    assert recall(spark, x) >= 0.9


def by_id(x, ids, q, k=10):
    """The k nearest other ids of a query, each at its nearest vector."""
    d = np.sqrt(((x - x[q]) ** 2).sum(1))
    least = {}
    for i, y in zip(ids.tolist(), d.tolist()):
        if i != ids[q]:
            least[i] = min(y, least.get(i, np.inf))
    return sorted((y, i) for i, y in least.items())[:k]


@pytest.mark.parametrize("kind", ["one id", "every row", "one id, other vectors"])
def test_repeated_ids_leave_room_for_others(spark, kind):
    r = np.random.default_rng(5)
    x = r.normal(size=(300, 8)).astype(np.float32).astype(float)
    x[8], ids = x[7] + 0.125, np.arange(300)
    if kind == "every row":
        x, ids = np.repeat(x, 2, axis=0), np.repeat(ids, 2)
    else:
        ids[::3] = 7
        x[ids == 7] = x[7]
        if kind == "one id, other vectors":
            x[ids == 7] += (r.normal(size=(int((ids == 7).sum()), 8)) * 0.01).astype(np.float32)
            x = x.astype(np.float32).astype(float)
    df, got = frame(spark, x, ids), {}
    queries = df.where("vec_id % 50 in (1, 8, 31)")
    for m in ann.search(df, queries, list_rows=1000).orderBy("query_id", "rank").collect():
        got.setdefault(m.query_id, []).append((m.score, m.vec_id))
    for q in {i for i in ids.tolist() if i % 50 in (1, 8, 31)}:
        want = by_id(x, ids, int(np.flatnonzero(ids == q)[0]))
        assert [i for _, i in got[q]] == [i for _, i in want] and len(want) == 10
        assert np.allclose([s for s, _ in got[q]], [s for s, _ in want], atol=1e-12)


def test_lists_are_read_until_they_hold_enough_ids(spark):
    r = np.random.default_rng(6)
    x, ids = r.normal(size=(1200, 4)) * 0.01, np.zeros(1200, int)
    x[600:], ids[600:] = r.normal(size=(600, 4)) + 40, np.arange(600) + 1
    x[600], ids[600] = x[0] + 0.001, 1
    df = frame(spark, x, ids)
    got = ann.search(df, df.where("vec_id = 1")).collect()
    assert len(got) == 10 and len({m.vec_id for m in got}) == 10


def test_small_and_odd_tables(spark):
    rows = [(1, [1.0, 0.0], "x"), (2, [0.0, 1.0], "x"), (3, [0.0, 0.0], "x"), (4, None, "x"),
            (5, [None, 1.0], "x"), (6, [float("nan"), 1.0], "x"), (7, [float("inf"), 1.0], "x"),
            (8, [1.0, 0.0], "x"), (8, [1.0, 0.0], "x"), (None, [1.0, 1.0], "x"), (9, [], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    got = [tuple(r) for r in ann.search(df, df).orderBy("query_id", "rank").collect()]
    s = 2.0 ** 0.5
    assert got == [(1, 1, 8, 0.0), (1, 2, 2, s), (2, 1, 1, s), (2, 2, 8, s), (8, 1, 1, 0.0), (8, 2, 2, s)]
    assert ann.search(df.where("false"), df).count() == 0
    assert ann.search(df, df.where("false")).count() == 0


def test_graph_search_finds_the_lists_within_the_ratio():
    r = np.random.default_rng(3)
    heads = ann.Heads.build(r.normal(size=(600, 16)))
    sizes, found, want = np.full(600, 10), 0, 0
    for q in r.normal(size=(50, 16)):
        d = np.sort(np.sqrt(((heads.centres - q) ** 2).sum(1)))
        inside = int((d <= d[:ann.BASE].mean() * (1 + ann.PRUNE)).sum())
        found += len(heads.search(q, sizes, 11))
        want += inside
    assert 0.95 * want <= found <= 1.05 * want


def test_query_recall(spark):
    sf = "/root/testdata/sf0.1"
    t = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").toPandas()
    x, ids = np.stack(t.embedding).astype(float), t.vec_id.to_numpy()
    got = ann.query(spark, sf).toPandas()
    hits = [len(set(g.vec_id) & {i for i, _ in brute(x, ids, int(np.flatnonzero(ids == q)[0]))}) / 10
            for q, g in got.groupby("query_id")]
    assert len(hits) == (ids % 100 == 0).sum() and np.mean(hits) >= 0.9


def test_long_lists_are_split_level_by_level(spark, monkeypatch):
    """Few top centres: their lists are split twice over; recall and distances hold."""
    for name, value in (("MAX_CENTRES", 4), ("SPLIT_ROWS", 300), ("SPLIT_PARTS", 4), ("QUERY_BLOCK", 7),
                        ("SHARD_ROWS", 100)):
        monkeypatch.setattr(ann, name, value)
    r = np.random.default_rng(11)
    x = r.normal(size=(60, 16))[r.integers(0, 60, 4000)] * 2 + r.normal(size=(4000, 16))
    assert recall(spark, x) >= 0.9


def test_lists_that_cannot_be_split(spark, monkeypatch):
    """Vectors that hardly differ: one centre, a list in shards, its queries in blocks."""
    for name, value in (("SPLIT_ROWS", 50), ("QUERY_BLOCK", 3), ("SHARD_ROWS", 40)):
        monkeypatch.setattr(ann, name, value)
    x = np.full((400, 4), 1.0)
    x[:, 0] += np.arange(400) % 7 * 1e-3
    assert recall(spark, x) >= 0.9


def test_copies_keep_the_smallest_ids(spark):
    r = np.random.default_rng(13)
    rows = [(int(i), [float(i % 5), 1.0]) for i in r.permutation(500)] + [(1000 + i, [9.0 + i, 2.0]) for i in range(5)]
    df = spark.createDataFrame(rows, "id long, v array<float>")
    got = ann.without_copies(df, 3).collect()
    assert sorted(x.id for x in got) == [*range(15), *range(1000, 1005)]
    assert ann.without_copies(df, 100) is df


@pytest.mark.parametrize("offset", [0.0, 1e4, 1e6])
def test_far_from_the_origin(offset):
    """Rounding of large norms loses no neighbour."""
    r = np.random.default_rng(17)
    x = r.normal(size=(3000, 32)) * 0.01 + offset
    rows = pa.table({"id": pa.array(range(3000), pa.int64()), "v": pa.array(list(x), pa.list_(pa.float64()))})
    asked = rows.slice(0, 40).rename_columns(["query_id", "v"])
    got = ann._nearest(10)(rows, asked).to_pandas()
    for q, found in got.groupby("query_id"):
        assert [i for i, _ in brute(x, np.arange(3000), q)] == found.sort_values(
            ["score", "vec_id"]).vec_id.tolist()


@pytest.mark.parametrize("split", [False, True])
def test_recall_on_sparse_vectors(spark, monkeypatch, split):
    """Most parts are zero, so a vector's neighbours lie in lists far from it; the pruning
    ratio is fitted to that, also where lists are split, however many levels that takes."""
    r = np.random.default_rng(21)
    x = (r.random((5000, 64)) < 0.05) * r.normal(size=(5000, 64))
    if split:
        for name, value in (("MAX_CENTRES", 4), ("SPLIT_ROWS", 300), ("SPLIT_PARTS", 16)):
            monkeypatch.setattr(ann, name, value)
    else:
        monkeypatch.setattr(ann.search, "__defaults__", (10, "vec_id", "embedding", 20))
    x[~x.any(1)] = r.normal(size=64)
    assert recall(spark, x) >= 0.9
