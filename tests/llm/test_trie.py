import hashlib
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftpool.llm import trie
from tests.harness import duck

#: extra columns bear names that the operator uses inside or returns
TURNS = T.StructType([
    T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()),
    T.StructField("role", T.StringType()), T.StructField("text", T.StringType()),
    T.StructField("conv", T.StringType()), T.StructField("path", T.StringType()),
    T.StructField("node", T.LongType()), T.StructField("size", T.LongType())])


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 1, 2) for r in rows], TURNS)


def brute(convs):
    """{conv: [(role, text)]} -> sorted output rows"""
    nodes = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    children = {}
    for p in nodes:
        if p:
            children.setdefault(p[:-1], []).append(p)
    leaves, saved = {}, {}
    for p in sorted(nodes, key=len, reverse=True):
        own = children.get(p, [])
        leaves[p] = sum(leaves[x] for x in own) or 1
        saved[p] = sum(saved[x] for x in own) + ((len(nodes[p]) - 1) * len(p[-1][1]) if p else 0)
    out = []
    for p, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(c for c in members if len(convs[c]) == len(p)))
        out.append((min(members), len(p), min(nodes[p[:-1]]) if p else -1, len(members),
                    len(children.get(p, [])), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


def rows_of(df):
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs,
                   r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect())


def conversations(seed, n):
    """Shared beginnings, whole copies, one very common conversation and a long one."""
    r, out = random.Random(seed), {}
    for c in range(n):
        if c % 3 == 0:
            turns = [("user", "hello"), ("assistant", "hi")]
        elif out and c % 5 == 0:
            turns = out[r.choice(sorted(out))][:r.randrange(6)] + [("user", f"t{r.randrange(4)}")]
        else:
            turns = [(r.choice(["user", "assistant"]), f"é{r.randrange(3)}") for _ in range(r.randrange(1, 7))]
        out[c * 7 - 50] = turns
    out[9999] = [("user", f"x{i}") for i in range(300)]
    out[10000] = out[9999][:250]
    return out


@pytest.mark.parametrize("shard_turns", [4, 40, 100_000])
def test_equals_brute_force(spark, shard_turns, monkeypatch):
    """Many shards, a few and one; pieces of a node's ends shorter than its ends."""
    monkeypatch.setattr(trie, "PIECE", 3)
    convs = conversations(shard_turns, 250)
    df = table(spark, [(c, i, role, text) for c, turns in convs.items()
                       for i, (role, text) in enumerate(turns)])
    assert rows_of(trie.prefix_trie(df, shard_turns=shard_turns)) == brute(convs)


def test_skeleton_covers_what_reaches_into_two_shards():
    r = random.Random(1)
    sample = sorted((b"".join(bytes([r.randrange(3)]) * 16 for _ in range(r.randrange(5))), i)
                    for i in range(200))
    skeleton = trie.Skeleton.build(sample, 20)
    found = {}
    for path, conv in sample:
        shard = trie.bisect_right(skeleton.splitters, (path, conv))
        for n in range(0, len(path) + 1, 16):
            found.setdefault(path[:n], set()).add(shard)
    assert len(skeleton.splitters) > 10
    for path, shards in found.items():
        node = 0
        for n in range(0, len(path), 16):
            node = None if node is None else skeleton.children[node].get(path[n:n + 16])
        assert node is not None or len(shards) == 1
    for node, up, depth, last in skeleton.rows:
        assert last >= node and (up is None or skeleton.rows[up][2] == depth - 1
                                 and skeleton.rows[up][3] >= last)


def test_odd_rows(spark):
    rows = [(1, None, "user", "first"), (1, 2, None, None), (1, 2, None, None), (1, 0, "a", "b"),
            (2, 0, "user", "first"), (2, None, "user", "first"), (None, 0, "user", "lost"),
            (3, 5, "", ""), (4, None, None, None), (5, 1, "user", "x" * 200_000), (6, 1, "userx", ""),
            (7, 1, "user", "x")]
    got = trie.prefix_trie(table(spark, rows))
    assert rows_of(got) == brute({
        1: [("user", "first"), ("a", "b"), ("", ""), ("", "")], 2: [("user", "first")] * 2,
        3: [("", "")], 4: [("", "")], 5: [("user", "x" * 200_000)], 6: [("userx", "")], 7: [("user", "x")]})
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
                           "saved_tokens", "ends_sha256"]
    assert trie.prefix_trie(table(spark, [])).count() == 0
    assert trie.prefix_trie(table(spark, [(None, 1, "user", "x")])).count() == 0


def test_borrowed_heads(spark):
    convs = conversations(5, 60)
    df = table(spark, [(c, i, *t) for c, turns in convs.items() for i, t in enumerate(turns)])
    base = {c: (c - c % 10 if c % 4 else 77777, abs(c) % 6) for c in convs}
    want = {c: convs.get(b, [])[:n] + convs[c][n:] for c, (b, n) in base.items()}
    c = F.col("conv")
    got = trie.with_heads(trie.paths(df), F.when(F.pmod(c, F.lit(4)) != 0, c - F.pmod(c, F.lit(10)))
                          .otherwise(77777), (F.abs(c) % 6).cast("int"))
    assert any(not turns for turns in want.values())
    assert rows_of(trie.trie(got, 50)) == brute(want)


def test_query_equals_oracle(spark):
    sf = "/root/testdata/sf0.001"
    want = duck(sf).execute(trie.ORACLE_SQL).fetchall()
    assert sorted(map(str, (tuple(r) for r in trie.query(spark, sf).collect()))) == sorted(map(str, want))
