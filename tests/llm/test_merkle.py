import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from driftpool.llm import merkle
from tests.harness import duck
from tests.llm.helpers import docs, odd_rows


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def value(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(leaves, fanout):
    """(root, each leaf's proof as (before, after) per level), by plain recursion on levels"""
    proofs, at, level = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(level) > 1:
        for k, i in enumerate(at):
            first = i // fanout * fanout
            proofs[k].append(("".join(level[first:i]), "".join(level[i + 1:first + fanout])))
        level = [sha("".join(level[i:i + fanout])) for i in range(0, len(level), fanout)]
        at = [i // fanout for i in at]
    return level[0], proofs


def brute(rows, fanout=2):
    """rows: (id, group, leaf) -> sorted (id, leaf, subroot, root, proof)"""
    groups = {}
    for i, g, leaf in rows:
        groups.setdefault(g, []).append((i is not None, i or 0, leaf, i))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    subs = [tree([x[2] for x in sorted(groups[g])], fanout) for g in order]
    root, tops = tree([s for s, _ in subs], fanout)
    return sorted((str(x[3]), x[2], sub, root, proof + top)
                  for g, (sub, proofs), top in zip(order, subs, tops)
                  for x, proof in zip(sorted(groups[g]), proofs))


def rows_of(df):
    return sorted((str(r.doc_id), r.leaf, r.subroot, r.root, [tuple(p) for p in r.proof])
                  for r in df.collect())


@pytest.mark.parametrize("fanout, block", [(2, 2), (2, 8), (3, 9), (2, 4096)])
def test_equals_plain_tree(spark, fanout, block):
    """Groups of every size up to some blocks: aligned, ragged, one leaf, null and clashing names."""
    rows = [(1000 * g + i, name, sha(f"{g}/{i}")) for g, (name, n) in enumerate(
        [(None, 1), ("", 2), ("a", 7), ("b", 16), ("+", 17), ("é", 33), ("z", 9), ("zz", 1)])
        for i in range(n)]
    rows += [(None, "a", sha("null id")), (2003, "a", sha("same id")), (2003, "a", sha("same id"))]
    df = (spark.createDataFrame(rows, "doc_id long, lang string, h string")
          .withColumn("g", F.lit("x")).withColumn("block", F.lit(1)).withColumn("pos", F.lit(None)))
    got = merkle.manifest(df, "h", "doc_id", "lang", fanout=fanout, block_rows=block)
    assert rows_of(got) == brute(rows, fanout)


def test_proofs_lead_to_the_root_and_show_tampering(spark):
    rows = [(i, "ab"[i % 2], sha(str(i))) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, h string").withColumn(
        "other", F.lit(sha("other")))
    got = merkle.manifest(df, "h", "doc_id", "lang", ["other"], block_rows=4)
    got = got.select("root", merkle.fold(F.col("leaf"), F.col("proof")).alias("good"),
                     merkle.fold(F.col("other"), F.col("proof")).alias("bad"))
    assert got.where("good = root and bad <> root").count() == 40


def test_odd_rows(spark):
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    df = docs(spark, odd_rows())
    hashed = df.select("*", merkle.leaf_of([F.col(c) for c in columns]).alias("h"))
    got = merkle.manifest(hashed, "h", "doc_id", "lang")
    want = [(r.doc_id, r.lang, sha("".join(value(r[c]) for c in columns))) for r in df.collect()]
    assert rows_of(got) == brute(want)
    assert merkle.manifest(hashed.where("false"), "h", "doc_id", "lang").count() == 0
    one = merkle.manifest(hashed.where("doc_id = 5"), "h", "doc_id", "lang").first()
    assert one.leaf == one.subroot == one.root and one.proof == []


def test_query_equals_oracle_and_finds_tampering(spark):
    sf = "/root/testdata/sf0.001"
    got = merkle.query(spark, sf)
    want = duck(sf).execute(merkle.ORACLE_SQL).fetchall()
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    assert {r.doc_id for r in got.where("not verified").collect()} == {
        r.doc_id for r in got.collect() if zlib.crc32(str(r.doc_id).encode()) % 7 == 0}
