"""Merkle manifest of a dataset by butterfly exchange (operator 11).

Method: the leaves of a group are numbered in order and cut into aligned blocks of
``BLOCK`` leaves, a power of the fanout. Every block hashes its own subtree. Then
blocks exchange: in round r the ``fanout`` blocks whose numbers differ in digit r
alone meet, swap the roots of their subtrees and each hashes their common ancestor,
redundantly. After a round every block knows the root of a subtree ``fanout`` times
as large and the siblings on its way up, so that after the last round all upper
proofs are in place without a pass down. A group whose number of blocks is no power
of the fanout is filled up with blank blocks, which hold no leaf, take part in the
exchange (they carry the root that their neighbours need) and go afterwards. The
groups' roots are the leaves of one more tree, built in the same way.

A hot group costs more blocks, never a larger task: numbering is by ranges, a block
has at most ``BLOCK`` leaves, and a round brings ``fanout`` short rows together.
What is exchanged is one row a block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftpool.functions.ranking import row_number_in_group
from driftpool.llm.common import cut, duck_crc32, table

QUERY_NAME = "op11_merkle_manifest"
FANOUT, BLOCK = 2, 4096
STEP = "struct<before: string, after: string>"


def leaf_of(columns: list[Column]) -> Column:
    """Hash of a row's values: each ``-`` if null, else UTF-8 byte count, ``:``, value."""
    parts = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"),
                                 c.cast("string")), F.lit("-")) for c in columns]
    return F.sha2(F.concat(*parts), 256)


def fold(start: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(proof, start, lambda h, p: F.sha2(F.concat(p.before, h, p.after), 256))


def siblings(proof: Column) -> Column:
    """All siblings of a proof, level by level, left to right, as one string."""
    return F.array_join(F.transform(proof, lambda p: F.concat(p.before, p.after)), "")


def _hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _levels(leaves: list[str], fanout: int, height: int | None) -> list[list[str]]:
    """Nodes by level: ``height`` levels above the leaves, or up to a single node."""
    levels = [leaves]
    while len(levels) <= height if height is not None else len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([_hash("".join(last[i:i + fanout])) for i in range(0, len(last), fanout)])
    return levels


def _height(fanout: int, block_rows: int) -> int:
    """Levels of a full block: the largest power of the fanout within ``block_rows``."""
    n = 1
    while fanout ** (n + 1) <= block_rows:
        n += 1
    return n


def _blocks(numbered: DataFrame, fanout: int, height: int) -> DataFrame:
    """(g, block, alone, among): each block's root if it is its group's only one
    (levels up to a single node), and if there are others (all its levels)."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("pos")
        leaves = rows["leaf"].to_pylist()
        return pa.table({
            "g": rows["g"][:1], "block": rows["block"][:1],
            "alone": pa.array([_levels(leaves, fanout, None)[-1][0]]),
            "among": pa.array([_levels(leaves, fanout, height)[-1][0]])})

    return (numbered.select("g", "block", "pos", "leaf").groupBy("g", "block")
            .applyInArrow(run, "g string, block long, alone string, among string"))


def _joined(keep: Callable[[Column], Column]) -> Column:
    """The roots of those members of ``met`` that ``keep`` selects, in order; blank
    subtrees have a null root, which joining skips."""
    return F.array_join(F.transform(F.filter("met", keep), lambda m: m.root), "")


def _swap(state: DataFrame, live: Column, step: int, fanout: int) -> DataFrame:
    """One round: the blocks whose numbers differ in the digit worth ``step`` alone
    meet, and each hashes their common ancestor. Groups that are not ``live`` have
    no such digit; their blocks stay as they are."""
    digit = F.expr(f"(block div {step}L) % {fanout}L")
    member = F.struct(digit.alias("digit"), "block", "root", "blank", "proof")
    met = state.groupBy("g", "rounds", (F.col("block") - digit * F.lit(step)).alias("first")).agg(
        F.sort_array(F.collect_list(member)).alias("met"))  # fanout rows at most
    every = _joined(lambda x: F.lit(True))
    up = F.when(every != "", F.sha2(every, 256))

    def moved(m: Column) -> Column:
        passed = F.array(F.struct(_joined(lambda x: x.digit < m.digit).alias("before"),
                                  _joined(lambda x: x.digit > m.digit).alias("after")))
        return F.struct(m.block.alias("block"), F.when(live, up).otherwise(m.root).alias("root"),
                        m.blank.alias("blank"),
                        F.when(live & ~m.blank, F.concat(m.proof, passed))
                        .otherwise(m.proof).alias("proof"))

    return met.select("g", "rounds", F.inline(F.transform("met", moved)))


def butterfly(blocks: DataFrame, fanout: int) -> DataFrame:
    """(g, block, root, proof): each block of ``blocks`` (g, block, alone, among) with
    its group's root and its proof from its own root up. Counts the blocks (a job);
    the rounds, one for each digit of the largest group's block numbers, are one plan
    with a shuffle of one row a block for each round."""
    sizes = cut(blocks.groupBy("g").agg(F.count(F.lit(1)).alias("blocks")), "merkle-sizes")
    most = sizes.agg(F.max("blocks")).first()[0] or 1
    powers = [1]
    while powers[-1] < most:
        powers.append(powers[-1] * fanout)
    rounds = sum((F.when(F.col("blocks") > n, 1).otherwise(0) for n in powers), F.lit(0))
    sizes = sizes.withColumn("rounds", rounds).withColumn(
        "room", F.element_at(F.array(*[F.lit(n).cast("long") for n in powers]), F.col("rounds") + 1))
    own = blocks.join(sizes, "g").select(
        "g", "rounds", "block", F.when(F.col("blocks") == 1, F.col("alone"))
        .otherwise(F.col("among")).alias("root"), F.lit(False).alias("blank"))
    blank = (sizes.where("blocks < room")
             .select("g", "rounds", F.explode(F.expr("sequence(blocks, room - 1)")).alias("block"))
             .select("g", "rounds", "block", F.lit(None).cast("string").alias("root"),
                     F.lit(True).alias("blank")))
    state = own.union(blank).withColumn("proof", F.expr(f"cast(array() as array<{STEP}>)"))
    for r, step in enumerate(powers[:-1]):
        state = _swap(state, F.col("rounds") > r, step, fanout)
    return state.where("not blank").select("g", "block", "root", "proof")


def _trees(rows: DataFrame, order: list[str], fanout: int, block_rows: int) -> tuple[DataFrame, DataFrame]:
    """Numbered ``rows`` (g, leaf and others; written) and their blocks' state after
    the exchange (written). Runs jobs."""
    height = _height(fanout, block_rows)
    place = row_number_in_group(rows, ["g"], order, rank_col="pos").withColumn(
        "pos", F.col("pos") - 1)
    numbered = cut(place.withColumn("block", F.expr(f"pos div {fanout ** height}L")), "merkle-leaves")
    blocks = cut(_blocks(numbered, fanout, height), "merkle-blocks")
    return numbered, cut(butterfly(blocks, fanout), "merkle-upper")


def _proofs(numbered: DataFrame, upper: DataFrame, keep: list[str], fanout: int,
            block_rows: int) -> DataFrame:
    """``keep``, leaf, top (columns of ``upper`` beside g, block and proof) and proof:
    each leaf's siblings within its block, then its block's."""
    height = _height(fanout, block_rows)
    top = [f.name for f in upper.schema.fields if f.name not in ("g", "block", "proof", "blocks")]
    kinds = ([numbered.schema[c] for c in [*keep, "leaf"]] + [upper.schema[c] for c in top])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kinds)

    def run(rows: pa.Table, above: pa.Table) -> pa.Table:
        rows = rows.sort_by("pos").combine_chunks()
        leaves, n = rows["leaf"].to_pylist(), rows.num_rows
        one = above["blocks"][0].as_py() == 1
        levels = _levels(leaves, fanout, None if one else height)[:-1]
        rest = above["proof"][0].as_py()
        before, after = [], []
        for i in range(n):
            for nodes in levels:
                run_at = i - i % fanout
                before.append("".join(nodes[run_at:i]))
                after.append("".join(nodes[i + 1:run_at + fanout]))
                i //= fanout
            before += [p["before"] for p in rest]
            after += [p["after"] for p in rest]
        size = len(levels) + len(rest)
        proof = pa.ListArray.from_arrays(
            pa.array(range(0, n * size + 1, size) if size else [0] * (n + 1), pa.int32()),
            pa.StructArray.from_arrays([pa.array(before, pa.string()), pa.array(after, pa.string())],
                                       ["before", "after"]))
        return pa.table({**{c: rows[c] for c in [*keep, "leaf"]},
                         **{c: pa.array([above[c][0].as_py()] * n, pa.string()) for c in top},
                         "proof": proof})

    total = upper.groupBy("g").agg(F.count(F.lit(1)).alias("blocks"))
    return (numbered.groupBy("g", "block").cogroup(upper.join(total, "g").groupBy("g", "block"))
            .applyInArrow(run, f"{schema}, proof array<{STEP}>"))


def manifest(df: DataFrame, leaf_col: str, id_col: str, group_col: str, keep: list[str] | None = None,
             fanout: int = FANOUT, block_rows: int = BLOCK) -> DataFrame:
    """One row per row of ``df``: ``id_col``, the columns ``keep``, leaf (the hex hash
    in ``leaf_col``), subroot (of the row's group), root (of all groups) and proof, an
    array of (before, after): the siblings, joined, on either side of the leaf's
    ancestor at each level, from the leaf up to the root.

    Within a group leaves stand in order of the id (null first), rows of one id in
    order of the leaf; repeated rows are leaves of their own, interchangeable ones. A
    null group is a group, the first; groups stand in order of their name's UTF-8
    bytes. ``fanout`` consecutive nodes make a node, the last run of a level may be
    shorter, even one; a lone leaf is its group's root, a lone group's root is the
    root. Other columns are ignored; an empty table gives no rows. Runs jobs."""
    name = F.col(f"`{group_col}`").cast("string")
    own = [f"k{i}" for i in range(len(keep or []))]
    rows = df.select(
        F.coalesce(F.concat(F.lit("+"), name), F.lit("")).alias("g"),
        F.col(f"`{id_col}`").alias("id"), F.col(f"`{leaf_col}`").alias("leaf"),
        *[F.col(f"`{c}`").alias(k) for c, k in zip(keep or [], own)])
    numbered, upper = _trees(rows, ["id", "leaf"], fanout, block_rows)
    # the groups' roots are the leaves of the last tree: one row a group
    groups = upper.where("block = 0").select(F.lit("").alias("g"), F.col("g").alias("id"),
                                             F.col("root").alias("leaf"))
    last = _proofs(*_trees(groups, ["id"], fanout, block_rows), ["id"], fanout, block_rows)
    last = cut(last.select(F.col("id").alias("g"), F.col("root").alias("all"),
                           F.col("proof").alias("rest")), "merkle-groups")
    upper = upper.join(last, "g").select("g", "block", F.col("root").alias("subroot"),
                                         F.col("all").alias("root"),
                                         F.concat("proof", "rest").alias("proof"))
    out = _proofs(numbered, upper, ["id", *own], fanout, block_rows)
    return out.select(F.col("id").alias(id_col),
                      *[F.col(k).alias(c) for c, k in zip(keep or [], own)],
                      "leaf", "subroot", "root", "proof")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of all documents; where 7 divides the id's crc32, n_chars is
    tampered with before the leaf is folded up its proof again."""
    docs = table(spark, sf_dir, "documents")
    row = lambda n: leaf_of([F.col("doc_id"), F.col("source"), F.col("lang"), n, F.col("text")])
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    rows = docs.select("doc_id", "lang", row(F.col("n_chars")).alias("leaf"),
                       F.when(hit, row(F.try_add("n_chars", F.lit(1)))).alias("tampered"))
    out = manifest(rows, "leaf", "doc_id", "lang", ["tampered"])
    out = out.select("doc_id", "leaf", "subroot", "root",
                     F.sha2(siblings(F.col("proof")), 256).alias("proof_sha256"),
                     fold(F.coalesce("tampered", "leaf"), F.col("proof")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _oracle() -> str:
    part = lambda c: (f"coalesce(CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || "  # noqa: E731
                      f"CAST({c} AS VARCHAR), '-')")
    leaf = lambda n: "sha256(" + " || ".join(
        part(c) for c in ("doc_id", "source", "lang", n, "text")) + ")"
    up = lambda key, nodes: f"""
  SELECT {key} lvl + 1, idx // {FANOUT}, sha256(string_agg(h, '' ORDER BY idx)),
         (any_value(n) + {FANOUT - 1}) // {FANOUT}
  FROM {nodes} WHERE n > 1 GROUP BY {key} lvl, idx // {FANOUT}"""  # noqa: E731
    return rf"""
WITH RECURSIVE d AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos
  FROM (SELECT doc_id, lang, {leaf('n_chars')} AS leaf,
               CASE WHEN {duck_crc32('CAST(doc_id AS VARCHAR)')} % 7 = 0
                    THEN {leaf('(n_chars + 1)')} END AS tampered FROM documents)),
node(lang, lvl, idx, h, n) AS (
  SELECT lang, 0, pos, leaf, count(*) OVER (PARTITION BY lang) FROM d
  UNION ALL{up('lang,', 'node')}),
sub AS (SELECT lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS idx FROM node WHERE n = 1),
top(lvl, idx, h, n) AS (
  SELECT 0, idx, h, count(*) OVER () FROM sub
  UNION ALL{up('', 'top')}),
step AS (
  SELECT d.lang, d.pos, s.lvl, 0 AS tree,
         CASE WHEN s.idx < d.pos >> s.lvl THEN 'b' ELSE 'a' END || s.h AS sib
  FROM d JOIN node s ON d.lang IS NOT DISTINCT FROM s.lang AND s.n > 1
       AND s.idx = xor(d.pos >> s.lvl, 1)
  UNION ALL
  SELECT d.lang, d.pos, s.lvl, 1, CASE WHEN s.idx < g.idx >> s.lvl THEN 'b' ELSE 'a' END || s.h
  FROM d JOIN sub g ON d.lang IS NOT DISTINCT FROM g.lang
       JOIN top s ON s.n > 1 AND s.idx = xor(g.idx >> s.lvl, 1)),
-- a level without a sibling still hashes the node on its own
level AS (
  SELECT DISTINCT lang, lvl, 0 AS tree FROM node WHERE n > 1
  UNION ALL SELECT lang, lvl, 1 FROM sub, (SELECT DISTINCT lvl FROM top WHERE n > 1)),
way AS (
  SELECT d.lang, d.pos, list(coalesce(sib, 'a') ORDER BY l.tree, l.lvl) AS sibs
  FROM d JOIN level l ON d.lang IS NOT DISTINCT FROM l.lang
       LEFT JOIN step s ON s.lang IS NOT DISTINCT FROM d.lang AND s.pos = d.pos
            AND s.lvl = l.lvl AND s.tree = l.tree
  GROUP BY d.lang, d.pos),
r AS (
  SELECT d.doc_id, d.leaf, g.h AS subroot, (SELECT h FROM top WHERE n = 1) AS root,
         sha256(list_aggregate(list_transform(coalesce(sibs, []), lambda x: x[2:]), 'string_agg', ''))
           AS proof_sha256,
         list_reduce(list_prepend(coalesce(tampered, leaf), coalesce(sibs, [])),
                     lambda h, x: sha256(CASE WHEN x[1] = 'b' THEN x[2:] || h ELSE h || x[2:] END))
           AS folded_root
  FROM d JOIN sub g ON d.lang IS NOT DISTINCT FROM g.lang
       LEFT JOIN way w ON w.lang IS NOT DISTINCT FROM d.lang AND w.pos = d.pos)
SELECT *, folded_root = root AS verified FROM r"""


ORACLE_SQL = _oracle()
