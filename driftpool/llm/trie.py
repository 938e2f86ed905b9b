"""Conversation prefix trie by splitter and skeleton (operator 13).

Method: a conversation is a path, one 16-byte digest for each of its turns. Splitters
taken from a sample of the paths cut their order into ranges, and the trie of the
splitters' paths, the skeleton, is broadcast. A node can reach into two ranges only
if it lies on a splitter's path. Every range is sorted and walked by itself: the shard
finishes all nodes off the skeleton, whose members it holds to the last, and gives for
each skeleton node it touches one partial aggregate. The partial aggregates are
reduced by node, and sums over subtrees then follow from running sums in the
skeleton's preorder, where a subtree is a range of numbers.

A splitter is a path and a conversation id, so that a path which a third of all
conversations share is cut as well. A splitter is only as long as it must be to
stand apart from its neighbour in the sample. Texts never leave the scan: digests and
code-point counts do. What a broadcast holds is bounded by the number of splitters
(``MAX_SHARDS``) and their length.

The ids that end at a skeleton node are gathered as text pieces of at most ``PIECE``
ids; sorted pieces stream through the hash, so that no node's ids are ever in memory
at once, however many end there.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from driftpool.llm.common import Shared, cut, drawn, duck_crc32, table

QUERY_NAME = "op13_conversation_trie"
#: turns a shard should have, bound of the shards, and sampled paths for each of them
SHARD_TURNS, MAX_SHARDS, SAMPLED = 8192, 100_000, 32
PIECE = 4096
DIGEST = 16
#: the query's conversations start as the first one of their hundred, for fewer turns than HEAD
FAMILY, HEAD = 100, 6
EMPTY = hashlib.sha256(b"").hexdigest()
LEAST = -(1 << 63)

FOUND = T.StructType([
    # of a finished node; its parent is known by conv_id, or by number if on the skeleton
    T.StructField("kind", T.StringType()), T.StructField("node", T.LongType()),
    T.StructField("conv_id", T.LongType()), T.StructField("depth", T.LongType()),
    T.StructField("parent_conv_id", T.LongType()), T.StructField("n_convs", T.LongType()),
    T.StructField("n_children", T.LongType()), T.StructField("n_leaves", T.LongType()),
    T.StructField("saved_tokens", T.LongType()), T.StructField("size", T.LongType()),
    T.StructField("ends", T.StringType())])


def paths(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
          text_col: str = "text") -> DataFrame:
    """(conv, path, sizes): each conversation's turns as digests in one binary value,
    and the code points of their texts. One shuffle of some 60 bytes a turn; a
    conversation's turns are one row."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    role = F.coalesce(F.col(f"`{role_col}`").cast("string"), F.lit(""))
    digest = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))
    turn = F.struct(F.col(f"`{turn_col}`").alias("turn"), role.alias("role"), digest.alias("digest"),
                    F.length(text).cast("long").alias("size"))
    return (df.where(F.col(f"`{conv_col}`").isNotNull())
            .groupBy(F.col(f"`{conv_col}`").cast("long").alias("conv"))
            .agg(F.sort_array(F.collect_list(turn)).alias("turns"))
            .select("conv", F.unhex(F.array_join("turns.digest", "")).alias("path"),
                    F.col("turns.size").alias("sizes")))


def with_heads(convs: DataFrame, source: Column, n: Column) -> DataFrame:
    """``convs`` (conv, path, sizes), whose first ``n`` turns (``HEAD`` at most) are
    replaced by those of the conversation ``source``: all of them if it has fewer,
    none if there is no such conversation. A source serves any number of others."""
    rows = convs.withColumn("source", source).withColumn("n", n)
    first = convs.join(rows.select(F.col("source").alias("conv")).distinct(), "conv", "left_semi").select(
        F.col("conv").alias("source"), F.expr(f"substring(path, 1, {DIGEST * HEAD})").alias("head"),
        F.slice("sizes", 1, HEAD).alias("head_sizes"))
    path = f"concat(coalesce(substring(head, 1, {DIGEST} * n), X''), substring(path, {DIGEST} * n + 1))"
    sizes = ("concat(coalesce(slice(head_sizes, 1, n), cast(array() as array<long>)), "
             "slice(sizes, n + 1, greatest(size(sizes) - n, 0)))")
    return rows.join(first, "source", "left").select(
        "conv", F.expr(path).alias("path"), F.expr(sizes).alias("sizes"))


@dataclass
class Skeleton:
    """Splitters in order, and the trie of their paths: nodes numbered in preorder from
    the root 0, with parent, depth and the last number in the subtree."""

    splitters: list[tuple[bytes, int]]
    children: list[dict[bytes, int]]
    rows: list[tuple[int, int | None, int, int]]

    @classmethod
    def build(cls, sample: list[tuple[bytes, int]], shards: int) -> Skeleton:
        """Splitters that cut the sorted sample into even parts, each as short as
        it may be to stay above the sampled path before it."""
        sample = sorted(sample)
        splitters = []
        for i in sorted({len(sample) * k // shards for k in range(1, shards)}):
            if not 0 < i < len(sample):
                continue
            (before, _), (path, conv) = sample[i - 1], sample[i]
            n = 0
            while path[n:n + DIGEST] == before[n:n + DIGEST] and n < len(path):
                n += DIGEST
            splitters.append((path, conv) if path == before else (path[:n + DIGEST], LEAST))
        splitters = sorted(set(splitters))
        children, rows, open_, last = [{}], [[0, None, 0, 0]], [0], b""
        for path, _ in splitters:  # in order, so that numbers are in preorder
            n = 0
            while path[n:n + DIGEST] == last[n:n + DIGEST] and n < min(len(path), len(last)):
                n += DIGEST
            del open_[n // DIGEST + 1:]
            for at in range(n, len(path), DIGEST):
                node, parent = len(children), open_[-1]
                children[parent][path[at:at + DIGEST]] = node
                children.append({})
                rows.append([node, parent, len(open_), node])
                open_.append(node)
            last = path
        for node, parent, _, end in reversed(rows[1:]):
            rows[parent][3] = max(rows[parent][3], end)
        return cls(splitters, children, [tuple(r) for r in rows])


class Node:
    """An open node of a shard's walk."""

    __slots__ = ("number", "depth", "size", "conv", "n", "children", "leaves", "saved", "ends", "done")

    def __init__(self, number: int | None, depth: int, size: int):
        self.number, self.depth, self.size = number, depth, size
        self.conv, self.n, self.children, self.leaves, self.saved = None, 0, 0, 0, 0
        self.ends: list[int] = []  # of members with no further turn, ascending
        self.done: list[tuple] = []  # finished children, which wait for this node's conv_id


def walk(rows: list[tuple[bytes, int, list[int]]], skeleton: Skeleton) -> list[tuple]:
    """Rows of FOUND from one shard's sorted (path, conv, sizes): finished nodes
    (kind 'node'; under a skeleton node ``node`` is the parent's number),
    partial aggregates of skeleton nodes ('part') and pieces of their ends ('ends')."""
    out: list[tuple] = []
    stack, last = [Node(0, 0, 0)], b""

    def close(upto: int) -> None:
        while len(stack) > upto:
            x = stack.pop()
            for conv, *rest in x.done:
                out.append(("node", None, conv, x.depth + 1, x.conv, *rest))
            up = stack[-1] if stack else None
            if x.number is not None:
                out.append(("part", x.number, x.conv, x.depth, None, x.n, x.children, x.leaves,
                            x.saved, x.size, None))
                for at in range(0, len(x.ends), PIECE):
                    part = x.ends[at:at + PIECE]
                    out.append(("ends", x.number, part[0], *[None] * 7, ",".join(map(str, part))))
            else:
                leaves = x.leaves or 1
                saved = x.saved + (x.n - 1) * x.size
                ends = hashlib.sha256(",".join(map(str, x.ends)).encode()).hexdigest()
                row = (x.conv, x.n, x.children, leaves, saved, None, ends)
                if up.number is None:
                    up.done.append(row)
                else:
                    out.append(("node", up.number, x.conv, x.depth, None, *row[1:]))
                up.children += 1
                up.leaves += leaves
                up.saved += saved
            if up is not None:  # a skeleton child's members are this node's too
                up.n += x.n
                up.conv = x.conv if up.conv is None else min(up.conv, x.conv)

    for path, conv, sizes in rows:
        n = 0
        while path[n:n + DIGEST] == last[n:n + DIGEST] and n < min(len(path), len(last)):
            n += DIGEST
        close(n // DIGEST + 1)
        for at in range(n, len(path), DIGEST):
            up = stack[-1]
            number = None if up.number is None else skeleton.children[up.number].get(path[at:at + DIGEST])
            stack.append(Node(number, len(stack), sizes[at // DIGEST]))
        x = stack[-1]
        x.n += 1
        x.conv = conv if x.conv is None else min(x.conv, conv)
        x.ends.append(conv)
        last = path
    if rows:
        close(0)
    return out


def _hash_pieces(batches):
    """(node, ends) of sorted (node, first, piece) rows: one running hash."""
    node, run = None, None
    for b in batches:
        nodes, out = [], []
        for k, piece in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
            if k != node:
                if node is not None:
                    nodes.append(node), out.append(run.hexdigest())
                node, run = k, hashlib.sha256(piece.encode())
            else:
                run.update(b"," + piece.encode())
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(out, pa.string())],
                                         names=["node", "ends"])
    if node is not None:
        yield pa.RecordBatch.from_arrays([pa.array([node], pa.int64()), pa.array([run.hexdigest()])],
                                         names=["node", "ends"])


def trie(convs: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """One row for each distinct sequence of first turns of ``convs`` (conv, path,
    sizes; conv unique), the empty one included: conv_id (the smallest member),
    depth, parent_conv_id (null at the root), n_convs, n_children, n_leaves,
    saved_tokens (over the subtree, members less one times the last text's code
    points) and ends_sha256 (of the ids that end there). No conversations: no rows.
    Runs jobs; the sample and the skeleton pass the driver, both bounded by
    ``MAX_SHARDS`` and the paths' length."""
    spark = convs.sparkSession
    convs = cut(convs, "trie-paths")
    n, turns = convs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("sizes")), F.lit(0))).first()
    shards = max(1, min(MAX_SHARDS, n, turns // shard_turns))
    few = convs.select("path", "conv").where(drawn("conv") * n < SAMPLED * shards) if shards > 1 else None
    sample = few.toArrow() if few is not None else None
    skeleton = Skeleton.build([] if sample is None else list(
        zip(sample["path"].to_pylist(), sample["conv"].to_pylist())), shards)
    shared = Shared(spark, skeleton)

    def deal(batches):
        cuts = shared.value.splitters
        for b in batches:
            to = [bisect_right(cuts, x) for x in zip(b.column(1).to_pylist(), b.column(0).to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(to, pa.int32())],
                                             names=["conv", "path", "sizes", "shard"])

    def finish(rows: pa.Table) -> pa.Table:
        found = walk(sorted(zip(rows["path"].to_pylist(), rows["conv"].to_pylist(),
                                rows["sizes"].to_pylist())), shared.value)
        return pa.table({f.name: pa.array(c, pa.string() if f.dataType == T.StringType() else pa.int64())
                         for f, c in zip(FOUND.fields, zip(*found))})

    dealt = convs.select("conv", "path", "sizes").mapInArrow(
        deal, T.StructType([*convs.select("conv", "path", "sizes").schema.fields,
                            T.StructField("shard", T.IntegerType())]))
    found = cut(dealt.groupBy("shard").applyInArrow(finish, FOUND), "trie-shards")

    frame = spark.createDataFrame(skeleton.rows, "node long, up long, depth long, last long")
    parts = found.where("kind = 'part'").groupBy("node").agg(
        F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"),
        F.sum("n_children").alias("n_children"), F.sum("n_leaves").alias("n_leaves"),
        F.sum("saved_tokens").alias("saved_tokens"), F.max("size").alias("size"))
    inner = frame.groupBy(F.col("up").alias("node")).agg(F.count(F.lit(1)).alias("more"))
    own = frame.join(parts, "node").join(inner, "node", "left").withColumn(
        "n_children", F.col("n_children") + F.coalesce("more", F.lit(0)))
    leaf = F.when(F.col("n_children") == 0, 1).otherwise(0)
    saved = F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("size")
    # the skeleton alone is numbered in one window: splitters times their length
    upto = Window.orderBy("node")
    own = (own.withColumn("leaves", F.col("n_leaves") + leaf).withColumn("saved", saved)
           .withColumn("leaves_to", F.sum("leaves").over(upto))
           .withColumn("saved_to", F.sum("saved").over(upto)))
    own = cut(own, "trie-skeleton")
    ends = own.select(F.col("node").alias("last"), F.col("leaves_to").alias("leaves_end"),
                      F.col("saved_to").alias("saved_end"))
    above = own.select(F.col("node").alias("up"), F.col("conv_id").alias("parent_conv_id"))
    pieces = (found.where("kind = 'ends'").select("node", F.col("conv_id").alias("first"), "ends")
              .repartition("node").sortWithinPartitions("node", "first"))
    hashed = pieces.mapInArrow(_hash_pieces, "node long, ends string")
    skeletal = (own.join(ends, "last").join(above, "up", "left").join(hashed, "node", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children",
        (F.col("leaves_end") - F.col("leaves_to") + F.col("leaves")).alias("n_leaves"),
        (F.col("saved_end") - F.col("saved_to") + F.col("saved")).alias("saved_tokens"),
        F.coalesce("ends", F.lit(EMPTY)).alias("ends_sha256")))
    local = found.where("kind = 'node'").join(
        above.withColumnRenamed("parent_conv_id", "above"), F.col("node") == F.col("up"), "left").select(
        "conv_id", "depth", F.coalesce("parent_conv_id", "above").alias("parent_conv_id"), "n_convs",
        "n_children", "n_leaves", "saved_tokens", F.col("ends").alias("ends_sha256"))
    return skeletal.union(local)


def prefix_trie(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                text_col: str = "text", shard_turns: int = SHARD_TURNS) -> DataFrame:
    """The trie (see ``trie``) of the conversations of ``df``.

    Turns stand in order of ``turn_col`` (nulls first; ties by role, then the md5 of
    role and text); repeated rows are turns of their own. Null roles and texts are
    empty; rows with a null conversation id take no part. Other columns are ignored;
    an empty table gives none. A conversation's digests are one row, its texts are
    not. Runs jobs."""
    return trie(paths(df, conv_col, turn_col, role_col, text_col), shard_turns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations, each of which starts as the first of its
    hundred does for its id's crc32 modulo 6 turns."""
    own = cut(paths(table(spark, sf_dir, "conversations")), "trie-own")
    crc = F.crc32(F.col("conv").cast("string").cast("binary"))
    return trie(with_heads(own, F.col("conv") - F.col("conv") % FAMILY, (crc % HEAD).cast("int")))


ORACLE_SQL = rf"""
WITH own AS (
  SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY turn NULLS FIRST, role,
         md5(strlen(role) || ':' || role || text)) AS turns
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
        FROM conversations WHERE conv_id IS NOT NULL) GROUP BY conv_id),
c AS (
  SELECT o.conv_id, list_concat(coalesce(b.turns[1:o.h], []), o.turns[o.h + 1:]) AS turns
  FROM (SELECT *, {duck_crc32('CAST(conv_id AS VARCHAR)')} % {HEAD} AS h FROM own) o
  LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % {FAMILY}),
p AS (SELECT conv_id, turns[1:d] AS path, d, d = len(turns) AS ending
      FROM (SELECT *, unnest(range(len(turns) + 1)) AS d FROM c)),
n AS (
  SELECT path, any_value(d) AS d, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)
                         FILTER (ending), '')) AS ends_sha256
  FROM p GROUP BY path),
k AS (SELECT u.path, count(*) AS n_children FROM n JOIN n u ON n.d = u.d + 1 AND n.path[1:u.d] = u.path
      GROUP BY u.path),
m AS (SELECT n.*, coalesce(n_children, 0) AS n_children,
             CASE WHEN d = 0 THEN 0 ELSE (n_convs - 1) * length(n.path[d].text) END AS saved
      FROM n LEFT JOIN k ON n.path = k.path),
s AS (SELECT path, sum(saved) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves
      FROM (SELECT path[1:unnest(range(d + 1))] AS path, saved, n_children FROM m) GROUP BY path)
SELECT m.conv_id, CAST(m.d AS BIGINT) AS depth, u.conv_id AS parent_conv_id, m.n_convs,
       CAST(m.n_children AS BIGINT) AS n_children, s.n_leaves,
       CAST(s.saved_tokens AS BIGINT) AS saved_tokens, m.ends_sha256
FROM m JOIN s ON m.path = s.path LEFT JOIN n u ON m.d = u.d + 1 AND u.path = m.path[1:u.d]"""
