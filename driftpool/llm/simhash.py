"""Near-duplicates by SimHash fingerprints (operator 6).

Method: a 64-bit fingerprint is mapped to the bit counts of its 32 two-bit
segments. A differing bit moves one count by one, so the Manhattan distance of
two such vectors never exceeds the Hamming distance. Fingerprints at most two
bits apart therefore have a lattice point within distance one of both vectors:
every distinct fingerprint is put into the (at most 65) grid cells within
distance one of its vector, and only cells holding two or more fingerprints go
on. There the distance is verified exactly, and without pairs: fingerprints at
most two bits apart are those that share a 64-bit word within one bit of both.
Each candidate names those words that lie in the shared cell (itself in its own
cell, at most two flips in a cell beside it), and links to the smallest
fingerprint that names the same word. A group of n near copies costs at most 65 n
words, never n squared. Narrow segments keep chance apart: wider ones have few
distinct counts, and unrelated fingerprints then meet with the square of their
number.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from driftpool.llm.common import add_columns, cut, table, text_bytes
from driftpool.llm.components import components

QUERY_NAME = "op6_simhash_near_dedup"
ORACLE_SQL = None  # SQL has no XXH64; tests hold it against brute force
SEED, SEGMENT_BITS, MAX_BITS = 42, 2, 2
LOW = 0x5555555555555555  # the lower bit of every segment
CHUNK = 1 << 16  # shingles hashed at once: bounds memory on very long texts


def fingerprint(text: bytes | None, shingle: int) -> int:
    """Signed 64-bit SimHash of the word shingles of ``text`` (A-Z lower-cased);
    0 for a text without words, or null."""
    import xxhash

    words = (text or b"").lower().split()
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_digest
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    starts = (ends - size).tolist()
    last = ends[min(shingle, len(words)) - 1:].tolist()
    ones = np.zeros(2048, np.int64)
    place = np.arange(0, 2048, 256, dtype=np.int64)
    for at in range(0, len(last), CHUNK):
        part = b"".join([digest(joined[a:b], SEED)
                         for a, b in zip(starts[at:at + CHUNK], last[at:at + CHUNK])])
        got = np.frombuffer(part, np.uint8).reshape(-1, 8) + place
        ones += np.bincount(got.ravel(), minlength=2048)
    bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
    set_bits = (ones.reshape(8, 256) @ bits) * 2 > len(last)
    return int.from_bytes(np.packbits(set_bits).tobytes(), "big", signed=True)


def fingerprints(df: DataFrame, text_col: str = "text", shingle: int = 3,
                 keep: list[str] | None = None) -> DataFrame:
    """``df`` (or its columns ``keep``) with its fingerprint as long column ``fp``."""

    def make():
        return lambda texts: [pa.array([fingerprint(t, shingle) for t in text_bytes(texts)],
                                       pa.int64())]

    return add_columns(df, text_col, [T.StructField("fp", T.LongType())], make, keep)


def _cell(fp):
    """Bit counts (0 to 2) of the 32 segments, two bits each, packed in a long."""
    lower = fp.bitwiseAND(F.lit(LOW))
    upper = F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(LOW))
    return lower.bitwiseXOR(upper).bitwiseOR(F.shiftleft(lower.bitwiseAND(upper), 1))


def _words(fp, cell):
    """The words within one bit of ``fp`` that lie in ``cell``, a cell within
    distance one of its own: itself, or the flips of the segment that differs."""
    moved = _cell(fp).bitwiseXOR(cell)
    bit = moved.bitwiseOR(F.shiftrightunsigned(moved, 1)).bitwiseAND(F.lit(LOW))
    flips = F.array(fp.bitwiseXOR(bit), fp.bitwiseXOR(F.shiftleft(bit, 1)))
    return F.when(moved == 0, F.array(fp)).otherwise(F.filter(flips, lambda w: _cell(w) == cell))


def links(fps: DataFrame) -> DataFrame:
    """Edges (u, v) between distinct fingerprints (column fp) at most two bits
    apart; two fingerprints that close are joined by at most one fingerprint
    between them."""
    own = F.col("cell")
    near = [own]
    for s in range(0, 64, SEGMENT_BITS):
        count = F.shiftrightunsigned(own, s).bitwiseAND(F.lit(3))
        rest = own.bitwiseAND(F.lit(~(3 << s) if s < 62 else (1 << 62) - 1))
        for step in (-1, 1):
            moved = count + F.lit(step)
            near.append(F.when(moved.between(0, SEGMENT_BITS),
                               rest.bitwiseOR(F.shiftleft(moved, s))))
    grid = (fps.select("fp", _cell(F.col("fp")).alias("cell"))
            .select("fp", F.explode(F.array(*near)).alias("cell")).where("cell is not null"))
    shared = (grid.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("cell")))
              .where("n > 1").select("fp", "cell"))
    words = shared.select("fp", F.explode(_words(F.col("fp"), F.col("cell"))).alias("word"))
    first = F.min("fp").over(Window.partitionBy("word"))
    return (words.withColumn("v", first).where("fp <> v")
            .select(F.col("fp").alias("u"), "v").distinct())


def roots(fps: DataFrame) -> DataFrame:
    """(fp, root) for all distinct fingerprints; root names the component."""
    comp = components(links(fps)).select(F.col("node").alias("fp"), "root")
    return fps.join(comp, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    shingle: int = 3) -> DataFrame:
    """One row per row of ``df``: ``id_col``, fingerprint (16 hex digits) and
    component_id, the smallest id that can be reached over links of at most two
    differing bits, the row's own included.

    Null and empty texts have fingerprint zero, linked like any other. Texts of
    fewer words than a shingle are one shingle. Repeated rows stay repeated; a row
    with a null id keeps it, never names a component, and has a null
    component_id if all its component's ids are null. An empty table gives none.
    Other columns are ignored. Runs jobs; fingerprints are written once."""
    docs = cut(fingerprints(df.select(F.col(f"`{id_col}`").alias("id"),
                                      F.col(f"`{text_col}`").alias("text")),
                            "text", shingle, ["id"]), "fingerprints")
    classes = cut(docs.groupBy("fp").agg(F.min("id").alias("low")), "classes")
    named = cut(roots(classes.select("fp")), "roots")
    lows = (named.join(classes, "fp").groupBy("root").agg(F.min("low").alias("component_id")))
    # written, so that adaptive execution may split a hot fingerprint's rows
    by_fp = cut(named.join(lows, "root").select("fp", "component_id"), "component-of")
    return docs.join(by_fp, "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             shingle: int = 3) -> DataFrame:
    """The rows of ``df`` less near-duplicates: of each component the row with the
    smallest id stays (null ids last; among rows of one id the text with the
    smallest hash; of rows repeated with id and text, one). Columns unchanged."""
    # the row's key is its id and a hash of its text: ids may repeat or be null
    tag = F.xxhash64(F.col(f"`{text_col}`"))
    keyed = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"),
                      tag.alias("tag"))
    docs = cut(fingerprints(keyed, "text", shingle, ["id", "tag"]), "fingerprints")
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "tag"))
    classes = cut(docs.groupBy("fp").agg(first.alias("low")), "classes")
    named = roots(classes.select("fp")).join(classes, "fp")
    stay = (named.groupBy("root").agg(F.min("low").alias("low"))
            .select(F.col("low.id").alias("__id"), F.col("low.tag").alias("__tag")))
    rows = df.withColumn("__own", tag)
    kept = rows.join(cut(stay, "kept"), rows[f"`{id_col}`"].eqNullSafe(F.col("__id"))
                     & (F.col("__own") == F.col("__tag")), "left_semi")
    # only rows repeated with id and text meet again to leave one of each
    again = cut(docs.groupBy("id", "tag").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
                .select(F.col("id").alias("__id"), F.col("tag").alias("__tag")), "repeated-rows")
    if again.count():
        same = kept[f"`{id_col}`"].eqNullSafe(F.col("__id")) & (kept["__own"] == F.col("__tag"))
        kept = (kept.join(again, same, "left_anti")
                .union(kept.join(again, same, "left_semi").dropDuplicates([id_col, "__own"])))
    return kept.drop("__own")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
