"""Approximate nearest neighbours from balanced posting lists (operator 1).

Method: a bounded sample is halved again and again at the median of its spread,
which gives clusters of equal size; after a few rounds of means their centres are
the heads of posting lists. Every vector joins the list of its nearest centre and,
near a boundary, up to ``REPLICAS`` lists whose centres are within ``BOUNDARY`` of
that distance. A query searches the centres along an in-memory graph of
neighbours, best first, and reads the lists whose centre's distance is within
``PRUNE`` of the mean of the ``BASE`` nearest ones' (the nearest one alone may be
the query's own, and close by chance); the vectors of those lists are compared
exactly. How far the lists of a query's neighbours lie from it depends on the vectors,
so ``PRUNE`` is a least ratio: a bounded sample of the queries is compared with every
vector, and the ratio is widened until the lists read hold ``WANTED_RECALL`` of what
that finds (levels of split lists likewise).

The top centres (at most ``MAX_CENTRES``) and their graph are broadcast. A list of more
than ``SPLIT_ROWS`` vectors is split in the same way, by centres of its own, which stay
in a table, and its parts again, until none is longer: lists stay short however many
vectors there are. Of equal vectors the k + 1 smallest ids are indexed, as no
answer can hold another one. What is left long is read in shards by a hash of the id,
and a list's queries come in blocks.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from driftpool.functions.ranking import top_k_per_group
from driftpool.llm.common import Shared, cut, drawn, table

QUERY_NAME = "op1_nearest_neighbours"
ORACLE_SQL = None  # approximate; tests hold recall and distances against brute force
#: vectors a list should have, bound of the lists, and of the sample that places them
LIST, MAX_CENTRES, FIT_ROWS = 100, 4096, 50_000
REPLICAS, BOUNDARY, PRUNE, BASE = 4, 0.10, 0.085, 8
#: graph neighbours of a centre; nodes a search looks at beyond the pruning ratio
LINKS, SLACK = 24, 0.04
SHARD_ROWS, BLOCK = 20_000, 1 << 20
ROUNDS = 5
#: vectors above which a list is split, parts it is split into at most, lists of a vector
#: within it, sampled vectors a part, and queries that are compared with a list at once
SPLIT_ROWS, SPLIT_PARTS, SPLIT_REPLICAS, SPLIT_SAMPLE, QUERY_BLOCK = 2000, 256, 2, 16, 2000
MAX_LEVELS = 8
#: queries that are also compared with every vector; the share of what that finds that the
#: lists read must hold, and of that the parts read at each level of split lists; the step
#: by which the pruning ratio is widened until they do
CHECKED, WANTED_RECALL, SPLIT_RECALL, WIDEN = 256, 0.93, 0.99, 1.3


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T)
    return np.sqrt(np.maximum(square, 0.0))


def place_centres(sample: np.ndarray, lists: int) -> np.ndarray:
    """Centres of clusters of equal size, then a few rounds of means."""
    groups = [np.arange(len(sample))]
    while len(groups) < lists and len(groups[0]) > 1:
        groups.sort(key=len, reverse=True)
        own = groups[0]
        x = sample[own] - sample[own].mean(0)
        axis = x[int(np.argmax((x * x).sum(1)))]
        for _ in range(4):  # towards the direction of the widest spread
            axis = x.T @ (x @ axis)
            axis = axis / max(np.linalg.norm(axis), 1e-300)
        order = np.argsort(x @ axis, kind="stable")
        groups[:1] = [own[order[:len(own) // 2]], own[order[len(own) // 2:]]]
    centres = np.stack([sample[g].mean(0) for g in groups])
    for _ in range(ROUNDS):
        near = np.concatenate([_distances(sample[i:i + 4096], centres).argmin(1)
                               for i in range(0, len(sample), 4096)])
        size = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        centres = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], centres)
    return np.unique(centres, axis=0)


@dataclass
class Heads:
    """Centres of the lists and the graph of their neighbours."""

    centres: np.ndarray
    links: np.ndarray

    @classmethod
    def build(cls, centres: np.ndarray) -> Heads:
        near = np.concatenate([np.argsort(_distances(centres[i:i + 512], centres), axis=1)[:, 1:LINKS + 1]
                               for i in range(0, len(centres), 512)])
        # a ring besides, so that every centre can be reached from any other
        ring = (np.arange(len(centres)) + 1) % len(centres)
        return cls(centres, np.column_stack([near, ring]))

    def lists_of(self, vectors: np.ndarray,
                 replicas: int = REPLICAS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(vector, list, whether it is the nearest) rows of vectors to be indexed."""
        d = _distances(vectors, self.centres)
        n = min(replicas, d.shape[1])
        order = np.argpartition(d, n - 1, axis=1)[:, :n]
        own = np.take_along_axis(d, order, 1)
        by = np.argsort(own, axis=1, kind="stable")
        order, own = np.take_along_axis(order, by, 1), np.take_along_axis(own, by, 1)
        row, place = np.nonzero(own <= own[:, :1] * (1.0 + BOUNDARY))
        return row, order[row, place], place == 0

    def search(self, q: np.ndarray, sizes: np.ndarray, wanted: int, prune: float = PRUNE) -> list[int]:
        """Lists to read for a query: best-first along the graph; all centres found
        within the pruning ratio, and further ones until the lists hold ``wanted``
        vectors (``sizes``, each vector counted in one list)."""
        start = list(range(0, len(self.centres), max(1, len(self.centres) // 16)))
        seen = np.zeros(len(self.centres), bool)
        seen[start] = True
        look = np.sqrt(((self.centres[start] - q) ** 2).sum(1))
        heap = list(zip(look.tolist(), start))
        heapq.heapify(heap)
        least, held, found = sorted(look.tolist())[:BASE], 0, []
        while heap:
            d, node = heapq.heappop(heap)
            if d > sum(least) / len(least) * (1.0 + prune + SLACK) and held >= wanted:
                break
            found.append((d, node))
            held += int(sizes[node])
            new = self.links[node][~seen[self.links[node]]]
            if len(new):
                new = np.unique(new)
                seen[new] = True
                look = np.sqrt(((self.centres[new] - q) ** 2).sum(1))
                least = sorted(least + look.tolist())[:BASE]
                for x in zip(look.tolist(), new.tolist()):
                    heapq.heappush(heap, x)
        out, held = [], 0
        for d, node in sorted(found):
            if d > sum(least) / len(least) * (1.0 + prune) and held >= wanted:
                break
            out.append(node)
            held += int(sizes[node])
        return out


def usable(column) -> F.Column:
    """Whether a vector is neither null nor zero nor holds null or non-finite parts."""
    value = F.col(column)
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(value.isNotNull() & F.forall(value, finite)
                      & F.exists(value, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _nearest(k: int):
    """Of one shard, each query's k nearest ids by exact distance, ties to smaller
    ids. An id with several vectors counts once, at the nearest of them."""

    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], []]
        if rows.num_rows and queries.num_rows:
            x, ids = _matrix(rows["v"].combine_chunks()), rows["id"].to_numpy()
            order = np.argsort(ids, kind="stable")
            x, ids = x[order], ids[order]
            starts = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
            q, names = _matrix(queries["v"].combine_chunks()), queries["query_id"].to_numpy()
            # candidates are picked by an expanded square, about the list's centre; its
            # rounding error grows with the norms, and so does the slack
            middle = x.mean(0)
            near_x, norm = x - middle, ((x - middle) ** 2).sum(1)
            step = max(1, BLOCK // len(x))
            for at in range(0, len(q), step):
                part = q[at:at + step]
                near_q = part - middle
                own = (near_q ** 2).sum(1)
                d = own[:, None] + norm - 2.0 * (near_q @ near_x.T)
                slack = 1e-12 * x.shape[1] * (own + norm.max() + (middle ** 2).sum() * 1e-3) + 1e-300
                for i, row in enumerate(d):
                    other = ids != names[at + i]
                    row = np.where(other, row, np.inf)
                    least = np.minimum.reduceat(row, starts) if len(starts) < len(ids) else row
                    n = min(k, int(other[starts].sum()))
                    if not n:
                        continue
                    edge = np.partition(least, n - 1)[n - 1]
                    near = np.flatnonzero(row <= edge + 2 * slack[i])
                    exact = np.sqrt(((x[near] - part[i]) ** 2).sum(1))
                    first = np.lexsort((ids[near], exact))
                    if len(starts) < len(ids):
                        own = np.unique(ids[near][first], return_index=True)[1]
                        first = first[np.sort(own)]
                    first = first[:n]
                    out[0].append(np.full(n, names[at + i])), out[1].append(ids[near][first])
                    out[2].append(exact[first])
        cols = [np.concatenate(c) if c else np.zeros(0, t) for c, t in
                zip(out, (np.int64, np.int64, np.float64))]
        return pa.table(dict(zip(("query_id", "vec_id", "score"), map(pa.array, cols))))
    return run


def true_neighbours(vectors: DataFrame, few: pa.Table, k: int) -> DataFrame:
    """(query_id, id, tag): of the queries ``few`` (query_id, v), the k rows of
    ``vectors`` (id, v, tag) nearest to each by comparing it with all of them; rows of its
    own id are none."""
    shared = Shared(vectors.sparkSession, (few["query_id"].to_numpy(), _matrix(few["v"])))

    def run(batches):
        names, q = shared.value
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                part = b.slice(at, 4096)
                ids, x = part.column(0).to_numpy(), _matrix(part.column(1))
                middle = x.mean(0)
                d = np.where(ids[None, :] == names[:, None], np.inf, _distances(q - middle, x - middle))
                n = min(k, len(ids))
                near = np.argpartition(d, n - 1, axis=1)[:, :n]
                score = np.take_along_axis(d, near, 1)
                own, place = np.nonzero(np.isfinite(score))
                near = pa.array(near[own, place])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names[own]), part.column(0).take(near), part.column(2).take(near),
                     pa.array(score[own, place])], names=["query_id", "id", "tag", "score"])

    found = vectors.select("id", "v", "tag").mapInArrow(run, "query_id long, id long, tag long, score double")
    return top_k_per_group(found, ["query_id"], [F.col("score"), F.col("id")], k).select("query_id", "id", "tag")


def fitting_prune(heads: Heads, sizes: np.ndarray, wanted: int, few: pa.Table, needed: list) -> float:
    """The least ratio, from ``PRUNE`` in steps of ``WIDEN``, at which the searches of the
    queries ``few`` read ``WANTED_RECALL`` of their neighbours. needed: (query_id, the
    lists a neighbour is in) of each neighbour."""
    prune, q = PRUNE, dict(zip(few["query_id"].to_pylist(), _matrix(few["v"])))
    while needed:
        read = {i: set(heads.search(v, sizes, wanted, prune)) for i, v in q.items()}
        hits = sum(not read[i].isdisjoint(own) for i, own in needed)
        if hits >= WANTED_RECALL * len(needed) or all(len(x) == len(heads.centres) for x in read.values()):
            break
        prune = (1.0 + prune) * WIDEN - 1.0 if prune > 1 else prune * WIDEN
    return prune


def without_copies(vectors: DataFrame, most: int) -> DataFrame:
    """``vectors`` (id, v) with, of equal vectors, the rows of the ``most`` smallest ids.
    Runs the counting job; only hashes are shuffled where no vector has more copies."""
    tagged = vectors.withColumn("tag", F.xxhash64("v"))
    copied = cut(tagged.groupBy("tag").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most)
                 .select("tag"), "copied-vectors")
    if copied.isEmpty():
        return vectors
    few = top_k_per_group(tagged.join(copied, "tag", "left_semi"), ["tag", "v"], [F.col("id")], most,
                          salt_cols=["id"])
    rest = tagged.join(copied, "tag", "left_anti").select("id", "v")
    return rest.union(few.select("id", "v"))


def index(vectors: DataFrame, list_rows: int = LIST, k: int = 10) -> tuple[Heads | None, DataFrame]:
    """vectors: (id, v), usable ones of one width. The heads, and the written index
    (list, id, v, first): every vector in each of its lists, ``first`` marking the
    nearest. Where ids are repeated, equal rows are made one first; of equal vectors
    the k + 1 smallest ids stay. Runs jobs."""
    spark = vectors.sparkSession
    n, ids = (vectors.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
              .agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first())
    if ids < n:
        vectors = cut(vectors.distinct(), "distinct-vectors")
    fewer = without_copies(vectors, k + 1)
    if fewer is not vectors:
        vectors = cut(fewer, "vectors-without-copies")
    if ids < n or fewer is vectors:
        n = vectors.count()
    schema = T.StructType([T.StructField("list", T.LongType()), vectors.schema["id"],
                           vectors.schema["v"], T.StructField("first", T.BooleanType())])
    if not n:
        return None, spark.createDataFrame([], schema)
    # twice the share that is needed, so that sorting never sees more
    few = vectors.withColumn("u", drawn("id")).where(F.col("u") * n < 2 * FIT_ROWS)
    sample = few.orderBy("u", "id").limit(FIT_ROWS).select("v").toArrow()
    centres = place_centres(_matrix(sample["v"].combine_chunks()),
                            min(MAX_CENTRES, max(1, n // list_rows)))
    heads = Heads.build(centres)
    shared = Shared(spark, heads)

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 2048):
                part = b.slice(at, 2048)
                row, to, first = shared.value.lists_of(_matrix(part.column(1)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(to, pa.int64()), part.column(0).take(pa.array(row)),
                     part.column(1).take(pa.array(row)), pa.array(first)],
                    names=["list", "id", "v", "first"])

    return heads, cut(vectors.mapInArrow(run, schema), "posting-lists")


def _parts(long: DataFrame, lists: DataFrame, list_rows: int) -> DataFrame:
    """(list, part, centre): centres of the parts of the lists in ``long`` (list, rows),
    from a sample of their vectors bounded by ``SPLIT_PARTS`` x ``SPLIT_SAMPLE`` rows."""
    parts = F.least(F.lit(SPLIT_PARTS), F.ceil(F.col("rows") / list_rows))
    few = (lists.join(long, "list").withColumn("parts", parts.cast("int"))
           .where(drawn("id") * F.col("rows") < F.col("parts") * SPLIT_SAMPLE))

    def place(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("id").combine_chunks()
        centres = place_centres(_matrix(rows["v"]), rows["parts"][0].as_py())
        return pa.table({"list": pa.array([rows["list"][0].as_py()] * len(centres), pa.int64()),
                         "part": pa.array(range(len(centres)), pa.int64()),
                         "centre": pa.array(list(centres), pa.list_(pa.float64()))})

    return (few.select("list", "id", "v", "parts").groupBy("list")
            .applyInArrow(place, "list long, part long, centre array<double>"))


def _meet(rows: DataFrame, centres: DataFrame, sizes: DataFrame, key: str, share: int, fn, schema) -> DataFrame:
    """``rows`` of a list, in blocks of about ``share`` rows by a hash of ``key``, with
    the list's centres, by ``fn(rows, centres)``. sizes: (list, n)."""
    blocks = sizes.select("list", F.ceil(F.col("n") / share).alias("blocks"))
    dealt = rows.join(blocks, "list").withColumn("block", F.pmod(F.xxhash64(key), F.col("blocks"))).drop("blocks")
    met = centres.join(blocks, "list").withColumn(
        "block", F.explode(F.expr("sequence(0L, blocks - 1)"))).drop("blocks")

    def run(some: pa.Table, own: pa.Table) -> pa.Table:
        if not some.num_rows or not own.num_rows:
            return pa.table({f.name: pa.array([], t.type) for f, t in zip(schema.fields, kinds)})
        return fn(some.combine_chunks(), own.sort_by("part").combine_chunks())

    kinds = to_arrow_schema(schema)
    return dealt.groupBy("list", "block").cogroup(met.groupBy("list", "block")).applyInArrow(run, schema)


def split(lists: DataFrame, routed: DataFrame, list_rows: int, wanted: int,
          true: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The index (list, id, v, first) and the queries' lists (list, query_id, v) once
    long lists are split, level by level. ``true`` (query_id, id, tag): neighbours by which
    each level's pruning ratio is fitted. Runs jobs; what reaches the driver is whether a
    list is long, and that ratio."""
    done_lists, done_routed = [], []
    for level in range(1, MAX_LEVELS + 1):
        sizes = cut(lists.groupBy("list").agg(F.count(F.lit(1)).alias("rows")), "list-sizes")
        long = sizes.where(F.col("rows") > SPLIT_ROWS)
        if long.isEmpty():
            break
        centres = cut(_parts(long, lists, list_rows), "list-parts")
        # a list that cannot be split, as its vectors hardly differ, stays as it is
        real = cut(centres.groupBy("list").agg(F.count(F.lit(1)).alias("parts")).where("parts > 1"), "split-lists")
        if real.isEmpty():
            break
        # numbers of parts never meet those of lists: each level has 2^40 of its own, dealt to
        # its split lists (few rows) in turn
        turn = F.row_number().over(Window.orderBy("list")).cast("long") - 1
        real = cut(real.select("list", (turn * SPLIT_PARTS + (level << 40)).alias("base")), "split-bases")
        centres = cut(centres.join(real, "list"), "based-list-parts")
        done_lists.append(lists.join(real, "list", "left_anti"))
        done_routed.append(routed.join(real, "list", "left_anti"))

        def assign(rows: pa.Table, own: pa.Table) -> pa.Table:
            heads = Heads(_matrix(own["centre"]), np.zeros((0, 0), int))
            row, to, first = heads.lists_of(_matrix(rows["v"]), SPLIT_REPLICAS)
            base = own["base"][0].as_py()
            row = pa.array(row)
            return pa.table({"list": pa.array(base + to, pa.int64()), "id": rows["id"].take(row),
                             "v": rows["v"].take(row),
                             "first": pa.array(rows["first"].to_numpy(zero_copy_only=False)[row] & first)})

        def rate(rows: pa.Table, own: pa.Table) -> pa.Table:
            """Every part by its distance beyond the mean of the nearest ones', as a ratio
            (0: read in any case)."""
            held = own["n"].to_numpy()
            d = _distances(_matrix(rows["v"]), _matrix(own["centre"]))
            order = np.argsort(d, axis=1, kind="stable")
            near = np.take_along_axis(d, order, 1)
            ratio = near / np.maximum(near[:, :BASE].mean(1, keepdims=True), 1e-300) - 1.0
            ratio[np.cumsum(held[order], axis=1) - held[order] < wanted] = 0.0
            base = own["base"][0].as_py()
            row = pa.array(np.repeat(np.arange(len(d)), d.shape[1]))
            return pa.table({"list": pa.array(base + order.ravel(), pa.int64()),
                             "query_id": rows["query_id"].take(row), "v": rows["v"].take(row),
                             "ratio": pa.array(ratio.ravel())})

        def choose(prune: float):
            def run(rows: pa.Table, own: pa.Table) -> pa.Table:
                rated = rate(rows, own)
                return rated.filter(pc.less_equal(rated["ratio"], prune)).drop_columns("ratio")
            return run

        hot = real.join(sizes, "list").select("list", F.col("rows").alias("n"))
        parted = cut(_meet(lists.join(real.select("list"), "list", "left_semi"),
                           centres, hot, "id", SHARD_ROWS,
                           assign, lists.select("list", "id", "v", "first").schema), "split-posting-lists")
        held = (parted.where("first").groupBy("list").agg(F.count(F.lit(1)).alias("n"))
                .withColumn("part", F.pmod(F.col("list") - (level << 40), F.lit(SPLIT_PARTS)))
                .select((F.col("list") - F.col("part")).alias("base"), "part", "n"))
        known = centres.join(held, ["base", "part"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
        asked = routed.join(real.select("list"), "list", "left_semi")
        queries = cut(asked.groupBy("list").agg(F.count(F.lit(1)).alias("n")), "list-queries")
        schema = routed.select("list", "query_id", "v").schema
        checked = F.broadcast(true.select("query_id").distinct())
        rated = _meet(asked.join(checked, "query_id", "left_semi").select("list", "query_id", "v"), known, queries,
                      "query_id", QUERY_BLOCK, rate, T.StructType([*schema.fields, T.StructField("ratio", T.DoubleType())]))
        placed = parted.withColumn("tag", F.xxhash64("v")).join(F.broadcast(true), ["id", "tag"])
        need = (placed.select("list", "query_id", "id", "tag").join(rated, ["list", "query_id"])
                .groupBy("query_id", "id", "tag").agg(F.min("ratio").alias("ratio")))
        fits = need.agg(F.percentile("ratio", F.lit(SPLIT_RECALL))).first()[0]
        routed = cut(_meet(asked, known, queries, "query_id", QUERY_BLOCK, choose(max(PRUNE, fits or 0.0)), schema),
                     "split-queries")
        lists = parted
    for x in done_lists:
        lists = lists.union(x.select(*lists.columns))
    for x in done_routed:
        routed = routed.union(x.select(*routed.columns))
    return lists, routed


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id",
           vector_col: str = "embedding", list_rows: int = LIST) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest vectors found for each
    query by Euclidean distance in double precision, nearest first, ties to the
    smaller id; all, where there are fewer. A vector of the query's own id is no
    candidate.

    Null vectors, zero vectors and those with null or non-finite parts take no part,
    nor do rows with a null id; rows repeated with their id count once, and an id with
    several vectors counts at the one nearest the query. Vectors must have one width. Other columns are ignored, empty tables give none. Runs jobs."""
    spark = vectors.sparkSession
    pick = lambda df: (df.select(F.col(f"`{id_col}`").cast("long").alias("id"),
                                 F.col(f"`{vector_col}`").alias("v"))
                       .where(usable("v") & F.col("id").isNotNull()))
    heads, lists = index(pick(vectors), list_rows, k)
    out = "query_id long, vec_id long, score double"
    if heads is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    # at most MAX_CENTRES rows; an id is counted in one list, however many vectors it has
    firsts = (lists.where("first").groupBy("id").agg(F.min("list").alias("list"))
              .groupBy("list").agg(F.count(F.lit(1)).alias("n")).toArrow())
    own = np.zeros(len(heads.centres), np.int64)
    own[firsts["list"].to_numpy()] = firsts["n"].to_numpy()
    source = pick(queries).select(F.col("id").alias("query_id"), "v")
    few = (source.withColumn("u", drawn("query_id")).orderBy("u", "query_id", "v").limit(CHECKED)
           .dropDuplicates(["query_id"]).select("query_id", "v").toArrow())
    if not few.num_rows:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    tagged = lists.withColumn("tag", F.xxhash64("v"))
    true = cut(true_neighbours(tagged.where("first"), few, k), "true-neighbours")
    # at most CHECKED x k rows of few lists each
    needed = (tagged.select("list", "id", "tag").join(F.broadcast(true), ["id", "tag"])
              .groupBy("query_id", "id", "tag").agg(F.collect_set("list").alias("lists")))
    prune = fitting_prune(heads, own, k + 1, few, [(x.query_id, x.lists) for x in needed.collect()])
    shared = Shared(spark, (heads, own, prune))

    def route(batches):
        heads, own, prune = shared.value
        for b in batches:
            found = [heads.search(q, own, k + 1, prune) for q in _matrix(b.column(1))]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int64())), *b.columns],
                                             names=["lists", "query_id", "v"])

    routes = cut(source.mapInArrow(route, T.StructType([
        T.StructField("lists", T.ArrayType(T.LongType())), *source.schema.fields])), "query-lists")
    routed = routes.select(F.explode("lists").alias("list"), "query_id", "v")
    lists, routed = split(lists, routed, list_rows, k + 1, true)
    # long lists in shards, a list's queries in blocks: every block meets every shard
    asked = routed.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).alias("blocks"))
    plan = cut(lists.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / SHARD_ROWS).alias("shards"))
               .join(asked, "list"), "list-plan")
    number = lambda key, n: F.pmod(F.xxhash64(key), F.col(n))
    each = lambda n: F.explode(F.expr(f"sequence(0L, {n} - 1)"))
    posted = lists.join(plan, "list").select("list", number("id", "shards").alias("shard"),
                                             each("blocks").alias("block"), "id", "v")
    sent = routed.join(plan, "list").select("list", number("query_id", "blocks").alias("block"),
                                            each("shards").alias("shard"), "query_id", "v")
    at = ["list", "shard", "block"]
    found = posted.groupBy(*at).cogroup(sent.groupBy(*at)).applyInArrow(_nearest(k), out)
    once = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(vectors, vectors.where("vec_id % 100 = 0"))
