"""Gradient-boosted trees with a score for every round.

MLlib boosts one binary or regression model at a time, with a job for each tree level
and no scores on the way. Here any number of ensembles (classes of a soft-max model,
folds, candidates of a search) grow side by side: one job serves a level of all
their trees, and with it come training and validation loss and accuracy of the round
before. An ensemble fitted to its largest number of rounds so answers for every
smaller one, too.

Features are cut into at most ``BINS`` quantile bins and kept as bytes in persisted
blocks of rows; a task sums gradients by node, feature and bin, the sums of a node meet
in a task that picks its split, and the driver, which holds fitted parameters only, gets
the splits and no sums.
Margins are carried from round to round; lineage is cut by ``checkpoint`` every
``CUT_EVERY`` rounds, so a lost executor costs that many at most. Where one task can
hold all rows (up to ``ROWS_PER_BLOCK``, or ``BYTES_ALONE`` if there are more ensembles
than blocks), there is nothing to reduce: they are broadcast as bytes, and the ensembles,
not the rows, are spread over tasks. Of two children, only the one with fewer rows is
then summed, and the other is what is left of their parent.

Gradients are rounded to a step (``_Fit.unit``) so fine that a double holds any sum of
them without an error: sums do not depend on order, blocks or what they were taken from.
"""

from __future__ import annotations

import pickle
import sys
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, cloudpickle
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftpool.session import ensure_checkpoint_dir

# task functions travel with their code, so that executors need no installed copy
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BINS, ROWS_PER_BLOCK, CUT_EVERY = 32, 65_536, 20
#: bytes of bins (one for each row and feature) that a task may hold at most; it needs some
#: five times as much with 32 features
BYTES_ALONE = 1 << 26
#: rows of a node from which features are summed two at a time
ROWS_PAIRED = 700
#: added to a node's curvature, and the least curvature a child must have
RIDGE, LEAST = 1.0, 1e-3
SKIP, TRAIN, TEST = 0, 1, 2
LOSSES = ("logistic", "softmax", "squared")
#: stands for (tree, node) where scores travel along
SCORE = (-1, -1)


@dataclass(frozen=True)
class Plan:
    """An ensemble to fit: rounds, step size, depth, and which of a row's roles says
    whether it is learned from (1), scored (2) or neither (0)."""

    rounds: int
    rate: float
    depth: int
    role: int = 0


@dataclass
class Trees:
    """One round's tree of each head, nodes numbered as in a heap; feature -1: a leaf."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    @classmethod
    def empty(cls, heads: int, depth: int) -> Trees:
        size = (heads, 2 ** (depth + 1) - 1)
        return cls(np.full(size, -1, np.int32), np.zeros(size, np.uint8), np.zeros(size))

    def step(self, head: int, bins: np.ndarray, at: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The node each row reaches from ``at``; ``first``: where a row's bins begin."""
        f = self.feature[head].take(at)
        right = bins.ravel().take(first + np.maximum(f, 0)) > self.cut[head].take(at)
        return np.where(f >= 0, 2 * at + 1 + right, at)

    def node(self, head: int, bins: np.ndarray, steps: int) -> np.ndarray:
        """The node each row has reached after so many steps."""
        at, first = np.zeros(len(bins), np.int64), _first(bins)
        for _ in range(steps):
            at = self.step(head, bins, at, first)
        return at


def _first(bins: np.ndarray) -> np.ndarray:
    return np.arange(len(bins)) * bins.shape[1]


#: rows of a partition: bins, labels, roles, and margins by row and head (plan x class).
#: Plain arrays, which any worker can unpickle
Block = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]


def gradients(loss: str, margins: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Downhill gradient and curvature of each (row, plan, class)."""
    if loss == "squared":
        return y[:, None, None] - margins, np.ones_like(margins)
    p = probabilities(loss, margins)
    hit = (y[:, None, None] == np.arange(margins.shape[2])) if loss == "softmax" else y[:, None, None]
    return hit - p, np.maximum(p * (1 - p), 1e-12)


def probabilities(loss: str, margins: np.ndarray) -> np.ndarray:
    if loss == "logistic":
        return 1.0 / (1.0 + np.exp(-np.clip(margins, -500, 500)))
    e = np.exp(margins - margins.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def losses(loss: str, margins: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Loss, and whether the prediction is right, of each (row, plan)."""
    if loss == "squared":
        return (y[:, None] - margins[:, :, 0]) ** 2, np.zeros(margins.shape[:2])
    if loss == "logistic":
        m = margins[:, :, 0]
        return np.logaddexp(0, m) - y[:, None] * m, (m > 0) == (y[:, None] > 0)
    own = np.take_along_axis(margins, y.astype(np.int64)[:, None, None], 2)[:, :, 0]
    high = margins.max(2)
    return (high + np.log(np.exp(margins - high[:, :, None]).sum(2)) - own,
            margins.argmax(2) == y[:, None])


def paired(bins: np.ndarray) -> np.ndarray:
    """(pair of features, row): the bins of two features as one number (of an odd last one
    and of none)."""
    wide = bins.astype(np.uint16)
    out = wide[:, ::2] * np.uint16(BINS)
    out[:, :wide.shape[1] // 2] += wide[:, 1::2]
    return np.ascontiguousarray(out.T)


def histogram(pairs: np.ndarray, features: int, rows: np.ndarray | None, slot: np.ndarray | int, slots: int,
              weight: np.ndarray) -> np.ndarray:
    """(slot, feature, bin) sums of ``weight`` over ``rows`` (all without) of ``pairs``; a row
    counts for its ``slot``. Weights are gradient + i x curvature, so one pass adds both."""
    out = np.empty((slots, 2 * len(pairs), BINS), np.complex128)
    code, place = np.empty(len(weight), np.uint16), np.empty(len(weight), np.int64)
    both = len(weight) >= ROWS_PAIRED * slots

    def add(part: np.ndarray, size: int) -> np.ndarray:
        cells = np.zeros(slots * size, np.complex128)
        np.add.at(cells, np.add(start, part, out=place), weight)
        return cells

    start = np.asarray(slot) * (BINS ** 2 if both else BINS)
    for p, codes in enumerate(pairs):
        if rows is not None:
            codes = codes.take(rows, out=code, mode="clip")
        if both:
            cells = add(codes, BINS ** 2).reshape(slots, BINS, BINS)
            out[:, 2 * p], out[:, 2 * p + 1] = cells.sum(2), cells.sum(1)
        else:
            high = codes // BINS
            out[:, 2 * p] = add(high, BINS).reshape(slots, BINS)
            out[:, 2 * p + 1] = add(codes - high * BINS, BINS).reshape(slots, BINS)
    return out[:, :features]


class _Fit:
    """What tasks need: plans, loss, number of classes, and the step that gradients are
    rounded to. Heads are plan x class."""

    def __init__(self, plans: list[Plan], loss: str, classes: int, unit: float = 0.0):
        self.plans, self.loss, self.classes, self.unit = plans, loss, classes, unit
        self.heads = [(p, k) for p in range(len(plans)) for k in range(classes)]

    def weights(self, margins: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Gradient + i x curvature of each (row, plan, class), rounded."""
        out = np.empty(margins.shape, np.complex128)
        shift = 1.5 * 2.0 ** 52 * self.unit  # doubles of this size are multiples of the unit
        g, h = gradients(self.loss, margins, y)
        out.real = (g + shift) - shift
        out.imag = h if self.loss == "squared" else (h + shift) - shift
        return out

    def shaped(self, margins: np.ndarray) -> np.ndarray:
        return margins.reshape(len(margins), len(self.plans), self.classes)

    def advance(self, block: Block, trees: Trees | None, live: list[int]) -> Block:
        """The block after a round's trees."""
        bins, y, roles, margins = block
        margins = margins.copy()
        for i, head in enumerate(live):
            plan = self.plans[self.heads[head][0]]
            margins[:, head] += plan.rate * trees.value[i][trees.node(i, bins, plan.depth)]
        return bins, y, roles, margins

    def score(self, block: Block) -> np.ndarray:
        """(plan, train or test, [rows, loss, right]) sums."""
        _, y, roles, margins = block
        each, right = losses(self.loss, self.shaped(margins), y)
        out = np.zeros((len(self.plans), 2, 3))
        for i, p in enumerate(self.plans):
            for j, role in enumerate((TRAIN, TEST)):
                own = roles[:, p.role] == role
                out[i, j] = own.sum(), each[own, i].sum(), right[own, i].sum()
        return out

    def sums(self, block: Block, trees: Trees, level: int,
             heads: list[tuple[int, int]]) -> list[tuple[tuple[int, int], np.ndarray]]:
        """((tree, node), (feature, bin) sums) of the level's nodes that training rows have reached."""
        bins, y, roles, margins = block
        weights, pairs = self.weights(self.shaped(margins), y), paired(bins)
        n_nodes, n_features = 2 ** level, bins.shape[1]
        out = []
        for tree, head in heads:
            plan, k = self.heads[head]
            own = np.flatnonzero(roles[:, self.plans[plan].role] == TRAIN)
            node = trees.node(tree, bins[own], level) - (n_nodes - 1)
            own, node = own[node >= 0], node[node >= 0]  # others rest on a leaf
            sums = histogram(pairs, n_features, own, node, n_nodes, weights[own, plan, k])
            out += [((tree, int(at)), sums[at]) for at in np.flatnonzero(np.bincount(node, minlength=n_nodes))]
        return out


#: a node's own value, and (feature, cut, left value, right value) if it is to be split
Choice = tuple[float, tuple[int, int, float, float] | None]


def _choose(sums: np.ndarray) -> list[Choice]:
    """The split of each node, by (node, feature, bin) sums, that lowers the loss most;
    ties: the first feature, the lowest cut."""
    total = sums[:, :1].sum(2, keepdims=True)  # of any feature: a node's sums
    left = np.cumsum(sums, axis=2)[:, :, :-1]
    right = total - left
    worth = lambda s: s.real ** 2 / (s.imag + RIDGE)
    gain = worth(left) + worth(right) - worth(total)
    # rounded, so that no last digit decides a tie
    gain = np.where((left.imag >= LEAST) & (right.imag >= LEAST), np.round(gain, 9), -np.inf)
    step, out = lambda s: float(s.real / (s.imag + RIDGE)), []
    for i, best in enumerate(gain.reshape(len(gain), -1).argmax(1)):
        f, cut = divmod(int(best), BINS - 1)
        split = (f, cut, step(left[i, f, cut]), step(right[i, f, cut])) if gain[i, f, cut] > 0 else None
        out.append((step(total[i, 0, 0]), split))
    return out


def _split(trees: Trees, level: int, chosen: list[tuple[tuple[int, int], Choice]]) -> None:
    """Splits nodes of the level, given as ((tree, node), choice); sets the values of the
    nodes below."""
    for (tree, node), (value, split) in chosen:
        if level == 0:
            trees.value[tree, 0] = value
        if split is not None:
            at = 2 ** level - 1 + node
            trees.feature[tree, at], trees.cut[tree, at] = split[:2]
            trees.value[tree, 2 * at + 1], trees.value[tree, 2 * at + 2] = split[2:]


@dataclass
class Boosted:
    """Fitted ensembles: ``edges`` cut features into bins, ``base`` is each head's first
    margin, ``rounds`` hold each round's trees and the heads they belong to;
    ``history[t, plan]`` has (rows, mean loss, accuracy) of train and test after t rounds."""

    plans: list[Plan]
    loss: str
    classes: int
    edges: list[np.ndarray]
    base: np.ndarray
    rounds: list[tuple[Trees, list[int]]] = field(default_factory=list)
    history: np.ndarray | None = None

    def best_round(self, plan: int) -> int:
        """Rounds with the lowest test loss (the fewest such)."""
        return int(self.history[:self.plans[plan].rounds + 1, plan, 1, 1].argmin())

    def history_table(self, spark) -> DataFrame:
        """(candidate, iteration, train_loss, valid_loss, valid_accuracy, is_best): one
        row for each plan and number of rounds, 0 included; the best one marked."""
        last = {i: p.rounds for i, p in enumerate(self.plans)}
        best = min(last, key=lambda i: (self.history[self.best_round(i), i, 1, 1], i))
        mark = (best, self.best_round(best))
        rows = [(i, t, *(float(x) for x in (self.history[t, i, 0, 1], *self.history[t, i, 1, 1:])),
                 (i, t) == mark) for i in last for t in range(last[i] + 1)]
        return spark.createDataFrame(rows, "candidate int, iteration int, train_loss double, "
                                           "valid_loss double, valid_accuracy double, is_best boolean")

    def margins(self, features: np.ndarray, plan: int, rounds: int | None = None) -> np.ndarray:
        """(row, class) margins of an ensemble cut off after ``rounds``."""
        bins, own = to_bins(features, self.edges), self.plans[plan]
        out = np.tile(self.base[plan * self.classes:(plan + 1) * self.classes], (len(bins), 1))
        for trees, live in self.rounds[:own.rounds if rounds is None else rounds]:
            for i, head in enumerate(live):
                if head // self.classes == plan:
                    out[:, head % self.classes] += own.rate * trees.value[i][
                        trees.node(i, bins, own.depth)]
        return out

    def transform(self, df: DataFrame, features: str = "features", plan: int = 0,
                  rounds: int | None = None) -> DataFrame:
        """``df`` with prediction (the value, or the likeliest class: ties the smaller)
        and, for classes, probability, an array that sums to one."""
        kinds = [T.StructField("prediction", T.DoubleType()),
                 T.StructField("probability", T.ArrayType(T.DoubleType()))]
        kept = df.drop("prediction", "probability")
        src = kept.withColumn("__x", _as_array(kept, features))
        # MLlib vectors have no Arrow type: they stay out of the batch and come back by position
        plain = [f for f in kept.schema.fields if f.dataType.simpleString() != "vector"]
        schema = T.StructType([*plain, *kinds])

        def run(batches):
            for b in batches:
                m = self.margins(matrix(b.column(b.num_columns - 1)), plan, rounds)
                if self.loss == "squared":
                    value, p = m[:, 0], np.zeros((len(m), 0))
                else:
                    p = probabilities(self.loss, m)
                    p = np.column_stack([1 - p, p]) if self.loss == "logistic" else p
                    value = p.argmax(1).astype(float)
                yield pa.RecordBatch.from_arrays(
                    [*b.columns[:-1], pa.array(value), pa.array(list(p), pa.list_(pa.float64()))],
                    names=schema.names)

        return src.select(*[F.col(f"`{f.name}`") for f in plain], "__x").mapInArrow(run, schema)


def _as_array(df: DataFrame, features: str) -> Column:
    c = F.col(f"`{features}`")
    return vector_to_array(c) if df.schema[features].dataType.simpleString() == "vector" \
        else c.cast("array<double>")


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def to_bins(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.column_stack([np.searchsorted(e, x[:, i], "left") for i, e in enumerate(edges)]).astype(
        np.uint8) if edges else np.zeros((len(x), 0), np.uint8)


def bin_edges(df: DataFrame, features: str, width: int) -> list[np.ndarray]:
    """Upper edges of each feature's bins but the last: distinct quantiles."""
    wide = df.select(*[F.col(features)[i].alias(f"f{i}") for i in range(width)])
    shares = [k / BINS for k in range(1, BINS)]
    return [np.unique(q) for q in wide.approxQuantile(wide.columns, shares, 0.001)]


def fit_boosters(data: DataFrame, plans: list[Plan], loss: str, features: str = "features",
                 label: str = "label", roles: str = "roles", classes: int = 1,
                 key: str | list[str] | None = None) -> Boosted:
    """Fits all ``plans`` side by side and scores every round of each.

    ``roles`` is an array column: what a row is to each role number. ``loss``:
    'logistic' (labels 0 and 1), 'softmax' (labels 0 to ``classes`` - 1) or 'squared'.
    ``key``, a unique row key, makes reruns identical. Features may be an array or an
    MLlib vector without nulls. Runs a job for each level of the deepest tree of
    every round, or a single one where a task can hold the rows (``BYTES_ALONE``); the trees
    are the same. Raises ValueError where a plan has no row to learn from."""
    spark = data.sparkSession
    ensure_checkpoint_dir(spark)
    keys = [key] if isinstance(key, str) else list(key or [])
    rows = data.select(*keys, _as_array(data, features).alias("x"), F.col(label).cast("double").alias("y"),
                       F.col(roles).alias("roles")).persist(StorageLevel.MEMORY_AND_DISK)
    blocks = None
    try:
        n = rows.count()
        head = rows.select(F.size("x")).first()
        if head is None:
            raise ValueError("no rows to fit")
        learned = rows.where(F.exists("roles", lambda r: r == TRAIN))
        edges = bin_edges(learned, "x", head[0])
        parts = max(1, -(-n // ROWS_PER_BLOCK))
        dealt = rows.repartition(parts, *keys).sortWithinPartitions(*keys) if keys else rows.repartition(parts)
        blocks = _blocks(dealt.drop(*keys), edges).persist(StorageLevel.MEMORY_AND_DISK)
        base, learn, most = _base(blocks, _Fit(plans, loss, classes))
        fit = _Fit(plans, loss, classes, _unit(n, most))
        out = Boosted(plans, loss, classes, edges, base)
        if parts == 1 or parts < len(plans) and n * max(1, head[0]) <= BYTES_ALONE:
            _grow_alone(blocks, fit, out, learn)
        else:
            started = blocks.map(lambda b: (*b[:3], np.tile(base, (len(b[1]), 1))))
            blocks = _grow(started, blocks, fit, out)
        return out
    finally:
        rows.unpersist()
        if blocks is not None:
            blocks.unpersist()


def _blocks(rows: DataFrame, edges: list[np.ndarray]):
    """One Block for each Arrow batch (an RDD: margins are carried between rounds)."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                block = (to_bins(matrix(b.column(0)), edges),
                         b.column(1).to_numpy(zero_copy_only=False).astype(np.float64),
                         matrix(b.column(2)).astype(np.uint8), None)
                yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(block)], pa.binary())], ["block"])

    return rows.mapInArrow(run, "block binary").rdd.map(lambda r: pickle.loads(r[0]))


def _base(blocks, fit: _Fit) -> tuple[np.ndarray, np.ndarray, float]:
    """First margins: mean label, log odds, or log shares of a plan's training rows; their
    number by plan; and the largest gradient there can be at first."""
    classes, loss, plans = fit.classes, fit.loss, fit.plans

    def count(b: Block) -> tuple[np.ndarray, float]:
        out = np.zeros((len(plans), classes + 1))
        for i, p in enumerate(plans):
            y = b[1][b[2][:, p.role] == TRAIN]
            out[i, classes] = len(y)
            out[i, :classes] = np.bincount(y.astype(np.int64), minlength=classes)[:classes] \
                if loss == "softmax" else y.sum()
        return out, float(np.abs(b[1]).max())

    got, most = blocks.map(count).reduce(lambda a, b: (a[0] + b[0], max(a[1], b[1])))
    n = got[:, classes:]
    if (n == 0).any():
        raise ValueError("no training rows")
    share = got[:, :classes] / n
    if loss == "squared":
        return share.ravel(), n[:, 0], 2 * most
    share = np.clip(share, 1e-6, 1 - 1e-6)
    return np.log(share / (1 - share) if loss == "logistic" else share).ravel(), n[:, 0], 1.0


def _unit(n: int, most: float) -> float:
    """A power of two so small that a gradient is rounded by 2 ** -51 of n times the
    largest at most, and so large that a double holds the sum of n of them exactly."""
    return 2.0 ** (int(np.ceil(np.log2(n * most))) - 51) if 0 < most < np.inf else 2.0 ** -51


def _depth(trees: Trees) -> int:
    return int(np.log2(trees.feature.shape[1] + 1)) - 1


def _start(fit: _Fit, t: int) -> tuple[Trees, list[int]]:
    """Empty trees for the heads that grow in round t (none after the last)."""
    live = [h for h, (p, _) in enumerate(fit.heads) if fit.plans[p].rounds > t]
    return Trees.empty(len(live), max((fit.plans[fit.heads[h][0]].depth for h in live), default=0)), live


def _open(fit: _Fit, trees: Trees, live: list[int], level: int) -> list[tuple[int, int]]:
    """(tree, head) of the trees that have nodes to split on a level."""
    return [(i, h) for i, h in enumerate(live) if fit.plans[fit.heads[h][0]].depth > level
            and (level == 0 or (trees.feature[i, 2 ** (level - 1) - 1:2 ** level - 1] >= 0).any())]


def _means(history: list[np.ndarray]) -> np.ndarray:
    sums = np.array(history)  # (round, plan, train or test, [rows, loss, right])
    rows = np.maximum(sums[..., :1], 1)
    mean = np.where(sums[..., :1] > 0, sums[..., 1:] / rows, np.nan)
    return np.concatenate([sums[..., :1], mean], axis=-1)


def _grow_alone(blocks, fit: _Fit, out: Boosted, learn: np.ndarray) -> None:
    """All rounds where a task can hold the rows: they are broadcast, and each ensemble grows
    in a task of its own. ``learn``: each ensemble's training rows."""
    sc = blocks.context
    parts = blocks.map(lambda b: b[:3]).collect()
    rows, base = sc.broadcast(tuple(np.concatenate(x) for x in zip(*parts))), out.base.reshape(-1, fit.classes)
    del parts

    def whole(i: int) -> tuple[list[tuple], list[np.ndarray]]:
        rounds, scores = _Alone(_Fit([fit.plans[i]], fit.loss, fit.classes, fit.unit), *rows.value, base[i]).grow()
        return [(t.feature, t.cut, t.value) for t in rounds], scores

    n = len(fit.plans)
    # those with most to do first: they decide how long it takes
    order = sorted(range(n), key=lambda i: -fit.plans[i].rounds * fit.plans[i].depth * learn[i])
    grown = dict(zip(order, sc.parallelize(order, n).map(whole).collect()))
    rows.unpersist()
    last = max(p.rounds for p in fit.plans)
    for t in range(last):
        trees, live = _start(fit, t)
        for i, head in enumerate(live):
            plan, k = fit.heads[head]
            feature, cut, value = (x[k] for x in grown[plan][0][t])
            trees.feature[i, :len(feature)], trees.cut[i, :len(cut)], trees.value[i, :len(value)] = feature, cut, value
        out.rounds.append((trees, live))
    scores = [np.concatenate([grown[i][1][min(t, fit.plans[i].rounds)] for i in range(n)])
              for t in range(last + 1)]
    out.history = _means(scores)


class _Alone:
    """An ensemble in one task: training rows, then test rows; others are left out."""

    def __init__(self, fit: _Fit, bins: np.ndarray, y: np.ndarray, roles: np.ndarray, base: np.ndarray):
        role = roles[:, fit.plans[0].role]
        learn, test = np.flatnonzero(role == TRAIN), np.flatnonzero(role == TEST)
        own = np.concatenate([learn, test])
        self.fit, self.plan, self.n = fit, fit.plans[0], len(learn)
        self.bins, self.y, self.margins = bins[own], y[own], np.tile(base, (len(own), 1))
        self.first, self.pairs = _first(self.bins), paired(self.bins[:self.n])

    def grow(self) -> tuple[list[Trees], list[np.ndarray]]:
        """The trees of each round; the scores of each number of rounds, 0 included."""
        rounds, scores = [], [self.score()]
        for _ in range(self.plan.rounds):
            trees = Trees.empty(self.fit.classes, self.plan.depth)
            weights = self.fit.weights(self.margins[:self.n, None], self.y[:self.n])
            for k in range(self.fit.classes):
                at = self.tree(trees, k, np.ascontiguousarray(weights[:, 0, k]))
                self.margins[:, k] += self.plan.rate * trees.value[k].take(at)
            rounds.append(trees)
            scores.append(self.score())
        return rounds, scores

    def tree(self, trees: Trees, k: int, weight: np.ndarray) -> np.ndarray:
        """Grows the tree of a class; the node each row ends at."""
        at, features = np.zeros(len(self.bins), np.int64), self.bins.shape[1]
        nodes = np.zeros(1, np.int64)  # the level's that may be split, numbered in it, with their sums
        sums = histogram(self.pairs, features, None, 0, 1, weight)
        for level in range(self.plan.depth):
            _split(trees, level, [((k, int(node)), one) for node, one in zip(nodes, _choose(sums))])
            split = np.flatnonzero(trees.feature[k, nodes + 2 ** level - 1] >= 0)
            if not len(split):
                break
            at = trees.step(k, self.bins, at, self.first)
            if level + 1 < self.plan.depth:
                nodes, sums = self.below(at[:self.n], level + 1, nodes[split], sums[split], weight)
        return at

    def below(self, at: np.ndarray, level: int, parents: np.ndarray, sums: np.ndarray,
              weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The children of ``parents``, nodes of the level above with these sums, and their
        sums: read from rows for the child with fewer of them, left over for the other."""
        start = 2 ** level - 1
        rows = np.bincount(at, minlength=2 * start + 1)[start:]
        less = 2 * parents + (rows[2 * parents + 1] < rows[2 * parents])
        slots = np.full(2 * start + 1, -1)
        slots[start + less] = np.arange(len(less))
        slot = slots.take(at)
        own = np.flatnonzero(slot >= 0)
        few = histogram(self.pairs, self.bins.shape[1], own, slot.take(own), len(less), weight.take(own))
        return np.concatenate([less, less ^ 1]), np.concatenate([few, sums - few])

    def score(self) -> np.ndarray:
        """(1, train or test, [rows, loss, right]) sums."""
        each, right = losses(self.fit.loss, self.margins[:, None], self.y)
        return np.array([[(len(each[own]), each[own].sum(), right[own].sum())
                          for own in (slice(self.n), slice(self.n, None))]], float)


def _grow(now, before, fit: _Fit, out: Boosted):
    """All rounds side by side; returns the last blocks. ``before``: persisted blocks to
    release."""
    history = []
    trees, live = None, []
    for t in range(max(p.rounds for p in fit.plans) + 1):
        if t:
            now = before.map(_call(fit.advance, trees, live))
        now = now.persist(StorageLevel.MEMORY_AND_DISK)
        if t and t % CUT_EVERY == 0:
            now.checkpoint()
        trees, live = _start(fit, t)
        score = None
        for level in range(_depth(trees)):
            heads = _open(fit, trees, live, level)
            if not heads:
                break
            # the first level's job also scores the rounds so far
            own = now.flatMap(_both(fit, trees, level, heads, level == 0))
            tasks = min(now.context.defaultParallelism, len(heads) * 2 ** level)
            chosen = dict(own.reduceByKey(np.add, tasks).map(_settle).collect())
            score = chosen.pop(SCORE, score)
            _split(trees, level, list(chosen.items()))
        if score is None:
            score = now.map(fit.score).treeReduce(np.add)
        history.append(score)
        before.unpersist()
        before = now
        if live:
            out.rounds.append((trees, live))
    out.history = _means(history)
    return before


def _call(fn: Callable, *args) -> Callable:
    return lambda block: fn(block, *args)


def _both(fit: _Fit, trees: Trees, level: int, heads: list[tuple[int, int]], score: bool) -> Callable:
    """Of a block, ((tree, node), sums) for each node with rows, and its score."""

    def run(block: Block) -> list[tuple[tuple[int, int], np.ndarray]]:
        own = fit.sums(block, trees, level, heads)
        return own + [(SCORE, fit.score(block))] if score else own
    return run


def _settle(one: tuple) -> tuple:
    at, sums = one
    return at, sums if at == SCORE else _choose(sums[None])[0]
