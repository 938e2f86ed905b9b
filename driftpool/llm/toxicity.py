"""Toxicity by fuzzy lexicon matches in context (operator 8).

Method: terms (words and word beginnings) that a bounded sample of labelled texts
ties to the label form a lexicon, kept as a trie. A Levenshtein automaton of one
edit is intersected with the trie, as a deterministic automaton built while words
run through it, so that misspelled terms are caught and most words are refused
after a few letters; words that clean sample texts use are not taken for
misspellings. Every match is weighed by the words around it: quotation marks and
reporting words lower it, direct address and further matches raise it. A logistic
regression over the sums turns them into a score.

Texts are scored row by row in Arrow batches, whole, without a shuffle. What is
learned is bounded by the sample (``FIT_ROWS``) and broadcast.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftpool.llm.common import Shared, add_columns, cut, drawn, held_out, table

QUERY_NAME = "op8_toxicity"
ORACLE_SQL = None  # tests hold the matcher against brute force and scores against held-out labels
THRESHOLD = 0.3
#: bound of the fitting sample: labelled rows with the smallest hashed ids
FIT_ROWS = 20_000
#: a lexicon term: texts, evidence (G squared), odds against clean texts; bound of the lexicon
MIN_TEXTS, MIN_EVIDENCE, MIN_ODDS, MAX_TERMS = 3, 18.0, 8.0, 2000
PREFIXES = range(5, 9)
#: terms of fewer letters must match exactly
FUZZY_LETTERS = 5
MISSPELLED, QUOTED, REPORTED, ADDRESSED, COMPANY = 0.8, 0.4, 0.7, 1.2, 0.25
CONTEXT = 8
REMEMBERED = 400_000
EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "“”„«»‘’‚‹›…–—¿¡"
OPENING, CLOSING = frozenset("\"“„«‹‘‚"), frozenset("\"”“»›’")

# fixed values: words that report speech, and words that address a reader
REPORTING = frozenset("""said says wrote writes called quoted quote claims claimed
dit écrit appelé citation sagte schrieb nannte zitat dijo escribió llamó cita""".split())
ADDRESS = frozenset("""you your yours you're du dich dir dein deine ihr euch tu te toi ton ta vous votre
tú ti tus usted ustedes vosotros""".split())


def words_of(text: str | None) -> list[str]:
    return (text or "").lower().split()


def terms_of(words: list[str]) -> set[str]:
    """Words without punctuation at their ends, and their beginnings, marked ``*``."""
    out = set()
    for w in set(words):
        w = w.strip(EDGE)
        if len(w) > 2:
            out.add(w)
            out.update(w[:n] + "*" for n in PREFIXES if len(w) >= n)
    return out


class FuzzyTrie:
    """The Levenshtein automaton of one edit over a trie of words, determinised as
    words are read. A state is a set of (trie node, edits); state 0 refuses."""

    def __init__(self, words: list[str]):
        self.children: list[dict[str, int]] = [{}]
        self.word: list[str | None] = [None]
        for w in words:
            node = 0
            for ch in w:
                if ch not in self.children[node]:
                    self.children[node][ch] = len(self.children)
                    self.children.append({})
                    self.word.append(None)
                node = self.children[node][ch]
            self.word[node] = w
        self.numbers: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.best: list[tuple[int, str] | None] = []
        self.moves: list[dict[str, int]] = []
        self._number(frozenset())
        self.start = self._number(self._closed({(0, 0)}))

    def _closed(self, found: set) -> frozenset:
        """With the nodes reached by leaving out one letter of a term; of a node
        only the fewest edits."""
        found = found | {(c, 1) for node, e in found if e == 0 for c in self.children[node].values()}
        return frozenset(x for x in found if x[1] == 0 or (x[0], 0) not in found)

    def _number(self, state: frozenset) -> int:
        if state not in self.numbers:
            self.numbers[state] = len(self.sets)
            self.sets.append(state)
            self.moves.append({})
            ends = [(e, self.word[node]) for node, e in state if self.word[node] is not None
                    and (e == 0 or len(self.word[node]) >= FUZZY_LETTERS)]
            self.best.append(min(ends) if ends else None)
        return self.numbers[state]

    def _move(self, state: int, ch: str) -> int:
        out = set()
        for node, e in self.sets[state]:
            if ch in self.children[node]:
                out.add((self.children[node][ch], e))
            if e == 0:
                out.add((node, 1))  # a letter too many
                out.update((c, 1) for c in self.children[node].values())  # another letter
        got = self.moves[state][ch] = self._number(self._closed(out))
        return got

    def match(self, word: str) -> tuple[int, str] | None:
        """(edits, term) of the nearest term within one edit; ties: the smaller."""
        state = self.start
        for ch in word:
            to = self.moves[state].get(ch)
            state = self._move(state, ch) if to is None else to
            if not state:
                return None
        return self.best[state]


@dataclass
class Lexicon:
    """Weights of words and of word beginnings; words never taken for misspellings."""

    words: dict[str, float] = field(default_factory=dict)
    starts: dict[str, float] = field(default_factory=dict)
    usual: frozenset[str] = frozenset()
    trie: FuzzyTrie | None = None
    seen: dict[str, tuple[int, float]] = field(default_factory=dict)

    def __getstate__(self):
        return {**self.__dict__, "trie": None, "seen": {}}

    def find(self, raw: str) -> tuple[int, float]:
        """(kind, weight) of a word as it stands in a text: 1 a term, 2 a misspelled
        one, 3 a beginning, 0 none."""
        if self.trie is None:
            self.trie = FuzzyTrie(sorted(self.words))
        w = raw.strip(EDGE)
        got = self.trie.match(w) if len(w) > 2 else None
        if got is not None and got[0] == 0:
            return 1, self.words[w]
        found = [(3, self.starts[w[:n]]) for n in PREFIXES if w[:n] in self.starts and len(w) >= n]
        if got is not None and w not in self.usual:
            found.append((2, self.words[got[1]] * MISSPELLED))
        return max(found, key=lambda x: x[1], default=(0, 0.0))

    def matches(self, words: list[str]) -> list[tuple[int, int, float]]:
        """(place, kind, weight) of the words that match."""
        seen, out = self.seen, []
        for i, w in enumerate(words):
            got = seen.get(w)
            if got is None:
                if len(seen) >= REMEMBERED:
                    seen.clear()
                got = seen[w] = self.find(w)
            if got[0]:
                out.append((i, *got))
        return out

    def features(self, text: str | None) -> list[float]:
        words = words_of(text)
        found = self.matches(words)
        if not found:
            return [0.0] * N_FEATURES
        places = np.array([i for i, _, _ in found])
        # a word repeated over and over is one piece of evidence: its heaviest place
        heaviest: dict[str, tuple[float, int, bool]] = {}
        for i, kind, weight in found:
            lo, hi = max(0, i - CONTEXT), min(len(words), i + CONTEXT + 1)
            before, after = words[lo:i + 1], words[i:hi]
            near = {w.strip(EDGE) for w in words[lo:hi]}
            quoted = (any(w[0] in OPENING for w in before) and any(
                w.rstrip(".,;:!?")[-1:] in CLOSING for w in after))
            weight *= QUOTED if quoted else 1.0
            weight *= REPORTED if near & REPORTING else 1.0
            weight *= ADDRESSED if near & ADDRESS else 1.0
            others = len({words[j] for j in places[np.searchsorted(places, lo):
                                                   np.searchsorted(places, hi)]} - {words[i]})
            weight *= 1.0 + COMPANY * min(3, others)
            word = words[i].strip(EDGE)
            heaviest[word] = max(heaviest.get(word, (0.0, 0, False)), (weight, kind, quoted))
        total = sum(w for w, _, _ in heaviest.values())
        kinds = Counter(k for _, k, _ in heaviest.values())
        return [np.log1p(total), max(w for w, _, _ in heaviest.values()),
                np.log1p(100.0 * total / len(words)),
                sum(q for _, _, q in heaviest.values()) / len(heaviest),
                *(np.log1p(kinds[k]) for k in (1, 2, 3)), 1.0]


N_FEATURES = 8


@dataclass
class Model:
    lexicon: Lexicon
    weights: np.ndarray
    bias: float

    def score(self, text: str | None) -> float:
        z = self.bias + float(np.dot(self.weights, self.lexicon.features(text)))
        return float(1.0 / (1.0 + np.exp(-np.clip(z, -30, 30))))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, rounds: int = 50):
    """Weights and bias of a ridge logistic regression, by Newton's method."""
    scale = np.maximum(np.abs(x).max(axis=0), 1e-9)
    a = np.column_stack([x / scale, np.ones(len(x))])
    keep, w = np.diag([ridge] * x.shape[1] + [1e-6]), np.zeros(x.shape[1] + 1)
    for _ in range(rounds):
        p = 1.0 / (1.0 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + keep, a.T @ (y - p) - keep @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1] / scale, float(w[-1])


def _counts(texts: DataFrame, terms_in) -> dict[str, int]:
    """Texts that hold each term; counted by task, then summed."""

    def run(batches):
        counts = Counter()
        for b in batches:
            for t in b.column(0):
                counts.update(terms_in(t.as_py()))
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()),
                                          pa.array(list(counts.values()), pa.int64())],
                                         names=["term", "n"])

    got = (texts.select("text").mapInArrow(run, "term string, n long").groupBy("term")
           .agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_TEXTS).toArrow())
    return dict(zip(got["term"].to_pylist(), got["n"].to_pylist()))


def _lexicon(toxic: dict[str, int], clean: dict[str, int], n_toxic: int, n_clean: int) -> Lexicon:
    rows = []
    for term, a in toxic.items():
        b = clean.get(term, 0)
        odds = (a + 0.5) / (n_toxic + 1) / ((b + 0.5) / (n_clean + 1))
        share = n_toxic / (n_toxic + n_clean)
        g2 = 2 * (a * np.log(a / ((a + b) * share))
                  + (b * np.log(b / ((a + b) * (1 - share))) if b else 0.0))
        if odds >= MIN_ODDS and g2 >= MIN_EVIDENCE:
            rows.append((g2, term, float(np.log(odds))))
    rows = sorted(rows, reverse=True)[:MAX_TERMS]
    return Lexicon({t: w for _, t, w in rows if t[-1] != "*"},
                   {t[:-1]: w for _, t, w in rows if t[-1] == "*"})


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """The model of a bounded sample: labelled rows (``labels.toxic`` of the same
    doc_id; the largest, if there are several) with the smallest hashed ids, each
    different text once. Rows with a null id, text or label are not used; without
    rows of both labels every text scores the share of toxic ones. Runs jobs; what
    reaches the driver is bounded by the sample."""
    marks = (labels.where("doc_id is not null and toxic is not null").groupBy("doc_id")
             .agg(F.max("toxic").alias("toxic")))
    ids = docs.select("doc_id").join(marks, "doc_id").distinct()
    ids = cut(ids.withColumn("u", drawn("doc_id")), "labelled-rows")
    # twice the share that is needed, so that sorting never sees more
    few = ids.where(F.col("u") * ids.count() < 2 * fit_rows)
    sample = cut(few.orderBy("u", "doc_id").limit(fit_rows).drop("u"), "fit-rows")
    rows = cut(docs.select("doc_id", "text").where("text is not null")
               .join(F.broadcast(sample), "doc_id").groupBy(F.md5("text").alias("tag"))
               .agg(F.max("toxic").alias("toxic"), F.max("text").alias("text"))
               .select("text", "toxic"), "fit-texts")
    n = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
    n_toxic, n_clean = n.get(1, 0), n.get(0, 0)
    if not n_toxic or not n_clean:
        share = n_toxic / max(1, n_toxic + n_clean)
        return Model(Lexicon(), np.zeros(N_FEATURES),
                     float(np.log((share + 1e-9) / (1 - share + 1e-9))))
    toxic = _counts(rows.where("toxic = 1"), lambda t: terms_of(words_of(t)))
    wanted = Shared(rows.sparkSession, frozenset(toxic))
    clean_rows = rows.where("toxic = 0")
    clean = _counts(clean_rows, lambda t: terms_of(words_of(t)) & wanted.value)
    lexicon = _lexicon(toxic, clean, n_toxic, n_clean)
    shared = Shared(rows.sparkSession, lexicon)

    def usual(text):
        words = words_of(text)
        return {words[i].strip(EDGE) for i, kind, _ in shared.value.matches(words) if kind == 2}

    lexicon.usual = frozenset(_counts(clean_rows, usual))
    final = Shared(rows.sparkSession, lexicon)
    kinds = T.StructType([T.StructField("x", T.ArrayType(T.DoubleType()))])
    table_ = add_columns(rows, "text", kinds.fields, lambda: lambda texts: [
        pa.array([final.value.features(t.as_py()) for t in texts], pa.list_(pa.float64()))],
        ["toxic"]).toArrow()
    x = np.array(table_["x"].to_pylist())
    weights, bias = _logistic(x, table_["toxic"].to_numpy().astype(float))
    return Model(lexicon, weights, bias)


def score(df: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD,
          keep: list[str] | None = None) -> DataFrame:
    """``df`` (or its columns ``keep``) with score (0 to 1) and predicted (1 if
    score >= threshold). Null and empty texts score as texts without matches. Row
    by row: repeated rows, null ids and other columns pass through; columns named
    score or predicted are replaced."""
    shared = Shared(df.sparkSession, model)

    def make():
        own = shared.value

        def run(texts):
            s = [own.score(t.as_py()) for t in texts]
            return [pa.array(s, pa.float64()), pa.array([int(x >= threshold) for x in s], pa.int32())]
        return run

    return add_columns(df, text_col, [T.StructField("score", T.DoubleType()),
                                      T.StructField("predicted", T.IntegerType())], make, keep)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learn = docs.where(~held_out()).select("doc_id", "text")
    model = fit(learn, table(spark, sf_dir, "labels"))
    return score(docs.select("doc_id", held_out().alias("held_out"), "text"), model,
                 keep=["doc_id", "held_out"])
