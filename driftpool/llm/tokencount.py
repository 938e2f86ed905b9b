"""Token counts at every prefix of a text (operator 5).

Method: dynamic programming over prefixes. With byte-pair merging by score, a
sequence of pieces is the encoding of its text exactly if every two neighbours
are what their own concatenation encodes to. The encoding of a prefix therefore
ends in the one piece that agrees with the last piece of the prefix before it,
and its token count is that prefix's count plus one (plus a character's bytes,
where the vocabulary lacks the character). Counts of all prefixes come from one
walk, and answer length, budget and truncation questions without encoding again.

No piece has a space behind another character, so texts fall into units (spaces
and the word after them) that encode independently; the counts of a unit's prefixes are
stored and remembered across texts, within a bound, and a text's totals, limits and
prefixes are read off them. Texts are counted row by row in Arrow
batches, whole, without a shuffle.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftpool.llm.common import add_columns, table

QUERY_NAME = "op5_token_counts"
ORACLE_SQL = None  # tests hold it against the tokenizer's own library
VOCABULARY, LIMIT = "piece_bpe_32k.model", 4096
#: units and pairs remembered by a worker before it starts anew, and the longest of them
REMEMBERED, LONGEST = 500_000, 48
ID_BITS = 17
LAST = (1 << ID_BITS) - 1

UNIT = re.compile(r"\n| *[^ \n]+| +")


class PrefixCounter:
    """Counts for one sentencepiece BPE model with byte fallback. Texts are read
    with a space put before them and spaces standing for the model's space mark.

    A prefix's state is its token count times 2^ID_BITS plus the number of its last
    piece: 0 at the start and after a character outside the vocabulary, where
    pieces never merge across."""

    def __init__(self, model_file: str):
        import sentencepiece

        self.model = m = sentencepiece.SentencePieceProcessor(model_file=model_file)
        plain = [m.id_to_piece(i).replace("▁", " ") for i in range(m.get_piece_size())
                 if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]
        if any(re.search(r"[^ ] |\n", p) for p in plain) or len(plain) >> ID_BITS:
            raise ValueError("the model has pieces across words or lines, or too many")
        self.names = ["", *plain]
        self._automaton(plain)
        self.agree: dict[int, bool] = {}
        self.known: dict[str, bytes] = {}

    def _automaton(self, pieces: list[str]) -> None:
        """All pieces that end at a character, by one step a character: children and
        fallback of each node of the pieces' trie, and the (length, number) of the
        pieces that end there, longest first."""
        self.children, self.ending, self.fallback = [{}], [()], [0]
        for number, piece in enumerate(pieces, 1):
            node = 0
            for ch in piece:
                if ch not in self.children[node]:
                    self.children[node][ch] = len(self.children)
                    self.children.append({}), self.ending.append(()), self.fallback.append(0)
                node = self.children[node][ch]
            self.ending[node] = ((len(piece), number),)
        queue = list(self.children[0].values())
        for node in queue:
            self.ending[node] += self.ending[self.fallback[node]]
            for ch, child in self.children[node].items():
                back = self.fallback[node]
                while back and ch not in self.children[back]:
                    back = self.fallback[back]
                self.fallback[child] = self.children[back].get(ch, 0)
                queue.append(child)

    @classmethod
    def of(cls, model_file: str) -> PrefixCounter:
        """The process's counter for a model: tasks of one worker share what it
        remembers."""
        made = cls.__dict__.get("made", {})
        if model_file not in made:
            made[model_file] = cls(model_file)
            cls.made = made
        return made[model_file]

    def _agrees(self, key: int) -> bool:
        """Whether two pieces, numbered in ``key``, stay apart, and whole, when
        encoded together."""
        if len(self.agree) >= REMEMBERED:
            self.agree.clear()
        pair = [x for x in (self.names[key >> ID_BITS], self.names[key & LAST]) if x]
        # behind a line break, which no piece holds, nothing is put before the text
        got = self.model.encode("\n" + "".join(pair), out_type=str)[2:]
        self.agree[key] = ok = [x.replace("▁", " ") for x in got] == pair
        return ok

    def _states(self, unit: str) -> list[int]:
        """The states of all prefixes of a unit, the empty one first."""
        children, ending, fallback, agree = self.children, self.ending, self.fallback, self.agree.get
        states, node = [0], 0
        for end, ch in enumerate(unit, 1):
            while ch not in children[node] and node:
                node = fallback[node]
            node = children[node].get(ch, 0)
            for size, piece in ending[node]:
                before = states[end - size]
                key = (before & LAST) << ID_BITS | piece
                ok = agree(key)
                if self._agrees(key) if ok is None else ok:
                    states.append((before >> ID_BITS) + 1 << ID_BITS | piece)
                    break
            else:  # a character outside the vocabulary: its bytes
                size = len(ch.encode("utf-8", "replace"))
                states.append((states[-1] >> ID_BITS) + size << ID_BITS)
        return states

    def _unit(self, unit: str) -> bytes | list[int]:
        """Tokens of every prefix of a unit, from one character on; remembered (a short
        unit's counts fit in bytes: a character has four bytes at most)."""
        counts = [x >> ID_BITS for x in self._states(unit)[1:]]
        if len(unit) <= LONGEST:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[unit] = counts = bytes(counts)
        return counts

    def units(self, text: str | None) -> tuple[list[bytes | list[int]], list[int]]:
        """The units of a text, each as the tokens of its prefixes, and the tokens up
        to the end of each: the exact count of every prefix of the text."""
        if not text:
            return [], []
        known, parts = self.known, []
        for u in UNIT.findall(" " + text.replace("▁", " ")):
            got = known.get(u)
            parts.append(self._unit(u) if got is None else got)
        return parts, list(accumulate([x[-1] for x in parts]))

    def prefixes(self, text: str | None) -> np.ndarray:
        """Tokens of ``text[:i]`` for every i from 0 to its length."""
        parts, totals = self.units(text)
        out = [np.zeros(1, np.int64)]
        for part, before in zip(parts, [0, *totals]):
            out.append(np.array(list(part), np.int64) + before)
        counts = np.concatenate(out)
        # the first position of the walk is the space put before the text
        return np.concatenate(([0], counts[2:])) if len(counts) > 1 else counts

    def within(self, parts: list[bytes | list[int]], totals: list[int], limit: int) -> int:
        """Length in code points of the text's longest prefix of at most ``limit``
        tokens, read off the stored counts. Beyond a unit that ends above the limit
        every prefix is longer."""
        at = bisect_right(totals, limit)
        size = sum(map(len, parts[:at])) - 1  # the space put before the text
        if at < len(parts):
            before = totals[at - 1] if at else 0
            size += max((i + 1 for i, n in enumerate(parts[at]) if before + n <= limit), default=0)
        return max(0, size)


def count_tokens(df: DataFrame, text_col: str = "text", limit: int = LIMIT,
                 model_file: str | None = None, keep: list[str] | None = None,
                 store_prefixes: bool = False) -> DataFrame:
    """``df`` (or its columns ``keep``) with n_tokens, over_limit (n_tokens >
    limit), limit_chars (code points of the longest prefix of at most ``limit``
    tokens) and, if ``store_prefixes``, prefix_tokens, the token counts of all
    prefixes from the empty one to the whole text.

    ``model_file`` is a path that executors can read; by default each looks up the
    public vocabulary. Null and empty texts have no tokens. Row by row: repeated
    rows, null ids and other columns pass through, columns of the new names are
    replaced."""

    def make():
        path = model_file
        if path is None:
            import public_tokenizers

            path = public_tokenizers.path(VOCABULARY)
        counter = PrefixCounter.of(path)

        def run(texts):
            n, fits, stored = [], [], []
            for t in texts:
                text = t.as_py()
                parts, totals = counter.units(text)
                n.append(totals[-1] if totals else 0)
                fits.append(len(text or "") if n[-1] <= limit
                            else counter.within(parts, totals, limit))
                if store_prefixes:
                    stored.append(counter.prefixes(text).astype(np.int32))
            out = [pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_()),
                   pa.array(fits, pa.int64())]
            return out + [pa.array(stored, pa.list_(pa.int32()))] * store_prefixes
        return run

    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType()),
              T.StructField("limit_chars", T.LongType())]
    if store_prefixes:
        fields.append(T.StructField("prefix_tokens", T.ArrayType(T.IntegerType())))
    return add_columns(df, text_col, fields, make, keep)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    return count_tokens(docs, keep=["doc_id", "n_bytes"])
