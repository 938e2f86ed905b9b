import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from driftpool.llm import substrings
from tests.llm.helpers import docs, odd_rows, words


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute(texts, window):
    count = Counter()
    ws = [split(t) for t in texts]
    for w in ws:
        count.update(tuple(w[i:i + window]) for i in range(len(w) - window + 1))
    out = []
    for t, w in zip(texts, ws):
        gone = set()
        for i in range(len(w) - window + 1):
            if count[tuple(w[i:i + window])] > 1:
                gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((None if t is None else kept, len(w), len(gone)))
    return out


def run(spark, rows, window):
    got = substrings.remove_repeats(docs(spark, rows), window=window)
    return sorted(((r.doc_id, r.text, r.n_words, r.n_removed) for r in got.collect()), key=str)


def expect(rows, window):
    return sorted(((r[0], *x) for r, x in zip(rows, brute([r[1] for r in rows], window))), key=str)


@pytest.mark.parametrize("window", [1, 2, 5, 8, 35])
def test_equals_brute_force(spark, window):
    r = random.Random(window)
    shared = [words(100 + i, r.randrange(2, 60)) for i in range(6)]
    rows = []
    for i in range(40):
        parts = [words(1000 + 9 * i + j, r.randrange(1, 25), 4 if i % 7 == 0 else 10_000) for j in range(3)]
        parts.insert(r.randrange(3), r.choice(shared))
        rows.append((i, r.choice([" ", "\n", "\t "]).join(parts), "en", "a"))
    rows += [(100, "same " * 90, "en", "a"), (101, words(7, 50), "en", "a"), (102, words(7, 50), "en", "a")]
    assert run(spark, rows, window) == expect(rows, window)


def test_odd_rows(spark):
    rows = odd_rows()
    assert run(spark, rows, 35) == expect(rows, 35)
    assert run(spark, [], 35) == []


def test_small_chunks_and_merge_joins_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(substrings, "CHUNK_WORDS", 64)
    monkeypatch.setattr(substrings, "BROADCAST_BYTES", 0)
    rows = [(i, words(i % 9, 40) + " " + words(50 + i, 30), "en", "a") for i in range(30)]
    assert run(spark, rows, 7) == expect(rows, 7)


def test_text_in_pieces_hashes_like_whole(monkeypatch):
    text = words(3, 5000).encode()
    whole = substrings.word_hashes(text, 2)
    monkeypatch.setattr(substrings, "PIECE", 100)
    parts = substrings.word_hashes(text, 2)
    # a word's hash depends on its bytes alone
    assert all((a == b).all() for a, b in zip(whole, parts))
    names = {}
    for w, h in zip(text.split(), whole[0].tolist()):
        assert names.setdefault(w, h) == h
    assert len(set(names.values())) == len(names)


def test_window_hashes_depend_on_their_words_alone():
    x = substrings.word_hashes(words(1, 200).encode(), 1)[0]
    for n in (1, 2, 3, 18, 35, 200):
        got = substrings.LANES[0].windows(x, n)
        assert len(got) == 200 - n + 1
        for p in (0, (200 - n) // 2, 200 - n):
            assert substrings.LANES[0].windows(x[p:p + n], n)[0] == got[p]
    assert len(substrings.LANES[0].windows(x[:3], 4)) == 0


def test_last_bucket_keeps_its_keys():
    keys = np.array([0, 5, 2**63, 2**64 - 1], np.uint64)
    runs = dict(substrings._by_bucket(keys, 60, 16))
    assert {b: keys[s].tolist() for b, s in runs.items()} == {0: [0, 5], 8: [2**63], 15: [2**64 - 1]}


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = {(r.doc_id, n, gone, hashlib.sha256((kept or "").encode()).hexdigest())
            for r, (kept, n, gone) in zip(rows, brute([r.text for r in rows], 35))}
    assert {tuple(r) for r in substrings.query(spark, sf).collect()} == want
