import random

import public_tokenizers
import pytest
import sentencepiece

from driftpool.llm import tokencount
from tests.llm.helpers import docs, odd_rows, words

ODD = ["", "a", " ", "  ", "a  b", "\n", "\n\n a", "x▁y", " ▁ a", "日本語 テスト", "👩‍👩‍👧 ok", "a\tb\r\n c",
       "<s>[INST]</s>", "é", "​", "x" * 300, " " * 40 + "a", "\x00", "straße", "$$$ ###***", "<0x0A>", "▁"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(tokencount.VOCABULARY))


@pytest.fixture(scope="module")
def counter():
    return tokencount.PrefixCounter(public_tokenizers.path(tokencount.VOCABULARY))


@pytest.mark.parametrize("text", ODD)
def test_every_prefix_equals_the_library(counter, library, text):
    want = [len(library.encode(text[:i])) for i in range(len(text) + 1)]
    assert counter.prefixes(text).tolist() == want
    for limit in (0, 1, 2, 5):
        assert counter.within(*counter.units(text), limit) == max(
            i for i, n in enumerate(want) if n <= limit)


def test_random_texts_equal_the_library(counter, library):
    r = random.Random(1)
    alphabet = ["th", "er", "ing", "on", "é", "ß", "z", "Q", " ", " ", "  ", ".", "\n", "1", "中", "the ", "un"]
    for _ in range(300):
        text = "".join(r.choice(alphabet) for _ in range(r.randrange(60)))
        assert counter.prefixes(text).tolist() == [len(library.encode(text[:i]))
                                                   for i in range(len(text) + 1)]


def test_forgetting_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(tokencount, "REMEMBERED", 5)
    small = tokencount.PrefixCounter(public_tokenizers.path(tokencount.VOCABULARY))
    text = words(1, 400)
    assert small.units(text)[1][-1] == len(library.encode(text))


def test_odd_rows(spark, library):
    rows = odd_rows()
    df = docs(spark, rows).withColumnRenamed("n", "n_tokens")
    out = tokencount.count_tokens(df, limit=20, store_prefixes=True)
    assert out.columns == [c for c in df.columns if c != "n_tokens"] + [
        "n_tokens", "over_limit", "limit_chars", "prefix_tokens"]
    got = out.collect()
    assert len(got) == len(rows)
    for r in got:
        n = len(library.encode(r.text or ""))
        assert r.n_tokens == n and r.over_limit == (n > 20) and r.prefix_tokens[-1] == n
        assert len(r.prefix_tokens) == len(r.text or "") + 1
        assert r.limit_chars == max(i for i, x in enumerate(r.prefix_tokens) if x <= 20)
    assert tokencount.count_tokens(docs(spark, [])).count() == 0


def test_query_equals_the_library(spark, library):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in tokencount.query(spark, sf).collect():
        assert r.n_tokens == len(library.encode(texts[r.doc_id]))
        assert r.n_bytes == len(texts[r.doc_id].encode()) and r.over_limit == (r.n_tokens > 4096)


def test_limits_are_read_off_the_stored_counts(counter, library, monkeypatch):
    """Once a text's units are counted, no prefix question walks or encodes anything."""
    text = words(3, 200) + " " + "x" * 100 + " é 日本"
    parts, totals = counter.units(text)
    assert sum(map(len, parts)) == len(text) + 1 and totals[-1] == len(library.encode(text))
    monkeypatch.setattr(counter, "_states", None)
    want = [len(library.encode(text[:i])) for i in range(0, len(text) + 1)]
    for limit in (0, 1, 17, 100, want[-1] - 1, want[-1], 10**6):
        assert counter.within(parts, totals, limit) == max(i for i, n in enumerate(want) if n <= limit)
