import random
import tracemalloc

import numpy as np

from driftpool.llm import decontam
from tests.llm.helpers import docs, odd_rows, words


def smith_waterman(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1))
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (decontam.MATCH if x == y else decontam.MISMATCH),
                          h[i - 1, j] + decontam.GAP, h[i, j - 1] + decontam.GAP)
    return h.max()


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def test_alignment_equals_the_full_table():
    r = random.Random(1)
    for _ in range(200):
        a = [r.randrange(1, 6) for _ in range(r.randrange(1, 15))]
        b = [r.randrange(0, 6) for _ in range(r.randrange(0, 40))]
        score, end = decontam.align(np.array(a), np.array(b))
        assert score == smith_waterman(a, b) and 0 <= end <= len(b)


def edited(text, r, share):
    out = []
    for w in text.split():
        x = r.random()
        if x < share / 3:
            continue
        out.append("changed" if x < share * 2 / 3 else w)
        if x > 1 - share / 3:
            out.append("added")
    return " ".join(out)


def test_finds_exact_and_edited_copies_and_no_other(spark):
    r = random.Random(3)
    bench = [(i, words(10_000 + i, 40, 4000)) for i in range(20)]
    rows, want = [], set()
    for i in range(150):
        text = words(i, 200, 4000)
        if i % 3 == 0:
            item = r.randrange(20)
            copy = bench[item][1] if i % 2 else edited(bench[item][1], r, 0.2)
            text = f"{words(900 + i, 50, 4000)}, {copy.upper()}! {text}"
            score = smith_waterman(decontam.words_of(bench[item][1]), decontam.words_of(copy))
            if score / (decontam.MATCH * 40) >= decontam.MIN_SCORE:
                want.add((i, item))
        rows.append((i, text, "en", "a"))
    got = decontam.matches(docs(spark, rows), items(spark, bench)).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and len(want) >= 45
    for m in got:
        own = decontam.words_of(rows[m.doc_id][1])[m.first_word:m.end_word]
        item = decontam.words_of(bench[m.item_id][1])
        assert m.score == smith_waterman(item, own) / (decontam.MATCH * len(item))
        assert 48 <= m.first_word <= 55


def test_periodic_edits_are_found_beside_an_exact_copy(spark):
    """Every 4th, 5th or 6th word replaced, in one text; an exact copy of the item in another."""
    kinds = [(step, at, size) for step in (4, 5, 6) for at in range(step) for size in (15, 40)]
    bench = [(i, words(20_000 + i, size, 4000)) for i, (_, _, size) in enumerate(kinds)]
    rows, best = [], {}
    for (i, text), (step, at, size) in zip(bench, kinds):
        copy = " ".join("changed" if n % step == at else w for n, w in enumerate(text.split()))
        rows.append((i, f"{words(i, 30, 4000)} {copy} {words(500 + i, 30, 4000)}", "en", "a"))
        rows.append((100 + i, f"{words(900 + i, 9, 4000)} {text}", "en", "a"))
        own, other = decontam.words_of(text), decontam.words_of(rows[-2][1])
        best[i, i] = smith_waterman(own, other) / (decontam.MATCH * size)
        best[100 + i, i] = 1.0
    got = {(r.doc_id, r.item_id): r.score for r in
           decontam.matches(docs(spark, rows), items(spark, bench)).collect()}
    assert min(best.values()) >= decontam.MIN_SCORE and got == best


def test_long_excerpts_of_long_items_are_found(spark):
    bench = [(1, words(41, 57, 4000)), (2, words(42, 300, 4000))]
    cut = lambda item, lo, hi: " ".join(bench[item - 1][1].split()[lo:hi])
    rows = [(1, f"{words(1, 30, 4000)} {cut(1, 20, 42)} {words(2, 30, 4000)}", "en", "a"),
            (2, f"{words(3, 30, 4000)} {cut(2, 100, 200)}", "en", "a"),
            (3, f"{words(4, 30, 4000)} {cut(2, 100, 115)} {words(5, 30, 4000)}", "en", "a")]
    got = {(r.doc_id, r.item_id) for r in decontam.matches(docs(spark, rows), items(spark, bench)).collect()}
    assert got == {(1, 1), (2, 2)}
    assert [r.doc_id for r in decontam.drop_leaks(docs(spark, rows), items(spark, bench)).collect()] == [3]


def test_an_item_in_every_text_is_still_found(spark):
    bench = [(1, words(5, 30, 4000))]
    rows = [(i, f"{words(i, 20)} {bench[0][1]} {words(77 + i, 20)}", "en", "a") for i in range(60)]
    got = decontam.matches(docs(spark, rows), items(spark, bench))
    assert {r.doc_id for r in got.collect()} == set(range(60))


def test_joins_give_the_same_as_the_broadcast(spark, monkeypatch):
    """Copies, edited ones, common phrases, repeated n-grams, equal items, repeated rows."""
    r = random.Random(8)
    bench = [(i, words(10_000 + i, 20 + 3 * i, 4000)) for i in range(12)]
    bench += [(20, "a b c d " * 12), (21, "a b c d " * 12), (22, bench[0][1]), (23, "of the the " + words(1, 9))]
    rows = [(i, f"{words(i, 30, 200)} {edited(bench[i % 16][1], r, i % 3 * 0.1)} of the the {words(i, 9)}", "en", "a")
            for i in range(40)]
    rows += [rows[0], (41, "a b c d " * 40, "en", "a"), (99, words(5, 30), "en", "a")]
    run = lambda: sorted(map(str, map(tuple, decontam.matches(docs(spark, rows), items(spark, bench)).collect())))
    leaks = lambda: sorted(r.doc_id for r in decontam.drop_leaks(docs(spark, rows), items(spark, bench)).collect())
    whole, left = run(), leaks()
    monkeypatch.setattr(decontam, "BROADCAST_BYTES", 0)
    assert run() == whole and len(whole) > 40
    assert leaks() == left and 99 in left


def test_a_table_of_edited_copies_equals_brute_force(spark):
    """Every (text, item) that shares a seed, scored by aligning the whole text."""
    r = random.Random(12)
    bench = [(i, words(30_000 + i, r.choice([8, 15, 40, 90]), 900)) for i in range(25)]
    rows = []
    for i in range(120):
        parts = [words(50_000 + i, r.randrange(60), 900)]
        for _ in range(r.randrange(3)):
            parts += [edited(bench[r.randrange(25)][1], r, r.choice([0, 0.1, 0.3])), words(i, r.randrange(40), 900)]
        rows.append((i, " ".join(parts), "en", "a"))
    want = {}
    for i, item in bench:
        own = decontam.words_of(item)
        grams = {tuple(own[k:k + 3]) for k in range(len(own) - 2)}
        number = {}
        a = np.array([number.setdefault(w, len(number) + 1) for w in own])
        for d, text, *_ in rows:
            ws = decontam.words_of(text)
            if grams & {tuple(ws[k:k + 3]) for k in range(len(ws) - 2)}:
                score = decontam.align(a, decontam.numbers(ws, number))[0] / (decontam.MATCH * len(own))
                if score >= min(decontam.MIN_SCORE, decontam.MIN_WORDS / len(own)):
                    want[d, i] = score
    got = {(m.doc_id, m.item_id): m.score for m in
           decontam.matches(docs(spark, rows), items(spark, bench)).collect()}
    assert got == want and len(want) > 80


def test_repeats_cost_no_more_than_their_number():
    """An item of one word and of a phrase over and over, texts five times as long."""
    for phrase in (["x"], ["a", "b", "c", "d", "e"]):
        block = decontam.Items()
        block.add(1, [w.encode() for w in phrase] * (4000 // len(phrase)))
        block.close()
        ids = decontam.numbers([w.encode() for w in phrase] * (20_000 // len(phrase)), block.number)
        tracemalloc.start()
        found = list(decontam.passages(ids, block, 0.4, 20))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 100e6
        assert [f[:2] for f in found] == [(0, 1.0)]


def test_odd_rows(spark):
    rows = odd_rows()
    bench = items(spark, [(1, None), (2, ""), (3, "one two"), (None, words(2, 50)), (4, words(1, 60)),
                          (5, words(1, 60))])
    df = docs(spark, rows)
    got = [(r.doc_id, r.item_id) for r in decontam.matches(df, bench).collect()]
    assert sorted(got, key=str) == sorted([(6, 4), (6, 4), (6, 5), (6, 5), (7, 4), (7, 5), (None, None)], key=str)
    left = decontam.drop_leaks(df, bench)
    assert left.columns == df.columns and left.count() == len(rows) - 4
    assert decontam.matches(df, bench.where("false")).count() == 0
    assert decontam.drop_leaks(df, bench.where("false")).count() == len(rows)
    assert decontam.matches(docs(spark, []), bench).count() == 0


def test_query_finds_all_exact_passages(spark):
    sf = "/root/testdata/sf0.01"
    bench = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    texts = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    planted = {r.doc_id for r in texts if any(b in (r.text or "") for b in bench)}
    assert {r.doc_id for r in decontam.query(spark, sf).collect()} == planted
