import random

import numpy as np
import pytest

from driftpool.llm import quality
from tests.llm.helpers import docs, odd_rows, words


def matrix(texts):
    parts = [(k, part) for k, t in enumerate(texts) for part in quality.cut_text(t)]
    chunks = np.zeros((len(parts), quality.CHUNK), np.uint8)
    for row, (_, part) in zip(chunks, parts):
        row[:len(part)] = part
    return chunks, np.array([k for k, _ in parts])


@pytest.mark.parametrize("n", [0, 1, 15, 16, 17, 511, 512, 513, 1008, 1009, 5000])
def test_chunks_cover_the_text_and_overlap(n):
    raw = bytes(random.Random(n).randrange(256) for _ in range(n))
    parts = [p.tobytes() for p in quality.cut_text(raw)]
    step = quality.CHUNK - quality.OVERLAP
    assert b"".join(p[:step] for p in parts[:-1]) + parts[-1] == raw
    assert all(len(p) == quality.CHUNK for p in parts[:-1])
    assert all(a[step:] == b[:quality.OVERLAP] for a, b in zip(parts, parts[1:]))


def test_gradients_equal_differences():
    r = np.random.default_rng(0)
    net = quality.Net(*[x.astype(np.float64) + r.standard_normal(x.shape) * 0.05
                        for x in quality.Net.start().layers()])
    net.byte[0] = 0
    chunks, owner = matrix([b"hello world " * 200, b"x", b"", b"something ### else" * 9])
    y, weight = np.array([1.0, 0, 1, 0]), np.array([1.0, 2, 0.5, 1])
    dropped = (r.random((4, quality.FILTERS)) > 0.2) / 0.8
    loss = lambda: net.gradients(chunks, owner, y, weight, dropped)[0]
    grads = net.gradients(chunks, owner, y, weight, dropped)[1]
    for layer, (x, g) in enumerate(zip(net.layers(), grads)):
        assert x.shape == g.shape
        for _ in range(6):
            at = (ord(r.choice(list("helo w"))), r.integers(quality.EMBED)) if layer == 0 else tuple(
                r.integers(0, s) for s in x.shape)
            x[at] += 1e-6
            up = loss()
            x[at] -= 2e-6
            slope = (up - loss()) / 2e-6
            x[at] += 1e-6
            assert abs(slope - g[at]) < 1e-4 * max(1, abs(slope)), layer


def sample(n=600, bad_share=6):
    """Plain texts, and every ``bad_share``-th one with a few noisy words somewhere."""
    out = []
    for i in range(n):
        ws = words(i, 30 + i % 90, 3000).split()
        bad = i % bad_share == 0
        if bad:
            for k in range(3):
                ws[(i * 7 + k) % len(ws)] += "###&&&"
        out.append((" ".join(ws).encode(), int(not bad)))
    return out


@pytest.fixture(scope="module")
def net():
    net = quality.Net.start()
    rows = sample()
    losses = net.learn([t for t, _ in rows], np.array([y for _, y in rows], np.float32))
    assert losses[-1] < 0.5 * losses[0]
    return net


def test_learns_and_reruns_agree(net):
    rows = [(words(10_000 + i, 60, 3000).encode(), 1) for i in range(50)]
    rows += [(t + b" w1###&&& w2###&&& w3###&&&", 0) for t, _ in rows]
    got = net.scores(t for t, _ in rows)
    assert np.mean((got >= 0.5) == np.array([y for _, y in rows])) > 0.95
    again = quality.Net.start()
    small = sample(100)
    for x in (again, other := quality.Net.start()):
        x.learn([t for t, _ in small], np.array([y for _, y in small], np.float32), 2)
    assert all(np.array_equal(a, b) for a, b in zip(again.layers(), other.layers()))


def test_every_place_of_a_long_text_is_read(net):
    """Noise in any one chunk changes the score; batches and neighbours do not."""
    clean = words(5, 40_000, 3000).encode()
    base = net.scores([clean])[0]
    for at in (0, 1000, len(clean) // 2, len(clean) - 40):
        assert net.scores([clean[:at] + b" w###&&& x###&&& " + clean[at:]])[0] != base
    texts = [clean, b"", b"w1", None, words(6, 300).encode()]
    alone = [net.scores([t])[0] for t in texts]
    assert np.allclose(net.scores(texts * 3), alone * 3, atol=1e-5)


def test_odd_rows(spark, net):
    rows = odd_rows()
    df = docs(spark, rows).withColumnRenamed("n", "score").withColumnRenamed("tag", "Predicted")
    got = quality.score(df, net)
    assert got.columns == [c for c in df.columns if c not in ("score", "Predicted")] + ["score", "predicted"]
    out = got.collect()
    assert len(out) == len(rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)
    assert quality.score(docs(spark, []), net).count() == 0


def test_odd_labels(spark):
    """Null, repeated and foreign labels; texts too long to learn from; one label only; none."""
    rows = odd_rows() + [(50, "y" * (quality.FIT_TEXT + 1), "en", "a")]
    marks = spark.createDataFrame([(None, 1), (6, None), (6, 1), (6, 0), (99, 1), (5, 0), (50, 1), (2, 0)],
                                  "doc_id long, quality int")
    net = quality.fit(docs(spark, rows), marks, epochs=1)
    assert 0 <= net.scores([None])[0] <= 1
    flat = quality.fit(docs(spark, rows), marks.where("quality = 0"))
    assert max(flat.scores([None, b"abc"])) < 0.01
    assert np.allclose(quality.fit(docs(spark, rows), marks.where("false")).scores([b"", b"x"]), 0.5)
    assert np.allclose(quality.fit(docs(spark, []), marks).scores([b"x"]), 0.5)


def test_query_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    rows = quality.query(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    got = rows.where("held_out and quality is not null").select("quality", "predicted", "score").toPandas()
    good, bad = got[got.quality == 1], got[got.quality == 0]
    assert (good.predicted == 1).mean() >= 0.98
    assert (bad.predicted == 0).mean() >= 0.8
    order = (bad.score.values[:, None] < good.score.values[None, :]).mean()
    assert order >= 0.98  # area under the curve
    assert rows.where("score is null").count() == 0
