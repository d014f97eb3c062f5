import random
import zlib

import numpy as np
import pytest

from heddle.llm.quality import BLOCK, FILTERS, HALF, STEP, _forward, _gradients, _padded, _pools, byte_features, fit, held_out_scores, keep_quality, probabilities, train


def corpus(n=400):
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7)))
    out = []
    for i in range(n):
        words = [word() for _ in range(r.randint(5, 200))]
        out.append((i, (" | " if i % 4 == 0 else " ").join(words), int(i % 4 != 0)))
    return out


def test_held_out_accuracy_and_defined_cases(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(900, None, "x"), (901, "", None), (None, "a b", "x"), (3, "again", "y"), (902, "x y " * 40_000, "z")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in rows] + [(None, 1, 0), (5, None, 0), (7777, 1, 1)], "doc_id long, quality int, toxic int")
    got = held_out_scores(docs, labels).collect()
    truth = {i: q for i, _, q in rows}
    held = [g for g in got if g.held_out and g.doc_id in truth]
    assert len(got) == 405 and all(0 <= g.score <= 1 and g.predicted == (g.score >= 0.5) for g in got)
    assert all(g.held_out == (zlib.crc32(str(g.doc_id).encode()) % 3 == 1) for g in got if g.doc_id is not None)
    assert np.mean([g.predicted == truth[g.doc_id] for g in held]) > 0.97
    model = train(docs, labels)
    kept = keep_quality(docs, model)
    assert kept.columns == docs.columns and 250 < kept.count() < 320


def test_gradients_agree_with_differences():
    r = random.Random(4)
    texts = [bytes(r.choice(b"abc |") for _ in range(r.choice((0, 3, 256, 700)))) for _ in range(6)]
    y = np.array([0, 1, 1, 0, 1, 0], np.float32)
    m = fit(texts, y, epochs=1)
    loss = lambda: float(np.mean(np.log1p(np.exp(np.where(y > 0, -1, 1) * _forward(m, texts)[0].astype(float)))))
    grads = _gradients(m, texts, y)
    for p, g in zip(m.parameters(), grads):
        for at in [tuple(x) for x in np.argwhere(np.abs(g) > 0.01)[:4]]:
            keep, e = p[at], 2e-3
            p[at] = keep + e
            up = loss()
            p[at] = keep - e
            down = loss()
            p[at] = keep
            assert g[at] == pytest.approx((up - down) / (2 * e), rel=0.2, abs=3e-3)


def test_score_depends_on_the_text_alone():
    m = fit([b"ab" * 50, b"c|d" * 50], np.array([1, 0], np.float32), epochs=2)
    texts = [b"", b"x" * 255, b"y" * 256, b"z" * 257, b"ab|" * 400]
    together = probabilities(m, texts)
    assert together == pytest.approx([probabilities(m, [t])[0] for t in texts], abs=1e-6)


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert held_out_scores(docs, labels).collect()[0].score == pytest.approx(0.5, abs=0.01)
    assert held_out_scores(docs.where("false"), labels).count() == 0


def plain(m, text):
    """The network by plain loops over one text."""
    n = max(1, -(-len(text) // HALF))
    vector = [byte_features()[b].astype(float) for b in text.ljust(n * HALF, b"\0")]
    step = [np.concatenate(vector[i : i + STEP]) for i in range(0, n * HALF, STEP)]
    halves = []
    for h in range(n):
        best = np.full(FILTERS, -np.inf)
        for s in range(h * HALF // STEP, (h + 1) * HALF // STEP):
            for f in range(FILTERS):
                y = step[s] @ m.w[:, f] + (step[s + 1] @ m.w[:, FILTERS + f] if s + 1 < len(step) else 0)
                best[f] = max(best[f], y)
        halves.append([max(0.0, x + b) for x, b in zip(best, m.b)])
    chunks = [[max(x, y) for x, y in zip(halves[h], halves[min(h + 1, n - 1)])] for h in range(n)]
    columns = list(zip(*chunks))
    logit = sum(v * x for v, x in zip(m.v, [*map(max, columns), *(sum(c) / n for c in columns), *map(min, columns)])) + m.c
    return 1 / (1 + np.exp(-logit))


def test_agrees_with_plain_loops():
    r = random.Random(9)
    texts = [bytes(r.choice(b"ab c|\n\x80") for _ in range(n)) for n in (0, 1, 255, 256, 257, 1000, 1500)]
    m = fit(texts, np.array([0, 1, 0, 1, 0, 1, 0], np.float32), epochs=1)
    assert probabilities(m, texts) == pytest.approx([plain(m, t) for t in texts], abs=1e-5)


def test_a_text_of_many_blocks():
    m = fit([b"ab" * 50, b"c|d" * 50], np.array([1, 0], np.float32), epochs=2)
    text = random.Random(1).randbytes(3 * BLOCK * HALF + 77)
    data, first = _padded([text])
    whole = _pools(m, data, first)[0]
    far = [_pools(m, data[i * HALF :], np.array([0]))[0][0] for i in (BLOCK - 1, BLOCK, 2 * BLOCK + 5)]
    assert np.allclose(whole[[BLOCK - 1, BLOCK, 2 * BLOCK + 5]], far, atol=1e-5)
