import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from heddle.llm.lm_scoring import END, LOWER, START, Ppm, Trie, _merged, _mixed, _pack_sorted, _summed, _Table, _unpack_sorted, score_documents

SCHEMA = "doc_id long, text string, score double, word string"


def docs(n=40):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcé ") for _ in range(r.randint(1, 6)))
    out = [(i, " ".join(word() for _ in range(r.randint(0, 30))), 1.0, "x") for i in range(n)]
    return out + [(100, None, 1.0, "x"), (101, "", None, None), (None, "AbC abc", 1.0, "x"), (5, "Again again", 0.0, "y"), (102, "zzz \x0b qq\n" * 50, 1.0, "x")]


@pytest.mark.parametrize("order", [1, 3, 6])
def test_scores_equal_the_trie_and_the_unigram_formula(spark, order):
    rows = docs()
    got = sorted((tuple(r) for r in score_documents(spark.createDataFrame(rows, SCHEMA), order=order).collect()), key=repr)
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 5 == 1
    trie, counts = Trie(order), Counter()
    for d, t, *_ in rows:
        if not held(d):
            data = bytes([START]) * order + (t or "").encode().translate(LOWER)
            for i, s in enumerate([*data[order:], END]):
                trie.learn(data[i : i + order], s)
            counts.update((t or "").encode().translate(LOWER).split() + [b"\n"])
    n, v = sum(counts.values()), len(counts)
    want = []
    for d, t, *_ in rows:
        tokens = (t or "").encode().translate(LOWER).split() + [b"\n"]
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens)
        want.append((d, held(d), len(tokens), sum(w in counts for w in tokens), n, base, trie.code((t or "").encode(), adaptive=False)))
    for g, w in zip(got, sorted(want, key=repr), strict=True):
        assert g[:5] == w[:5] and g[5:] == pytest.approx(w[5:])
    assert any(held(d) for d, *_ in rows)


def test_the_model_is_a_distribution():
    trie = Trie(2)
    for s in b"abracadabra":
        trie.learn(b"ab", s)
        trie.learn(b"bc", s ^ 1)
    for context in (b"ab", b"bc", b"zz", b"ac"):
        assert sum(10 ** trie.log10(context, s) for s in range(255)) == pytest.approx(1)


def test_adaptive_code_shortens_repetition():
    text = b"the same words again. " * 20
    assert Trie(5).code(text, adaptive=True) / len(text) > Trie(5).code(text[:22], adaptive=True) / 22


def test_table_finds_all_and_only_its_keys():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**63, 5000, dtype=np.uint64))
    t = _Table(keys[::2])
    assert (t.find(keys[::2]) == np.arange(len(keys[::2]))).all() and (t.find(keys[1::2]) == -1).all()
    assert (_Table(keys[:0]).find(keys) == -1).all()


def test_empty_model(spark):
    assert Ppm([(np.empty(0, np.uint64), np.empty(0, np.int64))] * 3).texts([b"ab"], 2)[0] == pytest.approx(-3 * math.log10(255))
    held = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 5 == 1)
    row = score_documents(spark.createDataFrame([(held, "ab c")], "doc_id long, text string")).collect()[0]
    assert row.train_tokens == row.n_known == 0 and row.score == pytest.approx(-5 * math.log10(255))


def test_packed_counts_beyond_their_bits():
    keys, counts = np.array([5, 2, 5, 9], np.uint64), np.array([70_000, 1, 200_000, 0])
    assert [x.tolist() for x in _merged(keys, counts, 48)] == [x.tolist() for x in _summed([(keys, counts)])] == [[2, 5, 9], [1, 270_000, 0]]
    for bits in (16, 32, 48, 56):
        x = np.random.default_rng(1).integers(0, 1 << bits, 1000, dtype=np.uint64)
        assert (_mixed(_mixed(x, bits), bits, back=True) == x).all()
        assert (_unpack_sorted(_pack_sorted(np.sort(x)), 1000) == np.sort(x)).all()


def test_empty_table(spark):
    assert score_documents(spark.createDataFrame([], SCHEMA)).count() == 0


def test_the_model_has_no_bound_and_blocks_do_not_matter(spark):
    rows = docs(30)
    frame = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    one, many = (sorted((tuple(r) for r in score_documents(frame, order=5, **more).collect()), key=repr) for more in ({}, {"block_bytes": 100}))
    for a, b in zip(one, many, strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:])
    trie = Trie(5)
    for d, t, *_ in rows:
        if zlib.crc32(("" if d is None else str(d)).encode()) % 5 != 1:
            data = bytes([START]) * 5 + (t or "").encode().translate(LOWER)
            for i, s in enumerate([*data[5:], END]):
                trie.learn(data[i : i + 5], s)
    assert sorted(r[6] for r in many) == pytest.approx(sorted(trie.code((t or "").encode(), adaptive=False) for _, t, *_ in rows))
