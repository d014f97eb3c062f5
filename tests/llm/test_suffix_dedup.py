import hashlib
import random

from hypothesis import given, settings
from hypothesis import strategies as st

import numpy as np
from heddle.llm import suffix_dedup
from heddle.llm.suffix_dedup import removal_digest, remove_repeats
from heddle.llm.windows import PIECE, sliding_argmin

SCHEMA = "doc_id long, text string, lang string, doc int"


def brute(rows, n=200):
    """Per row (n_bytes, n_removed, n_spans, sha256 of the rest) by looking at every window."""
    texts = [(t or "").encode() for _, t in rows]
    seen = {}
    for t in texts:
        for i in range(len(t) - n + 1):
            seen[t[i : i + n]] = seen.get(t[i : i + n], 0) + 1
    out = []
    for (d, _), t in zip(rows, texts):
        gone = [False] * len(t)
        for i in range(len(t) - n + 1):
            if seen[t[i : i + n]] > 1:
                gone[i : i + n] = [True] * n
        kept = bytes(b for b, g in zip(t, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def rows():
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdeéß€") for _ in range(r.randint(2, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    base, passage, other = text(160), text(45), text(60)
    near = [base[:k] + "#" + base[k + 1 :] for k in range(40, 700, 110)]
    out = [(1, base), (2, base), *((10 + i, t) for i, t in enumerate(near)), (30, text(50) + passage + text(20)), (31, passage + other), (32, other + text(9) + passage + passage)]
    out += [(40, None), (41, ""), (42, "x" * 199), (43, "x" * 200), (44, "y" * 201), (45, "ab" * 300), (46, text(300)), (46, text(30)), (47, base), (47, base), (None, text(40)), (None, passage)]
    long = text(14_000)
    return out + [(50, long), (51, long[3000:71_000]), (52, text(50) + long[40_000:40_300])]


def test_against_all_windows(spark):
    data = rows()
    docs = spark.createDataFrame([(d, t, "en", 1) for d, t in data], SCHEMA)
    got = sorted((tuple(r) for r in removal_digest(docs).collect()), key=repr)
    assert got == brute(data)


def test_names_with_many_runs_go_window_by_window(spark, monkeypatch):
    data = rows()
    docs = spark.createDataFrame([(d, t, "en", 1) for d, t in data], SCHEMA)
    plain = {(r.doc, r.mark): (r.starts, r.ends) for r in suffix_dedup.repeated_spans(docs).collect()}
    wide = {(r.doc, r.mark): (r.starts, r.ends) for r in suffix_dedup.repeated_spans(docs, hot_runs=2).collect()}
    assert wide == plain


def test_remove_keeps_columns_and_nulls(spark):
    t = "abcdefghij" * 30
    u = "".join(chr(0x4E00 + i) for i in range(200))
    docs = spark.createDataFrame([(1, t + "tail", "en", 7), (2, u + "x", "fr", 8), (3, "é" + u, None, 9), (4, None, None, None)], SCHEMA)
    got = {r.doc_id: r for r in remove_repeats(docs).collect()}
    assert remove_repeats(docs).columns == docs.columns
    assert got[1].text == "tail" and got[2].text == "x" and got[3].text == "é" and got[4].text is None and got[3].doc == 9


def test_empty_table(spark):
    assert removal_digest(spark.createDataFrame([], SCHEMA)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=60), st.integers(1, 9))
def test_sliding_argmin_finds_the_first_least(values, width):
    h = np.array(values, np.uint64) << np.uint64(18)
    want = [i + int(np.argmin(values[i : i + width])) for i in range(len(values) - width + 1)]
    assert sliding_argmin(h, width).tolist() == want
    assert PIECE + 400 < 1 << 18
