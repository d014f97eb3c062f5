from hypothesis import given, settings
from hypothesis import strategies as st

import numpy as np
from heddle.llm.words import hashed_words, sets_of


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab \n\té"), max_size=30), max_size=6))
def test_words_lines_and_sets(texts):
    h, line, text_of, number = hashed_words([t.encode() for t in texts])
    lines = [(i, n, x.encode().split()) for i, t in enumerate(texts) for n, x in enumerate(t.split("\n"))]
    assert list(zip(text_of.tolist(), number.tolist())) == [(i, n) for i, n, _ in lines]
    words = [(k, w) for k, (_, _, ws) in enumerate(lines) for w in ws]
    assert line.tolist() == [k for k, _ in words]
    names = {}
    for v, (_, w) in zip(h.tolist(), words):
        assert names.setdefault(w, v) == v
    assert len(set(names.values())) == len(names)
    s, sizes = sets_of(h, line, len(lines))
    assert sizes.tolist() == [len(set(ws)) for _, _, ws in lines]
    at = np.cumsum(sizes) - sizes
    assert [set(s[a : a + n].tolist()) for a, n in zip(at, sizes)] == [{names[w] for w in ws} for _, _, ws in lines]


def test_long_words_and_chunk_borders_hash_alike():
    from heddle.llm.words import CHUNK

    r = __import__("random").Random(5)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(1, 9))) for _ in range(90_000)] + ["x" * (CHUNK + 17), "end"]
    h, line, text_of, number = hashed_words([" ".join(words).encode()])
    assert len(h) == len(words) and set(line.tolist()) == {0}
    for i in (0, 1, 45_000, 89_999, 90_000, 90_001):
        assert hashed_words([b" " + words[i].encode()])[0][0] == h[i]
    several = [i for i, w in enumerate(words) if w == words[7]]
    assert len({int(h[i]) for i in several}) == 1


def test_parts_cut_by_bytes_and_keep_all_rows():
    import pyarrow as pa

    from heddle.llm.words import parts

    batch = pa.RecordBatch.from_arrays([pa.array(range(5)), pa.array(["a" * 10, None, "b" * 1000, "", "c" * 30])], ["i", "t"])
    got = [p.column(0).to_pylist() for p in parts(batch, 1, 64)]
    assert [i for p in got for i in p] == list(range(5)) and len(got) > 1 and list(parts(batch.slice(0, 0), 1)) == []


def test_spaces_lines_and_chunks_as_in_bytes_split(monkeypatch):
    from heddle.llm import words

    texts = [bytes(range(256)), b"", b"\n\n", b" a\tb\x0bc\x0cd\re\x08f\x0eg \x1f!", b"x" * 50 + b"\n" + b"yy " * 40, b"end"]
    plain = hashed_words(texts)
    monkeypatch.setattr(words, "CHUNK", 16)
    monkeypatch.setattr(words, "_POWERS", [])
    assert all(np.array_equal(a, b) for a, b in zip(plain, hashed_words(texts)))
    lines = [x for t in texts for x in t.split(b"\n")]
    want = [(k, w) for k, x in enumerate(lines) for w in x.split()]
    assert plain[1].tolist() == [k for k, _ in want]
    assert [int(hashed_words([w])[0][0]) for _, w in want] == plain[0].tolist()
    assert len(hashed_words([])[0]) == len(hashed_words([b" "])[0]) == 0
