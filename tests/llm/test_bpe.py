import hashlib
import random

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from heddle.llm.bpe import decode, decode_documents, encode, encode_documents, encoding, pieces

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("ab c'sé  \n\t1٣中<|endoftext|>🙂"), max_size=120), st.integers(1, 20))
def test_cut_texts_have_the_same_ids(text, size):
    enc = encoding(PATH, PATTERN)
    assert "".join(pieces(text, size)) == text
    assert encode(enc, text, size).tolist() == enc.encode_ordinary(text)
    assert b"".join(decode(enc, encode(enc, text), 3)) == text.encode()


def test_documents(spark):
    r = random.Random(1)
    rows = [(i, "".join(r.choice("ab c é\n") for _ in range(r.randint(0, 300))), "x") for i in range(30)]
    rows += [(None, "a b", "x"), (40, None, None), (41, "", "x"), (3, "again", "y"), (42, "word " * 60_000, "x"), (43, "z" * 150_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    enc = encoding(PATH, PATTERN)
    want = []
    for d, t, _ in rows:
        ids = np.array(enc.encode_ordinary(t or ""), "<u4")
        want.append((d, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    got = encode_documents(docs, PATH, PATTERN, digest=True)
    assert sorted((tuple(g) for g in got.collect()), key=repr) == sorted(want, key=repr)
    back = decode_documents(encode_documents(docs, PATH, PATTERN), PATH, PATTERN).collect()
    assert sorted(bytes(b.bytes) for b in back) == sorted((t or "").encode() for _, t, _ in rows)
    assert encode_documents(docs.where("false"), PATH, PATTERN, digest=True).count() == 0
