import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from heddle.llm import packing
from heddle.llm.packing import Limits, WordEncoder, pack, pack_documents, plan

PATH = public_tokenizers.path("word_bpe_49k.json")


def filled(places):
    """bin -> its (offset, length), from the plan's rows."""
    bins = defaultdict(list)
    for length, _, n, first, at in places:
        for b in range(first, first + n):
            bins[b].append((at, length))
    return bins


@pytest.mark.parametrize("rule", ["norm", "dot"])
@pytest.mark.parametrize("limits", [Limits(100), Limits(100, 3), Limits(100, 4, 12_000), Limits(100, None, 10_000)])
def test_plan_keeps_every_limit(limits, rule):
    r = random.Random(1)
    counts = {n: r.randint(1, 40) for n in range(1, 101, 3)}
    places = plan(counts, limits, rule=rule)
    placed, seen = defaultdict(int), defaultdict(set)
    for length, rank, n, _, _ in places:
        placed[length] += n
        assert not seen[length] & set(range(rank, rank + n))
        seen[length] |= set(range(rank, rank + n))
    assert placed == counts and all(seen[n] == set(range(counts[n])) for n in counts)
    for pieces in filled(places).values():
        pieces.sort()
        assert [at for at, _ in pieces] == np.cumsum([0] + [n for _, n in pieces])[:-1].tolist()
        assert sum(n for _, n in pieces) <= limits.tokens
        assert limits.documents is None or len(pieces) <= limits.documents
        assert limits.attention is None or sum(n * n for _, n in pieces) <= limits.attention


def test_plan_is_close_to_the_lower_bound():
    r = random.Random(2)
    lengths = [min(4096, int(r.lognormvariate(6, 1.2)) + 1) for _ in range(20_000)]
    counts = {n: lengths.count(n) for n in set(lengths)}
    assert len(filled(plan(counts, Limits()))) <= -(-sum(lengths) // 4096) + 3


def test_plan_refuses_what_fits_nowhere():
    with pytest.raises(ValueError):
        plan({11: 1}, Limits(10))
    assert plan({}, Limits()) == []


def test_words_give_the_texts_ids():
    r = random.Random(3)
    whole, words = Tokenizer.from_file(PATH), WordEncoder(PATH, most=500)
    whole.encode_special_tokens = True
    chars = "ab'sSt é́  \t\n\x1c\x85\xa0ΣΑİßfiǆ<|endoftext|>0123 ٣²中̸>=‍🙂"
    for _ in range(1500):
        t = "".join(r.choice(chars) for _ in range(r.randint(0, 40)))
        assert words.encode(t).tolist() == whole.encode(t, add_special_tokens=False).ids, repr(t)


def test_frequent_words_stay_known():
    words, whole = WordEncoder(PATH, most=100), Tokenizer.from_file(PATH)
    common, asked = [f"common{chr(97 + i)}" for i in range(20)], []
    real = words.ids
    words.ids = lambda w, odd: asked.append(w) or real(w, odd)
    for i in range(200):
        t = " ".join([*common, *(f"rare{chr(97 + i % 26)}{chr(97 + i // 26)}{chr(97 + k)}" for k in range(20))])
        assert words.encode(t).tolist() == whole.encode(t, add_special_tokens=False).ids
        assert len(words.known) <= 100 + 40
    assert all(asked.count(w) == 1 for w in common)  # never asked for again, however many rare words come between


def test_documents_are_packed_whole(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 8)))
    rows = [(i, " ".join(word() for _ in range(r.randint(0, 900))), "x") for i in range(60)]
    rows += [(100, None, "x"), (101, "", None), (None, "a b", "x"), (7, "again", "y"), (200, " ".join(word() for _ in range(9000)), "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length string")
    got = pack_documents(docs, PATH).collect()
    whole = Tokenizer.from_file(PATH)
    want = []
    for d, t, _ in rows:
        ids = whole.encode(t or "", add_special_tokens=False).ids + [1]
        want += [(d, k, s, len(ids[s : s + 4096]), zlib.crc32(np.array(ids[s : s + 4096], "<u4").tobytes())) for k, s in enumerate(range(0, len(ids), 4096))]
    assert sorted((tuple(g)[:5] for g in got), key=repr) == sorted(want, key=repr)
    bins = defaultdict(list)
    for g in got:
        bins[g.sequence_id].append((g.offset, g.length))
    for pieces in bins.values():
        pieces.sort()
        assert [at for at, _ in pieces] == np.cumsum([0] + [n for _, n in pieces])[:-1].tolist() and sum(n for _, n in pieces) <= 4096
    assert len(bins) <= -(-sum(g.length for g in got) // 4096) + 1


def test_empty_table(spark):
    assert pack_documents(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
    assert pack(spark.createDataFrame([], "length long, part2 string")).columns == ["length", "part2", "sequence_id", "offset"]


def test_pieces_are_cut_and_ranked_in_one_python_node(spark, monkeypatch):
    nodes, real = [], packing.materialise
    monkeypatch.setattr(packing, "materialise", lambda df, name: nodes.append((name, df._jdf.queryExecution().executedPlan().toString().count("MapInArrow"))) or real(df, name))
    docs = spark.createDataFrame([(i, "a b c" * (i % 4)) for i in range(40)], "doc_id long, text string")
    assert pack_documents(docs, PATH).count() == 40
    assert nodes == [("pieces", 1), ("lengths", 0)]
