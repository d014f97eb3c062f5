import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from heddle.llm.simhash_dedup import keep_one, near, near_duplicates

SCHEMA = "doc_id long, text string, mark string, a int"


def shingles(text):
    w = (text or "").lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows):
    """doc id -> smallest id of its class, by comparing all pairs of distinct sequences."""
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    seqs = sorted({tuple((t or "").lower().split()) for _, t in rows})
    sets = [shingles(" ".join(s)) for s in seqs]
    for i, a in enumerate(sets):
        for j in range(i):
            if a and 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                parent[find(seqs[i])] = find(seqs[j])
    members = {}
    for d, t in rows:
        members.setdefault(find(tuple((t or "").lower().split())), []).append(d)
    return {d: (min((x for x in m if x is not None), default=None), len(m)) for m in members.values() for d in m}


def corpus(seed=1, families=18, spread=12):
    r = random.Random(seed)
    vocabulary = ["w%d" % i for i in range(3000)]
    rows, n = [], 10
    for _ in range(families):
        base = [r.choice(vocabulary) for _ in range(r.choice((3, 8, 60, 150, 400)))]
        for _ in range(r.randint(1, spread)):
            text = list(base)
            for _ in range(r.choice((0, 1, 1, 2, 3, 6))):
                text[r.randrange(len(text))] = r.choice(vocabulary)
            rows.append((n, " ".join(text).upper() if r.random() < 0.1 else "  ".join(text)))
            n += 1
    r.shuffle(rows)
    return rows + [(1, None), (2, ""), (3, " \n"), (None, rows[0][1]), (4, "one"), (5, "one"), (6, "a b c d")]


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "x", 1) for d, t in rows], SCHEMA)


def test_classes_equal_brute_force(spark):
    rows = corpus()
    got = {r.doc_id: (r.class_id, r.class_size) for r in near_duplicates(frame(spark, rows)).collect()}
    assert got == brute(rows)


def test_cut_shards_and_overflowing_lists(spark):
    rows = corpus(2, 4, 40)
    got = {r.doc_id: (r.class_id, r.class_size) for r in near_duplicates(frame(spark, rows), shard_nodes=20, neighbours=2).collect()}
    assert got == brute(rows)


def test_keep_one_keeps_one_of_each_class_and_all_columns(spark):
    rows = corpus(3, 8, 5)
    kept = keep_one(frame(spark, rows))
    want = Counter(c for c, _ in brute(rows).values())
    assert kept.columns == ["doc_id", "text", "mark", "a"] and sorted(r.doc_id for r in kept.collect()) == sorted(want)
    assert near_duplicates(frame(spark, []), audited=0).count() == 0


def test_near_reports_the_nearest_first():
    codes = np.array([[0, 0], [1, 0], [3, 0], [2**40 - 1, 2**20], [7, 0]], np.uint64)
    x, y, d, over = near(codes, np.array([10, 10, 10, 10, 100]), np.ones(5, bool), np.arange(5), 3, __import__("fractions").Fraction(4, 5), 1)
    assert list(zip(x.tolist(), y.tolist(), d.tolist())) == [(0, 1, 1), (1, 0, 1), (2, 1, 1)] and over.all()


def test_beams_find_what_the_whole_shard_has():
    from fractions import Fraction

    from heddle.llm.simhash_dedup import beam_near

    r = np.random.default_rng(4)
    codes = r.integers(0, 2**64, (1500, 2), dtype=np.uint64)
    codes[1000:1200, 0] = codes[0, 0] ^ (np.uint64(1) << r.integers(0, 64, 200).astype(np.uint64))
    codes[1000:1200, 1] = codes[0, 1]
    codes[:400:2] = codes[1:400:2] ^ np.array([0xFFFF, 3], np.uint64)
    args = (codes, np.full(1500, 50), np.ones(1500, bool), np.where(np.arange(1500) >= 1100, 7, np.arange(1500)), 36, Fraction(4, 5))
    want, got = near(*args, 1500), beam_near(*args, 4)
    pairs = set(zip(got[0].tolist(), got[1].tolist()))
    assert {p for p in pairs if p[0] != p[1]} <= set(zip(want[0].tolist(), want[1].tolist()))
    alone = {(i, i ^ 1) for i in range(2, 400)}
    assert len(alone & pairs) > 0.9 * len(alone)
    assert set(got[0][got[3]].tolist()) >= set(range(1000, 1200))


def test_pairs_that_meet_on_a_passage_shared_by_a_large_shard(spark):
    r = random.Random(7)
    shared = ["s%d" % i for i in range(75)]
    rows = []
    for i in range(200):
        own = ["w%d" % r.randrange(10**9) for _ in range(30)]
        rows += [(2 * i, " ".join(shared + own)), (2 * i + 1, " ".join(shared + own[:-1] + ["x%d" % i]))]
    r.shuffle(rows)
    got = {d.doc_id: d.class_id for d in near_duplicates(frame(spark, rows), shard_nodes=8, audited=0).collect()}
    assert sum(got[i] == i - i % 2 for i in range(400)) >= 396


def test_parts_ask_in_blocks_and_find_what_one_graph_finds(spark):
    from heddle.llm import simhash_dedup as sd

    r = np.random.default_rng(9)
    n = 300
    codes = r.integers(-(2**63), 2**63 - 1, (n, 2))
    codes[1::2] = codes[::2] ^ 0b111
    nodes = spark.createDataFrame([(i, int(codes[i, 0]), int(codes[i, 1]), 50, [7]) for i in range(n)], "id long, s1 long, s2 long, size long, mins array<long>")
    shards = sd._sharded(nodes, 0, 1, 5).withColumn("asks", F.col("query")).withColumn("group", F.col("id"))
    assert shards.select("part").distinct().count() == n // 5 and shards.select("block").distinct().count() == -(-(n // 5) // sd.PARTS_ASKING)
    found = {(f.a, f.b) for f in sd._search(shards, 36, sd.THRESHOLD, 16, 4).collect()}
    assert {(i, i + 1) for i in range(0, n, 2)} <= found


def test_repeated_words_and_phrases_have_equal_sets(spark):
    phrases = ["spam", "buy now", "click here now", "a b c d", "one two three four five six"]
    rows = [(10 * i + k, " ".join([p] * n)) for i, p in enumerate(phrases) for k, n in enumerate((20, 35, 200, 350))]
    rows += [(100, "spam " * 4), (101, "spam " * 3), (102, "spam spam spam"), (103, None)]
    got = {r.doc_id: (r.class_id, r.class_size) for r in near_duplicates(frame(spark, rows), audited=0).collect()}
    assert got == brute(rows) and got[3] == (0, 4) and got[101] == (101, 2)


def test_a_search_that_misses_pairs_fails(spark):
    with pytest.raises(RuntimeError, match="recall"):
        near_duplicates(frame(spark, corpus(5, 6, 6)), radius=0)


def test_audit_is_not_outweighed_by_a_large_class(spark):
    from heddle.llm import simhash_dedup as sd

    r = random.Random(8)
    base = ["g%d" % i for i in range(100)]
    rows = [(i, " ".join(base + ["e%d" % i])) for i in range(30)]
    for i in range(10):
        own = ["w%d" % r.randrange(10**9) for _ in range(60)]
        rows += [(100 + 2 * i, " ".join(own)), (101 + 2 * i, " ".join(own + ["x"]))]
    keyed = sd._keyed(frame(spark, rows), "doc_id", "text")
    nodes = sd._scan(keyed, 1, 5).withColumn("id", F.col("doc"))
    group = spark.createDataFrame([(0, i) for i in range(1, 30)], "a long, b long")
    whole = group.union(spark.createDataFrame([(100 + 2 * i, 101 + 2 * i) for i in range(10)], "a long, b long"))
    apart = nodes.select("id", F.col("id").alias("group"))
    group, whole = sd._labels(apart, group), sd._labels(apart, whole)
    assert sd.audit(nodes, keyed, group, sd.THRESHOLD, 5, 256) == 0.5
    assert sd.audit(nodes, keyed, whole, sd.THRESHOLD, 5, 256) == 1.0
