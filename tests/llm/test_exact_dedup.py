import hashlib
import random
import re

from heddle.llm.exact_dedup import Directory, exact_dedup

SCHEMA = "doc_id long, text string, key string, sha int"


def brute(rows):
    groups = {}
    for d, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), d is None, d or 0, d))
    out = []
    for norm, members in groups.items():
        keep = min(members)[3]
        out += [(d, keep, len(members), d == keep, hashlib.sha256(norm.encode()).hexdigest()) for *_, d in members]
    return sorted(out, key=repr)


def test_against_brute_force(spark):
    r = random.Random(3)
    texts = ["a b", "ab", "a\tb\n", "", None, " ", "é\x0b", "é", "x" * 9000] + ["".join(r.choice("ab c") for _ in range(r.randint(0, 5))) for _ in range(60)]
    rows = [(i, r.choice(texts)) for i in range(150)] + [(None, "a b"), (None, "only"), (500, "hot"), (501, " hot")]
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], SCHEMA)
    want = brute(rows)
    assert sorted((tuple(x) for x in exact_dedup(docs).collect()), key=repr) == want
    assert sorted((tuple(x) for x in exact_dedup(docs, bucket_entries=2).collect()), key=repr) == want
    assert exact_dedup(docs.where("false")).count() == 0


def test_directory_splits_overfull_buckets_only():
    d = Directory(10).build({k: 12 if k == 5 else 1 for k in range(8)}, 3)
    held = {b: sum(12 if k == 5 else 1 for k in range(8) if d.slots[k >> (3 - d.depth)] == b) for b in d.buckets()}
    assert d.depth == 3 and len(d.slots) == 8 and sum(held.values()) == 19
    assert all(n <= 10 or b[0] == 3 for b, n in held.items())
    assert Directory(100).build({0: 5, 1: 5}, 1).depth == 0
