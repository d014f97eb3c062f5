import math
import random

from pyspark.sql import functions as F

from heddle.llm.topk import top_k

SCHEMA = "vec_id long, embedding array<float>, score long"


def brute(rows, k=5):
    """By all pairs; of queries that repeat an id the largest vector asks."""
    good = [(i, [math.floor(256 * x) for x in v]) for i, v, _ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    queries = {}
    for i, v in good:
        if i % 50 == 0:
            queries[i] = max(queries.get(i, v), v)
    out = []
    for i, q in queries.items():
        scored = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in good if j != i)[:k]
        out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scored)]
    return sorted(out)


def check(spark, rows, **how):
    got = top_k(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 50 == 0, **how)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows)


def test_against_all_pairs(spark):
    r = random.Random(9)
    grid = lambda: [r.randint(-64, 64) / 64 for _ in range(12)]
    rows = [(i, grid(), 0) for i in range(400)]
    rows += [(i, [0.5] * 12, 1) for i in range(1000, 1040)]  # ties
    rows += [(50, grid(), 2), (51, grid(), 2), (None, grid(), 3), (2000, None, 3), (2001, [1.0, None], 3), (2050, [math.nan] * 12, 3), (2100, [math.inf] * 12, 3), (2150, [1.0, -1.0], 3), (2200, [], 3)]
    check(spark, rows)
    check(spark, rows, block=3)


def test_fewer_candidates_than_k_and_none(spark):
    check(spark, [(0, [1.0, 2.0], 0), (1, [1.0, 1.0], 0), (50, [-1.0, 0.0], 0)])
    check(spark, [(0, [1.0], 0)])
    check(spark, [])
