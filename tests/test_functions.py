import math

from pyspark.sql import functions as F

from heddle.functions import google as g


def cases():
    L = F.lit
    return [
        (g.to_int64(L(2.5)), 3), (g.to_int64(L(-2.5)), -3), (g.div(L(-7), L(2)), -3), (g.safe_divide(L(1), L(0)), None), (g.ieee_divide(L(-1), L(0)), -math.inf), (g.safe_negate(L(-(2**63))), None),
        (g.greatest(L(1), L(None)), None), (g.least(L(1), L(2)), 1), (g.trunc(L(-1.79), 1), -1.7), (g.range_bucket(L(5), F.array(L(1), L(5), L(9))), 2), (g.shift_left(L(1).cast("long"), 64), 0), (g.shift_right(L(-1).cast("long"), 63), 1),
        (g.equal(L(float("nan")), L(float("nan"))), False), (g.split(L("a.b."), "."), ["a", "b", ""]), (g.split(L(""), ","), [""]), (g.substr(L("abc"), -5, 2), "ab"), (g.substr(L("abc"), 0, 2), "ab"), (g.substr(L("abcdé"), -2), "dé"),
        (g.initcap(L("ab cD\te")), "Ab Cd\tE"), (g.initcap(L("a-b c"), "-"), "A-B c"), (g.instr(L("banana"), L("an"), 1, 2), 4), (g.instr(L("banana"), L("x")), 0), (g.code_points(L("aé😀")), [97, 233, 128512]), (g.code_points(L("")), []),
        (g.from_code_points(F.array(L(97), L(128512))), "a😀"), (g.to_base32(L(b"foob")), "MZXW6YQ="), (g.to_base32(L(b"")), ""), (g.to_hex(L(b"\xff\x01")), "ff01"), (g.array_slice(F.array(L(1), L(2), L(3)), -2, -1), [2, 3]), (g.array_slice(F.array(L(1)), 3, 5), []),
        (g.generate_array(L(5).cast("long"), L(1).cast("long")), []), (g.generate_array(L(5).cast("long"), L(1).cast("long"), -2), [5, 3, 1]), (g.euclidean_distance(F.array(L(0.0), L(3.0)), F.array(L(4.0), L(0.0))), 5.0),
        (g.date_diff(L("2024-01-07").cast("date"), L("2024-01-06").cast("date"), "WEEK"), 1), (g.date_diff(L("2024-01-08").cast("date"), L("2024-01-07").cast("date"), "ISOWEEK"), 1), (g.date_diff(L("2024-01-01").cast("date"), L("2023-12-31").cast("date"), "YEAR"), 1),
        (g.timestamp_diff(L("2024-01-01 00:00:00").cast("timestamp"), L("2024-01-01 01:59:00").cast("timestamp"), "HOUR"), -1), (g.contains_substr(L("ABC"), "bc"), True),
    ]


def test_values(spark):
    wanted = cases()
    got = spark.range(1).select(*(c.alias(f"x{i}") for i, (c, _) in enumerate(wanted))).first()
    assert list(got) == [w for _, w in wanted]


def test_safe_integer_arithmetic_at_the_edges(spark):
    edges = [-(2**63), -(2**63) + 1, -(2**62) - 1, -(2**62), -3037000500, -7, -2, -1, 0, 1, 2, 7, 3037000499, 3037000500, 2**62 - 1, 2**62, 2**63 - 2, 2**63 - 1, None]
    forms = [(g.safe_add, int.__add__), (g.safe_subtract, int.__sub__), (g.safe_multiply, int.__mul__)]

    def want(f, a, b):
        return None if a is None or b is None or not -(2**63) <= f(a, b) < 2**63 else f(a, b)

    x = spark.createDataFrame([(a, b) for a in edges for b in edges], "a bigint, b bigint").repartition(4)
    got = x.select("a", "b", *(safe(F.col("a"), F.col("b")).alias(f.__name__) for safe, f in forms)).collect()
    assert len(got) == len(edges) ** 2
    assert [tuple(r) for r in got] == [(r.a, r.b, *(want(f, r.a, r.b) for _, f in forms)) for r in got]
    one = x.where("a IS NULL AND b IS NULL")
    pairs = [(safe, f, a, b) for safe, f in forms for a in edges[::3] for b in edges[::3]]
    constant = one.select(*(safe(F.lit(a), F.lit(b)).alias(f"x{i}") for i, (safe, _, a, b) in enumerate(pairs))).first()
    assert list(constant) == [want(f, a, b) for _, f, a, b in pairs]


def below(node):
    """A node of a Catalyst tree and all beneath it."""
    kids = node.children()
    return [node, *(x for i in range(kids.length()) for x in below(kids.apply(i)))]


def try_arithmetic(df):
    """Additions, subtractions and multiplications in a frame's plan that throw and catch an exception for each overflow."""
    lists = [n.expressions() for n in below(df._jdf.queryExecution().optimizedPlan())]
    every = [x for e in lists for i in range(e.length()) for x in below(e.apply(i))]
    kind = lambda x: x.getClass().getSimpleName()
    return [x.toString() for x in every if kind(x) == "TryEval" or (kind(x) in ("Add", "Subtract", "Multiply") and x.evalMode().toString() == "TRY")]


def test_safe_query_throws_no_exception_per_row(spark):
    from heddle.queries import QUERIES

    assert try_arithmetic(spark.range(2).select(F.try_add("id", F.lit(1))))  # so that it finds them
    assert not try_arithmetic(QUERIES["q_fn_safe"](spark, "/root/testdata/sf0.001"))
