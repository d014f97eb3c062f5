import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heddle.operators import profile as pf
from heddle.operators import relational as rel
from heddle.plans import analysis as an
from heddle.plans import joinorder as jo
from heddle.plans import models as md
from heddle.sources import files
from heddle.streaming import incremental as inc

SCHEMA = T.StructType([T.StructField("k", T.LongType()), T.StructField("v", T.DoubleType()), T.StructField("s", T.StringType())])


def test_equivalence_verdicts(spark):
    tables = {"t": SCHEMA}
    assert an.equivalent(spark, tables, lambda t: t.where("k > 1").where("v > 0"), lambda t: t.where("v > 0").where("k > 1")) in ("same plan", "no difference found")
    assert an.equivalent(spark, tables, lambda t: t.where("k > 1"), lambda t: t.where("k > 1")) == "same plan"
    found = an.find_difference(spark, tables, lambda t: t.where("k > 1"), lambda t: t.where("not (k <= 1) or k is null"))
    assert found is not None and len(found["t"]) == 1 and found["t"][0][0] is None
    assert an.equivalent(spark, tables, lambda t: t.select("k").distinct(), lambda t: t.groupBy("k").count().select("k"), seeds=4) in ("same plan", "no difference found")


def test_plan_facts(spark):
    t = spark.createDataFrame([(1, 2.0, "a")], SCHEMA)
    assert an.row_bound(t.limit(3)) in (1, 3) and an.row_bound(t.agg(F.count("*"))) == 1
    assert an.not_null(t.agg(F.count("*").alias("n"))) == {"n"}
    assert an.lineage(t.withColumn("x", F.col("k") + F.col("v")).groupBy("s").agg(F.max("x").alias("m"))) == {"s": {"s"}, "m": {"k", "v"}}
    assert an.lineage(t.select("k").union(t.select(F.col("v").cast("long")))) == {"k": {"k", "v"}}
    assert an.repeated_work({"a": t.where("k > 1"), "b": t.where("k > 1"), "c": t}) == [["a", "b"]]
    assert an.dry_run(t)["bytes"] > 0


def test_join_orders_agree(spark):
    a = spark.range(100).select(F.col("id").alias("a1"), (F.col("id") % 10).alias("a2"))
    b = spark.range(10).select(F.col("id").alias("b1"), (F.col("id") % 3).alias("b2"))
    c = spark.range(3).select(F.col("id").alias("c1"))
    q = jo.JoinQuery({"a": a, "b": b, "c": c}, [("a", "a2", "b", "b1"), ("b", "b2", "c", "c1")], {"c": F.col("c1") == 1})
    stats = jo.Statistics.collect(q)
    cost, plan = jo.optimize(q, stats)
    other, tree = jo.greedy(q, stats)
    assert cost <= other and jo.members(plan) == jo.members(tree) == {"a", "b", "c"}
    assert pf.bags_equal(jo.emit(q, plan).select("a1", "b1", "c1"), jo.emit(q, (("a", "b"), "c")).select("a1", "b1", "c1"))
    assert jo.q_error(10, 100) == 10
    with pytest.raises(ValueError):
        jo.optimize(jo.JoinQuery({"a": a, "c": c}, []), jo.Statistics({"a": 1, "c": 1}, {}))


def test_models(spark):
    with pytest.raises(ValueError, match="cycle"):
        md.Pipeline({"a": "SELECT * FROM b", "b": "SELECT * FROM a"}).order()
    p = md.Pipeline({"a": "WITH x AS (SELECT 1 AS k, 2 AS z FROM src) SELECT * FROM x", "b": "SELECT k FROM a JOIN src ON true -- FROM nowhere"})
    assert p.reads == {"a": ["src"], "b": ["a", "src"]} and p.order() == ["a", "b"]
    spark.range(1).createOrReplaceTempView("src")
    assert p.unread_columns(spark) == [("a", "z")]
    assert md.select_materializations({"a": 5, "b": 4, "c": 4}, {"a": 3, "b": 2, "c": 2}, 4) == ["b", "c"]
    assert md.answers(["a", "b"], {"n": "count"}, ["a"], ["n"]) and not md.answers(["a"], {"n": "avg"}, ["a"], ["n"])
    assert md.shared_filters({"x": ["a", "b"], "y": ["b"]}) == ["b"]


def test_replay_shows_late_rows(spark):
    rows = spark.createDataFrame([(1, 1), (2, 5), (3, 3)], "id long, ts long")
    model = inc.Model(lambda d: d, inc.append_after_watermark("ts"))
    in_order = inc.replay(model, [rows.where("ts < 4"), rows.where("ts > 4")])[1]
    late = inc.replay(model, [rows.where("ts <> 3"), rows.where("ts = 3")])[1]
    assert in_order == [True, True] and late == [True, False]


def test_upsert_rules(spark):
    t = spark.createDataFrame([(1, "a"), (None, "n")], "k long, v string")
    s = spark.createDataFrame([(1, "b"), (2, "c"), (None, "m")], "k long, v string")
    assert sorted(map(repr, map(tuple, rel.upsert(t, s, ["k"]).collect()))) == sorted(map(repr, [(1, "b"), (2, "c"), (None, "n"), (None, "m")]))
    with pytest.raises(Exception, match="more than one"):
        rel.upsert(t, s.union(s), ["k"]).collect()


def test_upsert_sink_is_repeatable(spark, tmp_path):
    write = inc.upsert_sink(lambda n: str(tmp_path / f"v{n}"), ["k"])
    one = spark.createDataFrame([(1, "a")], "k long, v string")
    two = spark.createDataFrame([(1, "b"), (2, "c")], "k long, v string")
    for n, b in ((0, one), (1, two), (1, two)):
        write(b, n)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "v1")).collect())) == [(1, "b"), (2, "c")]


def test_files_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    for kind in ("csv", "tsv", "ndjson", "parquet", "orc"):
        files.write(df, str(tmp_path / kind), kind)
        assert files.read(spark, str(tmp_path / kind), kind, "k int, v string").orderBy("k").collect() == df.collect()
    (tmp_path / "jobs.json").write_text('[{"jobReference": {"jobId": "j1"}, "statistics": {"totalSlotMs": "12"}}]')
    row = files.jobs(spark, str(tmp_path / "jobs.json")).first()
    assert (row.job_id, row.slot_ms, row.target) == ("j1", 12, None)
    with pytest.raises(ValueError):
        files.read(spark, "x.avro")


def test_profile_flags_and_nested(spark):
    df = spark.createDataFrame([(1, (2, None), "a"), (2, (3, None), "a")], "k long, s struct<x: long, y: string>, c string")
    got = {r.column_name: r for r in pf.profile(df).collect()}
    assert got["k"].is_unique and got["c"].constant and got["s.y"].all_null and got["s.x"].mean == 2.5


def test_unions_by_name(spark):
    a, b = spark.createDataFrame([(1, 2)], "x long, y long"), spark.createDataFrame([(3, 4)], "y long, z long")
    assert rel.union_by_name(a, b, "left").collect()[1] == (None, 3)
    assert rel.union_by_name(a, b, "inner").columns == ["y"] and rel.union_by_name(a, b, "full").columns == ["x", "y", "z"]
    with pytest.raises(ValueError):
        rel.union_by_name(a, b)


def test_match_recognize_finds_runs(spark):
    from heddle.operators.patterns import match_recognize

    rows = spark.createDataFrame([(1, i, k) for i, k in enumerate("aabxaab")] + [(2, 9, "b")], "p long, t long, k string")
    got = match_recognize(rows, ["p"], ["t"], {"a": F.col("k") == "a", "b": F.col("k") == "b"}, "a+b", "t").collect()
    assert sorted(map(tuple, got)) == [(1, 1, 0, 2, 3), (1, 2, 4, 6, 3)]
