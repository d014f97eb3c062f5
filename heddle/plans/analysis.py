"""What can be said of a query from its Catalyst plan: sources, lineage, keys, sameness; and by running it on small data."""

from __future__ import annotations

import json
import random
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from heddle.operators.profile import bags_equal


def same_plan(left: DataFrame, right: DataFrame) -> bool:
    """Whether Catalyst optimizes both to one plan, up to names: equal results on all data."""
    return left._jdf.queryExecution().optimizedPlan().sameResult(right._jdf.queryExecution().optimizedPlan())


def plan_hash(df: DataFrame) -> int:
    return df.semanticHash()


def repeated_work(models: dict[str, DataFrame]) -> list[list[str]]:
    """Groups of models that compute the same."""
    groups: dict[int, list[str]] = {}
    for name, df in models.items():
        groups.setdefault(plan_hash(df), []).append(name)
    return sorted(sorted(g) for g in groups.values() if len(g) > 1)


def dry_run(df: DataFrame) -> dict:
    """Schema and estimated bytes without running anything."""
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return {"schema": json.loads(df.schema.json()), "bytes": int(str(size))}


def row_bound(df: DataFrame) -> int | None:
    """The most rows the plan can give, if Catalyst knows a bound."""
    most = df._jdf.queryExecution().optimizedPlan().maxRows()
    return int(most.get()) if most.isDefined() else None


def not_null(df: DataFrame) -> set[str]:
    return {f.name for f in df.schema if not f.nullable}


def lineage(df: DataFrame) -> dict[str, set[str]]:
    """For each output column the leaf columns it is computed from, by the analyzed plan's expression ids.

    Columns that only filter, join or order rows are no sources.
    """
    plan = df._jdf.queryExecution().analyzed()
    sources: dict[int, set[str]] = {}

    def refs(e) -> set[str]:
        out: set[str] = set()
        it = e.references().toSeq().iterator()
        while it.hasNext():
            a = it.next()
            out |= sources.get(a.exprId().id(), {a.name()})
        return out

    def visit(p) -> None:
        children = p.children().iterator()
        kids = []
        while children.hasNext():
            kids.append(children.next())
            visit(kids[-1])
        if not kids:
            out = p.output().iterator()
            while out.hasNext():
                a = out.next()
                sources[a.exprId().id()] = {a.name()}
            return
        own = p.expressions().iterator()
        while own.hasNext():
            collect(own.next())
        if p.nodeName() == "Union":
            outputs = [list(_each(k.output())) for k in kids]
            for i, a in enumerate(_each(p.output())):
                sources[a.exprId().id()] = set().union(*(sources.get(o[i].exprId().id(), set()) for o in outputs))

    def collect(e) -> None:
        if e.nodeName() == "Alias":
            sources[e.exprId().id()] = refs(e)
        for c in _each(e.children()):
            collect(c)

    visit(plan)
    return {a.name(): sources.get(a.exprId().id(), set()) for a in _each(plan.output())}


def _each(seq):
    it = seq.iterator()
    while it.hasNext():
        yield it.next()


def random_table(spark: SparkSession, schema: T.StructType, rows: int, seed: int, null_rate: float = 0.15) -> DataFrame:
    """A small table with few distinct values, nulls among them, the same for the same seed."""
    r = random.Random(seed)

    def value(kind: T.DataType):
        if isinstance(kind, (T.LongType, T.IntegerType)):
            return r.randint(0, 4)
        if isinstance(kind, T.DoubleType):
            return r.choice([0.0, -1.5, 2.25, 10.0])
        if isinstance(kind, T.BooleanType):
            return r.random() < 0.5
        return r.choice(["", "a", "b", "A%"])

    data = [tuple(None if f.nullable and r.random() < null_rate else value(f.dataType) for f in schema) for _ in range(rows)]
    return spark.createDataFrame(data, schema)


def find_difference(spark: SparkSession, schemas: dict[str, T.StructType], left: Callable[..., DataFrame], right: Callable[..., DataFrame], seeds: int = 20) -> dict[str, list] | None:
    """Small tables on which two queries give different bags, with rows taken away as long as they still do; None if none was found."""
    for seed in range(seeds):
        rows = seed % 6  # the first is the empty database
        data = {n: random_table(spark, s, rows, seed * 31 + i).collect() for i, (n, s) in enumerate(schemas.items())}
        if _differ(spark, schemas, data, left, right):
            return _minimized(spark, schemas, data, left, right)
    return None


def _differ(spark, schemas, data, left, right) -> bool:
    tables = {n: spark.createDataFrame(data[n], s) for n, s in schemas.items()}
    return not bags_equal(left(**tables), right(**tables))


def _minimized(spark, schemas, data, left, right) -> dict[str, list]:
    shrunk = True
    while shrunk:
        shrunk = False
        for n in data:
            for i in range(len(data[n])):
                fewer = data | {n: data[n][:i] + data[n][i + 1 :]}
                if _differ(spark, schemas, fewer, left, right):
                    data, shrunk = fewer, True
                    break
    return {n: [tuple(r) for r in rows] for n, rows in data.items()}


def equivalent(spark: SparkSession, schemas: dict[str, T.StructType], left: Callable[..., DataFrame], right: Callable[..., DataFrame], seeds: int = 20) -> str:
    """"same plan", "different", or "no difference found": the last is evidence, not a proof."""
    empty = {n: spark.createDataFrame([], s) for n, s in schemas.items()}
    if same_plan(left(**empty), right(**empty)):
        return "same plan"
    return "different" if find_difference(spark, schemas, left, right, seeds) is not None else "no difference found"
