"""A pipeline of SQL models as a graph: order, reach, lineage, impact, costs and summaries that can be reused."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.plans.analysis import lineage


@dataclass
class Pipeline:
    """models: name to SQL; other names in FROM and JOIN are sources."""

    models: dict[str, str]
    reads: dict[str, list[str]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for name, text in self.models.items():
            plain = re.sub(r"'(?:[^']|'')*'|--[^\n]*|/\*.*?\*/", " ", text, flags=re.S)
            ctes = {m.lower() for m in re.findall(r"(?:\bWITH|,)\s+(\w+)\s+AS\s*\(", plain, flags=re.I)}
            found = re.findall(r"\b(?:FROM|JOIN)\s+([A-Za-z_][\w.]*)", plain, flags=re.I)
            self.reads[name] = sorted({f for f in found if f.lower() not in ctes})

    @staticmethod
    def load(folder: str, spark: SparkSession) -> "Pipeline":
        """A model for each .sql file below folder, named by the file."""
        rows = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.sql").select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.sql$", 1), "value").collect()
        return Pipeline({r[0]: r[1] for r in rows})

    def order(self) -> list[str]:
        """Models after what they read; a cycle is an error that names it."""
        done: list[str] = []
        state: dict[str, int] = {}

        def visit(n: str, path: tuple[str, ...]) -> None:
            if state.get(n) == 1:
                raise ValueError("cycle: " + " -> ".join([*path[path.index(n) :], n]))
            if n in self.models and n not in state:
                state[n] = 1
                for r in self.reads[n]:
                    visit(r, (*path, n))
                state[n] = 2
                done.append(n)

        for n in sorted(self.models):
            visit(n, ())
        return done

    def edges(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(r, n) for n, rs in self.reads.items() for r in rs], "src string, dst string")

    def run(self, spark: SparkSession) -> dict[str, DataFrame]:
        """Registers every model as a view, in order; nothing is computed yet."""
        out = {}
        for n in self.order():
            out[n] = spark.sql(self.models[n])
            out[n].createOrReplaceTempView(n)
        return out

    def columns(self, spark: SparkSession) -> DataFrame:
        """(model, column_name, source): column lineage down to source tables' columns."""
        rows = [(n, c, s) for n, df in self.run(spark).items() for c, found in lineage(df).items() for s in sorted(found)]
        return spark.createDataFrame(rows, "model string, column_name string, source string")

    def unread_columns(self, spark: SparkSession) -> list[tuple[str, str]]:
        """Columns of models that others read, whose names appear in none of their readers."""
        frames, out = self.run(spark), []
        for n, df in frames.items():
            readers = [self.models[m] for m in self.models if n in self.reads[m]]
            if readers and not any(re.search(r"\*", t) for t in readers):
                out += [(n, c) for c in df.columns if not any(re.search(rf"\b{re.escape(c)}\b", t) for t in readers)]
        return out


def reach(edges: DataFrame, start: list[str], downstream: bool = True, max_rounds: int = 100) -> DataFrame:
    """(node, distance): what start feeds (or is fed by), by rounds of joins that go on from new nodes only."""
    spark = edges.sparkSession
    step = edges.select("src", "dst") if downstream else edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    found = spark.createDataFrame([(s, 0) for s in start], "node string, distance int")
    new = found
    for d in range(1, max_rounds):
        new = step.join(new, step["src"] == new["node"]).select(F.col("dst").alias("node")).distinct().join(found.select("node"), "node", "left_anti").withColumn("distance", F.lit(d)).checkpoint()
        if new.isEmpty():
            return found
        found = found.union(new)
    raise RuntimeError("the graph is deeper than expected")


def attribute_costs(jobs: DataFrame, edges: DataFrame) -> DataFrame:
    """jobs(target, bytes, slot_ms) summed for each model, with the share of all bytes and how many models it feeds."""
    per = jobs.groupBy(F.col("target").alias("model")).agg(F.count(F.lit(1)).alias("runs"), F.sum("bytes").alias("bytes"), F.sum("slot_ms").alias("slot_ms"))
    total = per.agg(F.sum("bytes").alias("all_bytes"))
    fed = edges.groupBy(F.col("src").alias("model")).agg(F.countDistinct("dst").alias("feeds"))
    out = per.join(F.broadcast(total)).join(fed, "model", "left")
    return out.select("model", "runs", "bytes", "slot_ms", F.round(F.col("bytes") / F.col("all_bytes"), 6).alias("share"), F.coalesce("feeds", F.lit(0)).cast("long").alias("feeds"))


#: How an aggregate of a finer summary gives the coarser one.
ROLL_UP = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max, "bool_and": F.bool_and, "bool_or": F.bool_or}


def roll_up(summary: DataFrame, keys: list[str], columns: dict[str, str]) -> DataFrame:
    """Re-aggregates a finer summary: columns says for each of its aggregates what it is. avg needs its sum and count beside it."""
    out = [ROLL_UP[how](c).alias(c) for c, how in columns.items()]
    return summary.groupBy(*keys).agg(*out)


def answers(summary_keys: list[str], summary: dict[str, str], keys: list[str], wanted: list[str]) -> bool:
    """Whether a summary by summary_keys can answer a query by keys for the wanted aggregates."""
    return set(keys) <= set(summary_keys) and all(w in summary and summary[w] in ROLL_UP for w in wanted)


def select_materializations(benefit: dict[str, float], size: dict[str, float], budget: float, exact_up_to: int = 16) -> list[str]:
    """What to store within a budget: exact for a few candidates, by benefit per byte otherwise."""
    names = sorted(benefit)
    if len(names) <= exact_up_to:
        best = max(range(1 << len(names)), key=lambda m: (lambda chosen: (-1.0, 0) if sum(size[c] for c in chosen) > budget else (sum(benefit[c] for c in chosen), -len(chosen)))([n for i, n in enumerate(names) if m >> i & 1]))
        return [n for i, n in enumerate(names) if best >> i & 1]
    chosen, left = [], budget
    for n in sorted(names, key=lambda n: -benefit[n] / max(size[n], 1e-9)):
        if size[n] <= left and benefit[n] > 0:
            chosen.append(n)
            left -= size[n]
    return sorted(chosen)


def shared_filters(filters: dict[str, list[str]]) -> list[str]:
    """Conditions that all readers of a model apply, which can move into it."""
    return sorted(reduce(lambda a, b: a & b, (set(f) for f in filters.values()))) if filters else []
