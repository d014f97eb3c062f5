"""Incremental maintenance of tables, as replayable batches and as Structured Streaming with the same rules."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.operators.profile import bags_equal
from heddle.operators.relational import is_first, qualify, upsert

Written = Callable[[DataFrame], DataFrame]


@dataclass
class Model:
    """full computes the table from all source rows; step brings target up to date with a batch."""

    full: Callable[[DataFrame], DataFrame]
    step: Callable[[DataFrame, DataFrame, DataFrame], DataFrame]  # target, all source rows, new rows


def append_after_watermark(time: str) -> Callable[[DataFrame, DataFrame, DataFrame], DataFrame]:
    """Appends rows later than the target's newest; late rows are lost, which replay() shows."""

    def step(target: DataFrame, source: DataFrame, _: DataFrame) -> DataFrame:
        newest = target.agg(F.max(time).alias("__newest"))
        later = source.join(F.broadcast(newest), F.col("__newest").isNull() | (F.col(time) > F.col("__newest"))).select(target.columns)
        return target.unionByName(later)

    return step


def reload_newest_day(time: str) -> Callable[[DataFrame, DataFrame, DataFrame], DataFrame]:
    """Replaces the target's newest day and all later ones."""

    def step(target: DataFrame, source: DataFrame, _: DataFrame) -> DataFrame:
        newest = F.broadcast(target.agg(F.to_date(F.max(time)).alias("__day")))
        kept = target.join(newest, F.to_date(time) < F.col("__day")).select(target.columns)
        again = source.join(newest, F.col("__day").isNull() | (F.to_date(time) >= F.col("__day"))).select(target.columns)
        return kept.unionByName(again)

    return step


def newest_for_key(keys: list[str], *order: Column) -> Callable[[DataFrame, DataFrame, DataFrame], DataFrame]:
    """Keeps one row for each key, so that rows delivered twice change nothing."""

    def step(target: DataFrame, _: DataFrame, new: DataFrame) -> DataFrame:
        return qualify(target.unionByName(new.select(target.columns)), is_first(1, keys, *order))

    return step


def reaggregate_groups(keys: list[str], aggregate: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, DataFrame, DataFrame], DataFrame]:
    """Computes the groups that a batch touches again, from all of their rows, and merges them."""

    def step(target: DataFrame, source: DataFrame, new: DataFrame) -> DataFrame:
        touched = new.select(keys).distinct()
        return upsert(target, aggregate(source.join(touched, keys, "left_semi")), keys)

    return step


def merge_full(keys: list[str], full: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, DataFrame, DataFrame], DataFrame]:
    return lambda target, source, _: upsert(target, full(source), keys)


def replay(model: Model, batches: list[DataFrame], written: Written = lambda d: d) -> tuple[DataFrame, list[bool]]:
    """Runs the model batch by batch; says after each whether the target equals a full refresh."""
    source, target, equal = None, None, []
    for batch in batches:
        source = batch if source is None else source.unionByName(batch)
        target = written(model.full(source) if target is None else model.step(target, source, batch))
        equal.append(bags_equal(target, model.full(source)))
    return target, equal


def windowed_counts(stream: DataFrame, time: str, keys: list[str], width: str, late: str, slide: str | None = None) -> DataFrame:
    """Counts in tumbling or sliding windows of a stream, with rows accepted until they are late."""
    window = F.window(time, width, slide) if slide else F.window(time, width)
    out = stream.withWatermark(time, late).groupBy(window.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("w.start").alias("window_start"), *keys, "n")


def deduplicated(stream: DataFrame, time: str, keys: list[str], late: str) -> DataFrame:
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def sessions(stream: DataFrame, time: str, keys: list[str], gap: str, late: str) -> DataFrame:
    out = stream.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *keys, "n")


def upsert_sink(path: Callable[[int], str], keys: list[str], *order: Column) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: version n of the table is version n - 1 with the batch merged. With order the first row of each key in a batch
    counts, so order should leave no ties; without it several rows that match one are an error. Either way a batch that runs again
    writes the same."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        last = qualify(batch, is_first(1, keys, *order)) if order else batch
        merged = last if number == 0 else upsert(spark.read.parquet(path(number - 1)), last, keys)
        merged.write.mode("overwrite").parquet(path(number))

    return write


def run_once(stream: DataFrame, name: str, folder: str, mode: str = "append") -> DataFrame:
    """Processes what the stream's source has now into Parquet files of folder and returns them as a table."""
    query = stream.writeStream.format("parquet" if mode == "append" else "memory").outputMode(mode).option("checkpointLocation", f"{folder}/{name}-state").queryName(name)
    query = (query.option("path", f"{folder}/{name}") if mode == "append" else query).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.parquet(f"{folder}/{name}") if mode == "append" else stream.sparkSession.table(name)
