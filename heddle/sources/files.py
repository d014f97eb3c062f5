"""Files as tables and tables as files, by the names of their formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

OPTIONS = {
    "csv": ("csv", {"header": "true", "inferSchema": "true"}),
    "tsv": ("csv", {"header": "true", "inferSchema": "true", "sep": "\t"}),
    "json": ("json", {"multiLine": "true"}),
    "ndjson": ("json", {}),
    "jsonl": ("json", {}),
    "parquet": ("parquet", {}),
    "orc": ("orc", {}),
}


def read(spark: SparkSession, path: str, kind: str | None = None, schema: str | None = None) -> DataFrame:
    """A file or folder as a table; the format by its ending unless it is given. A schema spares the pass that infers one."""
    kind = kind or path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind not in OPTIONS:
        raise ValueError(f"no such format: {kind}")
    name, options = OPTIONS[kind]
    reader = spark.read.format(name).options(**options)
    return (reader.schema(schema) if schema else reader).load(path)


def write(df: DataFrame, path: str, kind: str = "parquet", by: list[str] = (), mode: str = "errorifexists") -> None:
    name, options = OPTIONS[kind]
    options = {k: v for k, v in options.items() if k in ("header", "sep")}
    df.write.format(name).options(**options).partitionBy(*by).mode(mode).save(path)


def jobs(spark: SparkSession, path: str) -> DataFrame:
    """A job history, JSON array or lines: nested fields flattened to (job_id, target, user, bytes, slot_ms, started)."""
    df = read(spark, path)
    paths = {"job_id": "jobReference.jobId", "target": "configuration.query.destinationTable.tableId", "user": "user_email", "bytes": "statistics.query.totalBytesBilled", "slot_ms": "statistics.totalSlotMs", "started": "statistics.startTime"}
    return df.select(*(field(df, p).cast("long" if n in ("bytes", "slot_ms", "started") else "string").alias(n) for n, p in paths.items()))


def field(df: DataFrame, path: str) -> Column:
    """A nested field, null where the schema has none of that name."""
    kind = df.schema
    for part in path.split("."):
        if not hasattr(kind, "names") or part not in kind.names:
            return F.lit(None)
        kind = kind[part].dataType
    return F.col(path)


def catalog(spark: SparkSession) -> DataFrame:
    """(database, table_name, column_name, data_type) of all tables and views that the session knows."""
    rows = [(t.database or "", t.name, c.name, c.dataType) for t in spark.catalog.listTables() for c in spark.catalog.listColumns(t.name)]
    return spark.createDataFrame(rows, "database string, table_name string, column_name string, data_type string")
