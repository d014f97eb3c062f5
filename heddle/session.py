"""Sessions and tables: UTC, ANSI arithmetic, adaptive execution, and integers widened to 64 bits as GoogleSQL has them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(master: str = "local[*]", **conf: str) -> SparkSession:
    return SparkSession.builder.master(master).config(map=SETTINGS | conf).getOrCreate()


def widened(df: DataFrame) -> DataFrame:
    """INT32 columns as INT64, FLOAT32 as FLOAT64: GoogleSQL has no narrower types."""
    wider = {"int": "bigint", "smallint": "bigint", "tinyint": "bigint", "float": "double"}
    return df.select(*(F.col(f"`{n}`").cast(wider[t]).alias(n) if t in wider else F.col(f"`{n}`") for n, t in df.dtypes))


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return widened(spark.read.parquet(f"{folder}/{name}.parquet"))


def views(spark: SparkSession, folder: str, *names: str) -> None:
    """Registers tables of a folder as temporary views."""
    for n in names:
        load(spark, folder, n).createOrReplaceTempView(n)
