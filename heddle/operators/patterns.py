"""Row patterns over ordered partitions, and time series aligned to periods."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def match_recognize(df: DataFrame, partition: list[str], order: list[str], define: dict[str, Column], pattern: str, id_col: str) -> DataFrame:
    """MATCH_RECOGNIZE: (partition, match_number, first_id, last_id, rows) for each match, one after another.

    define names row classes by one letter each, tried in order; pattern is a regular expression over the letters, and
    rows of no class are written as '-'. A partition is one task's work, in order.
    """
    letter = F.lit("-")
    for name, condition in reversed(define.items()):
        letter = F.when(condition, F.lit(name)).otherwise(letter)
    rows = df.select(*partition, *[o for o in order if o not in partition], F.col(id_col).alias("__id"), letter.alias("__letter"))
    compiled = re.compile(pattern)

    def find(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values([*order, "__id"], kind="stable")
        ids, text = group["__id"].to_numpy(), "".join(group["__letter"])
        found = [m for m in compiled.finditer(text) if m.end() > m.start()]
        out = pd.DataFrame({"match_number": range(1, len(found) + 1), "first_id": [ids[m.start()] for m in found], "last_id": [ids[m.end() - 1] for m in found], "rows": [m.end() - m.start() for m in found]})
        for p in partition:
            out.insert(0, p, group[p].iloc[0])
        return out[[*partition, "match_number", "first_id", "last_id", "rows"]]

    kinds = ", ".join(f"{p} {df.schema[p].dataType.simpleString()}" for p in partition)
    return rows.groupBy(*partition).applyInPandas(find, f"{kinds}, match_number long, first_id {df.schema[id_col].dataType.simpleString()}, last_id {df.schema[id_col].dataType.simpleString()}, rows long")


def align(df: DataFrame, time: str, keys: list[str], period: str, within: str, **metrics: Column) -> DataFrame:
    """ALIGN ... PERIOD ... WITHIN: at each period's end the metrics over the rows of the lookback before it."""
    w = F.window(time, within, period)
    return df.groupBy(w.alias("w"), *keys).agg(*(m.alias(n) for n, m in metrics.items())).select(F.col("w.end").alias("period_end"), *keys, *metrics)
