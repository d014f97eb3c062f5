"""Relational operators of GoogleSQL that Spark lacks or spells differently, as DataFrame compositions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def star(df: DataFrame, but: tuple[str, ...] = (), replace: dict[str, Column] | None = None) -> DataFrame:
    """SELECT * EXCEPT (but) REPLACE (e AS c): columns keep their places."""
    replace = replace or {}
    if missing := [c for c in (*but, *replace) if c not in df.columns]:
        raise ValueError(f"no such column: {missing}")
    return df.select(*(replace[c].alias(c) if c in replace else F.col(f"`{c}`") for c in df.columns if c not in but))


def qualify(df: DataFrame, condition: Column) -> DataFrame:
    """Rows whose window condition is true. A bound on row_number becomes a per-group limit before the shuffle."""
    return df.withColumn("__qualify", condition).where("__qualify").drop("__qualify")


def is_first(k: int, partition: list[str], *order: Column) -> Column:
    return F.row_number().over(Window.partitionBy(*partition).orderBy(*order)) <= k


def is_last(k: int, partition: list[str], *order: str) -> Column:
    """The last k rows by order, column names with a minus before those that descend: the first rows of the reverse order, so that
    the bound becomes a limit for each group before the shuffle."""
    return is_first(k, partition, *(F.col(o[1:]).asc_nulls_first() if o.startswith("-") else F.col(o).desc_nulls_last() for o in order))


def count_distinct_over(x: Column, partition: list[str]) -> Column:
    """COUNT(DISTINCT x) OVER (PARTITION BY ...): the greatest dense rank among values that aren't null, without sets."""
    w = Window.partitionBy(*partition)
    return F.max(F.when(x.isNotNull(), F.dense_rank().over(w.orderBy(x.asc_nulls_last())))).over(w)


def array_agg(x: Column, *order: Column, limit: int | None = None, keep_nulls: bool = True, descending: bool = False, distinct: bool = False) -> Column:
    """ARRAY_AGG with ORDER BY (sort keys of one direction), DISTINCT and LIMIT; nulls are kept, and empty input gives NULL.

    A limit cuts the array only once the group is gathered: top_array_agg() gathers no more than the limit.
    """
    row = F.struct(*(o.alias(f"k{i}") for i, o in enumerate(order)), x.alias("v"))
    collect = F.collect_set if distinct else F.collect_list
    rows = F.sort_array(collect(row if keep_nulls else F.when(x.isNotNull(), row)), not descending)
    values = F.transform(rows, lambda r: r["v"])
    values = F.slice(values, 1, limit) if limit is not None else values
    return F.when(F.size(rows) > 0, values)


def top_array_agg(df: DataFrame, keys: list[str], x: Column, order: list[Column], limit: int, name: str) -> DataFrame:
    """keys with ARRAY_AGG(x ORDER BY order LIMIT limit), order with any directions: row_number() bounds each group before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    top = df.select(*keys, x.alias("__x"), F.row_number().over(w).alias("__r")).where(F.col("__r") <= limit)
    return top.groupBy(*keys).agg(array_agg(F.col("__x"), F.col("__r")).alias(name))


def having_extremum(df: DataFrame, keys: list[str], by: str, largest: bool = True) -> DataFrame:
    """The rows that an aggregate with HAVING MAX (or MIN) by reads: those with their group's extreme value."""
    w = Window.partitionBy(*keys)
    best = F.max(by).over(w) if largest else F.min(by).over(w)
    return qualify(df, F.col(by) == best)


def union_by_name(left: DataFrame, right: DataFrame, mode: str = "strict", by: list[str] | None = None) -> DataFrame:
    """UNION ALL BY NAME / CORRESPONDING. strict: equal names; inner: common ones; left: the left's, full: all, with NULLs."""
    names, others = left.columns, set(right.columns)
    if by is not None:
        return left.select(by).union(right.select(by))
    if mode == "strict":
        if set(names) != others:
            raise ValueError("the branches have different columns")
        return left.unionByName(right)
    if mode == "inner":
        common = [c for c in names if c in others]
        return left.select(common).union(right.select(common))
    if mode == "left":
        return left.union(right.select(*(F.col(c) if c in others else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in names)))
    return left.unionByName(right, allowMissingColumns=True)


def recursive_distinct(seed: DataFrame, step: Callable[[DataFrame], DataFrame], written: Callable[[DataFrame], DataFrame], max_rounds: int = 500) -> DataFrame:
    """WITH RECURSIVE ... UNION DISTINCT: only rows that are new feed the next round. written cuts the lineage (checkpoint)."""
    found = new = written(seed.distinct())
    for _ in range(max_rounds):
        new = written(step(new).distinct().exceptAll(found))
        if new.isEmpty():
            return found
        found = written(found.union(new))
    raise RuntimeError("the recursion did not end")


def upsert(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """MERGE: source rows replace target rows with equal keys and are inserted otherwise; null keys never match.

    A target row that several source rows match is an error, which shows when the result is computed; several source rows with
    a key that the target lacks are all inserted.
    """
    has_key = F.lit(True)
    for k in keys:
        has_key = has_key & F.col(k).isNotNull()
    several = source.where(has_key).groupBy(*keys).agg(F.count("*").alias("__n")).where("__n > 1")
    twice = target.select(*keys).distinct().join(several, keys, "left_semi").withColumn("__twice", F.lit(True))
    guard = F.when(F.col("__twice"), F.raise_error(F.lit("MERGE: a row is matched by more than one source row")).cast("boolean")).otherwise(F.lit(True))
    checked = source.join(twice, keys, "left").where(guard)
    return target.join(source.select(keys).distinct(), keys, "left_anti").select(target.columns).unionByName(checked.select(target.columns))


def unnest(df: DataFrame, array: str, name: str, offset: str | None = None, outer: bool = False) -> DataFrame:
    """[LEFT] JOIN UNNEST(array) AS name [WITH OFFSET AS offset], offsets from 0."""
    if offset is None:
        return df.withColumn(name, (F.explode_outer if outer else F.explode)(F.col(array)))
    f = F.posexplode_outer if outer else F.posexplode
    return df.select("*", f(F.col(array)).alias(offset, name)).withColumn(offset, F.col(offset).cast("long"))


def using_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """JOIN ... USING: the keys once, first, coalesced for outer joins."""
    return left.join(right, keys, how)
