"""Table profiles, fingerprints and differences, each as a few aggregates over the table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = (T.LongType, T.IntegerType, T.ShortType, T.ByteType, T.DoubleType, T.FloatType, T.DecimalType)


def type_class(kind: T.DataType) -> str:
    if isinstance(kind, NUMERIC):
        return "numeric"
    if isinstance(kind, T.StringType):
        return "string"
    if isinstance(kind, T.BooleanType):
        return "boolean"
    return "temporal" if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)) else "other"


def expanded(df: DataFrame) -> DataFrame:
    """Struct fields as columns of their own (a.b), to any depth; arrays stay and are profiled as a whole."""
    while any(isinstance(f.dataType, T.StructType) for f in df.schema):
        out = []
        for f in df.schema:
            if isinstance(f.dataType, T.StructType):
                out += [F.col(f"`{f.name}`").getField(k.name).alias(f"{f.name}.{k.name}") for k in f.dataType]
            else:
                out.append(F.col(f"`{f.name}`"))
        df = df.select(*out)
    return df


def profile(df: DataFrame, include: list[str] | None = None, sample_percent: float | None = None, where: Column | None = None, approximate: bool = False) -> DataFrame:
    """One row for each column: rows, nulls, distinct, least, greatest, mean, stddev, quartiles, text lengths and flags.

    Exact figures come from the columns' values with their counts, so that no task holds all values of a column: one shuffle groups all
    columns at once. approximate takes one aggregate of sketches over one scan instead.
    """
    df = df if where is None else df.where(where)
    df = df if sample_percent is None else df.sample(sample_percent / 100, seed=0)
    df = expanded(df)
    names = include or df.columns
    kinds = [type_class(df.schema[n].dataType) for n in names]
    aggregates: list[Column] = [F.count(F.lit(1)).alias("rows")]
    for i, (n, kind) in enumerate(zip(names, kinds, strict=True)):
        c = F.col(f"`{n}`")
        number = c.cast("double") if kind == "numeric" else F.lit(None).cast("double")
        size = F.length(c) if kind == "string" else F.lit(None).cast("int")
        shown = c.cast("string") if kind in ("string", "boolean", "temporal") else F.lit(None).cast("string")
        aggregates += [
            F.count(c).alias(f"{i}_known"), F.min(number).alias(f"{i}_min"), F.max(number).alias(f"{i}_max"), F.avg(number).alias(f"{i}_mean"), F.stddev_samp(number).alias(f"{i}_stddev"),
            F.min(size).alias(f"{i}_short"), F.max(size).alias(f"{i}_long"), F.min(shown).alias(f"{i}_first"), F.max(shown).alias(f"{i}_last"),
        ]
        if approximate:
            aggregates += [F.approx_count_distinct(c).alias(f"{i}_distinct"), F.percentile_approx(number, [0.25, 0.5, 0.75]).alias(f"{i}_q")]
    one = df.agg(*aggregates)
    rows = F.array(
        *(
            F.struct(
                F.lit(i).alias("place"), F.lit(n).alias("column_name"), F.lit(kinds[i]).alias("type_class"), F.col("rows"), (F.col("rows") - F.col(f"{i}_known")).alias("nulls"), F.col(f"{i}_min").alias("min_number"), F.col(f"{i}_max").alias("max_number"), F.col(f"{i}_mean").alias("mean"),
                F.col(f"{i}_stddev").alias("stddev"), F.col(f"{i}_short").cast("long").alias("min_length"), F.col(f"{i}_long").cast("long").alias("max_length"), F.col(f"{i}_first").alias("first_text"), F.col(f"{i}_last").alias("last_text"),
                *([F.col(f"{i}_distinct").alias("distinct_values"), F.col(f"{i}_q").alias("q")] if approximate else []),
            )
            for i, n in enumerate(names)
        )
    )
    flat = one.select(F.explode(rows).alias("r")).select("r.*")
    if not approximate:
        flat = flat.join(F.broadcast(_values(df, names, kinds)), "place", "left").withColumn("distinct_values", F.coalesce("distinct_values", F.lit(0).cast("long")))  # a row for each column
    flat = flat.withColumns({"q1": F.get("q", F.lit(0)), "median": F.get("q", F.lit(1)), "q3": F.get("q", F.lit(2))})
    flat = flat.select("column_name", "type_class", "rows", "nulls", "distinct_values", "min_number", "max_number", "mean", "stddev", "q1", "median", "q3", "min_length", "max_length", "first_text", "last_text")
    known = F.col("rows") - F.col("nulls")
    return flat.withColumns({"all_null": (known == 0) & (F.col("rows") > 0), "constant": F.col("distinct_values") == 1, "is_unique": (F.col("distinct_values") == F.col("rows")) & (F.col("rows") > 0)})


#: Runs of one column's sorted values that are counted by themselves, for its quartiles.
RUNS = 256


def _values(df: DataFrame, names: list[str], kinds: list[str]) -> DataFrame:
    """(place, distinct_values, q): of each column's values, grouped with their counts.

    Quartiles interpolate between the two values about a rank. Values are dealt to runs by approximate quantiles; running
    sums over the runs tell which of them hold the ranks, and only those are sorted.
    """
    number = [i for i, k in enumerate(kinds) if k == "numeric"]
    cells = F.array(*(F.struct(F.lit(i).alias("place"), (F.col(f"`{n}`").cast("double") if kinds[i] == "numeric" else F.lit(None).cast("double")).alias("x"), (F.lit(None).cast("string") if kinds[i] == "numeric" and not str(df.schema[n].dataType).startswith("Decimal") else F.col(f"`{n}`").cast("string") if kinds[i] != "other" else F.to_json(F.struct(F.col(f"`{n}`")))).alias("v"), (F.col(f"`{n}`").cast("long") if str(df.schema[n].dataType) == "LongType()" else F.lit(None).cast("long")).alias("w"), F.col(f"`{n}`").isNotNull().alias("known")) for i, n in enumerate(names)))
    grouped = df.select(F.explode(cells).alias("c")).where("c.known").groupBy("c.place", "c.x", "c.v", "c.w").agg(F.count("*").alias("n"))
    per = grouped.groupBy("place").agg(F.count("*").alias("distinct_values"), F.sum("n").alias("known"), F.percentile_approx("x", [i / RUNS for i in range(1, RUNS)], 10_000).alias("edges"))
    if not number:
        return per.select("place", "distinct_values", F.lit(None).cast("array<double>").alias("q"))
    numbers = grouped.where(F.col("place").isin(number)).join(F.broadcast(per.select("place", "known", "edges")), "place")
    numbers = numbers.withColumn("run", F.coalesce(F.size(F.filter("edges", lambda e: e < F.col("x"))), F.lit(0))).drop("edges")
    runs = numbers.groupBy("place", "run", "known").agg(F.sum("n").alias("in_run"))
    runs = runs.withColumn("before", F.sum("in_run").over(Window.partitionBy("place").orderBy("run")) - F.col("in_run"))  # RUNS rows for each column
    ranks = F.array(*(F.col("known") - 1 for _ in range(3)))
    holds = F.exists(F.zip_with(ranks, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), lambda k, p: k * p), lambda r: (F.floor(r) < F.col("before") + F.col("in_run")) & (F.ceil(r) >= F.col("before")))
    held = numbers.join(F.broadcast(runs.where(holds).select("place", "run", "before")), ["place", "run"])
    last = F.sum("n").over(Window.partitionBy("place", "run").orderBy("x")) + F.col("before")  # rows up to this value
    placed = held.select("place", "known", "x", (last - F.col("n")).alias("first"), last.alias("until"))
    value = lambda p, up: F.max(F.when(((F.ceil if up else F.floor)((F.col("known") - 1) * p) >= F.col("first")) & ((F.ceil if up else F.floor)((F.col("known") - 1) * p) < F.col("until")), F.col("x")))
    at = [(F.max("known") - 1) * p for p in (0.25, 0.5, 0.75)]
    q = F.array(*(value(p, False) + (value(p, True) - value(p, False)) * (r - F.floor(r)) for p, r in zip((0.25, 0.5, 0.75), at, strict=True)))
    quartiles = placed.groupBy("place").agg(q.alias("q"))
    return per.select("place", "distinct_values").join(F.broadcast(quartiles), "place", "left")


def top_values(df: DataFrame, column: str, k: int = 5) -> DataFrame:
    return df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc_nulls_first("value")).limit(k)


def fingerprint(df: DataFrame, columns: list[str] | None = None, method: str = "xxhash64") -> DataFrame:
    """(column_name, row_count, checksum): sums of value hashes, independent of the rows' order; * is the whole row.

    md5 takes the first 32 bits of an MD5 of the value's text, so that other engines can compute the same sums.
    """
    columns = sorted(columns or df.columns)

    def value(c: Column) -> Column:
        if method == "md5":
            text = F.coalesce(c.cast("string"), F.lit("\\N"))
            return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("decimal(38,0)")
        return F.xxhash64(c).cast("decimal(38,0)")

    if method == "md5":
        row = F.concat_ws("\x1f", *(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\\N")) for c in columns))
    else:
        row = F.struct(*(F.col(f"`{c}`") for c in columns))
    sums = df.agg(F.count(F.lit(1)).alias("row_count"), F.sum(value(row)).alias("h_all"), *(F.sum(value(F.col(f"`{c}`"))).alias(f"h{i}") for i, c in enumerate(columns)))
    rows = [F.struct(F.lit("*").alias("column_name"), F.col("h_all").alias("checksum"))] + [F.struct(F.lit(c).alias("column_name"), F.col(f"h{i}").alias("checksum")) for i, c in enumerate(columns)]
    return sums.select("row_count", F.explode(F.array(*rows)).alias("r")).select("r.column_name", "row_count", F.coalesce("r.checksum", F.lit(0).cast("decimal(38,0)")).cast("string").alias("checksum"))


def compare_fingerprints(before: DataFrame, after: DataFrame) -> DataFrame:
    """(column_name, matches): a full join of two fingerprints."""
    b = before.select("column_name", F.struct("row_count", "checksum").alias("b"))
    a = after.select("column_name", F.struct("row_count", "checksum").alias("a"))
    return b.join(a, "column_name", "full").select("column_name", F.coalesce(F.col("a") == F.col("b"), F.lit(False)).alias("matches"))


def diff_keyed(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that were added, removed or changed: keys, change and the changed columns, in name order."""
    columns = sorted(c for c in before.columns if c not in keys)
    b = before.select(*keys, F.struct(*columns).alias("b")).alias("x")
    a = after.select(*keys, F.struct(*columns).alias("a")).alias("y")
    changed = F.array_compact(F.array(*(F.when(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), F.lit(c)) for c in columns)))
    change = F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "removed").when(F.size(changed) > 0, "changed")
    match = reduce(lambda x, y: x & y, (F.col(f"x.{k}").eqNullSafe(F.col(f"y.{k}")) for k in keys))  # a null key is a key like others
    named = [F.coalesce(f"x.{k}", f"y.{k}").alias(k) for k in keys]
    out = b.join(a, match, "full").select(*named, change.alias("change"), F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), F.array_join(changed, ",")).alias("changed_columns"))
    return out.where("change is not null")


def diff_bags(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows with how often after has them more (+) or less (-) than before."""
    columns = before.columns
    both = before.select(*columns, F.lit(-1).alias("d")).union(after.select(*columns, F.lit(1)))
    return both.groupBy(*columns).agg(F.sum("d").alias("difference")).where("difference <> 0")


def rounded(df: DataFrame, digits: int = 12) -> DataFrame:
    """Doubles to so many significant digits, for comparing results of different plans."""
    return df.select(*(F.round(F.col(n) / F.pow(F.lit(10.0), F.floor(F.log10(F.abs(n)))), digits - 1).alias(n) if t == "double" else F.col(n) for n, t in df.dtypes))


def bags_equal(left: DataFrame, right: DataFrame) -> bool:
    if len(left.columns) != len(right.columns):
        return False
    return diff_bags(left, right.toDF(*left.columns)).isEmpty()


def violations(df: DataFrame, not_null: list[str] = (), unique: list[list[str]] = (), foreign: list[tuple[str, DataFrame, str]] = ()) -> DataFrame:
    """(rule, n): how many rows or keys break each declared constraint."""
    parts = [df.where(F.col(c).isNull()).agg(F.lit(f"not_null({c})").alias("rule"), F.count(F.lit(1)).alias("n")) for c in not_null]
    parts += [df.groupBy(*k).count().where("count > 1").agg(F.lit(f"unique({','.join(k)})").alias("rule"), F.count(F.lit(1)).alias("n")) for k in unique]
    parts += [df.where(F.col(c).isNotNull()).join(parent.select(F.col(k).alias("__k")).distinct(), F.col(c) == F.col("__k"), "left_anti").agg(F.lit(f"foreign({c})").alias("rule"), F.count(F.lit(1)).alias("n")) for c, parent, k in foreign]
    return reduce(DataFrame.union, parts)


def key_bins(df: DataFrame, key: str, heavy: int = 50, bins: int = 64) -> DataFrame:
    """Join statistics of a key: the heavy values by themselves, the others in ranges, each with rows and distinct values."""
    # Counted once where the session has a checkpoint folder.
    counts = df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.count("*").alias("n"))
    counts = counts.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else counts
    top = counts.orderBy(F.desc("n"), "k").limit(heavy).select("k", F.lit(True).alias("is_heavy"))
    edges = counts.agg(F.percentile_approx("k", [i / bins for i in range(1, bins)]).alias("edges"))
    marked = counts.join(F.broadcast(top), "k", "left").join(F.broadcast(edges))
    bin_of = F.when(F.col("is_heavy"), F.concat(F.lit("v"), F.col("k").cast("string"))).otherwise(F.concat(F.lit("r"), F.coalesce(F.size(F.filter("edges", lambda e: e < F.col("k"))), F.lit(0)).cast("string")))
    return marked.groupBy(bin_of.alias("bin")).agg(F.sum("n").alias("n"), F.count("*").alias("distinct_values"))


def row_order(df: DataFrame, keys: list[str]) -> DataFrame:
    """Groups of rows that tie on the keys: where a LIMIT or ROW_NUMBER over these keys would not be determined."""
    return df.groupBy(*keys).count().where("count > 1")
