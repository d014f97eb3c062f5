"""What the training-data operators share: reading tables, scratch tables in the cluster's shared folder, document classes."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar
from functools import reduce, wraps

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as the operators' contracts define it.
SPACE = r"[\x20\x09-\x0D]"

_LOCAL: dict[str, str] = {}
_LEFT: dict[str, SparkSession] = {}  # scratch tables outside any tidy() call
_MADE: ContextVar[list[list[str]]] = ContextVar("made", default=[])  # those of the tidy() calls that run, in this thread
#: Rows of a batch that goes to Python.
BATCH_ROWS = 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a temporary one in local mode, whose
    only executor is the driver; a cluster must name one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = _LOCAL.setdefault("root", tempfile.mkdtemp(prefix="heddle-"))
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder. It goes when the tidy() call that it was made in ends, else with the driver's Python."""
    path = f"{shared_dir(spark)}/heddle/{name}-{uuid.uuid4().hex}"
    if made := _MADE.get():
        made[-1].append(path)
    else:
        _LEFT[path] = spark
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a scratch path, whatever file system it is on."""
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session has ended: the folder goes with the cluster's clean-up
        pass
    _LEFT.pop(path, None)


@atexit.register
def _clean() -> None:
    for path, spark in list(_LEFT.items()):
        remove(spark, path)


def small_batches(spark: SparkSession) -> None:
    """From now on the session sends Python BATCH_ROWS rows at a time at most, so that a batch of long texts fits a worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)


def free_shuffles(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files that no table here needs: their handles may hang on cycles in Python, so those go first."""
    gc.collect()
    spark._jvm.System.gc()


def discard(df: DataFrame) -> None:
    """Deletes a table of materialise() before the end of the tidy() call that it was made in."""
    for f in df.inputFiles()[:1]:
        remove(df.sparkSession, f.rsplit("/", 1)[0])


def materialise(df: DataFrame, name: str, free: bool = False) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends there, and a lost executor costs one task's rows at most.

    free: the shuffle files behind it were large; Spark drops them once their handles are collected.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    small_batches(spark)
    df.write.parquet(path)
    if free:
        free_shuffles(spark)
    return spark.read.schema(df.schema).parquet(path)


def tidy(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """f with its result written, and the scratch tables that this call made on the way deleted once that is done."""

    @wraps(f)
    def run(*args, **kwargs) -> DataFrame:
        made: list[str] = []
        token = _MADE.set([*_MADE.get(), made])
        try:
            df = f(*args, **kwargs)
        finally:
            _MADE.reset(token)
        out = materialise(df, f.__name__, free=True)  # belongs to the caller
        for path in made:
            remove(df.sparkSession, path)
        return out

    return run


#: Bytes of Parquet up to which a join's smaller side is broadcast; beyond it both sides are shuffled.
BROADCAST_BYTES = 24 << 20


def fitted_join(rows: DataFrame, side: DataFrame, on: list[str], how: str, most: int = BROADCAST_BYTES) -> DataFrame:
    """rows joined null-safely with a written side: broadcast if its files are small, else by a shuffle whose hot keys Spark splits."""
    side = materialise(side, "side")
    spark = side.sparkSession
    size = 0
    for f in side.inputFiles()[:1]:
        p = spark._jvm.org.apache.hadoop.fs.Path(f).getParent()
        size = p.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(p).getLength()
    named = side.toDF(*(f"side_{c}" for c in side.columns))
    if size <= most:
        named = F.broadcast(named)
    match = reduce(lambda a, b: a & b, (rows[c].eqNullSafe(named[f"side_{c}"]) for c in on))
    out = rows.join(named, match, how).drop(*(f"side_{c}" for c in on))
    return out.withColumnsRenamed({f"side_{c}": c for c in side.columns if c not in on})


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of links(a, b): (id, root), root the smallest id that is reachable; ids without links are absent.

    Alternating large-star and small-star rounds, each one a written table: rounds grow with the logarithm of the
    component size, no list of neighbours is collected, and the hub of a large star is a grouping key of a partial aggregate.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = materialise(edges, "edges")
    before = None
    for _ in range(max_rounds):
        seen = Observation()
        edges = materialise(_small_star(_large_star(edges)).observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum")), "edges")
        now = seen.get
        if not now["n"] or now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not converge")
    roots = edges.select(F.col("u").alias("id"), F.col("v").alias("root"))
    return roots.union(edges.select("v", "v").distinct())


def _large_star(edges: DataFrame) -> DataFrame:
    """Links each larger neighbour of a node to the smallest of the node and its neighbours."""
    both = edges.union(edges.select("v", "u")).toDF("n", "m")
    least = both.groupBy("n").agg(F.min("m").alias("least")).select("n", F.least("n", "least").alias("least"))
    return both.where("m > n").join(least, "n").select(F.col("m").alias("u"), F.col("least").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Links each node and its smaller neighbours to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("least"))
    moved = edges.join(least, "u").select(F.col("v").alias("a"), F.col("least").alias("b"))
    return moved.union(least.select("u", "least")).toDF("u", "v").where("u <> v").distinct()
