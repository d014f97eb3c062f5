"""Exact top-k search by inner product over integer vectors.

Candidates are laid out by descending length in a basis of their own principal directions. A query block scans a
partition's candidates in that order: the leading rotated components give a partial sum, the Cauchy-Schwarz inequality
bounds the rest, and what cannot reach the query's present k-th score is passed over; once a length alone is too short,
so are all later ones. Scores of what remains are computed on the integers, so results are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heddle.llm.common import materialise

SCALE = 256
K = 5
#: Queries that are sent to the tasks at once.
BLOCK = 4096
#: Candidates that a query block is compared with at once.
CHUNK = 2048


def quantised(vector: Column) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE).cast("double"))


def usable(vector: Column) -> Column:
    """Neither null nor with a component that is null, NaN or infinite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    """Rows of one width: shorter vectors end in zeros."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
    out = np.zeros((len(lists), d))
    n = np.diff(offsets)
    row = np.repeat(np.arange(len(lists)), n)
    out[row, np.arange(len(row)) - np.repeat(offsets[:-1] - offsets[0], n)] = flat[offsets[0] : offsets[-1]]
    return out


def rotation(vectors: DataFrame, d: int) -> np.ndarray:
    """The principal directions of vectors(v array<double>), strongest first: an orthogonal d x d matrix.

    The Gram matrix is summed cell by cell over the cluster; d * d numbers reach the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram = np.zeros((d, d))
        for batch in batches:
            x = _matrix(batch.column(0), d)
            gram += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d * d)), pa.array(gram.ravel())], ["cell", "x"])

    cells = vectors.mapInArrow(run, "cell long, x double").groupBy("cell").agg(F.sum("x").alias("x")).toPandas()
    gram = np.zeros(d * d)
    gram[cells["cell"].to_numpy()] = cells["x"].to_numpy()
    return np.linalg.eigh(gram.reshape(d, d))[1][:, ::-1]


def top_k(vectors: DataFrame, queries: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products of each query row, ties to the smaller id.

    queries says which rows ask; candidates are all rows with another id. Rows whose id is null or whose vector is not
    usable take no part; vectors of unequal width are compared as if the shorter ended in zeros; rows that repeat an id
    are candidates each, and of queries that repeat an id the largest vector, in array order, asks. An empty table gives
    no rows.
    """
    spark = vectors.sparkSession
    given = vectors.where(usable(F.col(vector_col)) & F.col(id_col).isNotNull())
    rows = given.select(F.col(id_col).cast("long").alias("vec_id"), F.coalesce(queries, F.lit(False)).alias("asks"), quantised(F.col(vector_col)).alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    rows = materialise(rows.withColumn("norm", norm), "vectors")
    d = rows.agg(F.max(F.size("v"))).first()[0]
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if not d:
        d = 1
    basis = rotation(rows.select("v"), d)
    lead = max(1, d // 4)
    sorted_rows = materialise(rows.select("vec_id", "norm", "v").repartitionByRange(F.desc("norm"), "vec_id").sortWithinPartitions(F.desc("norm")), "by-length")
    asking = rows.where("asks").groupBy("vec_id").agg(F.max("v").alias("v"))
    n_blocks = -(-asking.count() // block)
    asking = materialise(asking.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(max(1, n_blocks)))), "queries")
    seeds = sorted_rows.orderBy(F.desc("norm")).limit(CHUNK).select("vec_id", "v").toArrow()  # long vectors, for first bounds
    found = empty
    for b in range(n_blocks):
        asked = asking.where(F.col("block") == b).select("vec_id", "v").toArrow()  # about block rows
        q, ids = _matrix(asked.column("v"), d), asked.column("vec_id").to_numpy()
        floor = _floors(q, ids, _matrix(seeds.column("v"), d), seeds.column("vec_id").to_numpy(), k)
        shared = spark.sparkContext.broadcast((q, ids, floor, basis))
        part = sorted_rows.mapInArrow(_scan(shared, d, lead, k), "query_id long, vec_id long, score long")
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        part = part.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        found = found.union(materialise(part, "found") if n_blocks > 1 else part)
    return found


def _floors(q: np.ndarray, ids: np.ndarray, x: np.ndarray, x_ids: np.ndarray, k: int) -> np.ndarray:
    """A lower bound of each query's k-th score, from some candidates."""
    if len(x) <= k:
        return np.full(len(q), -np.inf)
    scores = q @ x.T
    scores[ids[:, None] == x_ids] = -np.inf
    return -np.partition(-scores, k - 1, axis=1)[:, k - 1]


def _scan(shared, d: int, lead: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, ids, floor, basis = shared.value
        floor = floor.copy()
        rotated = q @ basis
        head, length = rotated[:, :lead], np.linalg.norm(q, axis=1)
        rest = np.sqrt(np.maximum(length**2 - (head**2).sum(axis=1), 0))
        best = [np.full((len(q), 0), -np.inf), np.empty((len(q), 0), np.int64)]
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                part = batch.slice(at, CHUNK)
                x_ids, norms, x = part.column(0).to_numpy(), part.column(1).to_numpy(), _matrix(part.column(2), d)
                slack = 1e-9 * (1 + length * norms[0])
                active = np.flatnonzero(length * norms[0] + slack >= floor)  # for the others this and all later ones are too short
                if not len(active):
                    break
                xr = x @ basis[:, :lead]
                x_rest = np.sqrt(np.maximum(norms**2 - (xr**2).sum(axis=1), 0))
                bound = head[active] @ xr.T + rest[active, None] * x_rest + slack[active, None]
                near = bound >= floor[active, None]
                near &= ids[active, None] != x_ids
                scores = np.full(near.shape, -np.inf)
                if near.mean() > 0.2:
                    scores = np.where(near, q[active] @ x.T, -np.inf)
                else:
                    i, j = np.nonzero(near)
                    for s in range(0, len(i), 1 << 16):
                        scores[i[s : s + (1 << 16)], j[s : s + (1 << 16)]] = np.einsum("nd,nd->n", q[active[i[s : s + (1 << 16)]]], x[j[s : s + (1 << 16)]])
                _merge(best, active, scores, x_ids, k)
                if best[0].shape[1] == k:
                    floor = np.maximum(floor, best[0][:, -1])
        row, col = np.nonzero(best[0] >= np.maximum(floor, -1e300)[:, None]) if best[0].size else (np.empty(0, int),) * 2
        yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(best[1][row, col]), pa.array(best[0][row, col].astype(np.int64))], ["query_id", "vec_id", "score"])

    return run


def _merge(best: list[np.ndarray], active: np.ndarray, scores: np.ndarray, x_ids: np.ndarray, k: int) -> None:
    """Takes a chunk's scores into the k best of the active queries, by score and then by id."""
    if scores.shape[1] > 4 * k:  # only what ties with the k-th best of the chunk, or beats it
        cut = -np.partition(-scores, k - 1, axis=1)[:, k - 1]
        i, j = np.nonzero((scores >= cut[:, None]) & (scores > -np.inf))
        s = scores[i, j]
        order = np.lexsort((x_ids[j], -s, i))
        i, j, s = i[order], j[order], s[order]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        i, j, s, place = (a[place < k] for a in (i, j, s, place))
        short, names = np.full((len(active), k), -np.inf), np.full((len(active), k), np.iinfo(np.int64).max)
        short[i, place], names[i, place] = s, x_ids[j]
    else:
        short, names = scores, np.broadcast_to(x_ids, scores.shape)
    if best[0].shape[1] < k:
        grown = k - best[0].shape[1]
        best[0] = np.concatenate([best[0], np.full((len(best[0]), grown), -np.inf)], axis=1)
        best[1] = np.concatenate([best[1], np.full((len(best[1]), grown), np.iinfo(np.int64).max)], axis=1)
    s, n = np.concatenate([best[0][active], short], axis=1), np.concatenate([best[1][active], names], axis=1)
    order = np.lexsort((n, -s), axis=1)[:, :k]
    best[0][active], best[1][active] = np.take_along_axis(s, order, axis=1), np.take_along_axis(n, order, axis=1)
