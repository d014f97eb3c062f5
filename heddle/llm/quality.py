"""Quality classifier: a byte-level convolutional network in numpy.

Bytes become fixed feature vectors; learned filters slide over eight bytes in steps of four; their rectified outputs are
max-pooled over overlapping chunks of 512 bytes that cover the whole document, and the chunks' vectors are combined, as
their maximum, mean and minimum, into one probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.llm.common import small_batches
from heddle.llm.lm_scoring import blocks, fold
from heddle.llm.words import trim

#: Labelled documents that a model is fitted on at most, taken in the order of a hash of their ids.
MAX_LABELLED = 4000
FILTERS, FEATURES, STEP, HALF = 32, 12, 4, 256  # chunks are two halves; each half is shared by two chunks


@lru_cache(maxsize=1)
def byte_features() -> np.ndarray:
    """A vector for each byte: what kind of character it belongs to, and random components that tell bytes apart. 0 pads."""
    b = np.arange(256)
    upper, lower, digit = (b >= 65) & (b <= 90), (b >= 97) & (b <= 122), (b >= 48) & (b <= 57)
    space, line, high = b == 32, b == 10, b >= 128
    kinds = np.stack([upper, lower, digit, space, line, high, ~(upper | lower | digit | space | line | high)], axis=1).astype(np.float32)
    random = np.random.default_rng(7).normal(0, 0.5, (256, FEATURES - kinds.shape[1])).astype(np.float32)
    out = np.concatenate([kinds, random], axis=1)
    out[0] = 0
    return out


@dataclass
class Model:
    w: np.ndarray  # (STEP * FEATURES, 2 * FILTERS): the filters' first and second four bytes
    b: np.ndarray
    v: np.ndarray  # (3 * FILTERS,): weights of the chunks' maximum, mean and minimum
    c: float

    def parameters(self) -> list[np.ndarray]:
        return [self.w, self.b, self.v]


def _padded(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts' bytes in whole halves, and each text's first half."""
    halves = np.array([max(1, -(-len(t) // HALF)) for t in texts])
    first = np.cumsum(halves) - halves
    data = np.zeros(int(halves.sum()) * HALF, np.uint8)
    for t, at in zip(texts, (first * HALF).tolist(), strict=True):
        data[at : at + len(t)] = np.frombuffer(t, np.uint8)
    return data, first


#: Halves whose filter outputs are held at once; a text of any length takes this and a vector for each of its halves.
BLOCK = 512


def _pools(m: Model, data: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each half's largest output of each filter, rectified, and the step of four bytes that gave it."""
    n, steps = len(data) // HALF, HALF // STEP
    ends = np.zeros(n, bool)  # a filter's second part doesn't reach into the next text
    ends[np.append(first[1:], n) - 1] = True
    pooled, at = np.empty((n, FILTERS), np.float32), np.empty((n, FILTERS), np.int32)
    features = byte_features()
    for i in range(0, n, BLOCK):
        j = min(i + BLOCK, n)
        y = features[data[i * HALF : j * HALF + STEP]].reshape(-1, STEP * FEATURES) @ m.w
        second = np.zeros(((j - i) * steps, FILTERS), np.float32)
        second[: len(y) - 1] = y[1 : len(second) + 1, FILTERS:]
        second[(np.flatnonzero(ends[i:j]) + 1) * steps - 1] = 0
        out = (y[: len(second), :FILTERS] + second).reshape(j - i, steps, FILTERS)
        at[i:j] = out.argmax(axis=1)
        pooled[i:j] = np.maximum(out.max(axis=1) + m.b, 0)
    return pooled, at


def _forward(m: Model, texts: list[bytes]):
    data, first = _padded(texts)
    n = len(data) // HALF
    pooled, at = _pools(m, data, first)
    following = np.append(np.arange(1, n), n - 1)
    last = np.append(first[1:], n) - 1
    following[last] = last
    chunks = np.maximum(pooled, pooled[following])
    count = (last - first + 1)[:, None]
    most, mean, least = np.maximum.reduceat(chunks, first), np.add.reduceat(chunks, first) / count, np.minimum.reduceat(chunks, first)
    logits = np.concatenate([most, mean, least], axis=1) @ m.v + m.c
    return logits, (data, at, pooled, following, chunks, most, mean, least, first, count)


def probabilities(m: Model, texts: list[bytes]) -> np.ndarray:
    with np.errstate(over="ignore"):
        return 1 / (1 + np.exp(-_forward(m, texts)[0].astype(float)))


def _gradients(m: Model, texts: list[bytes], y: np.ndarray, of: int = 0) -> list[np.ndarray]:
    """The loss's gradients by w, b, v and c, as a part of `of` texts' mean."""
    logits, (data, best, pooled, following, chunks, most, mean, least, first, count) = _forward(m, texts)
    d = ((1 / (1 + np.exp(-logits)) - y) / (of or len(y))).astype(np.float32)
    dv = np.concatenate([most, mean, least], axis=1).T @ d
    dmost, dmean, dleast = (np.outer(d, v) for v in m.v.reshape(3, FILTERS))
    dmean /= count
    sizes = count[:, 0]
    dchunks = np.repeat(dmean, sizes, axis=0)
    for extreme, share in ((most, dmost), (least, dleast)):
        at = chunks == np.repeat(extreme, sizes, axis=0)
        dchunks += np.where(at, np.repeat(share / np.add.reduceat(at, first, dtype=np.float32), sizes, axis=0), 0)
    own = pooled >= pooled[following]
    dpooled = np.where(own, dchunks, 0)
    np.add.at(dpooled, following, np.where(own, 0, dchunks))
    dpooled *= pooled > 0
    # A filter's weights see only the steps that its maxima stand on, and the steps after those.
    features, steps = byte_features(), HALF // STEP
    ends = np.append(first[1:], len(pooled)) * steps - 1
    words = data.reshape(-1, STEP)
    dw = np.zeros_like(m.w)
    for i in range(0, len(pooled), BLOCK):
        g = dpooled[i : i + BLOCK]
        block = np.arange(i, i + len(g))[:, None] * steps + best[i : i + BLOCK]
        dw[:, :FILTERS] += np.einsum("hfk,hf->kf", features[words[block]].reshape(*g.shape, -1), g)
        inner = np.where(np.isin(block, ends), 0, g)
        dw[:, FILTERS:] += np.einsum("hfk,hf->kf", features[words[np.minimum(block + 1, len(words) - 1)]].reshape(*g.shape, -1), inner)
    return [dw, dpooled.sum(axis=0), dv, d.sum()]


def _summed_gradients(m: Model, texts: list[bytes], y: np.ndarray) -> list[np.ndarray]:
    """_gradients() of a batch, from parts of 256 KiB of text each, or one longer text."""
    total, at = None, 0
    for part in blocks(texts, 1 << 18):
        g = _gradients(m, part, y[at : at + len(part)], len(texts))
        at += len(part)
        total = g if total is None else [a + b for a, b in zip(total, g, strict=True)]
    return total


def fit(texts: list[bytes], labels: np.ndarray, epochs: int = 14, batch: int = 48, rate: float = 4e-3, seed: int = 11) -> Model:
    """A model for labels 0 and 1. Without texts it says 0.5; with one label only it says that label's smoothed share."""
    r = np.random.default_rng(seed)
    m = Model(r.normal(0, 0.15, (STEP * FEATURES, 2 * FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32), r.normal(0, 0.1, 3 * FILTERS).astype(np.float32), 0.0)
    share = (labels.sum() + 0.5) / (len(labels) + 1)
    m.c = float(np.log(share / (1 - share)))
    if len(set(labels.tolist())) < 2:
        m.v[:] = 0
        return m
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in [*m.parameters(), np.zeros(())]]
    step, steps = 0, epochs * -(-len(texts) // batch)
    for _ in range(epochs):
        order = r.permutation(len(texts))
        for at in range(0, len(order), batch):
            part = order[at : at + batch]
            step += 1
            now = rate * (1 - step / (steps + 1))
            for i, g in enumerate(_summed_gradients(m, [texts[k] for k in part], labels[part])):
                s = state[i]
                s[0] = 0.9 * s[0] + 0.1 * g
                s[1] = 0.99 * s[1] + 0.01 * g * g
                change = now * (s[0] / (1 - 0.9**step)) / (np.sqrt(s[1] / (1 - 0.99**step)) + 1e-8)
                if i < 3:
                    m.parameters()[i][...] -= change
                else:
                    m.c -= float(change)
    return m


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", max_labelled: int = MAX_LABELLED) -> Model:
    """Fits a model on at most max_labelled labelled documents. Rows without id or label aren't used; a null text is empty."""
    small_batches(docs.sparkSession)
    chosen = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("label_id"), F.col(label_col).cast("double").alias("y"))
    chosen = chosen.join(docs.select(F.col(id_col).alias("label_id")), "label_id", "left_semi")  # a label without a document takes no place
    chosen = chosen.orderBy(F.xxhash64("label_id"), "label_id", "y").limit(max_labelled)
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    rows = rows.join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id")).select("label_id", "text", "y").toPandas().sort_values(["label_id", "y", "text"])
    return fit([bytes(t) for t in rows["text"]], rows["y"].to_numpy(np.float32))


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) for every row and whole text: a map without a shuffle. Null and empty texts get the score of padding."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [probabilities(shared.value, part) for part in blocks((v.as_py() for v in batch.column(1)), 1 << 18)]
            trim()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(scores) if scores else np.empty(0))], ["doc_id", "score"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")


def keep_quality(docs: DataFrame, model: Model, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of docs that the model gives least or more, all columns as they were."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    small_batches(docs.sparkSession)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        parts = [probabilities(shared.value, p) for p in blocks((v.as_py() for v in texts), 1 << 18)]
        trim()
        return pa.array(np.concatenate(parts) if parts else np.empty(0))

    return docs.where(score(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary")) >= least)


def held_out_scores(docs: DataFrame, labels: DataFrame, folds: int = 3, held_fold: int = 1) -> DataFrame:
    """(doc_id, held_out, score, predicted): fitted on labelled rows outside the held-out fold, then every row scored."""
    model = train(docs, labels.where(fold(F.col("doc_id"), folds) != held_fold))
    out = score_documents(docs, model)
    return out.select("doc_id", (fold(F.col("doc_id"), folds) == held_fold).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
