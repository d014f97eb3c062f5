"""Removal of repeated substrings: every byte that a string of min_bytes bytes covers which also starts anywhere else.

The plan is that of a difference-cover suffix sort, cut off at depth min_bytes, over a content-defined cover:

1. Sample. Each window of min_bytes bytes is given the anchor of windows.anchors(); equal windows have equal anchors at
   equal offsets. A sampled row stands for the run of consecutive windows with one anchor: (name, run name, place).
2. Sort the samples by name. Windows whose name is unique are unique: no further row is made for them.
3. Recurse on names: among rows with one name, those with one run name are equal over the whole run, so all of their
   windows repeat. Only runs that share the name and differ stay open: the edges of repeated passages.
4. Merge what remains: the open runs' windows are compared with those of the other runs of the same name.

Names are 64-bit hashes that are compared inside a group of equal 64-bit anchor names, 128 bits in effect.

Hot names: a name's count and a run's count come from partial aggregates; rows meet names in joins whose hot keys Spark
splits; the runs that step 4 holds together are distinct ones, and a name with more than HOT_RUNS distinct runs is
resolved window by window in a partial aggregate of its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.llm.common import fitted_join, materialise, tidy
from heddle.llm.windows import PIECE, anchors, window_hashes
from heddle.llm.words import trim

MIN_BYTES = 200
ANCHOR_BYTES = 64
#: Distinct runs of one name that a task compares at once.
HOT_RUNS = 1000
#: Bytes of runs that a task gathers before it compares them.
GATHER_BYTES = 1 << 18


@tidy
def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_bytes: int = MIN_BYTES, hot_runs: int = HOT_RUNS) -> DataFrame:
    """(doc, mark, starts, ends): the maximal removed runs of each row that has any, as byte offsets.

    A row is known by its id and the hash of its text. Null texts count as empty; texts shorter than min_bytes have no
    spans; rows that repeat an id and a text repeat each other; an empty table gives no rows.
    """
    keyed = with_key(docs, id_col, text_col)
    sampled = materialise(_samples(keyed, min_bytes), "samples")
    names = sampled.groupBy("name").agg(F.count("*").alias("n"), F.min("run").alias("least"), F.max("run").alias("most")).where("n > 1")
    names = materialise(names.select("name", (F.col("least") == F.col("most")).alias("same")), "names", free=True)
    repeated = materialise(sampled.join(names, "name"), "repeated", free=True)

    mixed = repeated.where("not same")
    runs = mixed.groupBy("name", "run").agg(F.count("*").alias("n"), F.min(F.struct("doc", "mark", "place")).alias("first"))
    runs = materialise(runs.select("name", "run", "n", "first.*"), "runs")
    equal = mixed.join(runs.where("n > 1").select("name", "run"), ["name", "run"])
    whole = repeated.where("same").select("doc", "mark", "place").union(equal.select("doc", "mark", "place"))
    start = F.shiftright("place", 8)
    whole = whole.select("doc", "mark", start.alias("start"), (start + F.col("place").bitwiseAND(255) + (min_bytes - 1)).alias("end"))

    wide = runs.groupBy("name").count().where(F.col("count") > hot_runs).select("name")
    texts = materialise(_run_texts(keyed, runs, min_bytes), "run-texts", free=True)
    edges = _edges(texts.join(F.broadcast(wide) if wide.count() < 100_000 else wide, "name", "left_anti"), min_bytes)
    if not wide.isEmpty():
        edges = edges.union(_wide_edges(texts.join(wide, "name"), min_bytes))
    spans = whole.union(edges).groupBy("doc", "mark").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    return _merged(spans)


def with_key(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, mark, text): the id, the text's hash, the text as bytes."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(text).alias("mark"), text.cast("binary").alias("text"))


def _samples(keyed: DataFrame, min_bytes: int) -> DataFrame:
    assert ANCHOR_BYTES < min_bytes < ANCHOR_BYTES + 255

    def sample(parts: list[tuple[int, int, memoryview]]) -> pa.RecordBatch:
        """parts: (row in batch, offset in its text, bytes); windows don't cross from one to the next."""
        raw = b"".join(p[2] for p in parts)
        data = np.frombuffer(raw, np.uint8)
        ends = np.cumsum([len(p[2]) for p in parts])
        valid = np.ones(max(0, len(data) - min_bytes + 1), bool)
        for e in ends[:-1].tolist():
            valid[max(0, e - min_bytes + 1) : e] = False
        first, count, _, names = anchors(data, valid, min_bytes, ANCHOR_BYTES)
        view, digest = memoryview(raw), xxhash.xxh3_64_intdigest
        runs = np.fromiter((digest(view[a : a + n + min_bytes - 1]) for a, n in zip(first.tolist(), count.tolist(), strict=True)), np.uint64, len(first))
        part = np.searchsorted(ends, first, side="right")
        begins = ends - np.array([len(p[2]) for p in parts])
        start = first - begins[part] + np.array([p[1] for p in parts])[part]
        row = np.array([p[0] for p in parts])[part]
        return row, names.view(np.int64), runs.view(np.int64), (start << 8) | count

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, marks = batch.column(0), batch.column(1)
            parts, size = [], 0
            for i, value in enumerate(batch.column(2)):
                view = memoryview(value.as_buffer())
                for at in range(0, max(1, len(view) - min_bytes + 1), PIECE):
                    piece = view[at : at + PIECE + min_bytes - 1]
                    if len(piece) < min_bytes:
                        continue
                    parts.append((i, at, piece))
                    size += len(piece)
                    if size >= PIECE:
                        yield _sample_rows(docs, marks, *sample(parts))
                        parts, size = [], 0
            if parts:
                yield _sample_rows(docs, marks, *sample(parts))

    return keyed.mapInArrow(run, "doc long, mark long, name long, run long, place long")


def _sample_rows(docs: pa.Array, marks: pa.Array, row: np.ndarray, names: np.ndarray, runs: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
    at = pa.array(row)
    return pa.RecordBatch.from_arrays([docs.take(at), marks.take(at), pa.array(names), pa.array(runs), pa.array(place)], ["doc", "mark", "name", "run", "place"])


def _run_texts(keyed: DataFrame, runs: DataFrame, min_bytes: int) -> DataFrame:
    """(name, doc, mark, place, known, bytes) for one place of each distinct open run; known: the whole run repeats anyway."""
    wanted = runs.groupBy("doc", "mark").agg(F.collect_list(F.struct("name", "place", (F.col("n") > 1).alias("known"))).alias("wanted"))
    rows = fitted_join(keyed, wanted, ["doc", "mark"], "inner")  # a row that repeats only repeats runs that are known

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, mark, text, wanted in zip(*(batch.column(c) for c in ("doc", "mark", "text", "wanted")), strict=True):
                view, doc, mark = memoryview(text.as_buffer()), doc.as_py(), mark.as_py()
                out = []
                for w in wanted.as_py():
                    start, n = w["place"] >> 8, w["place"] & 255
                    out.append((w["name"], doc, mark, w["place"], w["known"], bytes(view[start : start + n + min_bytes - 1])))
                columns = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TEXT_TYPES, strict=True)], ["name", "doc", "mark", "place", "known", "bytes"])

    return rows.select("doc", "mark", "text", "wanted").mapInArrow(run, "name long, doc long, mark long, place long, known boolean, bytes binary")


_TEXT_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]


def _window_rows(names: np.ndarray, places: np.ndarray, texts: list[bytes], min_bytes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the run, window start, hash of name and window) for all windows of the runs."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    (h,) = window_hashes(data, min_bytes)
    n = places & 255
    begins = np.cumsum([0] + [len(t) for t in texts[:-1]])
    which = np.repeat(np.arange(len(texts)), n)
    within = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
    return which, (places >> 8)[which] + within, h[begins[which] + within] ^ (names.view(np.uint64)[which] * np.uint64(0x9E3779B97F4A7C15))


def _edges(texts: DataFrame, min_bytes: int) -> DataFrame:
    """Spans of the open runs' repeated windows; all distinct runs of a name meet in one task."""

    def compare(rows: list[tuple]) -> pa.RecordBatch:
        names, docs, marks, places, known, raw = zip(*rows, strict=True)
        which, start, keys = _window_rows(np.array(names, np.int64), np.array(places, np.int64), list(raw), min_bytes)
        order = np.argsort(keys, kind="stable")
        s = keys[order]
        equal = s[1:] == s[:-1]
        twice = np.zeros(len(keys), bool)
        twice[order[1:]] |= equal
        twice[order[:-1]] |= equal
        twice &= ~np.array(known)[which]
        return _span_rows(docs, marks, which[twice], start[twice], min_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size, last = [], 0, None
        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size >= GATHER_BYTES and r[0] != last:
                    yield compare(rows)
                    rows, size = [], 0
                rows.append(r)
                size += len(r[5])
                last = r[0]
        if rows:
            yield compare(rows)
        trim()

    return texts.repartition("name").sortWithinPartitions("name").mapInArrow(run, _SPAN)


_SPAN = "doc long, mark long, start long, end long"


def _span_rows(docs, marks, which: np.ndarray, start: np.ndarray, min_bytes: int) -> pa.RecordBatch:
    """Runs of consecutive window starts of one row as spans."""
    if not len(which):
        return pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 4, ["doc", "mark", "start", "end"])
    cut = np.ones(len(which), bool)
    cut[1:] = (which[1:] != which[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(cut)
    last = np.append(first[1:], len(which)) - 1
    rows = which[first].tolist()
    return pa.RecordBatch.from_arrays([pa.array([docs[i] for i in rows], pa.int64()), pa.array([marks[i] for i in rows], pa.int64()), pa.array(start[first]), pa.array(start[last] + min_bytes)], ["doc", "mark", "start", "end"])


def _wide_edges(texts: DataFrame, min_bytes: int) -> DataFrame:
    """As _edges(), window by window, for names with very many distinct runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                names, docs, marks, places, known, raw = (c.to_pylist() for c in batch.slice(at, 256).columns)
                which, start, keys = _window_rows(np.array(names, np.int64), np.array(places, np.int64), raw, min_bytes)
                yield pa.RecordBatch.from_arrays([pa.array(np.array(names, np.int64)[which]), pa.array(keys.view(np.int64)), pa.array([docs[i] for i in which], pa.int64()), pa.array([marks[i] for i in which], pa.int64()), pa.array(start), pa.array(np.array(known)[which])], ["name", "window", "doc", "mark", "start", "known"])

    windows = materialise(texts.select("name", "doc", "mark", "place", "known", "bytes").mapInArrow(run, "name long, window long, doc long, mark long, start long, known boolean"), "windows")
    twice = windows.groupBy("name", "window").count().where("count > 1").select("name", "window")
    return windows.where("not known").join(twice, ["name", "window"]).select("doc", "mark", "start", (F.col("start") + min_bytes).alias("end"))


def merge(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The maximal runs of overlapping or touching spans."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    first = np.append(True, starts[1:] > ends[:-1])
    return starts[first], ends[np.append(np.flatnonzero(first)[1:], len(starts)) - 1]


def _merged(spans: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            offsets, flat = lists.offsets.to_numpy(), lists.values
            s, e = flat.field(0).to_numpy(), flat.field(1).to_numpy()
            found = [merge(s[a:b], e[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            kind = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([f[0] for f in found], kind), pa.array([f[1] for f in found], kind)], ["doc", "mark", "starts", "ends"])

    return spans.select("doc", "mark", "spans").mapInArrow(run, "doc long, mark long, starts array<long>, ends array<long>")


def _kept(text: memoryview, starts: list[int] | None, ends: list[int] | None) -> Iterator[memoryview]:
    at = 0
    for s, e in zip(starts or (), ends or (), strict=True):
        yield text[at:s]
        at = e
    yield text[at:]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_bytes: int = MIN_BYTES) -> DataFrame:
    """docs with the repeated bytes cut out of their texts, all other columns as they were.

    Cuts are made between bytes; a character that a cut divides goes as well. A null text stays null.
    """
    spans = repeated_spans(docs, id_col, text_col, min_bytes)
    given = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)), F.col(id_col).cast("long").alias("doc"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("mark"))
    joined = fitted_join(given, spans, ["doc", "mark"], "left")
    text = f"c{docs.columns.index(text_col)}"

    @F.arrow_udf("string")
    def cut(texts: pa.Array, starts: pa.Array, ends: pa.Array) -> pa.Array:
        out = []
        for t, s, e in zip(texts.to_pylist(), starts.to_pylist(), ends.to_pylist(), strict=True):
            out.append(t if t is None or s is None else b"".join(_kept(memoryview(t.encode()), s, e)).decode("utf-8", "ignore"))
        return pa.array(out, pa.string())

    joined = joined.withColumn(text, F.when(F.col("starts").isNull(), F.col(text)).otherwise(cut(text, "starts", "ends")))
    return joined.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)))


def removal_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_bytes: int = MIN_BYTES) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for each row."""
    spans = repeated_spans(docs, id_col, text_col, min_bytes)
    joined = fitted_join(with_key(docs, id_col, text_col), spans, ["doc", "mark"], "left").select("doc", "text", "starts", "ends")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, starts, ends in zip(batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                view, digest, kept = memoryview(text.as_buffer()), hashlib.sha256(), 0
                for part in _kept(view, starts, ends):
                    digest.update(part)
                    kept += len(part)
                out.append((len(view), len(view) - kept, len(starts or ()), digest.hexdigest()))
            a, b, c, d = zip(*out, strict=True) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.int64()), pa.array(d, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
