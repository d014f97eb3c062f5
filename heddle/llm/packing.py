"""Best-fit packing of token sequences into bins under several capacities: tokens, documents, attention cost.

Pieces of one length are alike in every capacity, so a packing is decided on the histogram of lengths: at most
max_tokens numbers, whatever the corpus. The bins of one residual vector form a class; each length, longest first, goes
to the class that fits best, as many pieces at once as the class has bins. The decisions are intervals of piece ranks that map
to intervals of bin numbers; pieces take their places from them without a sort of the corpus.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heddle.llm.common import materialise, small_batches
from heddle.llm.words import trim

MAX_TOKENS = 4096
#: Words whose ids a Python worker keeps, beside those of the text at hand; then the rarer half goes.
CACHED_WORDS = 100_000


@dataclass(frozen=True)
class Limits:
    """What a bin holds at most. None: no limit. Attention cost is the sum of the squared lengths of a bin's pieces."""

    tokens: int = MAX_TOKENS
    documents: int | None = None
    attention: int | None = None


def plan(counts: dict[int, int], limits: Limits, weights: tuple[float, float, float] = (1.0, 1.0, 1.0), rule: str = "norm") -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over {length: pieces}: rows (length, first rank, pieces, first bin, offset).

    Pieces rank, ..., rank + pieces - 1 of a length go to bins first bin, ... at that offset. rule: among the classes of
    bins where a piece fits under every capacity, "norm" takes the one with the least weighted norm of what is left
    over, relative to the capacities; "dot" the one with the greatest weighted dot product of demand and residual.
    A piece that fits no empty bin is an error.
    """
    used = np.array([True, limits.documents is not None, limits.attention is not None])
    caps = np.where(used, [limits.tokens, limits.documents or 1, limits.attention or 1], 0)
    scale = np.where(used, 1.0 / np.maximum(caps, 1), 0.0)
    w = np.array(weights) * used
    classes = np.zeros((64, 3), np.int64)  # residuals of the classes, those without bins among them
    alive = np.zeros(64, bool)
    number: dict[tuple[int, ...], int] = {}
    runs: list[list[tuple[int, int]]] = []  # for each class its bins, as (first, count)
    out: list[tuple[int, int, int, int, int]] = []
    bins = 0

    def hold(residual: np.ndarray, first: int, count: int) -> None:
        nonlocal classes, alive
        if (residual[used] <= 0).any():
            return
        key = tuple(residual.tolist())
        if (c := number.setdefault(key, len(runs))) == len(runs):
            runs.append([])
            if c == len(classes):
                classes, alive = np.concatenate([classes, np.zeros_like(classes)]), np.concatenate([alive, np.zeros_like(alive)])
            classes[c] = residual
        runs[c].append((first, count))
        alive[c] = True

    for length in sorted(counts, reverse=True):
        need = np.where(used, [length, 1, length * length], 0)
        if (need > caps).any():
            raise ValueError(f"a piece of {length} tokens fits no bin")
        rank, left = 0, counts[length]
        while left:
            n = len(runs)
            fits = np.flatnonzero(alive[:n] & (classes[:n] >= need).all(axis=1))
            if not len(fits):
                each = int(min(c // d for c, d in zip(caps[used], need[used], strict=True)))
                new = max(1, left // each)  # new bins, which take as many of this length as they hold
                hold(caps, bins, new)
                bins += new
                continue
            fit = classes[fits]
            if rule == "norm":
                c = fits[np.argmin((w * ((fit - need) * scale) ** 2).sum(axis=1))]
            else:
                c = fits[np.argmax((w * need * scale * fit * scale).sum(axis=1))]
            first, count = runs[c].pop()
            take = min(count, left)
            if take < count:
                runs[c].append((first + take, count - take))
            alive[c] = bool(runs[c])
            out.append((length, rank, take, first, limits.tokens - int(classes[c][0])))
            hold(classes[c] - need, first, take)
            rank, left = rank + take, left - take
    return out


#: Characters whose words need no normaliser but lower-casing: ASCII and the letters of Latin-1.
_PLAIN = re.compile("[\x00-\x7f\xc0-\xd6\xd8-\xf6\xf8-\xff]*")
#: The tokenizer's own pre-splitting over those characters, once they are lower case.
_PRE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[^\\sa-z0-9\xdf-\xf6\xf8-\xff]+", re.ASCII)
_SPACES = {9: 32, 10: 32, 11: 32, 12: 32, 13: 32}


def _byte_letters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in plain}
    for b in range(256):
        letters.setdefault(b, chr(256 + len(letters) - len(plain)))
    return [letters[b] for b in range(256)]


class WordEncoder:
    """Ids of texts under a tokenizer that drops white space, each word or part of a word encoded once for a worker.

    Plain words are split and lower-cased here and go straight to the tokenizer's model; all others, one by one, through
    the whole tokenizer. No rule of the tokenizer reaches across white space, so a text's ids are those of its words.
    """

    def __init__(self, path: str, most: int = CACHED_WORDS) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # special tokens' strings are ordinary text
        self.model, self.letters, self.most = self.tokenizer.model, _byte_letters(), most
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.begins, self.flat, self.uses = np.zeros(1024, np.int64), np.zeros(4096, "<u4"), np.zeros(1024, np.int32)

    def add(self, words: list[str], n: np.ndarray, ids: np.ndarray) -> None:
        """words, none of them known; n: how many of ids each has."""
        first, until = len(self.known), len(self.known) + len(words)
        ends = self.begins[first] + np.cumsum(n)
        while until + 1 > len(self.begins):
            self.begins, self.uses = np.append(self.begins, np.zeros_like(self.begins)), np.append(self.uses, np.zeros_like(self.uses))
        while ends[-1] > len(self.flat):
            self.flat = np.append(self.flat, np.zeros_like(self.flat))
        self.flat[self.begins[first] : ends[-1]] = ids
        self.begins[first + 1 : until + 1] = ends
        self.known.update(zip(words, range(first, until), strict=True))

    def gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many ids the known words at these places have, and their ids, one word after another."""
        first, n = self.begins[at], self.begins[at + 1] - self.begins[at]
        before = np.cumsum(n) - n
        return n, self.flat[np.arange(int(n.sum())) + np.repeat(first - before, n)]

    def thin(self) -> None:
        """Forgets the half of the words that the fewest texts used, of late above all."""
        uses = self.uses[: len(self.known)]
        kept = np.sort(np.argsort(-uses, kind="stable")[: len(uses) // 2])
        (n, ids), words = self.gather(kept), list(self.known)
        self.clear()
        if len(kept):
            self.add(list(map(words.__getitem__, kept.tolist())), n, ids)
            self.uses[: len(kept)] = uses[kept] >> 1

    def parts(self, text: str) -> tuple[list[str], set[str]]:
        """The words' parts in order, and those of them that are no plain ones."""
        if _PLAIN.fullmatch(text):
            return _PRE.findall(text.lower()), set()
        out, odd = [], set()
        for w in text.translate(_SPACES).split(" "):
            if _PLAIN.fullmatch(w):
                out += _PRE.findall(w.lower())
            else:
                out.append("\0" + w)  # never equal to a plain part with another meaning: those hold no character of w
                odd.add(out[-1])
        return out, odd

    def ids(self, word: str, odd: bool) -> list[int]:
        if odd:
            return self.tokenizer.encode(word[1:], add_special_tokens=False).ids
        if not (word.isascii() and word.isprintable()):  # the letters of printable bytes are the bytes
            word = "".join([self.letters[b] for b in word.encode()])
        return [t.id for t in self.model.tokenize(word)]

    def encode(self, text: str) -> np.ndarray:
        parts, odd = self.parts(text)
        if len(self.known) > self.most:
            self.thin()
        known = self.known
        at = np.fromiter(map(known.get, parts, repeat(-1)), np.int64, len(parts))
        new = np.flatnonzero(at < 0).tolist()
        if new:
            words = list(dict.fromkeys([parts[i] for i in new]))
            ids = [self.ids(w, w in odd) for w in words]
            n = np.fromiter(map(len, ids), np.int64, len(ids))
            self.add(words, n, np.fromiter(chain.from_iterable(ids), "<u4", int(n.sum())))
            at[new] = [known[parts[i]] for i in new]
        self.uses[at] += 1
        return self.gather(at)[1]


@lru_cache(maxsize=4)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def tokenise(docs: DataFrame, path: str, end_id: int = 1, max_tokens: int = MAX_TOKENS, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, rank: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32 [, ids] [, part, local]): each text's ids, then end_id, cut into pieces of max_tokens; the last may be shorter.

    A null text is empty, so that its one piece is the end id. rank: with the columns of ranked(), from the same Python worker;
    a node of its own would take a second worker for each core, and Spark keeps those for a minute.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_encoder(path).encode
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                out, kept = [], []
                for doc, text in zip(batch.column(0)[at : at + 512].to_pylist(), batch.column(1)[at : at + 512], strict=True):
                    ids = np.append(encode(text.as_py().decode("utf-8", "replace")), np.uint32(end_id)).astype("<u4", copy=False)
                    for k, start in enumerate(range(0, len(ids), max_tokens)):
                        part = ids[start : start + max_tokens]
                        out.append((doc, k, start, len(part), zlib.crc32(part.data)))
                        if with_ids:
                            kept.append(part.astype("<i4"))
                columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
                if with_ids:
                    columns.append(pa.array(kept, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names)
            trim()

    names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    if rank:
        return rows.mapInArrow(lambda batches: _with_ranks(run(batches), "length"), f"{schema}, {_RANKS}")
    return rows.mapInArrow(run, schema)


_RANKS = "part int, local long"


def _with_ranks(batches: Iterator[pa.RecordBatch], by: str) -> Iterator[pa.RecordBatch]:
    """A task's batches with the columns of ranked()."""
    seen = np.zeros(1, np.int64)
    part = TaskContext.get().partitionId()
    for batch in batches:
        value = batch.column(batch.schema.get_field_index(by)).to_numpy()
        if not len(value):
            continue
        if value.max() >= len(seen):
            seen = np.append(seen, np.zeros(value.max() + 1 - len(seen), np.int64))
        order = np.argsort(value, kind="stable")
        s = value[order]
        first = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
        n = np.diff(np.append(first, len(s)))
        local = np.empty(len(s), np.int64)
        local[order] = np.arange(len(s)) - np.repeat(first, n) + np.repeat(seen[s[first]], n)
        seen[s[first]] += n
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(s), part, np.int32)), pa.array(local)], [*batch.schema.names, "part", "local"])


def ranked(rows: DataFrame, by: str = "length") -> DataFrame:
    """rows with part and local: the rank of a row among those of its task with its length. To be written before use."""
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(lambda batches: _with_ranks(batches, by), f"{fields}, {_RANKS}")


def pack(pieces: DataFrame, limits: Limits = Limits(), weights: tuple[float, float, float] = (1.0, 1.0, 1.0), rule: str = "norm") -> DataFrame:
    """pieces with sequence_id and offset: where each piece stands. pieces has a column length, 1 to limits.tokens.

    Every piece is placed once; a sequence's pieces are gapless from offset 0 and keep every limit. An empty table
    stays empty.
    """
    return _placed(ranked(pieces), limits, weights, rule)


def _placed(pieces: DataFrame, limits: Limits, weights: tuple[float, float, float] = (1.0, 1.0, 1.0), rule: str = "norm") -> DataFrame:
    """pack() of ranked() pieces."""
    rows = materialise(pieces, "pieces")
    columns = rows.columns[:-2]
    counts = rows.groupBy("part", "length").count()
    before = F.coalesce(F.sum("count").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = materialise(counts.select("part", "length", "count", before.alias("before")), "lengths")
    # One row for each length, max_tokens at most.
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    placer = _placer(plan(histogram, limits, weights, rule))
    spark = pieces.sparkSession
    table = spark.sparkContext.broadcast(placer)  # intervals: grows with the distinct lengths, at most max_tokens, not with the rows

    @F.arrow_udf("sequence_id long, offset long")
    def where(length: pa.Array, rank: pa.Array) -> pa.Array:
        return pa.StructArray.from_arrays([pa.array(c) for c in _place(table.value, length.to_numpy(), rank.to_numpy())], ["sequence_id", "offset"])

    joined = rows.join(counts.drop("count").withColumnRenamed("length", "l"), (F.col("l") == rows["length"]) & (counts["part"] == rows["part"]))
    joined = joined.select(*(rows[c] for c in columns), where(rows["length"], F.col("local") + F.col("before")).alias("w"))
    return joined.select(*columns, "w.sequence_id", "w.offset")


def _placer(places: list[tuple[int, int, int, int, int]]) -> dict[str, np.ndarray]:
    """The rows of plan() as columns, by length and rank."""
    rows = np.array(places, np.int64).reshape(-1, 5)
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    return {"rank": rows[:, 1], "bin": rows[:, 3], "at": rows[:, 4], "key": (rows[:, 0] << 46) + rows[:, 1]}


def _place(p: dict[str, np.ndarray], length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    i = np.searchsorted(p["key"], (length.astype(np.int64) << 46) + rank, side="right") - 1
    return p["bin"][i] + rank - p["rank"][i], p["at"][i]


def pack_documents(docs: DataFrame, path: str, limits: Limits = Limits(), end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", ids: bool = False) -> DataFrame:
    """Tokenises and packs docs: (doc_id, piece, start, length, ids_crc32 [, ids], sequence_id, offset)."""
    return _placed(tokenise(docs, path, end_id, limits.tokens, id_col, text_col, ids, rank=True), limits)
