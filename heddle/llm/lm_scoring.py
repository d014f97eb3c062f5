"""Language-model scores: prediction by partial matching over bytes, with a smoothed unigram word model beside it.

The trie of byte contexts is the set of counted (order + 1)-grams of all training texts; lower orders are their marginals. No
task holds the whole model, and nothing is left out of it. Texts are dealt to blocks. A block's distinct grams travel as packed, sorted arrays, cut
into hash ranges; each range adds up the counts of all blocks. Grams whose contexts end in the same two bytes come
together in one part, which has all that their scores need beside the 65,536 byte pairs' counts; the scores go back to
the ranges and from there to the blocks, whose texts add them up. Words take the same way by their hashes. At each byte the model
starts at its longest known context; a byte that the context has not seen escapes to the next shorter one (escape method C), where the
symbols already ruled out are excluded from the counts. With Trie the same model runs symbol by symbol, pretrained or adaptive.

Texts are scored with A-Z in lower case and one end symbol, so the probabilities of all texts sum to one.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.llm.common import materialise, small_batches, tidy
from heddle.llm.words import hashed_words, trim

ORDER = 5
#: Bytes of text in a block, whose distinct grams are counted and scored together.
BLOCK_BYTES = 32 << 20
START, END = 0xFF, 0xFE  # bytes that UTF-8 never has
SYMBOLS = 255  # all bytes but START
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
U = np.uint64
_FLUSH = 2_000_000


class Trie:
    """The model symbol by symbol: counts[context][symbol]."""

    def __init__(self, order: int = ORDER) -> None:
        self.order, self.counts = order, {}

    def learn(self, context: bytes, symbol: int) -> None:
        for k in range(self.order + 1):
            node = self.counts.setdefault(context[len(context) - k :], {})
            node[symbol] = node.get(symbol, 0) + 1

    def log10(self, context: bytes, symbol: int) -> float:
        out, excluded = 0.0, set()
        for k in range(self.order, -1, -1):
            node = self.counts.get(context[len(context) - k :])
            if not node:
                continue
            left = {s: n for s, n in node.items() if s not in excluded}
            total, kinds = sum(left.values()), len(left)
            if symbol in left:
                return out + math.log10(left[symbol] / (total + kinds))
            if left:
                out += math.log10(kinds / (total + kinds))
            excluded |= set(node)
        return out - math.log10(SYMBOLS - len(excluded))

    def code(self, text: bytes, adaptive: bool) -> float:
        """The text's log10 probability; adaptive: each symbol is learnt once it is coded."""
        out, data = 0.0, bytes([START]) * self.order + text.translate(LOWER)
        for i, s in enumerate([*data[self.order :], END]):
            context = data[i : i + self.order]
            out += self.log10(context, s)
            if adaptive:
                self.learn(context, s)
        return out


def gram_keys(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Each symbol with its context as one integer, and where each text's symbols begin."""
    assert order <= 7
    pad = bytes([START]) * order
    data = np.frombuffer(b"".join([pad + t.translate(LOWER) + bytes([END]) for t in texts]) if texts else b"", np.uint8)
    n = np.array([len(t) + 1 for t in texts], np.int64)
    keys = np.zeros(max(0, len(data) - order), U)
    for i in range(order + 1):
        keys = (keys << U(8)) | data[i : i + len(keys)]
    begins = np.cumsum(n + order) - (n + order)
    which = np.ones(len(keys), bool)  # keys that would reach over into the next text's padding
    for b in begins[1:].tolist():
        which[b - order : b] = False
    return keys[which], np.cumsum(n) - n


class _Table:
    """Sorted integers, found by their positions."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys = keys

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Positions, -1 where a key is absent; fastest for sorted keys."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at, -1)


class Ppm:
    """A pretrained model that fits in memory, in arrays. levels: for each m from order + 1 down to 1 the m-grams' (keys, counts), sorted."""

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray]]) -> None:
        self.levels = []
        for i, (keys, counts) in enumerate(levels):
            m = len(levels) - i
            contexts = keys >> U(8)
            first = np.flatnonzero(np.append(True, contexts[1:] != contexts[:-1])) if len(keys) else np.empty(0, np.int64)
            kinds = np.diff(np.append(first, len(keys)))
            total = np.add.reduceat(counts, first) if len(first) else np.empty(0, np.int64)
            mass = np.zeros(len(first), np.int64)
            if m > 1 and len(first):  # what the context's symbols weigh one order below
                lower, lower_counts = levels[i + 1]
                mass = np.add.reduceat(lower_counts[np.searchsorted(lower, keys & U((1 << 8 * (m - 1)) - 1))], first)
            self.levels.append((m, _Table(keys), np.log10(counts.astype(float)), _Table(contexts[first]), total, kinds, mass))

    def log10(self, keys: np.ndarray) -> np.ndarray:
        """log10 probability of each symbol in its context."""
        out = np.zeros(len(keys))
        left = np.arange(len(keys))
        mass, kinds = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        for m, grams, logs, contexts, total_of, kinds_of, mass_of in self.levels:
            k = keys[left] & U((1 << 8 * m) - 1)
            c = contexts.find(k >> U(8))
            known = c >= 0
            total, kind = np.where(known, total_of[c] if len(total_of) else 0, 0) - mass, np.where(known, kinds_of[c] if len(kinds_of) else 0, 0) - kinds
            g = grams.find(k)
            hit = g >= 0
            with np.errstate(divide="ignore"):
                below = np.log10(np.maximum(total + kind, 1))
                out[left[hit]] += logs[g[hit]] - below[hit]
                escapes = ~hit & known & (kind > 0)
                out[left[escapes]] += np.log10(kind[escapes]) - below[escapes]
            rest = ~hit
            mass = np.where(known, mass_of[c] if len(mass_of) else 0, 0)[rest]
            kinds = np.where(known, kinds_of[c] if len(kinds_of) else 0, 0)[rest]
            left = left[rest]
            if not len(left):
                return out
        out[left] -= np.log10(SYMBOLS - kinds)
        return out

    def texts(self, texts: list[bytes], order: int, block: int = 1 << 19) -> np.ndarray:
        keys, begins = gram_keys(texts, order)
        logs = np.concatenate([self.log10(keys[i : i + block]) for i in range(0, len(keys), block)]) if len(keys) else np.empty(0)
        return np.add.reduceat(logs, begins) if len(begins) else np.empty(0)


def blocks(texts: Iterable[bytes], size: int = 1 << 20) -> Iterator[list[bytes]]:
    part, n = [], 0
    for t in texts:
        part.append(t)
        n += len(t)
        if n >= size or len(part) == 1 << 15:
            yield part
            part, n = [], 0
    if part:
        yield part


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)
    return keys[first], (np.add.reduceat(counts, first) if len(first) else counts)


def _merged(keys: np.ndarray, counts: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """As _summed(), by one sort of keys of so many bits with their counts in the bits below."""
    if bits > 48:
        return _summed([(keys, counts)])
    most = (1 << 64 - bits) - 1
    if len(counts) and counts.max() > most:  # a count that doesn't fit is cut into several
        times = np.maximum(1, -(-counts // most))
        keys, left = np.repeat(keys, times), np.repeat(counts, times)
        nth = np.arange(len(keys)) - np.repeat(np.cumsum(times) - times, times)
        counts = np.minimum(left - nth * most, most)
    both = np.sort(keys << U(64 - bits) | counts.astype(U))
    keys = both >> U(64 - bits)
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat((both & U(most)).astype(np.int64), first) if len(first) else np.empty(0, np.int64)


#: Odd multipliers for mixing, and shifts of half the bits: a bijection of grams that spreads them evenly.
_M1, _M2 = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def _mixed(keys: np.ndarray, bits: int, back: bool = False) -> np.ndarray:
    mask = U((1 << bits) - 1)
    first, second = (_M1, _M2) if not back else (pow(_M2, -1, 1 << 64), pow(_M1, -1, 1 << 64))
    x = keys * U(first) & mask
    x ^= x >> U(bits // 2)
    return x * U(second) & mask


_CODEC = pa.Codec("zstd", compression_level=1)


def _pack(values: np.ndarray) -> bytes:
    """Numbers of 8 bytes, compressed byte plane by byte plane."""
    return _CODEC.compress(np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8).T.tobytes(), asbytes=True)


def _unpack(data: bytes, n: int, kind: type) -> np.ndarray:
    if not n:
        return np.empty(0, kind)
    return np.ascontiguousarray(np.frombuffer(_CODEC.decompress(data, n * 8, asbytes=True), np.uint8).reshape(8, n).T).view(kind).ravel()


def _pack_sorted(keys: np.ndarray) -> bytes:
    return _pack(np.diff(keys, prepend=U(0)))


def _unpack_sorted(data: bytes, n: int) -> np.ndarray:
    return np.cumsum(_unpack(data, n, U), dtype=U)


def _cuts(keys: np.ndarray, bits: int, ranges: int) -> list[int]:
    """Where the ranges of sorted keys of so many bits begin, and where the last ends."""
    edges = np.arange(1, ranges, dtype=U) << U(bits - (ranges.bit_length() - 1))
    return [0, *np.searchsorted(keys, edges).tolist(), len(keys)]


def _low(texts: Iterable) -> Iterator[bytes]:
    return (v.as_py().translate(LOWER) for v in texts)


def block_counts(rows: DataFrame, order: int, ranges: int) -> DataFrame:
    """(range, block, ng, grams, gram_counts, nw, words, word_counts): the distinct mixed grams and word hashes of each block of
    rows(block, held_out, text) in each range, sorted, and how often its training texts have them."""
    bits = 8 * (order + 1)

    def run(t: pa.Table) -> pa.Table:
        keys, counts, pending, waiting = np.empty(0, U), np.empty(0, np.int64), [], 0
        words: list[tuple[np.ndarray, np.ndarray]] = []
        for held in (False, True):
            which = pa.array(t.column("held_out").to_numpy(zero_copy_only=False) == held)
            for part in blocks(_low(t.column("text").filter(which))):
                own = np.sort(_mixed(gram_keys(part, order)[0], bits))
                first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
                pending.append((own[first], np.diff(np.append(first, len(own))) * (not held)))
                waiting += len(first)
                if waiting > _FLUSH:
                    keys, counts = _merged(np.concatenate([keys, *(p[0] for p in pending)]), np.concatenate([counts, *(p[1] for p in pending)]), bits)
                    pending, waiting = [], 0
                h, n = np.unique(hashed_words(part)[0], return_counts=True)
                words.append((h, n * (not held)))
        keys, counts = _merged(np.concatenate([keys, *(p[0] for p in pending)]), np.concatenate([counts, *(p[1] for p in pending)]), bits)
        trim()
        w, wn = _summed([(np.empty(0, U), np.empty(0, np.int64)), *words])
        g, x = _cuts(keys, bits, ranges), _cuts(w, 64, ranges)
        cut = lambda f, c, at: pa.array([f(c[i:j]) for i, j in zip(at, at[1:])], pa.binary())
        return pa.table({
            "range": pa.array(range(ranges), pa.int32()), "block": pa.array([t.column("block")[0].as_py()] * ranges, pa.int64()),
            "ng": pa.array(np.diff(g)), "grams": cut(_pack_sorted, keys, g), "gram_counts": cut(_pack, counts, g),
            "nw": pa.array(np.diff(x)), "words": cut(_pack_sorted, w, x), "word_counts": cut(_pack, wn, x),
        })

    return rows.select("block", "held_out", "text").groupBy("block").applyInArrow(run, "range int, block long, ng long, grams binary, gram_counts binary, nw long, words binary, word_counts binary")


def _all_grams(t: pa.Table, bits: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """A range's grams in each row of block_counts(), all of them, sorted, and their counts."""
    each = [_unpack_sorted(d.as_py(), n.as_py()) for d, n in zip(t.column("grams"), t.column("ng"), strict=True)]
    counts = [_unpack(d.as_py(), len(k), np.int64) for d, k in zip(t.column("gram_counts"), each, strict=True)]
    keys, n = _merged(np.concatenate([np.empty(0, U), *each]), np.concatenate([np.empty(0, np.int64), *counts]), bits)
    return each, keys, n


def _parts_of(grams: np.ndarray, parts: int) -> np.ndarray:
    """The part of each gram, by the last two bytes of its context."""
    return ((((grams >> U(8)) & U(0xFFFF)) * U(_M1)) >> U(65 - parts.bit_length())).astype(np.int64)


PAIRS, WORDS = -1, -2  # rows of range_counts() that aren't a part's


def range_counts(counted: DataFrame, order: int, parts: int) -> DataFrame:
    """(part, range, n, grams, counts): of each range the grams of each part, with their counts over all training texts; besides, with part PAIRS
    the last two bytes' counts, and with WORDS, in n and counts, how many different words there are and how often in all."""
    bits = 8 * (order + 1)

    def run(t: pa.Table) -> pa.Table:
        _, keys, n = _all_grams(t, bits)
        grams = _mixed(keys, bits, back=True)
        part = _parts_of(grams, parts)
        rows = []
        by = np.argsort(part, kind="stable")
        at = np.searchsorted(part[by], np.arange(parts + 1))
        for p in range(parts):
            own = by[at[p] : at[p + 1]]
            if len(own):
                rows.append((p, len(own), _pack_sorted(keys[own]), _pack(n[own])))
        pairs = np.bincount((grams & U(0xFFFF)).astype(np.int64), weights=n, minlength=1 << 16).astype(np.int64)
        rows.append((PAIRS, 1 << 16, b"", _pack(pairs)))
        each = [(_unpack_sorted(d.as_py(), m.as_py()), _unpack(c.as_py(), m.as_py(), np.int64)) for d, c, m in zip(t.column("words"), t.column("word_counts"), t.column("nw"), strict=True)]
        _, times = _summed([(np.empty(0, U), np.empty(0, np.int64)), *each])
        rows.append((WORDS, int((times > 0).sum()), b"", _pack(np.array([times.sum()]))))
        p, m, k, c = zip(*rows, strict=True)
        return pa.table({"part": pa.array(p, pa.int32()), "range": pa.array([t.column("range")[0].as_py()] * len(p), pa.int32()), "n": pa.array(m, pa.int64()), "grams": pa.array(k, pa.binary()), "counts": pa.array(c, pa.binary())})

    return counted.groupBy("range").applyInArrow(run, "part int, range int, n long, grams binary, counts binary")


def _pair_counts(ranged: DataFrame) -> np.ndarray:
    """The counts of the last two bytes over all ranges: added up in 16 tasks, whose 65,536 numbers each come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            for c in batch.column(0):
                total += _unpack(c.as_py(), 1 << 16, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([_pack(total)], pa.binary())], ["counts"])

    sums = ranged.where(F.col("part") == PAIRS).select("counts").coalesce(16).mapInArrow(run, "counts binary").collect()
    return sum((_unpack(bytes(r.counts), 1 << 16, np.int64) for r in sums), np.zeros(1 << 16, np.int64))


def part_scores(ranged: DataFrame, pairs: np.ndarray, order: int) -> DataFrame:
    """(range, part, logs): the log10 probability of each gram of a part's ranges, in the order of range_counts()."""
    bits = 8 * (order + 1)
    shared = ranged.sparkSession.sparkContext.broadcast(pairs)  # 65,536 numbers

    def run(t: pa.Table) -> pa.Table:
        sizes = t.column("n").to_numpy()
        grams = _mixed(np.concatenate([_unpack_sorted(k.as_py(), n) for k, n in zip(t.column("grams"), sizes, strict=True)]), bits, back=True)
        counts = np.concatenate([_unpack(c.as_py(), n, np.int64) for c, n in zip(t.column("counts"), sizes, strict=True)])
        by = np.argsort(grams)
        grams, counts = grams[by], counts[by]
        known = counts > 0
        levels = [(grams[known], counts[known])]
        for m in range(order, 0, -1):
            if m > 2:
                levels.append(_merged(levels[-1][0] & U((1 << 8 * m) - 1), levels[-1][1], 8 * m))
            else:  # contexts that are shorter than a part's are shared by parts
                n = shared.value if m == 2 else shared.value.reshape(256, 256).sum(axis=0)
                levels.append((np.flatnonzero(n).astype(U), n[n > 0]))
        model = Ppm(levels)
        logs = np.empty(len(grams))
        for i in range(0, len(grams), 1 << 19):
            logs[by[i : i + (1 << 19)]] = model.log10(grams[i : i + (1 << 19)])
        ends = np.cumsum(sizes)
        return pa.table({"range": t.column("range"), "part": t.column("part"), "logs": pa.array([_pack(logs[e - n : e]) for e, n in zip(ends, sizes, strict=True)], pa.binary())})

    return ranged.where("part >= 0").groupBy("part").applyInArrow(run, "range int, part int, logs binary")


def block_logs(counted: DataFrame, scored: DataFrame, order: int, parts: int) -> DataFrame:
    """(block, range, ng, grams, logs, nw, words, times): the scores of each block's grams, and its words' counts over all training texts."""
    bits = 8 * (order + 1)

    def run(t: pa.Table, scores: pa.Table) -> pa.Table:
        each, keys, _ = _all_grams(t, bits)
        part = _parts_of(_mixed(keys, bits, back=True), parts)
        by = np.argsort(part, kind="stable")
        at = np.searchsorted(part[by], np.arange(parts + 1))
        logs = np.empty(len(keys))
        for p, packed in zip(scores.column("part").to_pylist(), scores.column("logs"), strict=True):
            own = by[at[p] : at[p + 1]]
            logs[own] = _unpack(packed.as_py(), len(own), np.float64)
        words = [_unpack_sorted(d.as_py(), m.as_py()) for d, m in zip(t.column("words"), t.column("nw"), strict=True)]
        times = [_unpack(c.as_py(), len(w), np.int64) for c, w in zip(t.column("word_counts"), words, strict=True)]
        all_words, all_times = _summed([(np.empty(0, U), np.empty(0, np.int64)), *zip(words, times, strict=True)])
        return pa.table({
            "block": t.column("block"), "range": t.column("range"), "ng": t.column("ng"), "grams": t.column("grams"),
            "logs": pa.array([_pack(logs[np.searchsorted(keys, k)]) for k in each], pa.binary()), "nw": t.column("nw"), "words": t.column("words"),
            "times": pa.array([_pack(all_times[np.searchsorted(all_words, w)]) for w in words], pa.binary()),
        })

    schema = "block long, range int, ng long, grams binary, logs binary, nw long, words binary, times binary"
    return counted.groupBy("range").cogroup(scored.groupBy("range")).applyInArrow(run, schema)


def text_scores(rows: DataFrame, logged: DataFrame, order: int, below: float, ends: int) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, base_score, score) of rows(block, doc_id, held_out, text)."""
    bits = 8 * (order + 1)

    def run(t: pa.Table, scores: pa.Table) -> pa.Table:
        scores = scores.sort_by("range")
        joined = lambda name, size, f: np.concatenate([f(d.as_py(), n.as_py()) for d, n in zip(scores.column(name), scores.column(size), strict=True)])
        keys, logs = joined("grams", "ng", _unpack_sorted), joined("logs", "ng", lambda d, n: _unpack(d, n, np.float64))
        words, times = joined("words", "nw", _unpack_sorted), joined("times", "nw", lambda d, n: _unpack(d, n, np.int64))
        word_logs = np.log10(times + 0.5)
        found = []
        for part in blocks(_low(t.column("text"))):
            own, begins = gram_keys(part, order)
            number = np.repeat(np.arange(len(part)), np.diff(np.append(begins, len(own))))
            own = _mixed(own, bits)
            if bits <= 48:  # blocks() gives fewer texts than the other 16 bits hold
                both = np.sort(own << U(16) | number.astype(U))
                own, number = both >> U(16), (both & U(0xFFFF)).astype(np.int64)
            else:
                by = np.argsort(own, kind="stable")
                own, number = own[by], number[by]
            first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            each = np.repeat(logs[np.searchsorted(keys, own[first])], np.diff(np.append(first, len(own))))
            score = np.bincount(number, weights=each, minlength=len(part))
            h, line, text_of, _ = hashed_words(part)
            of = text_of[line]
            at = np.searchsorted(words, h)
            n = np.bincount(of, minlength=len(part))
            known = np.bincount(of, weights=times[at] > 0, minlength=len(part)).astype(np.int64) if len(h) else np.zeros(len(part), np.int64)
            base = np.bincount(of, weights=word_logs[at], minlength=len(part)) if len(h) else np.zeros(len(part))
            found.append((n + 1, known + (ends > 0), base + math.log10(ends + 0.5) - (n + 1) * below, score))
        a, b, c, d = (np.concatenate(x) for x in zip(*found, strict=True))
        del keys, logs, words, times, word_logs
        trim()
        return pa.table({"doc_id": t.column("doc_id"), "held_out": t.column("held_out"), "n_tokens": pa.array(a.astype(np.int64)), "n_known": pa.array(b.astype(np.int64)), "base_score": pa.array(c), "score": pa.array(d)})

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    return rows.groupBy("block").cogroup(logged.groupBy("block")).applyInArrow(run, schema)


def fold(doc_id: Column, k: int) -> Column:
    """crc32 of the id as text, modulo k; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % k


@tidy
def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, folds: int = 5, held_fold: int = 1, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each document: (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score).

    Both models learn from all rows outside the held-out fold. base_score is the add-half unigram log10 probability of
    the words and one end; score the byte model's of the whole text. Words are told apart by 64-bit hashes. Null texts are empty; repeated
    rows count as often as they occur; an empty training fold leaves uniform models; an empty table gives no rows.
    """
    assert 1 <= order <= 6
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (fold(F.col(id_col), folds) == held_fold).alias("held_out"), text.alias("text"))
    total = rows.agg(F.sum(F.octet_length("text") + 1).alias("bytes"), F.count(F.when(~F.col("held_out"), 1)).alias("ends")).first()
    count, ends = max(1, -(-(total.bytes or 0) // block_bytes)), total.ends
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(count)))
    ranges = 1 << max(6, (int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length())
    counted = materialise(block_counts(rows, order, ranges), "block-counts", free=True)
    ranged = materialise(range_counts(counted, order, ranges), "range-counts", free=True)
    sums = ranged.where(F.col("part") == WORDS).select("n", "counts").collect()  # a row for each range
    n, v = sum(int(_unpack(bytes(r.counts), 1, np.int64)[0]) for r in sums) + ends, sum(r.n for r in sums) + (ends > 0)
    scored = part_scores(ranged, _pair_counts(ranged), order)
    out = text_scores(rows, block_logs(counted, scored, order, ranges), order, math.log10(n + 0.5 * (v + 1)), ends)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
