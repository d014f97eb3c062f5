"""Line deduplication: an exact set-similarity join of the corpus's lines.

A line is the set of its lower-cased words. Tokens are ordered by rarity over all documents; a line posts the tokens of
its prefix, and two lines whose Jaccard similarity reaches the threshold share a posted token. Postings that meet are
filtered by length, by position, and by a 128-bit parity sketch whose distance never exceeds the sets' difference; what
passes is verified on the whole sets. A line goes when an earlier line is at least as similar as the threshold.

Equal sets are one node of the join, however often they occur. Postings travel as packed columns, one row for each hash
range of tokens, and meet there in numpy. Where a posted token occurs often, its lines are joined by Spark instead: they are first
compared with the token's earliest ones; only lines without a match go on to all others, so that a thousand variants of
one line don't become all their pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heddle.llm.common import discard, fitted_join, materialise, tidy
from heddle.llm.lm_scoring import _summed
from heddle.llm.words import hashed_words, parts, sets_of, trim

THRESHOLD = Fraction(4, 5)
#: Most frequent tokens, whose order is their count; all others are rarer than these and ordered by their hash.
RANKED = 100_000
#: Occurrences of a posted token, from which on its earliest lines are tried first; and how many of those.
MANY, EARLIEST = 1000, 32
#: Tokens or postings that a task gathers before it sends them on, as one row for each hash range.
FLUSH = 200_000
#: Leading bits of a hash by which it is looked up among the ranked tokens.
LEADING = 18
U = np.uint64


def _mix(h: np.ndarray, k: int) -> np.ndarray:
    x = (h ^ U(0x9E3779B97F4A7C15 * k & 0xFFFFFFFFFFFFFFFF)) * U(0xBF58476D1CE4E5B9)
    return (x ^ (x >> U(31))) * U(0x94D049BB133111EB)


def _reduce(how: np.ufunc, values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """how over each set's values; 0 for empty sets."""
    out = np.zeros(len(sizes), values.dtype)
    full = np.flatnonzero(sizes)
    if len(full):
        out[full] = how.reduceat(values, (np.cumsum(sizes) - sizes)[full])
    return out


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(text).alias("mark"), text.alias("text"))


def _ranges(docs: DataFrame) -> int:
    """Hash ranges that tokens are dealt to: a power of two that grows with the shuffle partitions."""
    return 1 << max(6, (int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length())


def _range_of(h: np.ndarray, ranges: int) -> np.ndarray:
    return (_mix(h, 11) >> U(65 - ranges.bit_length())).astype(np.int64)


def _packed(by: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, list[bytes]]]:
    """(number, the columns' bytes) for each number in by."""
    order = np.argsort(by, kind="stable")
    by = by[order]
    first = np.flatnonzero(np.append(True, by[1:] != by[:-1])) if len(by) else []
    columns = [c[order] for c in columns]
    for i, j in zip(first, [*first[1:], len(by)], strict=True):
        yield int(by[i]), [c[i:j].tobytes() for c in columns]


def _scan(keyed: DataFrame, ranges: int) -> DataFrame:
    """Rows of two kinds: (0, doc, mark, no, set key) for each line with words, (1, ..., no the range, tokens, counts) for token counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["kind", "doc", "mark", "no", "a", "b", "tokens", "counts"]
        keys, counts, pending, waiting = np.empty(0, U), np.empty(0, np.int64), [], 0

        def counted() -> pa.RecordBatch:
            packed = list(_packed(_range_of(keys, ranges), keys, counts.astype(np.int32)))
            none = pa.array(np.zeros(len(packed), np.int64))
            return pa.RecordBatch.from_arrays([pa.array(np.ones(len(packed), np.int32)), none, none, pa.array([r for r, _ in packed], pa.int32()), none, none, pa.array([x[0] for _, x in packed], pa.binary()), pa.array([x[1] for _, x in packed], pa.binary())], names)

        for batch in batches:
            for part in parts(batch, 2):
                h, line, row, no = hashed_words(_lower(part.column(2).to_pylist()))
                h, sizes = sets_of(h, line, len(row))
                full = np.flatnonzero(sizes)
                first, second = _reduce(np.add, _mix(h, 1), sizes)[full], _reduce(np.bitwise_xor, _mix(h, 2), sizes)[full]
                taken, none = pa.array(row[full]), pa.nulls(len(full), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(full), np.int32)), part.column(0).take(taken), part.column(1).take(taken), pa.array(no[full].astype(np.int32)), pa.array(first.view(np.int64)), pa.array(second.view(np.int64)), none, none], names)
                pending.append(np.unique(h, return_counts=True))
                waiting += len(pending[-1][0])
                if waiting > FLUSH:
                    keys, counts = _summed([(keys, counts), *pending])
                    pending, waiting = [], 0
                    if len(keys) > FLUSH:
                        yield counted()
                        keys, counts = np.empty(0, U), np.empty(0, np.int64)
        keys, counts = _summed([(keys, counts), *pending])
        if len(keys):
            yield counted()

    return keyed.mapInArrow(run, "kind int, doc long, mark long, no int, a long, b long, tokens binary, counts binary")


def _frequent(found: DataFrame, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent tokens of each hash range, RANKED numbers at most in all, and their counts over all texts, most frequent first."""
    share = -(-RANKED // ranges)

    def run(t: pa.Table) -> pa.Table:
        keys, counts = _summed([(np.frombuffer(k.as_py(), U), np.frombuffer(c.as_py(), np.int32).astype(np.int64)) for k, c in zip(t.column("tokens"), t.column("counts"), strict=True)])
        top = np.lexsort((keys, -counts))[:share]
        return pa.table({"token": keys[top].view(np.int64), "n": counts[top]})

    got = found.where("kind = 1").select("no", "tokens", "counts").groupBy("no").applyInArrow(run, "token long, n long").toArrow()  # RANKED rows
    tokens, n = got.column("token").to_numpy().view(U), got.column("n").to_numpy()
    order = np.lexsort((tokens, -n))
    return tokens[order], n[order]


def _lower(texts: list[str]) -> list[bytes]:
    return [t.lower().encode("utf-8", "replace") for t in texts]


def _chosen_sets(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sets of the lines that a row's list asks for, their sizes and the lines' ids; columns text, nos, ids."""
    h, line, text_of, _ = hashed_words(_lower(batch.column("text").to_pylist()))
    nos, ids = batch.column("nos"), batch.column("ids").flatten().to_numpy()
    per_text = np.bincount(text_of, minlength=batch.num_rows)
    asked = np.repeat(np.cumsum(per_text) - per_text, np.diff(nos.offsets.to_numpy())) + nos.flatten().to_numpy()
    place = np.full(len(text_of), -1)
    place[asked] = np.arange(len(asked))
    row = place[line]
    h, sizes = sets_of(h[row >= 0], row[row >= 0], len(asked))
    return h, sizes, ids


def _postings(keyed: DataFrame, asked: DataFrame, frequent: tuple[np.ndarray, np.ndarray], threshold: Fraction, many: int, ranges: int) -> DataFrame:
    """(range, hot, tokens, ids, places, s1, s2): the prefixes of the asked lines, as bytes of columns; a place holds the set's size
    and, in 20 bits, the token's position. Postings of tokens that occur more than many times are hot and go to any range."""
    rows = fitted_join(keyed, asked, ["doc", "mark"], "inner").select("text", "nos", "ids")
    by_hash = np.argsort(frequent[0])
    shared = keyed.sparkSession.sparkContext.broadcast((frequent[0][by_hash], by_hash, frequent[1][by_hash] > many))  # RANKED numbers at most
    num, den = threshold.numerator, threshold.denominator
    least = _least_size(threshold)
    names = ["range", "hot", "tokens", "ids", "places", "s1", "s2"]

    def packed(columns: list[tuple[np.ndarray, ...]], begins: np.ndarray) -> pa.RecordBatch:
        sorted_hashes, _, is_hot = shared.value
        token, *others = (np.concatenate(c) for c in zip(*columns, strict=True))
        i = _found(token, sorted_hashes, begins)
        hot = (sorted_hashes[i] == token) & is_hot[i] if len(sorted_hashes) else np.zeros(len(token), bool)
        to = np.where(hot, ranges + np.arange(len(token)) * 7919 % ranges, _range_of(token, ranges))
        out = list(_packed(to, token, *others))
        return pa.RecordBatch.from_arrays([pa.array([r % ranges for r, _ in out], pa.int32()), pa.array([r >= ranges for r, _ in out], pa.bool_()), *(pa.array([x[k] for _, x in out], pa.binary()) for k in range(5))], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sorted_hashes, rank_of, _ = shared.value
        begins = _begins(sorted_hashes)
        pending, waiting = [], 0
        for batch in batches:
            for part in parts(batch, 0):
                h, sizes, ids = _chosen_sets(part)
                places = _places(h, sorted_hashes, rank_of, begins)
                row = np.repeat(np.arange(len(sizes)), sizes)
                order = np.argsort(row << 50 | places) if len(sizes) < 8192 else np.lexsort((places, row))
                pos = np.arange(len(h)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                prefix = np.where(sizes >= least, sizes - -(-sizes * num // den) + 1, 0)
                in_prefix = pos < prefix[row]  # row is sorted already, so positions fit the new order
                bit = U(1) << (h & U(63))
                s1 = _reduce(np.bitwise_xor, np.where(h & U(64), U(0), bit), sizes)
                s2 = _reduce(np.bitwise_xor, np.where(h & U(64), bit, U(0)), sizes)
                r = row[in_prefix]
                pending.append((h[order][in_prefix], ids[r], sizes[r] << 20 | np.minimum(pos[in_prefix], 0xFFFFF), s1[r], s2[r]))
                waiting += len(r)
                if waiting > FLUSH:
                    yield packed(pending, begins)
                    pending, waiting = [], 0
        if waiting:
            yield packed(pending, begins)

    return rows.mapInArrow(run, "range int, hot boolean, tokens binary, ids binary, places binary, s1 binary, s2 binary")


def _met(postings: DataFrame, threshold: Fraction) -> DataFrame:
    """(token, x, y, s1, s2): the pairs that the postings of each range leave possible, x the later; and, with token not null, their
    hot postings, x the id and y the place."""

    def run(t: pa.Table) -> pa.Table:
        columns = [c.combine_chunks() for c in t.select(["tokens", "ids", "places", "s1", "s2"]).columns]
        hot = t.column("hot").to_numpy(zero_copy_only=False)
        taken = lambda which: [np.frombuffer(b"".join(v.as_py() for v in c.filter(pa.array(which))), kind) for c, kind in zip(columns, (U, np.int64, np.int64, U, U), strict=True)]
        x, y = meet(*taken(~hot), threshold)
        trim()
        token, ids, place, s1, s2 = taken(hot)
        none = np.zeros(len(x), np.int64)
        return pa.table({"token": pa.concat_arrays([pa.nulls(len(x), pa.int64()), pa.array(token.view(np.int64))]), "x": np.append(x, ids), "y": np.append(y, place), "s1": np.append(none, s1.view(np.int64)), "s2": np.append(none, s2.view(np.int64))})

    return postings.groupBy("range").applyInArrow(run, "token long, x long, y long, s1 long, s2 long")


def meet(token: np.ndarray, ids: np.ndarray, place: np.ndarray, s1: np.ndarray, s2: np.ndarray, threshold: Fraction, block: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (later, earlier) ids of postings that share a token and pass the filters."""
    num, den = threshold.numerator, threshold.denominator
    _, token, times = np.unique(token, return_inverse=True, return_counts=True)
    several = times[token] > 1
    token, ids, place, s1, s2 = (c[several] for c in (token, ids, place, s1, s2))
    size = place >> 20
    order = np.lexsort((size, token))
    token, ids, place, s1, s2, size = (c[order] for c in (token, ids, place, s1, s2, size))
    pos = place & 0xFFFFF
    # Partners come later in the order and are of a size that the threshold allows.
    most = np.minimum(size * den // num, (1 << 40) - 1)
    until = np.searchsorted(token << 40 | size, token << 40 | most, side="right")
    number = until - np.arange(len(token)) - 1
    ends = np.cumsum(number)
    xs, ys = [], []
    at = 0
    while at < len(token):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + block, side="right")))
        n = number[at:to]
        i = np.repeat(np.arange(at, to), n)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
        total = size[i] + size[j]
        differ = np.bitwise_count(s1[i] ^ s1[j]).astype(np.int64) + np.bitwise_count(s2[i] ^ s2[j])
        good = np.flatnonzero(differ * (num + den) <= total * (den - num))
        i, j, total = i[good], j[good], total[good]
        overlap = np.minimum(pos[i], pos[j]) + np.minimum(size[i] - pos[i], size[j] - pos[j])
        long = (size[i] >= 1 << 20) | (size[j] >= 1 << 20)  # positions don't fit the bits: no positional filter
        good = (ids[i] != ids[j]) & (long | (overlap * (num + den) >= total * num))
        xs.append(np.maximum(ids[i], ids[j])[good])
        ys.append(np.minimum(ids[i], ids[j])[good])
        at = to
    if not xs:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    x, y = np.concatenate(xs), np.concatenate(ys)
    order = np.lexsort((y, x))
    x, y = x[order], y[order]
    new = np.append(True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])) if len(x) else np.empty(0, bool)
    return x[new], y[new]


def _begins(sorted_hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes are smaller, for each value of the leading bits."""
    n = np.bincount((sorted_hashes >> U(64 - LEADING)).astype(np.int64), minlength=1 << LEADING)
    return (np.cumsum(n) - n).astype(np.int32)


def _found(hashes: np.ndarray, sorted_hashes: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """np.searchsorted(sorted_hashes, hashes), or the last index where that is beyond: a few passes over those with equal leading bits."""
    last = max(0, len(sorted_hashes) - 1)
    i = np.minimum(begins.take((hashes >> U(64 - LEADING)).astype(np.int64)), last)
    behind = np.flatnonzero(sorted_hashes.take(i) < hashes) if len(sorted_hashes) else np.empty(0, np.int64)
    while len(behind := behind[i[behind] < last]):
        i[behind] += 1
        behind = behind[sorted_hashes.take(i[behind]) < hashes[behind]]
    return i


def _places(hashes: np.ndarray, sorted_hashes: np.ndarray, rank_of: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """50-bit sort keys of tokens: first those beyond the ranked ones, by their hash, then the ranked ones, rarest first."""
    rare = (hashes >> U(15)).astype(np.int64)
    if not len(sorted_hashes):
        return rare
    i = _found(hashes, sorted_hashes, begins)
    return np.where(sorted_hashes[i] == hashes, (1 << 50) - 1 - rank_of[i], rare)


def _sets(keyed: DataFrame, asked: DataFrame) -> DataFrame:
    """(id, tokens): the asked lines' sets."""
    rows = fitted_join(keyed, asked, ["doc", "mark"], "inner").select("text", "nos", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, 0):
                h, sizes, ids = _chosen_sets(part)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(h.view(np.int64)))], ["id", "tokens"])

    return rows.mapInArrow(run, "id long, tokens array<long>")


def _filters(threshold: Fraction) -> Column:
    """On postings x and y of one token, y the earlier: what the sets' sizes, the positions and the sketches leave possible."""
    num, den = threshold.numerator, threshold.denominator
    sx, sy = F.shiftright("x.place", 20), F.shiftright("y.place", 20)
    px, py = F.col("x.place").bitwiseAND(0xFFFFF), F.col("y.place").bitwiseAND(0xFFFFF)
    overlap = F.least(px, py) + F.least(sx - px, sy - py)
    long = (sx >= 1 << 20) | (sy >= 1 << 20)  # positions don't fit the bits: no positional filter
    differ = F.bit_count(F.col("x.s1").bitwiseXOR(F.col("y.s1"))) + F.bit_count(F.col("x.s2").bitwiseXOR(F.col("y.s2")))
    return (
        (F.col("y.id") < F.col("x.id"))
        & (differ * (num + den) <= (sx + sy) * (den - num))
        & (F.least(sx, sy) * den >= F.greatest(sx, sy) * num)
        & (long | (overlap * (num + den) >= (sx + sy) * num))
    )


def _pairs(x: DataFrame, y: DataFrame, threshold: Fraction) -> DataFrame:
    met = x.alias("x").join(y.alias("y"), (F.col("x.token") == F.col("y.token")) & _filters(threshold))
    return met.select(F.col("x.id").alias("x"), F.col("y.id").alias("y")).distinct()


def _verified(pairs: DataFrame, sets: DataFrame, keyed: DataFrame, threshold: Fraction) -> DataFrame:
    """The later lines of the pairs that are similar enough."""
    num, den = threshold.numerator, threshold.denominator
    pairs = materialise(pairs, "pairs")
    ids = pairs.select(F.col("x").alias("id")).union(pairs.select("y")).distinct()
    asked = sets.join(ids, "id").groupBy("doc", "mark").agg(F.collect_list("no").alias("nos"), F.collect_list("id").alias("ids"))
    tokens = materialise(_sets(keyed, asked), "sets")
    tx, ty = tokens.toDF("x", "tx"), tokens.toDF("y", "ty")
    common = F.size(F.array_intersect("tx", "ty"))
    union = F.size("tx") + F.size("ty") - common
    return pairs.join(tx, "x").join(ty, "y").where(common * den >= union * num).select(F.col("x").alias("id")).distinct()


@tidy
def removed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: Fraction = THRESHOLD, many: int = MANY, earliest: int = EARLIEST) -> DataFrame:
    """(doc, mark, gone): for each row that loses any, the numbers of its removed lines.

    Lines end at line feeds and are ordered by the document's id (nulls last), its text's hash and their number. A line
    is removed if an earlier one, removed or not, has a Jaccard similarity of at least threshold. Lines without words
    never match. Words end at ASCII white space. Rows that repeat an id and a text are one document. Tokens are told apart by 64-bit hashes.
    """
    keyed = _keyed(docs, id_col, text_col)
    ranges = _ranges(docs)
    found = materialise(_scan(keyed, ranges), "lines")
    frequent = _frequent(found, ranges)
    # The counts take three times the lines' disk and aren't needed from here on; nor are the shuffle files behind frequent.
    lines = materialise(found.where("kind = 0").select("doc", "mark", "no", "a", "b"), "lines", free=True)
    discard(found)

    order = F.struct(F.col("doc").isNull().alias("late"), "doc", "mark", "no")
    sets = lines.groupBy("a", "b").agg(F.min(order).alias("first"), F.count("*").alias("n"))
    sets = sets.select("a", "b", "n", "first.late", "first.doc", "first.mark", "first.no")
    sets = materialise(sets.repartitionByRange("late", "doc", "mark", "no").sortWithinPartitions("late", "doc", "mark", "no").withColumn("id", F.monotonically_increasing_id()), "sets", free=True)

    asked = sets.groupBy("doc", "mark").agg(F.collect_list("no").alias("nos"), F.collect_list("id").alias("ids"))
    postings = _postings(keyed, asked, frequent, threshold, many, ranges)
    met = materialise(_met(postings, threshold), "met", free=True)
    pairs = met.where("token is null").select("x", "y")
    hot = met.where("token is not null").select("token", F.col("x").alias("id"), F.col("y").alias("place"), "s1", "s2")
    some = not hot.isEmpty()
    if some:
        salted = hot.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64)))
        for by in (["token", "salt"], ["token"]):
            salted = salted.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy("id"))).where(F.col("r") <= earliest)
        pairs = pairs.union(materialise(_pairs(hot, salted.select(hot.columns), threshold), "pairs", free=True))
    pairs = pairs.distinct()
    similar = materialise(_verified(pairs, sets, keyed, threshold), "similar", free=True)
    if some:
        alone = hot.join(similar, "id", "left_anti").select(hot.columns)
        similar = materialise(similar.union(_verified(_pairs(alone, hot, threshold), sets, keyed, threshold)).distinct(), "similar")

    # All lines of a set with an earlier similar one go; of the other sets all but the first line.
    judged = sets.join(similar.withColumn("goes", F.lit(True)), "id", "left").where("goes or n > 1").select("a", "b", "goes", F.col("doc").alias("d"), F.col("mark").alias("m"), F.col("no").alias("k"))
    first = F.col("doc").eqNullSafe(F.col("d")) & (F.col("mark") == F.col("m")) & (F.col("no") == F.col("k"))
    gone = lines.join(judged, ["a", "b"]).where(F.coalesce("goes", F.lit(False)) | ~first)
    return gone.groupBy("doc", "mark").agg(F.collect_set("no").alias("gone"))


def _least_size(threshold: Fraction) -> int:
    """Smaller sets are as similar as the threshold to equal sets only."""
    n = 1
    while Fraction(n, n + 1) < threshold and Fraction(n - 1, n) < threshold:
        n += 1
    return n


def _kept(text: str, gone: list[int] | None) -> str:
    if not gone:
        return text
    drop = set(gone)
    return "\n".join(line for i, line in enumerate(text.split("\n")) if i not in drop)


def remove_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: Fraction = THRESHOLD) -> DataFrame:
    """docs without the lines that removed_lines() names, all other columns as they were; rows stay, a null text stays null."""
    gone = removed_lines(docs, id_col, text_col, threshold)
    given = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)), F.col(id_col).cast("long").alias("doc"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("mark"))
    joined = fitted_join(given, gone, ["doc", "mark"], "left")
    text = f"c{docs.columns.index(text_col)}"

    @F.arrow_udf("string")
    def cut(texts: pa.Array, gone: pa.Array) -> pa.Array:
        return pa.array([None if t is None else _kept(t, g) for t, g in zip(texts.to_pylist(), gone.to_pylist(), strict=True)], pa.string())

    joined = joined.withColumn(text, F.when(F.col("gone").isNull(), F.col(text)).otherwise(cut(text, "gone")))
    return joined.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)))


def line_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: Fraction = THRESHOLD) -> DataFrame:
    """(doc_id, n_lines, n_removed, removed, kept_sha256) for each row; removed: the numbers of the lines, in order."""
    joined = fitted_join(_keyed(docs, id_col, text_col), removed_lines(docs, id_col, text_col, threshold), ["doc", "mark"], "left").select("doc", "text", "gone")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, k, which, digest = [], [], [], []
            for text, gone in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                n.append(text.count("\n") + 1)
                k.append(len(gone or ()))
                which.append(sorted(gone or ()))
                digest.append(hashlib.sha256(_kept(text, gone).encode("utf-8", "replace")).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(k, pa.int64()), pa.array(which, pa.list_(pa.int32())), pa.array(digest, pa.string())], ["doc_id", "n_lines", "n_removed", "removed", "kept_sha256"])

    return joined.mapInArrow(run, "doc_id long, n_lines long, n_removed long, removed array<int>, kept_sha256 string")
