"""Near-duplicate documents: SimHash codes in navigable small-world graphs, candidate edges verified and unioned.

A document is the set of its five-word shingles. Each distinct set is a node with a 128-bit SimHash. A node is keyed by
each of several min-hashes: two documents of similarity s share one with probability s. Nodes that share none with any other
node can't be similar to one and go no further. The others are dealt to shards, all nodes of a key to one shard. A shard is a
small-world graph over Hamming distance; every node asks it for its neighbours by a beam search, and nodes whose neighbours overflow the beam ask
again with a beam eight times as wide, beyond their own class; a beam that would visit the whole shard compares it whole. A key of very many nodes is cut into parts, each a
graph of its own, which all the key's nodes ask. Edges are verified on the whole shingle sets, and verified edges are
joined into classes. Recall is audited by comparing the shingle sets of a sample of nodes with those of all nodes; shards
are added if it is low, and the job fails if it stays so.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.llm.common import components, fitted_join, materialise, tidy
from heddle.llm.line_dedup import _lower, _mix, _reduce
from heddle.llm.small_world import SmallWorld
from heddle.llm.words import hashed_words, parts

SHINGLE, THRESHOLD = 5, Fraction(4, 5)
#: Bits in which the codes of documents at the threshold may differ: 4 standard deviations above the mean of 19 of 128.
RADIUS = 36
SHARDINGS, MORE_SHARDINGS = 4, 4
#: Nodes of a shard; keys with more are cut into parts, and each node asks all parts. Parts whose nodes ask in one task.
SHARD_NODES, PARTS_ASKING = 4096, 16
#: Nodes that come to one task.
TASK_NODES = 1 << 14
#: Neighbours that a node reports at once, nearest first, and the least beam that looks for them.
NEIGHBOURS, BEAM = 16, 32
#: Links of a graph's node at most.
ROOM = 32
#: Nodes of a graph from which a query that isn't one of them starts.
ENTRIES = 8
#: Nodes that the audit searches for exactly, and the recall it asks for.
AUDITED, LEAST_RECALL = 256, 0.9
U = np.uint64
_LOG = logging.getLogger(__name__)


def _shingles(texts: list[str], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All texts' distinct shingles, sorted in each text, their numbers, and two hashes of each text's set.

    A text of fewer words than width is one shingle of all its words; one without words has none.
    """
    h, line, text_of, _ = hashed_words(_lower(texts))
    row = text_of[line]
    n = np.bincount(row, minlength=len(texts))
    size = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    first = np.repeat(np.cumsum(n) - n, size) + np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    srow = np.repeat(np.arange(len(texts)), size)
    x = np.zeros(len(first), U)
    for i in range(width):
        inside = first + i < np.cumsum(n)[srow]
        at = np.minimum(first + i, max(0, len(h) - 1))
        x = np.where(inside, _mix((x << U(7) | x >> U(57)) ^ h[at], 8 + i), x)
    order = np.lexsort((x, srow))
    x, srow = x[order], srow[order]
    new = np.append(True, (x[1:] != x[:-1]) | (srow[1:] != srow[:-1])) if len(x) else np.empty(0, bool)
    x, sizes = x[new], np.bincount(srow[new], minlength=len(texts))
    return x, sizes, _reduce(np.add, _mix(x, 6), sizes), _reduce(np.add, _mix(x, 7), sizes)


def _simhash(x: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two halves of each set's 128-bit code: each bit as most of the set's elements have it."""
    out, row = [], np.repeat(np.arange(len(sizes)), sizes)
    for k in (21, 22):
        ones = np.zeros((len(sizes), 64), np.int32)
        for at in range(0, len(x), 1 << 15):
            own = row[at : at + (1 << 15)]
            first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            bits = np.unpackbits(_mix(x[at : at + (1 << 15)], k).view(np.uint8).reshape(-1, 8), axis=1)
            ones[own[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int32)
        out.append(np.packbits(2 * ones > sizes[:, None], axis=1).view(U).ravel())
    return out[0], out[1]


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(text).alias("mark"), text.alias("text"))


def _scan(keyed: DataFrame, shardings: int, width: int) -> DataFrame:
    """(doc, mark, a, b, size, s1, s2, mins): a row's shingle set, its size, code and min-hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, 2):
                x, sizes, a, b = _shingles(part.column(2).to_pylist(), width)
                s1, s2 = _simhash(x, sizes)
                mins = np.stack([_reduce(np.minimum, _mix(x, 40 + r), sizes) for r in range(shardings)], axis=1)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1, dtype=np.int32) * shardings), pa.array(mins.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(c.view(np.int64)) for c in (a, b, sizes.astype(np.int64), s1, s2)), lists], ["doc", "mark", "a", "b", "size", "s1", "s2", "mins"])

    return keyed.mapInArrow(run, "doc long, mark long, a long, b long, size long, s1 long, s2 long, mins array<long>")


def _sharded(nodes: DataFrame, first: int, last: int, shard_nodes: int) -> DataFrame:
    """nodes for each sharding from first to last, with shard, part and block, home (stands in the part's graph) and query
    (asks it). A node stands in one part of the shard of its key, if others have that key, and asks all its parts, block by block."""
    sent = nodes.select("id", "s1", "s2", "size", F.explode(F.sequence(F.lit(first), F.lit(last - 1))).alias("sharding"), "mins")
    sent = sent.select("id", "s1", "s2", "size", F.xxhash64("sharding", F.element_at("mins", F.col("sharding") + 1)).alias("key"))
    shared = sent.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    sent = materialise(sent.join(shared, "key"), "keyed")
    count = max(1, -(-sent.count() // shard_nodes))
    large = F.col("n") > shard_nodes
    sent = sent.withColumn("shard", F.when(large, F.col("key")).otherwise(F.pmod(F.xxhash64("key"), F.lit(count))))
    columns = ["id", "s1", "s2", "size", "shard", "part", "block", "home", "query"]
    whole = sent.where(~large).withColumns({"part": F.lit(0), "block": F.lit(0), "home": F.lit(True), "query": F.lit(True)}).select(columns)
    if sent.where(large).isEmpty():
        return whole
    heavy = sent.where(large).withColumn("parts", F.ceil(F.col("n") / shard_nodes).cast("int"))
    heavy = heavy.withColumn("own", F.pmod(F.xxhash64("id", "shard"), F.col("parts")).cast("int"))
    last_block = F.floor((F.col("parts") - 1) / PARTS_ASKING).cast("int")
    stands = heavy.withColumns({"part": F.col("own"), "block": F.explode(F.sequence(F.lit(0), last_block)), "home": F.lit(True), "query": F.lit(False)})
    asks = heavy.withColumns({"part": F.explode(F.sequence(F.lit(0), F.col("parts") - 1)), "block": F.floor(F.col("own") / PARTS_ASKING).cast("int"), "home": F.lit(False), "query": F.lit(True)})
    return whole.union(stands.select(columns)).union(asks.select(columns))


Found = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def near(codes: np.ndarray, sizes: np.ndarray, asks: np.ndarray, group: np.ndarray, radius: int, threshold: Fraction, most: int) -> Found:
    """(x, y, distance, overflow): for each asking row its most nearest rows of other groups inside the radius.

    Sizes that rule the threshold out are passed over. overflow says that a row has more such neighbours.
    """
    q = np.flatnonzero(asks)
    x, y, d, over = _whole((codes, sizes, group), (codes[q], sizes[q], group[q]), radius, threshold, most)
    return q[x], y, d, over


def _whole(nodes: tuple[np.ndarray, ...], queries: tuple[np.ndarray, ...], radius: int, threshold: Fraction, most: int) -> Found:
    """As near(), for queries besides nodes, both (codes, sizes, group); x counts queries and y nodes."""
    order, q_order = np.argsort(nodes[1], kind="stable"), np.argsort(queries[1], kind="stable")
    codes, sizes, group = (c[order] for c in nodes)
    q_codes, q_sizes, q_group = (c[q_order] for c in queries)
    num, den = threshold.numerator, threshold.denominator
    lo, hi = np.searchsorted(sizes * den, q_sizes * num), np.searchsorted(sizes * num, q_sizes * den, side="right")
    xs, ys, ds, over = [], [], [], []
    for at in range(0, len(q_codes), 256):
        q = np.arange(at, min(at + 256, len(q_codes)))
        a, b = int(lo[q[0]]), int(hi[q[-1]])
        d = np.bitwise_count(q_codes[q, None, 0] ^ codes[None, a:b, 0])
        d += np.bitwise_count(q_codes[q, None, 1] ^ codes[None, a:b, 1])
        i, j = np.nonzero(d <= radius)
        dist, j = d[i, j], j + a
        good = (q_group[q[i]] != group[j]) & (j >= lo[q[i]]) & (j < hi[q[i]])
        i, j, dist = i[good], j[good], dist[good]
        o = np.lexsort((j, dist, i))
        i, j, dist = i[o], j[o], dist[o]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        more = np.bincount(i, minlength=len(q)) > most
        keep = place < most
        i, j, dist = i[keep], j[keep], dist[keep]
        xs.append(q_order[q[i]])
        ys.append(order[j])
        ds.append(dist.astype(np.int32))
        over.append(more[i])
    if not xs:
        e = np.empty(0, np.int64)
        return e, e, e.astype(np.int32), e.astype(bool)
    return tuple(np.concatenate(c) for c in (xs, ys, ds, over))


def beam_near(codes: np.ndarray, sizes: np.ndarray, asks: np.ndarray, group: np.ndarray, radius: int, threshold: Fraction, most: int) -> Found:
    """As near(), by beam searches from each node's own place in a small-world graph."""
    q = np.flatnonzero(asks)
    x, y, d, over = _beams((codes, sizes, group), (codes[q], sizes[q], group[q]), q, radius, threshold, most)
    # A node whose beam is full of its own class reports itself, so that it asks again.
    return q[x], np.where(y >= 0, y, q[x]), d, over


def _beams(nodes: tuple[np.ndarray, ...], queries: tuple[np.ndarray, ...], place: np.ndarray, radius: int, threshold: Fraction, most: int) -> Found:
    """As _whole(), by beam searches from each query's place among the nodes, or, where that is -1, from the graph's first
    nodes. A query whose beam is full of its own class has one row with y -1."""
    (codes, sizes, group), (q_codes, q_sizes, q_group) = nodes, queries
    n, beam = len(codes), max(BEAM, 2 * most)
    if beam * ROOM >= n:  # a beam follows so many links that comparing all nodes costs no more
        return _whole(nodes, queries, radius, threshold, most)
    graph = SmallWorld(codes, room=ROOM)
    num, den = threshold.numerator, threshold.denominator
    found = []
    for start in range(0, len(q_codes), 512):
        q = np.arange(start, min(start + 512, len(q_codes)))
        entries = np.repeat(graph.order[None, :ENTRIES], len(q), axis=0)
        own = place[q] >= 0
        entries[own] = -1
        entries[own, 0] = place[q][own]
        at, dist = graph.search(q_codes[q], beam, entries)
        full = dist[:, -1] <= radius
        y = np.maximum(at, 0)
        good = (at >= 0) & (dist <= radius) & (q_group[q][:, None] != group[y])
        good &= np.minimum(q_sizes[q][:, None], sizes[y]) * den >= np.maximum(q_sizes[q][:, None], sizes[y]) * num
        more = full | (good.sum(axis=1) > most)
        good &= np.cumsum(good, axis=1) <= most
        i, k = np.nonzero(good)
        lone = np.flatnonzero(more & ~good.any(axis=1))
        found.append((np.append(q[i], q[lone]), np.append(y[i, k], np.full(len(lone), -1)), np.append(dist[i, k], np.zeros(len(lone), np.uint8)).astype(np.int32), np.append(more[i], np.ones(len(lone), bool))))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True)) if found else _whole(nodes, queries, radius, threshold, most)


def _part(t: pa.Table, radius: int, threshold: Fraction, most: int) -> pa.Table:
    """(x, y, distance, overflow) of ids: what the rows that ask find among those that are at home in one part."""
    ids, home, asks = t.column("id").to_numpy(), t.column("home").to_numpy(), t.column("asks").to_numpy()
    codes = np.stack([t.column("s1").to_numpy().view(U), t.column("s2").to_numpy().view(U)], axis=1)
    sizes, group = t.column("size").to_numpy(), t.column("group").to_numpy()
    nodes, queries = np.flatnonzero(home), np.flatnonzero(asks)
    # Most nodes may be of one class by now: its own ask the others only, which a graph of the others answers.
    values, counts = np.unique(group[nodes], return_counts=True)
    main = values[counts.argmax()] if len(nodes) and 2 * counts.max() > len(nodes) else None
    inside = np.zeros(len(queries), bool) if main is None else group[queries] == main
    out = []
    for q, v in ((queries[~inside], nodes), (queries[inside], nodes[group[nodes] != main] if main is not None else nodes[:0])):
        if not len(q) or not len(v):
            continue
        order = np.argsort(ids[v])
        v = v[order]
        place = np.minimum(np.searchsorted(ids[v], ids[q]), len(v) - 1)
        place = np.where(ids[v][place] == ids[q], place, -1)
        x, y, d, over = _beams((codes[v], sizes[v], group[v]), (codes[q], sizes[q], group[q]), place, radius, threshold, most)
        out.append((ids[q[x]], np.where(y >= 0, ids[v[np.maximum(y, 0)]], ids[q[x]]), d, over))
    e = np.empty(0, np.int64)
    x, y, d, over = (np.concatenate(c) for c in zip((e, e, e.astype(np.int32), e.astype(bool)), *out, strict=True))
    return pa.table({"x": x, "y": y, "distance": d, "overflow": over})


def _search(shards: DataFrame, radius: int, threshold: Fraction, most: int, tasks: int) -> DataFrame:
    """(x, y, distance, overflow) over all shards, dealt to so many tasks; shards has asks and group besides."""

    def search(t: pa.Table) -> pa.Table:
        return _part(t, radius, threshold, most)

    # Rows that neither stand in a graph nor ask it any more stay behind.
    found = shards.where("home or asks").repartition(tasks, "shard", "part", "block").groupBy("shard", "part", "block").applyInArrow(search, "x long, y long, distance int, overflow boolean")
    return found.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.min("distance").alias("distance"), F.max(F.when(F.col("overflow") & (F.col("x") <= F.col("y")), True)).alias("over_a"), F.max(F.when(F.col("overflow") & (F.col("x") > F.col("y")), True)).alias("over_b"))


def _verified(pairs: DataFrame, nodes: DataFrame, keyed: DataFrame, threshold: Fraction, width: int) -> DataFrame:
    """Those of pairs(a, b) whose whole shingle sets are similar enough."""
    num, den = threshold.numerator, threshold.denominator
    pairs = materialise(pairs.select("a", "b"), "pairs")
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    asked = nodes.join(ids, "id").groupBy("doc", "mark").agg(F.min("id").alias("id"))
    rows = fitted_join(keyed, asked, ["doc", "mark"], "inner").select("id", "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, 1):
                x, sizes, _, _ = _shingles(part.column(1).to_pylist(), width)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(x.view(np.int64)))], ["id", "x"])

    found = materialise(rows.mapInArrow(sets, "id long, x array<long>").dropDuplicates(["id"]), "sets")
    xa, xb = found.toDF("a", "xa"), found.toDF("b", "xb")

    both = pairs.join(xa, "a").join(xb, "b").withColumn("common", F.size(F.array_intersect("xa", "xb")))
    return both.where(F.col("common") * den >= (F.size("xa") + F.size("xb") - F.col("common")) * num).select("a", "b")


def _labels(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """labels(id, group) with the groups joined that edges(a, b) lead across, each named by its smallest id."""
    across = edges.join(labels.toDF("a", "ga"), "a").join(labels.toDF("b", "gb"), "b").where("ga <> gb")
    joined = components(across.select(F.col("ga").alias("a"), F.col("gb").alias("b"))).toDF("group", "root")
    return materialise(labels.join(joined, "group", "left").select("id", F.coalesce("root", "group").alias("group")), "labels")


@tidy
def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: Fraction = THRESHOLD, width: int = SHINGLE, radius: int = RADIUS, shardings: int = SHARDINGS, shard_nodes: int = SHARD_NODES, neighbours: int = NEIGHBOURS, audited: int = AUDITED) -> DataFrame:
    """(doc_id, mark, class_id, class_size, kept, recall) for each row; mark is the hash of its text, recall the audit's figure.

    A class holds the documents that chains of pairs with a shingle similarity of at least threshold join; class_id is
    its smallest doc_id, and that row is kept. Words are lower-cased and end at ASCII white space; documents with equal word
    sequences are copies, those without any word too; a text of fewer words than a shingle equals its copies only. Texts of equal sets are of one class, whatever their words'
    order and number. Null
    texts are empty, a null id sorts last and is never kept beside others; rows that repeat the smallest id are all kept.
    An empty table gives no rows.
    """
    most_shardings = shardings + 2 * MORE_SHARDINGS
    keyed = _keyed(docs, id_col, text_col)
    rows = materialise(_scan(keyed, most_shardings, width), "codes")
    nodes = rows.groupBy("a", "b").agg(F.min(F.struct(F.col("doc").isNull().alias("late"), "doc", "mark")).alias("first"), F.min("size").alias("size"), F.min("s1").alias("s1"), F.min("s2").alias("s2"), F.first("mins").alias("mins"))
    nodes = materialise(nodes.select("a", "b", "first.doc", "first.mark", "size", "s1", "s2", "mins").withColumn("id", F.monotonically_increasing_id()), "nodes")
    several = nodes.where(F.col("size") >= 4)  # smaller sets are as similar to equal sets only, which are one node
    labels = materialise(several.select("id", F.col("id").alias("group")), "labels")
    tried, done, recall = None, 0, 1.0
    while True:
        until = shardings if not done else done + MORE_SHARDINGS
        shards = materialise(_sharded(several, done, until, shard_nodes), "shards")
        labels, tried = _joined(shards, several, keyed, labels, tried, threshold, width, radius, neighbours)
        done = until
        if not audited:
            break
        recall = audit(several, keyed, labels, threshold, width, audited)
        _LOG.info("recall %.4f after %d shardings", recall, done)
        if recall >= LEAST_RECALL:
            break
        if done >= most_shardings:
            raise RuntimeError(f"recall {recall:.4f} after {done} shardings is under {LEAST_RECALL}")
    named = nodes.select("a", "b", "id").join(labels, "id", "left").select("a", "b", F.coalesce("group", "id").alias("group"))
    out = rows.select("doc", "mark", "a", "b").join(named, ["a", "b"])
    classes = materialise(out.groupBy("group").agg(F.min("doc").alias("class_id"), F.count("*").alias("class_size")), "classes")
    out = out.join(classes, "group")
    return out.select(F.col("doc").alias("doc_id"), "mark", "class_id", F.col("class_size").cast("long").alias("class_size"), F.col("doc").eqNullSafe(F.col("class_id")).alias("kept"), F.lit(recall).alias("recall"))


def _joined(shards: DataFrame, nodes: DataFrame, keyed: DataFrame, labels: DataFrame, tried: DataFrame | None, threshold: Fraction, width: int, radius: int, neighbours: int) -> tuple[DataFrame, DataFrame]:
    """Searches the shards and joins the labels that verified edges lead across; with the pairs tried. Nodes whose list overflows search
    again with a beam eight times as wide, beyond their own class only, until no list overflows; a beam of two shards' nodes can't."""
    asking, beam = None, neighbours
    tasks = max(1, -(-shards.count() // TASK_NODES), int(shards.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    while True:
        sent = shards.join(labels, "id")
        sent = sent.withColumn("asks", F.col("query")) if asking is None else sent.join(asking.withColumn("again", F.lit(True)), "id", "left").withColumn("asks", F.col("query") & F.coalesce("again", F.lit(False)))
        if asking is not None:  # shards that nobody asks any more stay behind
            sent = sent.join(materialise(sent.where("asks").select("shard", "part", "block").distinct(), "asked"), ["shard", "part", "block"])
        found = materialise(_search(sent, radius, threshold, beam, tasks), "found")
        new = found.where("a <> b")
        new = new.select("a", "b", "distance") if tried is None else new.join(tried, ["a", "b"], "left_anti").select("a", "b", "distance")
        if asking is None:
            # The nearest neighbour of each node first; of the other edges only those between classes that are still apart.
            both = new.select(F.col("a").alias("n"), "a", "b", "distance").union(new.select("b", "a", "b", "distance"))
            nearest = both.groupBy("n").agg(F.min(F.struct("distance", "a", "b")).alias("e")).select("e.a", "e.b").distinct()
            nearest = materialise(nearest, "nearest")
            labels = _labels(labels, _verified(nearest, nodes, keyed, threshold, width))
            apart = new.join(nearest, ["a", "b"], "left_anti").select("a", "b")
            new = apart.join(labels.toDF("a", "ga"), "a").join(labels.toDF("b", "gb"), "b").where("ga <> gb").select("a", "b")
        labels = _labels(labels, _verified(new, nodes, keyed, threshold, width))
        tried = materialise(found.select("a", "b") if tried is None else tried.union(found.select("a", "b")).distinct(), "tried")
        asking = materialise(found.where("over_a").select(F.col("a").alias("id")).union(found.where("over_b").select("b")).distinct(), "asking")
        if asking.isEmpty():
            return labels, tried
        beam *= 8


def audit(nodes: DataFrame, keyed: DataFrame, labels: DataFrame, threshold: Fraction, width: int, audited: int) -> float:
    """The share of a sampled node's true neighbours that stand in its class, averaged over the sample.

    The neighbours are found by comparing whole shingle sets with all texts, without codes. Nodes with similar numbers of
    neighbours (by powers of two) are averaged first, so that a large class counts as one of several.
    """
    sample = nodes.orderBy(F.xxhash64("id")).limit(audited).select("doc", "mark", "id")
    texts = fitted_join(keyed, sample, ["doc", "mark"], "inner").dropDuplicates(["id"]).select("id", "text").toArrow()  # audited rows
    if not texts.num_rows:
        return 1.0
    x, sizes, _, _ = _shingles(texts.column("text").to_pylist(), width)
    order = np.argsort(x, kind="stable")
    shared = nodes.sparkSession.sparkContext.broadcast((x[order], np.repeat(np.arange(len(sizes)), sizes)[order], sizes, texts.column("id").to_numpy()))
    num, den = threshold.numerator, threshold.denominator

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, owner, sizes, ids = shared.value
        values, first, number = np.unique(x, return_index=True, return_counts=True)
        for batch in batches:
            for part in parts(batch, 0, 1 << 16):
                y, n, a, b = _shingles(part.column(0).to_pylist(), width)
                place = np.minimum(np.searchsorted(values, y), len(values) - 1)
                hit = np.flatnonzero(values[place] == y)
                of, times = place[hit], number[place[hit]]
                owners = owner[np.repeat(first[of] - (np.cumsum(times) - times), times) + np.arange(int(times.sum()))]
                pair, common = np.unique(np.repeat(np.repeat(np.arange(len(n)), n)[hit], times) * len(ids) + owners, return_counts=True)
                i, j = pair // len(ids), pair % len(ids)
                good = common * den >= (n[i] + sizes[j] - common) * num
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (a[i[good]].view(np.int64), b[i[good]].view(np.int64), ids[j[good]])], ["a", "b", "asked"])

    pairs = keyed.select("text").mapInArrow(run, "a long, b long, asked long").distinct()
    true = materialise(pairs.join(nodes.select("a", "b", "id"), ["a", "b"]).where("id <> asked").select("asked", "id"), "true")
    met = true.join(labels.toDF("asked", "ga"), "asked").join(labels.toDF("id", "gb"), "id")
    each = met.groupBy("asked").agg(F.count("*").alias("n"), F.avg((F.col("ga") == F.col("gb")).cast("double")).alias("share"))
    recall = each.groupBy(F.floor(F.log2("n"))).agg(F.avg("share").alias("share")).agg(F.avg("share")).first()[0]
    return 1.0 if recall is None else recall


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: Fraction = THRESHOLD) -> DataFrame:
    """The rows of docs that near_duplicates() keeps, all columns as they were."""
    kept = near_duplicates(docs, id_col, text_col, threshold).where("not kept").select(F.col("doc_id").alias("doc"), "mark").distinct()
    given = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)), F.col(id_col).cast("long").alias("doc"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("mark"))
    rest = fitted_join(given, kept.withColumn("gone", F.lit(True)), ["doc", "mark"], "left").where("gone is null")
    return rest.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)))
