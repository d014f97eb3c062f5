"""Exact deduplication over an extendible-hash index in shared files.

A text's key is the 64-bit hash of its normalised form. The directory maps the key's leading bits to buckets; a bucket
that overflows is split, and the directory doubles when the bucket already uses all of its bits. Entries go to one file
group per owner, each owner holding a range of buckets (so a range of keys), and an owner chains the entries whose keys
collide. Members of a group are compared with the group's first text byte by byte before they share its class.

Hot texts: an index entry stands for all rows with one fingerprint, counted by a partial aggregate, so a text that a
third of all rows share is one entry and never one task.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heddle.llm.common import SPACE, materialise

#: Entries that a bucket holds before it is split.
BUCKET_ENTRIES = 200_000
#: Most leading bits a directory may use; a bucket at this depth chains its overflow.
MAX_DEPTH = 20


@dataclass
class Directory:
    """The directory: for each of 2**depth leading-bit patterns the bucket, given as (local depth, leading bits)."""

    capacity: int
    max_depth: int = MAX_DEPTH
    depth: int = 0
    slots: list[tuple[int, int]] = field(default_factory=lambda: [(0, 0)])

    def build(self, counts: dict[int, int], count_depth: int) -> "Directory":
        """counts: entries for each leading pattern of count_depth bits. Splits every bucket that holds more than capacity."""
        pending = [(0, 0)]
        weight = {(0, 0): counts}
        while pending:
            d, bits = bucket = pending.pop()
            held = weight.pop(bucket)
            if sum(held.values()) <= self.capacity or d >= min(self.max_depth, count_depth):
                continue
            if d == self.depth:  # the bucket uses all bits: the directory doubles
                self.slots = [s for s in self.slots for _ in (0, 1)]
                self.depth += 1
            step = 1 << (self.depth - d - 1)
            for half in (0, 1):
                child = (d + 1, bits * 2 + half)
                first = child[1] * step
                self.slots[first : first + step] = [child] * step
                weight[child] = {k: n for k, n in held.items() if (k >> (count_depth - d - 1)) & 1 == half}
                pending.append(child)
        return self

    def buckets(self) -> list[tuple[int, int]]:
        return sorted(set(self.slots), key=lambda b: b[1] / (1 << b[0]))

    def number(self, key: Column) -> Column:
        """The bucket's number for a 64-bit key: an index into the directory by the key's leading bits."""
        numbers = {b: i for i, b in enumerate(self.buckets())}
        if self.depth == 0:
            return F.lit(0)
        slots = F.array(*(F.lit(numbers[s]) for s in self.slots))
        return F.element_at(slots, F.shiftrightunsigned(key, 64 - self.depth).cast("int") + 1)


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE + "+", "")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_entries: int = BUCKET_ENTRIES) -> DataFrame:
    """One row for each document: its group's keeper, the group's size, and the normalised text's SHA-256.

    Texts are equal when they are identical once ASCII white space is deleted; of equal ones, the row with the most code
    points in the original stays, then the smallest id. Null texts count as empty; a null id sorts after all others;
    rows that repeat an id and a text are alike and carry the same flags; an empty table gives no rows. Columns besides
    the two named ones are ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("norm"), F.length(F.coalesce(F.col(text_col), F.lit(""))).alias("n_points"))
    rows = rows.withColumns({"key": F.xxhash64("norm"), "sha": F.sha2("norm", 256)})
    thin = materialise(rows.select("doc_id", "key", "sha", "n_points"), "fingerprints")

    index = write_index(thin, bucket_entries)
    repeated = index.where("group_size > 1").select("key", "sha", "keep_id", "group_size")

    # Members of groups are compared with the keeper's bytes; a fingerprint whose texts differ is split by the bytes.
    members = materialise(rows.join(repeated.drop("group_size"), ["key", "sha"]), "members")
    first = members.where("doc_id <=> keep_id").groupBy("key", "sha").agg(F.min("norm").alias("first_norm"))
    differs = members.join(first, ["key", "sha"]).where("norm <> first_norm")
    if not differs.isEmpty():
        return _by_bytes(rows)

    same = repeated.select("key", "sha", "keep_id", "group_size")
    out = thin.join(same, ["key", "sha"], "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    out = out.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.col("sha").alias("text_sha256"))
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def write_index(thin: DataFrame, bucket_entries: int) -> DataFrame:
    """The index in shared files: (bucket, chain, key, sha, keep_id, group_size), an owner's buckets in its own files, in key order.

    chain numbers the entries that collide in a key.
    """
    order = F.struct(F.col("n_points").alias("p"), F.coalesce(-F.col("doc_id"), F.lit(-(2**63))).alias("i"))
    entries = thin.groupBy("key", "sha").agg(F.count("*").alias("group_size"), F.max(order).alias("best"))
    entries = entries.select("key", "sha", "group_size", F.when(F.col("best.i") != -(2**63), -F.col("best.i")).alias("keep_id"))
    entries = materialise(entries, "entries")
    total = entries.count()
    depth = min(MAX_DEPTH, max(0, (total // bucket_entries)).bit_length() + 3)
    prefix = F.shiftrightunsigned("key", 64 - depth).alias("prefix")
    counts = {r.prefix: r["count"] for r in entries.groupBy(prefix).count().toLocalIterator()}  # 2**depth rows: about 16 for each bucket
    directory = Directory(bucket_entries).build(counts, depth)
    chain = F.row_number().over(Window.partitionBy("key").orderBy("sha")) - 1
    owned = entries.withColumn("bucket", directory.number(F.col("key"))).withColumn("chain", chain)
    return materialise(owned.repartition("bucket", "key").sortWithinPartitions("bucket", "key"), "index")


def _by_bytes(rows: DataFrame) -> DataFrame:
    """The same result grouped by the texts' bytes themselves: for inputs on which two texts share a fingerprint."""
    order = F.struct(F.col("n_points").alias("p"), F.coalesce(-F.col("doc_id"), F.lit(-(2**63))).alias("i"))
    groups = rows.groupBy("norm").agg(F.count("*").alias("group_size"), F.max(order).alias("best"))
    keep = F.when(F.col("best.i") != -(2**63), -F.col("best.i"))
    out = rows.join(groups, "norm").select("doc_id", keep.alias("keep_id"), F.col("group_size").cast("long").alias("group_size"), F.col("sha").alias("text_sha256"))
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
