"""Sharding by best-fit-decreasing bin packing, and by two plainer laws.

``bytes``: equal texts form an indivisible group. Groups smaller than a unit (a small fraction of a
shard) are packed into parcels of one unit within their partition; larger groups are parcels of
their own. As a shard holds a fixed number of units, and there are no more partitions than units, parcels
are few at any input size (three a unit at most), so one place packs them all: the least capacity
at which best fit, decreasing, needs no more than the wanted shards. ``rows``: counts at most one
apart. ``key``: doc_id and the number of shards decide (rendezvous hashing), so one more shard only
takes rows into itself.

Null texts are one group of size 8 with crc32 0. Repeated rows stay together under ``bytes`` and keep
slots of their own: equal rows are one row with a count until their slots are known, so no number of them
meets in one task. Null doc_ids are a value like any other. Empty tables give no rows.
"""

from __future__ import annotations

from bisect import bisect_left, insort

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from continuo.llm.common import checked_broadcast, materialize

UNITS_PER_SHARD, BLOCK_GROUPS, SLOT_ROWS = 200, 100_000, 20_000
#: Equal rows that one row stands for while they are dealt out.
COPY_BLOCK = 10_000


class CapacityTree:
    """A balanced tree of height two over (remaining capacity, bin): leaves split in half when full."""

    LEAF = 256

    def __init__(self):
        self.leaves: list[list[tuple[int, int]]] = [[]]
        self.heads: list[tuple[int, int]] = [(-1, -1)]  # each leaf's lower bound

    def add(self, remaining: int, bin_: int) -> None:
        at = max(0, bisect_left(self.heads, (remaining, bin_)) - 1)
        leaf = self.leaves[at]
        insort(leaf, (remaining, bin_))
        if len(leaf) > self.LEAF:
            half = len(leaf) // 2
            self.leaves[at : at + 1] = [leaf[:half], leaf[half:]]
            self.heads.insert(at + 1, leaf[half])

    def take_tightest(self, size: int) -> tuple[int, int] | None:
        """Removes and returns the bin with the least remaining capacity of at least ``size``."""
        at = max(0, bisect_left(self.heads, (size, -1)) - 1)
        while at < len(self.leaves):
            k = bisect_left(self.leaves[at], (size, -1))
            if k < len(self.leaves[at]):
                found = self.leaves[at].pop(k)
                if not self.leaves[at] and len(self.leaves) > 1:
                    del self.leaves[at]
                    del self.heads[at]
                    self.heads[0] = (-1, -1)
                return found
            at += 1
        return None


class Bins:
    """Bins of one capacity in the order of their opening; sizes enter the tightest that holds them."""

    def __init__(self, capacity: int):
        self.capacity, self.tree, self.number = capacity, CapacityTree(), 0

    def put(self, size: int, most: int | None = None) -> int | None:
        """The bin that takes ``size``; None if that would be one more than ``most``."""
        found = self.tree.take_tightest(size)
        if found is None:
            if self.number == most:
                return None
            found = (max(self.capacity, size), self.number)
            self.number += 1
        self.tree.add(found[0] - size, found[1])
        return found[1]


def best_fit(sizes: list[int], capacity: int, most: int | None = None) -> list[int] | None:
    """Bins of sizes given in descending order; None as soon as more than ``most`` are needed."""
    bins, out = Bins(capacity), []
    for size in sizes:
        if (at := bins.put(size, most)) is None:
            return None
        out.append(at)
    return out


def into_bins(sizes: list[int], bins: int) -> list[int]:
    """Bins 0 to bins - 1 for sizes in descending order, at the least capacity that best fit manages."""
    low = max([-(-sum(sizes) // bins), *sizes[:1]], default=1)
    high = low + (sizes[0] if sizes else 0) + 1
    while (best := best_fit(sizes, high, bins)) is None:
        high *= 2
    while low < high:
        half = (low + high) // 2
        if (got := best_fit(sizes, half, bins)) is None:
            low = half + 1
        else:
            best, high = got, half
    return best


def pack_groups(groups: DataFrame, unit: int) -> DataFrame:
    """(digest, size) to (digest, size, parcel): parcels of at most ``unit``, or one larger group.

    A partition's groups come in blocks, each in descending order; its parcels stay open from block to block.
    """

    def place(batches):
        import pandas as pd
        from pyspark import TaskContext

        base, bins, held, rows = TaskContext.get().partitionId() << 36, Bins(unit), [], 0

        def parcels(frames):
            block = pd.concat(frames).sort_values(["size", "digest"], ascending=[False, True])
            return block.assign(parcel=[base + bins.put(size) for size in block["size"].tolist()])

        for batch in batches:
            if len(batch):
                held.append(batch)
                rows += len(batch)
            if rows >= BLOCK_GROUPS:
                yield parcels(held)
                held, rows = [], 0
        if held:
            yield parcels(held)

    return groups.mapInPandas(place, "digest string, size long, parcel long")


def with_slots(rows: DataFrame, n_rows: int, *tie: str) -> DataFrame:
    """A row for each of the ``times`` that a row counts for, with its ``slot``: 0, 1, ... within each shard.

    Numbers run over hashed buckets, so that no shard is one task, and over rows that stand for their equals.
    """
    buckets = max(1, n_rows // SLOT_ROWS)
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64(*tie), F.lit(buckets)).cast("int"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy("shard", "bucket").agg(F.sum("times").alias("in_bucket"))
    base = base.select("shard", "bucket", F.coalesce(F.sum("in_bucket").over(before), F.lit(0)).alias("base"))
    own = Window.partitionBy("shard", "bucket").orderBy(*tie).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("ahead", F.coalesce(F.sum("times").over(own), F.lit(0))).join(base, ["shard", "bucket"])
    rows = rows.withColumn("first", F.col("base") + F.col("ahead")).drop("bucket", "base", "ahead")
    few = rows.where(F.col("times") <= COPY_BLOCK).withColumn("slot", _numbers(F.col("first"), F.col("times")))
    many = rows.where(F.col("times") > COPY_BLOCK)
    block = F.explode(F.sequence(F.lit(0), F.floor((F.col("times") - 1) / COPY_BLOCK)))
    many = many.withColumn("block", block).repartition(buckets, *tie, "block")  # their equals are written by many tasks
    left = F.least(F.col("times") - F.col("block") * COPY_BLOCK, F.lit(COPY_BLOCK))
    many = many.withColumn("slot", _numbers(F.col("first") + F.col("block") * COPY_BLOCK, left)).drop("block")
    return few.unionByName(many).drop("first", "times")


def _numbers(first, number):
    return F.explode(F.sequence(first, first + number - 1))


def shard_by_key(key, shards: int):
    """The shard with the greatest hash of (key, shard): rendezvous hashing."""
    return F.array_max(F.array(*[F.struct(F.xxhash64(key, F.lit(k)).alias("h"), F.lit(k).alias("k")) for k in range(shards)]))["k"]


def shard(docs: DataFrame, n_shards: int = 24, law: str = "bytes", units_per_shard: int = UNITS_PER_SHARD) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document."""
    text = F.col("text").cast("string")
    thin = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
        F.coalesce(F.crc32(F.encode(text, "UTF-8")), F.lit(0)).cast("long").alias("text_crc32"),
        F.coalesce(F.md5(F.encode(text, "UTF-8")), F.lit("null")).alias("digest"),
    )
    names = ["doc_id", "size", "text_crc32", "digest"]
    thin = materialize(thin.groupBy(*names).agg(F.count("*").alias("times")), "shard-rows")
    spark, sums = docs.sparkSession, thin.agg(F.sum("times").alias("rows"), F.sum(F.col("size") * F.col("times")).alias("bytes")).first()
    n_rows, total = sums["rows"] or 0, sums["bytes"] or 0
    grown = F.lit(None).cast("int")
    if law == "bytes":
        units = n_shards * units_per_shard
        groups = thin.groupBy("digest").agg(F.sum(F.col("size") * F.col("times")).alias("size"))
        unit = max(1, -(-total // n_shards) // units_per_shard)
        placed = materialize(pack_groups(groups.coalesce(units), unit), "shard-parcels")
        parcels = placed.groupBy("parcel").agg(F.sum("size").alias("size")).collect()  # three a unit at most
        parcels.sort(key=lambda r: (-r["size"], r["parcel"]))
        bins = into_bins([r["size"] for r in parcels], n_shards)
        of = spark.createDataFrame([(r["parcel"], b) for r, b in zip(parcels, bins, strict=True)], "parcel long, shard int")
        # equal texts may be a third of all rows: this join is left to the runtime's skew handling
        rows = thin.join(placed.select("digest", "parcel"), "digest").join(checked_broadcast(of, len(parcels)), "parcel")
        rows = rows.select(*names, "times", "shard")
    elif law == "key":
        rows = thin.withColumn("shard", shard_by_key(F.col("doc_id"), n_shards))
        grown = shard_by_key(F.col("doc_id"), n_shards + 1)
    elif law == "rows":
        rows = with_slots(thin.withColumn("shard", F.lit(0)), n_rows, "doc_id", "digest")
        rows = rows.withColumn("shard", (F.col("slot") % n_shards).cast("int")).withColumn("slot", F.floor(F.col("slot") / n_shards).cast("long"))
    else:
        raise ValueError(f"unknown law {law!r}: bytes, rows or key")
    if law != "rows":
        rows = with_slots(materialize(rows, "shard-placed"), n_rows, "doc_id", "digest")
    return rows.select("doc_id", "size", "text_crc32", F.lit(law).alias("law"), "shard", "slot", grown.cast("int").alias("grown_shard"))
