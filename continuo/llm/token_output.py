"""Token-id shards with a minimal perfect hash index.

Layout of a folder: ``shard-<n>-<attempt>.bin``, raw little-endian ids of documents in ascending
key order (16 bits where the vocabulary allows, else 32); ``index-<bucket>-<attempt>.npz``, one per
hash bucket of (key, copy). A bucket's index has levels of bit arrays: an entry's first level where it alone
fell on its bit gives its slot (the rank of that bit), so n entries have slots 0 to n - 1. A slot
stores a fingerprint, the shard, the offset there, the number of ids and, for copy 0, how many copies there are.
A lookup costs one bucket a copy, an expected constant number of bits and one range read. Files of lost tasks
are never referred to: the manifest holds only those of attempts that ended.

A null text is empty (it still has the end id). Rows of one key are copies 0, 1, ... in the order of their texts'
first ``PREFIX`` characters, a hash, and their place in the table; however many they are, this order deals them over
shards, and their number deals them over buckets. Null keys come first and are looked up as null. Empty tables give no shards. Other
columns are ignored.
"""

from __future__ import annotations

import io

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from continuo.llm import tokens
from continuo.llm.common import checked_broadcast, materialize, scratch_path, text_of
from continuo.llm.hashing import mix

#: A null key is written under this one.
NULL_KEY = -(2**63)
SHARD_BYTES, BUCKET_KEYS = 256 << 20, 50_000
#: Copies of a key that one row of a lookup stands for while they are dealt out.
COPY_BLOCK = 10_000
PREFIX = 64
_LEVELS, _GAMMA = 48, 2.0


def _key_hash(keys: np.ndarray, copies: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(mix(keys.astype(np.int64).view(np.uint64) + np.uint64(seed)) + copies.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


class PerfectHash:
    """Slots 0 to n - 1 for n distinct 64-bit hashes; ``slots`` gives -1 for some that it never saw."""

    def __init__(self, levels: list[np.ndarray], rest: np.ndarray):
        self.levels, self.rest = levels, np.sort(rest)
        self.ranks, before = [], 0
        for bits in levels:
            self.ranks.append(before + np.concatenate([[0], np.cumsum(bits, dtype=np.int64)[:-1]]))
            before += int(bits.sum())
        self.before = before

    @classmethod
    def build(cls, hashes: np.ndarray) -> PerfectHash:
        levels, rest = [], hashes
        for level in range(_LEVELS):
            if not len(rest):
                break
            size = max(1, int(np.ceil(_GAMMA * len(rest))))
            at = cls._at(rest, level, size)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone)
            rest = rest[~alone[at]]
        return cls(levels, rest)

    @staticmethod
    def _at(hashes: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(hashes + np.uint64((level * 0x632BE59BD9B4E019) % (1 << 64))) % np.uint64(size)).astype(np.int64)

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        out, open_ = np.full(len(hashes), -1, dtype=np.int64), np.arange(len(hashes))
        for level, (bits, ranks) in enumerate(zip(self.levels, self.ranks, strict=True)):
            at = self._at(hashes[open_], level, len(bits))
            hit = bits[at]
            out[open_[hit]] = ranks[at[hit]]
            open_ = open_[~hit]
            if not len(open_):
                return out
        if len(self.rest):
            at = np.minimum(np.searchsorted(self.rest, hashes[open_]), len(self.rest) - 1)
            hit = self.rest[at] == hashes[open_]
            out[open_[hit]] = self.before + at[hit]
        return out


def _open(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder.replace("s3a://", "s3://", 1))


def qualified(spark: SparkSession, folder: str) -> str:
    """The folder with the scheme that Spark takes it to have, so that all writers and readers mean one place."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    uri = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toUri().toString()
    return uri if "://" in uri else uri.replace(":/", ":///", 1)


def _bucket(number: int):
    return F.pmod(F.xxhash64("key", "copy"), F.lit(number)).cast("int").alias("bucket")


class TokenStore:
    """A written folder: ``shards`` (shard, file, ids), ``buckets`` (bucket, file) and lookups by key."""

    def __init__(self, spark: SparkSession, folder: str, width: int, shards: list, buckets: dict, number: int):
        self.spark, self.folder, self.width, self.buckets, self.number = spark, folder, width, buckets, number
        self.shards, before = [], 0
        for shard, file, ids in sorted(shards):
            self.shards.append((shard, file, before))
            before += ids

    def lookup(self, keys: DataFrame) -> DataFrame:
        """(key, copy, shard, at, n) of each distinct key that the index holds; key: column ``key`` long."""
        columns = ("key", "copy", "shard", "at", "n")
        if not self.buckets:
            return self.spark.createDataFrame([], "key long, copy long, shard int, at long, n long")
        first = materialize(self._found(keys.select("key", F.lit(0).cast("long").alias("copy"))), "token-lookup")
        more = first.where("copies > 1").select("key", "copies", F.explode(F.sequence(F.lit(0), F.floor((F.col("copies") - 1) / COPY_BLOCK))).alias("block"))
        more = more.repartition(max(1, self.number), "key", "block")  # a key's many copies are found by many tasks
        begin = F.greatest(F.col("block") * COPY_BLOCK, F.lit(1))
        end = F.least((F.col("block") + 1) * COPY_BLOCK, "copies") - 1
        more = more.where(begin <= end).select("key", F.explode(F.sequence(begin, end)).alias("copy"))
        return first.select(*columns).unionByName(self._found(more).select(*columns))

    def _found(self, entries: DataFrame) -> DataFrame:
        """(key, copy, shard, at, n, copies) of those of the entries (key, copy) that the index holds."""
        folder, buckets = self.folder, self.buckets

        def find(batches):
            import pandas as pd

            files, at = _open(folder)
            loaded: tuple = (None, None, None)
            for batch in batches:
                for bucket, part in batch.groupby("bucket", sort=True):
                    if bucket not in buckets:
                        continue
                    if loaded[0] != bucket:
                        with files.open_input_file(f"{at}/{buckets[bucket]}") as f:
                            data = dict(np.load(io.BytesIO(f.read())))
                        loaded = (bucket, PerfectHash([data[f"level{k}"] for k in range(int(data["levels"]))], data["rest"]), data)
                    _, index, data = loaded
                    keys, copies = part["key"].to_numpy(np.int64), part["copy"].to_numpy(np.int64)
                    slots = index.slots(_key_hash(keys, copies, 1))
                    found = slots >= 0
                    found[found] = data["prints"][slots[found]] == (_key_hash(keys[found], copies[found], 2) >> np.uint64(32)).astype(np.uint32)
                    slots = slots[found]
                    yield pd.DataFrame({"key": keys[found], "copy": copies[found], **{c: data[c][slots] for c in ("shard", "at", "n", "copies")}})

        routed = entries.select("key", "copy", _bucket(self.number))
        routed = routed.repartition(self.number, "bucket").sortWithinPartitions("bucket", "key", "copy")
        return routed.mapInPandas(find, "key long, copy long, shard int, at long, n long, copies long")

    def read(self, located: DataFrame) -> DataFrame:
        """(doc_id, start, n_tokens, ids_crc32) of located documents, read from their shards' files."""
        folder, width, shards = self.folder, self.width, {s: (f, b) for s, f, b in self.shards}

        def fetch(batches):
            import pandas as pd

            files, root = _open(folder)
            open_: tuple = (None, None)
            for batch in batches:
                crcs, starts = [], []
                for shard, at, n in zip(batch["shard"], batch["at"], batch["n"], strict=True):
                    if open_[0] != shard:
                        open_ = (shard, files.open_input_file(f"{root}/{shards[shard][0]}"))
                    open_[1].seek(at * width)
                    crcs.append(tokens.crc32_of(np.frombuffer(open_[1].read(n * width), dtype=f"<u{width}")))
                    starts.append(shards[shard][1] + at)
                doc_id = batch["key"].astype("Int64").mask(batch["key"] == NULL_KEY)
                yield pd.DataFrame({"doc_id": doc_id, "start": starts, "n_tokens": batch["n"], "ids_crc32": crcs})

        return located.repartition(max(1, len(shards)), "shard").sortWithinPartitions("shard", "at").mapInPandas(fetch, "doc_id long, start long, n_tokens long, ids_crc32 long")


def write_tokens(docs: DataFrame, tokenizer_path: str, end_id: int = 1, folder: str | None = None) -> TokenStore:
    """Writes all documents' ids in ascending doc_id order and the index over them."""
    spark = docs.sparkSession
    folder = qualified(spark, folder or scratch_path(spark, "token-store"))
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_KEY)).alias("key"), text_of().alias("text"), F.monotonically_increasing_id().alias("place"))
    total = keyed.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    number = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(total[1] or 0) // SHARD_BYTES))
    files, root = _open(folder)
    files.create_dir(root, recursive=True)

    def write(batches):
        import pandas as pd
        from pyspark import TaskContext

        task, tokenizer = TaskContext.get(), tokens.load(tokenizer_path)
        end, width = np.array([end_id], dtype=tokenizer.dtype).tobytes(), tokenizer.dtype.itemsize
        name = f"shard-{task.partitionId():06d}-{task.taskAttemptId()}.bin"
        out, at, last, copy = None, 0, None, 0
        for batch in batches:
            ns, ats, copies = [], [], []
            for key, text in zip(batch["key"], batch["text"], strict=True):
                if out is None:
                    files, root = _open(folder)
                    out = files.open_output_stream(f"{root}/{name}", buffer_size=1 << 20)
                ids = tokenizer.ids(text) + end
                out.write(ids)
                copy = copy + 1 if key == last else 0
                last = key
                ns.append(len(ids) // width)
                ats.append(at)
                copies.append(copy)
                at += ns[-1]
            yield pd.DataFrame({"key": batch["key"], "copy": copies, "shard": task.partitionId(), "file": name, "at": ats, "n": ns})
        if out is not None:
            out.close()

    order = ["key", F.substring("text", 1, PREFIX), F.xxhash64("text"), "place"]
    ordered = keyed.repartitionByRange(number, *order).sortWithinPartitions(*order).select("key", "text")
    written = materialize(ordered.mapInPandas(write, "key long, copy long, shard int, file string, at long, n long"), "token-manifest")
    written, shards = _numbered(written)
    buckets = -(-total[0] // BUCKET_KEYS)

    def index(batches):
        import pandas as pd
        from pyspark import TaskContext

        rows = [b for b in batches if len(b)]
        if not rows:
            return
        files, root = _open(folder)
        for bucket, part in pd.concat(rows).groupby("bucket"):
            keys, copies = part["key"].to_numpy(np.int64), part["copy"].to_numpy(np.int64)
            hashes = _key_hash(keys, copies, 1)
            table = PerfectHash.build(hashes)
            order = np.empty(len(keys), dtype=np.int64)
            order[table.slots(hashes)] = np.arange(len(keys))
            data = {f"level{k}": bits for k, bits in enumerate(table.levels)}
            data |= {"levels": np.array(len(table.levels)), "rest": table.rest, "prints": (_key_hash(keys, copies, 2) >> np.uint64(32)).astype(np.uint32)[order]}
            data |= {c: part[c].to_numpy()[order] for c in ("shard", "at", "n", "copies")}
            np.savez(out := io.BytesIO(), **data)
            name = f"index-{bucket:06d}-{TaskContext.get().taskAttemptId()}.npz"
            with files.open_output_stream(f"{root}/{name}") as f:
                f.write(out.getvalue())
            yield pd.DataFrame({"bucket": [bucket], "file": [name]})

    routed = written.select("key", "copy", "shard", "at", "n", "copies", _bucket(max(1, buckets)))
    indexed = materialize(routed.repartition(max(1, buckets), "bucket").mapInPandas(index, "bucket int, file string"), "token-index")
    width = tokens.load(tokenizer_path).dtype.itemsize
    return TokenStore(spark, folder, width, shards, {r[0]: r[1] for r in indexed.collect()}, max(1, buckets))  # one row per bucket


def _numbered(written: DataFrame) -> tuple[DataFrame, list[tuple]]:
    """The manifest with copy numbers that run on from shard to shard and the copies of each key; and the shards."""
    spark = written.sparkSession
    ends = F.max(F.struct("key", (F.col("copy") + 1).alias("copies"))).alias("last")
    rows = written.groupBy("shard", "file").agg(F.sum("n").alias("ids"), F.min("key").alias("first"), ends).collect()  # one row per shard
    rows.sort(key=lambda r: r["shard"])
    before, held = [], (None, 0)  # held: the last key so far and its copies so far
    for r in rows:
        if r["first"] == held[0]:
            before.append((r["shard"], r["first"], held[1]))
        last, copies = r["last"]
        held = (last, copies + (held[1] if last == held[0] else 0))
    moved = spark.createDataFrame(before, "shard int, key long, before long")  # a row a shard at most
    written = written.join(checked_broadcast(moved, len(before)), ["shard", "key"], "left")
    written = written.withColumn("copy", F.col("copy") + F.coalesce("before", F.lit(0))).drop("before")
    many = materialize(written.where("copy > 0").groupBy("key").agg((F.max("copy") + 1).alias("copies")), "token-copies")
    written = written.join(checked_broadcast(many, many.count()), "key", "left").withColumn("copies", F.coalesce("copies", F.lit(1)).cast("long"))
    return written, [(r["shard"], r["file"], r["ids"]) for r in rows]
