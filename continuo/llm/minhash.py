"""MinHash near-dedup with tensored banding.

Two small collections of ``side`` band hashes (``rows`` minhashes each) give side * side tables: a
table's key joins one band of either side, so 2 * side * rows minhashes do the work of
2 * side * side * rows. At similarity 0.75 with side 12 and rows 2, a pair misses all tables with
probability 1e-4. Bands that nobody else has drop out before keys are formed.

Equal shingle sets are one class (128-bit set hash) behind its smallest doc_id. A class goes by a
64-bit number; the few numbers that two classes would share are dealt anew. Links are confirmed
on full sets of 64-bit shingle hashes, in rounds that leave out what is connected already:
each class against the best of its buckets' smallest members; then against the best-linked member
of its buckets; then every pair that meets in a table and is still in different components, tested
in blocks inside tasks. So no link between components is left untested, and no pairs are gathered. Components
come from distributed star contraction.

The blocks of the last round are the classes behind a common left band, cut into parts that meet
pairwise where it is common. Where that takes more parts than a side has bands, its table keys take its place, and
only a key that is too common itself is cut. A pair is tested in the first block where it meets, so the copies of a
set are a few for each band, however common it is, as long as no whole key is.

Rows of one doc_id count as one document (all its sets are reachable from each other). A null doc_id
links with nothing, nor does a text without words; both stay. Empty tables give no rows. Other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from continuo.llm.common import checked_broadcast, give_back, materialize, unbatched
from continuo.llm.graph import components
from continuo.llm.hashing import Words, mix, set_hashes

SHINGLE, SIDE, ROWS, PERCENT = 5, 12, 2, 75
#: Classes, and their shingles, on one side of a block of pairs (on average; one class at least).
BLOCK, BLOCK_SHINGLES = 1_000, 500_000
_SEED = 20_240_501


def _functions(side: int, rows: int):
    random = np.random.default_rng(_SEED)
    number = 2 * side * rows
    return random.integers(0, 2**63, number, dtype=np.uint64) * np.uint64(2) + np.uint64(1), random.integers(0, 2**63, number, dtype=np.uint64)


def bands_of(shingles: np.ndarray, factors: np.ndarray, masks: np.ndarray, rows: int) -> np.ndarray:
    least = np.full(len(factors), np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(shingles), 2048):
        least = np.minimum(least, ((shingles[at : at + 2048, None] ^ masks) * factors).min(axis=0))
    least = mix(least).reshape(-1, rows)
    band = least[:, 0]
    for k in range(1, rows):
        band = mix(band * np.uint64(0x9E3779B97F4A7C15) + least[:, k])
    return band


def set_key(shingles: np.ndarray) -> tuple[int, int]:
    """A 128-bit hash of a set: two independent sums of mixed members."""
    with np.errstate(over="ignore"):
        return int(mix(shingles + np.uint64(0x51ED270B)).sum(dtype=np.uint64).view(np.int64)), int(mix(shingles ^ np.uint64(0x2545F4914F6CDD1D)).sum(dtype=np.uint64).view(np.int64))


def _signatures(size: int, side: int, rows: int):
    def run(batches):
        import pyarrow as pa

        factors, masks = _functions(side, rows)
        for batch in unbatched(batches):
            flat, begin = set_hashes(Words(batch["text"], lower=True), size)
            ns, keys, bands = [], [], np.zeros((batch.num_rows, 2 * side), dtype=np.uint64)
            for k in range(batch.num_rows):
                own = np.unique(flat[begin[k] : begin[k + 1]])
                ns.append(len(own))
                keys.append(set_key(own))
                if len(own):
                    bands[k] = bands_of(own, factors, masks, rows)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * (2 * side)), pa.array(bands.view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(ns, pa.int64()), pa.array([a for a, _ in keys], pa.int64()), pa.array([b for _, b in keys], pa.int64()), lists], ["doc_id", "n", "h1", "h2", "bands"])

    return run


def _sets(size: int):
    def run(batches):
        import pyarrow as pa

        for batch in unbatched(batches):
            flat, begin = set_hashes(Words(batch["text"], lower=True), size)
            sets = [np.unique(flat[a:b]) for a, b in zip(begin[:-1], begin[1:], strict=True)]
            keys = [set_key(s) for s in sets]
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in keys], pa.int64()), pa.array([b for _, b in keys], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["h1", "h2", "shingles"])

    return run


def _confirm(percent: int):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            keep = []
            for left, right in zip(batch["left"], batch["right"], strict=True):
                a, b = np.frombuffer(left.as_buffer(), dtype=np.uint64), np.frombuffer(right.as_buffer(), dtype=np.uint64)
                if len(a) > len(b):
                    a, b = b, a
                at = np.minimum(np.searchsorted(b, a), len(b) - 1)
                common = int((b[at] == a).sum())
                keep.append(100 * common >= percent * (len(a) + len(b) - common))
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))
        give_back()

    return run


def _close(side: int, percent: int):
    """Tests a block: rows of one left band ``i`` (and right band ``j``, if not -1), of parts a and b of it."""

    def run(key, rows):
        import pandas as pd

        i, j, a, b = (int(x) for x in key[1:])
        bands = np.stack(rows["bands"].to_numpy())
        left, right = bands[:, :side], bands[:, side:]
        part, root, n, ids = rows["part"].to_numpy(), rows["root"].to_numpy().copy(), rows["n"].to_numpy(), rows["class"].to_numpy()
        flat, at = np.unique(np.concatenate([np.frombuffer(s, dtype=np.uint64) for s in rows["shingles"]]), return_inverse=True)
        begin = np.concatenate([[0], np.cumsum(n)])
        marked, out = np.zeros(len(flat), dtype=bool), []
        for y in range(len(n)):
            if a != b and part[y] != a:
                continue
            z = np.flatnonzero((root != root[y]) & (100 * np.minimum(n, n[y]) >= percent * np.maximum(n, n[y])))
            z = z[part[z] == b] if a != b else z[z > y]
            if not len(z):
                continue
            same = left[z] == left[y]
            meets = same[:, i] & (same.argmax(axis=1) == i)  # the first left band that they share
            same = right[z] == right[y]
            meets &= same.any(axis=1) if j < 0 else same[:, j] & (same.argmax(axis=1) == j)
            z = z[meets]
            if not len(z):
                continue
            own = at[begin[y] : begin[y + 1]]
            marked[own] = True
            common = np.array([np.count_nonzero(marked[at[begin[x] : begin[x + 1]]]) for x in z])
            marked[own] = False
            for x in z[100 * common >= percent * (n[z] + n[y] - common)]:
                if root[x] != root[y]:
                    out.append((ids[y], ids[x]))
                    root[root == max(root[x], root[y])] = min(root[x], root[y])
        if len(at) > BLOCK_SHINGLES // 2:
            del flat, at, marked
            give_back()
        return pd.DataFrame(out, columns=["u", "v"], dtype="int64")

    return run


def numbered(classes: DataFrame, number: Column | None = None) -> DataFrame:
    """Adds ``class``, a 64-bit number of (h1, h2); where several have one hash, all but the first get another."""
    found = classes.withColumn("class", F.xxhash64("h1", "h2") if number is None else number)
    found = found.withColumn("k", F.row_number().over(Window.partitionBy("class").orderBy("h1", "h2")))
    return found.withColumn("class", F.when(F.col("k") == 1, F.col("class")).otherwise(F.xxhash64("class", "h2", "h1", "k"))).drop("k")


class NearDuplicates:
    """The run over one table; ``links`` are confirmed pairs of class representatives."""

    def __init__(self, docs: DataFrame, size: int = SHINGLE, side: int = SIDE, rows: int = ROWS, percent: int = PERCENT):
        self.size, self.side, self.percent = size, side, percent
        self.texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        signed = materialize(self.texts.mapInArrow(_signatures(size, side, rows), "doc_id long, n long, h1 long, h2 long, bands array<long>"), "signatures")
        classes = signed.where("n > 0 and doc_id is not null").groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"))
        # written first, so that the join back deals both sides anew and the runtime can split a hot class
        classes = materialize(numbered(classes), "set-classes")
        self.members = materialize(signed.join(classes, ["h1", "h2"], "left"), "members")
        own = self.members.where("doc_id = rep and n > 0").select("class", "rep", "n", "h1", "h2", "bands")
        self.classes = materialize(own.dropDuplicates(["class"]), "classes")

    def table_rows(self) -> DataFrame:
        """(key, i, j, class, rep, n, bands) of every class in every table where it has company."""
        side = self.side
        bands = self.classes.select("class", F.posexplode("bands").alias("k", "band"))
        bands = bands.select("class", "k", F.xxhash64("k", "band").alias("band"))
        shared = bands.groupBy("band").agg(F.count("*").alias("times")).where("times > 1").select("band")
        own = bands.join(shared, "band").groupBy("class").agg(F.collect_list(F.struct("k", "band")).alias("own"))
        own = own.select("class", F.filter("own", lambda x: x["k"] < side).alias("l"), F.filter("own", lambda x: x["k"] >= side).alias("r"))
        own = own.where("size(l) > 0 and size(r) > 0").select("class", F.explode("l").alias("l"), "r").select("class", "l", F.explode("r").alias("r"))
        keyed = own.select("class", F.xxhash64("l.band", "r.band").alias("key"), F.col("l.k").alias("i"), (F.col("r.k") - side).alias("j"))
        keyed = materialize(keyed, "table-keys")
        company = keyed.groupBy("key").agg(F.count("*").alias("times")).where("times > 1").select("key")
        keyed = keyed.join(company, "key")
        return materialize(keyed.join(self.classes.select("class", "rep", "n"), "class"), "table-rows")

    def confirm(self, pairs: DataFrame) -> DataFrame:
        """The pairs (u, v) of classes whose full sets are similar enough."""
        left, right = (self.sets.select(F.col("class").alias(c), F.col("shingles").alias(s)) for c, s in (("u", "left"), ("v", "right")))
        return materialize(pairs.join(left, "u").join(right, "v").select("u", "v", "left", "right").mapInArrow(_confirm(self.percent), "u long, v long"), "links")

    def fits(self, a: str, b: str):
        return 100 * F.least(F.col(a), F.col(b)) >= self.percent * F.greatest(F.col(a), F.col(b))

    def roots(self, links: DataFrame) -> DataFrame:
        """(class, root, degree) of linked classes; roots are doc_ids."""
        reps = self.classes.select("class", "rep")
        edges = links.join(reps.toDF("u", "ru"), "u").join(reps.toDF("v", "rv"), "v")
        found = components(edges.select(F.col("ru").alias("u"), F.col("rv").alias("v")))
        ends = links.select(F.col("u").alias("class")).unionByName(links.select(F.col("v").alias("class"))).groupBy("class").agg(F.count("*").alias("degree"))
        return ends.join(reps, "class").join(found, F.col("rep") == F.col("node")).select("class", "root", "degree")

    def run(self) -> DataFrame:
        """doc_id, n_shingles, component_id, kept of every row."""
        rows = self.table_rows()
        wanted = self.classes.join(rows.select("class").distinct(), "class", "left_semi")
        wanted = materialize(wanted.select("class", "rep", "h1", "h2"), "wanted")
        ids = wanted.select(F.col("rep").alias("doc_id")).distinct()
        texts = self.texts.join(checked_broadcast(ids, wanted.count()), "doc_id", "left_semi")
        sets = texts.mapInArrow(_sets(self.size), "h1 long, h2 long, shingles binary")
        sets = sets.join(wanted.select("h1", "h2", "class"), ["h1", "h2"]).select("class", "shingles")
        self.sets = materialize(sets.dropDuplicates(["class"]), "sets")
        # first round: the best of the smallest members of a class's buckets
        head = rows.groupBy("key").agg(F.min(F.struct("rep", "class", "n")).alias("head"))
        met = rows.join(head, "key").where((F.col("class") != F.col("head.class")) & self.fits("n", "head.n"))
        met = met.groupBy(F.col("class").alias("u"), F.col("head.class").alias("v"), F.col("head.rep").alias("first")).agg(F.count("*").alias("times"))
        tested = materialize(met.groupBy("u").agg(F.max(F.struct("times", -F.col("first"), "v")).alias("best")).select("u", F.col("best.v").alias("v")), "tested")
        links = self.confirm(tested)
        # second: the best-linked member of those that lead buckets which still span components
        spread = self.spanning(rows, links)
        hub = spread.groupBy("key").agg(F.max(F.struct("degree", (-F.col("rep")).alias("order"), "class", "n", "root")).alias("hub"))
        met = spread.join(hub, "key").where((F.col("root") != F.col("hub.root")) & self.fits("n", "hub.n"))
        met = met.groupBy("class").agg(F.max(F.struct("hub.degree", "hub.order", F.col("hub.class").alias("v"))).alias("best"))
        fresh = materialize(self.untested(met.select(F.col("class").alias("u"), F.col("best.v").alias("v")), tested), "tested")
        links = links.unionByName(self.confirm(fresh))
        # third: every pair that still meets across components, in blocks
        return self.label(links.unionByName(self.close(self.spanning(rows, links))))

    def close(self, spread: DataFrame) -> DataFrame:
        """Links that join components: all pairs that share a band on both sides, in blocks.

        A block's pairs are tested inside one task on at most two parts of about ``BLOCK`` sets and
        ``BLOCK_SHINGLES`` shingles; only links that join what the block has not joined yet come out.
        """
        rows = materialize(spread.select("class", "root").distinct(), "open-classes")
        rows = rows.join(self.classes.select("class", "n", "bands"), "class")
        every = ["class", "root", "n", "bands", "i", "j"]
        left = rows.select("class", "root", "n", "bands", F.posexplode(F.slice("bands", 1, self.side)).alias("i", "band"))
        left = left.withColumns({"key": F.xxhash64("i", "band"), "j": F.lit(-1)}).select(*every, "key")
        left = self.sized(materialize(left, "open-bands"))
        left = materialize(left, "sized-bands")
        by_key = F.col("parts") > self.side  # below, parts that meet pairwise need fewer copies than keys
        right = left.where(by_key).drop("j", "parts", "key")
        right = right.select("class", "root", "n", "bands", "i", F.col("bands")[F.col("i")].alias("own"), F.posexplode(F.slice("bands", self.side + 1, self.side)).alias("j", "band"))
        right = right.withColumn("key", F.xxhash64("i", "own", "j", "band")).select(*every, "key")
        right = self.sized(materialize(right, "open-keys"))
        dealt = left.where(~by_key).select(*every, "key", "parts").unionByName(right.select(*every, "key", "parts"))
        dealt = dealt.withColumn("part", F.pmod(F.xxhash64("class", "i", "j"), F.col("parts")).cast("int"))
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        dealt = dealt.select(*every, "key", "part", F.least("part", "other").alias("a"), F.greatest("part", "other").alias("b"))
        dealt = dealt.join(self.sets.select("class", "shingles"), "class")
        return materialize(dealt.groupBy("key", "i", "j", "a", "b").applyInPandas(_close(self.side, self.percent), "u long, v long"), "links")

    @staticmethod
    def sized(rows: DataFrame) -> DataFrame:
        """Rows of the keys that span components, with the ``parts`` that their key needs."""
        parts = (F.floor(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_SHINGLES)) + 1).cast("int")
        sizes = rows.groupBy("key").agg(parts.alias("parts"), F.min("root").alias("a"), F.max("root").alias("b"))
        return rows.join(sizes.where("a <> b").select("key", "parts"), "key")

    def spanning(self, rows: DataFrame, links: DataFrame) -> DataFrame:
        """Rows of buckets that span components, with root and degree."""
        roots = materialize(self.roots(links), "roots")
        rows = rows.join(roots, "class", "left").withColumn("root", F.coalesce("root", "rep")).withColumn("degree", F.coalesce("degree", F.lit(0)))
        rows = materialize(rows, "rooted")
        open_ = rows.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("key")
        return materialize(rows.join(open_, "key"), "spanning")

    @staticmethod
    def untested(pairs: DataFrame, tested: DataFrame) -> DataFrame:
        """Distinct pairs in a fixed order, without those tested either way."""
        ordered = lambda d: d.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
        return ordered(pairs).distinct().join(ordered(tested), ["u", "v"], "left_anti")

    def label(self, links: DataFrame) -> DataFrame:
        reps = self.classes.select("class", "rep")
        edges = links.join(reps.toDF("u", "ru"), "u").join(reps.toDF("v", "rv"), "v").select(F.col("ru").alias("u"), F.col("rv").alias("v"))
        ids = self.members.where("rep is not null").select("doc_id", "rep").distinct()
        repeated = ids.groupBy("doc_id").agg(F.min("rep").alias("v"), F.count("*").alias("times")).where("times > 1")
        edges = edges.unionByName(repeated.join(ids, "doc_id").select(F.col("rep").alias("u"), "v"))
        roots = materialize(components(edges), "components")
        own = self.members.join(roots, F.col("rep") == F.col("node"), "left")
        component = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "rep", "doc_id"))
        return own.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def near_duplicates(docs: DataFrame, size: int = SHINGLE, side: int = SIDE, rows: int = ROWS, percent: int = PERCENT) -> DataFrame:
    return NearDuplicates(docs, size, side, rows, percent).run()
