"""Merkle manifest of a dataset: a tree a group, a tree over the groups, and a proof for every row.

Rows are leaves in the order of their group (``lang``), doc_id, leaf. Up to ``FANOUT`` consecutive nodes become one by
hashing their hex digests; a lone node of a level above or below which others stand is hashed, too, and a level with
one node ends the tree. Numbers within groups come from a range partitioning: counts by partition and group, summed up.

Large blocks are reduced where they lie: one row holds a block of ``BLOCK`` consecutive nodes, and gives one node of the
level above. That is repeated until ``TOP`` nodes are left at most, whatever the number of rows. The driver builds the
small top tree and broadcasts each block's suffix path: the siblings from there to the root. Executors put the path
within a block before it, hash the proof and fold it from the row's leaf as it is presented now. If there are more
groups than ``TOP``, their roots are blocks of a further tree that is reduced in the same way.

Nulls: every column may be null, which is encoded as ``-``; the null group comes first, null doc_ids come first in their
group. Repeated rows are leaves of their own. An empty table gives no rows. Very long texts are hashed whole. Other
columns are ignored. ``presented`` says how a row's text reads now; equal texts fold to the root.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from continuo.llm.common import checked_broadcast, materialize
from continuo.llm.decontaminate import lower_ascii

FANOUT, DEPTH = 8, 4
#: Nodes that the driver's tree starts from at most; a suffix path takes about 2 KB.
TOP = 8_192
#: Rows of one range of the order, about.
RANGE_ROWS = 50_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_PATH = "array<struct<at: int, around: binary>>"
PROVED = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def encoded(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(text: Column) -> Column:
    """The digest of a row whose text is ``text``."""
    parts = [encoded(text if name == "text" else F.col(name)) for name in FIELDS]
    return F.unhex(F.sha2(F.concat(*parts).cast("binary"), 256))


def tampered_text() -> Column:
    """Every third row by the checksum of its doc_id reads in lower case; a null doc_id is not tampered with."""
    hit = F.crc32(F.encode(F.col("doc_id").cast("long").cast("string"), "UTF-8")) % 3 == 0
    text = F.col("text").cast("string")
    return F.when(hit, lower_ascii(text)).otherwise(text)


def _joined(nodes: list[bytes]) -> bytes:
    return hashlib.sha256(b"".join(nodes)).hexdigest().encode()


def levels(nodes: list[bytes], depth: int | None, fanout: int = FANOUT) -> list[list[list[bytes]]]:
    """The runs of every level, from ``nodes`` up: ``depth`` levels, or (None) until one node is left."""
    out = []
    while depth is None and len(nodes) > 1 or depth is not None and len(out) < depth:
        runs = [nodes[k : k + fanout] for k in range(0, len(nodes), fanout)]
        out.append(runs)
        nodes = [_joined(run) for run in runs]
    return out


def top_of(nodes: list[bytes], depth: int | None, fanout: int = FANOUT) -> bytes:
    tree = levels(nodes, depth, fanout)
    return _joined(tree[-1][0]) if tree else nodes[0]


def paths(nodes: list[bytes], depth: int | None, fanout: int = FANOUT) -> list[list[tuple[int, bytes]]]:
    """Of every node, by level: how many siblings stand before it, and all siblings' hex digests in a row."""
    tree, out = levels(nodes, depth, fanout), []
    around = [[[(j, b"".join(run[:j] + run[j + 1 :])) for j in range(len(run))] for run in runs] for runs in tree]
    for k in range(len(nodes)):
        path, at = [], k
        for level in around:
            path.append(level[at // fanout][at % fanout])
            at //= fanout
        out.append(path)
    return out


def fold(node: bytes, path: list[tuple[int, bytes]]) -> bytes:
    """The root that a node and its siblings make."""
    for at, siblings in path:
        node = hashlib.sha256(siblings[: 64 * at] + node + siblings[64 * at :]).hexdigest().encode()
    return node


class Manifest:
    """The tree over ``docs`` grouped by ``lang``; ``presented`` is the text as it reads now."""

    def __init__(self, docs: DataFrame, presented: Column | None = None, fanout: int = FANOUT, depth: int = DEPTH, top: int = TOP):
        self.spark, self.fanout, self.depth, self.top = docs.sparkSession, fanout, depth, top
        text, now = F.col("text").cast("string"), F.col("text").cast("string") if presented is None else presented
        group = F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit(""))  # null first, then bytewise
        rows = docs.select(
            F.monotonically_increasing_id().alias("row"),
            group.alias("grp"),
            F.col("doc_id").cast("long").alias("doc_id"),
            leaf(text).alias("digest"),
            F.when(now.eqNullSafe(text), F.lit(None).cast("binary")).otherwise(leaf(now)).alias("now"),
        )
        self.leaves = materialize(rows, "merkle-leaves")
        self.subroots: list[tuple[DataFrame, int]] = []
        numbered = self._numbered(self.leaves, "grp", "doc_id", "digest", "row")
        self.rounds = [self._blocks(numbered, "doc_id", "digest", "now")]

    def _numbered(self, nodes: DataFrame, group: str, *order: str) -> DataFrame:
        """``pos`` from 0 within the group in the given order, and the group's ``total``."""
        ranges = max(1, nodes.count() // RANGE_ROWS + 1)
        dealt = nodes.repartitionByRange(ranges, group, *order).sortWithinPartitions(group, *order)

        def local(batches):
            import numpy as np
            import pyarrow as pa
            from pyspark import TaskContext

            part, last, n = TaskContext.get().partitionId(), None, 0
            for batch in batches:
                groups, number = batch[group].to_pylist(), np.empty(batch.num_rows, dtype=np.int64)
                for k, g in enumerate(groups):
                    n = n + 1 if g == last else 0
                    number[k], last = n, g
                columns = [*batch.columns, pa.array(np.full(batch.num_rows, part, np.int32)), pa.array(number)]
                yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "part", "number"])

        kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in nodes.schema)
        dealt = materialize(dealt.mapInArrow(local, f"{kinds}, part int, number long"), "merkle-order")
        counts = materialize(dealt.groupBy(group, "part").agg(F.count("*").alias("n")), "merkle-counts")
        everywhere = Window.partitionBy(group)
        base = F.coalesce(F.sum("n").over(everywhere.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        base = counts.select(group, "part", base.alias("base"), F.sum("n").over(everywhere).alias("total"))
        out = dealt.join(checked_broadcast(base, counts.count()), [group, "part"])  # ranges and groups together at most
        return out.withColumn("pos", F.col("base") + F.col("number")).drop("part", "number", "base")

    def _blocks(self, nodes: DataFrame, *keep: str) -> DataFrame:
        """One row a block: grp, block, depth of its tree, and its nodes in order."""
        size = self.fanout**self.depth
        block = F.floor(F.col("pos") / size).cast("long").alias("block")
        nodes = nodes.select("grp", block, "total", F.struct("pos", *keep).alias("node"))
        out = nodes.groupBy("grp", "block", "total").agg(F.array_sort(F.collect_list("node")).alias("nodes"))
        depth = F.when(F.col("total") > size, F.lit(self.depth)).alias("depth")  # null: until one node is left
        return materialize(out.select("grp", "block", "total", depth, "nodes"), "merkle-blocks")

    def _reduced(self, blocks: DataFrame) -> DataFrame:
        """grp, pos, total, digest: a node a block."""
        fanout, size = self.fanout, self.fanout**self.depth

        def reduce(batches):
            import pyarrow as pa

            for batch in batches:
                got = []
                for nodes, depth in zip(batch["nodes"].to_pylist(), batch["depth"].to_pylist(), strict=True):
                    got.append(bytes.fromhex(top_of([n["digest"].hex().encode() for n in nodes], depth, fanout).decode()))
                columns = [batch["grp"], batch["block"], batch["total"], pa.array(got, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["grp", "pos", "total", "digest"])

        digests = F.transform("nodes", lambda n: F.struct(n["digest"].alias("digest"))).alias("nodes")
        out = blocks.select("grp", "block", "total", "depth", digests).mapInArrow(reduce, "grp string, pos long, total long, digest binary")
        return materialize(out.withColumn("total", F.ceil(F.col("total") / size).cast("long")), "merkle-nodes")

    def _top(self, nodes: DataFrame, over_groups: bool) -> DataFrame:
        """(grp, block, subroot, root, path) of the nodes that are left, from a tree on the driver."""
        by_group: dict[str, list[bytes]] = {}
        for r in sorted(nodes.select("grp", "pos", "digest").collect(), key=lambda r: (r["grp"].encode(), r["pos"])):
            by_group.setdefault(r["grp"], []).append(r["digest"].hex().encode())
        roots = {g: top_of(nodes, None, self.fanout) for g, nodes in by_group.items()}
        upper, root = [[]] * len(roots), next(iter(roots.values()), b"")
        if over_groups and roots:
            upper, root = paths(list(roots.values()), None, self.fanout), top_of(list(roots.values()), None, self.fanout)
        rows = []
        for (group, below), above in zip(by_group.items(), upper, strict=True):
            for k, path in enumerate(paths(below, None, self.fanout)):
                rows.append((group, k, roots[group].decode() if over_groups else None, root.decode(), [(a, bytearray(s)) for a, s in [*path, *above]]))
        return self.spark.createDataFrame(rows, f"grp string, block long, subroot string, root string, path {_PATH}")

    def _suffixes(self) -> DataFrame:
        """The suffix path of every block of leaves."""
        nodes, rounds, grouped = self._reduced(self.rounds[0]), [], True
        left = nodes.count()
        while left > self.top:
            if nodes.agg(F.max("total")).first()[0] == 1:
                if not grouped:
                    break
                # more groups than the driver takes: their roots are the nodes of one further tree
                grouped, subroots = False, nodes.select(F.col("grp").alias("of"), "digest")
                nodes = self._numbered(subroots.withColumn("grp", F.lit("")), "grp", "of", "digest")
                rounds.append(("groups", materialize(nodes.select("of", "pos", "digest"), "merkle-subroots")))
            blocks = self._blocks(nodes, "digest")
            rounds.append(("blocks", blocks))
            nodes = self._reduced(blocks)
            left = nodes.count()
        suffix, n = self._top(nodes, grouped), left
        for kind, table in reversed(rounds):
            near = checked_broadcast(suffix, n, self.top)
            if kind == "groups":  # (all groups, position) becomes (group, its only block)
                found = table.join(near.withColumnRenamed("block", "pos").drop("grp", "subroot"), "pos")
                suffix = found.select(F.col("of").alias("grp"), F.lit(0).cast("long").alias("block"), F.lower(F.hex("digest")).alias("subroot"), "root", "path")
            else:
                suffix = self._below(table.join(near, ["grp", "block"]))
            suffix = materialize(suffix, "merkle-suffixes")
            n = suffix.count()
        self.n_suffixes = n
        return suffix

    def _below(self, blocks: DataFrame) -> DataFrame:
        """The suffix paths of a block's nodes: the way to the block's own, and the block's suffix path."""
        fanout = self.fanout

        def extend(batches):
            import pyarrow as pa

            kind = pa.list_(pa.struct([("at", pa.int32()), ("around", pa.binary())]))
            for batch in batches:
                for r in batch.to_pylist():
                    inner = paths([n["digest"].hex().encode() for n in r["nodes"]], r["depth"], fanout)
                    rows = [[{"at": a, "around": s} for a, s in path] + r["path"] for path in inner]
                    same = [[r[c]] * len(rows) for c in ("grp", "subroot", "root")]
                    positions = [n["pos"] for n in r["nodes"]]
                    yield pa.RecordBatch.from_arrays([pa.array(same[0], pa.string()), pa.array(positions, pa.int64()), *[pa.array(x, pa.string()) for x in same[1:]], pa.array(rows, kind)], ["grp", "block", "subroot", "root", "path"])

        return blocks.select("grp", "nodes", "depth", "subroot", "root", "path").mapInArrow(extend, f"grp string, block long, subroot string, root string, path {_PATH}")

    def prove(self) -> DataFrame:
        """A row a leaf: its digest, both roots, the hash of its proof, and the root that its presented text folds to."""
        fanout = self.fanout
        suffix = self._suffixes()
        joined = self.rounds[0].join(checked_broadcast(suffix, self.n_suffixes, self.top), ["grp", "block"])

        def finish(batches):
            import pyarrow as pa

            names = [c.split()[0] for c in PROVED.split(", ")]
            kinds = [pa.int64(), *[pa.string()] * 5, pa.bool_()]
            for batch in batches:
                for r in batch.to_pylist():
                    upper, root = [(x["at"], x["around"]) for x in r["path"]], r["root"]
                    leaves = [n["digest"].hex() for n in r["nodes"]]
                    inner = paths([x.encode() for x in leaves], r["depth"], fanout)
                    above = b"".join([s for _, s in upper])
                    proofs = [hashlib.sha256(b"".join([s for _, s in path]) + above).hexdigest() for path in inner]
                    presented = [x if n["now"] is None else n["now"].hex() for x, n in zip(leaves, r["nodes"], strict=True)]
                    subroot = r["subroot"]
                    folded = [fold(x.encode(), path + upper).decode() for x, path in zip(presented, inner, strict=True)]
                    columns = [[n["doc_id"] for n in r["nodes"]], leaves, [subroot] * len(leaves), [root] * len(leaves), proofs, folded, [x == root for x in folded]]
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names)

        return joined.select("nodes", "depth", "subroot", "root", "path").mapInArrow(finish, PROVED)


def manifest(docs: DataFrame, presented: Column | None = None, fanout: int = FANOUT, depth: int = DEPTH, top: int = TOP) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row."""
    return Manifest(docs, presented, fanout, depth, top).prove()
