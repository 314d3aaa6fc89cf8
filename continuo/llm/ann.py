"""Approximate nearest neighbours by cross-polytope hashing.

A hash function rotates unit vectors by three rounds of random signs and a fast Hadamard transform and gives the
nearest signed axis. A table's cell is a run of such functions, the last of which looks at a few axes only; their
number follows the number of vectors, so a cell holds about ``CELL_ROWS`` rows at any size. A query probes
the cells with the least squared gaps to its own axes: ``LEAST_PROBES`` and ``PROBES`` times the root of the
number of cells in each table.

Cells are dealt into groups of about ``GROUP_ROWS`` rows, and a hot one into parts. What goes there is a vector's code:
one byte a component, a scale, and how far that is from the vector. By the triangle inequality it gives
a least and a greatest distance; a candidate is dropped only where as many others surely are nearer. The rest,
little more than the answer, is reranked by exact Euclidean distance on the original vectors in double precision.

Equal vectors are one candidate with its ``k + 1`` smallest vec_ids (more can't be needed). A query
that its cells give fewer than ``k`` neighbours is compared with all vectors, in parts. Vectors
that are null, zero or hold null or non-finite components, and rows with null vec_id, take no part.
Only vectors of one length are compared. Rows with one vec_id are candidates of their own but never
neighbours of a query with that vec_id; queries of one vec_id with unlike vectors are answered each. Ties go to
the smaller vec_id. Empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from continuo.llm.common import checked_broadcast, materialize

TABLES, PROBES, LEAST_PROBES, CELL_ROWS, GROUP_ROWS, BLOCK = 8, 3.0, 24, 12.5, 2_000, 4_000
#: The least number of axes of a table's last function.
LEAST_AXES = 4
_SEED = 91
_KEYS = ("dim", "tab", "grp")


def hadamard(x: np.ndarray) -> np.ndarray:
    size, half = x.shape[1], 1
    while half < size:
        y = x.reshape(len(x), size // (2 * half), 2, half)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), size)
        half *= 2
    return x


def padded(dim: int) -> int:
    return 1 << max(1, (dim - 1).bit_length())


def rotated(vectors: np.ndarray, function: int, axes: int) -> np.ndarray:
    """Inner products (up to scale) with the first ``axes`` axes of the function's pseudo-rotation and their opposites."""
    size = padded(vectors.shape[1])
    x = np.zeros((len(vectors), size))
    scale = np.abs(vectors).max(axis=1, keepdims=True)  # squares of what is left neither vanish nor overflow
    x[:, : vectors.shape[1]] = vectors / scale
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    signs = np.random.default_rng([_SEED, function, size]).choice([-1.0, 1.0], (3, size))
    for s in signs:
        x = hadamard(x * s)
    return np.concatenate([x[:, :axes], -x[:, :axes]], axis=1)


def functions_of(rows: int, dim: int) -> list[int]:
    """How many axes each function of a table looks at, for ``rows`` vectors of length ``dim``."""
    size, cells, out = padded(dim), rows / CELL_ROWS, []
    while cells > 2 * size:
        cells /= 2 * size
        out.append(size)
    if not out:
        cells /= 2 * size
        out.append(size)
    axes = LEAST_AXES
    while 2 * axes < cells:
        axes *= 2
    return [*out, min(axes, size)]


def cells_of(vectors: np.ndarray, table: int, axes: list[int]) -> np.ndarray:
    code = np.zeros(len(vectors), dtype=np.int64)
    for j, a in enumerate(axes):
        code = code * (2 * a) + rotated(vectors, table * 64 + j, a).argmax(axis=1)
    return code


def probes_of(vectors: np.ndarray, table: int, axes: list[int], probes: float) -> np.ndarray:
    """Each vector's cells with the least sums of squared gaps."""
    wanted = LEAST_PROBES + int(np.ceil(probes * np.sqrt(np.prod([2.0 * a for a in axes]))))
    codes, gaps = np.zeros((len(vectors), 1), dtype=np.int64), np.zeros((len(vectors), 1))
    for j, a in enumerate(axes):
        near = rotated(vectors, table * 64 + j, a)
        gap = (near.max(axis=1, keepdims=True) - near) ** 2
        gaps = (gaps[:, :, None] + gap[:, None, :]).reshape(len(vectors), -1)
        codes = (codes[:, :, None] * (2 * a) + np.arange(2 * a)).reshape(len(vectors), -1)
        if gaps.shape[1] > wanted:  # a sum grows with every function, so what is left out now can't come back
            best = np.argsort(gaps, axis=1, kind="stable")[:, :wanted]
            gaps, codes = np.take_along_axis(gaps, best, axis=1), np.take_along_axis(codes, best, axis=1)
    return codes


def coded(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, scale, distance from the vector) of each vector."""
    scale = np.abs(vectors).max(axis=1) / 127
    scale[scale == 0] = np.finfo(np.float64).tiny
    code = np.rint(vectors / scale[:, None]).astype(np.int8)
    off = vectors - code * scale[:, None]
    top = np.abs(off).max(axis=1)
    top[top == 0] = 1.0
    return code, scale, top * np.sqrt(((off / top[:, None]) ** 2).sum(axis=1))


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding of the vectors that take part; components stay floats or doubles."""
    e = F.col("embedding")
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kind = "array<float>" if dict(vectors.dtypes)["embedding"] == "array<float>" else "array<double>"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), e.cast(kind).alias("embedding"))
    return rows.where("vec_id is not null").where(fine & F.exists(e, lambda x: x != 0))


def _matrices(batches, most: int):
    """(rows, their vectors as doubles) of equal length."""
    for batch in batches:
        for dim, part in batch.groupby(batch["embedding"].map(len)):
            for at in range(0, len(part), most):
                own = part.iloc[at : at + most]
                yield int(dim), own, np.stack(own["embedding"].to_numpy()).astype(np.float64)


def _groups(code: np.ndarray, axes: list[int], rows: int) -> np.ndarray:
    """The group of a cell: those that differ in the last function alone stay together."""
    return code // (2 * axes[-1]) % max(1, rows // GROUP_ROWS)


def _index(counts: dict[int, int], tables: int, whole: bool):
    """A row a vector and table; only its group unless ``whole``."""

    def run(batches):
        import pandas as pd

        for dim, own, vectors in _matrices(batches, 2_000):
            axes, (code, scale, off) = functions_of(counts[dim], dim), coded(vectors)
            for t in range(tables):
                cell = cells_of(vectors, t, axes)
                out = {"dim": dim, "tab": t, "grp": _groups(cell, axes, counts[dim])}
                if whole:
                    out |= {"cell": cell, "rep": own["vec_id"].to_numpy(), "mark": own["mark"].to_numpy(), "single": own["single"].to_numpy()}
                    out |= {"code": [c.tobytes() for c in code], "scale": scale, "off": off}
                yield pd.DataFrame(out)

    return run


def _probes(counts: dict[int, int], tables: int, probes: float):
    """A row a query, table and group: the query's cells there."""

    def run(batches):
        import pandas as pd

        for dim, own, vectors in _matrices(batches, 64):
            if dim not in counts:
                continue
            axes, rows = functions_of(counts[dim], dim), []
            keys, ids, embeddings = (own[c].to_numpy() for c in ("query", "query_id", "embedding"))
            for t in range(tables):
                cells = probes_of(vectors, t, axes, probes)
                groups = _groups(cells, axes, counts[dim])
                for i, (cell, group) in enumerate(zip(cells, groups, strict=True)):
                    order = np.argsort(group, kind="stable")
                    cuts = np.flatnonzero(np.diff(group[order])) + 1
                    rows += [(dim, t, int(group[part[0]]), np.sort(cell[part]), keys[i], ids[i], embeddings[i]) for part in np.split(order, cuts)]
            yield pd.DataFrame(rows, columns=["dim", "tab", "grp", "cells", "query", "query_id", "embedding"])

    return run


def _bounded(k: int):
    """(query, rep, mark, least, most) of the rows that may be among the k nearest classes with another vec_id."""

    def run(key, rows, queries):
        import pandas as pd

        found: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] * 3 + [np.zeros(0)] * 2]
        if len(rows) and len(queries):
            rows = rows.sort_values("cell", kind="stable")
            cell, rep, mark, off, single = (rows[c].to_numpy() for c in ("cell", "rep", "mark", "off", "single"))
            codes = np.frombuffer(b"".join(rows["code"]), dtype=np.int8).reshape(len(rows), -1)
            v = codes * rows["scale"].to_numpy()[:, None]
            for query, query_id, cells, e in zip(*(queries[c] for c in ("query", "query_id", "cells", "embedding")), strict=True):
                own = np.arange(len(v))
                if cells is not None:
                    begin, end = np.searchsorted(cell, cells, "left"), np.searchsorted(cell, cells, "right")
                    number = end - begin
                    own = np.arange(number.sum()) + np.repeat(begin - (np.cumsum(number) - number), number)
                own = own[~(single[own] & (rep[own] == query_id))]
                if not len(own):
                    continue
                gap = v[own] - np.asarray(e, dtype=np.float64)
                with np.errstate(over="ignore"):
                    distance = np.sqrt(np.einsum("ij,ij->i", gap, gap))
                slack = off[own] + distance * 1e-9 + 1e-150  # rounding stays below it
                most = np.where(np.isfinite(distance), distance + slack, np.inf)
                least = np.where(np.isfinite(distance), distance - slack, 0.0)  # of what overflows nothing is known
                near = least <= (np.partition(most, k - 1)[k - 1] if len(most) >= k else np.inf)
                own = own[near]
                found.append([np.full(len(own), query), rep[own], mark[own], least[near], most[near]])
        names = ("query", "rep", "mark", "least", "most")
        return pd.DataFrame({c: np.concatenate(x) for c, x in zip(names, zip(*found, strict=True), strict=True)})

    return run


def _candidates(index: DataFrame, groups: DataFrame, probes: DataFrame, k: int, block: int) -> DataFrame:
    """(query, rep, mark, least, most) out of every group; one with more than ``block`` rows is cut into parts.

    groups: the groups of all index rows, which cost no codes.
    """
    parts = (F.floor(F.count("*") / block) + 1).cast("int").alias("parts")
    hot = materialize(groups.groupBy(*_KEYS).agg(parts).where("parts > 1"), "ann-hot")
    hot = checked_broadcast(hot, hot.count())
    parts = F.coalesce("parts", F.lit(1))
    rows = index.join(hot, list(_KEYS), "left").withColumn("part", F.pmod(F.xxhash64("rep"), parts).cast("int"))
    asked = probes.join(hot, list(_KEYS), "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    left = rows.select(*_KEYS, "part", "cell", "rep", "mark", "single", "code", "scale", "off").groupBy(*_KEYS, "part")
    right = asked.select(*_KEYS, "part", "cells", "query", "query_id", "embedding").groupBy(*_KEYS, "part")
    return left.cogroup(right).applyInPandas(_bounded(k), "query long, rep long, mark long, least double, most double")


def _reranked(found: DataFrame, asked: DataFrame, classes: DataFrame, k: int) -> DataFrame:
    """query, query_id, rank, vec_id, score: the exact order of what the bounds leave."""
    found = found.groupBy("query", "rep", "mark").agg(F.max("least").alias("least"), F.min("most").alias("most"))
    place = F.row_number().over(Window.partitionBy("query").orderBy("most"))
    limit = F.max(F.when(F.col("place") <= k, F.col("most"))).over(Window.partitionBy("query"))
    left = found.withColumn("place", place).withColumn("limit", limit).where("least <= limit").select("query", "rep", "mark")
    vectors = classes.select(F.col("vec_id").alias("rep"), "mark", F.col("embedding").alias("other"), "ids")
    left = left.join(asked, "query").join(vectors, ["rep", "mark"])
    square = lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))
    score = F.sqrt(F.aggregate(F.zip_with("embedding", "other", square), F.lit(0.0), lambda s, x: s + x))
    each = left.select("query", "query_id", score.alias("score"), F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query").orderBy("score", "vec_id"))
    return each.withColumn("rank", rank).where(F.col("rank") <= k).select("query", "query_id", "rank", "vec_id", "score")


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, tables: int = TABLES, probes: float = PROBES, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k nearest among vectors, without its own vec_id."""
    keyed = usable(vectors).withColumn("mark", F.xxhash64("embedding")).withColumn("h", F.hash("embedding"))
    each = keyed.groupBy("mark", "h", "vec_id").agg(F.first("embedding").alias("embedding"), F.least(F.count("*"), F.lit(k)).cast("int").alias("times"))
    first = Window.partitionBy("mark", "h").orderBy("vec_id")
    few = each.withColumn("k", F.row_number().over(first)).where(F.col("k") <= k + 1)
    ids = F.sort_array(F.flatten(F.collect_list(F.array_repeat("vec_id", F.col("times")))))
    classes = few.groupBy("mark", "h").agg(ids.alias("ids"), F.min_by("embedding", "vec_id").alias("embedding"), F.min("vec_id").alias("vec_id"))
    classes = classes.withColumn("single", F.array_max("ids") == F.col("vec_id"))  # all of one vec_id
    classes = materialize(classes.select("vec_id", "mark", "single", "embedding", "ids"), "vectors")
    sizes = classes.groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n"))
    counts = {r["dim"]: r["n"] for r in sizes.collect()}  # a row for each length of vectors
    asked = usable(queries).withColumn("query", F.xxhash64("vec_id", "embedding"))
    asked = materialize(asked.dropDuplicates(["query"]).select("query", F.col("vec_id").alias("query_id"), "embedding"), "queries")
    if not counts:
        return asked.select("query_id", F.lit(0).alias("rank"), F.col("query_id").alias("vec_id"), F.lit(0.0).alias("score")).where("false")
    kind = dict(classes.dtypes)["embedding"]
    schema = "dim int, tab int, grp long, cell long, rep long, mark long, single boolean, code binary, scale double, off double"
    index = classes.select("vec_id", "mark", "single", "embedding").mapInPandas(_index(counts, tables, True), schema)
    groups = classes.select("vec_id", "mark", "single", "embedding").mapInPandas(_index(counts, tables, False), "dim int, tab int, grp long")
    probed = asked.mapInPandas(_probes(counts, tables, probes), f"dim int, tab int, grp long, cells array<long>, query long, query_id long, embedding {kind}")
    found = materialize(_candidates(index, groups, probed, k, block), "ann-bounds")
    near = materialize(_reranked(found, asked, classes, k), "ann-found")
    short = near.groupBy("query").agg(F.count("*").alias("n"))
    short = materialize(asked.join(short, "query", "left").where(F.coalesce("n", F.lit(0)) < k).select(*asked.columns), "ann-short")
    columns = ("query_id", "rank", "vec_id", "score")
    if not short.count():
        return near.select(*columns)
    # one group a length: its parts hold about ``block`` rows
    everywhere = {"tab": F.lit(-1), "grp": F.lit(0).cast("long")}
    whole = classes.select("vec_id", "mark", "single", "embedding").mapInPandas(_index(counts, 1, True), schema).withColumns(everywhere)
    wanted = short.withColumns({"dim": F.size("embedding"), **everywhere, "cells": F.lit(None).cast("array<long>")})
    rest = _candidates(whole, whole.select(*_KEYS), wanted, k, block)
    rest = materialize(_reranked(rest, short, classes, k), "ann-rest")
    return near.join(short.select("query"), "query", "left_anti").select(*columns).unionByName(rest.select(*columns))
