"""Exact substring dedup by seed and extend.

Seed: among the grams of every window the one with the least hash is its anchor (winnowing), so
equal windows of any documents have equal anchors at equal places. Consecutive windows with one
anchor are one occurrence; it carries the hash of its whole context, all words that its windows
touch. Occurrences meet by anchor. Extend: occurrences whose contexts agree repeat as a whole, and
all but those of the smallest document are covered at once. Only where one anchor has several
contexts, that is at the ends of repeats, are the single windows of each context's first document
hashed and compared, which finds how far each match reaches on both sides. The union of covered
windows gives the maximal repeats of at least ``window`` words.

No pairs are formed: each group is reduced to its smallest doc_id by a partial aggregate and joined
back. Documents are keyed by doc_id and text, so repeated rows get the same result; equal doc_ids
are never sources for each other, null doc_ids are neither sources nor cut. Null and short texts
have no windows. Empty tables give no rows. Other columns pass through, but for one that has the name of a
column that is added, which gives way.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from continuo.llm.common import BROADCAST_KEYS, materialize, unbatched
from continuo.llm.hashing import Words, mix

WINDOW, GRAM = 50, 10
#: The columns that the result adds.
ADDED = {"__n_words": T.LongType(), "__n_removed": T.LongType(), "__kept_sha256": T.StringType()}
_SEGMENT, _POSITION = 1 << 22, np.uint64((1 << 24) - 1)
_OCCURRENCES = "anchor long, context long, doc_id long, text_key long, lo int, n int, at int"


def find_anchors(words: Words, window: int = WINDOW, gram: int = GRAM):
    """(document, lo, n, at, anchor hash, context hash) of each run of windows with one anchor; lo counts from the document's start."""
    total = len(words.hashes)
    if total < window:
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(4)) + tuple(np.zeros(0, dtype=np.uint64) for _ in range(2))
    document, span, parts = words.document(), window - gram + 1, []
    for begin in range(0, total - window + 1, _SEGMENT):
        windows = min(_SEGMENT, total - window + 1 - begin)
        grams = words.spans(np.arange(begin, begin + windows + span - 1), gram)
        least = (grams & ~_POSITION) | np.arange(len(grams), dtype=np.uint64)
        width = 1
        while 2 * width <= span:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        least = np.minimum(least[:windows], least[span - width : span - width + windows])
        place = (least & _POSITION).astype(np.int64)
        start = np.arange(begin, begin + windows)
        valid = document[start] == document[start + window - 1]
        first = valid.copy()
        first[1:] &= ~valid[:-1] | (place[1:] != place[:-1])
        heads = np.flatnonzero(first)
        runs = np.cumsum(first)[valid]
        n = np.bincount(runs, minlength=len(heads) + 1)[1:] if len(heads) else np.zeros(0, dtype=np.int64)
        lo, at = start[heads], place[heads] + begin - start[heads]
        anchor = grams[place[heads]]
        context = mix(words.spans(lo, n + window - 1) + at.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        parts.append((document[lo], lo - words.first[document[lo]], n, at, anchor, context))
    return tuple(np.concatenate(c) for c in zip(*parts, strict=True))


def _occurrences(window: int, gram: int):
    def run(batches):
        import pyarrow as pa

        for batch in unbatched(batches):
            words = Words(batch["text"])
            document, lo, n, at, anchor, context = find_anchors(words, window, gram)
            take = pa.array(document)
            columns = [pa.array(anchor.view(np.int64)), pa.array(context.view(np.int64)), batch["doc_id"].take(take), batch["__text_key"].take(take), *(pa.array(c.astype(np.int32)) for c in (lo, n, at))]
            yield pa.RecordBatch.from_arrays(columns, ["anchor", "context", "doc_id", "text_key", "lo", "n", "at"])

    return run


def _windows(window: int):
    """Every window of the runs in column ``__runs``."""

    def run(batches):
        import pyarrow as pa

        for batch in unbatched(batches, 1 << 18):
            words, runs = Words(batch["text"]), batch["__runs"]
            flat, offsets = runs.flatten(), np.asarray(runs.offsets) - runs.offsets[0].as_py()
            lo, n, at, anchor = (np.asarray(flat.field(k)) for k in range(4))
            document = np.repeat(np.arange(len(runs)), np.diff(offsets))
            total = int(n.sum())
            step = np.arange(total) - np.repeat(np.cumsum(n) - n, n)
            start = np.repeat(lo, n) + step
            hashes = words.spans(np.repeat(words.first[document], n) + start, window)
            take = pa.array(np.repeat(document, n))
            columns = [pa.array(np.repeat(anchor, n)), pa.array((np.repeat(at, n) - step).astype(np.int32)), pa.array(hashes.view(np.int64)), batch["doc_id"].take(take), batch["__text_key"].take(take), pa.array(start.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, ["anchor", "place", "hash", "doc_id", "text_key", "lo"])

    return run


def covered_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, text_key, lo, n): words lo to lo + n - 1 repeat a document with a smaller doc_id. docs: doc_id, __text_key, text."""
    found = materialize(docs.mapInArrow(_occurrences(window, gram), _OCCURRENCES), "anchors")
    shared = found.groupBy("anchor").agg(F.count("*").alias("times"), F.min("context").alias("a"), F.max("context").alias("b")).where("times > 1")
    # written first, so that the joins back deal both sides anew and the runtime can split hot anchors
    shared = materialize(shared.select("anchor", (F.col("a") != F.col("b")).alias("several")), "shared-anchors")
    repeated = materialize(found.join(shared, "anchor"), "repeated-anchors")
    first = materialize(repeated.groupBy("anchor", "context").agg(F.min("doc_id").alias("first")), "first-contexts")
    placed = materialize(repeated.join(first, ["anchor", "context"]).where("doc_id > first or (several and doc_id = first)"), "placed-anchors")
    whole = placed.where("doc_id > first").select("doc_id", "text_key", "lo", (F.col("n") + (window - 1)).alias("n"))
    runs = placed.where("doc_id = first").groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("lo", "n", "at", "anchor")).alias("__runs"))
    runs = materialize(runs.withColumnRenamed("text_key", "__text_key"), "end-runs")
    ends = only(docs, runs).join(runs, ["doc_id", "__text_key"]).select("doc_id", "__text_key", "text", "__runs")
    single = materialize(ends.mapInArrow(_windows(window), "anchor long, place int, hash long, doc_id long, text_key long, lo int"), "end-windows")
    keys = ["anchor", "place", "hash"]
    least = single.groupBy(*keys).agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    least = materialize(least.select(*keys, "first"), "first-windows")
    parts = single.join(least, keys).where("doc_id > first").select("doc_id", "text_key", "lo", F.lit(window).alias("n"))
    return whole.unionByName(parts)


def only(docs: DataFrame, keys: DataFrame, keep: bool = True) -> DataFrame:
    """The documents with (or without) a key among ``keys``; filtered before any shuffle where the keys are few."""
    on = ["doc_id", "__text_key"]
    few = keys.select(*on).distinct()
    if is_small(keys):
        few = F.broadcast(few)
    return docs.join(few, on, "left_semi" if keep else "left_anti")


def is_small(keys: DataFrame) -> bool:
    return keys.count() <= BROADCAST_KEYS


def cut_words(words: Words, document: np.ndarray, lo: np.ndarray, n: np.ndarray):
    """(removed words, kept bytes, their offsets) by document, without the words of the given spans."""
    edge = np.zeros(len(words.hashes) + 1, dtype=np.int64)
    begin = words.first[document] + lo
    np.add.at(edge, begin, 1)
    np.add.at(edge, begin + n, -1)
    kept = np.cumsum(edge)[:-1] <= 0
    before = np.concatenate([[0], np.cumsum(kept)])
    removed = words.counts - np.diff(before[words.first])
    place = np.flatnonzero(kept)
    of = words.document()[place]
    inner = np.ones(len(place), dtype=bool)  # followed by another kept word of its document
    inner[:-1] = of[1:] == of[:-1]
    inner[-1:] = False
    data, take = words.data.copy(), np.zeros(len(words.data) + 1, dtype=np.int8)
    data[words.ends[place[inner]]] = 0x20
    take[words.starts[place]] += 1
    np.add.at(take, words.ends[place] + inner, -1)
    mask = np.cumsum(take[:-1], dtype=np.int8) > 0
    return removed, data[mask], np.concatenate([[0], np.cumsum(mask)])[words.offsets]


def _cut(names: list[str]):
    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in unbatched(batches):
            words, spans = Words(batch["text"]), batch["__spans"]
            offsets = np.asarray(spans.offsets)
            sizes = np.where(np.asarray(spans.is_valid()), np.diff(offsets), 0)
            flat = spans.flatten()
            document = np.repeat(np.arange(len(spans)), sizes)
            removed, data, at = cut_words(words, document, np.asarray(flat.field(0)), np.asarray(flat.field(1)))
            view = memoryview(np.ascontiguousarray(data))
            hashes = [hashlib.sha256(view[a:b]).hexdigest() for a, b in zip(at[:-1], at[1:], strict=True)]
            text = pa.StringArray.from_buffers(len(spans), pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data))
            text = pc.if_else(pa.array(removed > 0), text, batch["text"])
            numbers = (pa.array(x.astype(np.int64)) for x in (words.counts, removed))
            own = {"text": text, **dict(zip(ADDED, (*numbers, pa.array(hashes)), strict=True))}
            yield pa.RecordBatch.from_arrays([own.get(c, batch[c] if c in batch.schema.names else None) for c in names], names)

    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """docs with ``text`` cut (kept words joined by one space; unchanged where nothing goes), __n_words, __n_removed, __kept_sha256."""
    typed = docs.drop(*ADDED, "__text_key", "__spans").withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("text", F.col("text").cast("string"))
    on = ["doc_id", "__text_key"]
    keyed = typed.withColumn("__text_key", F.xxhash64("text"))
    spans = covered_spans(keyed.select(*on, "text"), window, gram)
    spans = spans.groupBy("doc_id", F.col("text_key").alias("__text_key")).agg(F.collect_list(F.struct("lo", "n")).alias("__spans"))
    spans = materialize(spans, "covered-spans")
    names = [*typed.columns, "__spans"]
    if is_small(spans):  # only the texts that lose words are shuffled
        touched = only(keyed, spans).join(spans, on, "left").select(*names)
        rest = only(keyed, spans, keep=False).withColumn("__spans", F.lit(None).cast("array<struct<lo:int,n:int>>"))
        both = touched.unionByName(rest.select(*names))
    else:  # all texts once
        both = keyed.join(spans, on, "left").select(*names)
    schema = T.StructType([*typed.schema.fields, *(T.StructField(n, t) for n, t in ADDED.items())])
    return both.mapInArrow(_cut([f.name for f in schema.fields]), schema)
