"""Ranked lexical search over an impact-ordered index, score at a time.

Documents are dealt into segments of ``SEGMENT_DOCS`` as they are read. A posting's impact is the exact integer that it
adds to a score; a segment's postings are grouped by term and impact, so a group is a list of places and no group is
larger than a segment, however many copies a text has. The index is a table; a search reads the asked terms' rows.

Within a segment a query's groups are processed by descending impact over all its terms. What a term can still add is
the impact of its next group, so the sum of those bounds every document not yet complete. Once the k-th best sum so
far exceeds that bound, no unseen document can enter; documents whose sum and bound reach the k-th best are completed
from their own postings, and the best k go to a merge over all segments.

Terms are maximal runs of ASCII digits and letters and everything beyond ASCII, A-Z lower-cased. Null and empty texts
have no terms and are not counted. Every row is a document of its own: repeated rows have a rank each, null doc_ids
come last among equal scores, then rows in the order of their places. Rows of one item_id (null is an item_id too) are one
item with the terms of all. Very long texts count whole. Empty tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from continuo.llm.common import checked_broadcast, materialize, text_of, unbatched

TOP_K = 10
#: Documents of a segment; part of the index.
SEGMENT_DOCS = 4_096
#: Terms of items that one pass takes (they are broadcast); more items are searched in further passes.
PASS_TERMS = 200_000
#: Postings that are processed before the bound is first looked at; then twice as many each time.
FIRST_STEP = 1_024
#: Bytes that are no part of a term become spaces, A-Z become a-z.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
COUNTED = "segment long, slot int, doc_id long, n long, terms array<string>, tfs array<int>"
FOUND = "item int, segment long, slot int, score long"


def terms_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split()


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term), each once."""

    def cut(batches):
        import pyarrow as pa

        for batch in unbatched(batches):
            rows = [(k, t.decode()) for k, text in zip(batch["item_id"].to_pylist(), batch["text"].to_pylist(), strict=True) for t in set(terms_of(text))]
            ids, terms = zip(*rows, strict=True) if rows else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field("item_id").type), pa.array(terms, pa.string())], ["item_id", "term"])

    rows = items.select("item_id", text_of().alias("text"))
    return rows.mapInArrow(cut, f"item_id {rows.schema['item_id'].dataType.simpleString()}, term string").distinct()


class ImpactIndex:
    """The index of ``docs`` over ``vocabulary`` (a column ``term``); None indexes every term."""

    def __init__(self, docs: DataFrame, vocabulary: DataFrame | None = None, segment_docs: int = SEGMENT_DOCS):
        self.spark, self.segment_docs = docs.sparkSession, segment_docs
        self.counts = materialize(self._counted(docs, vocabulary), "impact-counts")
        sums = self.counts.agg(F.count("*").alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("l")).first()
        self.n_docs, self.n_terms = sums["n"], sums["l"]
        frequency = self.counts.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
        ratio = (F.lit(2.0) * self.n_docs + 2) / (F.lit(2.0) * F.col("df") + 1)
        self.weights = materialize(frequency.select("term", F.floor(F.lit(1000.0) * F.ln(ratio)).cast("long").alias("w")), "impact-weights")
        self.groups = materialize(self._grouped(), "impact-groups")

    def _counted(self, docs: DataFrame, vocabulary: DataFrame | None) -> DataFrame:
        """A row a document with terms: its length and the counts of its indexed terms."""
        size, known = self.segment_docs, None
        if vocabulary is not None and vocabulary.count() <= PASS_TERMS:
            known = self.spark.sparkContext.broadcast({r["term"].encode() for r in vocabulary.select("term").distinct().collect()})

        def count(batches):
            from collections import Counter

            import pyarrow as pa
            from pyspark import TaskContext

            wanted = None if known is None else known.value
            segment, waiting = TaskContext.get().partitionId() << 36, []

            def full():
                waiting.sort(key=lambda d: (d[0] is None, d[0] or 0))  # so places order documents
                columns = [pa.array([segment] * len(waiting), pa.int64()), pa.array(range(len(waiting)), pa.int32()), pa.array([d[0] for d in waiting], pa.int64())]
                columns += [pa.array([d[1] for d in waiting], pa.int64())]
                columns += [pa.array([d[k] for d in waiting], pa.list_(t)) for k, t in ((2, pa.string()), (3, pa.int32()))]
                return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in COUNTED.split(", ")])

            for batch in unbatched(batches):
                for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                    words = terms_of(text)
                    if not words:
                        continue
                    tf = Counter(words if wanted is None else [w for w in words if w in wanted])
                    waiting.append((doc_id, len(words), [t.decode() for t in tf], list(tf.values())))
                    if len(waiting) == size:
                        yield full()
                        segment, waiting = segment + 1, []
            if waiting:
                yield full()

        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
        return rows.mapInArrow(count, COUNTED)

    def _grouped(self) -> DataFrame:
        """(segment, term, impact, slots): postings by exact impact."""
        m = F.lit(10) + F.expr(f"(90L * n * {self.n_docs}L) div {max(1, self.n_terms)}L")
        entry = F.explode(F.arrays_zip("terms", "tfs")).alias("e")
        postings = self.counts.select("segment", "slot", m.alias("m"), entry)
        postings = postings.select("segment", "slot", "m", F.col("e.terms").alias("term"), F.col("e.tfs").cast("long").alias("tf"))
        postings = postings.join(checked_broadcast(self.weights, self.weights.count(), PASS_TERMS), "term")
        impact = F.expr("w * ((1000000000L * tf) div (1000L * tf + 8L * m))")
        postings = postings.select("segment", "term", impact.alias("impact"), "slot").where("impact > 0").repartition("segment")
        return postings.groupBy("segment", "term", "impact").agg(F.collect_list("slot").alias("slots")).sortWithinPartitions("segment", F.desc("impact"))

    def search(self, queries: DataFrame, k: int = TOP_K) -> DataFrame:
        """item_id, rank, doc_id, score: the best ``k`` documents of each item of (item_id, term)."""
        queries = materialize(queries.select("item_id", "term").distinct(), "impact-queries")
        number = Window.orderBy("item_id")  # over item_ids alone, as many as the benchmark has
        items = queries.groupBy("item_id").agg(F.count("*").alias("n_terms"))
        items = items.withColumn("item", F.row_number().over(number)).withColumn("upto", F.sum("n_terms").over(number))
        items = materialize(items, "impact-items")
        numbered = queries.join(checked_broadcast(items.withColumnRenamed("item_id", "id"), items.count()), F.col("item_id").eqNullSafe(F.col("id")))
        passes = (items.agg(F.max("upto")).first()[0] or 0) // PASS_TERMS + 1
        found = None
        for at in range(passes):
            own = numbered.where(F.floor(F.col("upto") / PASS_TERMS) == at)
            part = self._searched(own, k)
            found = part if found is None else found.unionByName(part)
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last(), "segment", "slot")
        places = found.join(self.counts.select("segment", "slot", "doc_id"), ["segment", "slot"])
        best = places.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        best = best.join(checked_broadcast(items.select("item", "item_id"), items.count()), "item")
        return best.select("item_id", "rank", "doc_id", "score")

    def _searched(self, queries: DataFrame, k: int) -> DataFrame:
        """(item, segment, slot, score): the best ``k`` of every segment."""
        asked: dict[int, list[str]] = {}
        for r in queries.select("item", "term").collect():  # about PASS_TERMS at most
            asked.setdefault(r["item"], []).append(r["term"])
        known = self.spark.sparkContext.broadcast(asked)
        terms = queries.select("term").distinct()
        wanted = self.groups.join(checked_broadcast(terms, sum(map(len, asked.values())), 2 * PASS_TERMS), "term", "left_semi")

        def searched(table):
            import pyarrow as pa

            segment = table["segment"][0].as_py() if table.num_rows else 0
            rows = Segment(table).best(known.value, k)
            columns = list(zip(*rows, strict=True)) or [(), (), ()]
            item, slot, score = (pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int64()), strict=True))
            return pa.table([item, pa.array([segment] * len(rows), pa.int64()), slot, score], names=["item", "segment", "slot", "score"])

        return wanted.groupBy("segment").applyInArrow(searched, FOUND)


class Segment:
    """A segment's groups by descending impact, and each document's own postings."""

    def __init__(self, table):
        impacts = table["impact"].to_numpy()
        order = np.argsort(-impacts, kind="stable")
        self.impact = impacts[order]
        terms = table["term"].combine_chunks().dictionary_encode().take(order)
        self.term = terms.indices.to_numpy()
        self.number = {t: k for k, t in enumerate(terms.dictionary.to_pylist())}
        slots = table["slots"].combine_chunks().take(order)
        self.slot = slots.flatten().to_numpy()
        sizes = np.diff(slots.offsets.to_numpy())
        self.begin = np.concatenate([[0], np.cumsum(sizes)])
        self.of_term = np.split(np.argsort(self.term, kind="stable"), np.cumsum(np.bincount(self.term, minlength=len(self.number)))[:-1])
        self.n = int(self.slot.max()) + 1 if len(self.slot) else 0
        group = np.repeat(np.arange(len(self.impact)), sizes)
        own = np.argsort(self.slot, kind="stable")
        self.doc_begin = np.concatenate([[0], np.cumsum(np.bincount(self.slot, minlength=self.n))])
        self.doc_term, self.doc_impact = self.term[group[own]], self.impact[group[own]]

    def best(self, items: dict[int, list[str]], k: int):
        """(item, slot, score) of the best ``k`` of every item."""
        out = []
        for item, words in items.items():
            terms = [self.number[t] for t in words if t in self.number]
            if terms:
                out += [(item, slot, score) for slot, score in self._one(np.array(terms), k)]
        return out

    def _one(self, terms: np.ndarray, k: int):
        lists = [self.of_term[t] for t in terms]
        groups = np.sort(np.concatenate(lists))  # by descending impact over all terms
        sizes = self.begin[groups + 1] - self.begin[groups]
        upto = np.cumsum(sizes)
        sums, done, step = np.zeros(self.n, dtype=np.int64), 0, FIRST_STEP
        least, bound = 0, 0
        while done < len(groups):
            to = max(done + 1, int(np.searchsorted(upto, (upto[done - 1] if done else 0) + step, "right")))
            now = groups[done:to]
            places = _ranges(self.begin[now], sizes[done:to])
            np.add.at(sums, self.slot[places], np.repeat(self.impact[now], sizes[done:to]))
            done, step = to, 2 * step
            least = int(np.partition(sums, -k)[-k]) if self.n > k else 0
            if done < len(groups):
                bound = sum(int(self.impact[x[at]]) for x in lists if (at := np.searchsorted(x, groups[done])) < len(x))
            else:
                bound = 0
            if least > bound:
                break
        candidates = np.flatnonzero((sums > 0) & (sums + bound >= least))
        return self._complete(candidates, terms, k)

    def _complete(self, candidates: np.ndarray, terms: np.ndarray, k: int):
        """Whole scores from the candidates' own postings; ties go by place."""
        sizes = self.doc_begin[candidates + 1] - self.doc_begin[candidates]
        places = _ranges(self.doc_begin[candidates], sizes)
        asked = np.zeros(len(self.number), dtype=bool)
        asked[terms] = True
        impacts = np.where(asked[self.doc_term[places]], self.doc_impact[places], 0)
        scores = np.add.reduceat(impacts, np.cumsum(sizes) - sizes) if len(candidates) else impacts
        order = np.lexsort((candidates, -scores))[:k]
        return zip(candidates[order].tolist(), scores[order].tolist(), strict=True)


def _ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... for size[0] numbers, then the same from begin[1] on, and so on."""
    return np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def search(docs: DataFrame, items: DataFrame, k: int = TOP_K, segment_docs: int = SEGMENT_DOCS) -> DataFrame:
    """The best ``k`` documents of every item."""
    queries = materialize(item_terms(items), "impact-terms")
    return ImpactIndex(docs, queries.select("term").distinct(), segment_docs).search(queries, k)
