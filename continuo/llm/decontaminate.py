"""Benchmark decontamination by a positional inverted index, with DataFrame operations only.

The index is a table of postings (term, document, position) of every word of all documents that
occurs in the benchmark, written in document order without a shuffle, and one closing entry per
document with its number of words. Corpus frequencies of terms come from it. A benchmark window is
looked up from its two rarest terms: their lists, moved by the terms' offsets, meet in (document,
item, diagonal) groups, which only alignments with both terms survive. Survivors are then intersected
with the lists of all the item's terms; runs of consecutive matches as long as a window are
occurrences. Terms the corpus lacks rule their windows out at once.

Words: A-Z lower-cased, then ASCII digits, letters and everything beyond ASCII. A window is
``window`` consecutive words of an item; a shorter item, but not an empty one, is one window. Null
texts have no words. Rows are keyed by doc_id and a hash of the text, so repeated rows (null doc_ids too) get
equal results; items of one item_id count once. Very long texts are rows of postings like any other; words of
equal frequency are ordered by place. Empty tables are fine; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from continuo.llm.common import checked_broadcast, materialize, text_of

WINDOW = 10
#: Rows of terms, seeds, item words or document keys that are broadcast at most; beyond it joins shuffle, and the
#: runtime splits common terms.
BROADCAST_ROWS = 200_000
#: Positions of a block in which places of different items meet the words beside them.
BLOCK = 64
_SPLIT = r"[^0-9A-Za-z\x{80}-\x{10FFFF}]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The closing entry's word; no text has it.
_CLOSE = "\n"


def lower_ascii(word: Column) -> Column:
    return F.when(F.octet_length(word) == F.char_length(word), F.lower(word)).otherwise(F.translate(word, _UPPER, _LOWER))


def words_with_positions(rows: DataFrame, *keep: str) -> DataFrame:
    """``keep``, pos, term, n_words: one row per word and a closing row (term newline, pos n_words)."""
    cut = rows.select(*keep, F.split(text_of(), _SPLIT, -1).alias("w"))
    lead = (F.element_at("w", 1) == "").cast("int")
    trail = ((F.size("w") > 1) & (F.element_at("w", -1) == "")).cast("int")
    cut = cut.select(*keep, lead.alias("lead"), (F.size("w") - lead - trail).alias("n_words"), F.concat("w", F.array(F.lit(_CLOSE))).alias("w"))
    out = cut.select(*keep, "lead", "n_words", F.posexplode("w").alias("at", "word")).where("word <> ''")
    return out.select(*keep, F.when(F.col("word") == _CLOSE, F.col("n_words")).otherwise(F.col("at") - F.col("lead")).alias("pos"), lower_ascii(F.col("word")).alias("term"), "n_words")


def document_key(doc_id: Column, text: Column) -> Column:
    """Names a row by its doc_id and text; never null."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    return F.concat_ws(":", doc_id.cast("long").cast("string"), F.hex(F.xxhash64(text)))


class PositionalIndex:
    """Postings of the benchmark's terms in all documents, and the benchmark's items."""

    def __init__(self, docs: DataFrame, items: DataFrame, window: int = WINDOW):
        self.window = window
        items = items.select("item_id", text_of().alias("text")).withColumn("item", F.xxhash64("item_id", "text"))
        words = words_with_positions(items, "item_id", "item").where(F.col("term") != _CLOSE).distinct()
        self.items = materialize(words.select("item_id", "item", F.col("pos").alias("offset"), "term", "n_words"), "item-words")
        self.n_item_words = self.items.count()
        closing = self.items.sparkSession.createDataFrame([(_CLOSE,)], "term string")
        terms = self.items.select("term").unionByName(closing).distinct()
        docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).withColumn("doc", document_key(F.col("doc_id"), F.col("text")))
        found = words_with_positions(docs, "doc_id", "doc").join(checked_broadcast(terms, self.n_item_words, BROADCAST_ROWS), "term")
        found = found.select("term", "doc_id", "doc", "pos", F.when(F.col("term") == _CLOSE, F.col("n_words")).alias("n_words"))
        self.postings = materialize(found, "postings")

    def documents(self) -> DataFrame:
        return self.postings.where(F.col("term") == _CLOSE).select("doc_id", "doc", F.col("n_words").cast("long").alias("n_words"))

    def small(self, df: DataFrame) -> DataFrame:
        return checked_broadcast(df, self.n_item_words, BROADCAST_ROWS)

    def seeds(self) -> DataFrame:
        """(item, offset, term, need): the two rarest terms of every window whose terms all occur."""
        frequency = self.postings.groupBy("term").agg(F.count("*").alias("frequency"))
        words = self.items.join(self.small(frequency), "term", "left").withColumn("frequency", F.coalesce("frequency", F.lit(0)))
        lists = words.groupBy("item").agg(F.array_sort(F.collect_list(F.struct("offset", "frequency", "term"))).alias("words"))
        starts = F.explode(F.sequence(F.lit(0), F.greatest(F.size("words") - self.window, F.lit(0)))).alias("start")
        cut = lists.select("item", "words", starts).select("item", F.slice("words", F.col("start") + 1, self.window).alias("words"))
        cut = cut.where(F.forall("words", lambda x: x["frequency"] > 0))
        rare = F.array_sort(F.transform("words", lambda x: F.struct(x["frequency"].alias("f"), x["offset"].alias("offset"), x["term"].alias("term"))))
        cut = cut.select("item", F.least(F.size("words"), F.lit(2)).alias("need"), F.explode(F.slice(rare, 1, 2)).alias("s"))
        return cut.select("item", "need", F.col("s.offset").alias("offset"), F.col("s.term").alias("term")).distinct()

    def alignments(self) -> DataFrame:
        """(doc, item, diagonal) where lists of rare terms, moved by their offsets, meet."""
        seeds = materialize(self.seeds(), "seeds")
        hits = self.postings.join(checked_broadcast(seeds, seeds.count(), BROADCAST_ROWS), "term")
        hits = hits.select("doc", "item", "need", "offset", (F.col("pos") - F.col("offset")).alias("diagonal"))
        met = hits.groupBy("doc", "item", "diagonal").agg(F.min("offset").alias("a"), F.max("offset").alias("b"), F.min("need").alias("need"))
        return materialize(met.where("a < b or need = 1").select("doc", "item", "diagonal"), "alignments")

    def phrases(self) -> DataFrame:
        """(doc, item_id, start, length): maximal runs of a document's words that equal an item's, of a window at least."""
        met = self.alignments()
        expected = met.join(self.small(self.items), "item").withColumn("pos", F.col("diagonal") + F.col("offset"))
        docs = met.select("doc").distinct()
        lists = self.postings.join(checked_broadcast(docs, met.count(), BROADCAST_ROWS), "doc", "left_semi").select("doc", "pos", "term")
        matched = expected.join(lists, ["doc", "pos", "term"], "left_semi")
        order = Window.partitionBy("doc", "item", "diagonal").orderBy("offset")
        runs = matched.withColumn("run", F.col("offset") - F.row_number().over(order))
        runs = runs.groupBy("doc", "item", "item_id", "diagonal", "run").agg(F.min("pos").alias("start"), F.count("*").alias("length"), F.min("n_words").alias("item_words"))
        return runs.where(F.col("length") >= F.least(F.lit(self.window), F.col("item_words"))).select("doc", "item_id", "start", "length")

    def proximity(self, slop: int) -> DataFrame:
        """(doc_id, item_id, pos): places of an item's rarest term with all its terms within its length plus ``slop``.

        Positions fall into stretches of that length, so a place needs its own stretch and the two beside it: of each
        term there only the first and last position are kept, however often it is repeated. Only places with the item's
        second rarest term in reach meet the others, so a common term is met near those places and not wherever it
        stands. A repeated place of equal rows is one.
        """
        frequency = self.postings.groupBy("term").agg(F.count("*").alias("frequency"))
        reach = (F.col("n_words") + slop).alias("reach")
        terms = self.items.select("item", "item_id", reach, "term").distinct()
        lists = terms.join(self.small(frequency), "term", "left").groupBy("item", "item_id", "reach")
        lists = lists.agg(F.array_sort(F.collect_list(F.struct(F.coalesce("frequency", F.lit(0)).alias("f"), "term"))).alias("terms")).where(F.col("terms")[0]["f"] > 0)
        rare = F.explode(F.slice("terms", 1, 2)["term"]).alias("term")
        seeds = materialize(lists.select("item", "item_id", "reach", F.size("terms").alias("distinct"), F.col("terms")[0]["term"].alias("rare"), rare), "near-seeds")
        places = self.postings.join(checked_broadcast(seeds, seeds.count(), BROADCAST_ROWS), "term")
        places = places.withColumn("stretch", F.floor(F.col("pos") / (F.col("reach") + 1)))
        at = places.where("term = rare").select("doc", "doc_id", "item", "item_id", "reach", "distinct", F.col("pos").alias("at"), "stretch").distinct()
        second = places.where("term <> rare").groupBy("doc", "item", "stretch").agg(F.min("pos").alias("first"), F.max("pos").alias("last"))
        met = materialize(at.where("distinct = 1").unionByName(self._near(at.where("distinct > 1"), second).select(*at.columns).distinct()), "near-places")
        found = self._near(met, self._ends(met, terms)).groupBy("doc", "doc_id", "item", "item_id", "at", "distinct").agg(F.countDistinct("term").alias("terms"))
        return found.where("terms = distinct").select("doc_id", "item_id", F.col("at").alias("pos"))

    @staticmethod
    def _near(at: DataFrame, ends: DataFrame) -> DataFrame:
        """Places beside the ends of a stretch that are in reach."""
        beside = at.withColumn("stretch", F.explode(F.array(*[F.col("stretch") + k for k in (-1, 0, 1)])))
        return beside.join(ends, ["doc", "item", "stretch"]).where("first <= at + reach and last >= at - reach")

    def _ends(self, met: DataFrame, terms: DataFrame) -> DataFrame:
        """(doc, item, stretch, term, first, last) of an item's terms in the stretches around places that are met.

        Items have stretches of different lengths, so both sides are cut into blocks of one length.
        """
        around = met.select("doc", "item", "reach", F.explode(F.array(*[F.col("stretch") + k for k in (-1, 0, 1)])).alias("stretch")).where("stretch >= 0").distinct()
        low, high = F.col("stretch") * (F.col("reach") + 1), (F.col("stretch") + 1) * (F.col("reach") + 1) - 1
        block = F.explode(F.sequence(F.floor(low / BLOCK), F.floor(high / BLOCK))).alias("block")
        around = around.select("doc", "item", "stretch", low.alias("low"), high.alias("high"), block)
        docs = materialize(met.select("doc").distinct(), "near-documents")
        n = docs.count()
        words = self.postings.select("doc", "pos", "term")
        words = words.join(F.broadcast(docs), "doc", "left_semi") if n <= BROADCAST_ROWS else words
        words = words.withColumn("block", F.floor(F.col("pos") / BLOCK)).join(around, ["doc", "block"]).where("pos between low and high")
        return words.join(self.small(terms.select("item", "term")), ["item", "term"]).groupBy("doc", "item", "stretch", "term").agg(F.min("pos").alias("first"), F.max("pos").alias("last"))

    def hits(self) -> DataFrame:
        """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every document, and its key ``doc``."""
        places = self.phrases().select("doc", "item_id", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("length") - 1)).alias("pos"))
        hit = places.groupBy("doc").agg(F.countDistinct("pos").alias("n_hit"), F.collect_set(F.col("item_id").cast("string")).alias("items"))
        out = self.documents().join(hit, "doc", "left")
        items = F.coalesce("items", F.array().cast("array<string>"))
        n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
        return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.concat_ws(",", F.array_sort(items)).cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), "doc")
