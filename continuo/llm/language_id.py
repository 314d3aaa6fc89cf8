"""Language identification by Bayesian evidence fusion.

Evidence: character trigrams of the whole text, the declared markup language, the address suffix
and a prior of the host. The trigram model is fitted on a bounded sample of distinct texts with a declared
language (``SAMPLE`` per language, of at most ``SAMPLE_CHARS`` characters; for the ``LANGUAGES`` most
frequent ones, more than ISO 639-1 knows, so that the model stays below 256 MB). All other tables are counted over all rows by grouped aggregation: what hosts,
suffixes and declarations go with which text language. Host priors are smoothed by their suffix's,
those by the global one (Dirichlet). Trigrams depend on each other, so a text counts as ``EFFECTIVE``
trigrams at most.

A row is rejected (``kept`` false) if its text has fewer than ``LETTERS`` letters, null texts
included, if it is ``UNKNOWN``, or if no language has a posterior of ``CONFIDENT``. Posteriors compare
the modelled languages only, so a text is unknown if under ``LETTER_SHARE`` of its bytes are letters
or if it is too unlikely in every language: below the floor of log likelihood a trigram that held-out
texts of the language set (the median of what each half of the sample is worth to the other, less ``SPREADS`` of
their spreads, less ``SHORT`` / sqrt(trigrams)). Texts of the sample that this floor rejects teach nothing.
The text alone decides this; a declaration or host makes no text known. Null declarations, suffixes and hosts
are no evidence. Repeated rows are judged alike; of languages with equal posteriors the first in the alphabet
counts. Without any declared language there are no posteriors, and the rules on letters alone reject.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from continuo.llm.common import checked_broadcast, materialize, unbatched

LANGUAGES, SAMPLE, SAMPLE_CHARS, EFFECTIVE, LETTERS, CONFIDENT, STRENGTH = 256, 300, 8_000, 300, 3, 0.5, 10.0
LEAST_CHARS = 20
UNKNOWN, LETTER_SHARE, SPREADS, LEAST_SPREAD, SHORT = "unknown", 0.15, 12.0, 0.25, 14.0
_CLASSES = np.zeros(256, dtype=np.int32)
_CLASSES[np.arange(97, 123)] = _CLASSES[np.arange(65, 91)] = np.arange(1, 27)
_CLASSES[128:] = 27 + np.arange(128) % 37


def trigrams(data: np.ndarray) -> np.ndarray:
    codes = _CLASSES[data]
    return (codes[:-2] << 12) | (codes[1:-1] << 6) | codes[2:]


def _bytes(text: str) -> np.ndarray:
    return np.frombuffer(f" {text} ".encode(), dtype=np.uint8)


def _likelihoods(texts: list[str]) -> np.ndarray:
    counts = np.full(1 << 18, 0.1)
    for text in texts:
        counts += np.bincount(trigrams(_bytes(text)), minlength=1 << 18)
    return np.log(counts / counts.sum()).astype(np.float32)


def _typical(texts: list[str]) -> tuple[list[str], float]:
    """The texts that the others of their language explain, and the floor that says so.

    Each half of the texts is judged under the model of the other; one text alone sets no floor.
    """
    halves = texts[::2], texts[1::2]
    if not halves[1]:
        return texts, -np.inf
    tables = _likelihoods(halves[1]), _likelihoods(halves[0])
    held, number, letters = np.zeros(len(texts)), np.zeros(len(texts)), np.zeros(len(texts))
    for k, text in enumerate(texts):
        grams = trigrams(_bytes(text))
        held[k], number[k], letters[k] = tables[k % 2][grams].mean(), len(grams), (_CLASSES[_bytes(text)] > 0).sum()
    middle = np.median(held)
    floor = float(middle - SPREADS * max(1.4826 * np.median(np.abs(held - middle)), LEAST_SPREAD))
    fits = (held >= floor - SHORT / np.sqrt(number)) & (letters >= LETTER_SHARE * (number + 2))
    return [t for t, fit in zip(texts, fits, strict=True) if fit], floor


class TrigramModel:
    def __init__(self, labelled: dict[str, list[str]]):
        self.languages = sorted(labelled)
        typical = [_typical(labelled[x]) for x in self.languages]  # junk that somebody declared teaches nothing
        self.table = np.stack([_likelihoods(texts) for texts, _ in typical])
        self.floors = np.array([floor for _, floor in typical])

    def known(self, number: np.ndarray, letters: np.ndarray, scores: np.ndarray) -> np.ndarray:
        """Whether a text could be in one of the languages at all; from what ``scores`` gives."""
        n = np.maximum(number, 1)[:, None]
        return (letters >= LETTER_SHARE * (number + 2)) & (scores / n >= self.floors - SHORT / np.sqrt(n)).any(axis=1)

    def scores(self, data: np.ndarray, offsets: np.ndarray):
        """(trigrams, letters, log likelihoods) of each text; trigrams that cross a boundary don't count."""
        codes = _CLASSES[data]
        letters = np.diff(np.concatenate([[0], np.cumsum(codes > 0)])[offsets])
        number = np.maximum(np.diff(offsets) - 2, 0)
        out = np.zeros((len(number), len(self.languages)))
        if len(data) > 2:
            grams = trigrams(data)
            for k, row in enumerate(self.table):
                sums = np.concatenate([[0.0], np.cumsum(row[grams], dtype=np.float64)])
                begin = np.minimum(offsets[:-1], len(grams))
                out[:, k] = sums[np.minimum(begin + number, len(grams))] - sums[begin]
        return number, letters, out


def fit(rows: DataFrame) -> TrigramModel | None:
    """From rows with text and declared; the sample is chosen by hash, so it is the same every time.

    Copies count once, so a language of few texts has all of them in its sample. Only hashes are dealt out to choose it.
    """
    declared = rows.where("declared is not null and text is not null")
    declared = declared.select("declared", "text", F.xxhash64("text").alias("hash"), (F.length("text") >= LEAST_CHARS).alias("long"))
    distinct = F.coalesce(F.nullif(F.approx_count_distinct(F.when(F.col("long"), F.col("hash"))), F.lit(0)), F.approx_count_distinct("hash"))
    sizes = declared.groupBy("declared").agg(F.count("*").alias("rows"), distinct.alias("texts"), F.max("long").alias("any_long"))
    counts = sizes.orderBy(F.desc("rows"), "declared").limit(LANGUAGES).collect()
    if not counts:
        return None
    # hashes are even, so below this share of their range lie a few times SAMPLE of a language's texts at any size
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["declared"], 4.0 * SAMPLE / max(r["texts"], 1))])
    place = F.shiftrightunsigned("hash", 32)
    short_only = F.col("declared").isin([r["declared"] for r in counts if not r["any_long"]])
    declared = declared.where(F.col("declared").isin([r["declared"] for r in counts]) & (F.col("long") | short_only)).where(place <= share[F.col("declared")] * 2.0**32)
    first = Window.partitionBy("declared").orderBy(place, "hash")
    keys = declared.select("declared", "hash").distinct().withColumn("k", F.row_number().over(first)).where(F.col("k") <= SAMPLE).drop("k")
    drawn = declared.join(F.broadcast(keys), ["declared", "hash"]).groupBy("declared", "hash").agg(F.min(_window()).alias("text"))
    labelled: dict[str, list[str]] = {}
    for r in drawn.orderBy("declared", "hash").collect():  # LANGUAGES * SAMPLE rows at most, as are the keys
        labelled.setdefault(r["declared"], []).append(r["text"])
    return TrigramModel(labelled) if labelled else None


def _window():
    """The text, or a part of it at a place that its hash gives."""
    last = F.greatest(F.length("text") - SAMPLE_CHARS, F.lit(0))
    return F.substring(F.col("text"), (F.pmod(F.col("hash"), (last + 1).cast("long")) + 1).cast("int"), F.lit(SAMPLE_CHARS))


def _by_letters(text):
    """Whether the rules that need no model let a text pass."""
    letters = F.octet_length(F.regexp_replace(text, r"[\x00-\x40\x5B-\x60\x7B-\x7F]", ""))
    return F.coalesce((letters >= LETTERS) & (letters >= LETTER_SHARE * F.octet_length(text)), F.lit(False))


def _score(model: TrigramModel):
    def run(batches):
        import pyarrow as pa

        for batch in unbatched(batches):
            text = batch["text"]
            offsets = np.frombuffer(text.buffers()[1], dtype=np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
            data = np.frombuffer(text.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]] if text.buffers()[2] is not None else np.zeros(0, np.uint8)
            number, letters, scores = model.scores(data, offsets - offsets[0])
            known = model.known(number, letters, scores)
            scores *= np.minimum(1.0, EFFECTIVE / np.maximum(number, 1))[:, None]
            size = len(model.languages)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(text) + 1, dtype=np.int32) * size), pa.array(scores.ravel()))
            best = pa.array([model.languages[k] for k in scores.argmax(axis=1)])
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["text_key"], batch["host"], batch["suffix"], batch["declared"], pa.array(letters.astype(np.int64)), pa.array(known), lists, best], ["doc_id", "text_key", "host", "suffix", "declared", "letters", "known", "scores", "best"])

    return run


def _shares(counted: DataFrame, key: str, languages: list[str], parent) -> DataFrame:
    """(key, shares): the smoothed distribution of languages behind each value of ``key``."""
    wide = counted.groupBy(key).agg(*[F.sum(F.when(F.col("best") == x, F.col("rows")).otherwise(0)).alias(f"c{k}") for k, x in enumerate(languages)], *([F.max("above").alias("above")] if parent is None else []))
    counts = [F.col(f"c{k}") for k in range(len(languages))]
    total = sum(counts[1:], counts[0]) + STRENGTH
    above = [F.col("above")[k] if parent is None else F.lit(parent[k]) for k in range(len(languages))]
    return wide.select(key, F.array(*[(c + STRENGTH * a) / total for c, a in zip(counts, above, strict=True)]).alias("shares"))


def identify(rows: DataFrame) -> DataFrame:
    """doc_id, text_key, declared, language, posterior, kept. rows: doc_id, text, declared, host, suffix."""
    rows = rows.select("doc_id", F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("text_key"), "host", "suffix", "declared")
    model = fit(rows)
    if model is None:
        return rows.select("doc_id", "text_key", "declared", F.lit(None).cast("string").alias("language"), F.lit(None).cast("double").alias("posterior"), _by_letters(F.col("text")).alias("kept"))
    languages = model.languages
    scored = materialize(rows.mapInArrow(_score(model), "doc_id long, text_key long, host string, suffix string, declared string, letters long, known boolean, scores array<double>, best string"), "language-scores")
    sure = scored.where((F.col("letters") >= LETTERS) & F.col("known"))
    counted = materialize(sure.groupBy("host", "suffix", "declared", "best").agg(F.count("*").alias("rows")), "language-counts")
    overall = {r["best"]: r["rows"] for r in counted.groupBy("best").agg(F.sum("rows").alias("rows")).collect()}  # one row per language
    total = sum(overall.values()) + len(languages)
    top = [(overall.get(x, 0) + 1) / total for x in languages]
    ratios = lambda column: F.transform(column, lambda s, k: F.log(s) - F.log(F.array(*map(F.lit, top))[k]))
    nothing = F.array(*[F.lit(0.0) for _ in languages])
    by_suffix = _shares(counted.where("suffix is not null"), "suffix", languages, top)
    above = F.coalesce("shares", F.array(*map(F.lit, top)))
    hosts = counted.where("host is not null").join(checked_broadcast(by_suffix, by_suffix.count()), "suffix", "left").withColumn("above", above).drop("shares")
    out = scored
    for key, shares in (("host", _shares(hosts, "host", languages, None)), ("suffix", by_suffix), ("declared", _shares(counted.where("declared is not null"), "declared", languages, top))):
        shares = materialize(shares, "language-shares")
        out = out.join(checked_broadcast(shares.select(key, ratios(F.col("shares")).alias(f"e_{key}")), shares.count()), key, "left")
    # the suffix is in the host's prior already, so it speaks for itself only where there is no host
    evidence = [F.coalesce("e_host", "e_suffix", nothing), F.coalesce("e_declared", nothing), F.array(*[F.lit(float(np.log(x))) for x in top])]
    fused = F.col("scores")
    for e in evidence:
        fused = F.zip_with(fused, e, lambda a, b: a + b)
    out = out.withColumn("fused", fused).withColumn("most", F.array_max("fused"))
    weight = F.aggregate(F.transform("fused", lambda x: F.exp(x - F.col("most"))), F.lit(0.0), lambda a, x: a + x)
    at = F.array_position("fused", F.col("most")).cast("int")
    enough, known = F.col("letters") >= LETTERS, F.col("known")
    named = F.when(known, F.element_at(F.array(*map(F.lit, languages)), at)).otherwise(UNKNOWN)
    out = out.select("doc_id", "text_key", "declared", F.when(enough, named).alias("language"), (1 / weight).alias("posterior"), (enough & known).alias("enough"))
    return out.select("doc_id", "text_key", "declared", "language", "posterior", (F.col("enough") & (F.col("posterior") >= CONFIDENT)).alias("kept"))
