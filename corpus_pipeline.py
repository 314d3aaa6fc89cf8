"""The corpus pipeline: language ID, near dedup, substring dedup, decontamination, packing.

Every stage but the last returns the columns that it is given, further ones and any names included. Empty tables
pass through every stage; very long texts are judged whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from continuo.llm import common, language_id, minhash, packing, substring_dedup
from continuo.llm.decontaminate import PositionalIndex, document_key
from continuo.llm.queries import language_rows, tokenizer_path

#: The columns of documents that stages read.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _without(docs: DataFrame, gone: DataFrame, tag: str, *meets) -> DataFrame:
    """The documents that meet no row of ``gone``; broadcast where it is counted small."""
    gone = common.materialize(gone.distinct(), tag)
    condition = [left.eqNullSafe(gone[right]) for left, right in meets]
    return docs.join(common.checked_broadcast(gone, gone.count()), condition, "left_anti").select(*docs.columns)


def _doc_id(docs: DataFrame):
    return docs["doc_id"].cast("long")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without recognisable language go: null, blank and letterless texts, junk, unmodelled languages.

    Repeated rows are judged alike, rows with a null doc_id by their texts.
    """
    judged = language_id.identify(language_rows(docs)).where("not kept")
    gone = judged.select(F.col("doc_id").cast("long").alias("gone_id"), F.col("text_key").alias("gone_text"))
    return _without(docs, gone, "rejected", (_doc_id(docs), "gone_id"), (F.xxhash64(docs["text"].cast("string")), "gone_text"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest doc_id.

    All rows of that doc_id stay, and all rows without words or without doc_id, which are near nothing.
    """
    gone = minhash.near_duplicates(docs).where("not kept").select(F.col("doc_id").alias("gone_id"))
    return _without(docs, gone, "near-copies", (_doc_id(docs), "gone_id"))


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Long passages stay in one document only; a document that is nothing but such copies goes.

    Where words go, the rest is joined by single spaces and n_chars counts it; other texts, nulls too, stay as they are.
    """
    names = [c if c in COLUMNS else f"column{k}" for k, c in enumerate(docs.columns)]  # none that the operator adds
    cut = substring_dedup.remove_repeats(docs.toDF(*names))
    cut = cut.where("__n_removed = 0 or __n_removed < __n_words")
    length = F.when(F.col("__n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return cut.withColumn("n_chars", length).select(*names).toDF(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark passage go; null texts have none. Repeated rows are judged alike."""
    index = PositionalIndex(docs, common.table(spark, sf_dir, "benchmark"))
    gone = index.hits().where("contaminated").select(F.col("doc").alias("gone_doc"))
    return _without(docs, gone, "contaminated", (document_key(docs["doc_id"], docs["text"]), "gone_doc"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all sequences; a null text is one end token, every row a document of its own."""
    return packing.pack(docs, tokenizer_path(), end_id=2)


STAGES = [
    ("language_id", language_stage),
    ("near_dedup", near_dedup_stage),
    ("substring_dedup", substring_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: Trained likelihoods, minhash and tokenizers have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
