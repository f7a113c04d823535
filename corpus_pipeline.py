"""Corpus pipeline: quality filter, near-duplicate removal, redaction, mixing, packing.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that its predecessor kept. All but the
last return the columns of ``documents``; the last returns the pieces of packed sequences. ``run``
writes each stage's result to the scratch folder and reads it again for the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import common, jaccard, mixing, packing, pii, quality, queries

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts.

    Null and empty texts are scored like others; labels that are null count for nothing; repeated rows stay or go together,
    as do equal scores; very long texts are scored whole; an empty table gives an empty one.
    """
    labels = common.pick(common.table(spark, sf_dir, "labels"), "doc_id", "quality")
    return quality.accepted(common.pick(docs, *COLUMNS), labels)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word Jaccard of 0.8 or more): the one with the smallest id.

    Texts that are null, empty or without words are copies of one another; of repeated rows one stays; rows without a
    doc_id stay, and so do rows that share an id but not the text; very long texts are compared whole.
    """
    return jaccard.deduplicated(common.pick(docs, *COLUMNS))


def redact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; n_chars follows the text.

    Null texts stay null and a null n_chars stays null; repeated rows are each redacted; where spans overlap the first, then
    the longest counts; very long texts are redacted whole.
    """
    docs = pii.redacted(common.pick(docs, *COLUMNS))
    return docs.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length(F.coalesce("text", F.lit(""))).cast("long"))).select(*COLUMNS)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them.

    Null and empty texts have no words and are taken by rank like others; a null source is a source of its own, the last;
    repeated rows are documents of their own; equal sizes go by doc_id; very long texts are taken whole or not at all.
    """
    return mixing.mixed_documents(common.pick(docs, *COLUMNS))


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed token sequences, one row each.

    Null and empty texts have their end id only; repeated rows are packed each; very long texts fill sequences of their own
    first; an empty table gives no pieces.
    """
    return packing.pack_documents(common.pick(docs, "doc_id", "text"), queries.tokenizer_path())


STAGES = [
    ("quality", quality_stage),
    ("simhash", dedup_stage),
    ("pii", redact_stage),
    ("mixing", mix_stage),
    ("packing", pack_stage),
]

#: SQL can express neither the classifier nor the tokenizer; tests/llm compares with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
