"""A training corpus from raw documents: toxic and poor texts go, then copies and near copies; the rest is packed.

Each stage takes (spark, docs, sf_dir), works on all that the one before it kept and returns the columns
of documents; the last returns the pieces of the packed sequences. Classifiers learn from the labels in
``sf_dir``, of rows that are not held out and are still among their stage's documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from ludora.llm import common, exact, neardup, packing, quality, toxicity


def aside(docs: DataFrame) -> dict[str, str]:
    """Names under which columns of the documents wait that are called like a classifier's own."""
    hidden = {}
    for c in docs.columns:
        if c.lower() in ("score", "predicted"):
            hidden[c] = "given_" + c
            while hidden[c] in docs.columns or hidden[c] in [v for k, v in hidden.items() if k != c]:
                hidden[c] = "_" + hidden[c]
    return hidden


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is under the threshold, each row for itself; all their columns stay as they were.

    Null and empty texts have no insult and stay; texts of any length are scored whole; repeated rows share their score. No documents: none.
    """
    hidden = aside(docs)
    scored = toxicity.score(docs.withColumnsRenamed(hidden), common.table(spark, sf_dir, "labels"))
    return scored.where(F.col("predicted") == 0).drop("score", "predicted").withColumnsRenamed({v: k for k, v in hidden.items()}).select(docs.columns)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality is at the threshold or above, each row for itself; all their columns stay as they were.

    Null and empty texts are judged by the statistics of a text without characters; texts of any length are scored whole; repeated rows
    share their score. No documents: none.
    """
    hidden = aside(docs)
    given = docs.withColumnsRenamed(hidden)
    scored = quality.score(given, common.table(spark, sf_dir, "labels"), given.columns)
    return scored.where(F.col("predicted") == 1).drop("score", "predicted").withColumnsRenamed({v: k for k, v in hidden.items()}).select(docs.columns)


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, the longest, then that of smallest doc_id (null last), with all its columns.

    Null texts count as empty, and one of all empty ones stays. Of rows equal in doc_id and text any one stays. No documents: none.
    """
    return exact.keep_distinct(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, that of smallest doc_id (null last), with all its columns.

    Null and empty texts and those without words are no near copies of each other and stay, but of rows equal in doc_id and text one stays. No documents: none.
    """
    return neardup.keep_one_of_each(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences; columns besides doc_id and text go.

    A null or empty text is its end id alone; a very long one has many pieces; repeated rows are packed each. No documents: no pieces.
    """
    # its workers have served the stages before and are smaller for it
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), cached_parts=300_000, keep_encoder=False).drop("ids")


STAGES = [("toxicity", toxicity_stage), ("quality classifier", quality_stage), ("exact dedup", exact_dedup_stage), ("near dedup", near_dedup_stage), ("packing", packing_stage)]

#: Classifiers, tokenizers and alignment can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = common.written(docs, "stage-" + name.replace(" ", "-"))
    return docs
