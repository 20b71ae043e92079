"""Corpus pipeline: five stages from raw documents to packed sequences.

Each stage works on all rows that the one before kept; all but the last return the columns of documents.

Defined results, for every stage: rows with equal texts or ids are rows of their own (the near-dedup keeps one row of a
group, the rest of the stages all of them); null ids, languages, sources and counts are kept as they are; texts are worked on
whole, however long; an empty table gives no rows; columns beyond those of documents are left behind, whatever their
names. What a stage does with null and empty texts and with ties stands beside it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklake.llm import classifier, neardup, packing, pii, repetition
from tracklake.llm._session import checkpoint_folder, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: The key of the surrogates. Give one of your own, from a secret store.
SURROGATE_KEY = "replace-this-key"


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be good; learnt from labels of ids that aren't held out.

    Null and empty texts have a score like any other text; a score of exactly the bound is good. Labels that are null, or of
    ids that no document has, aren't learnt from.
    """
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    model = classifier.fit(docs, table(spark, sf_dir, "labels").where(~held_out))
    return classifier.keep_good(docs.select(*COLUMNS), model)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that repeat little inside themselves. Null and empty texts have no words, so they go; a share of exactly the bound stays."""
    return repetition.keep_unrepetitive(docs.select(*COLUMNS))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id; of repeated rows of that id one stays.

    Texts without words are linked with nothing; of those only rows equal in id and text are one.
    """
    return neardup.keep_one_row(docs.select(*COLUMNS))


def pii_surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with surrogates in place of personal data and secrets; ``n_chars`` follows the text.

    A null text stays null (its ``n_chars`` too), an empty one empty; equal entities have equal surrogates in all rows.
    """
    changed = pii.with_surrogates(docs.select(*COLUMNS), SURROGATE_KEY)
    return changed.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes. A null or empty text is one piece, its end id; pieces of equal length are interchangeable."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_classifier),
    ("quality rules", quality_rules),
    ("near-dedup", near_dedup),
    ("PII", pii_surrogates),
    ("best-fit packing", best_fit_packing),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage before is written as Parquet to the shared folder and read again.

    What a stage wrote goes when the next one is written; the last of it stays, for the result reads it.
    """
    folder = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            old = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{k - 1}")
            old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
    return STAGES[-1][1](spark, docs, sf_dir)
