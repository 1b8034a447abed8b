"""From raw documents to packed training sequences: quality, near duplicates, benchmark passages, secrets, packing.

Every stage takes the columns of documents, whatever further ones there are, keeps the order of columns, and gives an
empty table for an empty one. What each does with nulls, empty texts, ties and repeated rows is said with it; very long
texts are rows like any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import table, written
from tessera.llm.decontaminate import contaminated, find_passages, n_hit
from tessera.llm.encode import vocabulary
from tessera.llm.jaccard import one_of_each
from tessera.llm.packing import pack_documents
from tessera.llm.resampling import keep_sample
from tessera.llm.secrets import redact


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the importance sample keeps.

    Null and empty texts weigh 0 and are kept or not by their noise; a null doc_id has noise like any other value; equal
    rows, and ties at the cut, share their fate. Without labelled good documents all stay.
    """
    return keep_sample(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of Jaccard >= 0.8 on five-word shingles: least doc_id, then text hash; one of equal rows.

    Rows without words (null and empty texts) or without a doc_id are in no component and stay. Different texts under
    one doc_id are different documents.
    """
    return one_of_each(docs, width=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less than a twentieth of whose words lie in benchmark passages.

    Null and empty texts have no words and stay, as do rows with a null doc_id; repeated rows are judged each, alike.
    """
    names = [c if c in ("doc_id", "text") else f"column_{i}" for i, c in enumerate(docs.columns)]  # clear of the operator's own
    found = find_passages(docs.toDF(*names), table(spark, sf_dir, "benchmark"), keep=tuple(names)).withColumn("n_hit", n_hit())
    return found.where(~contaminated()).select(*names).toDF(*docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark for each secret; n_chars follows the text.

    Null texts stay null with their n_chars, empty ones empty; rows with a null doc_id and repeated rows stay.
    """
    return redact(docs).withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's place in sequences of 2048 tokens.

    Null and empty texts are an end id; a null doc_id stays null; repeated rows are packed each, equal lengths in the
    order of doc_id; other columns are ignored.
    """
    return pack_documents(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("packing", packing),
]

#: Hashed models and tokenizers are beyond SQL; tests/llm holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
