"""A corpus pipeline of five stages, each written as Parquet and read by the next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexsieve.llm import ngram_join, packing, pu_classifier, quality_rules, secret_scan
from lexsieve.llm.common import checkpoint_folder, remove, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, judged row by row: repeated rows alike, texts of any length as
    one. A null or blank text fails. An empty table gives none."""
    return quality_rules.judge_quality(docs.select(*COLUMNS)).filter("kept").select(*COLUMNS)


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be good, judged row by row: repeated rows alike, rows without a
    doc_id by their text. Learnt from the labels of this input's rows; without labels, or on an empty
    table, all stay."""
    labels = table(spark, sf_dir, "labels")
    scored = pu_classifier.score_quality(docs, *pu_classifier.learn_from(docs, labels), carried=tuple(COLUMNS))
    return scored.filter("score >= 0.5").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each component of five-word shingle sets at 0.8; of repeated
    rows one. Documents without words are each their own. An empty table gives none."""
    return ngram_join.one_of_each(docs.select(*COLUMNS), ngram_join.Join(n=5, part=80))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret replaced by a mark, row by row. A null text stays null, and so does n_chars."""
    found = secret_scan.scan_secrets(docs)
    return found.withColumn("text", secret_scan.redact(F.col("text"), F.col("secrets"))).select(
        "doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars")
    )


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents' tokens in full sequences; a null or empty text has its end only, repeated rows
    are packed each, a long text is cut. An empty table gives none."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality rules", quality),
    ("quality classifier", classifier),
    ("n-gram Jaccard join", near_duplicates),
    ("secret scans", secrets),
    ("packing", packed),
]

#: Tokens, learnt weights and components are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir. A stage's files are removed when the next stage is written; those
    of the last hold the result."""
    folder = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            remove(spark, f"{folder}/{k - 1}")
    return docs
