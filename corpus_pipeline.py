"""From raw documents to packed token sequences: quality, near duplicates, contamination, secrets, packing.

``STAGES`` are (name, function) pairs. A function takes (spark, docs, folder) and returns a DataFrame, which is
written as Parquet and read again as the next one's ``docs``; all but the last return the columns of ``docs``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm import gray_simhash, pairwise_quality, residual_packing, secret_ledger, wu_manber
from shelfwise.llm.common import checkpoint_folder, read_table

#: A stage cannot be expressed in SQL (hash-based fingerprints, byte-pair encoding): tests compare with brute force.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Without the documents that the quality classifier rejects."""
    model = pairwise_quality.learn(docs, read_table(spark, folder, "labels"))
    scored, score = pairwise_quality.score_documents(docs, model, docs.columns)
    return scored.filter(F.col(score) >= pairwise_quality.ACCEPT).drop(score)


def near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return gray_simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Without the documents that hold benchmark passages in a twentieth of their words or more."""
    return wu_manber.decontaminate(docs, read_table(spark, folder, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """All documents, with a marker in place of each secret."""
    return secret_ledger.redact(docs, length="n_chars" if "n_chars" in docs.columns else None)


def packing(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The pieces of all documents with their places in token sequences."""
    return residual_packing.pack(docs)


STAGES = [
    ("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("secrets", secrets),
    ("packing", packing),
]


def run(spark: SparkSession, folder: str) -> DataFrame:
    """The last stage's rows; each stage's are written below the shared checkpoint folder, in a folder of this run."""
    here = f"{checkpoint_folder(spark)}/corpus-pipeline-{uuid.uuid4()}"
    docs = read_table(spark, folder, "documents")
    for number, (name, stage) in enumerate(STAGES):
        out = f"{here}/{number}-{name}"
        stage(spark, docs, folder).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
