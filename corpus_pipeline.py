"""From raw documents to a mixed training corpus, in stages that are written and read back.

Each stage takes what the one before kept. A row's id decides: rows that share an
id, null included, are one document and stay or go together where a stage judges
by id. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineout.llm.common import rows_of, stored, table
from lineout.llm.decontaminate import contaminated
from lineout.llm.mixing import mix
from lineout.llm.near_dedup import near_duplicates
from lineout.llm.resampling import select_quality
from lineout.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose toxicity score is 0.5 or more."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that importance resampling draws for the labelled share of good ones."""
    return rows_of(docs, select_quality(docs, table(spark, sf_dir, "labels")).filter("kept"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each near-duplicate group."""
    return rows_of(docs, near_duplicates(docs).filter("kept"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item."""
    return rows_of(docs, contaminated(docs, table(spark, sf_dir, "benchmark")), "left_anti")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep what the mix takes, with the ``taken`` words of each row (repeats counted) and its source's ``target``.

    Rows that share an id are rows of their own here: each takes at most twice its size.
    """
    tagged = stored(docs.drop("taken", "target").withColumn("_mixed_row", F.monotonically_increasing_id()))
    mixed = mix(tagged, keep=["_mixed_row"]).filter("taken > 0").select("_mixed_row", "taken", "target")
    return tagged.join(mixed, "_mixed_row").drop("_mixed_row")


STAGES = [
    ("toxicity", toxicity),
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
]

# Hashes, models and components have no counterpart in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
