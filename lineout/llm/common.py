"""What the operators share: input tables, stored stages and word patterns."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lineout.sources.write import shared_folder

WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]"
BATCH_ROWS = 1000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _session_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/lineout-llm-{spark.sparkContext.applicationId}"


def stored(df: DataFrame, schema: T.StructType | None = None) -> DataFrame:
    """Write a stage to the shared folder and read it back.

    This cuts the lineage: a lost executor costs a re-read, and a stage that is
    read several times is computed once. ``clear_stored`` removes all of them.
    """
    path = f"{_session_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema or df.schema).parquet(path)


class Buckets:
    """Tables dealt by a key to as many buckets as the session has shuffle partitions, until ``drop``."""

    def __init__(self, spark: SparkSession, key: str):
        self.spark, self.key, self.count, self.made = spark, key, int(spark.conf.get("spark.sql.shuffle.partitions")), []

    def stored(self, df: DataFrame) -> DataFrame:
        name = f"{self.key}_{uuid.uuid4().hex}"
        path = f"{shared_folder(self.spark)}/{name}"
        self.made.append((name, path))
        df.write.format("parquet").option("path", path).option("compression", "zstd").bucketBy(self.count, self.key).saveAsTable(name)
        return self.spark.table(name)

    def listed(self, df: DataFrame, name: str, value: Column | str) -> DataFrame:
        """The values of each key as one list, dealt like the tables: a join with one of them leaves it where it is."""
        return df.repartition(self.count, self.key).groupBy(self.key).agg(F.collect_list(value).alias(name))

    def drop(self) -> None:
        for name, path in self.made:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
        self.made = []


def map_arrow(df: DataFrame, fn: Callable, schema: str | T.StructType) -> DataFrame:
    """``mapInArrow`` in batches of at most ``BATCH_ROWS`` rows: whole texts are long, and workers and
    executors hold a batch several times. The session keeps a smaller setting of its own."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    rows = int(conf.get(name))
    conf.set(name, BATCH_ROWS if rows <= 0 else min(BATCH_ROWS, rows))
    return df.mapInArrow(fn, schema)


def clear_stored(spark: SparkSession) -> None:
    """Delete what ``stored`` has written in this session."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_session_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z; other letters stay as they are."""
    return F.translate(text, UPPER, LOWER)


def word_count(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Whether crc32 of the id as text is divisible by ``folds``; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def fitting_ids(labels: DataFrame, label: str, value: int, rows: int) -> DataFrame:
    """At most ``rows`` labelled ids, the first by hash: (doc_id). Small by that bound."""
    ids = labels.filter(F.col(label) == value).select("doc_id").dropna().distinct()
    return ids.orderBy(F.xxhash64(F.lit("fit"), "doc_id"), "doc_id").limit(rows)


def rows_of(docs: DataFrame, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    """Rows of ``docs`` whose id is (or, with ``left_anti``, is not) in ``ids`` (doc_id); null is an id too."""
    wanted = ids.select(F.col("doc_id").alias("_wanted")).distinct()
    return docs.join(wanted, docs["doc_id"].eqNullSafe(wanted["_wanted"]), how)
