"""Writing reports, parameters, models and intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence
from functools import cache

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession


def write_report(df: DataFrame, path: str, names: Sequence[str] | None = None, single_file: bool = False) -> None:
    """CSV with a header and quoted text. ``single_file`` is for small reports only."""
    out = df.toDF(*names) if names else df
    if single_file:
        out = out.coalesce(1)
    out.write.mode("overwrite").option("header", True).option("quoteAll", True).csv(path)


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Write parquet and return the table as read back."""
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names for checkpoints; on one machine a temporary one if it names none."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and spark.sparkContext.master.partition("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (folder or _scratch_folder().name).rstrip("/")


@cache
def _scratch_folder() -> tempfile.TemporaryDirectory:
    return tempfile.TemporaryDirectory(prefix="lineout-", ignore_cleanup_errors=True)  # removed at exit


def materialise(df: DataFrame) -> DataFrame:
    """Write a table that is used many times to the shared folder and read it back.

    Cuts the lineage in columnar form: later steps read only the columns they
    need, and a lost executor costs a re-read, not a recomputation.
    """
    return write_table(df, f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}")


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
