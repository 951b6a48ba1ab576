"""Score new extracts with a saved model as files land in a folder.

Scoring is stateless: each row depends on the saved model alone, so there is no
watermark, window or state to keep.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from lineout import schema as S
from lineout.plans.hit_probability import score_new
from lineout.sources.write import load_model


def score_arriving(
    spark: SparkSession, model_path: str, incoming: str, scored: str, checkpoint: str,
    key: Sequence[str] = S.RAW_COLUMNS,
) -> StreamingQuery:
    """Append scores for every extract not yet seen, then stop.

    ``checkpoint`` remembers the files already scored and must be shared storage.
    """
    stream = (
        spark.readStream.schema(S.RAW_SCHEMA).option("header", True).option("nullValue", "null").csv(incoming)
    )
    return (
        score_new(load_model(model_path), stream, key)
        .writeStream.format("parquet").option("path", scored).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )
