"""Structured Streaming forms of the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as T
from ..operators.report import high, n_issues
from ..plans.translate import round_trip


def arriving(spark: SparkSession, folder: str, schema, per_trigger: int = 100) -> DataFrame:
    """Rows of Parquet files as they arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def once(results: DataFrame, lateness: str = "60 days") -> DataFrame:
    """Results without redelivered rows: state is kept by id until the watermark has passed a row's time.

    Rows without a time or id can't be told from others and pass through no state, so they are left out."""
    return results.where("result_id is not null and loaded_at is not null").withWatermark("loaded_at", lateness).dropDuplicatesWithinWatermark(["result_id"])


def flagged_by_day(results: DataFrame, lateness: str = "60 days", window: str = "1 day") -> DataFrame:
    """Segments, fallbacks, flagged ones and grave issues by tumbling window of loading, late rows taken up to ``lateness``."""
    w = results.withWatermark("loaded_at", lateness).groupBy(F.window("loaded_at", window))
    return w.agg(
        F.count("*").alias("segments"), F.count_if(~F.col("translated")).alias("fallback"), F.count_if(n_issues(F.col("issues")) > 0).alias("flagged"), F.sum(high(F.col("issues"))).alias("severe"),
    ).select(F.col("window.start").alias("day"), "segments", "fallback", "flagged", "severe")


def translate_arriving(docs: DataFrame, pivots: list[str], out: str, checkpoint: str, call=T.rotate_words) -> StreamingQuery:
    """Round trips of documents as they arrive, each micro-batch written under its number: a batch replayed after a failure
    overwrites its own folder, so results are written exactly once."""

    def write(batch: DataFrame, number: int) -> None:
        round_trip(batch, pivots, call).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
