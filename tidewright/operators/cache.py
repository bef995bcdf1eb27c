"""Content-addressed store of finished hops."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut


def through_cache(rows: DataFrame, key: Column, cache: DataFrame, call: Callable[[DataFrame], DataFrame], out: str = "out") -> tuple[DataFrame, DataFrame]:
    """(rows with ``out``, new entries (key, value)): rows found in the cache take its value, only the rest are called.

    Equal keys are called once. ``call`` gets rows with their key and gives the same with ``out``; it is computed once and cut
    from its lineage before anything reads it, so that an expensive call is never repeated by a lost executor or a second
    consumer. A row with a null key is neither looked up nor stored, and gets null."""
    keyed = rows.withColumn("_key", key)
    c = cache.groupBy("key").agg(F.max("value").alias("value"))
    hit = keyed.join(c.select(F.col("key").alias("_key"), F.col("value").alias("_value")), "_key", "left")
    missing = hit.where("_value is null and _key is not null").dropDuplicates(["_key"]).drop("_value")
    fresh = cut(call(missing).select(F.col("_key").alias("key"), F.col(out).alias("value")))
    both = hit.join(fresh.select(F.col("key").alias("_key"), F.col("value").alias("_new")), "_key", "left")
    return both.withColumn(out, F.coalesce("_value", "_new")).drop("_key", "_value", "_new"), fresh
