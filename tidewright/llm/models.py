"""Fitted models on any file system that Spark writes to: a pipeline fits once and scores many times."""

from __future__ import annotations

import pickle

from pyspark.sql import SparkSession

#: Changes with what the models hold, so that one of another kind is not read by mistake.
VERSION = 2


def save(spark: SparkSession, model, path: str) -> None:
    """Writes a model (a sentence splitter, tables, a truncation model) as a table of one row; what was there before is replaced."""
    spark.createDataFrame([(VERSION, type(model).__module__, bytearray(pickle.dumps(model, protocol=5)))], "version int, kind string, model binary").coalesce(1).write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str, kind: str = ""):
    """The model of a path. Only read what this package wrote: a model is code as well as data."""
    row = spark.read.parquet(path).first()
    if row is None or row.version != VERSION or kind and not row.kind.endswith(kind):
        raise ValueError(f"{path} holds no model of version {VERSION}" + f" of {kind}" * bool(kind))
    return pickle.loads(bytes(row.model))


def kept(spark: SparkSession, path: str | None, kind: str, fit):
    """The model of a path, or one that is fitted now and left there; without a path it is only fitted."""
    if path is not None:
        files = spark._jvm.org.apache.hadoop.fs.Path(path)
        if files.getFileSystem(spark._jsc.hadoopConfiguration()).exists(files):
            return load(spark, path, kind)
    model = fit()
    if path is not None:
        save(spark, model, path)
    return model
