"""Session helpers shared by the core and its extensions."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    """Sends this package to the session's Python workers, once a context.

    The driver serves the archive itself, so workers need neither this folder nor its path."""
    sc = spark.sparkContext
    if getattr(sc, "_tidewright_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    name = os.path.join(tempfile.mkdtemp(prefix="tidewright-"), "tidewright_package")
    with tempfile.TemporaryDirectory() as tmp:
        shutil.copytree(here, os.path.join(tmp, "tidewright"), ignore=shutil.ignore_patterns("__pycache__"))
        archive = shutil.make_archive(name, "zip", tmp)
    sc.addPyFile(archive)
    sc._tidewright_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data directory (a file or a directory of parts)."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes for each core up to which a table counts as small: shuffling it costs next to nothing.
SMALL_BYTES = 16 << 20


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores if it is a small table, whose few row groups would give work to few of them.

    The size is the optimizer's own estimate. A table of a cluster's size stays as it is, without a shuffle; the rows are the same either way."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(2 * cores) if size < cores * SMALL_BYTES else df


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it in ``spark.checkpoint.dir``.

    Only where neither the session nor the context names one, and all executors are on
    this machine (unit tests), a temporary folder is set; on a cluster that is an error.
    """
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named and not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tidewright-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and cut from its lineage, in the shared folder.

    The files survive the loss of executors, and no consumer recomputes the plan.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
