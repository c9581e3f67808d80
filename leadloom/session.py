"""Session helpers: reading tables and cutting lineage in the shared checkpoint folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder shared by the executors that ``spark.checkpoint.dir`` names.

    Where that setting is unset and no folder was set on the context, a temporary folder of
    this machine is used on a local master, where driver and executors are one process; on a
    cluster RuntimeError is raised.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    held = sc._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    if not named and not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="leadloom-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` by a reliable checkpoint, which survives the loss of executors.

    With ``spark.cleaner.referenceTracking.cleanCheckpoints`` Spark deletes it when it is no longer used.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small(df: DataFrame, most: int = 100_000) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``most`` rows, which is counted; beyond that as it is. ``df`` should be cut, so that counting is cheap."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def computed(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Adds columns that are computed once for each row.

    Filters and projections above an ordinary projection are merged into it, which repeats
    costly expressions for each use; those of a generator are not.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))
