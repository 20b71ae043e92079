"""Session helpers: a shared checkpoint folder and partition counts."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``, a folder that the driver and all executors share.

    Only where none is set and the master is local (as in tests) a temporary one takes its place; on a cluster
    without one this is an error.
    """
    sc = spark.sparkContext
    folder = sc._jsc.sc().getCheckpointDir()
    if folder.isDefined():
        return folder.get()
    named = sc.getConf().get("spark.checkpoint.dir")
    if not named:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="checkpoint-")
    sc.setCheckpointDir(named)
    return named


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows written to the shared checkpoint folder and read from there: a lost executor repeats nothing before."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hot_join(many: DataFrame, one: DataFrame, key: str, counts: DataFrame, total: int | None = None, share: int = 1000) -> DataFrame:
    """Inner join of ``many`` with ``one``, which has each key once; ``counts``: (key, n), how many rows of ``many`` hold a key.

    Keys held by more than one in ``share`` of the rows, fewer than ``share`` keys whatever the data, are met by a
    broadcast of their rows; the rest is shuffled, without any hot key. Null keys meet nothing.
    """
    if total is None:
        total = counts.agg(F.sum("n")).first()[0] or 0
    hot = checkpointed(counts.where(F.col("n") > max(total // share, 100)).select(key))
    if hot.isEmpty():
        return many.join(one, key)
    hot = F.broadcast(hot)
    met = many.join(F.broadcast(one.join(hot, key, "left_semi")), key)
    rest = many.join(hot, key, "left_anti").join(one.join(hot, key, "left_anti"), key)
    return met.unionByName(rest)
