"""Session helpers shared by every part of the engine."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, by any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only a local session without the setting gets a temporary folder; on a
    cluster a machine-local folder would lose files, so that is an error.
    """
    sc = spark.sparkContext
    found = sc._jsc.sc().getCheckpointDir()
    if found.isDefined():
        return found.get()
    set_to = spark.conf.get("spark.checkpoint.dir", None)
    if set_to is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        set_to = "file://" + tempfile.mkdtemp(prefix="spanloom-checkpoint-")
    sc.setCheckpointDir(set_to)
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage by a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


#: schemes of Spark's stores by the names they have in pyarrow
SCHEMES = {"s3a": "s3", "s3n": "s3", "s3": "s3", "abfss": "abfss", "abfs": "abfs", "gs": "gs", "hdfs": "hdfs", "viewfs": "viewfs", "file": "file"}


def store_uri(path: str) -> str:
    """A path as pyarrow names it, for what Python workers read and write themselves."""
    scheme, colon, rest = path.partition(":")
    if not colon:
        return "file://" + os.path.abspath(path)
    if scheme not in SCHEMES:
        raise ValueError(f"Python workers can't reach {scheme}, only {', '.join(SCHEMES)}")
    return re.sub(r"^file:/+", "file:///", f"{SCHEMES[scheme]}:{rest}")
