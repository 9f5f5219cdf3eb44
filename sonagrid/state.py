"""Lineage of loops: tables of a round in the shared folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared(spark: SparkSession) -> str:
    """The session's folder in spark.checkpoint.dir. Where none is set: a temporary one in
    local mode, an error on a cluster."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            folder = "file://" + tempfile.mkdtemp(prefix="rounds-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def kept(df: DataFrame) -> DataFrame:
    """df with its rows in the shared folder, so that a lost executor costs a re-read of one round."""
    shared(df.sparkSession)
    return df.checkpoint(eager=True)
