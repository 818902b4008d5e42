"""Parquet tables of a scale-factor folder, and cutting of lineage in the cluster's shared folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Table ``name`` of ``folder``: a Parquet file or a folder of Parquet files."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share.

    It is the one the cluster names in ``spark.checkpoint.dir``; only where that is unset (tests, one machine) a
    temporary folder is made, once a session, and removed when Python ends.
    """
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    named = context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        local = tempfile.mkdtemp(prefix="quire-")
        atexit.register(shutil.rmtree, local, ignore_errors=True)
        named = Path(local).as_uri()
    context.setCheckpointDir(named)
    return context._jsc.sc().getCheckpointDir().get()


def spread(frame: DataFrame, *keys: str) -> DataFrame:
    """``frame`` by keys over as many tasks as ``spark.sql.shuffle.partitions`` says.

    For work that costs far more than its bytes tell: adaptive planning would put small rows of it into few tasks. A
    deduplication by the same keys needs no further shuffle.
    """
    return frame.repartition(int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def cut(frame: DataFrame) -> DataFrame:
    """``frame`` written to the shared folder, without its lineage; survives the loss of executors."""
    shared_folder(frame.sparkSession)
    return frame.checkpoint(eager=True)
