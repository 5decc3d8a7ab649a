"""Intermediate tables in the folder that all executors share.

A table written here survives the loss of executors, and its Parquet form is smaller and cheaper to prune than
an RDD checkpoint. The folder is the one named by ``spark.checkpoint.dir``; a folder of our own is used only
where that setting is absent (tests, a laptop).
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder, or a temporary one if a local session names none."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = current.get() if current.isDefined() else None
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("a cluster needs spark.checkpoint.dir: a folder that the driver and all executors share")
        folder = os.path.join(tempfile.gettempdir(), "cataloom-shared")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def materialize(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write ``df`` to the shared folder and return it read back: a cut of the lineage that outlives executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.mode("error")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fingerprint(spark: SparkSession, folder: str) -> str:
    """Names the state of a folder's files: it changes when one is written anew. Reads their names, lengths and times alone."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length", "modificationTime")
    state = files.agg(F.count("*").alias("n"), F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)")).alias("s")).first()
    return f"{state['n']}_{state['s']}"


_written: dict[tuple[str, str, str, str], DataFrame] = {}


def written_once(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A table derived from the tables of a folder, which several queries of a session use: written by the first of them, and anew when the
    folder's files have changed."""
    key = (spark.sparkContext.applicationId, sf_dir, fingerprint(spark, sf_dir), name)
    if key not in _written:
        _written[key] = materialize(build(), name)
    return _written[key]
