"""Tables written between steps, in the folder that driver and executors share, and indexes that are built once."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

_STORED: dict[tuple, str] = {}


def folder(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a local one only where that is unset and Spark is local."""
    found = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="loquent-"))
    return spark.sparkContext.getCheckpointDir()


def written(df: DataFrame) -> DataFrame:
    """``df`` as Parquet in the shared folder, read back: its lineage ends there, and a lost executor costs a read."""
    path = f"{folder(df.sparkSession)}/loquent-{uuid.uuid4().hex}"
    df.write.parquet(path, compression="zstd")
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_at(name: str, source: DataFrame, build: Callable[[DataFrame, str], None]) -> str:
    """The folder that ``build(source, folder)`` filled, once in an application for the files that ``source`` reads.

    Files of a table are taken to be replaced by files of other names, not changed. What was cleared from the shared
    folder is built again.
    """
    spark = source.sparkSession
    key = (spark.sparkContext.applicationId, name, *sorted(source.inputFiles()))
    if key in _STORED:
        try:
            spark.read.parquet(f"{_STORED[key]}/done")
            return _STORED[key]
        except AnalysisException:  # no such folder any more
            del _STORED[key]
    path = f"{folder(spark)}/loquent-index-{uuid.uuid4().hex}"
    build(source, path)
    spark.range(1).write.parquet(f"{path}/done")
    _STORED[key] = path
    return path


def stored(name: str, source: DataFrame, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``build(source)``, written once (``stored_at``) and read from then on."""
    path = stored_at(name, source, lambda df, at: build(df).write.parquet(f"{at}/table", compression="zstd"))
    return source.sparkSession.read.parquet(f"{path}/table")
