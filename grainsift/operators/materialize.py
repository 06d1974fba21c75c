"""Cutting lineage with a table written to the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"
#: frees the shuffle files of a query when it ends
_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def checkpoint_folder(spark: SparkSession) -> str:
    """Folder named by the session; a folder of our own only in local mode without a setting."""
    folder = spark.conf.get(_KEY, None) or spark.sparkContext.getConf().get(_KEY)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {_KEY} to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="grainsift-")
    spark.conf.set(_KEY, folder)
    return folder


def materialize(df: DataFrame) -> DataFrame:
    """Write the rows once and read them back: lost executors cost a re-read, not a re-run.

    The shuffle files behind the table are freed when it is written, as nothing reads them any more."""
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    before = spark.conf.get(_FREE, None)
    spark.conf.set(_FREE, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_FREE)
        else:
            spark.conf.set(_FREE, before)
    return spark.read.schema(df.schema).parquet(path)
