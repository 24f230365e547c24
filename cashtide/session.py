"""Session settings and the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

# Everything here is a runtime SQL setting, so it can be applied to a session someone else built.
_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A hot key is split even when the operator above has to shuffle once more for it.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Turn on run-time replanning, which splits join partitions that hold a hot key. No query calls it by itself."""
    for key, value in _SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``; in local mode, where that is unset, a folder in the warehouse."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors reach")
    return folder or spark.conf.get("spark.sql.warehouse.dir") + "/staged"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Used where a result must not change between two reads (positions after a range shuffle) or
    where one small result feeds many branches. The copy outlives a lost executor.
    """
    path = f"{shared_dir(df.sparkSession)}/cashtide/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
