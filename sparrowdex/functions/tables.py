"""Tables that a plan reads more than once, written where a cluster shares them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; in a local session without one, a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
    return _local_dir(spark.sparkContext.applicationId)


_LOCAL: dict[str, str] = {}


def _local_dir(application: str) -> str:
    if application not in _LOCAL:
        _LOCAL[application] = "file://" + tempfile.mkdtemp(prefix="sparrowdex-")
    return _LOCAL[application]


def stored(df: DataFrame, what: str) -> DataFrame:
    """df, written as Parquet in the shared folder and read again: computed once, and no executor's loss undoes it."""
    path = f"{shared_dir(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
