"""Working tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder only where it is unset and all runs on one machine."""
    if shared := spark.conf.get("spark.checkpoint.dir", None):
        return shared
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return _LOCAL.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="orrery-"))


def save(df: DataFrame) -> DataFrame:
    """Cut lineage: written once, read from there by all that follows."""
    path = f"{work_dir(df.sparkSession)}/orrery/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
