"""Streams: stateless filters and calculations on unbounded tables, and an append writer with a fixed quota."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class QuotaWriter:
    """A foreachBatch sink that appends to a Parquet folder up to a number of rows fixed in advance; a batch that would
    go beyond, or has another schema, is an error and nothing of it is written. A batch that is run again after a
    failure replaces what it had written."""

    def __init__(self, path: str, rows: int, schema):
        self.path, self.rows, self.schema = path, rows, schema

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        if [(f.name, f.dataType) for f in batch.schema.fields] != [(f.name, f.dataType) for f in self.schema.fields]:
            raise TypeError("the batch has another schema")
        try:
            there = batch.sparkSession.read.parquet(self.path).where(F.col("batch") != batch_id).count()
        except Exception as e:  # nothing written so far
            if "PATH_NOT_FOUND" not in str(e):
                raise
            there = 0
        if there + batch.count() > self.rows:
            raise ValueError(f"more than {self.rows} rows")
        batch.write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")


def filtered(stream: DataFrame, condition: Column, **made: Column) -> DataFrame:
    """Rows that fit, with calculated columns; works on streams and tables alike."""
    return stream.where(condition).withColumns(made) if made else stream.where(condition)


def counted(stream: DataFrame, time: str, width: str, late: str, *keys: str) -> DataFrame:
    """Counts a window of time, with rows up to ``late`` behind."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(F.count("*").alias("n"))
