"""Tables as text: a data file of quoted fields, and a column file that tells name, type and attributes."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def dump(df: DataFrame, data: str, columns: str) -> None:
    """Vectors are written as JSON lists."""
    flat = [F.to_json(f.name).alias(f.name) if isinstance(f.dataType, (T.ArrayType, T.StructType)) else F.col(f.name) for f in df.schema.fields]
    df.select(*flat).write.option("sep", " ").option("nullValue", "").option("emptyValue", '""').option("quoteAll", True).csv(data)
    df.sparkSession.createDataFrame([(i, f.json()) for i, f in enumerate(df.schema.fields)], "place int, field string").coalesce(1).write.json(columns)


def load(spark: SparkSession, data: str, columns: str) -> DataFrame:
    fields = [T.StructField.fromJson(json.loads(r["field"])) for r in spark.read.json(columns).orderBy("place").collect()]
    flat = T.StructType([T.StructField(f.name, T.StringType() if isinstance(f.dataType, (T.ArrayType, T.StructType)) else f.dataType) for f in fields])
    rows = spark.read.schema(flat).option("sep", " ").option("nullValue", "").option("emptyValue", "").csv(data)
    return rows.select(*((F.from_json(f.name, f.dataType) if isinstance(f.dataType, (T.ArrayType, T.StructType)) else F.col(f.name)).alias(f.name) for f in fields))
