"""Filters and calculators given as text.

The text is Spark SQL: Spark reads it, checks its types and plans it like any column. ``register`` adds the library's own
functions as SQL functions, which Catalyst puts in place, so that text can name them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OFFSETS = "((x - xc) * cos(radians(angle)) + (y - yc) * sin(radians(angle)))", "((y - yc) * cos(radians(angle)) - (x - xc) * sin(radians(angle)))"
#: name: parameters, result, body.
FUNCTIONS = {
    "near": ("a DOUBLE, b DOUBLE, tolerance DOUBLE", "BOOLEAN", "abs(a - b) < tolerance"),
    "circle": ("xc DOUBLE, yc DOUBLE, r DOUBLE, x DOUBLE, y DOUBLE", "BOOLEAN", "(x - xc) * (x - xc) + (y - yc) * (y - yc) <= r * r"),
    "box": ("xc DOUBLE, yc DOUBLE, width DOUBLE, height DOUBLE, angle DOUBLE, x DOUBLE, y DOUBLE", "BOOLEAN", f"abs({_OFFSETS[0]}) <= width / 2 AND abs({_OFFSETS[1]}) <= height / 2"),
    "ellipse": ("xc DOUBLE, yc DOUBLE, a DOUBLE, b DOUBLE, angle DOUBLE, x DOUBLE, y DOUBLE", "BOOLEAN", f"pow({_OFFSETS[0]} / a, 2) + pow({_OFFSETS[1]} / b, 2) <= 1"),
    "int_div": ("a BIGINT, b BIGINT", "BIGINT", "CASE WHEN b <> 0 THEN a DIV b END"),
    "default_null": ("x DOUBLE, other DOUBLE", "DOUBLE", "coalesce(x, other)"),
    "middle": ("s STRING, start INT, length INT", "STRING", "CASE WHEN start <> 0 THEN substring(s, start, length) END"),
    "find": ("s STRING, part STRING", "INT", "nullif(instr(s, part), 0)"),
    "round_up_half": ("x DOUBLE", "DOUBLE", "CAST(floor(x + 0.5) AS DOUBLE)"),
}


def register(spark: SparkSession) -> None:
    for name, (parameters, result, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")


def rows_where(df: DataFrame, text: str) -> DataFrame:
    """Rows for which the text holds; NULL counts as no."""
    return df.where(text)


def calculated(df: DataFrame, **columns: str) -> DataFrame:
    """Columns made of texts, each on its own of the columns that were there."""
    return df.withColumns({name: F.expr(text) for name, text in columns.items()})


def result_type(df: DataFrame, text: str) -> str:
    """The type a text would have; an error where it doesn't fit the columns."""
    return df.select(F.expr(text)).schema.fields[0].dataType.simpleString()
