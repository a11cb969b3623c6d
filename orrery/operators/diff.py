"""Differences of tables, headers and images, as tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def differ(a: Column, b: Column, kind: T.DataType, tolerance: float = 0.0) -> Column:
    """Whether two values differ. Fractions: by more than ``tolerance`` times the second; NaN equals NaN."""
    if isinstance(kind, T.FractionalType):
        same = F.abs(a - b) <= F.abs(b) * tolerance
        return ~F.coalesce(same | (F.isnan(a) & F.isnan(b)) | (a == b), a.isNull() & b.isNull())
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FractionalType):
        return ~F.coalesce((F.size(a) == F.size(b)) & ~F.exists(F.zip_with(a, b, lambda x, y: differ(x, y, kind.elementType, tolerance)), lambda d: d), a.isNull() & b.isNull())
    return ~a.eqNullSafe(b)


def column_diff(a: DataFrame, b: DataFrame, ignore: tuple[str, ...] = ()) -> DataFrame:
    """(name, only_in, type_a, type_b) of columns that one table lacks or that have another type; names without case."""
    spark = a.sparkSession
    skip = {i.lower() for i in ignore}
    kinds = [{f.name.lower(): f.dataType.simpleString() for f in d.schema.fields if f.name.lower() not in skip} for d in (a, b)]
    rows = [(n, "a" if n not in kinds[1] else "b" if n not in kinds[0] else None, kinds[0].get(n), kinds[1].get(n)) for n in sorted({*kinds[0], *kinds[1]}) if kinds[0].get(n) != kinds[1].get(n)]
    return spark.createDataFrame(rows, "name string, only_in string, type_a string, type_b string")


def _paired(a: DataFrame, b: DataFrame, key: str, ignore: tuple[str, ...]) -> tuple[DataFrame, list]:
    """Rows of both by the key, with only_in (a, b, or null where both have it), and the fields that both have."""
    common = [f for f in a.schema.fields if f.name in b.columns and f.name != key and f.name not in ignore]
    side = lambda d, s: d.select(F.col(key).alias(f"_{s}_key"), F.lit(True).alias(f"_in_{s}"), *(F.col(f.name).alias(f"{s}_{f.name}") for f in common))
    both = side(a, "a").join(side(b, "b"), F.col("_a_key").eqNullSafe(F.col("_b_key")), "full")
    only = F.when(F.col("_in_b").isNull(), "a").when(F.col("_in_a").isNull(), "b")
    return both.withColumns({key: F.coalesce("_a_key", "_b_key"), "only_in": only}), common


def table_diff(a: DataFrame, b: DataFrame, key: str = "_row", tolerance: float = 0.0, ignore: tuple[str, ...] = ()) -> DataFrame:
    """(key, column_name, value_a, value_b, only_in) of every cell that differs, rows paired by the key (NULL keys with each
    other). A row that only one table has is one row, with ``only_in`` a or b and no column name."""
    both, common = _paired(a, b, key, ignore)
    text = lambda c: F.col(c).cast("string")
    cell = lambda name, x, y: F.struct(name.cast("string").alias("column_name"), x.cast("string").alias("value_a"), y.cast("string").alias("value_b"))
    cells = [F.when(differ(F.col(f"a_{f.name}"), F.col(f"b_{f.name}"), f.dataType, tolerance), cell(F.lit(f.name), text(f"a_{f.name}"), text(f"b_{f.name}"))) for f in common]
    none = F.lit(None)
    found = F.when(F.col("only_in").isNotNull(), F.array(cell(none, none, none))).otherwise(F.array_compact(F.array(*cells)) if cells else F.array().cast("array<struct<column_name:string,value_a:string,value_b:string>>"))
    return both.select(key, F.explode(found).alias("d"), "only_in").select(key, "d.*", "only_in")


def diff_summary(a: DataFrame, b: DataFrame, key: str = "_row", tolerance: float = 0.0, ignore: tuple[str, ...] = ()) -> DataFrame:
    """One row: cells and rows that differ, rows that only one table has, and the share of all cells of rows that both have
    that differ."""
    both, common = _paired(a, b, key, ignore)
    n = reduce(lambda x, y: x + y, (differ(F.col(f"a_{f.name}"), F.col(f"b_{f.name}"), f.dataType, tolerance).cast("long") for f in common), F.lit(0).cast("long"))
    rows = both.select(F.when(F.col("only_in").isNull(), n).alias("n"), "only_in")
    total = F.count("n") * len(common)
    return rows.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("cells_differ"), F.count_if(F.col("n") > 0).alias("rows_differ"), F.count_if(F.col("only_in") == "a").alias("rows_only_a"), F.count_if(F.col("only_in") == "b").alias("rows_only_b"), F.coalesce(F.try_divide(F.sum("n").cast("double"), total), F.lit(0.0)).alias("ratio"))


def header_diff(a: DataFrame, b: DataFrame, ignore: tuple[str, ...] = (), ignore_comments: bool = False) -> DataFrame:
    """(keyword, n, value_a, value_b, comment_a, comment_b, kind) of header cards, paired by keyword and occurrence, and by hdu
    (which the result then has too) where both have that column."""
    keys = [*(["hdu"] if "hdu" in a.columns and "hdu" in b.columns else []), "keyword", "n"]
    cards = lambda d, s: d.where(~F.upper("keyword").isin(*[i.upper() for i in ignore]) if ignore else F.lit(True)).select(*keys[:-2], F.upper("keyword").alias("keyword"), "n", F.col("value").alias(f"value_{s}"), F.col("comment").alias(f"comment_{s}"), F.lit(True).alias(f"_{s}"))
    both = cards(a, "a").join(cards(b, "b"), keys, "full")
    kind = F.when(F.col("_a").isNull(), "only in b").when(F.col("_b").isNull(), "only in a").when(~F.col("value_a").eqNullSafe(F.col("value_b")), "value")
    kind = kind if ignore_comments else kind.when(~F.col("comment_a").eqNullSafe(F.col("comment_b")), "comment")
    return both.withColumn("kind", kind).where("kind is not null").drop("_a", "_b")


def image_diff(a: DataFrame, b: DataFrame, axes: tuple[str, ...] = ("x", "y"), tolerance: float = 0.0) -> DataFrame:
    """Pixels that differ; a pixel that one image lacks differs."""
    both = a.withColumnRenamed("value", "value_a").join(b.withColumnRenamed("value", "value_b"), list(axes), "full")
    return both.where(differ(F.col("value_a"), F.col("value_b"), a.schema["value"].dataType, tolerance))
