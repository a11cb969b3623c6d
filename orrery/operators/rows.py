"""Row order: numbers, positions, offsets, running sums.

A table's order is given by key columns. Rows are dealt by key ranges and numbered within a range; ranges are then shifted
by the counts before them, so that no task ever holds all rows. ``_row`` counts from 1.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.plans.tables import save


def _ranged(df: DataFrame, keys: list[str]) -> DataFrame:
    """The table in key ranges, with the range's number; saved, as ranges may fall otherwise another time."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return save(df.repartitionByRange(n, *keys).withColumn("_range", F.spark_partition_id()))


def with_row(df: DataFrame, *keys: str) -> DataFrame:
    """Adds _row by the order of the keys."""
    ranged = _ranged(df, list(keys))
    counts = ranged.groupBy("_range").count()
    before = counts.select("_range", (F.sum("count").over(Window.orderBy("_range")) - F.col("count")).alias("_before"))  # a row a range
    local = F.row_number().over(Window.partitionBy("_range").orderBy(*keys))
    return ranged.withColumn("_row", local.cast("long")).join(F.broadcast(before), "_range").withColumn("_row", F.col("_row") + F.col("_before")).drop("_range", "_before")


def offset(df: DataFrame, column: str, by: int, name: str, missing=None, block: int = 65536, most: int = 1_000_000) -> DataFrame:
    """Adds the value of the row ``by`` rows on (back if negative); beyond the table's ends, or where no such row is,
    ``missing``. Rows meet in blocks of consecutive numbers: a block holds copies of the rows beyond its end that it asks
    for, so the table is shuffled once. Offsets beyond ``most`` rows meet by a join."""
    if abs(by) > most:
        other = df.select((F.col("_row") - by).alias("_row"), F.col(column).alias("_v"), F.lit(True).alias("_there"))
        return df.join(other, "_row", "left").withColumn(name, F.when(F.col("_there"), F.col("_v")).otherwise(F.lit(missing))).drop("_v", "_there")
    size = max(block, 8 * abs(by))
    of = lambda row: F.floor((row - 1) / F.lit(size)).cast("long")
    mine = df.withColumns({"_block": of(F.col("_row")), "_copy": F.lit(False)})
    asked = df.withColumns({"_block": of(F.col("_row") - by), "_copy": F.lit(True)}).where(F.col("_block") != of(F.col("_row")))
    beside = Window.partitionBy("_block").orderBy("_row").rangeBetween(by, by)
    there = F.count(F.lit(1)).over(beside) > 0
    found = mine.union(asked).withColumn(name, F.when(there, F.first(column).over(beside)).otherwise(F.lit(missing)))
    return found.where(~F.col("_copy")).drop("_block", "_copy")


def accumulate(df: DataFrame, column: str, name: str, keys: tuple[str, ...] = ("_row",)) -> DataFrame:
    """Adds the running sum; NULL adds nothing, and the sum is never NULL."""
    ranged = _ranged(df, list(keys))
    value = F.coalesce(F.col(column), F.lit(0))
    totals = ranged.groupBy("_range").agg(F.sum(value).alias("_total"))
    before = totals.select("_range", (F.sum("_total").over(Window.orderBy("_range")) - F.col("_total")).alias("_before"))
    local = F.sum(value).over(Window.partitionBy("_range").orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0))
    return ranged.withColumn("_local", local).join(F.broadcast(before), "_range").withColumn(name, F.col("_local") + F.col("_before")).drop("_range", "_local", "_before")


def accumulate_vectors(df: DataFrame, column: str, name: str, keys: tuple[str, ...] = ("_row",)) -> DataFrame:
    """Adds the running sum over the elements of a vector column, on from row to row; NULL elements add nothing."""
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda a, x: a + F.coalesce(x.cast("double"), F.lit(0.0)))
    summed = accumulate(df.withColumn("_sum", F.coalesce(total(F.col(column)), F.lit(0.0))), "_sum", "_end", keys)
    start = F.struct(F.array().cast("array<double>").alias("v"), (F.col("_end") - F.col("_sum")).alias("s"))
    step = lambda a, x: F.struct(F.array_append(a["v"], a["s"] + F.coalesce(x.cast("double"), F.lit(0.0))).alias("v"), (a["s"] + F.coalesce(x.cast("double"), F.lit(0.0))).alias("s"))
    return summed.withColumn(name, F.aggregate(column, start, step, lambda a: a["v"])).drop("_sum", "_end")


def difference(df: DataFrame, column: str, name: str) -> DataFrame:
    """Adds the step from the row before; the first row's step is from 0, a step from or to NULL is NULL."""
    shifted = offset(df, column, -1, "_prev")
    return shifted.withColumn(name, F.when(F.col("_row") == 1, F.col(column)).otherwise(F.col(column) - F.col("_prev"))).drop("_prev")


def parse_ranges(text: str) -> list[tuple[int, int | None]]:
    """"1-5,9,20-" -> [(1, 5), (9, 9), (20, None)]."""
    out: list[tuple[int, int | None]] = []
    for part in (p.strip() for p in text.split(",")):
        m = re.fullmatch(r"(\d*)\s*(-?)\s*(\d*)", part)
        if not part or not m or not (m[1] or m[2]):
            raise ValueError(f"not a row range: {part!r}")
        low = int(m[1] or 1)
        high = int(m[3]) if m[3] else (None if m[2] else low)
        if high is not None and high < low or low < 1:
            raise ValueError(f"not a row range: {part!r}")
        out.append((low, high))
    return out


def in_ranges(text: str) -> Column:
    row = F.col("_row")
    return reduce(lambda a, b: a | b, ((row >= low) if high is None else row.between(low, high) for low, high in parse_ranges(text)))


def take_rows(df: DataFrame, start: int | None = None, stop: int | None = None, step: int = 1) -> DataFrame:
    """Rows start, start + step, ... before stop, counted from 0 as in a slice of a list."""
    at, low = F.col("_row") - 1, start or 0
    cond = (at >= low) & ((at - low) % step == 0)
    return df.where(cond if stop is None else cond & (at < stop))


def pick_rows(df: DataFrame, rows: list[int]) -> DataFrame:
    """Rows by number in the order of the list, which _place tells."""
    wanted = df.sparkSession.createDataFrame(list(enumerate(rows)), "_place long, _row long")
    return df.join(wanted, "_row")


def delete_rows(df: DataFrame, ranges: str) -> DataFrame:
    return df.where(~in_ranges(ranges))


def insert_rows(df: DataFrame, new: DataFrame, after: int) -> DataFrame:
    """The rows of ``new`` (numbered too) behind row ``after``, and all numbers anew; columns go by name."""
    n = new.count()
    moved = df.withColumn("_row", F.when(F.col("_row") > after, F.col("_row") + n).otherwise(F.col("_row")))
    return moved.unionByName(new.withColumn("_row", F.col("_row") + after))


def calculate_on_rows(df: DataFrame, column: str, value: Column, ranges: str) -> DataFrame:
    """The column with new values in some rows."""
    return df.withColumn(column, F.when(in_ranges(ranges), value).otherwise(F.col(column)))


def flags(df: DataFrame, condition: Column, name: str = "flag") -> DataFrame:
    """Adds whether the condition holds; NULL counts as no."""
    return df.withColumn(name, F.coalesce(condition, F.lit(False)))


def first_match(df: DataFrame, condition: Column) -> DataFrame:
    """One row: the number of the first row where the condition holds, 0 if none."""
    return df.where(condition).agg(F.coalesce(F.min("_row"), F.lit(0)).cast("long").alias("first_row"))
