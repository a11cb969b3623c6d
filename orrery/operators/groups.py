"""Grouping tables (group_id, member), checksums, housekeeping series, image statistics."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.operators.rows import _ranged
from orrery.plans.tables import save


def merge_groups(a: DataFrame, b: DataFrame) -> DataFrame:
    """Members of both; those that are there already are left out."""
    return a.select("group_id", "member").union(b.select("group_id", "member")).dropDuplicates()


def remove_members(groups: DataFrame, gone: DataFrame) -> DataFrame:
    return groups.join(gone, gone.columns, "left_anti")


def members_of(groups: DataFrame, catalog: DataFrame, key: str) -> DataFrame:
    """Group members with their catalog rows."""
    return groups.join(catalog.withColumnRenamed(key, "member"), "member")


def compact_groups(groups: DataFrame) -> DataFrame:
    """One level flatter: members that are groups are replaced by their own members."""
    inner = groups.select(F.col("group_id").alias("member"), F.col("member").alias("inner_member"))
    return groups.join(inner, "member", "left").select("group_id", F.coalesce("inner_member", "member").alias("member")).dropDuplicates()


def all_members(groups: DataFrame, most_depth: int = 64) -> DataFrame:
    """Members of members, to the end; cycles end as nothing new is found. A round follows only what the round before found; its
    joins are shuffled, as a broadcast in every round would send the groups to the driver each time."""
    edges = save(groups.select("group_id", "member").dropDuplicates())
    step = edges.select(F.col("group_id").alias("member"), F.col("member").alias("next")).hint("merge")
    found = [edges]
    for _ in range(most_depth):
        further = found[-1].join(step, "member").select("group_id", F.col("next").alias("member")).dropDuplicates()
        known = reduce(DataFrame.union, found)
        there = known.select(F.col("group_id").alias("_g"), F.col("member").alias("_m")).hint("merge")
        new = save(further.join(there, F.col("group_id").eqNullSafe(F.col("_g")) & F.col("member").eqNullSafe(F.col("_m")), "left_anti"))
        if new.isEmpty():
            return known
        found.append(new)
    raise RuntimeError("groups are nested too deeply")


def folded_sum(word: Column) -> Column:
    """Aggregate: the 32-bit ones' complement sum of words 0 .. 2^32-1. Any order and any partial sums give the same."""
    total = F.sum(word.cast("decimal(20,0)"))
    top = F.lit(4294967295).cast("decimal(20,0)")
    rest = total % top
    return F.when(total.isNull(), 0).when((rest == 0) & (total > 0), 4294967295).otherwise(rest).cast("long")


def words_of(data: Column) -> Column:
    """The big-endian 32-bit words of bytes, the last filled up with zeros."""
    hexed = F.hex(data)
    n = F.ceil(F.char_length(hexed) / 8).cast("int")
    word = lambda i: F.conv(F.rpad(F.substring(hexed, i * 8 + 1, F.lit(8)), 8, "0"), 16, 10).cast("long")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), word)).otherwise(F.array().cast("array<bigint>"))


def carry_forward(df: DataFrame, columns: list[str], *keys: str) -> DataFrame:
    """NULLs take the last value before them in key order. Ranges of keys are filled each, then from the ranges before."""
    ranged = _ranged(df, list(keys))
    place = F.struct(*keys)
    ends = ranged.groupBy("_range").agg(*(F.max_by(F.col(c), F.when(F.col(c).isNotNull(), place)).alias(c) for c in columns))
    w = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = ends.select("_range", *(F.last(c, ignorenulls=True).over(w).alias(f"_before_{c}") for c in columns))  # a row a range
    local = Window.partitionBy("_range").orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
    filled = ranged.withColumns({c: F.last(c, ignorenulls=True).over(local) for c in columns}).join(F.broadcast(before), "_range")
    return filled.withColumns({c: F.coalesce(c, f"_before_{c}") for c in columns}).select(*df.columns)


def housekeeping(df: DataFrame, time: str, parameter: str, value: str, parameters: list[str]) -> DataFrame:
    """A row a time with a column a parameter; one that isn't reported at a time keeps its last value. Of several values of a
    parameter at one time the greatest counts."""
    wide = df.groupBy(time).pivot(parameter, parameters).agg(F.max(value))
    return carry_forward(wide, parameters, time)


def image_stats(df: DataFrame, pixels: str) -> DataFrame:
    """Adds n_good, mean and sigma of each row of pixels, and its noise from medians of differences of first, third and
    fifth order."""
    known = F.filter(F.transform(F.col(pixels), lambda v: v.cast("double")), lambda v: v.isNotNull() & ~F.isnan(v))
    n = F.size("_v")
    total = F.aggregate("_v", F.lit(0.0), lambda a, v: a + v)
    mean = F.when(n > 0, total / n)

    def noise(weights: tuple[int, ...], gap: int) -> Column:
        reach = gap * (len(weights) - 1)
        at = lambda i: F.abs(sum((F.get("_v", i + gap * k) * w for k, w in enumerate(weights)), F.lit(0.0)))
        steps = F.sort_array(F.transform(F.sequence(F.lit(0), n - reach - 1), at))
        norm = 1.482602 / math.sqrt(sum(w * w for w in weights))
        return F.when(n > reach, F.get(steps, F.floor((F.size(steps) - 1) / 2).cast("int")) * norm)

    squares = F.aggregate("_v", F.lit(0.0), lambda a, v: a + (v - F.col("mean")) * (v - F.col("mean")))
    out = df.withColumn("_v", known).withColumns({"n_good": n, "mean": mean})
    return out.withColumns({"sigma": F.when(n > 0, F.sqrt(squares / n)), "noise1": noise((1, -1), 1), "noise3": noise((-1, 2, -1), 2), "noise5": noise((1, -4, 6, -4, 1), 2)}).drop("_v")
