"""Times in good intervals: a range join on dyadic buckets of time.

An interval is listed on one level, whose buckets are as wide as it is long or up to twice that, so under two buckets at most,
however long it is. A time falls in one bucket of each level that holds intervals; levels go by powers of two, so there
are few of them. Rows meet by an equi-join on level and bucket; both ends of an interval belong to it. Where all pairs are asked
for, buckets are an eighth as wide, so that few rows meet in vain, and an interval is listed in nine at most. Intervals that end before they start, or lack an end, hold nothing.

How many intervals hold a time, and the least of them, needs no pairs (``interval_totals``): an interval becomes the few
blocks of 4^k consecutive times that it covers, totals are taken by block, and each block hands its totals down to its four parts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.operators.rows import accumulate
from orrery.plans.tables import save

LEVELS = 40
#: Buckets are 2^FINER times narrower where pairs are made.
FINER = 3


def _listed(intervals: DataFrame, start: str, stop: str, finer: int = 0) -> tuple[DataFrame, Column | None]:
    """The intervals with _level and _bucket, and what a time (_at) falls in: an array of such pairs."""
    a, b = (F.col(c).cast("double") for c in (start, stop))
    fine = intervals.where(a <= b)
    length = b - a
    lo, hi, least = fine.agg(F.min(a), F.max(b), F.min(F.when(length > 0, length))).first()
    if lo is None:
        return fine.withColumns({"_level": F.lit(0), "_bucket": F.lit(0).cast("long")}), None
    unit = 2.0 ** math.ceil(math.log2(max(least or 0.0, (hi - lo) * 2.0**-LEVELS, max(abs(lo), abs(hi)) * 2.0**-52, 1e-300)))
    level = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(length, F.lit(unit)) / unit))).cast("int")
    width = F.pow(F.lit(2.0), F.col("_level") - finer) * unit
    placed = fine.withColumn("_level", level)
    levels = sorted(r[0] for r in placed.select("_level").distinct().collect())  # a few dozen at most
    listed = placed.withColumn("_bucket", F.explode(F.sequence(F.floor(a / width).cast("long"), F.floor(b / width).cast("long"))))
    falls = F.array(*(F.struct(F.lit(n).alias("level"), F.floor(F.col("_at") / (2.0 ** (n - finer) * unit)).cast("long").alias("bucket")) for n in levels))
    return listed, F.when(F.col("_at").between(lo, hi), falls)


def in_intervals(df: DataFrame, time: str, intervals: DataFrame, start: str = "start", stop: str = "stop", shift: float = 0.0, keep: bool = True) -> DataFrame:
    """Rows whose time (plus ``shift``) lies in some interval; ``keep`` False: in none. Distinct times are matched, then
    rows kept by their time."""
    listed, falls = _listed(intervals.select(F.col(start).alias("_start"), F.col(stop).alias("_stop")), "_start", "_stop")
    if falls is None:
        return df.limit(0) if keep else df
    rows = df.withColumn("_at", F.col(time).cast("double") + shift)
    times = rows.select("_at").distinct().select("_at", F.explode(falls).alias("_p")).select("_at", "_p.level", "_p.bucket")
    inside = (F.col("level") == F.col("_level")) & (F.col("bucket") == F.col("_bucket")) & F.col("_at").between(F.col("_start").cast("double"), F.col("_stop").cast("double"))
    held = times.join(listed, inside, "left_semi").select("_at").distinct()
    return rows.join(held, "_at", "left_semi" if keep else "left_anti").select(*df.columns)


def with_interval(df: DataFrame, time: str, intervals: DataFrame, start: str = "start", stop: str = "stop") -> DataFrame:
    """A row for each pair of a row and an interval that holds its time. The join is shuffled: repeated rows pack so well in files
    that Spark would broadcast millions of intervals."""
    listed, falls = _listed(intervals, start, stop, FINER)
    rows = df.withColumn("_at", F.col(time).cast("double"))
    if falls is None:
        return rows.join(listed, F.lit(False)).drop("_at", "_level", "_bucket")
    dealt = rows.withColumn("_p", F.explode(falls))
    inside = (F.col("_p.level") == F.col("_level")) & (F.col("_p.bucket") == F.col("_bucket")) & F.col("_at").between(F.col(start).cast("double"), F.col(stop).cast("double"))
    return dealt.join(listed.hint("merge"), inside).drop("_at", "_p", "_level", "_bucket")


def _spans(distinct: DataFrame, times: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Times (_at) with their place from 0 in time order, and intervals (_start, _stop) with _first and _end, the places of
    the first time they hold and of the one behind the last."""
    ends = [distinct.select(F.col(c).alias("_at"), F.lit(0).alias("_is_time")) for c in ("_start", "_stop")]
    values = times.withColumn("_is_time", F.lit(1)).union(ends[0]).union(ends[1]).groupBy("_at").agg(F.max("_is_time").alias("_is_time"))
    placed = save(accumulate(values, "_is_time", "_upto", ("_at",)))
    first = placed.select(F.col("_at").alias("_start"), (F.col("_upto") - F.col("_is_time")).alias("_first"))
    end = placed.select(F.col("_at").alias("_stop"), F.col("_upto").alias("_end"))
    spans = distinct.join(first.hint("merge"), "_start").join(end.hint("merge"), "_stop").where("_first < _end").drop("_start", "_stop")
    return placed.where("_is_time = 1").select("_at", (F.col("_upto") - 1).alias("_block")), spans


def _blocks() -> Column:
    """The blocks of 4^_level times that lie in _first .. _end - 1, but for those in a larger block that does."""
    up, down = (lambda c, bits, add=add: F.expr(f"shiftright({c} + {add.format(bits=bits)}, {bits})") for add in ("shiftleft(1L, {bits}) - 1", "0"))
    fine, coarse = "2 * _level", "2 * _level + 2"
    a, b, c, d = up("_first", fine), down("_end", fine), up("_first", coarse) * 4, down("_end", coarse) * 4
    run = lambda x, y: F.when(x < y, F.sequence(x, y - 1)).otherwise(F.array().cast("array<bigint>"))
    return F.when(c < d, F.concat(run(a, c), run(d, b))).otherwise(run(a, b))


def interval_totals(df: DataFrame, time: str, intervals: DataFrame, of: str, start: str = "start", stop: str = "stop", count: str = "n_intervals", least: str = "least") -> DataFrame:
    """Rows whose time some interval holds, with how many do and the least ``of`` among them. No pairs are made: work grows with
    times and intervals, by the logarithm of their number, not with how many intervals hold a time. Joins are shuffled:
    repeated rows pack so well in files that Spark would broadcast millions of them."""
    ends = (F.col(c).cast("double") for c in (start, stop))
    given = intervals.select(*(c.alias(n) for c, n in zip(ends, ("_start", "_stop"))), F.col(of).alias("_of")).where("_start <= _stop")
    total = lambda by, n, of: by.agg(F.sum(n).alias("_n"), F.min(of).alias("_of"))
    distinct = save(total(given.groupBy("_start", "_stop"), F.lit(1), "_of"))
    rows = df.withColumn("_at", F.col(time).cast("double"))
    places, spans = _spans(distinct, rows.select("_at").where("_at IS NOT NULL").distinct())
    spans = total(spans.groupBy("_first", "_end"), "_n", "_of")
    levels = F.sequence(F.lit(0), F.floor(F.log2(F.col("_end") - F.col("_first")) / 2).cast("int") + 1)  # the last holds none
    listed = spans.withColumn("_level", F.explode(levels)).withColumn("_block", F.explode(_blocks()))
    blocks = save(total(listed.groupBy("_level", "_block"), "_n", "_of"))
    held = None
    for level in range(blocks.agg(F.coalesce(F.max("_level"), F.lit(0))).first()[0], -1, -1):
        own = blocks.where(F.col("_level") == level).select("_block", "_n", "_of")
        if held is None:
            held = own
        else:
            parts = F.explode(F.sequence(F.col("_block") * 4, F.col("_block") * 4 + 3))
            held = total(held.select(parts.alias("_block"), "_n", "_of").union(own).groupBy("_block"), "_n", "_of")
    found = places.join(held.hint("merge"), "_block").select("_at", F.col("_n").alias(count), F.col("_of").alias(least))
    return rows.join(found.hint("merge"), "_at").drop("_at")
