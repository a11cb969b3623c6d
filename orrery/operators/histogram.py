"""Histograms over one to four axes, dense, as one aggregation.

Limits are single-precision numbers. A whole-number column with whole limits has bins centred on whole numbers: limits move
out by a half and the last value has its bin. A limit taken from the data adds one bin at the top; a given upper limit of a
fractional axis is not in the last bin, which may be narrower than the others. A row that lacks any axis, or lies outside
on one, is left out. Weights are a column, or its reciprocal.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass
class Axis:
    column: str
    low: float | None = None
    high: float | None = None
    size: float | None = None


@dataclass
class Bins:
    column: str
    low: float
    size: float
    n: int
    top: float

    def index(self) -> Column:
        """The bin of a row, from 1; NULL outside."""
        at = (F.col(self.column).cast("float").cast("double") - self.low) / self.size
        i = F.floor(at).cast("long") + 1
        return F.when((at >= 0) & (at <= self.top) & (i >= 1) & (i <= self.n), i)


def resolve_axes(df: DataFrame, axes: list[Axis]) -> list[Bins]:
    """Limits and sizes of all axes; those that aren't given come from one pass over the data."""
    for a in axes:
        if not isinstance(df.schema[a.column].dataType, T.NumericType):
            raise TypeError(f"{a.column} is not a numeric scalar column")
    wanted = [a.column for a in axes if a.low is None or a.high is None]
    known = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    found = df.agg(*(x for c in dict.fromkeys(wanted) for x in (F.min(known(c)).alias(f"{c}_lo"), F.max(known(c)).alias(f"{c}_hi")))).first() if wanted else {}
    out = []
    for a in axes:
        kind = df.schema[a.column].dataType
        low = a.low if a.low is not None else found[f"{a.column}_lo"] or 0.0
        high = a.high if a.high is not None else found[f"{a.column}_hi"] or 0.0
        low, high = float(np.float32(low)), float(np.float32(high))
        size = float(np.float32(a.size if a.size is not None else min(1.0, (high - low) / 10) or 1.0))
        if size <= 0:
            raise ValueError("the bin size must be above 0")
        whole = isinstance(kind, T.IntegralType) and low == int(low) and high == int(high)
        if whole:
            n = int((high - low) / size) + 1
            low, top = low - 0.5, (high - low + 1) / size
        elif a.high is None:
            n = int((high - low) / size) + 1
            top = float(n)
        else:
            n = math.ceil((high - low) / size)
            top = (high - low) / size
        out.append(Bins(a.column, low, size, max(1, n), top))
    return out


def histogram(df: DataFrame, axes: list[Axis], weight: str | None = None, reciprocal: bool = False, condition: Column | None = None, dense: bool = True) -> DataFrame:
    """(bin1, ..., value): counts, or sums of weights. ``dense``: empty bins too, as 0."""
    if not 1 <= len(axes) <= 4:
        raise ValueError("one to four axes")
    if condition is not None:
        df = df.where(condition)
    bins = resolve_axes(df, axes)
    names = [f"bin{k + 1}" for k in range(len(axes))]
    value = F.count("*") if weight is None else F.sum(F.try_divide(F.lit(1.0), F.col(weight).cast("double")) if reciprocal else F.col(weight))
    counted = df.select(*(b.index().alias(n) for b, n in zip(bins, names, strict=True)), *([weight] if weight else [])).dropna(subset=names).groupBy(*names).agg(value.alias("value"))
    if not dense:
        return counted
    at, cells, grid = F.col("id"), 1, []
    for b, n in zip(bins, names, strict=True):
        grid.append((F.expr(f"(id div {cells}) % {b.n}") + 1).cast("long").alias(n))
        cells *= b.n
    zero = F.lit(0).cast(counted.schema["value"].dataType)
    return df.sparkSession.range(cells).select(*grid).join(counted, names, "left").withColumn("value", F.coalesce("value", zero))
