"""Columns: choosing by name or pattern, renaming, attributes, stored and physical values, joining tables side by side."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def resolve(df: DataFrame, name: str) -> str:
    """A column by its exact name, else by its name without regard to case; two such are an error."""
    if name in df.columns:
        return name
    found = [c for c in df.columns if c.lower() == name.lower()]
    if len(found) == 1:
        return found[0]
    raise KeyError(f"{'ambiguous' if found else 'no'} column {name!r}")


def matching(df: DataFrame, pattern: str) -> list[str]:
    """Columns by pattern: * any text, ? one character, # digits; a column of that very name comes alone."""
    if exact := [c for c in df.columns if c.lower() == pattern.lower()]:
        return exact
    rx = "".join({"*": ".*", "?": ".", "#": r"\d+"}.get(ch, re.escape(ch)) for ch in pattern)
    return [c for c in df.columns if re.fullmatch(rx, c, re.I)]


def select_like(df: DataFrame, *patterns: str) -> DataFrame:
    chosen = list(dict.fromkeys(c for p in patterns for c in matching(df, p)))
    return df.select(*chosen)


def edit_columns(df: DataFrame, *, keep: list[str] = (), make: dict[str, Column] | None = None, rename: dict[str, str] | None = None, delete: list[str] = ()) -> DataFrame:
    """Column editing in one step. ``make`` and ``rename`` (new: old) run in order and later ones see earlier results. If
    anything is kept or made and nothing deleted, all other columns go."""
    wanted = [c for p in keep for c in matching(df, p)]
    for name, value in (make or {}).items():
        df = df.withColumn(name, value)
        wanted.append(name)
    for new, old in (rename or {}).items():
        old = resolve(df, old)
        if new in df.columns and new != old:
            raise ValueError(f"column {new!r} exists")
        df = df.withColumnRenamed(old, new)
        wanted.append(new)
    if gone := [c for p in delete for c in matching(df, p)]:
        return df.drop(*gone)
    return df.select(*dict.fromkeys(wanted)) if wanted else df


def fold_names(df: DataFrame, upper: bool = False) -> DataFrame:
    return df.toDF(*(c.upper() if upper else c.lower() for c in df.columns))


def with_attributes(df: DataFrame, column: str, **attributes) -> DataFrame:
    """Column attributes (unit, null, scale, zero, display, dim) as its metadata."""
    return df.withMetadata(column, {**df.schema[column].metadata, **attributes})


def describe(df: DataFrame) -> DataFrame:
    """A row a column: name, type and attributes."""
    rows = [(i, f.name, f.dataType.simpleString(), *(str(f.metadata[k]) if k in f.metadata else None for k in ("unit", "null", "scale", "zero", "dim"))) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "place int, name string, type string, unit string, null string, scale string, zero string, dim string")


def physical(x: Column, scale: float = 1.0, zero: float = 0.0) -> Column:
    """Stored value times scale, then plus zero."""
    return x.cast("double") * F.lit(scale) + F.lit(zero)


def stored(x: Column, scale: float = 1.0, zero: float = 0.0, whole: str | None = None) -> Column:
    """Back from a physical value; whole numbers are rounded half to even."""
    raw = (x - F.lit(zero)) / F.lit(scale)
    return F.bround(raw).cast(whole) if whole else raw


def rescale(df: DataFrame, column: str, bits: int) -> DataFrame:
    """Adds <column>_stored, scale and zero so that least and greatest value span whole numbers of so many bits."""
    lo, hi = df.agg(F.min(column).cast("double"), F.max(column).cast("double")).first()
    zero = None if lo is None else lo if bits == 8 else (hi + lo) / 2
    scale = None if lo is None else ((hi - lo) / (255 if bits == 8 else 2**bits - 2)) or 1.0
    both = df.withColumns({"zero": F.lit(zero).cast("double"), "scale": F.lit(scale).cast("double")})
    return both.withColumn(f"{column}_stored", F.bround((F.col(column) - F.col("zero")) / F.col("scale")).cast("long"))


def _blank(t: T.DataType) -> Column:
    if isinstance(t, T.StringType):
        return F.lit("")
    if isinstance(t, T.ArrayType):
        return F.array().cast(t)
    return F.lit(False) if isinstance(t, T.BooleanType) else F.lit(0).cast(t)


def merge_by_position(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two tables side by side by _row, as long as the longer one; what the shorter lacks is 0, false or empty, not NULL.
    Both need distinct names."""
    there = F.lit(True)
    both = a.withColumn("_a", there).join(b.withColumn("_b", there), "_row", "full")
    fill = lambda f, mark: F.when(F.col(mark), F.col(f.name)).otherwise(_blank(f.dataType)).alias(f.name)
    return both.select("_row", *(fill(f, "_a") for f in a.schema.fields if f.name != "_row"), *(fill(f, "_b") for f in b.schema.fields if f.name != "_row"))


def append(a: DataFrame, b: DataFrame, by_name: bool = True) -> DataFrame:
    """Rows of both, with the names and types of the first; columns that the second lacks are 0, false or empty."""
    there = {c.lower() for c in b.columns}
    source = {c: resolve(b, c) for c in a.columns if c.lower() in there} if by_name else dict(zip(a.columns, b.columns, strict=False))
    cols = [(F.col(source[f.name]).cast(f.dataType) if f.name in source else _blank(f.dataType)).alias(f.name) for f in a.schema.fields]
    return a.union(b.select(*cols))


def sum_of_same(df: DataFrame, *columns: str) -> Column:
    """The sum of the columns that stand for one parameter."""
    return reduce(lambda a, b: a + b, (F.col(c).cast("double") for c in columns))


def extremes(df: DataFrame, *columns: str) -> DataFrame:
    """One row: least and greatest of each column, NULL and NaN left out."""
    known = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c))
    return df.agg(*(x for c in columns for x in (F.min(known(c)).alias(f"{c}_min"), F.max(known(c)).alias(f"{c}_max"))))
