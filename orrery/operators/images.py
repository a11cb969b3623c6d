"""Images as pixel tables: i1, i2, ... from 1, and value."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pixels_of_cell(df: DataFrame, column: str, shape: tuple[int, ...], *keys: str) -> DataFrame:
    """The elements of a vector cell as pixels; the first index runs fastest."""
    flat = df.select(*keys, F.posexplode(column).alias("_at", "value"))
    places, step = [], 1
    for k, n in enumerate(shape):
        places.append((F.expr(f"(_at div {step}) % {n}") + 1).cast("int").alias(f"i{k + 1}"))
        step *= n
    return flat.select(*keys, *places, "value")


def to_tiles(pixels: DataFrame, width: int, height: int, *keys: str) -> DataFrame:
    """Pixels (i1, i2 from 1, value) of the images told apart by ``keys`` -> (keys, t1, t2, values): a row a tile, its pixels
    row after row, NULL where the tile has a gap. Stored as Parquet, tiles are compressed by its codecs."""
    tile = [F.expr(f"(i1 - 1) div {width}").cast("int").alias("t1"), F.expr(f"(i2 - 1) div {height}").cast("int").alias("t2")]
    at = F.expr(f"(i2 - 1) % {height} * {width} + (i1 - 1) % {width}").cast("int")
    held = pixels.groupBy(*keys, *tile).agg(F.map_from_entries(F.collect_list(F.struct(at, "value"))).alias("_m"))
    return held.select(*keys, "t1", "t2", F.transform(F.sequence(F.lit(0), F.lit(width * height - 1)), lambda i: F.try_element_at("_m", i)).alias("values"))


def of_tiles(tiles: DataFrame, width: int, height: int, *keys: str) -> DataFrame:
    """The pixels of tiles; gaps are left out."""
    flat = tiles.select(*keys, "t1", "t2", F.posexplode("values").alias("_at", "value")).where("value is not null")
    return flat.select(*keys, F.expr(f"t1 * {width} + _at % {width} + 1").cast("int").alias("i1"), F.expr(f"t2 * {height} + _at div {width} + 1").cast("int").alias("i2"), "value")


def parse_section(text: str, shape: tuple[int, ...]) -> list[tuple[int, int, int]]:
    """"2:20:3,*,-*" -> (first, last, step) of each axis, from 1, both ends included; first over last flips."""
    parts = [p.strip() for p in text.split(",")]
    if len(parts) != len(shape) or len(shape) > 4:
        raise ValueError(f"{text!r} doesn't fit {len(shape)} axes")
    out = []
    for part, n in zip(parts, shape, strict=True):
        if part in ("*", "-*"):
            first, last, step = (1, n, 1) if part == "*" else (n, 1, 1)
        elif m := re.fullmatch(r"(-?\*|\d+)(?::(\d+))?(?::(\d+))?", part):
            step = int(m[3] or (m[2] if m[1] in ("*", "-*") and m[2] else 1))
            first, last = (1, n) if m[1] == "*" else (n, 1) if m[1] == "-*" else (int(m[1]), int(m[2] or m[1]))
        else:
            raise ValueError(f"not a section: {part!r}")
        if not (1 <= first <= n and 1 <= last <= n and step > 0):
            raise ValueError(f"{part!r} is outside 1..{n}")
        out.append((first, last, step))
    return out


def section(df: DataFrame, text: str, shape: tuple[int, ...], axes: tuple[str, ...] | None = None) -> DataFrame:
    """A part of an image, numbered anew from 1."""
    axes = axes or tuple(f"i{k + 1}" for k in range(len(shape)))
    for axis, (first, last, step) in zip(axes, parse_section(text, shape), strict=True):
        at = F.col(axis) - first if first <= last else F.lit(first) - F.col(axis)
        df = df.where(F.col(axis).between(min(first, last), max(first, last)) & (at % step == 0)).withColumn(axis, (F.expr(f"({axis} - {first}) div {step}") if first <= last else F.expr(f"({first} - {axis}) div {step}")) + 1)
    return df


def combine(images: dict[str, DataFrame], value: Column, axes: tuple[str, ...] = ("i1", "i2")) -> DataFrame:
    """A pixel expression over several images, each known by its name; pixels meet by place."""
    named = [df.select(*axes, F.col("value").alias(name)) for name, df in images.items()]
    return reduce(lambda a, b: a.join(b, list(axes)), named).select(*axes, value.alias("value"))


def with_blank(df: DataFrame, blank: int) -> DataFrame:
    """Pixels that equal the blank value become NaN."""
    return df.withColumn("value", F.when(F.col("value") == blank, F.lit(float("nan"))).otherwise(F.col("value").cast("double")))
