"""Headers as tables of cards: hdu, place, keyword, n (occurrence from 0), value, comment."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COMMENTARY = ("COMMENT", "HISTORY", "")


def is_keyword(keyword: str) -> Column:
    return F.upper("keyword") == keyword.upper()


def select_cards(header: DataFrame, pattern: str) -> DataFrame:
    """Cards by keyword pattern: * and ... any text, ? one character."""
    rx = "".join({"*": ".*", "?": ".", "\0": ".*"}.get(c, re.escape(c)) for c in pattern.upper().replace("...", "\0"))
    return header.where(F.upper("keyword").rlike(f"^{rx}$"))


def value_of(header: DataFrame, hdu: int, keyword: str, n: int = 0) -> str | None:
    """One card's value as text; KeyError where there is no such card."""
    row = header.where((F.col("hdu") == hdu) & is_keyword(keyword) & (F.col("n") == n)).select("value").first()
    if row is None:
        raise KeyError(keyword)
    return row[0]


def numbered(header: DataFrame) -> DataFrame:
    """Places and occurrences anew, in order of place; a header is small, so one task for each of them."""
    unit = Window.partitionBy("hdu").orderBy("place")
    same = Window.partitionBy("hdu", F.upper("keyword")).orderBy("place")
    return header.withColumn("n", (F.row_number().over(same) - 1).cast("int")).withColumn("place", (F.row_number().over(unit) - 1).cast("int"))


def set_card(header: DataFrame, hdu: int, keyword: str, value, comment: str | None = None, n: int = 0) -> DataFrame:
    """A new value for a card, or a new card at the end where there is none."""
    mine = (F.col("hdu") == hdu) & is_keyword(keyword) & (F.col("n") == n)
    changed = header.withColumn("value", F.when(mine, F.lit(str(value))).otherwise(F.col("value"))).withColumn("comment", F.when(mine & F.lit(comment is not None), F.lit(comment)).otherwise(F.col("comment")))
    if not header.where(mine).isEmpty():
        return changed
    return append_card(header, hdu, keyword, value, comment or "")


def append_card(header: DataFrame, hdu: int, keyword: str, value, comment: str = "") -> DataFrame:
    """Commentary longer than 72 characters takes several cards."""
    text = str(value)
    pieces = [text[i : i + 72] for i in range(0, max(1, len(text)), 72)] if keyword.upper() in COMMENTARY else [text]
    last = header.where(F.col("hdu") == hdu).agg(F.coalesce(F.max("place"), F.lit(-1))).first()[0]
    new = header.sparkSession.createDataFrame([(hdu, last + 1 + i, keyword.upper(), 0, p, comment) for i, p in enumerate(pieces)], header.schema)
    return numbered(header.union(new))


def delete_cards(header: DataFrame, hdu: int, pattern: str) -> DataFrame:
    gone = select_cards(header.where(F.col("hdu") == hdu), pattern).select("hdu", "place")
    return numbered(header.join(gone, ["hdu", "place"], "left_anti"))


def rename_keyword(header: DataFrame, hdu: int, old: str, new: str) -> DataFrame:
    if new.upper() not in COMMENTARY and not header.where((F.col("hdu") == hdu) & is_keyword(new)).isEmpty():
        raise ValueError(f"keyword {new!r} exists")
    return numbered(header.withColumn("keyword", F.when((F.col("hdu") == hdu) & is_keyword(old), F.lit(new.upper())).otherwise(F.col("keyword"))))


def counts(header: DataFrame) -> DataFrame:
    return header.groupBy("hdu", F.upper("keyword").alias("keyword")).agg(F.count("*").alias("n_cards"))


def verify(header: DataFrame) -> DataFrame:
    """(hdu, place, keyword, check) of cards that break a rule of the format."""
    required = F.col("keyword").isin("SIMPLE", "XTENSION", "BITPIX", "NAXIS")
    checks = F.array_compact(F.array(
        F.when(~F.col("keyword").rlike(r"^[A-Z0-9_-]{0,8}$") & ~F.col("keyword").contains(" "), "keyword characters"),
        F.when(required & F.col("value").isNull(), "value missing"),
        F.when((F.col("keyword") == "BITPIX") & ~F.col("value").isin("8", "16", "32", "64", "-32", "-64"), "BITPIX value"),
        F.when(F.col("keyword").rlike(r"^NAXIS\d*$") & ~F.coalesce(F.col("value").rlike(r"^\d+$"), F.lit(False)), "NAXIS value"),
        F.when((F.col("place") == 0) & ~F.col("keyword").isin("SIMPLE", "XTENSION"), "first card"),
        F.when(required & (F.col("n") > 0), "twice"),
        F.when(~F.coalesce(F.col("value"), F.lit("")).rlike(r"^[\x20-\x7E]*$"), "characters"),
    ))
    return header.select("hdu", "place", "keyword", F.explode(checks).alias("check"))
