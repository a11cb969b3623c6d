"""Document fingerprints: a threshold-scaled sketch of word shingles.

A sketch keeps every shingle hash below a fixed fraction of the hash range, and the least hash of all so that a short
text has one too. Sketches of parts merge by union, and containment of a small document in a large one is estimated from
the hashes both could hold. Shingles are five words `[^\\x20\\x09-\\x0D]+` of the A-Z lower-cased text; fewer words give
their whole sequence as one shingle.

Null text counts as empty; a text without words has an empty sketch, and two such are alike (1.0), one such and another
are not (0.0). Repeated rows are fingerprinted each, in a fixed order (rows of one id by their text's hash; a null id
comes last). An empty table gives no rows; other columns are ignored. Only SQL functions run on the executors.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.llm.common import table, tidied

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FRACTION, WORDS = 1 / 8, 5


def with_sketch(df: DataFrame, text: str, name: str, fraction: float = FRACTION, k: int = WORDS) -> DataFrame:
    """Adds the sorted sketch of a text column as array<long>."""
    limit = -(2**63) + int(fraction * 2**64) - 1
    words = F.filter(F.split(F.translate(text, UPPER, LOWER), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    df = df.withColumn("_w", F.transform(words, lambda w: F.xxhash64(w)))
    n = F.size("_w")
    at = lambda i: F.xxhash64(*(F.get("_w", i + j) for j in range(k)))
    many = F.transform(F.sequence(F.lit(0), n - k), at)
    df = df.withColumn("_h", F.when(n >= k, many).when(n > 0, F.array(F.xxhash64(F.lit(k), "_w"))).otherwise(F.array().cast("array<bigint>")))
    low = F.filter("_h", lambda h: h <= F.lit(limit))
    least = F.when(F.size("_h") > 0, F.array(F.array_min("_h"))).otherwise(F.array().cast("array<bigint>"))
    return df.withColumn(name, F.array_sort(F.array_union(low, least))).drop("_w", "_h")


def as_text(sketch: str) -> Column:
    return F.array_join(F.transform(sketch, F.hex), ".")


def merge(a: str, b: str) -> Column:
    """The sketch of both texts together: the least hash stays the least of all, the others are below the fraction."""
    return F.array_sort(F.array_union(a, b))


def likeness(a: str, b: str) -> Column:
    """Containment of the smaller sketch in the larger one, 0 to 1."""
    less = F.least(F.size(a), F.size(b))
    return F.when(less > 0, F.size(F.array_intersect(a, b)) / less).otherwise((F.size(a) == F.size(b)).cast("double"))


def predecessors(keys: DataFrame, n: int, most: int = 4096) -> DataFrame:
    """Distinct longs k -> (k, prev): the next lower key, and for the lowest the highest. Keys beyond ``most`` are linked in
    groups of about a thousand, and the groups' own keys in the same way."""
    if n <= most:
        w = Window.orderBy(F.desc("k"))
        return keys.select("k", F.coalesce(F.lead("k").over(w), F.first("k").over(w)).alias("prev"))
    grouped = keys.withColumn("g", F.expr("k div 1024"))
    heads = grouped.groupBy("g").agg(F.max("k").alias("head"))
    links = predecessors(heads.select(F.col("g").alias("k")), heads.count(), most)
    after = links.join(heads, F.col("prev") == F.col("g")).select(F.col("k").alias("g"), "head")
    inside = grouped.withColumn("inside", F.lead("k").over(Window.partitionBy("g").orderBy(F.desc("k"))))
    return inside.join(after, "g").select("k", F.coalesce("inside", "head").alias("prev"))


def ranges(docs: DataFrame, rows: int, most: int = 16384, salts: int = 1024) -> tuple:
    """The step that adds each row's place among the bounds, the row's range (higher ids, higher ranges), and how many
    ranges there may be. Bounds are quantiles, so ranges hold about ``rows`` rows each, or n / ``most``, however ids are
    spread. An id that fills ranges by itself is split by its texts' hashes."""
    n, nulls = docs.agg(F.count("*"), F.count_if(F.col("doc_id").isNull())).first()
    m = min(most, max(1, n // rows))
    bounds = docs.stat.approxQuantile("doc_id", [i / m for i in range(1, m)], 1 / m) if m > 1 and n > nulls else []
    splits = [float("-inf"), *sorted(set(bounds) or {0.0}), float("inf")]
    hot = sorted({int(x) for x, y in zip(bounds, bounds[1:]) if x == y})
    # splits are doubles; so are the ids looked up in them, and ids that are one double are in one range
    place = Bucketizer(splits=splits, inputCol="_id", outputCol="_place", handleInvalid="keep").transform
    # what comes later in the order has a lower range: higher ids than the hot one, its rows by hash, lower ids; null ids last
    bits = salts.bit_length() - 1
    by_hash = -1 - (F.shiftright("_tie", 64 - bits) + salts // 2)
    own = F.lit(0)
    if hot:
        at = F.element_at(F.create_map(*(F.lit(v) for i, h in ((sum(s <= h for s in splits) - 1, h) for h in hot) for v in (i, h))), F.col("_place").cast("int"))
        own = F.when(at.isNull() | (F.col("doc_id") > at), 0).when(F.col("doc_id") == at, by_hash).otherwise(-1 - salts)
    own = F.when(F.col("doc_id").isNull(), by_hash if nulls * m > 2 * n else F.lit(0)).otherwise(own)
    key = F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(F.col("_place") + 1).cast("long") * (4 * salts) + own
    return place, key, len(splits) + salts * (len(hot) + 1)


def with_next(docs: DataFrame, rows: int = 256) -> DataFrame:
    """doc_id, text, sketch, and next_text, next_sketch of the next document by descending doc_id; after the last comes
    the first. Documents meet in ranges of ids that hold about ``rows`` each, so texts are shuffled once; what stands
    first in a range is found apart, before the shuffle, and ranges are linked by their keys alone."""
    place, key, n = ranges(docs, rows)
    found = place(docs.select("doc_id", "text", F.xxhash64("text").alias("_tie"), F.coalesce(F.col("doc_id").cast("double"), F.lit(0.0)).alias("_id")))
    placed = found.select("doc_id", "text", key.alias("range"), F.col("_tie").alias("tie"))
    links = predecessors(placed.select(F.col("range").alias("k")).distinct(), n)
    w = Window.partitionBy("range").orderBy(F.desc_nulls_last("doc_id"), "tie")
    ranked = with_sketch(placed, "text", "sketch").withColumns({f"lead_{c}": F.lead(c).over(w) for c in ("text", "sketch")})
    heads = with_sketch(placed.withColumn("rn", F.row_number().over(w)).where("rn = 1"), "text", "head_sketch")
    after = heads.select(F.col("range").alias("prev"), F.col("text").alias("head_text"), "head_sketch").join(links, "prev").withColumn("range", F.col("k")).drop("k", "prev")
    both = ranked.join(after, "range", "left")
    return both.select("doc_id", "text", "sketch", *(F.coalesce(f"lead_{c}", f"head_{c}").alias(f"next_{c}") for c in ("text", "sketch")))


def edited(docs: DataFrame, rows: int = 256) -> DataFrame:
    """doc_id, n_chars, edited text, and the sketches of the text, the edited text and the next document's."""
    df = with_next(docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")), rows)
    df = df.withColumn("n_chars", F.char_length("text").cast("long"))
    third = F.floor(F.col("n_chars") / 3).cast("int")
    kept = F.substring("text", F.lit(1), F.col("n_chars").cast("int") - third)
    df = df.withColumn("edited", F.concat(kept, F.substring("next_text", F.lit(1), third)))
    return with_sketch(df.drop("text", "next_text"), "edited", "edited_sketch")


@tidied
def op6_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = edited(table(spark, sf_dir, "documents"))
    return df.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), as_text("sketch").alias("fingerprint"), as_text("edited_sketch").alias("edited_fingerprint"), likeness("sketch", "edited_sketch").alias("near_edited"), likeness("sketch", "next_sketch").alias("near_next"))


@tidied
def fingerprint_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op6: the edited texts."""
    return edited(table(spark, sf_dir, "documents")).select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"))


EDITS_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT doc_id, t, coalesce(lead(t) OVER (ORDER BY doc_id DESC), first_value(t) OVER (ORDER BY doc_id DESC)) AS next FROM d)
SELECT doc_id, length(t) AS n_chars, sha256(substring(t, 1, length(t) - length(t) // 3) || substring(next, 1, length(t) // 3)) AS edited_sha256 FROM n
"""
