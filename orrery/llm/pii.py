"""Personal data: patterns with checks, and terms that give protected entities away.

Base spans (code points, end exclusive) are e-mail addresses, IP addresses, card numbers that pass Luhn, and phone numbers:
leftmost matches of each pattern that do not overlap; matches that fail their check are dropped. The patterns are written
so that no text, however long, makes the matcher backtrack or recurse.

Information-theoretic part, over all documents. Protected entities are the values found, and secrets: runs of letters and
digits, 16 and more, with both in them, whose own characters carry at least ``SECRET_BITS`` bits (length times entropy).
A term (four letters or more) near an entity reveals it with P(entity | term) = documents that hold the term near it /
documents that hold the term, which is log2(P(entity | term) / P(entity)) bits of information. It may also reveal that some
entity of a kind stands there (key, password: never the same value twice). A term is disclosed where it stands near
the entity with at least ``support`` different texts before it and after it (for a kind: also near so many different values
of it) and reaches ``probability`` and ``bits``. Secrets become spans of kind ``secret``; occurrences of disclosed terms
spans of kind ``term``, generalised in the sanitised text, or ``tell``, removed there, from ``certain`` on.

Null text counts as empty: no spans, and the digest of no text. Repeated rows are treated each and count each. An empty
table gives no rows; other columns are ignored. Only SQL functions run on the executors.
"""

from __future__ import annotations

from functools import partial, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm.common import save, table, tidied

_LOCAL = "[A-Za-z0-9._%+-]"
#: In the order in which kinds are listed; possessive, and anchored where a run begins, so that each is found in one walk.
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9]){12,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for the pattern to be tried.
NEEDS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][0-9\x20-]{11}", "phone": r"\+[0-9]", "secret": r"[0-9][A-Za-z]|[A-Za-z][0-9]"}
SECRET = r"(?<![A-Za-z0-9])(?=[A-Za-z]*+[0-9])(?=[0-9]*+[A-Za-z])[A-Za-z0-9]{16,}+"
SECRET_BITS = 40.0
TERM = r"\p{L}{4,}+"
SPAN = "array<struct<kind:string,start:int,end:int,value:string>>"
MARKS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "secret": "[SECRET]", "term": "[TERM]", "tell": ""}


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    each = F.split(F.reverse(number), "(?<=.)(?=.)")
    doubled = F.transform(each, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", "").rlike(r"^([0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    n = F.char_length(digits(value))
    if kind == "card":
        return n.between(13, 19) & luhn(digits(value))
    return n.between(9, 15) if kind == "phone" else F.lit(True)


def located(text: Column, pattern: Column, kind: str) -> Column:
    """All matches of a pattern as SPAN, from the texts between them and their own lengths."""
    between, found = F.split(text, pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0))
    widths = F.zip_with(between, found, lambda b, m: F.struct(F.char_length(b).alias("b"), F.coalesce(F.char_length(m), F.lit(0)).alias("m"), m.alias("v")))
    empty = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("spans"))
    step = lambda a, x: F.struct(
        (a["at"] + x["b"] + x["m"]).alias("at"),
        F.when(x["v"].isNull(), a["spans"]).otherwise(F.array_append(a["spans"], F.struct(F.lit(kind).alias("kind"), (a["at"] + x["b"]).alias("start"), (a["at"] + x["b"] + x["m"]).alias("end"), x["v"].alias("value")))).alias("spans"),
    )
    return F.aggregate(widths, empty, step, lambda a: a["spans"])


def with_base(docs: DataFrame) -> DataFrame:
    """Adds base: SPAN of all kinds in the listed order, and whether the text has what any span needs (_some). A text that
    lacks what a pattern needs isn't searched for it."""
    none = F.array().cast(SPAN)
    docs = docs.withColumn("_some", F.col("text").rlike("[0-9@]"))
    for kind, pattern in PATTERNS.items():
        docs = docs.withColumn(f"_{kind}", F.when(F.col("_some") & F.col("text").rlike(NEEDS[kind]), located(F.col("text"), F.lit(pattern), kind)).otherwise(none))
    kept = [F.filter(f"_{k}", partial(lambda kind, s: valid(kind, s["value"]), k)) for k in PATTERNS]
    return docs.withColumn("base", F.when(F.col("_some"), F.concat(*kept)).otherwise(none)).drop(*(f"_{k}" for k in PATTERNS))


def bits(value: Column) -> Column:
    """Length times the entropy of a value's characters."""
    n = F.char_length(value).cast("double")
    held = lambda c: n - F.char_length(F.replace(value, c, F.lit("")))
    return F.aggregate(F.array_distinct(F.split(value, "(?<=.)(?=.)")), F.lit(0.0), lambda a, c: a - held(c) * F.log2(held(c) / n))


def with_secrets(based: DataFrame) -> DataFrame:
    """Adds secrets: SPAN of runs that carry enough bits and don't meet a base span."""
    fine = lambda s: (bits(s["value"]) >= SECRET_BITS) & ~meets(s, F.col("base"))
    found = F.when(F.col("_some") & F.col("text").rlike(NEEDS["secret"]), F.filter(located(F.col("text"), F.lit(SECRET), "secret"), fine))
    return based.withColumn("secrets", F.coalesce(found, F.array().cast(SPAN))).drop("_some")


def meets(span: Column, others: Column) -> Column:
    return F.exists(others, lambda b: (span["start"] < b["end"]) & (b["start"] < span["end"]))


def entity(span: Column) -> Column:
    """One value for the ways an entity is written."""
    return F.concat(span["kind"], F.lit(":"), F.when(span["kind"].isin("card", "phone"), digits(span["value"])).when(span["kind"] == "secret", span["value"]).otherwise(F.lower(span["value"])))


def terms_of(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), F.lower))


def with_hits(docs: DataFrame, terms: DataFrame, most: int = 2000, few: int = 16) -> DataFrame:
    """Adds hits: which of the distinct terms each text holds. Up to ``most`` terms go along with the plan; more are joined.
    Where they are ``few`` only texts that have one somewhere are taken apart into words."""
    known = [r[0] for r in terms.limit(most + 1).collect()]
    none = F.array().cast("array<string>")
    if len(known) <= most:
        held = F.array_intersect(terms_of(F.col("text")), F.lit(known)) if known else none
        if 0 < len(known) <= few:
            docs = docs.withColumn("_low", F.lower("text"))
            held = F.when(reduce(Column.__or__, [F.contains("_low", F.lit(t)) for t in known]), held).otherwise(none)
        return docs.withColumn("hits", held).drop("_low")
    rows = docs.withColumn("_row", F.monotonically_increasing_id())
    hits = rows.select("_row", F.explode(terms_of(F.col("text"))).alias("term")).join(terms, "term").groupBy("_row").agg(F.collect_set("term").alias("hits"))
    return rows.join(hits, "_row", "left").withColumn("hits", F.coalesce("hits", none)).drop("_row")


def disclosing_terms(based: DataFrame, docs: DataFrame, reach: int = 80, support: int = 3, probability: float = 0.5, bits: float = 3.0) -> DataFrame:
    """(term, disclosure): terms that give an entity, or a kind of them, away, with the highest P(entity | term)."""
    spans = F.concat("base", "secrets")
    held = save(based.where(F.size(spans) > 0).select(F.monotonically_increasing_id().alias("doc"), "text", spans.alias("spans")))
    near = held.select("doc", "text", F.explode("spans").alias("s"))
    # one character more on each side shows where a word is cut; a cut word is none
    before = F.substring("text", F.greatest(F.col("s.start") - reach - 1, F.lit(0)) + 1, F.least(F.col("s.start"), F.lit(reach + 1)))
    before = F.when(F.char_length(before) > reach, F.regexp_replace(before, r"^(\p{L}+|\P{L})", "")).otherwise(before)
    after = F.substring("text", F.col("s.end") + 1, F.lit(reach + 1))
    after = F.when(F.char_length(after) > reach, F.regexp_replace(after, r"(\p{L}++|\P{L})\z", "")).otherwise(after)
    sides = near.select("doc", entity(F.col("s")).alias("value"), F.concat("s.kind", F.lit(":")).alias("kind"), before.alias("l"), after.alias("r"))
    keyed = sides.select("doc", "value", F.explode(F.array("value", "kind")).alias("entity"), F.xxhash64("l").alias("lh"), F.xxhash64("r").alias("rh"), F.array_union(terms_of(F.col("l")), terms_of(F.col("r"))).alias("terms"))
    found = save(keyed.select("doc", "value", "entity", "lh", "rh", F.explode("terms").alias("term")))
    each = lambda c: F.count_distinct(c)
    counted = found.groupBy("term", "entity").agg(each("doc").alias("both"), F.least(each("lh"), each("rh")).alias("sides"), each("value").alias("values"))
    of_kind = F.col("entity").endswith(":")
    pairs = save(counted.where((F.col("sides") >= support) & (~of_kind | (F.col("values") >= support))))
    # documents that hold entities bound the count from below: a term too frequent among them can't reach the probability
    count = lambda rows, terms: with_hits(rows, terms).select(F.explode("hits").alias("term")).groupBy("term").agg(F.count("*").alias("n_term"))
    rare = count(held, pairs.select("term").distinct()).join(pairs, "term").where(F.col("both") >= probability * F.col("n_term"))
    pairs = save(rare.drop("n_term"))
    holding = count(docs, pairs.select("term").distinct())
    entities = keyed.groupBy("entity").agg(each("doc").alias("n_entity"))
    total = docs.count()
    p = F.col("both") / F.col("n_term")
    known = pairs.join(holding, "term").join(entities, "entity").withColumn("p", p).withColumn("info", F.log2(F.col("p") * total / F.col("n_entity")))
    return known.where((F.col("p") >= probability) & (F.col("info") >= bits)).groupBy("term").agg(F.max("p").alias("disclosure"))


def find(docs: DataFrame, certain: float = 0.9, **limits) -> DataFrame:
    """doc_id, text, base and extra spans. ``limits``: those of disclosing_terms."""
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    based = with_secrets(with_base(docs))
    terms = save(disclosing_terms(based, docs, **limits))
    whole = lambda t: F.concat(F.lit(r"(?iu)(?<!\p{L})"), t, F.lit(r"(?!\p{L})"))
    every = {}
    for kind, kept in (("term", F.col("disclosure") < certain), ("tell", F.col("disclosure") >= certain)):
        based = with_hits(based, terms.where(kept).select("term")).withColumnRenamed("hits", f"_{kind}")
        spans = F.flatten(F.transform(f"_{kind}", partial(lambda k, t: located(F.col("text"), whole(t), k), kind)))
        every[kind] = F.filter(spans, lambda s: ~meets(s, F.col("base")) & ~meets(s, F.col("secrets")))
    none = F.array().cast(SPAN)
    added = F.concat("secrets", *(F.when(F.size(f"_{k}") > 0, v).otherwise(none) for k, v in every.items()))
    return based.withColumn("extra", F.array_sort(added)).drop("secrets", "_term", "_tell")


def sanitise(found: DataFrame) -> DataFrame:
    """Adds sanitised: each span replaced by its kind's mark, which for terms that tell is nothing."""
    marks = F.create_map(*(F.lit(x) for kv in MARKS.items() for x in kv))
    spans = F.array_sort(F.concat("base", "extra"), lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["end"] - a["end"]))
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def put(a, s):
        new = F.concat(a["out"], F.substring(F.col("text"), a["at"] + 1, s["start"] - a["at"]), marks[s["kind"]])
        fits = s["start"] >= a["at"]
        return F.struct(F.when(fits, new).otherwise(a["out"]).alias("out"), F.when(fits, s["end"]).otherwise(a["at"]).alias("at"))

    done = F.aggregate(spans, start, put)
    replaced = F.concat("_done.out", F.substring("text", F.col("_done.at") + 1, F.char_length("text")))
    return found.withColumn("_done", F.when(F.size(spans) > 0, done)).withColumn("sanitised", F.coalesce(replaced, "text")).drop("_done")


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


@tidied
def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sanitise(find(table(spark, sf_dir, "documents")))
    of = lambda spans, *kinds: F.size(F.filter(spans, lambda s: s["kind"].isin(*kinds))).cast("long")
    counts = [of("base", k).alias(f"n_{k}") for k in PATTERNS] + [of("extra", "secret").alias("n_secret"), of("extra", "term", "tell").alias("n_term")]
    return found.select("doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.concat("base", "extra")).alias("spans"), F.sha2("sanitised", 256).alias("sanitised_sha256"))


@tidied
def pii_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op9: how many e-mail addresses and phone numbers a text holds."""
    found = with_base(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")))
    return found.select("doc_id", *(F.size(F.filter("base", partial(lambda kind, s: s["kind"] == kind, k))).cast("long").alias(f"n_{k}") for k in ("email", "phone")))


COUNTS_SQL = r"""
SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+')) AS n_email,
  len(list_filter(regexp_extract_all(coalesce(text, ''), '\+[0-9][\x20().0-9-]+[0-9]'), lambda p: length(regexp_replace(p, '[^0-9]', '', 'g')) BETWEEN 9 AND 15)) AS n_phone
FROM documents
"""
