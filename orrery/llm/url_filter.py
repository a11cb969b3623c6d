"""URL filter: allow and block rules, and gradient-boosted trees on lexical features for URLs without a rule.

Host: what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased. Path: from there up to ``?``,
``#`` or the end. A null URL, or one without ``://``, has an empty host and path. A rule ``host/path`` fits its host and
all subdomains where the URL's path starts with the rule's; the longest rule that fits decides.

Suffix statistics are how common a suffix is and what share of the URLs with it are blocked, counted over the hosts of the
other half (by the hosts' hash; over all suffixes where it has none): so no label can be read from its own statistics. The trees learn from labelled URLs: a bounded sample of those that rules decide (``sample`` of each verdict at most, by
the hash of page_id). As rules speak of few hosts, as many undecided URLs join them as weak examples of allow
(``weak`` is their weight), so that a URL is blocked only where it looks more like blocked ones than like the rest.
Where no URL is blocked, or none is not, the others get ``default``. Repeated rows are judged each; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm.common import save, small, table, tidied

RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = ("url_length", "host_length", "path_length", "depth", "labels", "digit_ratio", "letter_ratio", "hyphens", "params", "query_length", "has_fragment", "secure", "entropy", "longest_label", "suffix_share", "suffix_blocked", "ending_share")


def with_parts(urls: DataFrame) -> DataFrame:
    """Adds host and path."""
    url = F.coalesce("url", F.lit(""))
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return urls.withColumns({"host": F.translate(host, UPPER, LOWER), "path": F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)})


def rule_of(rules) -> Column:
    """The longest of the rules that fits host and path, as struct<rule, verdict>; else null. Rules are a short list given
    with the call, so one expression holds them."""
    tests = []
    for rule, verdict in sorted(rules, key=lambda r: -len(r[0])):
        host, path = rule.split("/", 1)
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith("/" + path)
        tests.append(F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.coalesce(*tests)


def entropy(text: Column) -> Column:
    """Shannon entropy of a text's characters, in bits."""
    n = F.char_length(text).cast("double")
    share = lambda c: (F.char_length(text) - F.char_length(F.replace(text, c, F.lit("")))) / n
    return F.when(n > 0, F.aggregate(F.array_distinct(F.split(text, "")), F.lit(0.0), lambda a, c: a - F.when(c == "", 0.0).otherwise(share(c) * F.log2(share(c))))).otherwise(0.0)


def lexical(urls: DataFrame) -> DataFrame:
    """Lexical features of each URL; suffix is the host's last label, ending the path's file ending."""
    url = F.coalesce("url", F.lit(""))
    count = lambda c, what: F.char_length(c) - F.char_length(F.translate(c, what, ""))
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    n = F.greatest(F.char_length(url), F.lit(1))
    return urls.withColumns({
        "url_length": F.char_length(url), "host_length": F.char_length("host"), "path_length": F.char_length("path"),
        "depth": count(F.col("path"), "/"), "labels": count(F.col("host"), "."), "digit_ratio": count(url, "0123456789") / n,
        "letter_ratio": count(url, UPPER + LOWER) / n, "hyphens": count(F.col("host"), "-"),
        "params": F.when(query == "", 0).otherwise(count(query, "&") + 1), "query_length": F.char_length(query),
        "has_fragment": F.instr(url, "#").cast("boolean").cast("int"), "secure": url.startswith("https").cast("int"), "entropy": entropy(url),
        "longest_label": F.array_max(F.transform(F.split("host", r"\."), F.char_length)),
        "suffix": F.substring_index("host", ".", -1), "ending": F.regexp_extract("path", r"\.([A-Za-z0-9]{1,8})$", 1),
    })


def judge(pages: DataFrame, rules=RULES, sample: int = 10_000, default: str = "allow", weak: float = 0.5, trees: int = 15, depth: int = 4) -> DataFrame:
    """(page_id, host, path, rule, verdict, score): score is the trees' probability of block, null where a rule decides."""
    base = with_parts(pages.select("page_id", "url")).withColumn("fits", rule_of(rules))
    features = save(lexical(base).drop("url"))
    total = F.lit(float(max(1, features.count())))
    half = F.pmod(F.xxhash64("host"), F.lit(2))
    sums = save(features.groupBy("suffix", half.alias("half")).agg(F.count("*").alias("n"), F.count_if(F.col("fits.verdict") == "block").alias("b")))
    every = sums.agg(F.coalesce(F.try_divide(F.sum("b"), F.sum("n")), F.lit(0.0))).first()[0]
    other = sums.select("suffix", (1 - F.col("half")).alias("half"), (F.col("b") / F.col("n")).alias("blocked"))
    shares = sums.groupBy("suffix").agg((F.sum("n") / total).alias("suffix_share"))
    halves = sums.select("suffix", "half").join(other, ["suffix", "half"], "left").join(shares, "suffix")
    suffixes = halves.select("suffix", "half", "suffix_share", F.coalesce("blocked", F.lit(float(every))).alias("suffix_blocked"))
    endings = features.groupBy("ending").agg((F.count("*") / total).alias("ending_share"))
    full = features.withColumn("half", half).join(small(suffixes), ["suffix", "half"]).join(small(endings), "ending")
    label, weight = F.coalesce((F.col("fits.verdict") == "block").cast("double"), F.lit(0.0)), F.when(F.col("fits").isNull(), weak).otherwise(1.0)
    known = full.withColumns({"label": label, "weight": weight})
    parts = [known.where(F.col("fits.verdict") == v) for v in ("allow", "block")] + [known.where("fits is null")]
    samples = [x.orderBy(F.xxhash64("page_id"), "page_id").limit(sample) for x in parts]
    labelled = save(reduce(DataFrame.union, [x.select("label", "weight", *FEATURES) for x in samples]))
    kinds = labelled.select("label").distinct().count()
    rule, verdict = F.col("fits.rule").alias("rule"), F.col("fits.verdict")
    if kinds < 2:
        return features.select("page_id", "host", "path", rule, F.coalesce(verdict, F.lit(default)).alias("verdict"), F.lit(None).cast("double").alias("score"))
    gather = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    model = GBTClassifier(maxIter=trees, maxDepth=depth, maxBins=32, weightCol="weight", seed=7, checkpointInterval=-1).fit(gather.transform(labelled))
    from pyspark.ml.functions import vector_to_array

    open_ = model.transform(gather.transform(full.where("fits is null"))).withColumn("score", vector_to_array("probability")[1])
    new = open_.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.when(F.col("score") >= 0.5, "block").otherwise("allow").alias("verdict"), F.round("score", 6).alias("score"))
    old = features.where("fits is not null").select("page_id", "host", "path", rule, verdict.alias("verdict"), F.lit(None).cast("double").alias("score"))
    return old.union(new)


@tidied
def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


@tidied
def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op5: host, path and rule."""
    pages = with_parts(table(spark, sf_dir, "pages").select("page_id", "url"))
    return pages.select("page_id", "host", "path", rule_of(RULES)["rule"].alias("rule"), rule_of(RULES)["verdict"].alias("verdict"))


RULES_SQL = r"""
WITH cut AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substring(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(substring(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM cut),
rules(rule, rule_host, rule_path, verdict) AS (VALUES ('com/', 'com', '/', 'allow'), ('example.com/en/', 'example.com', '/en/', 'block'),
  ('www.example.com/en/', 'www.example.com', '/en/', 'allow'), ('net/es/', 'net', '/es/', 'block'), ('net/fr/', 'net', '/fr/', 'block')),
fits AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM parts
  JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY page_id)
SELECT page_id, host, path, rule, verdict FROM parts LEFT JOIN fits USING (page_id)
"""
