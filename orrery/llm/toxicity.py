"""Toxicity by cumulative-link ordinal regression on sparse text features.

P(grade <= k | x) = sigmoid(threshold_k - w.x): one weight vector is shared by all ordered thresholds. Features are a
document's distinct words and their beginnings of four and five letters. The model is fitted on a bounded sample of
labelled rows (at most ``sample`` of each class, chosen by the hash of doc_id); every document is then scored whole.

Grades: a ``severity`` column of the labels if there is one; else 0 for toxic = 0, and toxic documents are graded 1 or 2
as they hold at most, or more than, the median number of words that hardly ever occur in clean documents. Grades 1 and 2 are
then a stand-in made of the text itself, so that only grade > 0 says something that the labels said.

The model keeps features held by ``least_held`` rows of the sample and more, with chi-square of at least ``evidence``, the
best ``most_features`` of them. Null or empty text has no features and gets the thresholds' own grade. Documents that share a
text weigh once in the fit. Rows with a null label or id, or whose document is absent or has no words, are left out of the
fit; where rows of one class only are left, or none, every document gets grade 0.
Repeated document rows are scored each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm.common import pieces, save, table, tidied

SCORES = "doc_id long, expected_severity double, grade int, p_toxic double, is_toxic boolean"
EDGES = ".,;:!?\"'()[]{}*#$%&-_/\\|<>«»“”…¿¡"
BEGINNINGS = (4, 5)


def word_rows(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct (text, word) pairs: the words, each pair's text and its word's place among them."""
    clean = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(clean))
    offsets = lists.offsets.to_numpy()
    coded = pc.utf8_trim(lists.flatten(), characters=EDGES).dictionary_encode()
    of = np.repeat(np.arange(len(texts)), np.diff(offsets))
    n = max(1, len(coded.dictionary))
    pairs = np.unique(of * n + coded.indices.to_numpy(zero_copy_only=False).astype(np.int64))
    empty = pc.equal(coded.dictionary, "").to_numpy(zero_copy_only=False)
    pairs = pairs[~empty[pairs % n]] if len(empty) else pairs
    return coded.dictionary, pairs // n, pairs % n


def features_of(words: pa.Array) -> list[pa.Array]:
    """Each word, and its beginnings where it is longer; a beginning ends in *, as no word does."""
    out = [words]
    for k in BEGINNINGS:
        start = pc.binary_join_element_wise(pc.utf8_slice_codeunits(words, 0, k), pa.scalar("*", pa.large_string()), pa.scalar("", pa.large_string()))
        out.append(pc.if_else(pc.greater(pc.utf8_length(words), k), start, pa.scalar(None, pa.large_string())))
    return out


def fit_ordinal(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, grade: np.ndarray, n_features: int, n_grades: int, l2: float = 0.3, rounds: int = 800) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thresholds) of the cumulative link model by accelerated gradient steps on the penalised likelihood."""
    n = len(grade)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    share = np.cumsum(np.bincount(grade, minlength=n_grades))[:-1] / n
    theta = np.log(np.clip(share, 1e-3, 1 - 1e-3) / (1 - np.clip(share, 1e-3, 1 - 1e-3)))
    norm = np.bincount(rows, values**2, minlength=n).max(initial=1.0)
    par = np.concatenate([np.zeros(n_features), theta])
    look, last, t = par.copy(), par.copy(), 1.0
    rate = 4.0 / (norm + 4)
    for _ in range(rounds):
        w, theta = look[:n_features], np.maximum.accumulate(look[n_features:])
        z = np.bincount(rows, w[cols] * values, minlength=n)
        upper = sigmoid(np.append(theta, 30.0)[grade] - z)
        lower = np.where(grade > 0, sigmoid(np.concatenate([[-30.0], theta])[grade] - z), 0.0)
        p = np.maximum(upper - lower, 1e-9)
        du, dl = np.where(grade < n_grades - 1, upper * (1 - upper), 0) / p, np.where(grade > 0, lower * (1 - lower), 0) / p
        gz = (du - dl) / n  # derivative of -log likelihood by z
        gw = np.bincount(cols, gz[rows] * values, minlength=n_features) + l2 * w / n
        gt = (np.bincount(grade, -du, minlength=n_grades)[:-1] + np.bincount(grade, dl, minlength=n_grades)[1:]) / n
        par = look - rate * np.concatenate([gw, gt]) * 4
        t, old = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        look, last = par + (old - 1) / t * (par - last), par
    return par[:n_features], np.maximum.accumulate(par[n_features:])


def train(docs: DataFrame, labels: DataFrame, sample: int = 4000, most_features: int = 4000, evidence: float = 15.0, least_held: int = 5) -> dict:
    """The model as plain values. ``sample``: labelled rows of each class at most. ``most_features``: kept by chi-square
    of at least ``evidence``; so what reaches the driver is bounded."""
    graded = "severity" in labels.columns
    given = F.col("severity").cast("int") if graded else F.col("toxic").cast("int")
    known = labels.select("doc_id", given.alias("y")).where("doc_id is not null and y is not null").groupBy("doc_id").agg(F.max("y").alias("y"))
    totals = {bool(r["bad"]): r["count"] for r in known.groupBy((F.col("y") > 0).alias("bad")).count().collect()}
    clean = {"features": [], "weights": [], "thresholds": [30.0]}
    if len(totals) < 2:
        return clean
    chosen = [known.where(F.col("y") > 0 if bad else F.col("y") <= 0).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for bad in (False, True)]
    picked = F.broadcast(chosen[0].union(chosen[1]))  # at most 2 x sample rows

    def spread(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                words, of, at = word_rows(part.column("text"))
                parts = [f.take(pa.array(at)) for f in features_of(words)]
                feature = pa.concat_arrays([x.cast(pa.string()) for x in parts])
                row = pa.array(np.tile(of, len(parts)))
                yield from pa.table({"doc_id": part.column("doc_id").take(row), "y": part.column("y").take(row), "feature": feature, "word": pa.array(np.arange(len(of) * len(parts)) < len(of))}).filter(pc.is_valid(feature)).to_batches(200_000)

    texts = docs.select(F.col("doc_id").cast("long"), "text").join(picked, "doc_id").withColumn("same", F.xxhash64("text")).dropDuplicates(["same", "y"]).drop("same")
    found = save(texts.mapInArrow(spread, "doc_id long, y int, feature string, word boolean").groupBy("doc_id", "y", "feature").agg(F.count("*").cast("double").alias("v"), F.max("word").alias("word")))
    docs_y = found.select("doc_id", "y").distinct().toPandas()  # at most 2 x sample rows
    n1 = int((docs_y["y"] > 0).sum())
    n0 = len(docs_y) - n1
    if not n0 or not n1:
        return clean
    a, b = F.count_if(F.col("y") > 0), F.count_if(F.col("y") <= 0)
    held = found.groupBy("feature", "word").agg(a.alias("a"), b.alias("b")).where(f"a + b >= {int(least_held)}")
    n = n0 + n1
    cross = F.col("a") * (n0 - F.col("b")) - F.col("b") * (n1 - F.col("a"))
    chi = n * cross.cast("double") * cross / ((F.col("a") + F.col("b")).cast("double") * (n - F.col("a") - F.col("b")) * n0 * n1)
    best = held.where(F.col("a") + F.col("b") < n).withColumn("chi", chi).where(F.col("chi") >= evidence).orderBy(F.desc("chi"), "feature", "word").limit(most_features).toPandas()
    names = list(best["feature"])
    at = {x: i for i, x in enumerate(names)}
    numbered = docs.sparkSession.createDataFrame(list(at.items()), "feature string, at int")  # at most most_features rows
    cells = found.join(F.broadcast(numbered), "feature").select("doc_id", "at", F.col("v").cast("float").alias("v")).toPandas()
    ids = {d: i for i, d in enumerate(docs_y["doc_id"])}
    rows, cols = cells["doc_id"].map(ids).to_numpy(np.int64), cells["at"].to_numpy(np.int64)
    values = cells["v"].to_numpy(float)
    y = docs_y["y"].clip(lower=0).to_numpy(np.int64)
    if not graded:
        strong = ((best["b"] * 20 < best["a"]) & best["word"]).to_numpy(bool)
        hits = np.bincount(rows, strong[cols] * 1.0, minlength=len(y)) if len(rows) else np.zeros(len(y))
        y = np.where(y > 0, 1 + (hits > np.median(hits[y > 0])), 0)
    levels = {g: i for i, g in enumerate(sorted(set(y)))}
    y = np.array([levels[g] for g in y], np.int64)
    w, theta = fit_ordinal(rows, cols, values, y, len(names), len(levels))
    odds = (totals[False] / totals[True]) / (n0 / n1)  # the sample holds more of the rarer class than the corpus
    return {"features": names, "weights": [float(x) for x in w], "thresholds": [float(x + np.log(odds)) for x in theta], "grades": [int(g) for g in levels]}


def rater(model: dict):
    """Text array -> probabilities of the grades, as rows; once in each task."""
    theta, value_set = np.array(model["thresholds"]), pa.array(model["features"], pa.large_string())
    weights = np.append(np.array(model["weights"], float), 0.0)

    def rate(texts: pa.Array) -> np.ndarray:
        words, of, at = word_rows(texts)
        total = np.zeros(len(words))
        for f in features_of(words):
            total += weights[pc.fill_null(pc.index_in(f, value_set=value_set), len(weights) - 1).to_numpy(zero_copy_only=False)]
        z = np.bincount(of, total[at], minlength=len(texts))
        below = 1 / (1 + np.exp(-np.clip(theta[None, :] - z[:, None], -30, 30)))
        return np.diff(np.concatenate([np.zeros((len(z), 1)), below, np.ones((len(z), 1))], axis=1), axis=1)

    return rate


def score(docs: DataFrame, model: dict, least: float = 0.5) -> DataFrame:
    """SCORES for every document; is_toxic where P(grade > 0) is at least ``least``."""
    grades = np.array(model.get("grades", [0, 1]))

    def run(batches):
        rate = rater(model)
        for batch in batches:
            for part in pieces(batch, "text"):
                p = rate(part.column("text"))
                worse = 1 - p[:, 0]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.round(p @ grades, 6)), pa.array(grades[p.argmax(1)].astype(np.int32)), pa.array(np.round(worse, 6)), pa.array(worse >= least)], names=["doc_id", "expected_severity", "grade", "p_toxic", "is_toxic"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCORES)


def clean_documents(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """The documents that the model doesn't find toxic, with all their columns, in one pass and without a shuffle."""
    model = train(docs, labels)

    def run(batches):
        rate = rater(model)
        for batch in batches:
            for part in pieces(batch, "text"):
                yield part.filter(pa.array(1 - rate(part.column("text"))[:, 0] < least))

    return docs.mapInArrow(run, docs.schema)


@tidied
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
