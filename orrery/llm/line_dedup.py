"""Line dedup by pairwise alignment of documents that share rare lines.

A document is its sequence of line hashes. A seed is the shortest run of consecutive lines that holds ``words`` words:
one long line, or several short ones; runs of that length are rare by themselves. For each seed the earliest document
(least doc_id) that holds it is its owner, and every later document with that seed is aligned with the owner: so a seed
in n documents gives n - 1 pairs, not n * n, and none is left out however common it is. A pair's line sequences are
aligned with patience diff (lines unique in both, their increasing run of most words, grown over equal neighbours), and
aligned blocks of at least ``words`` words are deleted from the later document. What is left is aligned again, for blocks
that stand in another order, and at last shared seeds whose lines aren't unique are aligned with their place in the owner.
The first document of each text keeps it.

Null or empty texts have no lines and stay as they are. Rows that repeat a doc_id are no later than each other; each is
cleaned by its own lines. A text all of whose lines go becomes
empty. An empty table gives no rows. Line ends are \\n; lines are compared after white space at their ends is removed.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm.common import as_long, chain, hash_strings, pieces, save, small, table, tidied

WORDS = 20
LINES = "doc_id long, same long, lines array<long>, words array<int>, seeds array<long>"
WHITE = " \t\n\x0b\x0c\r"


def same_text(column: str) -> Column:
    return F.xxhash64(F.coalesce(column, F.lit("")))


def line_rows(docs: DataFrame, words: int) -> DataFrame:
    """LINES: of each document its line hashes, words by line, and the seed that begins at each line (0: none)."""

    def run(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                texts = pc.fill_null(part.column("text").cast(pa.large_string()), "")
                lists = pc.split_pattern(texts, "\n")
                flat, at = pc.ascii_trim(lists.flatten(), characters=WHITE), lists.offsets.to_numpy().astype(np.int64)
                at = at - at[0]
                coded = flat.dictionary_encode()
                codes = coded.indices.to_numpy(zero_copy_only=False)
                own = hash_strings(coded)
                held = pc.list_value_length(pc.ascii_split_whitespace(coded.dictionary)).to_numpy(zero_copy_only=False)
                held = np.where(pc.equal(coded.dictionary, "").to_numpy(zero_copy_only=False), 0, held) if len(held) else held
                count = held[codes].astype(np.int32) if len(codes) else np.zeros(0, np.int32)
                total = np.concatenate([[0], np.cumsum(count, dtype=np.int64)])
                ends = np.searchsorted(total, total[:-1] + words, "left")  # a seed's lines are i .. ends[i] - 1
                limit = np.repeat(at[1:], np.diff(at))
                seeds = np.zeros(len(codes), np.uint64)
                for i in np.flatnonzero((ends <= limit) & (count > 0)):
                    seeds[i] = chain(own[i : ends[i]]) | 1
                as_list = lambda x: pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(x))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("same"), as_list(as_long(own)), as_list(count), as_list(as_long(seeds))], names=["doc_id", "same", "lines", "words", "seeds"])

    return docs.select(F.col("doc_id").cast("long"), "text", same_text("text").alias("same")).where("doc_id is not null").mapInArrow(run, LINES)


def heaviest_run(values: list[int], weights: list[int]) -> list[int]:
    """Places of the increasing subsequence of most weight, by patience sorting."""
    tops: list[int] = []  # last values of the best runs, ascending as their weights are
    held: list[tuple[int, int]] = []  # weight, place
    back = [-1] * len(values)
    for i, (v, w) in enumerate(zip(values, weights, strict=True)):
        k = bisect_left(tops, v)
        total = w + (held[k - 1][0] if k else 0)
        back[i] = held[k - 1][1] if k else -1
        end = k
        while end < len(tops) and held[end][0] <= total:
            end += 1
        if k == len(tops) or tops[k] != v or end > k:
            tops[k:end], held[k:end] = [v], [(total, i)]
    out, i = [], held[-1][1] if held else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def patience(a: np.ndarray, b: np.ndarray, words: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """Aligned blocks (start in a, start in b, lines) of two sequences of line hashes, by patience diff.
    ``words``: of each line of a; by default lines weigh the same."""
    words = np.ones(len(a), np.int64) if words is None else words + 1
    blocks, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        if a0 >= a1 or b0 >= b1:
            continue
        va, ia, ca = np.unique(a[a0:a1], return_index=True, return_counts=True)
        vb, ib, cb = np.unique(b[b0:b1], return_index=True, return_counts=True)
        _, pa_, pb = np.intersect1d(va[ca == 1], vb[cb == 1], return_indices=True)
        x, y = ia[ca == 1][pa_] + a0, ib[cb == 1][pb] + b0
        if not len(x):
            # no line is unique in both: equal beginnings and ends still align
            n = 0
            while a0 + n < a1 and b0 + n < b1 and a[a0 + n] == b[b0 + n]:
                n += 1
            m = 0
            while a1 - m > a0 + n and b1 - m > b0 + n and a[a1 - m - 1] == b[b1 - m - 1]:
                m += 1
            blocks += [(a0, b0, n)] * bool(n) + [(a1 - m, b1 - m, m)] * bool(m)
            continue
        order = np.argsort(x)
        x, y = x[order], y[order]
        keep = heaviest_run(y.tolist(), words[x].tolist())
        ends_a, ends_b = a0, b0
        for i, j in zip(x[keep].tolist(), y[keep].tolist(), strict=True):
            if i < ends_a or j < ends_b:
                continue  # grown over already
            s, t = i, j
            while s > ends_a and t > ends_b and a[s - 1] == b[t - 1]:
                s, t = s - 1, t - 1
            e, f = i + 1, j + 1
            while e < a1 and f < b1 and a[e] == b[f]:
                e, f = e + 1, f + 1
            todo.append((ends_a, s, ends_b, t))
            blocks.append((s, t, e - s))
            ends_a, ends_b = e, f
        todo.append((ends_a, a1, ends_b, b1))
    return blocks


def lines_gone(a: np.ndarray, held: np.ndarray, seeds: np.ndarray, theirs: np.ndarray, their_seeds: np.ndarray, words: int) -> np.ndarray:
    """Places of the lines of a that stand in aligned blocks of so many words."""
    gone = np.zeros(len(a), bool)
    left = a.copy()
    while True:
        found = [slice(s, s + n) for s, _, n in patience(left, theirs, held) if held[s : s + n].sum() >= words]
        found = [x for x in found if not gone[x].any()]
        if not found:
            break
        for x in found:
            gone[x] = True
        # a deleted line equals nothing any more
        left = np.where(gone, np.iinfo(np.int64).min + np.arange(len(a)), a)
    places = {int(s): k for k, s in reversed(list(enumerate(their_seeds.tolist()))) if s}
    for i in np.flatnonzero(~gone & (seeds != 0)):
        k = places.get(int(seeds[i]))
        n = 0
        while k is not None and i + n < len(a) and k + n < len(theirs) and a[i + n] == theirs[k + n]:
            n += 1
        if held[i : i + n].sum() >= words:
            gone[i : i + n] = True
    return np.flatnonzero(gone)


def repeated_lines(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, same, gone): of each document that repeats an earlier one, the places of the lines to delete."""
    rows = save(line_rows(docs, words))
    of = rows.select("doc_id", F.explode(F.array_distinct(F.filter("seeds", lambda s: s != 0))).alias("seed"))
    owners = of.groupBy("seed").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last")).where("owner < last").drop("last")
    pairs = of.join(owners, "seed").where("owner < doc_id").select("doc_id", "owner").distinct()
    earlier = rows.select(F.col("doc_id").alias("owner"), F.col("lines").alias("theirs"), F.col("seeds").alias("their_seeds"))
    met = pairs.join(earlier, "owner").join(rows, "doc_id")

    def align(batches):
        for batch in batches:
            out = []
            for doc, same, *cells in zip(*(batch.column(c) for c in ("doc_id", "same", "lines", "words", "seeds", "theirs", "their_seeds")), strict=True):
                gone = lines_gone(*(c.values.to_numpy(zero_copy_only=False) for c in cells), words)
                if len(gone):
                    out.append((doc.as_py(), same.as_py(), gone.tolist()))
            if out:
                yield pa.RecordBatch.from_pandas(pd.DataFrame(out, columns=["doc_id", "same", "gone"]), schema=pa.schema([("doc_id", pa.int64()), ("same", pa.int64()), ("gone", pa.list_(pa.int32()))]), preserve_index=False)

    found = met.select("doc_id", "same", "lines", "words", "seeds", "theirs", "their_seeds").mapInArrow(align, "doc_id long, same long, gone array<int>")
    return found.select("doc_id", "same", F.explode("gone").alias("line")).groupBy("doc_id", "same").agg(F.sort_array(F.collect_set("line")).alias("gone"))


def free(name: str, columns: list[str]) -> str:
    """A column name that isn't taken."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def cleaned(docs: DataFrame, words: int = WORDS, mark: str = "gone") -> DataFrame:
    """The documents with all their columns, ``text`` without repeated lines, plus the places of the lines deleted (null:
    none), in a column named ``mark`` (with _ behind it where the documents have one of that name). Where all lines that
    hold words are gone the text is empty."""
    names = [free(n, docs.columns) for n in (mark, "_id", "_same")]
    gone = small(repeated_lines(docs.select("doc_id", "text"), words).toDF(names[1], names[2], names[0]))
    met = docs.join(gone, (F.col("doc_id") == F.col(names[1])) & (same_text("text") == F.col(names[2])), "left").drop(*names[1:])
    kept = F.filter(F.split("text", "\n", -1), lambda _, i: ~F.array_contains(names[0], i))
    text = F.array_join(kept, "\n")
    return met.withColumn("text", F.when(F.col(names[0]).isNull(), F.col("text")).when(text.rlike(r"[^\x20\x09-\x0D]"), text).otherwise(""))


def clean_documents(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """The documents less repeated lines, with their own columns (``n_chars`` counted again); those that had nothing else go."""
    mark = free("gone", docs.columns)
    kept = cleaned(docs, words).where(F.col(mark).isNull() | (F.col("text") != ""))
    return kept.select(*(F.char_length("text").cast(kind).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c, kind in docs.dtypes))


@tidied
def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return cleaned(docs).select("doc_id", "text", F.char_length("text").cast("long").alias("n_chars"), F.coalesce(F.size("gone"), F.lit(0)).alias("lines_removed"), "gone")
