"""Benchmark decontamination by template canonicalisation.

A text's words become a template: numbers, units after numbers, and names (capitalised words inside a sentence) turn
into typed placeholders, everything else into its lower-case core without outer punctuation. Windows of ``WINDOW``
template words are hash-joined with those of the benchmark's items. Along each alignment of document and item the slots
must agree: one value of the item goes with one value of the document and the other way round. So a question whose
numbers or names were changed throughout is caught, and one that only resembles it is not.

An alignment counts where its windows cover at least ``share`` of the item's words. Where words were put in or left out,
the pieces on either side lie on alignments up to ``GAP`` words apart; such neighbours are one alignment too. Items of fewer words than a window
have one window of all their words and are found anywhere in a text; such an item without a literal word must be there
with its own values, or be all of the text. Items without words match nothing. Windows with fewer than ``literal`` literal words
say too little to find an alignment, unless the item has no others; along one that others found, all windows count. Null or empty texts match nothing, repeated rows are
compared each, empty tables give no rows, other columns are ignored. Equal items are reported each.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.llm.common import MIX, as_long, fmix, pieces, save, small, table, tidied

WINDOW, SHARE, LITERAL, GAP = 8, 0.6, 5, 8
OUTER = ".,;:!?\"'()[]{}<>«»“”…¿¡*#$%&|_-"
#: Units that follow a number; a fixed list.
UNITS = frozenset("mm cm m km in ft yd mi mg g kg t lb oz ml l gal s sec min h hr hrs ms day days week weeks month months year years hour hours minute minutes second seconds meter meters metre metres mile miles foot feet inch inches gram grams kilogram kilograms pound pounds liter liters litre litres kmh mph hz khz mhz ghz w kw v a k c f % usd eur gbp dollar dollars euro euros cent cents percent".split())
NUMBER = re.compile(r"[+-]?[$€£]?\d[\d.,/:]*")
WITH_UNIT = re.compile(r"([+-]?[$€£]?\d[\d.,/:]*)([a-z%]+)")
NUM, UNIT, NAME = (np.uint64(xxhash.xxh64_intdigest(f"\x00{k}")) for k in ("num", "unit", "name"))
EMPTY = np.uint64(xxhash.xxh64_intdigest(""))
HITS = "doc_id long, key long, pos int, window long"
ITEMS = "item_id long, item_words int, poor int, shape array<long>, slots array<long>, pos array<int>, window array<long>"
SPANS = "doc_id long, item long, diagonals array<int>, first int, its_words int, its_shape array<long>, its_slots array<long>"


def templates(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all words, flat: template hash, value hash, whether literal; and where each text's words begin and end. Words
    that are punctuation only are left out."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(texts))
    flat, offsets = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    coded, at = flat.dictionary_encode(), offsets - offsets[0]
    words = coded.dictionary
    core = pc.utf8_trim(words, characters=OUTER)
    low = pc.utf8_lower(core).to_pylist()
    own = np.fromiter((xxhash.xxh64_intdigest(w) for w in low), np.uint64, len(low))
    maybe = pc.match_substring_regex(core, r"^[+-]?[$€£]?\d").to_numpy(zero_copy_only=False)
    number, unit = np.zeros(len(low), bool), np.fromiter((w in UNITS for w in low), bool, len(low))
    for i in np.flatnonzero(maybe):
        number[i] = bool(NUMBER.fullmatch(low[i]) or (m := WITH_UNIT.fullmatch(low[i])) and m[2] in UNITS)
    capital = pc.match_substring_regex(core, r"^\p{Lu}[\p{Ll}\p{M}'’-]+$").to_numpy(zero_copy_only=False)
    stops = pc.match_substring_regex(words, r"[.!?…:][\"'»”)\]]*$").to_numpy(zero_copy_only=False)
    codes = coded.indices.to_numpy(zero_copy_only=False)
    if not len(codes):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, bool), at
    value, empty = own[codes], (own == EMPTY)[codes]
    first = np.zeros(len(codes) + 1, bool)
    first[at[:-1]] = True
    begins = first[:-1] | np.concatenate([[True], stops[codes][:-1]])
    is_number, is_name = number[codes], capital[codes] & ~begins
    is_unit = unit[codes] & np.concatenate([[False], is_number[:-1]]) & ~first[:-1]
    shape = np.where(is_number, NUM, np.where(is_unit, UNIT, np.where(is_name, NAME, value)))
    literal = ~(is_number | is_unit | is_name)
    if empty.any():
        before = np.concatenate([[0], np.cumsum(empty)])
        shape, value, literal, at = shape[~empty], value[~empty], literal[~empty], at - before[at]
    return shape, value, literal, at


def rolled(shape: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all windows of ``width`` words, flat: text, first word (flat), hash."""
    count = np.maximum(np.diff(at) - width + 1, 0)
    of = np.repeat(np.arange(len(count)), count)
    start = np.repeat(at[:-1], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    h = np.zeros(max(0, len(shape) - width + 1), np.uint64)
    for j in range(width):
        h = h * MIX + fmix(shape[j : len(shape) - width + 1 + j] + np.uint64(j + 1)) if len(h) else h
    return of, start, fmix(h[start])


def spread(flags: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of ``n`` words lie in a window whose flag is set."""
    ends = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(flags)
    np.add.at(ends, at, 1)
    np.add.at(ends, at + width, -1)
    return np.cumsum(ends[:-1]) > 0


def lists(values: list[np.ndarray], kind) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, values)]), pa.int32()), pa.array(np.concatenate(values), kind))


def item_rows(benchmark: DataFrame, size: int, literal_words: int) -> DataFrame:
    """ITEMS rows, one for each item that has words: its words' templates and slots (hashes; 0 where the word is literal),
    the windows that find it, and how many of its words lie in others."""

    def run(batches):
        for batch in batches:
            for part in pieces(batch, "text", 200_000):
                shape, value, literal, at = templates(part.column("text"))
                rows = []
                for i in np.flatnonzero(np.diff(at)):
                    s, own = shape[at[i] : at[i + 1]], literal[at[i] : at[i + 1]]
                    width = min(size, len(s))
                    sums = np.concatenate([[0], np.cumsum(own)])
                    rich = sums[width:] - sums[:-width] >= literal_words
                    if not rich.any():
                        rich[:] = True
                    h = as_long(rolled(s, np.array([0, len(s)]), width)[2])
                    rows.append((i, len(s), int(spread(~rich, width, len(s)).sum()), as_long(s), np.where(own, 0, as_long(value[at[i] : at[i + 1]])), np.flatnonzero(rich), h[rich]))
                if rows:
                    of, n, poor, shapes, slots, pos, found = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([part.column("item_id").take(pa.array(of)), pa.array(n, pa.int32()), pa.array(poor, pa.int32()), lists(shapes, pa.int64()), lists(slots, pa.int64()), lists(pos, pa.int32()), lists(found, pa.int64())], names=["item_id", "item_words", "poor", "shape", "slots", "pos", "window"])

    rows = benchmark.select(F.col("item_id").cast("long"), "text").mapInArrow(run, ITEMS)
    return rows.withColumn("item", F.xxhash64("item_id", "shape", "slots")).dropDuplicates(["item"])


def windows(docs: DataFrame, size: int, short: list[int], sent=None) -> DataFrame:
    """HITS rows: each window with its place. ``short``: lengths of the items that have fewer words than ``size``;
    every text gives windows of those lengths too. ``sent``: a broadcast of sorted hashes; only windows with one of them are
    given out."""

    def run(batches):
        wanted = sent.value if sent is not None else None
        for batch in batches:
            for part in pieces(batch, "text"):
                shape, _, _, at = templates(part.column("text"))
                for width in [*short, size]:
                    of, start, h = rolled(shape, at, width)
                    kept = np.arange(len(h))
                    if wanted is not None:
                        kept = np.flatnonzero(wanted[np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)] == h) if len(wanted) else kept[:0]
                    for k in range(0, len(kept), 50_000):
                        i = kept[k : k + 50_000]
                        yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(of[i])), part.column("key").take(pa.array(of[i])), pa.array((start[i] - at[of[i]]).astype(np.int32)), pa.array(as_long(h[i]))], names=["doc_id", "key", "pos", "window"])

    return docs.mapInArrow(run, HITS)


def spans(docs: DataFrame) -> DataFrame:
    """(doc_id, text, item, diagonals, item_words), the last three lists -> SPANS rows: a document's words beside an item's,
    from its word ``first`` on. A diagonal is a document's place less the item's."""

    def run(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                shape, value, literal, at = templates(part.column("text"))
                slot = np.where(literal, 0, as_long(value))
                held, rows = 0, []

                def told(rows):
                    ids, item, diagonals, first, n, a, b = zip(*rows, strict=True)
                    cut = lambda x: lists([x[p:q] for p, q in zip(a, b, strict=True)], pa.int64())
                    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(item, pa.int64()), pa.array(diagonals, pa.list_(pa.int32())), pa.array(first, pa.int32()), pa.array(n, pa.int32()), cut(as_long(shape)), cut(slot)], names=["doc_id", "item", "diagonals", "first", "its_words", "its_shape", "its_slots"])

                for i, (doc, *places) in enumerate(zip(*(part.column(c).to_pylist() for c in ("doc_id", "item", "diagonals", "item_words")), strict=True)):
                    for item, diagonals, words in zip(*places, strict=True):
                        first = max(0, min(diagonals))
                        a, b = at[i] + first, min(at[i] + max(diagonals) + words, at[i + 1])
                        rows.append((doc, item, diagonals, first, at[i + 1] - at[i], a, b))
                        held += b - a
                        if held > 100_000:
                            yield told(rows)
                            held, rows = 0, []
                if rows:
                    yield told(rows)

    return docs.mapInArrow(run, SPANS)


def agreed(shape: np.ndarray, slots: np.ndarray, its_shape: np.ndarray, its_slots: np.ndarray, shifts, width: int) -> tuple[int, int, bool, bool]:
    """Of an item's words and those beside them, so far along: windows that are the same, words in them, whether their
    slots agree, and whether some value is another one. A word counts along the shift with most such windows."""
    covered, values, n_same = np.zeros(len(shape), bool), [], 0
    found = []
    for s in shifts:
        lo, hi = max(0, -s), min(len(shape), len(its_shape) - s)
        if hi - lo >= width:
            sums = np.concatenate([[0], np.cumsum(shape[lo:hi] == its_shape[lo + s : hi + s])])
            same = sums[width:] - sums[:-width] == width
            if same.any():
                found.append((-int(same.sum()), s, lo, hi, same))
    for n, s, lo, hi, same in sorted(found, key=lambda f: f[:2]):
        new = spread(same, width, hi - lo) & ~covered[lo:hi]
        covered[lo:hi] |= new
        values.append(np.stack([slots[lo:hi][new], its_slots[lo + s : hi + s][new]]))
        n_same -= n
    a, b = np.concatenate(values, axis=1) if values else np.zeros((2, 0), np.int64)
    pairs = np.unique(np.stack([a, b])[:, a != 0], axis=1)
    agree = len(np.unique(pairs[0])) == len(np.unique(pairs[1])) == pairs.shape[1]
    return n_same, int(covered.sum()), agree, bool((a != b).any())


def contaminated(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, share: float = SHARE, literal: int = LITERAL, most_sent: int = 2_000_000) -> DataFrame:
    """(doc_id, item_id, n_windows, share, changed): documents that hold an item, possibly with other numbers, units or
    names. Where the benchmark has at most ``most_sent`` windows, their hashes go to the tasks (8 bytes each) and windows
    without a partner are dropped before the shuffle; beyond, all windows are shuffled."""
    items = save(item_rows(benchmark, size, literal))
    seeds = save(items.select("item", "item_words", "poor", F.explode(F.arrays_zip("pos", "window")).alias("w")).select("item", "item_words", "poor", F.col("w.pos").alias("item_pos"), F.col("w.window").alias("window")))
    wanted = np.unique(seeds.select("window").distinct().toPandas()["window"].to_numpy(np.int64).view(np.uint64)) if seeds.count() <= most_sent else None
    short = sorted(r[0] for r in items.where(F.col("item_words") < size).select("item_words").distinct().collect())
    docs = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("key"))
    sent = docs.sparkSession.sparkContext.broadcast(wanted)  # most_sent hashes at most
    pairs = windows(docs, size, short, sent).join(seeds, "window").withColumn("diagonal", F.col("pos") - F.col("item_pos"))
    reach = F.array_distinct(F.flatten(F.collect_set(F.sequence(F.col("item_pos"), F.col("item_pos") + F.least(F.col("item_words"), F.lit(size)) - 1))))
    lines = pairs.groupBy("doc_id", "key", "item", "diagonal").agg(reach.alias("reach"), F.max("item_words").alias("item_words"), F.max("poor").alias("poor"))
    # words in other windows may be found as well once the whole item is compared along the diagonal
    enough = lambda covered: covered + F.col("poor") >= F.lit(share) * F.col("item_words")
    beside = Window.partitionBy("doc_id", "key", "item").orderBy("diagonal")
    apart = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(beside) > GAP).cast("int"), F.lit(1))
    runs = lines.withColumn("apart", apart).withColumn("run", F.sum("apart").over(beside)).groupBy("doc_id", "key", "item", "run")
    runs = runs.agg(F.sort_array(F.collect_list("diagonal")).alias("diagonals"), F.collect_list(F.when(enough(F.size("reach")), F.array("diagonal"))).alias("ones"), F.size(F.array_distinct(F.flatten(F.collect_list("reach")))).alias("covered"), F.max("item_words").alias("item_words"), F.max("poor").alias("poor"))
    several = F.when((F.size("diagonals") > 1) & enough(F.col("covered")), F.array("diagonals")).otherwise(F.array().cast("array<array<int>>"))
    maybe = runs.select("doc_id", "key", "item", "item_words", F.explode(F.concat("ones", several)).alias("diagonals"))
    by_text = maybe.groupBy(F.col("doc_id").alias("_id"), F.col("key").alias("_key")).agg(F.collect_list(F.struct("item", "diagonals", "item_words")).alias("c"))
    by_text = small(by_text.select("_id", "_key", "c.item", "c.diagonals", "c.item_words"))
    needed = docs.join(by_text, docs["doc_id"].eqNullSafe(by_text["_id"]) & docs["key"].eqNullSafe(by_text["_key"]))
    beside = spans(needed.select("doc_id", "text", "item", "diagonals", "item_words")).join(items.select("item", "item_id", "item_words", "shape", "slots"), "item")

    def compare(batches):
        names = ["doc_id", "item_id", "n_windows", "share", "agree", "changed"]
        for batch in batches:
            columns = {c: batch.column(c) for c in batch.schema.names}
            rows = []
            for i in range(len(batch)):
                shape, slots, its_shape, its_slots = (columns[c][i].values.to_numpy(zero_copy_only=False) for c in ("shape", "slots", "its_shape", "its_slots"))
                n, first = columns["item_words"][i].as_py(), columns["first"][i].as_py()
                found, covered, agree, changed = agreed(shape, slots, its_shape, its_slots, [d - first for d in columns["diagonals"][i].as_py()], min(size, n))
                # a short item of slots only is held by any text with a number or name, unless the values count
                said = n >= size or not changed or (slots == 0).any() or columns["its_words"][i].as_py() == n
                rows.append((found, covered / n, agree and bool(said), changed))
            found = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.float64(), pa.bool_(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([columns["doc_id"], columns["item_id"], *found], names=names)

    good = beside.mapInArrow(compare, "doc_id long, item_id long, n_windows long, share double, agree boolean, changed boolean").where((F.col("share") >= share) & F.col("agree"))
    return good.groupBy("doc_id", "item_id").agg(F.max("n_windows").alias("n_windows"), F.round(F.max("share"), 6).alias("share"), F.min("changed").alias("changed"))


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no item of the benchmark, with all their columns."""
    bad = contaminated(docs, benchmark).select("doc_id").distinct()
    return docs.join(small(bad), "doc_id", "left_anti").select(docs.columns)


@tidied
def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
