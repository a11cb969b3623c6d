"""Operators on documents against brute force, on hard small tables."""

import random
import re
import string
from collections import Counter
from functools import cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.llm import decontaminate, fingerprint, line_dedup, ngram_join, packing, pii, toxicity

rng = random.Random(5)
VOCAB = ["".join(rng.choices(string.ascii_lowercase, k=rng.randint(2, 8))) for _ in range(400)]


def prose(n, r=rng):
    return " ".join(r.choice(VOCAB) for _ in range(n))


@cache
def corpus():
    base, long = prose(120), prose(3000)
    near = base.split()
    near[60] = "changed"
    rows = [(1, base), (2, " ".join(near)), (3, base), (4, None), (5, ""), (6, " \t\n"), (7, "one two"), (8, "one two"), (9, "ÉÀ one\u00a0two three"), (10, long), (11, long + " end"), (12, prose(40))]
    rows += [(12, rows[-1][1]), (20, "a b c d e"), (21, "A B c d E"), (22, "x" * 50000)]
    return [(i, t, "x", i * 10) for i, t in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), "doc_id long, text string, set string, n long").repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, set string, n long")


LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[j : j + 5]) for j in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def by_force(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    up = {i: i for i, _ in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if s and t and 100 * len(s & t) >= 75 * len(s | t):
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    return Counter((i, len(s), find(i)) for i, s in sets)


def families():
    r = random.Random(11)
    rows, k = [], 0
    for f in range(14):
        base = [r.choice(VOCAB) for _ in range(r.choice([8, 30, 90]))]
        for _ in range(r.randint(1, 14)):
            w = list(base)
            for _ in range(r.randint(0, max(1, len(w) // 25))):
                w[r.randrange(len(w))] = r.choice(VOCAB)
            rows.append((k := k + 1, " ".join(w[: len(w) - r.randint(0, 2)])))
    return rows


@pytest.mark.parametrize("block", [384, 5])
def test_ngram_join(spark, docs, empty, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", block)
    rows = families()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert Counter(map(tuple, ngram_join.linked(df).collect())) == by_force(rows)
    if block > 5:
        assert Counter(map(tuple, ngram_join.linked(docs).collect())) == by_force([(i, t) for i, t, *_ in corpus()])
        assert ngram_join.linked(empty).count() == 0
        assert ngram_join.linked(spark.createDataFrame([(None, "a b"), (1, "a b")], "doc_id long, text string")).where("doc_id is null").first().component_id is None
        assert {r.doc_id for r in ngram_join.one_of_each(docs).collect()} >= {1, 4, 5, 6, 7, 12}
        assert 3 not in {r.doc_id for r in ngram_join.one_of_each(docs).collect()}


def test_salted_shingles_meet(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "SALTED", 1)
    rows = families()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    assert Counter(map(tuple, ngram_join.linked(df, common_from=1).collect())) == by_force(rows)


def test_ties_pass_by_sets_that_only_count():
    import pyarrow as pa

    places = ngram_join.place_of(np.ones(6), np.arange(40, 46), np.array([0, 1, 0, 2, 0, 1]))
    batch = pa.RecordBatch.from_arrays([pa.array([7] * 6), pa.array(places), pa.array(range(6))], names=["shingle", "place", "set"])
    for cut in range(7):
        found = pa.Table.from_batches(ngram_join.tie(iter([batch.slice(0, cut), batch.slice(cut)]), 75)).to_pylist()
        assert {(r["a"], r["b"]) for r in found if r["kind"] == 0} == {(3, 1), (5, 3)}
        assert {(r["a"], r["b"]) for r in found if r["kind"] == 1} == {(7, 1)}


def test_a_set_that_many_tasks_sent_counts_once(spark):
    import pyarrow as pa

    places = ngram_join.place_of(np.ones(30), np.full(30, 40), np.full(30, 3))
    batch = pa.RecordBatch.from_arrays([pa.array([7] * 30), pa.array(places), pa.array([1] * 12 + [2] * 18)], names=["shingle", "place", "set"])
    for cut in (0, 5, 12, 20):
        found = pa.Table.from_batches(ngram_join.tie(iter([batch.slice(0, cut), batch.slice(cut)]), 75)).to_pylist()
        assert {r["a"]: r["b"] for r in found if r["kind"] == 2} == {k: 1 + 2**21 + 2**42 for k in (1, 2)}
        assert sum(r["kind"] == 2 for r in found) == 2
    full = [(5, sum((2**21 - 1) << (21 * k) for k in range(3)), 2)] * 4
    got = ngram_join.met_counts(spark.createDataFrame(full, "a long, b long, kind byte")).first()
    assert (got.n_met0, got.n_met1, got.n_met2) == (4 * (2**21 - 1),) * 3


def test_copies_of_a_long_text_in_many_tasks(spark):
    """Counts of one set's meetings, sent by many tasks, stay right where the text is long and common."""
    r = random.Random(1)
    long = " ".join(f"w{r.randrange(10**6)}" for _ in range(9_000))
    df = spark.range(40).repartition(40).select(F.col("id").alias("doc_id"), F.when(F.col("id") == 20, F.lit(long + " end")).otherwise(F.lit(long)).alias("text"))
    rows = ngram_join.linked(df).collect()
    assert len(rows) == 40 and {x.component_id for x in rows} == {0}


def test_one_of_each_of_repeated_rows(spark):
    text = prose(30)
    rows = [(1, text, 0)] * 3 + [(2, text, 0), (None, text, 1), (None, text, 1), (4, None, 2), (4, None, 2), (5, "", 3), (6, prose(20), 4), (6, prose(20), 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _rank long").repartition(4)
    assert Counter(x.doc_id for x in ngram_join.one_of_each(df).collect()) == Counter({1: 1, None: 2, 4: 1, 5: 1, 6: 2})


def test_packing(spark, docs, empty):
    got = packing.pack(docs).toPandas()
    encode = packing.encoder(*packing.default_files())
    slow = packing.encoder(packing.default_files()[0], None)
    for text in ("a <|endoftext|> b", "naïve 漢字 🙂\u2003x", "  don't 12345 "):
        assert encode(text).tolist() == slow(text).tolist()
    import zlib

    want = Counter()
    for i, t, *_ in corpus():
        ids = np.append(slow(t or ""), 2).astype("<u4")
        first = (len(ids) - 1) % 1024 + 1
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        want.update((i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:])))
    assert Counter(got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None)) == want
    for _, s in got.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert (s["offset"].to_numpy() == np.concatenate([[0], s["length"].cumsum().to_numpy()[:-1]])).all() and s["length"].sum() <= 1024
    assert packing.pack(empty).count() == 0


def test_packing_program_is_near_the_bound():
    r = np.random.default_rng(3)
    hist = Counter(np.clip(r.lognormal(5, 1.2, 20000).astype(int), 1, 1023).tolist())
    plan = packing.solve(hist)
    held = Counter()
    for times, config in plan:
        assert sum(a * b for a, b in config) <= 1024
        for length, many in config:
            held[length] += times * many
    assert held == hist
    assert sum(t for t, _ in plan) <= 1.01 * -(-sum(a * b for a, b in hist.items()) // 1024)


def test_line_dedup(spark, empty):
    a, b, c = (prose(30) for _ in range(3))
    short = "tiny line here"
    rows = [(1, f"{a}\n{short}\n{b}"), (2, f"{c}\n{b}\n{short}"), (3, f"{a}\n{short}\n{b}"), (4, None), (5, ""), (6, f"{short}\n{short}"), (7, f" {a} \n{prose(9)}"), (8, "\n\n"), (9, f"{prose(12)}\n{a}\n{a}")]
    rows += [(10, prose(11) + "\n" + prose(10)), (11, rows[-1][1])]
    rows.append((12, rows[-2][1] + "x"))
    rows[-1] = (12, rows[9][1] + "\nmore words")
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, gone_before string").repartition(3)
    got = {r.doc_id: r.text for r in line_dedup.cleaned(df).collect()}
    assert got[1] == rows[0][1] and got[4] is None and got[5] == "" and got[6] == rows[5][1] and got[8] == "\n\n"
    assert got[3] == "" and got[2] == f"{c}\n{short}" and a not in got[7] and got[11] == "" and got[12] == "more words"
    assert a not in got[9] and got[9]
    assert line_dedup.cleaned(empty).count() == 0
    names = ("gone", "gone_", "_new", "_id", "_same", "same", "lines", "owner", "_rank")
    clashing = df.select("doc_id", "text", *(F.lit(7).alias(c) for c in names))
    again = line_dedup.cleaned(clashing)
    assert again.columns == ["doc_id", "text", *names, "gone__"] and {r.doc_id: r.text for r in again.collect()} == got
    kept = line_dedup.clean_documents(clashing)
    assert kept.columns == clashing.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in df.collect()} - {3, 11}


def test_patience_alignment():
    x = np.array([1, 2, 3, 4, 5, 9, 7])
    y = np.array([8, 2, 3, 4, 6, 9, 7])
    assert sorted(line_dedup.patience(x, y)) == [(1, 1, 3), (5, 5, 2)]
    assert line_dedup.patience(x, np.array([], np.int64)) == []
    assert sum(n for *_, n in line_dedup.patience(np.array([1, 1, 1]), np.array([1, 1]))) == 2


def test_decontamination(spark, docs, empty):
    item = "Tom Baker bought 12 kg of apples and then sold 5 kg to the market before noon on that day."
    other = item.replace("12", "40").replace(" 5 ", " 7 ")
    moved = item.replace("12", "40").replace(" 5 ", " 40 ")
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "short item only"), (5, item)], "item_id long, text string")
    rows = [(100, prose(50) + " " + item + " " + prose(20)), (101, prose(10) + " " + other), (102, moved + " and " + prose(5)), (103, prose(60)), (104, None), (105, "we have a short item only"), (106, "short item only"), (107, item.upper().replace("12", "3"))]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item_id", F.lit(9))
    got = {(r.doc_id, r.item_id): r.changed for r in decontaminate.contaminated(df, bench).collect()}
    assert got[(100, 1)] is False and got[(101, 1)] is True and (100, 5) in got and (103, 1) not in got and (106, 4) in got
    by_join = {(r.doc_id, r.item_id): r.changed for r in decontaminate.contaminated(df, bench, most_sent=0).collect()}
    assert by_join == got
    assert decontaminate.contaminated(empty, bench).count() == 0 and decontaminate.contaminated(df, bench.limit(0)).count() == 0
    assert {r.doc_id for r in decontaminate.clean_documents(df, bench).collect()} >= {103, 104}
    assert (102, 1) not in got  # 12 -> 40 and 5 -> 40: one value for two of the item's


def test_decontamination_of_items_that_are_mostly_numbers(spark):
    numbers = " ".join(str(i * 7 + 3) for i in range(30))
    item = f"Find the median of the following list of numbers: {numbers}"
    other = " ".join(str(i * 11 + 1000) for i in range(30))
    mixed = numbers.replace("24 ", "17 ", 1)
    bench = spark.createDataFrame([(1, item), (1, item)], "item_id long, text string")
    rows = [(1, f"{prose(40)}. {item} {prose(30)}"), (2, item.replace(numbers, other)), (3, f"{prose(9)} {item[:60]} {prose(40)}"), (4, item.replace(numbers, mixed)), (None, item), (1, prose(60))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = {(r.doc_id, r.share, r.changed) for r in decontaminate.contaminated(df, bench).collect()}
    assert got == {(1, 1.0, False), (2, 1.0, True), (None, 1.0, False)}


@pytest.mark.parametrize("most_sent", [2_000_000, 0])
def test_decontamination_of_short_items(spark, most_sent):
    bench = spark.createDataFrame([(1, "What is the capital of France?"), (2, "short item only"), (3, "42"), (4, "Yes")], "item_id long, text string")
    rows = [(1, prose(30) + ". What is the capital of Spain? " + prose(30)), (2, "we have a short item only"), (3, "page 17 of 20"), (4, "page 42 of 50"), (5, "17"), (6, "capital of France"), (7, prose(20))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = {(r.doc_id, r.item_id, r.changed) for r in decontaminate.contaminated(df, bench, most_sent=most_sent).collect()}
    assert got == {(1, 1, True), (2, 2, False), (4, 3, False), (5, 3, True)}


@pytest.mark.parametrize("most_sent", [2_000_000, 0])
def test_decontamination_of_items_without_literal_windows(spark, most_sent):
    item = "Add 3 5 8 13 21 34 55 89 144 233 377 610"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    df = spark.createDataFrame([(1, f"{prose(40)}. {item} {prose(30)}"), (2, prose(50))], "doc_id long, text string")
    assert {(r.doc_id, r.item_id, r.share) for r in decontaminate.contaminated(df, bench, most_sent=most_sent).collect()} == {(1, 1, 1.0)}


def decontaminated_by_force(docs, items, share=0.6, size=8, literal=5, gap=8):
    """All pairs of documents and items, by loops over their template words."""
    import pyarrow as pa

    def words(text):
        shape, value, plain, _ = decontaminate.templates(pa.array([text]))
        return shape.tolist(), [0 if p else v for v, p in zip(value.tolist(), plain.tolist(), strict=True)]

    out = set()
    for d, text in docs:
        its, its_slots = words(text)
        for i, item in items:
            mine, slots = words(item)
            n = len(mine)
            width = min(size, n)
            if not n:
                continue
            rich = [p for p in range(n - width + 1) if sum(s == 0 for s in slots[p : p + width]) >= literal] or list(range(n - width + 1))
            of = lambda g, q, p: mine[p : p + width] == its[q : q + width]
            lines = sorted({q - p for p in rich for q in range(len(its) - width + 1) if of(0, q, p)})
            runs = [[g] for g in lines]
            for g in lines:
                if runs and len(runs) > len(lines) and g - runs[-1][-1] <= gap:
                    runs[-1].append(g)
                else:
                    runs.append([g])
            for run in runs:
                same = {g: [p for p in range(n - width + 1) if 0 <= p + g <= len(its) - width and of(0, p + g, p)] for g in run}
                pairs = {}
                for g in sorted(run, key=lambda g: (-len(same[g]), g)):
                    for k in sorted({p + j for p in same[g] for j in range(width)} - set(pairs)):
                        pairs[k] = (slots[k], its_slots[k + g])
                used = {p for p in pairs.values() if p[0]}
                changed = any(a != b for a, b in pairs.values())
                agree = len({a for a, _ in used}) == len({b for _, b in used}) == len(used)
                said = n >= size or not changed or any(s == 0 for s in slots) or len(its) == n
                if len(pairs) >= share * n and agree and said:
                    out.add((d, i))
    return out


@pytest.mark.parametrize("most_sent", [2_000_000, 0])
def test_decontamination_by_force(spark, most_sent):
    r = random.Random(21)
    names, units = ["Tom", "Anna", "Berlin", "Quito"], ["kg", "km", "hours", ""]
    word = lambda: r.choice([r.choice(VOCAB), r.choice(VOCAB), r.choice(VOCAB), r.choice(names), f"{r.randint(1, 99)} {r.choice(units)}"])
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate([2, 4, 6, 8, 9, 12, 15, 18, 20, 25, 30, 40])]
    rows = []
    for k, text in items:
        for how in ("copy", "numbers", "inserted", "left out", "half"):
            w = text.split()
            if how == "numbers":
                w = [str(1000 + int(x)) if x.isdigit() else x for x in w]
            if how == "inserted":
                w[len(w) // 2 : len(w) // 2] = ["newly", "added"]
            if how == "left out":
                del w[len(w) // 3 : len(w) // 3 + 1]
            if how == "half":
                w = w[: len(w) // 2]
            rows.append((len(rows), f"{prose(20, r)}. {' '.join(w)} {prose(9, r)}"))
    rows += [(500 + k, prose(60, r)) for k in range(20)] + [(600, ""), (601, " ".join(t for _, t in items))]
    got = {(x.doc_id, x.item_id) for x in decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string"), most_sent=most_sent).collect()}
    assert got == decontaminated_by_force(rows, items)
    assert all((k * 5 + j, k) in got for k, text in items for j in (0, 1)) and all((k * 5 + 2, k) in got for k in (9, 10, 11))


def test_fingerprints(spark, docs, empty):
    rows = sorted([(i, t or "") for i, t, *_ in corpus()], key=lambda r: -r[0])
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).dropDuplicates(["doc_id"])
    got = {r.doc_id: r for r in fingerprint.with_next(base, rows=2).collect()}
    ids = list(dict.fromkeys(i for i, _ in rows))
    texts = dict(rows)
    for k, i in enumerate(ids):
        assert got[i].next_text == texts[ids[(k + 1) % len(ids)]]
    assert got[1].sketch == got[3].sketch and len(got[4].sketch) == 0
    pair = spark.createDataFrame([(got[10].sketch, got[11].sketch, [], [])], "a array<long>, b array<long>, c array<long>, e array<long>")
    near, none, half = pair.select(fingerprint.likeness("a", "b"), fingerprint.likeness("c", "e"), fingerprint.likeness("a", "c")).first()
    assert near > 0.98 and none == 1.0 and half == 0.0
    h = fingerprint.with_sketch(spark.createDataFrame([(prose(4000),)], "text string"), "text", "s").first().s
    assert 400 < len(h) < 600 and h == sorted(h)
    merged = pair.select(fingerprint.merge("a", "b").alias("m")).first().m
    assert set(merged) == set(got[10].sketch) | set(got[11].sketch)
    assert fingerprint.with_next(empty.select("doc_id", "text")).count() == 0


def test_edited_texts_by_force(spark):
    import hashlib

    r = random.Random(3)
    spread = [(i, prose(r.randint(0, 40), r)) for i in [*range(0, 600, 3), 10**18, -(2**62), 2**63 - 1, -(2**63), 2**53 + 1, 2**53 + 3]]
    many = [(i, prose(r.randint(0, 30), r)) for i in range(300)] + [(150, f"text {k}") for k in range(300)] + [(None, f"none {k}") for k in range(200)]
    for rows in (spread, many, [(1, None)], [(5, "é🙂 b c d e f"), (4, "")]):
        df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("range", F.lit(1)).withColumn("_place", F.lit("x")).repartition(3)
        got = fingerprint.edited(df, rows=8).select("doc_id", "n_chars", "edited", "sketch", "edited_sketch", "next_sketch", fingerprint.likeness("sketch", "edited_sketch").alias("near_edited"), fingerprint.likeness("sketch", "next_sketch").alias("near_next")).collect()
        hashes = {x.t: x.h for x in df.select(F.coalesce("text", F.lit("")).alias("t"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()}
        order = sorted(((i, t or "") for i, t in rows), key=lambda x: (x[0] is None, -(x[0] or 0), hashes[x[1]]))
        texts = spark.createDataFrame([(t,) for t in {t for _, t in order}], "t string")
        sketches = {x.t: x.s for x in fingerprint.with_sketch(texts, "t", "s").select("t", "s").collect()}
        like = lambda a, b: len(set(a) & set(b)) / min(len(a), len(b)) if a and b else float(len(a) == len(b))
        want = Counter()
        for k, (i, t) in enumerate(order):
            following = order[(k + 1) % len(order)][1]
            edit = t[: len(t) - len(t) // 3] + following[: len(t) // 3]
            want[i, len(t), hashlib.sha256(edit.encode()).hexdigest(), round(like(sketches[t], sketches[following]), 9)] += 1
        assert Counter((x.doc_id, x.n_chars, hashlib.sha256(x.edited.encode()).hexdigest(), round(x.near_next, 9)) for x in got) == want
        assert all(round(like(x.sketch, x.edited_sketch), 9) == round(x.near_edited, 9) for x in got)
    place, key, _ = fingerprint.ranges(spark.createDataFrame(spread, "doc_id long, text string"), 8)
    df = spark.createDataFrame(spread, "doc_id long, text string").select("doc_id", F.lit(0).cast("long").alias("_tie"), F.col("doc_id").cast("double").alias("_id"))
    assert place(df).select(key.alias("k")).groupBy("k").count().agg(F.max("count")).first()[0] <= 40
    place, key, _ = fingerprint.ranges(spark.createDataFrame(many, "doc_id long, text string"), 8)
    df = spark.createDataFrame(many, "doc_id long, text string").select("doc_id", F.xxhash64("text").alias("_tie"), F.coalesce(F.col("doc_id").cast("double"), F.lit(0.0)).alias("_id"))
    assert place(df).select(key.alias("k")).groupBy("k").count().agg(F.max("count")).first()[0] <= 40


def test_predecessors_in_groups(spark):
    keys = [0, 1, 5, 1023, 1024, 5000, 2**40]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    want = {k: keys[i - 1] for i, k in enumerate(keys)}
    for most in (4096, 5):
        assert {r.k: r.prev for r in fingerprint.predecessors(df, len(keys), most).collect()} == want


RX = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(s):
    return sum((d if i % 2 == 0 else 2 * d - 9 * (d > 4)) for i, d in enumerate(map(int, s[::-1]))) % 10 == 0


def base_spans(x):
    out = []
    for kind, rx in RX.items():
        for m in re.finditer(rx, x):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in m[0].split(".")), "card": lambda: 13 <= len(d) <= 19 and luhn(d), "phone": lambda: 9 <= len(d) <= 15}[kind]():
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


def test_pii_base(spark, empty):
    r = random.Random(8)
    texts = ["", None, "x@y.z..w é🙂 a@b.c%d@e.f 1.2.3.4.5.6.7.8 0001.2.3.255 1.2.3.256", "4111 1111-1111 1111 41111111111111111111 4111  1111 1111 1111", "+1 (366) 555-9807 ++12345678 +123456789-", "a" * 30000 + " @ " + "9" * 5000 + "1 " * 4000 + "." * 100, "é" * 10 + "4111111111111111"]
    texts += ["".join(r.choice("aZ9.@+-% (0é1") for _ in range(60)) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("base", F.lit(1))
    got = {x.doc_id: x.s for x in pii.find(df).select("doc_id", pii.joined(F.col("base")).alias("s")).collect()}
    assert got == {i: base_spans(t or "") for i, t in enumerate(texts)}
    assert pii.find(empty).count() == 0


def test_pii_terms_and_sanitised(spark):
    mail = "jane@host.org"
    rows = [(i, f"{prose(3)} Zebulon {prose(1)} {mail} {prose(4)}") for i in range(6)] + [(10 + i, prose(30)) for i in range(800)] + [(900, "met Zebulon today")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = pii.find(df, support=3)
    got = {r.doc_id: r for r in pii.sanitise(found).collect()}
    at = rows[-1][1].index("Zebulon")
    assert [(s.kind, s.start, s.end) for s in got[900].extra] == [("term", at, at + 7)] and got[900].sanitised == "met [TERM] today"
    assert "[EMAIL]" in got[0].sanitised and mail not in got[0].sanitised and not got[10].extra and got[10].sanitised == rows[6][1]
    many = pii.with_hits(df, spark.createDataFrame([("zebulon",), ("nothing",)], "term string"), most=1)
    assert {r.doc_id for r in many.where("size(hits) > 0").collect()} == {0, 1, 2, 3, 4, 5, 900}


def terms_by_force(rows, reach=80, support=3, probability=0.5, bits=3.0):
    """The definition, by Python: terms near e-mail addresses (all that these rows hold)."""
    near, holds, entities = {}, Counter(), {}
    for d, text in rows:
        holds.update({w.lower() for w in re.findall(r"[^\W\d_]{4,}", text)})
        for m in re.finditer(RX["email"], text):
            left, right = text[max(0, m.start() - reach - 1) : m.start()], text[m.end() : m.end() + reach + 1]
            left = re.sub(r"^([^\W\d_]+|.)", "", left, flags=re.S) if len(left) > reach else left
            right = re.sub(r"([^\W\d_]+|.)\Z", "", right, flags=re.S) if len(right) > reach else right
            for e in (m[0].lower(), ":"):
                entities.setdefault(e, set()).add(d)
                for w in {w.lower() for side in (left, right) for w in re.findall(r"[^\W\d_]{4,}", side)}:
                    x = near.setdefault((w, e), (set(), set(), set(), set()))
                    for held, v in zip(x, (d, left, right, m[0].lower()), strict=True):
                        held.add(v)
    out = set()
    for (w, e), (docs, left, right, values) in near.items():
        p = len(docs) / holds[w]
        if min(len(left), len(right)) >= support and (e != ":" or len(values) >= support) and p >= probability and np.log2(p * len(rows) / len(entities[e])) >= bits:
            out.add(w)
    return out


def test_pii_terms_by_force_and_their_recall(spark):
    """Names that give an address away in most of their documents, words that stand before any address, and names that only
    sometimes stand near one."""
    r = random.Random(12)
    name = lambda: "".join(r.choices("aeiou", k=1) + r.choices("bcdfgklmnprstvz", k=7))
    rows, telling, plain = [], {name() for _ in range(30)}, {name() for _ in range(30)}
    for k, w in enumerate(sorted(telling)):
        rows += [f"{prose(r.randint(3, 20), r)} {w} {prose(2, r)} p{k}@host.org {prose(r.randint(3, 20), r)}" for _ in range(5)] + [f"{prose(9, r)} {w.upper()} {prose(9, r)}"]
    for k, w in enumerate(sorted(plain)):
        rows += [f"{prose(8, r)} {w} q{k}@host.org {prose(8, r)}"] + [f"{prose(9, r)} {w} {prose(9, r)}" for _ in range(9)]
    rows += [f"{prose(8, r)} reachable {r.random():.9f}@any.net {prose(8, r)}" for _ in range(40)] + [prose(30, r) for _ in range(3000)]
    rows = list(enumerate(rows))
    based = pii.with_secrets(pii.with_base(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)))
    got = {x.term for x in pii.disclosing_terms(based, based.select("text")).collect()}
    assert got == terms_by_force(rows) and len(got & telling) >= 0.9 * len(telling) and "reachable" in got and not got & plain
    assert len(got - telling - {"reachable"}) <= 3


def test_pii_secrets_and_what_tells_of_them(spark):
    r = random.Random(6)
    hexed = lambda n: "".join(r.choices("0123456789abcdef", k=n - 2)) + "a7"
    rows = [(i, f"{prose(6)} token = \"{hexed(40)}\" {prose(6)}") for i in range(8)] + [(10 + i, prose(20)) for i in range(400)]
    rows += [(900, f"aaaaaaaaaaaaaaaaa1 {'9' * 30} verylongwordwithoutdigits x{'a1' * 4} é{hexed(20)}é"), (901, "the token alone"), (902, f"{hexed(18)}@host.org 4111111111111111")]
    got = {x.doc_id: x for x in pii.sanitise(pii.find(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    kinds = lambda i: [s.kind for s in got[i].extra]
    assert kinds(0) == ["secret", "term"] and kinds(900) == ["secret"] and kinds(901) == ["term"] and kinds(902) == [] and kinds(10) == []
    assert "[SECRET]" in got[0].sanitised and got[901].sanitised == "the [TERM] alone" and got[902].sanitised == "[EMAIL] [CARD]"
    sure = {x.doc_id: x.sanitised for x in pii.sanitise(pii.find(spark.createDataFrame(rows[:-2], "doc_id long, text string"))).collect()}
    assert "token" not in sure[0] and "[TERM]" not in sure[0] and "[SECRET]" in sure[0]


def test_toxicity_held_out(spark, empty):
    r = random.Random(4)
    bad = ["grunk", "vexil", "morbo", "snarf", "plegh"]
    rows = []
    for i in range(900):
        words = prose(r.randint(5, 80), r).split()
        toxic = i % 6 == 0
        for _ in range(r.randint(1, 6) if toxic else 0):
            words.insert(r.randrange(len(words)), r.choice(bad) + r.choice(["", ".", "!"]))
        rows.append((i, " ".join(words), int(toxic)))
    df = spark.createDataFrame([(i, t, "z") for i, t, _ in rows] + [(5000, None, "z"), (5001, "", "z"), (5002, "clean " * 20000, "z")], "doc_id long, text string, toxic string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i % 2 == 0] + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.train(df, labels)
    got = {x.doc_id: x for x in toxicity.score(df, model).collect()}
    wrong = [i for i, _, y in rows if i % 2 and bool(y) != got[i].is_toxic]
    assert len(wrong) <= 2 and model["thresholds"] == sorted(model["thresholds"]) and len(model["thresholds"]) == 2
    assert not got[5000].is_toxic and not got[5001].is_toxic and not got[5002].is_toxic
    kept = {x.doc_id for x in toxicity.clean_documents(df, labels).collect()}
    assert kept == {i for i in got if not got[i].is_toxic}
    assert toxicity.score(empty, model).count() == 0
    none = toxicity.train(df, labels.where("toxic = 0"))
    assert toxicity.score(df, none).where("is_toxic").count() == 0
    for texts in (df.withColumn("text", F.lit("")), df.withColumn("text", F.lit(None).cast("string")), df.where("doc_id > 9999"), df.where("doc_id % 6 <> 0")):
        model = toxicity.train(texts, labels)
        assert {x.grade for x in toxicity.score(df, model).collect()} == {0} and toxicity.clean_documents(df, labels.limit(0)).count() == df.count()


def test_toxicity_grades_held_out(spark):
    r = random.Random(14)
    words = {1: ["dumb", "silly"], 2: ["vexil", "grunk"], 3: ["plegh", "morbo"]}
    rows = []
    for i in range(1200):
        grade = r.choice([0, 0, 0, 1, 2, 3])
        own = prose(r.randint(5, 60), r).split() + ([r.choice(words[grade]) for _ in range(3)] if grade else [])
        r.shuffle(own)
        rows.append((i, " ".join(own), grade))
    df = spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, g) for i, _, g in rows if i % 2], "doc_id long, severity int")
    model = toxicity.train(df, labels)
    got = {x.doc_id: x for x in toxicity.score(df, model).collect()}
    held_out = [(g, got[i]) for i, _, g in rows if not i % 2]
    assert len(model["thresholds"]) == 3 and sum(g == x.grade for g, x in held_out) >= 0.95 * len(held_out)
    means = [np.mean([x.expected_severity for g, x in held_out if g == k]) for k in range(4)]
    assert means == sorted(means)


def test_heaviest_run():
    from itertools import combinations

    r = random.Random(2)
    for _ in range(200):
        v = r.sample(range(20), r.randint(0, 7))
        w = [r.randint(1, 9) for _ in v]
        best = max((sum(w[i] for i in c) for k in range(len(v) + 1) for c in combinations(range(len(v)), k) if all(v[a] < v[b] for a, b in zip(c, c[1:]))))
        got = line_dedup.heaviest_run(v, w)
        assert all(v[a] < v[b] for a, b in zip(got, got[1:])) and sum(w[i] for i in got) == best
