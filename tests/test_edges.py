"""NULLs, empty tables and limits of the column functions and operators."""

import math

import pytest
from pyspark.sql import functions as F

from orrery.functions import numeric as N
from orrery.functions import regions as R
from orrery.functions import strings as S
from orrery.functions import vectors as V
from orrery.operators import columns as C
from orrery.operators import diff as D
from orrery.operators import groups as G
from orrery.operators import histogram as H
from orrery.operators import intervals as I
from orrery.operators import rows as W


def one(spark, *cols):
    return tuple(spark.range(1).select(*cols).first())


def test_undefined_values_are_null(spark):
    lit = F.lit
    assert one(spark, N.int_div(lit(7), lit(0)), N.remainder(lit(7), lit(0)), N.square_root(lit(-1.0)), N.natural_log(lit(0.0)), N.arc_sine(lit(2.0)), N.to_int(lit(1e300)), N.defined(lit(float("nan")))) == (None,) * 7
    assert one(spark, N.int_div(lit(-7), lit(2)), N.remainder(lit(-7), lit(2)), N.round_up_half(lit(-2.5)), N.to_int(lit(-2.9))) == (-3, -1, -2.0, -2)
    assert one(spark, N.choose(F.lit(None).cast("boolean"), lit(1), lit(2)), N.lesser(lit(1), F.lit(None).cast("int"))) == (None, 1)


def test_strings_and_bits(spark):
    lit = F.lit
    assert one(spark, S.middle(lit("abc"), lit(0), lit(2)), S.middle(lit("abc"), lit(9), lit(2)), S.find(lit("abc"), "z"), S.find(lit("abc"), "c")) == (None, "", None, 3)
    assert one(spark, S.bits_and(lit("110"), lit("11")), S.bits_or(lit("100"), lit("1")), S.bits_not(lit("10")), S.bits_equal(lit("0101"), lit("x1")), S.bits_less(lit("1x1"), lit("100"))) == ("010", "101", "01", False, False)
    assert one(spark, S.stripped(lit("ab  ")), S.stripped(lit("*  "), "*"), S.bits_count(lit("1011"))) == ("ab", None, 3)


def test_vector_reductions(spark):
    v = F.array(F.lit(3.0), F.lit(None), F.lit(1.0), F.lit(2.0), F.lit(9.0))
    none = F.array(F.lit(None).cast("double"))
    assert one(spark, V.vec_sum(v), V.vec_median(v), V.n_valid(v), V.n_elements(v)) == (15.0, 2.0, 4, 5)
    assert one(spark, V.vec_sum(none), V.vec_mean(none), V.vec_median(none), V.vec_std(none)) == (None, None, None, 0.0)
    assert one(spark, V.vec_std(F.array(F.lit(5.0))), V.resized(F.array(F.lit(1)), 3, 0)) == (0.0, [1, 0, 0])
    with pytest.raises(IndexError):
        V.element(v, 6, shape=(5,))


def test_regions(spark):
    inside = lambda *a: one(spark, *a)
    square = (0, 0, 4, 0, 4, 4, 0, 4)
    assert inside(*(R.polygon(F.lit(x), F.lit(y), *square) for x, y in ((2.0, 2.0), (4.0, 2.0), (5.0, 2.0), (0.0, 0.0)))) == (True, True, False, True)
    assert inside(R.point(F.lit(1.4), F.lit(1.0), 1, 1), R.line(F.lit(2.0), F.lit(0.2), 0, 0, 5, 0), R.elliptannulus(F.lit(3.0), F.lit(0.0), 0, 0, 2, 1, 4, 2), R.boxannulus(F.lit(0.0), F.lit(0.0), 0, 0, 2, 2, 6, 6)) == (True, True, True, False)
    assert inside(R.sector(F.lit(1.0), F.lit(-0.1), 0, 0, 350, 10), R.panda(F.lit(0.0), F.lit(2.0), 0, 0, 80, 100, 1, 1, 3, 1), R.epanda(F.lit(3.0), F.lit(0.0), 0, 0, 350, 10, 1, 2, 1, 4, 2, 1), R.bpanda(F.lit(0.5), F.lit(0.0), 0, 0, 350, 10, 1, 2, 2, 6, 6, 1)) == (True, True, True, False)
    assert R.read_region_lines(["# c", "circle(1,2,3); -box(1 2 3 4 0)"]) == [("+", "circle", (1, 2, 3)), ("-", "box", (1, 2, 3, 4, 0))]
    assert inside(R.in_region([("-", "circle", (0, 0, 1))], F.lit(0), F.lit(0)), R.in_region([("-", "circle", (0, 0, 1))], F.lit(5), F.lit(0))) == (False, True)


def test_row_ranges():
    assert W.parse_ranges("1-5, 9,20-") == [(1, 5), (9, 9), (20, None)]
    for bad in ("5-1", "a", "", "0"):
        with pytest.raises(ValueError):
            W.parse_ranges(bad)


def test_row_order_on_empty_and_null(spark):
    empty = spark.createDataFrame([], "k int, v int")
    assert W.with_row(empty, "k").count() == 0
    assert W.accumulate(empty, "v", "s", ("k",)).count() == 0
    df = spark.createDataFrame([(3, None), (1, 5), (2, None), (4, 7)], "k int, v int")
    rows = W.with_row(df, "k")
    assert [r.s for r in W.accumulate(rows, "v", "s").orderBy("k").collect()] == [5, 5, 5, 12]
    assert [r.d for r in W.difference(rows, "v", "d").orderBy("k").collect()] == [5, None, None, None]
    assert [r.v for r in G.carry_forward(df, ["v"], "k").orderBy("k").collect()] == [5, 5, 5, 7]
    assert W.first_match(rows, F.col("v") > 99).first()[0] == 0


def test_columns(spark):
    df = spark.createDataFrame([(1, 2, 3)], "ab int, aB2 int, c1 int")
    assert C.resolve(df, "AB2") == "aB2"
    with pytest.raises(KeyError):
        C.resolve(df, "zz")
    assert C.matching(df, "c#") == ["c1"]
    assert C.describe(C.with_attributes(df, "ab", unit="m")).where("name = 'ab'").first().unit == "m"
    a = W.with_row(spark.createDataFrame([(1,), (2,)], "x int"), "x")
    b = W.with_row(spark.createDataFrame([("q",)], "y string"), "y")
    assert sorted(tuple(r) for r in C.merge_by_position(a, b).collect()) == [(1, 1, "q"), (2, 2, "")]


def test_histogram_rules(spark):
    df = spark.createDataFrame([(1, 0.5), (2, 1.0), (2, None), (9, math.nan), (5, 2.0)], "i int, f double")
    got = {r.bin1: r.value for r in H.histogram(df, [H.Axis("i", 1, 5, 1)]).collect()}
    assert got == {1: 1, 2: 2, 3: 0, 4: 0, 5: 1}
    got = {r.bin1: r.value for r in H.histogram(df, [H.Axis("f", None, None, 0.5)]).collect()}
    assert got == {1: 1, 2: 1, 3: 0, 4: 1}
    with pytest.raises(TypeError):
        H.histogram(spark.createDataFrame([("a",)], "s string"), [H.Axis("s")])
    assert sum(r.value for r in H.histogram(spark.createDataFrame([], "i int"), [H.Axis("i", 0, 3, 1)]).collect()) == 0


def test_intervals_and_diff(spark):
    t = spark.createDataFrame([(1.0,), (2.0,), (3.5,), (None,)], "t double")
    g = spark.createDataFrame([(1.0, 2.0), (9.0, 3.0)], "start double, stop double")
    assert sorted(r.t for r in I.in_intervals(t, "t", g).collect()) == [1.0, 2.0]
    assert I.in_intervals(t, "t", g.limit(0)).count() == 0 and I.in_intervals(t, "t", g.limit(0), keep=False).count() == 4
    assert I.with_interval(t, "t", g.limit(0)).count() == 0 and sorted(r.t for r in I.in_intervals(t, "t", g, keep=False).where("t is not null").collect()) == [3.5]
    assert I.in_intervals(t, "t", g, keep=False).count() == 2
    a = spark.createDataFrame([(1, 1.0, "x", [1.0]), (2, math.nan, None, None)], "k int, f double, s string, v array<double>")
    assert D.table_diff(a, a, "k").count() == 0
    b = spark.createDataFrame([(1, 1.05, "y", [2.0]), (2, math.nan, None, None)], "k int, f double, s string, v array<double>")
    assert sorted(r.column_name for r in D.table_diff(a, b, "k").collect()) == ["f", "s", "v"]
    assert sorted(r.column_name for r in D.table_diff(a, b, "k", tolerance=0.1).collect()) == ["s", "v"]
    assert {(r.name, r.only_in) for r in D.column_diff(a, b.drop("s").withColumn("z", F.lit(1))).collect()} == {("s", "a"), ("z", "b")}
    cards = spark.createDataFrame([("A", 0, "1", ""), ("B", 0, "2", "c")], "keyword string, n int, value string, comment string")
    other = spark.createDataFrame([("a", 0, "3", ""), ("B", 0, "2", "d")], "keyword string, n int, value string, comment string")
    assert sorted(r.kind for r in D.header_diff(cards, other).collect()) == ["comment", "value"]


def test_long_intervals_are_listed_twice_at_most(spark):
    import random

    r = random.Random(1)
    spans = [(x := r.uniform(-1e6, 1e6), x + r.choice([0, 1e-3, 1, 50, 1e5, 1e6]) * r.random()) for _ in range(300)]
    times = [r.uniform(-1e6, 1e6) for _ in range(200)] + [s for s, _ in spans[:50]] + [e for _, e in spans[50:100]]
    g, t = spark.createDataFrame(spans, "start double, stop double"), spark.createDataFrame([(x,) for x in times], "t double")
    listed, _ = I._listed(g, "start", "stop")
    assert listed.count() <= 2 * len(spans)
    want = sorted((x, s, e) for x in times for s, e in spans if s <= x <= e)
    assert sorted(tuple(x) for x in I.with_interval(t, "t", g).select("t", "start", "stop").collect()) == want
    assert sorted(x.t for x in I.in_intervals(t, "t", g).collect()) == sorted(x for x in times if any(s <= x <= e for s, e in spans))


def test_few_rows_meet_in_vain(spark):
    n = 1500
    t = spark.range(n).select(F.col("id").cast("double").alias("t"))
    g = t.select(F.col("t").alias("start"), (F.col("t") + 600).alias("stop"))
    pairs = I.with_interval(t, "t", g)
    assert pairs.count() == sum(min(k, 600) + 1 for k in range(n))
    join = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=merge" in join
    listed, falls = I._listed(g, "start", "stop", I.FINER)
    assert listed.count() <= 9 * n
    met = t.withColumn("_at", F.col("t")).select(F.explode(falls).alias("_p")).join(listed, (F.col("_p.level") == F.col("_level")) & (F.col("_p.bucket") == F.col("_bucket")))
    assert met.count() < 1.5 * pairs.count()  # about three times as many with buckets as wide as the intervals


def test_interval_totals_without_pairs(spark):
    import random

    r = random.Random(2)
    spans = [(x := r.uniform(-1e3, 1e3), x + r.choice([0, 1e-3, 1, 50, 1e3, math.inf]) * max(r.random(), 1e-9), r.choice([None, *range(50)])) for _ in range(300)] + [(5.0, 1.0, 0), (None, 3.0, 0), (3.0, None, 0)]
    times = [r.uniform(-1e3, 1e3) for _ in range(200)] + [x[0] for x in spans[:50]] * 2 + [x[1] for x in spans[50:100]] + [None, -1e4, 0.0, -0.0]
    g, t = spark.createDataFrame(spans, "start double, stop double, gid int"), spark.createDataFrame([*enumerate(times)], "k int, t double")
    held = {k: [x[2] for x in spans if x[0] is not None and x[1] is not None and x[0] <= v <= x[1]] for k, v in enumerate(times) if v is not None}
    want = sorted((k, len(v), min((x for x in v if x is not None), default=None)) for k, v in held.items() if v)
    assert sorted(tuple(x) for x in I.interval_totals(t, "t", g, "gid").select("k", "n_intervals", "least").collect()) == want
    assert I.interval_totals(t, "t", g.limit(0), "gid").count() == 0 and I.interval_totals(t.limit(0), "t", g, "gid").count() == 0
    n = 200_000  # 2 * 10^10 pairs
    many = spark.range(n)
    got = I.interval_totals(many, "id", many.select(F.col("id").alias("start"), F.lit(1e6).alias("stop"), (n - F.col("id")).alias("gid")), "gid")
    assert got.where((F.col("n_intervals") == F.col("id") + 1) & (F.col("least") == n - F.col("id"))).count() == n == got.count()


def test_offsets_over_blocks_and_gaps(spark):
    rows = [(k, k * 10) for k in range(1, 60) if k % 7]
    df = spark.createDataFrame(rows, "_row long, v int").repartition(3)
    for by in (1, -1, 3, -8, 100):
        want = sorted((k, v, dict(rows).get(k + by, -1)) for k, v in rows)
        assert sorted(tuple(x) for x in W.offset(df, "v", by, "o", missing=-1, block=8).collect()) == want
        assert sorted(tuple(x) for x in W.offset(df, "v", by, "o", missing=-1, most=0).select("_row", "v", "o").collect()) == want


def test_diffs_of_rows_that_one_table_lacks(spark):
    a, b = (spark.createDataFrame(x, "k int, v int") for x in ([(1, 1), (2, 2), (None, 5)], [(2, 3), (4, 4), (None, 5)]))
    got = {tuple(x) for x in D.table_diff(a, b, "k").collect()}
    assert got == {(1, None, None, None, "a"), (2, "v", "2", "3", None), (4, None, None, None, "b")}
    assert D.diff_summary(a, b, "k").first().asDict() == {"cells_differ": 1, "rows_differ": 1, "rows_only_a": 1, "rows_only_b": 1, "ratio": 0.5}


def test_checksum_words(spark):
    df = spark.createDataFrame([(bytearray(b"\xff\xff\xff\xff\x00\x00\x00\x02\x01"),)], "b binary")
    words = df.select(F.explode(G.words_of(F.col("b"))).alias("w"))
    assert [r.w for r in words.collect()] == [2**32 - 1, 2, 2**24]
    assert words.agg(G.folded_sum(F.col("w"))).first()[0] == 2 + 2**24


def test_headers(spark):
    from orrery.operators import headers as A

    h = spark.createDataFrame([(0, 0, "SIMPLE", 0, "True", ""), (0, 1, "BITPIX", 0, "7", ""), (0, 2, "NAXIS", 0, "0", ""), (0, 3, "OBJECT", 0, "x", "what"), (0, 4, "bad key", 0, None, "")], "hdu int, place int, keyword string, n int, value string, comment string")
    value = lambda t, k: [r.value for r in t.where(A.is_keyword(k)).orderBy("place").collect()]
    assert value(A.set_card(h, 0, "object", "y"), "OBJECT") == ["y"] and value(A.set_card(h, 0, "NEW", 5), "NEW") == ["5"]
    long = A.append_card(h, 0, "HISTORY", "a" * 100)
    assert value(long, "HISTORY") == ["a" * 72, "a" * 28] and A.counts(long).where("keyword = 'HISTORY'").first().n_cards == 2
    assert value(A.rename_keyword(h, 0, "OBJECT", "TARGET"), "TARGET") == ["x"]
    with pytest.raises(ValueError):
        A.rename_keyword(h, 0, "OBJECT", "NAXIS")
    assert sorted(r.place for r in A.delete_cards(h, 0, "?A*").collect()) == [0, 1, 2]
    assert {(r.keyword, r.check) for r in A.verify(h).collect()} == {("BITPIX", "BITPIX value")}


def test_text_expressions(spark):
    from orrery.operators import expressions as X

    X.register(spark)
    df = spark.createDataFrame([(1, 2.0, "ab"), (2, None, None)], "k int, x double, s string")
    kinds = {"k + 1": "int", "k + 1L": "bigint", "k / 2": "double", "k > 1 OR x < 3 AND NOT k = 2": "boolean", "k * x": "double", "s || 'c'": "string", "near(x, 2, 0.1)": "boolean", "int_div(k, 0)": "bigint"}
    assert {t: X.result_type(df, t) for t in kinds} == kinds
    got = X.calculated(df, a="1 + 2 * k", b="-k % 2", c="x > 1 AND k = 1 OR k = 2", d="int_div(k, 0)", e="default_null(x, -1)").orderBy("k").collect()
    assert [tuple(r)[3:] for r in got] == [(3, -1, True, None, 2.0), (5, 0, True, None, -1.0)]
    assert [r.k for r in X.rows_where(df, "x > 0").collect()] == [1]
    with pytest.raises(Exception):
        X.result_type(df, "s + nothing")
    assert one(spark, S.bits_literal("o17"), S.bits_literal("hFx"), S.bits_literal("b10x")) == ("001111", "1111xxxx", "10x")
    for bad in ("o8", "b2", "z1", "h"):
        with pytest.raises(ValueError):
            S.bits_literal(bad)


def test_image_sections():
    from orrery.operators import images as P

    assert P.parse_section("2:8:3, -*, *:2", (8, 5, 9)) == [(2, 8, 3), (5, 1, 1), (1, 9, 2)]
    for bad in ("1:9", "a", "0:3", "1,2"):
        with pytest.raises(ValueError):
            P.parse_section(bad, (8,))


def test_all_members_broadcasts_no_groups(spark, monkeypatch):
    edges = [(k, k // 3) for k in range(1, 300)] + [(1000, 1001), (1001, 1002), (1002, 1000), (1002, None), (1000, None), (None, 1000), (5, 5), (1000, 1001)]
    plans = []
    keep = G.save
    monkeypatch.setattr(G, "save", lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), keep(df))[1])
    got = G.all_members(spark.createDataFrame(edges, "group_id int, member int"))
    want = set(edges)
    while more := {(g, n) for g, m in want for k, n in edges if m is not None and m == k} - want:
        want |= more
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got.collect())
    assert len(plans) > 3 and not any("Broadcast" in p for p in plans)
