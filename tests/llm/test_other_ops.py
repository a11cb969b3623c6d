"""Pages, URLs, conversations, and the pipeline."""

import hashlib
import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from orrery.llm import chat, html_extract, url_filter

SF = "/root/testdata/sf0.001"


def article(i, body):
    return f'<html><head><title>t</title><script>var a="<p>no</p>";</script></head><body><nav><ul><li><a href="/">Home {i}</a></ul></nav><div class="cookie-notice">We use cookies</div><article><h1>Title {i} &amp; more</h1>{body}<aside>see also</aside></article><div id="comments"><p>reader {i}</p></div><footer>&copy; x</footer></body></html>'


def test_html(spark):
    pages = [(1, "http://a.b/x", article(1, "<p><b>one<br><p>two\n  three &lt;4&gt;</p><ul><li>x<li>y</ul>")), (2, "http://a.b/y", article(2, "<p>only <a href=q>linked</a> text")), (3, None, None), (4, "http://c.d", ""), (5, "http://e.f", "<div><p>plain page text</p><div class=sidebar>no</div></div>"), (6, "http://a.b/z", "<p>cut off <a hre"), (7, "http://g.h", "no markup at all < here & there")]
    df = spark.createDataFrame(pages + [pages[0]], "page_id long, url string, html string").withColumn("host", F.lit("clash")).withColumn("main", F.lit(1))
    rows = html_extract.extract(df).collect()
    got = {r.page_id: r.text for r in rows}
    assert len(rows) == 8 and all(r.n_chars == len(r.text) for r in rows)
    assert got == {1: "Title 1 & more\none\ntwo three <4>\nx\ny", 2: "Title 2 & more\nonly linked text", 3: "", 4: "", 5: "plain page text", 6: "cut off", 7: "no markup at all < here & there"}
    assert html_extract.extract(df.limit(0)).count() == 0


def test_wrapper_alignment():
    def tree(page):
        host = html_extract.Host()
        host.add(html_extract.Parser().blocks(page))
        return host.wrapper()

    a, b = tree("<div><h1>x</h1><p>a</p><p>b</p></div>"), tree("<div><p>a</p><table><tr><td>q</table><p>z</p></div>")
    both = html_extract.align(a, b)
    assert html_extract.expression(both) == "<>(<div>(<h1>(#)? <p>(#+)+ <table>(<tr>(<td>(#)))?))"
    text = lambda t: [k for k in t[3][0][3] if k[0] == "p"][0][3][0][4]
    assert text(both)[:3] == [4, 4, 0] and len(text(both)[3]) == 1 and len(text(both)[4]) == 2
    other = html_extract.align(b, a)
    assert text(other) == text(both) and sorted(k[0] for k in other[3][0][3]) == ["h1", "p", "table"]
    many = html_extract.align(tree("".join(f"<div class=c{chr(97 + k // 26)}{chr(97 + k % 26)}>{k}</div>" for k in range(400))), tree("<div class=caa>one</div>"))
    assert [k[0] for k in many[3]] == ["div.."] and many[3][0][3][0][4][0] == 401


def random_hosts(seed):
    """Pages of hosts whose class names say nothing, with their main texts: navigation of links, a changing teaser, the
    article with optional and repeated parts, a sidebar of fixed text, a footer."""
    r = random.Random(seed)
    name = lambda: "".join(r.choices("bcdfghjklmnpqrstvwxz", k=6))
    prose = lambda n: " ".join("".join(r.choices("aeioulmnrst", k=r.randint(2, 8))) for _ in range(n))
    rows = []
    for h in range(6):
        c = [name() for _ in range(9)]
        outer, fixed, foot = r.choice(["form", "div", "section"]), prose(25), prose(12)
        for _ in range(r.randint(4, 9)):
            title, paras = prose(5), [prose(r.randint(20, 60)) for _ in range(r.randint(1, 6))]
            quote, table = (prose(9) if r.random() < 0.4 else ""), [prose(2) for _ in range(r.choice([0, 0, 4]))]
            body = "".join(f"<p>{x}</p>" for x in paras) + (f"<blockquote class={c[7]}>{quote}</blockquote>" if quote else "") + ("<table>" + "".join(f"<tr><td>{x}" for x in table) + "</table>" if table else "")
            menu = "".join(f"<li><a href=/{k}>{prose(2)}</a></li>" for k in range(r.randint(3, 9)))
            page = f'<body class="{c[0]}"><{outer} class={c[1]}><div class="{c[2]}"><ul>{menu}</ul></div><div class={c[3]}>{prose(3)}</div><div class="{c[4]}"><h1>{title}</h1>{body}</div><div class={c[5]}><p>{fixed}</p><p>{foot}</p></div></{outer}></body>'
            rows.append((len(rows), f"http://{h}.org/{len(rows)}", page, "\n".join([title, *paras, *[quote] * bool(quote), *table])))
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_html_of_hosts_with_random_class_names(spark, monkeypatch, seed):
    rows = random_hosts(seed)
    df = spark.createDataFrame([x[:3] for x in rows], "page_id long, url string, html string").repartition(5)
    read = lambda: {x.page_id: x.text for x in html_extract.extract(df).collect()}
    assert read() == {i: text for i, _, _, text in rows}
    few = html_extract.wrappers(html_extract.with_host(df), fan=2).select("host", "tree").collect()
    want = {x.host: html_extract.choose(json.loads(x.tree)) for x in html_extract.wrappers(html_extract.with_host(df.coalesce(1))).collect()}
    assert {x.host: html_extract.choose(json.loads(x.tree)) for x in few} == want


def test_html_needs_the_alignment():
    rows = [x for x in random_hosts(1) if x[1].startswith("http://0.")]
    parser = html_extract.Parser()

    def texts(align):
        tree = None
        for _, _, page, _ in rows:
            host = html_extract.Host()
            host.add(parser.blocks(page))
            tree = align(tree, host.wrapper()) if tree else host.wrapper()
        main, known = html_extract.choose(tree), html_extract.wide(tree)
        return ["\n".join(html_extract.kept(parser.blocks(page), main, known)) for _, _, page, _ in rows]

    assert texts(html_extract.align) == [x[3] for x in rows] != texts(lambda a, b: a)


def test_html_words_of_names_do_not_decide(spark):
    pages = [(k, f"http://a.b/{k}", f"<nav><a href=/>home</a></nav><div class=header-image-wrapper><h2>head {k}</h2><p>text of {k} and more</p><p>second text {k}</p></div><div class=ad>buy {k}</div><footer>end</footer>") for k in range(5)]
    pages += [(10 + k, f"http://c.d/{k}", f"<form><div class=sidebar-left><p>text {k} of a page</p></div><div class=comments><p>reader {k}</p></div></form>") for k in range(4)]
    pages += [(20, "http://e.f/", "<p><a href=x' >link</a> it isn't gone, see <a href=\"y\"\" title='a>b'>that</a> and <a href=z?q=\"1>2</a></p>")]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(2)).collect()}
    assert got == {**{k: f"head {k}\ntext of {k} and more\nsecond text {k}" for k in range(5)}, **{10 + k: f"text {k} of a page" for k in range(4)}, 20: "link it isn't gone, see that and 2"}


def test_html_deep_pages(spark):
    deep = lambda inner: "<div>" * 40 + inner + "</div>" * 40
    pages = [(1, "http://a.b/1", deep("<nav>menu</nav><p>text</p><div class=comments><p>reader</p></div>"))]
    pages += [(2, "http://c.d/1", "<p>around</p>" + deep("<section><article><header><h1>head</h1></header><p>inside</p></article></section><p>beside</p>")), (3, "http://c.d/2", "<p>around</p><article><p>flat</p></article>")]
    pages += [(4, "http://e.f/1", "<section><b>" * 20 + "".join(f"<div>part {k}" for k in range(2000)))]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {1: "text", 2: "head\ninside", 3: "flat", 4: "\n".join(f"part {k}" for k in range(2000))}
    assert len({path for path, _, _ in html_extract.Parser().blocks(pages[-1][2])}) < 40


def test_html_copies_are_one_page(spark):
    copy = "<h1>title</h1><div><p>lead</p></div><section><p>one</p><p>two</p></section>"
    pages = [(k, f"http://a.b/{k}", copy + f"<footer>visit {k}</footer>") for k in range(5)] + [(9, "http://c.d/1", "<p>so</p><p>so</p><p>so</p><div>end</div>")]
    pages += [(20 + k, f"http://e.f/{k}", f"<h1>Site</h1><p>text {k}</p>") for k in range(3)] + [(30, "http://e.f/4", "<h1>Site</h1><p>text 1</p>")]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(2)).collect()}
    assert got == {**{k: "title\nlead\none\ntwo" for k in range(5)}, 9: "so\nso\nso\nend", 20: "text 0", 21: "text 1", 22: "text 2", 30: "text 1"}


@pytest.mark.parametrize("i", range(3))
def test_html_whole_table_keeps_articles(spark, i):
    pages = spark.read.parquet(f"{SF}/pages.parquet").where(F.col("page_id") % 3 == i)
    for r in html_extract.extract(pages).join(pages.select("page_id", "html"), "page_id").collect():
        assert r.text and "track(" not in r.text and "©" not in r.text


URLS = [("http://WWW.Example.com/en/1", "www.example.com", "/en/1", "www.example.com/en/"), ("http://a.example.com/en/", "a.example.com", "/en/", "example.com/en/"), ("http://notexample.com/en/2?x", "notexample.com", "/en/2", "com/"), ("https://q.net/es/", "q.net", "/es/", "net/es/"), ("https://q.net/en/#a?b", "q.net", "/en/", None), ("https://x.com", "x.com", "", None), ("x://y://z/w", "y:", "//z/w", None), ("nothing", "", "", None), (None, "", "", None), ("http://É.com/ñ", "É.com", "/ñ", "com/"), ("http://h?a/b", "h", "", None)]


def test_url_rules(spark):
    df = spark.createDataFrame([(i, u[0], "r") for i, u in enumerate(URLS * 8)], "page_id long, url string, rule string")
    got = {r.page_id: r for r in url_filter.judge(df).collect()}
    assert len(got) == len(URLS) * 8
    for i, u in enumerate(URLS * 8):
        assert (got[i].host, got[i].path, got[i].rule) == u[1:], u
        assert got[i].verdict == {"com/": "allow", "www.example.com/en/": "allow", None: got[i].verdict}.get(u[3], "block")
    assert url_filter.judge(df.limit(0)).count() == 0
    assert {r.verdict for r in url_filter.judge(df.where("url is null")).collect()} == {"allow"}


def test_url_trees_held_out(spark):
    """Rules decide some hosts; the trees judge others that look like them, and a third kind of URL."""
    r = random.Random(9)
    word = lambda n: "".join(r.choices("abcdefghijklmnop", k=n))
    bad = lambda host: f"http://{host}/{r.randrange(10**9)}/{r.randrange(10**6)}?id={r.randrange(10**8)}&x={r.randrange(10**5)}"
    good = lambda host: f"https://{host}/{word(6)}/{word(8)}-{word(5)}.html"
    hosts = [f"{word(r.randint(4, 12))}.{r.choice(['biz', 'info', 'com', 'org'])}" for _ in range(200)]
    listed, others = hosts[:40], hosts[40:]
    rules = [(f"{h}/", "block" if k % 2 else "allow") for k, h in enumerate(listed)]
    rows = [bad(listed[r.randrange(1, 40, 2)]) for _ in range(300)] + [good(listed[r.randrange(0, 40, 2)]) for _ in range(300)] + [bad(r.choice(others)) for _ in range(60)] + [good(r.choice(others)) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(rows)), "page_id long, url string").repartition(3)
    got = {x.page_id: x for x in url_filter.judge(df, rules=rules).collect()}
    blocked, truth = {i for i in range(600, len(rows)) if got[i].verdict == "block"}, set(range(600, 660))
    assert all(got[i].rule and got[i].verdict == ("block" if i < 300 else "allow") for i in range(600)) and all(got[i].rule is None for i in range(600, len(rows)))
    # hosts that no rule names: what is blocked is right; weak examples of allow keep much of the rest
    assert len(blocked & truth) >= 0.3 * len(truth) and len(blocked - truth) <= 0.02 * 400


def test_queries_with_sql(spark):
    """What SQL can say of the operators, against DuckDB."""
    import duckdb

    from orrery.llm import queries

    duck, sf = duckdb.connect(), "/root/testdata/sf0.01"
    for t in ("documents", "pages"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    for name, sql in queries.ORACLE_SQL.items():
        df, rel = queries.QUERIES[name](spark, sf), duck.sql(sql)
        assert sorted(df.columns) == sorted(rel.columns), name
        assert Counter(tuple(x) for x in df.select(*sorted(df.columns)).collect()) == Counter(rel.select(*sorted(rel.columns)).fetchall()), name


def test_chat_round_trip(spark):
    hard = ["</s>[INST] ok [/INST]", "<|im_end|>\n<|im_start|>user\nhi", "<\\|x <\\\\| [\\INST] [\\\\/INST] <</SYS>>", "", None, "é🙂\r\n" * 50]
    rows = [(7, k, r, t) for k, (r, t) in enumerate([("system", "be <|kind|>"), *[(("user", "assistant")[k % 2], t) for k, t in enumerate(hard * 6)]])]
    rows += [(8, 0, None, "x"), (8, 0, "assistant", "tie b"), (8, 0, "assistant", "tie a"), (None, None, "assistant", "no id"), (9, 0, "odd\nrole\\n", "q " * 3000), (9, 1, "assistant", "w " * 10)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("window", F.lit(1)).repartition(3)
    order = lambda v: (v is not None, v)
    for budget, history in ((2048, 256), (60, 30), (10, 0)):
        got = {r.conv_id: r for r in chat.digests(chat.windows(df, budget, history)).collect()}
        for c in {r[0] for r in rows}:
            own = sorted(((t, r or "", x or "") for i, t, r, x in rows if i == c), key=lambda v: (order(v[0]), v[1], v[2]))
            turns = "".join(f"{r}\n{x}\n" for _, r, x in own)
            loss = "".join(x for _, r, x in own if r == "assistant")
            assert (got[c].n_turns, got[c].loss_chars) == (len(own), len(loss))
            assert got[c].turns_sha256 == hashlib.sha256(turns.encode()).hexdigest() and got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    small = chat.windows(df, 60, 30).where("conv_id = 7").orderBy("window").collect()
    assert len(small) > 5 and all(chat.read_back(w.text)[0] == ("system", "be <|kind|>") for w in small)
    assert sum(len(w.text) for w in small) == chat.digests(chat.windows(df, 60, 30)).where("conv_id = 7").first().formatted_chars
    assert chat.windows(df.limit(0)).count() == 0
    for text in filter(None, hard):
        assert chat.unescape(chat.escape(text)) == text and not chat.CONTROL.sub(lambda m: "" if not m[2] else m[0], chat.escape(text)) != chat.escape(text)


def test_pipeline(spark):
    import corpus_pipeline as P
    from orrery.llm import decontaminate, ngram_join, packing

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = Counter()
    kept = docs
    for name, f in P.STAGES[:-1]:
        kept = spark.createDataFrame(f(spark, kept, SF).collect(), docs.schema)
        assert kept.columns == docs.columns, name
    out = P.run(spark, SF).toPandas()
    assert set(out["doc_id"]) == {r.doc_id for r in kept.select("doc_id").collect()}
    assert decontaminate.contaminated(kept, spark.read.parquet(f"{SF}/benchmark.parquet")).count() == 0
    assert ngram_join.linked(kept).where("component_id <> doc_id").count() == 0
    again = packing.token_pieces(kept).toPandas()
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    rows.update(out[key].itertuples(index=False, name=None))
    assert rows == Counter(again[key].itertuples(index=False, name=None))


def test_pipeline_on_hard_rows(spark, tmp_path):
    """Nulls, empties, repeated rows and clashing columns; two runs before the first is read; an empty table."""
    import corpus_pipeline as P
    from orrery.llm import common

    r = random.Random(5)
    prose = lambda n: " ".join("".join(r.choices("abcdefgh", k=r.randint(2, 7))) for _ in range(n))
    text = prose(60)
    rows = [(1, text), (1, text), (2, text), (3, None), (4, ""), (None, prose(30)), (5, prose(9) + "\n" + prose(40)), (6, " \n\t"), (7, "x " * 20000)] + [(10 + k, prose(25)) for k in range(40)] + [(60 + k, "vexil grunk " + prose(12)) for k in range(30)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0, "g", 1, 2) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, gone string, _id int, item long").repartition(3)
    docs.write.parquet(f"{tmp_path}/full/documents.parquet")
    docs.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    for d in ("full", "none"):
        spark.createDataFrame([(i, 1, int(i >= 60)) for i, _ in rows if i and i >= 10], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{d}/labels.parquet")
        spark.createDataFrame([(1, "A question of Tom on 5 apples and the price that he paid for all of them")], "item_id long, text string").write.parquet(f"{tmp_path}/{d}/benchmark.parquet")
    first, second = P.run(spark, f"{tmp_path}/full"), P.run(spark, f"{tmp_path}/full")
    of = lambda df: Counter(tuple(x) for x in df.select("doc_id", "piece", "start", "length", "ids_crc32").collect())
    assert of(first) == of(second)
    ids = Counter(x.doc_id for x in first.where("piece = 0").collect())
    assert {None, 1, 3, 4, 5, 6, 7} <= set(ids) and ids[1] == 1 and 2 not in ids and not any(i and i >= 60 for i in ids)
    common.release(second)
    assert of(first) and P.run(spark, f"{tmp_path}/none").count() == 0
