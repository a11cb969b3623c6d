"""HTML extraction with wrappers inferred from the pages of a host.

Each page becomes a token stream of its block structure. Streams of one host are aligned, one after the other, into a
union-free expression: what both have stays, what only one has becomes optional, neighbours of one kind become a repeated
group, and text becomes a slot. The streams are folded first (repeated neighbours count once), so a host has few different
ones in a task; tasks align those, and their wrappers are aligned with each other in rounds, ``fan`` at a time. A node
counts its pages; a slot also its characters, those inside links, and the texts that every page with it holds. All of
these are sums, unions and intersections, so the wrapper's numbers don't depend on the order of pages.

Main text is read from the wrapper:
1. A text that stands in a slot on every page, of three and more different ones, is template; so is all of a slot with
   one such text a page. (Pages that differ only in noise are one; where hardly any text would be left, all are copies.)
2. The region: from the root down to the child that holds most of the other text outside links, until that text is spread
   over several, or stands there itself. An article or main element around it, or several inside it, take its place.
3. Slots in the region are main, but for template, those that are mostly links (outside articles), and noise: menus,
   headers, footers, sidebars, notices, adverts, forms, reader comments (by element, role, or a word of class or id). Such
   names only make text weigh a tenth when the region is sought: where the region itself bears one it means nothing.
   A heading h1, and what stands directly in an element around the region, belongs to it unless it is template, link or noise.
A page with no text in its host's main slots is its own wrapper.

Text: character references are decoded, white space inside a block becomes one space and is trimmed, blocks are joined by
\\n in page order. Null or empty html gives an empty text; a page with no main slot gives an empty text; a null url has the
host ''. Repeated rows are extracted each; an empty table gives no rows; other columns are ignored. Nothing is cut off:
elements nested deeper than ``DEPTH`` are folded where their kind comes again, with the noise and main text they lie in.
"""

from __future__ import annotations

import html as entities
import json
import re

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm.common import save, small, table, tidied

#: An attribute's value is quoted only where the quote follows the equals sign; any other quote is a plain character.
ATTRIBUTES = r"""(?:=\s*(?:"[^"]*"|'[^']*'|[^\s>"'][^\s>]*)?|[^=>])*+"""
TOKEN = re.compile(rf"""<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|svg|iframe|select|object|canvas|math|title)\b{ATTRIBUTES}>.*?(?:</\1\s*>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)({ATTRIBUTES})(>|\Z)""", re.S | re.I)
ATTRIBUTE = re.compile(r"""([a-zA-Z_:@][\w:.-]*)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>][^\s>]*))?""")
#: Elements inside a block; all others begin and end one.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img nobr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What an opening element ends when it is open: the nearest of these, unless one of the last stands between.
CLOSES = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr", "table"), "td": ("td th", "table"), "th": ("td th", "table"), "option": ("option", "select"), "thead": ("thead tbody tfoot", "table"), "tbody": ("thead tbody tfoot", "table"), "tfoot": ("thead tbody tfoot", "table")}
#: Elements and words of class, id or role that say that what they hold is hardly main text.
NOISE_TAGS = frozenset("nav header footer aside form head button menu dialog input fieldset".split())
NOISE_WORDS = frozenset("ad ads advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promoted promotion banner banners cookie cookies consent gdpr notice notices notification notifications alert popup modal overlay newsletter subscribe subscription signup login sidebar aside widget widgets menu menus nav navbar navigation breadcrumb breadcrumbs pagination pager footer header masthead topbar toolbar comment comments commentlist disqus reply replies respond discussion share sharing social related recommended recommendations search form skip".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
MAIN_TAGS = frozenset(("article", "main"))
#: Elements that hold text rather than a part of a page.
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre blockquote figcaption address caption".split())
KNOWN = TEXTUAL | NOISE_TAGS | MAIN_TAGS | frozenset("html body div section table thead tbody tfoot tr td th ul ol dl center figure details summary hgroup span a b i".split())
#: Elements of a path that are kept as they are; those below are folded.
DEPTH = 32
#: A text is template only where so many different pages hold it.
PAGES = 3
#: Most kinds of children that an element of a wrapper may have before their classes are left out.
KINDS = 256
#: The child that leads on holds so much of the text; text of the element itself stops the way down from this share on.
LEADS, OWN = 0.6, 0.1
WRAPPERS = "host string, tree string, n long"


def words(value: str) -> set[str]:
    return set(re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower().replace("_", " ").replace("-", " ").split())


class Parser:
    """Turns pages into blocks; what it has learnt of an opening tag is kept, as pages of a host repeat them."""

    def __init__(self):
        self.known: dict[tuple[str, str], str] = {}

    def label(self, tag: str, attributes: str) -> str:
        """tag.class, with the first class (or the id) less its digits; then ! for noise, * for main text's element."""
        key = (tag, attributes)
        got = self.known.get(key)
        if got is None:
            found: dict[str, str] = {}
            for name, value in ATTRIBUTE.findall(attributes):
                found.setdefault(name.lower(), value[1:-1] if value[:1] in ("'", '"') else value)
            marks = words(found.get("class", "") + " " + found.get("id", ""))
            role = found.get("role", "").lower()
            kind = re.sub(r"[\d/!*~.]+", "", next(iter((found.get("class", "") + " " + found.get("id", "")).split()), ""))[:64]
            got = tag + "." * bool(kind) + kind
            if tag in MAIN_TAGS or role in ("main", "article") or "articlebody" in found.get("itemprop", "").lower():
                got += "!" if marks & {"comment", "comments", "related", "promo", "ad"} else "*"
            elif tag not in ("html", "body") and (tag in NOISE_TAGS or marks & NOISE_WORDS or role in NOISE_ROLES or "hidden" in found or found.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", found.get("style", ""), re.I)):
                got += "!"
            if len(self.known) < 100_000:
                self.known[key] = got
        return got

    def blocks(self, page: str) -> list[tuple[str, str, int]]:
        """(path, text, characters inside links) of each block that holds text, in page order."""
        out: list[tuple[str, str, int]] = []
        # tag, path, and the places in the path where kinds below DEPTH stand first
        open_: list[tuple[str, tuple[str, ...], str]] = []
        parts: list[str] = []
        links = linked = 0

        def push(tag, label):
            path, state = open_[-1][1:] if open_ else ((), "")
            if label[-1] in "!*" and not (state == "*" and tag == "header"):
                state = "!" if "!" in (state, label[-1]) else "*"
            if len(path) >= DEPTH:
                label = "~" + (tag if tag in KNOWN else "x") + state
                at = path.index(label, DEPTH) if label in path[DEPTH:] else -1
                open_.append((tag, path[: at + 1] if at >= 0 else (*path, label), state))
            else:
                open_.append((tag, (*path, label), state))

        def flush():
            nonlocal linked
            if parts:
                text = " ".join(entities.unescape("".join(parts)).split())
                if text:
                    out.append(("/".join(open_[-1][1]) if open_ else "", text, min(linked, len(text))))
                parts.clear()
            linked = 0

        at = 0
        for m in TOKEN.finditer(page):
            if m.start() > at:
                parts.append(page[at : m.start()])
                linked += links and m.start() - at
            at = m.end()
            if m[3] is None:
                continue
            tag = m[3].lower()
            if not m[5]:
                break  # a tag that the page's end cuts off
            if tag in INLINE:
                if tag == "a":
                    links = 0 if m[2] else 1
                elif tag == "br":
                    parts.append(" ")
                if m[4] and not m[2] and tag != "a" and tag not in VOID and self.label(tag, m[4]).endswith("!"):
                    flush()
                    push(tag, self.label(tag, m[4]))
                elif m[2] and any(x[0] == tag for x in open_[-1:]):
                    flush()
                    open_.pop()
                continue
            flush()
            if m[2]:
                for i in range(len(open_) - 1, -1, -1):
                    if open_[i][0] == tag:
                        del open_[i:]
                        links = 0
                        break
                continue
            if tag in VOID:
                continue
            if open_ and open_[-1][0] == "p":
                open_.pop()
            if tag in CLOSES:
                ends, bar = (x.split() for x in CLOSES[tag])
                for i in range(len(open_) - 1, -1, -1):
                    if open_[i][0] in ends:
                        del open_[i:]
                        break
                    if open_[i][0] in bar:
                        break
            if not m[4].rstrip().endswith("/"):
                push(tag, self.label(tag, m[4]))
        else:
            parts.append(page[at:])
        flush()
        return out


# A node of a wrapper: [label, pages, repeated, children, slot]. Label '#' is a text slot, whose slot holds
# [blocks, characters, linked characters, texts that each of its pages has, least hashes of its different pages].


def fold(paths) -> list:
    """A page's structure, from its blocks' paths in order."""
    root: list = ["", 1, 0, [], None]
    for path in paths:
        node = root
        for label in path.split("/") if path else ():
            kids = node[3]
            if not kids or kids[-1][0] != label:
                kids.append([label, 1, 0, [], None])
            node = kids[-1]
        if node[3] and node[3][-1][0] == "#":
            node[3][-1][2] = 1
        else:
            node[3].append(["#", 1, 0, [], None])
    return root


def align(a: list, b: list) -> list:
    """The union-free expression of two with the same label, of different pages: children are aligned by their longest
    common sequence of labels, the others become optional (their pages are fewer), and kinds that come again become one
    repeated group."""
    return [a[0], a[1] + b[1], a[2] | b[2], gather(aligned(a[3], b[3], align)), slot_sum(a[4], b[4])]


def beside(a: list, b: list) -> list:
    """Two instances of one kind inside a page, as a repeated group."""
    return [a[0], max(a[1], b[1]), 1, gather(aligned(a[3], b[3], beside), beside), slot_sum(a[4], b[4])]


def aligned(x: list, y: list, join) -> list:
    n, m = len(x), len(y)
    if [k[0] for k in x] == [k[0] for k in y]:
        return [join(p, q) for p, q in zip(x, y, strict=True)]
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if x[i][0] == y[j][0] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < n or j < m:
        if i < n and j < m and x[i][0] == y[j][0]:
            out.append(join(x[i], y[j]))
            i, j = i + 1, j + 1
        elif j == m or i < n and best[i + 1][j] >= best[i][j + 1]:
            out.append(x[i])
            i += 1
        else:
            out.append(y[j])
            j += 1
    return out


def gather(items: list, join=align) -> list:
    """Kinds that stand in two places of the alignment join; so an expression has each kind once. Beyond KINDS of them
    those of one tag are one kind, tag.. for any class."""
    if len({x[0] for x in items}) > KINDS or any(".." in x[0] for x in items):
        every = len({x[0] for x in items}) > KINDS
        wide = {short(x[0]) for x in items if every or ".." in x[0]}
        items = [[short(x[0]), *x[1:]] if short(x[0]) in wide else x for x in items]
    seen: dict[str, list] = {}
    for item in items:
        first = seen.get(item[0])
        seen[item[0]] = item if first is None else join(first, item)
    return list(seen.values())


def short(label: str) -> str:
    """div.class! -> div..!, and others as they are."""
    if "." not in label:
        return label
    return label.split(".")[0] + ".." + (label[-1] if label[-1] in "!*" else "")


def wide(node: list, path: str = "") -> set[str]:
    """Paths of the elements whose children of some tag are one kind, with that kind."""
    found = set()
    for k in node[3]:
        if k[0] != "#":
            own = path + "/" * bool(path) + k[0]
            found |= ({own} if ".." in k[0] else set()) | wide(k, own)
    return found


def widened(path: str, known: set[str]) -> str:
    """A page's path as the wrapper has it."""
    if not known:
        return path
    out = ""
    for label in path.split("/"):
        loose = out + "/" * bool(out) + short(label)
        out = loose if loose in known else out + "/" * bool(out) + label
    return out


def tidy(node: list) -> list:
    """One page's structure with each kind once in each element."""
    return [*node[:3], gather([tidy(k) for k in node[3]], beside), node[4]]


def slot_sum(a: list | None, b: list | None) -> list | None:
    if a is None or b is None:
        return a or b
    return [a[0] + b[0], a[1] + b[1], a[2] + b[2], sorted(set(a[3]) & set(b[3])), sorted({*a[4], *b[4]})[:PAGES]]


def expression(node: list, above: int = 0) -> str:
    """The wrapper as readable text: ( ) groups, ? optional, + repeated, # slot."""
    inner = " ".join(expression(k, node[1]) for k in node[3])
    mark = ("+" if node[2] else "") + ("?" if node[1] < above else "")
    return f"#{mark}" if node[0] == "#" else f"<{node[0]}>({inner}){mark}"


def noisy(path: str) -> bool:
    """Whether a path leads through noise; a header inside the article is the article's own."""
    inside = False
    for label in path.split("/"):
        if label.endswith("!") and not (inside and label.startswith("header")):
            return True
        inside |= label.endswith("*")
    return False


class Host:
    """The pages of one host that a task has seen: their structures, and sums by path."""

    def __init__(self):
        self.shapes: dict[str, int] = {}
        self.keys: dict[tuple, str] = {}
        self.slots: dict[str, list] = {}

    def add(self, blocks: list) -> None:
        key = tuple(p for i, (p, _, _) in enumerate(blocks) if i < 2 or p != blocks[i - 1][0] or p != blocks[i - 2][0])
        shape = self.keys.get(key)
        if shape is None:
            shape = self.keys[key] = json.dumps(tidy(fold(key)), separators=(",", ":"))
        self.shapes[shape] = self.shapes.get(shape, 0) + 1
        aloud = {p: not noisy(p) for p in set(key)}
        copy = xxhash.xxh64_intdigest("\n".join(t for p, t, _ in blocks if aloud[p]))
        mine: dict[str, list] = {}
        for path, text, linked in blocks:
            s = mine.setdefault(path, [0, 0, 0, set(), [copy]])
            s[0], s[1], s[2] = s[0] + 1, s[1] + len(text), s[2] + linked
            s[3].add(xxhash.xxh64_intdigest(text))
        for path, s in mine.items():
            self.slots[path] = slot_sum(self.slots[path], s) if path in self.slots else s

    def wrapper(self) -> list:
        tree = None
        for shape in sorted(self.shapes):
            one = times(json.loads(shape), self.shapes[shape])
            tree = align(tree, one) if tree else one
        known, slots = wide(tree), {}
        for path, s in self.slots.items():
            path = widened(path, known)
            slots[path] = slot_sum(slots[path], s) if path in slots else s
        return with_slots(tree, slots)


def times(node: list, n: int) -> list:
    return [node[0], n, node[2], [times(k, n) for k in node[3]], node[4]]


def with_slots(node: list, slots: dict[str, list], path: tuple = ()) -> list:
    if node[0] == "#":
        s = slots.get("/".join(path))
        return [*node[:4], s and [*s[:3], sorted(s[3]), s[4]]]
    return [*node[:3], [with_slots(k, slots, (*path, k[0]) if k[0] != "#" else path) for k in node[3]], None]


def with_host(pages: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))
    return pages.select(F.col("page_id").cast("long"), "url", F.coalesce("html", F.lit("")).alias("html"), host.alias("host"))


def task_wrappers(pages: DataFrame, most_slots: int = 100_000) -> DataFrame:
    """WRAPPERS of the pages of each host in each task; so many slots at most are held at once."""

    def told(hosts):
        rows = [(name, json.dumps(h.wrapper(), separators=(",", ":")), sum(h.shapes.values())) for name, h in hosts.items()]
        return pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=["host", "tree", "n"]), preserve_index=False)

    def run(batches):
        parser, hosts, held = Parser(), {}, 0
        for batch in batches:
            for name, page in zip(batch.column("host").to_pylist(), batch.column("html"), strict=True):
                blocks = parser.blocks(page.as_py())
                if not blocks:
                    continue
                host = hosts.setdefault(name, Host())
                before = len(host.slots) + len(host.keys)
                host.add(blocks)
                held += len(host.slots) + len(host.keys) - before
                if held > most_slots:
                    yield told(hosts)
                    hosts, held = {}, 0
        if hosts:
            yield told(hosts)

    return pages.select("host", "html").mapInArrow(run, WRAPPERS)


def wrappers(pages: DataFrame, fan: int = 64) -> DataFrame:
    """(host, tree, n): each host's wrapper, as JSON, and its pages. The tasks' wrappers of one host are aligned by at most about
    ``fan`` in one place; what a place gives goes into the next round."""

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = None
        for text in sorted(pdf["tree"]):
            one = json.loads(text)
            tree = align(tree, one) if tree else one
        return pd.DataFrame({"host": [pdf["host"].iloc[0]], "tree": [json.dumps(tree, separators=(",", ":"))], "n": [int(pdf["n"].sum())]})

    found = save(task_wrappers(pages))
    while True:
        counts = found.groupBy("host").agg(F.count("*").alias("rows"))
        most = counts.agg(F.max("rows")).first()[0] or 0
        if most <= 1:
            return found
        dealt = found.withColumn("row", F.monotonically_increasing_id()).join(small(counts), "host")
        part = F.pmod(F.xxhash64("row"), F.ceil(F.col("rows") / fan))
        found = save(dealt.withColumn("part", part).groupBy("host", "part").applyInPandas(lambda pdf: merge(pdf), WRAPPERS))


def choose(root: list) -> dict[str, list[int]]:
    """path -> template texts to leave out, of the wrapper's main slots."""
    nodes: list[tuple[str, list, int]] = []  # path, node, place of its parent
    todo = [("", root, -1)]
    while todo:
        path, node, parent = todo.pop()
        place = len(nodes)
        nodes.append((path, node, parent))
        todo += [(path + "/" * bool(path) + k[0] if k[0] != "#" else path, k, place) for k in node[3]]
    slots = [i for i, (_, node, _) in enumerate(nodes) if node[0] == "#" and node[4]]
    shared = {i: len(nodes[i][1][4][4]) >= PAGES and nodes[i][1][4][3] for i in slots}
    constant = {i: bool(shared[i]) and (not nodes[i][1][2] or nodes[i][1][4][0] <= nodes[i][1][1] * len(shared[i])) for i in slots}
    plain = lambda i: nodes[i][1][4][1] - nodes[i][1][4][2]
    if sum(plain(i) for i in slots if not constant[i]) * 10 < sum(plain(i) for i in slots):
        shared, constant = dict.fromkeys(slots, False), dict.fromkeys(slots, False)
    weight = [0.0] * len(nodes)
    for i in slots:
        path = nodes[i][0]
        w = 0.0 if constant[i] else plain(i) * (0.1 if noisy(path) else 2.0 if "*" in path else 1.0)
        at = i
        while at >= 0:
            weight[at] += w
            at = nodes[at][2]
    kids: dict[int, list[int]] = {}
    for i, (_, node, parent) in enumerate(nodes):
        if node[0] != "#":
            kids.setdefault(parent, []).append(i)
    tag = lambda i: re.split(r"[.!*]", nodes[i][1][0].lstrip("~"))[0]
    trusted, at, region, going = {0}, 0, 0, True
    while kids.get(at):
        best = max(kids[at], key=lambda i: (weight[i], nodes[i][0]))
        if weight[best] < LEADS * weight[at] or not weight[best]:
            break
        own = weight[at] - sum(weight[i] for i in kids[at] if tag(i) not in TEXTUAL)
        going = going and not nodes[at][1][0].endswith("*") and own <= OWN * weight[at] and tag(best) not in TEXTUAL and best in kids
        trusted.add(best)
        region = best if going else region
        at = best
    above, at = [], region
    while at >= 0:
        above.append(at)
        at = nodes[at][2]
    whole = [i for i in above if nodes[i][1][0].endswith("*")][:1]
    inside = {}
    for i in slots:
        chain, at = [], i
        while at >= 0 and at not in (whole or [region]):
            chain.append(at)
            at = nodes[at][2]
        inside[i] = (at >= 0, chain)
    starred = {i for i in slots if inside[i][0] and any(nodes[x][1][0].endswith("*") for x in inside[i][1])}
    if not whole and sum(weight[i] for i in starred) * 2 >= weight[region] > 0:
        inside = {i: (i in starred, chain) for i, (_, chain) in inside.items()}

    def main(i: int) -> bool:
        path, node, parent = nodes[i]
        mostly_links = 2 * node[4][2] > node[4][1]
        within, chain = inside[i]
        if within:
            starry = bool(whole) or i in starred
            own_header = lambda x: tag(x) == "header" and starry
            return not constant[i] and (starry or not mostly_links) and not any(nodes[x][1][0].endswith("!") and x not in trusted and not own_header(x) for x in chain)
        around = tag(parent) == "h1" or (nodes[parent][2] if tag(parent) in TEXTUAL else parent) in above
        return not starred and not whole and around and not constant[i] and not mostly_links and not noisy(path)

    return {nodes[i][0]: list(shared[i] or []) for i in slots if main(i)}


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars): each page's blocks in its host's main slots."""
    pages = with_host(pages)

    def chosen(batches):
        for batch in batches:
            trees = [json.loads(tree) for tree in batch.column("tree").to_pylist()]
            mains = [json.dumps([choose(t), sorted(wide(t))], separators=(",", ":")) for t in trees]
            yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(mains, pa.string())], names=["host", "main"])

    known = wrappers(pages).mapInArrow(chosen, "host string, main string")

    def run(batches):
        parser, mains = Parser(), {}
        for batch in batches:
            texts = []
            for page, main in zip(batch.column("html"), batch.column("main").to_pylist(), strict=True):
                if main not in mains:
                    if len(mains) > 10_000:
                        mains.clear()
                    paths, known = json.loads(main) if main else ({}, [])
                    mains[main] = {p: frozenset(x) for p, x in paths.items()}, set(known)
                blocks = parser.blocks(page.as_py())
                own = kept(blocks, *mains[main])
                if not own and blocks:
                    alone = Host()
                    alone.add(blocks)
                    tree = alone.wrapper()
                    own = kept(blocks, choose(tree), wide(tree))
                texts.append("\n".join(own))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.join(small(known), "host", "left").select("page_id", "url", "html", "main").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def kept(blocks: list, main: dict, known: set[str]) -> list[str]:
    """The texts of a page's blocks in main slots, but for template texts."""
    places = {p: widened(p, known) for p in {p for p, _, _ in blocks}}
    fine = lambda p, text: p in main and not (main[p] and xxhash.xxh64_intdigest(text) in main[p])
    return [text for path, text, _ in blocks if fine(places[path], text)]


@tidied
def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
