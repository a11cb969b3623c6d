"""N-gram Jaccard join with prefix trees.

A document's set holds its distinct five-word shingles (words `[^\\x20\\x09-\\x0D]+` of the A-Z lower-cased text; fewer
words give their whole sequence as one). Documents link where 100 * intersection >= 75 * union; the join is exact.

1. Equal sets are one class from the start. Words and shingles that are common in some task are counted over all
   documents. The global order has shingles of rare words first, then those of ever commoner words (by the sum of the
   logarithms of their counts), and the commonest shingles last; ties go by hash. At most ``most_common`` words and as
   many shingles are told to the tasks; any such order gives the same links, a good one gives small clusters.
2. Each set sends the beginning of its ordered shingles (what a linked set must share one of) to where equal shingles
   meet. Sets that meet, with sizes near enough, form clusters: every link lies within one. Nothing is emitted in pairs:
   a shingle's sets are tied to one before them. Common shingles meet in salted parts first. With a beginning made longer
   by m - 1 shingles, linked sets meet for m of them at least; sets that meet others less often are left out.
3. A cluster's sets are stored in a compressed trie, ordered by how many sets share a shingle, and each set walks it,
   sharing the overlap along common beginnings and leaving subtrees that cannot reach the threshold any more.
4. Clusters beyond one block are parted again, by how many of their own sets have each shingle. What is larger still is
   joined within blocks; then with its hubs, the sets with most links; and then every set outside the largest component with
   every block. So a large group of near copies costs a walk for each set, not all pairs.

Null text and texts without words have an empty set, link with nothing and are their own component. A null doc_id has a
null component and takes no part. Repeated rows share a class. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.llm.common import as_long, components, fmix, hash_strings, pieces, save, shingle_hashes, small, table, tidied, words_of

PERCENT, WORDS = 75, 5
BLOCK_SETS, BLOCK_SHINGLES, HUBS = 2048, 4_000_000, 32
LONGER = 20  # a set's beginning is longer by this part of it than one shared shingle needs
BANDS = (91, 82)  # sizes that are to each other as so many to 100, or nearer, are in the first, second or else third band
SALTED = 16 * 9  # sixteenths of the logarithm of a count: shingles counted 512 times and more meet in salted parts


def distinct_sets(texts: pa.Array, k: int):
    """Each text's sorted distinct shingle hashes and their own hash as a signed long."""
    h, at = shingle_hashes(texts, k)
    for a, b in zip(at[:-1], at[1:], strict=True):
        s = np.unique(h[a:b])
        yield s, identity(s)


def identity(s: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(s.tobytes()) - 2**63


def often(h: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    values, counts = np.unique(h, return_counts=True)
    return values[counts >= least], counts[counts >= least]


def sets_and_common(docs: DataFrame, k: int, shingles_from: int = 3, words_from: int = 32) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, set) of every document, and (kind, item, count) of the shingles (kind 1) and words (kind 2) that some
    part of a task holds so often."""

    names = ["doc_id", "n", "id", "kind"]

    def common_rows(kind, hashes, least):
        values, counts = often(np.concatenate(hashes), least)
        return pa.RecordBatch.from_arrays([pa.nulls(len(values), pa.int64()), pa.array(counts.astype(np.int64)), pa.array(as_long(values)), pa.array(np.full(len(values), kind, np.int32))], names=names)

    def run(batches):
        shingles, words = [], []
        for batch in batches:
            for part in pieces(batch, "text"):
                found = list(distinct_sets(part.column("text"), k))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(s) for s, _ in found], pa.int64()), pa.array([i for _, i in found], pa.int64()), pa.array(np.zeros(len(found), np.int32))], names=names)
                shingles += [s for s, _ in found]
                words.append(hash_strings(words_of(part.column("text"))[0]))
                if sum(map(len, words)) > 3_000_000:
                    yield common_rows(1, shingles, shingles_from)
                    yield common_rows(2, words, words_from)
                    shingles, words = [], []
        if words:
            yield common_rows(1, shingles, shingles_from)
            yield common_rows(2, words, words_from)

    both = save(docs.mapInArrow(run, "doc_id long, n long, id long, kind int"))
    return both.where("kind = 0").select("doc_id", "n", F.col("id").alias("set")), both.where("kind > 0").groupBy("kind", F.col("id").alias("item")).agg(F.sum("n").alias("count"))


def lookup(rows: list) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes, and sixteenths of the logarithm of their counts."""
    items = np.array([r["item"] for r in rows], np.int64).view(np.uint64)
    order = np.argsort(items)
    return items[order], np.round(16 * np.log2(np.array([r["count"] for r in rows], float)))[order].astype(np.int64) if len(rows) else np.zeros(0, np.int64)


def weight(h: np.ndarray, known: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Their numbers for the hashes that are known, 0 for the others."""
    values, numbers = known
    if not len(values):
        return np.zeros(len(h), np.int64)
    place = np.minimum(np.searchsorted(values, h), len(values) - 1)
    return np.where(values[place] == h, numbers[place], 0)


def meeting(docs: DataFrame, words: list, shingles: list, k: int, percent: int, salts: int = 64) -> tuple[DataFrame, DataFrame]:
    """Edges (a, b) of sets that share a shingle of their beginnings and may be near enough in size; and (set, n_met0,
    n_met1, n_met2): for how many shingles of its longer beginning each set met one in each band of sizes."""
    shared = docs.sparkSession.sparkContext.broadcast((lookup(words), lookup(shingles)))  # at most 2 x most_common entries

    def begin(batches):
        by_word, by_shingle = shared.value
        seen: set[int] = set()
        for batch in batches:
            for part in pieces(batch, "text"):
                out = []
                h, at, score = shingle_hashes(part.column("text"), k, lambda w: weight(w, by_word))
                for a, b in zip(at[:-1], at[1:], strict=True):
                    s, first = np.unique(h[a:b], return_index=True)
                    i = identity(s)
                    if not len(s) or i in seen:
                        continue
                    if len(seen) < 1_000_000:
                        seen.add(i)
                    common = weight(s, by_shingle)
                    p = len(s) - (percent * len(s) + 99) // 100 + 1
                    ordered = np.lexsort((s, score[a:b][first], common))[: p + more(len(s)) - 1]
                    early = len(s) - (2 * percent * len(s) + 99 + percent) // (100 + percent) + 1
                    place = np.arange(len(ordered))
                    out.append((s[ordered], np.where(common[ordered] >= SALTED, 1 + i % salts, 0), np.full(len(place), len(s)), np.full(len(place), i), (place < p) * 1 + (place < early)))
                if out:
                    tokens, salt, n, ids, role = (np.concatenate(x) for x in zip(*out, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(as_long(tokens)), pa.array(place_of(salt, n, role)), pa.array(ids)], names=["shingle", "place", "set"])

    rows = docs.mapInArrow(begin, "shingle long, place long, set long")
    met = rows.repartition("shingle", F.shiftright("place", 40)).sortWithinPartitions("shingle", "place", "set")
    found = save(met_counts(met.mapInArrow(lambda batches: tie(batches, percent), "a long, b long, kind byte")))
    leaders = found.where("kind = 1").select(F.col("a").alias("shingle"), F.col("b").alias("a"))
    least = leaders.groupBy("shingle").agg(F.min("a").alias("b"))
    edges = found.where("kind = 0").select("a", "b").union(leaders.join(least, "shingle").select("a", "b"))
    return edges, found.where("kind = 2").select(F.col("a").alias("set"), "n_met0", "n_met1", "n_met2")


def met_counts(tied: DataFrame) -> DataFrame:
    """Distinct ties, and each set's counts summed over all batches, a column a band: a batch's own counts fit into 21 bits,
    their sums may not."""
    n_met = [F.sum(F.when(F.col("kind") == 2, F.shiftright("b", 21 * k).bitwiseAND(F.lit(2**21 - 1)))).alias(f"n_met{k}") for k in range(3)]
    return tied.groupBy("kind", "a", F.when(F.col("kind") < 2, F.col("b")).alias("b")).agg(*n_met)


def place_of(salt, n, role) -> np.ndarray:
    """Salt, size and role as one long, in that order: rows that shuffle are a third smaller than with three columns."""
    return salt.astype(np.int64) << 40 | n.astype(np.int64) << 8 | role.astype(np.int64)


def tie(batches, percent: int):
    """Rows (shingle, place, set) in that order -> pairs of sets (kind 0), first sets of salted parts (kind 1), and
    for how many shingles each set meets one in each band, in 21 bits a band (kind 2). A set that several tasks sent counts
    once."""
    # a pair's first common shingle is among the early ones of the smaller set: so each set is tied to the last set
    # before it, by size, that has the shingle early; those are tied among themselves in the same way
    held = None
    for batch in batches:
        if not len(batch):
            continue
        rows = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("shingle", "place", "set")]
        token, place, ids = (np.concatenate([h, r]) for h, r in zip(held, rows, strict=True)) if held else rows
        own = len(ids) - len(rows[0])  # the rows before ``own`` were told already
        fresh = np.concatenate([[True], (token[1:] != token[:-1]) | (place[1:] != place[:-1]) | (ids[1:] != ids[:-1])])
        fresh[:own] = True
        if not fresh[own:].any():
            continue
        token, place, ids = token[fresh], place[fresh], ids[fresh]
        salt, n, role = place >> 40, place >> 8 & 0xFFFFFFFF, place & 0xFF
        at = np.arange(len(ids))
        ties = (role == 2) | ((salt > 0) & (role > 0))
        before = np.concatenate([[-1], np.maximum.accumulate(np.where(ties, at, -1))[:-1]])
        other = np.maximum(before, 0)
        same = (before >= 0) & (token[other] == token) & (salt[other] == salt)
        tied = same & (ids[other] != ids) & (role > 0) & ((salt > 0) | (n * percent <= n[other] * 100)) & (at >= own)
        pairs = np.unique(np.stack([ids[tied], ids[other[tied]]]), axis=1)
        led = (salt > 0) & (role > 0) & ~same & (at >= own)
        values, at_value = np.unique(ids[own:], return_inverse=True)
        told = meets(*(x[own:] for x in (token, salt, n, ids)), percent, own > 0)
        counts = sum(np.bincount(at_value, flags, len(values)).astype(np.int64) << (21 * k) for k, flags in enumerate(told))
        values, counts = values[counts > 0], counts[counts > 0]
        last = int(np.maximum.accumulate(np.where(ties, at, -1))[-1])
        keep = [i for i in (last, len(ids) - 1) if i >= 0 and token[i] == token[-1] and salt[i] == salt[-1]]
        keep = sorted(set(keep))
        held = [x[keep] for x in (token, place, ids)]
        kinds = np.repeat(np.array([0, 1, 2], np.int8), [pairs.shape[1], int(led.sum()), len(values)])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([pairs[0], token[led], values])), pa.array(np.concatenate([pairs[1], ids[led], counts])), pa.array(kinds)], names=["a", "b", "kind"])


def meets(token, salt, n, ids, percent: int, goes_on: bool, reach: int = 8) -> list[np.ndarray]:
    """For each row of runs of one shingle, by size: whether another set is there whose size is in the first, second and
    third band. Runs of more rows, salted ones, and those that go beyond the batch count for all."""
    told = [np.zeros(len(ids), bool) for _ in range(3)]
    for d in range(1, min(reach, len(ids) - 1) + 1):
        same = (token[d:] == token[:-d]) & (salt[d:] == salt[:-d]) & (ids[d:] != ids[:-d]) & (n[d:] * percent <= n[:-d] * 100)
        first, second = (n[d:] * edge <= n[:-d] * 100 for edge in BANDS)
        for flags, new in zip(told, (same & first, same & second & ~first, same & ~second), strict=True):
            flags[d:] |= new
            flags[:-d] |= new
    starts = np.concatenate([[True], (token[1:] != token[:-1]) | (salt[1:] != salt[:-1])])
    run = np.cumsum(starts) - 1
    every = (np.bincount(run) > reach)[run] | (salt > 0) | (run == run[-1]) | ((run == 0) & goes_on)
    return [flags | every for flags in told]


def meets_enough(percent: int):
    """Whether a set may link: with a partner in a band it shares, within the longer beginnings of both, at least
    more(n) - ceil(percent n / 100) + overlap shingles, n the larger size, and the overlap that a link needs grows with
    the smaller size; so each band has its own least number."""
    enough = F.lit(False)
    for k, ratio in enumerate((*BANDS, percent)):
        share = 1 / LONGER - percent / 100 + percent * (1 + ratio / 100) / (100 + percent)
        enough = enough | (F.col(f"n_met{k}") >= F.greatest(F.lit(1), F.floor(F.col("n") * share - 2)))
    return enough


def more(n: int) -> int:
    """How many shingles, of as many as a set's beginning is made longer by (less one), two linked sets share there."""
    return max(1, n // LONGER)


class Trie:
    """A compressed prefix tree of sets of local shingle numbers, each in ascending order. Flat lists, a row a node."""

    def __init__(self, sets: list[np.ndarray], sizes: list[int]):
        self.tokens, self.kids, self.ends, self.rest, self.least, self.most, self.last = [], [], [], [], [], [], []
        order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u4").tobytes())
        self.sizes = sizes
        self.root = self._grow(sets, sizes, order)

    def _node(self, tokens, kids, ends):
        self.tokens.append(tokens), self.kids.append(kids), self.ends.append(ends)
        self.rest.append(0), self.least.append(0), self.most.append(0), self.last.append(-1)
        return len(self.tokens) - 1

    def _grow(self, sets, sizes, order):
        root = self._node(np.zeros(0, np.int64), [], [])
        todo = [(root, 0, 0, len(order))]  # node, depth, span of order
        visited = []
        while todo:
            node, depth, lo, hi = todo.pop()
            visited.append((node, depth, lo, hi))
            while lo < hi and len(sets[order[lo]]) == depth:
                self.ends[node].append(order[lo])
                lo += 1
            while lo < hi:
                token, end = sets[order[lo]][depth], lo + 1
                step, far = 1, hi
                while end < far and sets[order[end]][depth] == token:
                    end += step
                a, b = sets[order[lo]], sets[order[end - 1]]
                m = min(len(a), len(b)) - depth
                apart = np.flatnonzero(a[depth : depth + m] != b[depth : depth + m])
                deep = depth + (int(apart[0]) if len(apart) else m)
                kid = self._node(a[depth:deep], [], [])
                self.kids[node].append(kid)
                todo.append((kid, deep, lo, end))
                lo = end
        for node, depth, lo, hi in visited:
            span = order[lo:hi]
            self.rest[node] = max((len(sets[i]) for i in span), default=0) - depth
            self.least[node] = min((sizes[i] for i in span), default=0)
            self.most[node] = max((sizes[i] for i in span), default=0)
            self.last[node] = max(span, default=-1)
        return root

    def walk(self, mine: np.ndarray, size: int, mask: np.ndarray, percent: int, above: int, skip):
        """Sets with an index over ``above`` that link with a set of so many shingles, of which ``mine`` are known here."""
        total = 100 + percent
        todo = [(self.root, 0)]
        while todo:
            node, overlap = todo.pop()
            for kid in self.kids[node]:
                if self.last[kid] <= above or self.most[kid] * 100 < percent * size or self.least[kid] * percent > 100 * size:
                    continue
                tokens = self.tokens[kid]
                got = overlap + int(np.count_nonzero(mask[tokens]))
                ahead = len(mine) - int(np.searchsorted(mine, tokens[-1], "right"))
                if (got + min(ahead, self.rest[kid])) * total < percent * (size + self.least[kid]):
                    continue
                for i in self.ends[kid]:
                    if i > above and not skip(i) and got * total >= percent * (size + self.sizes[i]):
                        yield i
                if self.kids[kid]:
                    todo.append((kid, got))



def local_numbers(sets: list[np.ndarray]) -> tuple[list[np.ndarray], int]:
    """Shingles as numbers, those that most sets share first; shingles of one set only are left out."""
    if not sets:
        return [], 0
    flat = np.concatenate(sets)
    values, at, counts = np.unique(flat, return_inverse=True, return_counts=True)
    number = np.empty(len(values), np.int64)
    number[np.argsort(-counts, kind="stable")] = np.arange(len(values))
    shared = int((counts > 1).sum())
    ends = np.cumsum([0, *map(len, sets)])
    numbered = number[at]
    out = []
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        x = np.sort(numbered[a:b])
        out.append(x[: np.searchsorted(x, shared)])
    return out, shared


class Joined:
    """Union-find over a block's sets, with the number of links each was found to have."""

    def __init__(self, labels):
        self.up = {x: x for x in labels}
        self.links: dict = {}

    def find(self, x):
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def union(self, a, b):
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def link(sets: list[np.ndarray], labels: list[int], percent: int, queries: int | None = None) -> Joined:
    """Joins components of sets that link. ``queries``: only the first so many walk, and only over the others and those
    after them; by default all do. Sets of one component are not compared again."""
    sizes = [len(s) for s in sets]
    numbered, width = local_numbers(sets)
    able = [i for i, x in enumerate(numbered) if len(x) * 100 >= percent * sizes[i] and len(x)]
    joined = Joined(labels)
    trie = Trie([numbered[i] for i in able], [sizes[i] for i in able])
    mask = np.zeros(width, bool)
    for place, i in enumerate(able):
        if queries is not None and i >= queries:
            break
        mask[numbered[i]] = True
        mine = labels[i]
        for other in trie.walk(numbered[i], sizes[i], mask, percent, place, lambda o, m=mine: joined.find(labels[able[o]]) == joined.find(m)):
            joined.union(mine, labels[able[other]])
            for x in (i, able[other]):
                joined.links[x] = joined.links.get(x, 0) + 1
        mask[numbered[i]] = False
    return joined


def arrays(t: pa.Table) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint64) for x in t.column("shingles").to_pylist()]


def link_clusters(sets: DataFrame, percent: int) -> DataFrame:
    """sets: (cluster, set, n, shingles) -> (set, component)."""
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK_SETS), F.ceil(F.sum("n") / BLOCK_SHINGLES))
    sizes = save(sets.groupBy("cluster").agg(blocks.alias("blocks")))
    if not sizes.where("blocks > 1").isEmpty():
        large = small(sizes.where("blocks > 1").select("cluster"))
        parted = sets.join(large, "cluster").drop("cluster").join(small(parts_of(sets.join(large, "cluster"), percent)), "set")
        sets = sets.join(large, "cluster", "left_anti").unionByName(parted)
        sizes = save(sets.groupBy("cluster").agg(blocks.alias("blocks")))
    placed = sets.join(small(sizes), "cluster").withColumn("block", F.pmod(F.xxhash64("set"), F.col("blocks")))

    def within(t: pa.Table) -> pa.Table:
        t = t.sort_by([("n", "ascending"), ("set", "ascending")])
        labels = t.column("set").to_pylist()
        joined = link(arrays(t), labels, percent)
        return pa.table({"cluster": t.column("cluster"), "set": t.column("set"), "component": pa.array([joined.find(x) for x in labels], pa.int64()), "links": pa.array([joined.links.get(i, 0) for i in range(len(labels))], pa.int64()), "blocks": t.column("blocks"), "block": t.column("block")})

    first = save(placed.groupBy("cluster", "block").applyInArrow(within, "cluster long, set long, component long, links long, blocks long, block long"))
    large = first.where("blocks > 1")
    if large.isEmpty():
        return first.select("set", "component").distinct()

    members = save(sets.select("set", "n", "shingles").join(small(large), "set"))

    def across(t: pa.Table) -> pa.Table:
        t = t.sort_by([("walks", "descending"), ("n", "ascending"), ("set", "ascending")])
        labels, walks = t.column("component").to_pylist(), sum(t.column("walks").to_pylist())
        joined = link(arrays(t), labels, percent, walks)
        pairs = sorted({(x, joined.find(x)) for x in labels if joined.find(x) != x})
        return pa.table({"a": pa.array([a for a, _ in pairs], pa.int64()), "b": pa.array([b for _, b in pairs], pa.int64())})

    columns = ("cluster", "set", "n", "component", "shingles")
    every = members.select(*columns, "blocks", "block", F.lit(0).alias("walks"))
    top = Window.partitionBy("cluster", "block").orderBy(F.desc("links"), "set")
    best = members.select("cluster", "block", "blocks", "set", "links").withColumn("r", F.row_number().over(top)).where(F.col("r") <= F.greatest(F.lit(1), F.floor(F.lit(HUBS) / F.col("blocks"))))
    hubs = small(best.withColumn("g", F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("links"), "set"))).where(F.col("g") <= HUBS).select("set"))
    spread = members.join(hubs, "set").select(*columns, "blocks", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("walks"))
    edges = save(every.union(spread).groupBy("cluster", "block").applyInArrow(across, "a long, b long"))
    roots = named_roots(edges)
    merged = save(members.join(small(roots), "component", "left").withColumn("component", F.coalesce("root", "component")).drop("root"))
    counts = merged.groupBy("cluster", "component").count()
    main = counts.groupBy("cluster").agg(F.max_by("component", F.struct("count", "component")).alias("main"), F.count("*").alias("parts")).where("parts > 1").drop("parts")
    main = small(main)
    minor = merged.join(main, "cluster").where("component <> main")
    if not minor.isEmpty():
        # every set outside the largest component walks over the blocks of that one, and pairs of parts of such sets meet once
        is_minor = F.col("component") != F.col("main")
        split = lambda mine: F.greatest(F.lit(1), F.ceil(F.count_if(mine) / BLOCK_SETS), F.ceil(F.sum(F.when(mine, F.col("n")).otherwise(0)) / BLOCK_SHINGLES)).cast("long")
        both = merged.join(main, "cluster")
        parts = small(both.groupBy("cluster").agg(split(is_minor).alias("minors"), split(~is_minor).alias("mains")))
        dealt = both.join(parts, "cluster").withColumn("at", F.pmod(F.xxhash64("set", F.lit(1)), F.when(is_minor, F.col("minors")).otherwise(F.col("mains"))))
        upto = lambda c: F.sequence(F.lit(0).cast("long"), F.col(c) - 1)
        of_minors = lambda f: dealt.where(is_minor).select(*columns, "at", f)
        pairs = of_minors(F.explode(upto("minors")).alias("to")).withColumns({"a": F.least("at", "to"), "b": F.greatest("at", "to"), "walks": (F.col("at") <= F.col("to")).cast("int")})
        asking = of_minors(F.explode(upto("mains")).alias("to")).withColumns({"a": F.col("at"), "b": -1 - F.col("to"), "walks": F.lit(1)})
        asked = dealt.where(~is_minor).select(*columns, "at", F.explode(upto("minors")).alias("to")).withColumns({"a": F.col("to"), "b": -1 - F.col("at"), "walks": F.lit(0)})
        met_again = pairs.union(asking).union(asked).drop("at", "to").withColumnsRenamed({"a": "part", "b": "block"})
        more = met_again.groupBy("cluster", "part", "block").applyInArrow(across, "a long, b long")
        roots = named_roots(edges.union(more))
    final = first.join(roots, "component", "left")
    return final.select("set", F.coalesce("root", "component").alias("component")).distinct()


def parts_of(sets: DataFrame, percent: int) -> DataFrame:
    """(set, cluster): smaller clusters of the sets of each cluster, without those that link with none. Within a cluster it is
    known how many sets have each shingle, and by that order, rarest first, linked sets again share one of their beginnings;
    shingles of one set only are no meeting place. So sets that share common passages only part here."""

    def spread(batches):
        for batch in batches:
            for c, i, x in zip(batch.column("cluster"), batch.column("set"), batch.column("shingles"), strict=True):
                h = fmix(np.frombuffer(x.as_py(), np.uint64) ^ np.uint64(c.as_py() % 2**64))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), i.as_py(), np.int64)), pa.array(as_long(h))], names=["set", "shingle"])

    rows = sets.select("cluster", "set", "shingles").mapInArrow(spread, "set long, shingle long")
    shared = rows.withColumn("k", F.count("*").over(Window.partitionBy("shingle")).cast("int")).where("k > 1")
    mine = Window.partitionBy("set")
    ranked = shared.withColumns({"place": F.row_number().over(mine.orderBy("k", "shingle")), "held": F.count("*").over(mine)})
    # of n shingles those of one set only come first in the order, then the shared ones that are held
    begin = ranked.join(sets.select("set", "n"), "set").where(F.col("place") <= F.col("held") - F.ceil(F.col("n") * percent / 100) + 1)
    met = begin.select("set", F.min("set").over(Window.partitionBy("shingle")).alias("b")).where("set <> b").distinct()
    return components(met.select(F.col("set").alias("a"), "b")).select(F.col("node").alias("set"), F.col("component").alias("cluster"))


def named_roots(edges: DataFrame) -> DataFrame:
    return components(edges).select(F.col("node").alias("component"), F.col("component").alias("root"))


def commonest(counted: DataFrame, kind: int, most: int, least: int) -> list:
    return counted.where((F.col("kind") == kind) & (F.col("count") >= least)).orderBy(F.desc("count"), "item").limit(most).collect()


def linked(docs: DataFrame, k: int = WORDS, percent: int = PERCENT, most_common: int = 500_000, common_from: int = 6) -> DataFrame:
    """(doc_id, n_shingles, component_id): component_id is the least doc_id reachable by links."""
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    sets, counted = sets_and_common(docs, k)
    words, shingles = commonest(counted, 2, most_common, 0), commonest(counted, 1, most_common, common_from)
    known = docs.where("doc_id is not null")
    edges, met = meeting(known, words, shingles, k, percent)
    clusters = save(components(edges))
    classes = sets.where("n > 0 and doc_id is not null").groupBy("set").agg(F.min("doc_id").alias("least"), F.max("n").alias("n"))
    able = save(clusters.select(F.col("node").alias("set"), F.col("component").alias("cluster")).join(classes, "set").join(met, "set").where(meets_enough(percent)).select("set", "cluster", F.col("least").alias("doc_id")))
    several = able.groupBy("cluster").agg(F.count("*").alias("k")).where("k > 1").select("cluster")
    wanted = small(able.join(several, "cluster").select("set", "cluster", "doc_id"))

    def shingle_rows(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                found = list(distinct_sets(part.column("text"), k))
                ids = pa.array([i for _, i in found], pa.int64())
                t = pa.table({"cluster": part.column("cluster"), "set": ids, "n": pa.array([len(s) for s, _ in found], pa.int64()), "shingles": pa.array([s.tobytes() for s, _ in found], pa.binary())})
                yield from t.filter(pa.array([a == b for a, b in zip(ids.to_pylist(), part.column("set").to_pylist(), strict=True)], pa.bool_())).to_batches()

    needed = known.join(wanted, "doc_id").select("cluster", "set", "text").mapInArrow(shingle_rows, "cluster long, set long, n long, shingles binary")
    grouped = link_clusters(save(needed), percent)
    labelled = classes.join(grouped, "set", "left").withColumn("key", F.coalesce("component", "set"))
    least = save(labelled.groupBy("key").agg(F.min("least").alias("component_id")))
    by_set = labelled.select("set", "key").join(least, "key").select(F.col("set").alias("_set"), "component_id")
    done = sets.join(by_set, (sets["set"] == F.col("_set")) & (sets["n"] > 0), "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return done.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """Of each component the document with the least doc_id, with all its columns; of rows with one id and text one row;
    rows without an id stay."""
    ids = save(linked(docs).select("doc_id", "component_id"))
    gone = ids.where("component_id <> doc_id").select("doc_id").distinct()
    left = docs.join(small(gone), "doc_id", "left_anti").select(docs.columns)
    again = ids.where("component_id = doc_id").groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").select("doc_id")
    again = save(again)
    if again.isEmpty():
        return left
    rank = "_rank"
    while rank in docs.columns:
        rank += "_"
    twice = left.join(small(again), "doc_id", "left_semi").withColumn(rank, F.row_number().over(Window.partitionBy("doc_id", F.xxhash64("text")).orderBy("doc_id"))).where(F.col(rank) == 1)
    return left.join(small(again), "doc_id", "left_anti").union(twice.select(docs.columns)).select(docs.columns)


@tidied
def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(table(spark, sf_dir, "documents"))
