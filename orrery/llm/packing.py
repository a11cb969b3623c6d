"""Best-fit packing by a configuration linear program over the length histogram.

Texts become token pieces of at most ``capacity`` tokens. The lengths' histogram (at most ``capacity`` rows, whatever the
input) is all that reaches the driver. There a covering program over configurations (multisets of lengths that fit one
sequence) is solved by multiplicative weights: prices of lengths start at their share of a sequence and fall as a length
is covered, and a knapsack dynamic program finds the configurations of highest price. The fractional solution is rounded
down and what is left is packed best-fit. Each piece then finds its place by its rank among the pieces of its length.

Null text counts as empty: one piece that holds the end id alone. Repeated rows are packed each on their own. An empty
table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import base64
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.llm.common import save, table, tidied, trim

CAPACITY, END_ID = 1024, 2
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Texts of these characters only: for them both libraries split words alike.
PLAIN = re.compile(r"[\t\n\r\x20-\x7e¡-¬®-ſ]*")


def encoder(tokenizer: str, ranks: str | None):
    """Text -> token ids (numpy uint32). The ranks file holds the tokenizer's own vocabulary in the form of a quicker
    library; plain texts go through that one and all others, and any with a special token's string, through tokenizers."""
    import tiktoken
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(tokenizer)
    special = [t.content for t in slow.get_added_tokens_decoder().values()]
    own = lambda text: np.array(slow.encode(text, add_special_tokens=False).ids, np.uint32)
    if not ranks:
        return own
    import public_tokenizers

    with open(ranks, "rb") as lines:
        known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    quick = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=known, special_tokens={})
    return lambda text: np.array(quick.encode_ordinary(text), np.uint32) if PLAIN.fullmatch(text) and not any(s in text for s in special) else own(text)


def default_files() -> tuple[str, str]:
    import public_tokenizers as P

    return P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken")


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, files: tuple[str, str | None] | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): only texts of more than ``capacity`` ids are cut; the first piece is the
    shorter one. ``files``: tokenizer and ranks, by default those installed where each task runs."""

    def cut(batches):
        encode = encoder(*(files or default_files()))
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = np.append(encode(text.as_py() or ""), np.uint32(end_id)).astype("<u4")
                first = (len(ids) - 1) % capacity + 1
                bounds = [0, *range(first, len(ids) + 1, capacity)]
                rows += [(doc, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False))]
            yield pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"]).astype({"piece": "int32", "doc_id": "Int64"}), preserve_index=False)
        del encode
        trim()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, PIECES)


def price_configurations(lengths: np.ndarray, prices: np.ndarray, capacity: int, most: int, slack: float) -> list[dict[int, int]]:
    """Knapsack by dynamic programming: the best multiset of lengths, and for each length the best one that holds it,
    as far as its worth is within ``slack`` of the best."""
    best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(1, capacity + 1):
        m = np.searchsorted(lengths, c, "right")
        best[c], pick[c] = best[c - 1], -1
        if m:
            worth = best[c - lengths[:m]] + prices[:m]
            k = int(worth.argmax())
            if worth[k] > best[c]:
                best[c], pick[c] = worth[k], k
    found, forced = [], prices + best[capacity - lengths]
    for k in np.argsort(-forced, kind="stable")[:most]:
        if forced[k] < (1 - slack) * best[capacity]:
            break
        config, c = {int(k): 1}, capacity - int(lengths[k])
        while c > 0:
            if pick[c] < 0:
                c -= 1
            else:
                config[int(pick[c])] = config.get(int(pick[c]), 0) + 1
                c -= int(lengths[pick[c]])
        found.append(config)
    return found


def solve(histogram: dict[int, int], capacity: int = CAPACITY, step: float = 0.5, rounds: int = 400, slack: float = 0.02) -> list[tuple[int, list[tuple[int, int]]]]:
    """[(times, [(length, how many), ...])]: configurations that hold exactly the histogram's items.

    Multiplicative weights: every configuration found is taken until it covers ``step`` of the open demand of one of its
    lengths; a length's price is its share of the capacity times exp(-covered share). What is covered beyond the demand,
    or by a fraction, is rounded away; best-fit on the remaining histogram closes the rest."""
    lengths = np.array(sorted(k for k, n in histogram.items() if n > 0), np.int64)
    if not len(lengths):
        return []
    demand = np.array([histogram[int(k)] for k in lengths], float)
    open_, chosen = demand.copy(), {}
    for _ in range(rounds):
        live = np.flatnonzero(open_ >= 1)
        if not len(live):
            break
        prices = lengths[live] / capacity * np.exp(open_[live] / demand[live] - 1)
        taken = 0
        for config in price_configurations(lengths[live], prices, capacity, 64, slack):
            at, many = live[list(config)], np.array(list(config.values()))
            x = (open_[at] / many).min()
            x = x if x <= 4 else max(1.0, x * step)
            if x < 1:
                continue
            taken += 1
            key = tuple(sorted((int(lengths[i]), int(n)) for i, n in zip(at, many, strict=True)))
            chosen[key] = chosen.get(key, 0) + x
            open_[at] -= x * many
        if not taken:
            break
    plan = [(int(x), list(key)) for key, x in sorted(chosen.items()) if x >= 1]
    left = {int(k): histogram[int(k)] for k in lengths}
    for times, config in plan:
        for length, many in config:
            left[length] -= times * many
    return plan + best_fit(left, capacity)


def best_fit(left: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Best-fit decreasing over a histogram, alike sequences at once."""
    room: dict[int, dict[tuple, int]] = {}
    for length in sorted((k for k, n in left.items() if n > 0), reverse=True):
        n = left[length]
        while n:
            fits = [r for r in room if r >= length and room[r]]
            r = min(fits) if fits else capacity
            if fits:
                config, times = next(iter(room[r].items()))
                fill = min(r // length, n)
                take = min(times, n // fill)
                room[r][config] -= take
                if not room[r][config]:
                    del room[r][config]
                    if not room[r]:
                        del room[r]
            else:
                config, fill = (), min(capacity // length, n)
                take = n // fill
            new = (*config, (length, fill))
            at = room.setdefault(r - fill * length, {})
            at[new] = at.get(new, 0) + take
            n -= take * fill
    return [(times, list(config)) for held in room.values() for config, times in held.items() if times]


def slots(plan: list[tuple[int, list[tuple[int, int]]]]) -> dict[int, np.ndarray]:
    """For each length the rows (first rank, first sequence, how many each, offset in the sequence), in rank order."""
    out: dict[int, list] = {}
    ranks: dict[int, int] = {}
    base = 0
    for times, config in plan:
        at = 0
        for length, many in config:
            out.setdefault(length, []).append((ranks.get(length, 0), base, many, at))
            ranks[length] = ranks.get(length, 0) + times * many
            at += length * many
        base += times
    return {k: np.array(v, np.int64) for k, v in out.items()}


def pack(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, files: tuple[str, str | None] | None = None, salts: int = 256) -> DataFrame:
    """PIECES plus sequence_id, offset. A length that a third of all pieces share is ranked in ``salts`` parts whose
    counts are added up first, so no task gets all of it."""
    found = save(token_pieces(docs, capacity, end_id, files))
    full = found.where(F.col("length") == capacity).withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    rest = found.where(F.col("length") < capacity).withColumn("salt", F.pmod(F.xxhash64("doc_id", "ids_crc32"), F.lit(salts)).cast("int"))
    counts = rest.groupBy("length", "salt").count().toPandas()  # at most capacity x salts rows
    plan = solve(counts.groupby("length")["count"].sum().to_dict(), capacity) if len(counts) else []
    counts = counts.sort_values(["length", "salt"])
    counts["before"] = counts.groupby("length")["count"].cumsum() - counts["count"]
    before = {(int(a), int(b)): int(c) for a, b, c in counts[["length", "salt", "before"]].itertuples(index=False)}
    where = slots(plan)

    def place(batches):
        for batch in batches:
            pdf = batch.to_pandas()
            sequence, offset = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64)
            length, salt = pdf["length"].to_numpy(), pdf["salt"].to_numpy()
            rank = pdf["rank"].to_numpy() - 1 + np.fromiter((before[k] for k in zip(length.tolist(), salt.tolist(), strict=True)), np.int64, len(pdf))
            for n in np.unique(length):
                mine, rows = np.flatnonzero(length == n), where[int(n)]
                row = rows[np.searchsorted(rows[:, 0], rank[mine], "right") - 1]
                within = rank[mine] - row[:, 0]
                sequence[mine] = row[:, 1] + within // row[:, 2]
                offset[mine] = row[:, 3] + within % row[:, 2] * n
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = rest.withColumn("rank", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")).cast("long"))
    return ranked.mapInArrow(place, PIECES + ", sequence_id long, offset long").unionByName(full)


@tidied
def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
