"""Chat formatting in budgeted windows.

A conversation's turns, in order of turn (ties by role and text), become windows of at most ``budget`` tokens. Prefix sums
of the turns' tokens choose the longest turn-aligned span of new turns that fits beside what is repeated: the system turn
that opens the conversation, and the latest turns of up to ``history`` tokens before the span. The loss mask covers the
texts of new assistant turns only, so repeated targets are masked out and each is learnt once.

Template, for each turn: ``<|im_start|>`` role newline text ``<|im_end|>`` newline. Control strings inside texts and roles
(these marks and those of other common templates) get a backslash after their first character; one that has backslashes
there already gets one more, so it can be undone exactly.

Null text and null role count as empty; null ids and turns sort first and are a conversation and a place like others;
repeated rows are turns like others; a turn longer than the budget has a window of its own. An empty table gives no rows;
other columns are ignored. A task holds one window's turns of one conversation at a time, however long that is.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm.common import table, tidied
from orrery.llm.packing import default_files, encoder

BUDGET, HISTORY, AROUND = 2048, 256, 8  # AROUND: tokens of the template for each turn
START, END = "<|im_start|>", "<|im_end|>"
#: First character, backslashes, rest: fixed control strings of common chat templates.
CONTROL = re.compile(r"(<|\[)(\\*)(\||/?s>|/?INST\]|</?SYS>>|/?unk>|/?pad>)")
ESCAPED = re.compile(r"(<|\[)\\(\\*)(\||/?s>|/?INST\]|</?SYS>>|/?unk>|/?pad>)")
TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)
WINDOWS = "conv_id long, window int, text string, mask array<struct<start:int,end:int>>, repeated int, tokens long"


def escape(text: str) -> str:
    return CONTROL.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1\2\3", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def render(turns: list[tuple[str, str]], repeated: int) -> tuple[str, list[tuple[int, int]]]:
    """The window's text, and the places of the texts of its new assistant turns."""
    out, mask, at = [], [], 0
    for i, (role, text) in enumerate(turns):
        head, body = f"{START}{escape_role(role)}\n", escape(text)
        if i >= repeated and role == "assistant":
            mask.append((at + len(head), at + len(head) + len(body)))
        out.append(head + body + END + "\n")
        at += len(out[-1])
    return "".join(out), mask


def read_back(text: str) -> list[tuple[str, str]]:
    return [(unescape_role(role), unescape(body)) for role, body in TURN.findall(text)]


def cut(turns: list[tuple[str, str, int]], done: int, system: tuple | None, budget: int, history: int, last: bool, later: bool):
    """Windows of the turns from ``done`` on, by prefix sums: (history begin, begin, end). Without ``last`` a span that
    could still grow is left for later. ``later``: the conversation has windows already."""
    total = np.concatenate([[0], np.cumsum([n for *_, n in turns])])
    i = done
    while i < len(turns):
        h = min(int(np.searchsorted(total, total[i] - history, "left")), i)
        repeat = system[2] if system is not None and (later or i > done) else 0
        fixed = int(total[i] - total[h]) + (repeat if h or turns[0] is not system else 0)
        if fixed > budget // 2 and h < i:
            h, fixed = i, repeat
        j = max(i + 1, int(np.searchsorted(total, total[i] + budget - fixed, "right")) - 1)
        if j >= len(turns) and not last:
            return
        yield h, i, min(j, len(turns))
        i, later = j, True


def windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """WINDOWS rows; a conversation's stand together, in order."""
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    sorted_ = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches):
        encode = encoder(*default_files())
        conv, turns, system, done, number, begun = None, [], None, 0, 0, False
        out: list[tuple] = []

        def emit(last):
            nonlocal done, number, turns
            for h, i, j in cut(turns, done, system, budget, history, last, number > 0):
                again = [system] if system is not None and number and turns[h] is not system else []
                shown = [*again, *turns[h:j]]
                repeated = len(again) + i - h
                text, mask = render([t[:2] for t in shown], repeated)
                out.append((conv, number, text, [{"start": a, "end": b} for a, b in mask], repeated, sum(t[2] for t in shown)))
                number, done = number + 1, j
            if not last:  # of what is done only the possible history is kept
                total = np.cumsum([n for *_, n in turns[:done]][::-1])
                keep = int(np.searchsorted(total, history, "right"))
                turns, done = turns[done - keep :], keep

        def batch_of(rows):
            names = [f.split()[0] for f in ("conv_id", "window", "text", "mask", "repeated", "tokens")]
            types = [pa.int64(), pa.int32(), pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.int32(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)

        for batch in batches:
            for c, role, text in zip(batch.column("conv_id").to_pylist(), batch.column("role"), batch.column("text"), strict=True):
                if not begun or c != conv:
                    if begun:
                        emit(True)
                    conv, turns, system, done, number, begun = c, [], None, 0, 0, True
                role, text = role.as_py(), text.as_py()
                turn = (role, text, len(encode(escape(text))) + AROUND)
                if not turns and number == 0 and done == 0 and role == "system":
                    system = turn
                turns.append(turn)
                if sum(t[2] for t in turns[done:]) > 4 * budget:
                    emit(False)
                if len(out) >= 256:
                    yield batch_of(out)
                    out.clear()
        if begun:
            emit(True)
        if out:
            yield batch_of(out)

    return sorted_.mapInArrow(run, WINDOWS)


def digests(formatted: DataFrame) -> DataFrame:
    """What each conversation's windows say when read back: every turn once, and all text under the loss mask. The windows
    of a conversation come together and in order, as ``windows`` gives them."""

    def run(batches):
        conv, begun = None, False
        state: list = []
        out: list[tuple] = []
        fresh = lambda: [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
        close = lambda: out.append((conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        batch_of = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)
        for batch in batches:
            for c, text, mask, repeated in zip(batch.column("conv_id").to_pylist(), batch.column("text"), batch.column("mask"), batch.column("repeated").to_pylist(), strict=True):
                if not begun or c != conv:
                    if begun:
                        close()
                    conv, state, begun = c, fresh(), True
                text = text.as_py()
                for role, body in read_back(text)[repeated:]:
                    state[0] += 1
                    state[1].update(f"{role}\n{body}\n".encode("utf-8", "surrogatepass"))
                for span in mask.as_py():
                    said = unescape(text[span["start"] : span["end"]])
                    state[2] += len(said)
                    state[3].update(said.encode("utf-8", "surrogatepass"))
                state[4] += len(text)
            if len(out) >= 1000:
                yield batch_of(out)
                out.clear()
        if begun:
            close()
        if out:
            yield batch_of(out)

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


@tidied
def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    return digests(windows(rows.union(own)))
