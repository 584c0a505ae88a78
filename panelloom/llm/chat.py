"""Chat formatting: conversations as windows of whole turns, each within a token budget.

A turn is written `<|im_start|>role`, a line break, its text, `<|im_end|>`, a line break.
Control strings inside texts can't act: between `<` and `|` a backslash is put in, and one more
where there are some already, so `unescape` gives the text back and `<|` stands for
the template alone. Roles are escaped in the same way, their line breaks too.

Windows are chosen from prefix sums of the turns' tokens. A window holds the leading
system turn, then a limited history (the last turns before it, at most `history` tokens),
then as many new turns as fit into `budget`. A new turn that leaves no room for the history
shortens it. A turn is never cut: one that is longer than the budget has a window of its
own, marked `over_budget`. Every turn is new in exactly one window; only the texts of
new turns of the target role are in the window's `targets`, so repeated ones are masked.

A conversation of any length is handled: windows begin anew at every `block` bytes of
it, so a task holds one block. Conversations within a block are dealt by their identifier;
only longer ones are put in order and summed up over the whole table. Their blocks get the
system turn, and as history the turns that begin in the last `near` bytes of the
block before.

Defined cases: null text is empty, a null role too; null identifiers form one conversation;
null turn numbers come first; turns with equal numbers are ordered by role and by the text's
digest, repeated rows are turns of their own; an empty table gives no window; other
columns do not matter. `turns` should be read from files: equal rows are told apart by
their place in them.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from panelloom.llm.batches import kept, slices, small_batches
from panelloom.sources.storage import stage

START, END = "<|im_start|>", "<|im_end|>\n"
BUDGET = 2048
HISTORY = 512
BLOCK = 4 << 20   # bytes of a conversation after which windows begin anew
NEAR = 64 << 10   # bytes before a block whose turns may be its history
ROW = 16          # bytes that a turn counts beside its text
TARGET = "assistant"
SYSTEM = "system"
WINDOW = ("conv_id long, block long, window int, text string, fresh_from int, n_turns int, "
          "targets array<struct<start:int,length:int>>, n_tokens long, over_budget boolean")
READ = "conv_id long, block long, alone boolean, n_turns long, turns binary, loss binary, loss_chars long, formatted_chars long"
DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

_PLAIN, _GUARDED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    return _PLAIN.sub(r"<\\\1|", text) if "|" in text else text


def unescape(text: str) -> str:
    return _GUARDED.sub(r"<\1|", text) if "|" in text else text


def _head(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _role(head: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(head))


class Counter:
    """Tokens of a text by the ranks and pattern of a public tokeniser."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encode = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def __call__(self, text: str) -> int:
        return len(self.encode(text)) + 3  # the two marks and the line break at the end


def spans(tokens: list[int], lead: int, given: int, budget: int, history: int) -> Iterator[tuple[int, int, int]]:
    """(first repeated turn, first new turn, end) of each window.

    Turn 0 is kept in every window if `lead` is 1. The first `given` turns (the lead among
    them) only serve as history.
    """
    sums = np.concatenate([[0], np.cumsum(tokens)])
    at = given
    while at < len(tokens):
        room = budget - (int(sums[lead]) if at else 0)  # the lead itself is new in the first window
        spare = max(0, min(history, room - int(tokens[at])))
        back = max(min(lead, at), int(np.searchsorted(sums, sums[at] - spare, "left")))
        end = max(at + 1, int(np.searchsorted(sums, sums[back] + room, "right")) - 1)
        yield back, at, end
        at = end


def _windows(conv, block: int, rows: list[tuple[str, str, bool, int]], count, budget: int, history: int) -> Iterator[tuple]:
    """Windows of one block; rows are (role, text, whether the turn is new here, its begin) in order."""
    pieces, marks = [], []
    for role, text, *_ in rows:
        before = START + _head(role) + "\n"
        safe = escape(text)
        pieces.append(before + safe + END)
        marks.append((len(before), len(safe)))
    tokens = [count(p[len(START):-len(END)]) for p in pieces]
    given = next((i for i, r in enumerate(rows) if r[2]), len(rows))
    lead = int(rows[0][0] == SYSTEM and rows[0][3] == 0)
    for number, (back, first, end) in enumerate(spans(tokens, lead, given, budget, history)):
        chosen = [0] if lead and first > 0 else []
        chosen += range(back, first)
        fresh_from = sum(len(pieces[i]) for i in chosen)
        targets, at = [], fresh_from
        for i in range(first, end):
            if rows[i][0] == TARGET:
                targets.append({"start": at + marks[i][0], "length": marks[i][1]})
            at += len(pieces[i])
        chosen += range(first, end)
        used = sum(tokens[i] for i in chosen)
        yield conv, block, number, "".join(pieces[i] for i in chosen), fresh_from, end - first, targets, used, used > budget


def read(text: str, fresh_from: int, targets: list[dict]) -> tuple[list[tuple[str, str]], list[str]]:
    """The new turns of a window, (role, text), and the texts under its loss mask, both unescaped."""
    turns, at = [], fresh_from
    while at < len(text):
        if not text.startswith(START, at):
            raise ValueError("a turn does not begin where the one before it ends")
        line = text.index("\n", at)
        end = text.index(END, line)
        turns.append((_role(text[at + len(START):line]), unescape(text[line + 1:end])))
        at = end + len(END)
    return turns, [unescape(text[t["start"]:t["start"] + t["length"]]) for t in targets]


def _ordered(turns: DataFrame) -> DataFrame:
    """The columns that order the turns of a conversation, and the sizes."""
    text = F.coalesce("text", F.lit(""))
    return turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), text.alias("text"), F.md5(text.cast("binary")).alias("tie"),
        (F.octet_length(text) + ROW).cast("long").alias("size"))


ORDER = ("turn", "role", "tie")


def _blocks(long: DataFrame, block: int, near: int) -> DataFrame:
    """Turns of the long conversations with their block, and those that further blocks are given."""
    rows = long.withColumn("place", F.monotonically_increasing_id())
    rows = rows.repartitionByRange("conv_id", *ORDER, "place").sortWithinPartitions("conv_id", *ORDER, "place")
    names = ["conv_id", *ORDER, "text", "size"]

    def running(batches):
        """Bytes of the conversation before each turn, within the partition."""
        conv, total, begun = None, 0, False
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for batch in batches:
            before = []
            for c, n in zip(batch["conv_id"].to_pylist(), batch["size"].to_pylist()):
                if not begun or c != conv:
                    conv, total, begun = c, 0, True
                before.append(total)
                total += n
            yield pa.RecordBatch.from_arrays([*(batch[n] for n in names), pa.array([part] * len(before), pa.int32()),
                                              pa.array(before, pa.int64())], [*names, "part", "before"])

    summed = stage(small_batches(rows).mapInArrow(
        running, "conv_id long, turn long, role string, tie string, text string, size long, part int, before long"), "chat-long")
    # One row for each partition and conversation in it; an offset is needed only where one goes on.
    totals = summed.groupBy("conv_id", "part").agg(F.sum("size").alias("total"))
    over = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stage(totals.select(F.col("conv_id").alias("of"), F.col("part").alias("into"), F.sum("total").over(over).alias("offset"))
                    .where("offset is not null"), "chat-offsets")
    placed = summed.join(offsets, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("part") == F.col("into")), "left").withColumn(
        "begin", F.col("before") + F.coalesce("offset", F.lit(0)))
    placed = placed.withColumn("block", F.floor(F.col("begin") / block).cast("long"))
    placed = stage(placed.select(*names, "begin", "block"), "chat-placed")
    to_next = (F.col("block") + 1) * block - F.col("begin") <= near
    own = placed.withColumn("fresh", F.lit(True))
    leading = (F.col("begin") == 0) & (F.col("role") == SYSTEM)
    passed = placed.where(to_next & ~leading).withColumn("block", F.col("block") + 1).withColumn("fresh", F.lit(False))
    lead = placed.where(leading).select(
        F.col("conv_id").alias("of"), *[F.col(n).alias(f"lead_{n}") for n in names[1:]])
    later = placed.where("block > 0").select("conv_id", "block").distinct()
    leads = later.join(lead, F.col("conv_id").eqNullSafe(F.col("of"))).select(
        "conv_id", *[F.col(f"lead_{n}").alias(n) for n in names[1:]], F.lit(0).cast("long").alias("begin"), "block", F.lit(False).alias("fresh"))
    return own.unionByName(passed).unionByName(leads).withColumn("alone", F.lit(False))


def _dealt(turns: DataFrame, block: int, near: int) -> DataFrame:
    """All turns in partitions and order: whole blocks, (conv_id, block), their turns by `begin`."""
    rows = _ordered(turns)
    sizes = rows.groupBy("conv_id").agg(F.sum("size").alias("whole")).where(F.col("whole") > block)
    long = stage(sizes.select(F.col("conv_id").alias("of")), "chat-sizes")
    within = F.col("conv_id").eqNullSafe(F.col("of"))
    whole = {"begin": F.lit(0).cast("long"), "block": F.lit(0).cast("long"), "fresh": F.lit(True), "alone": F.lit(True)}
    if long.limit(1).count():
        parts = rows.join(long, within, "left_anti").withColumns(whole).unionByName(
            _blocks(rows.join(long, within, "left_semi"), block, near))
    else:
        parts = rows.withColumns(whole)
    keys = ["conv_id", "block"]
    return parts.repartition(*keys).sortWithinPartitions(*keys, "fresh", "begin", *ORDER).select(
        *keys, "alone", "fresh", "begin", "role", "text")


def _grouped(batches) -> Iterator[tuple]:
    """(conv_id, block, alone, rows) of each block of a sorted stream of batches."""
    key, rows = None, []
    for batch in batches:
        for piece in slices([batch], "text"):
            columns = (piece[n].to_pylist() for n in ("conv_id", "block", "alone", "role", "text", "fresh", "begin"))
            for conv, block, alone, *row in zip(*columns):
                if (conv, block, alone) != key:
                    if rows:
                        yield *key, rows
                    key, rows = (conv, block, alone), []
                rows.append(row)
    if rows:
        yield *key, rows


def _packed(found: Iterator[tuple], schema: pa.Schema, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Record batches of rows, each of about `size` bytes of text."""
    held, used = [], 0
    for row in found:
        held.append(row)
        used += sum(len(x) for x in row if isinstance(x, (str, bytes))) + 64
        if used > size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, used = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


_TARGETS = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())]))
_WINDOW = pa.schema([("conv_id", pa.int64()), ("block", pa.int64()), ("window", pa.int32()), ("text", pa.string()), ("fresh_from", pa.int32()),
                     ("n_turns", pa.int32()), ("targets", _TARGETS), ("n_tokens", pa.int64()), ("over_budget", pa.bool_())])
_READ = pa.schema([("conv_id", pa.int64()), ("block", pa.int64()), ("alone", pa.bool_()), ("n_turns", pa.int64()), ("turns", pa.binary()),
                   ("loss", pa.binary()), ("loss_chars", pa.int64()), ("formatted_chars", pa.int64())])
_DIGEST = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
                     ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def _counter(path: str, pattern: str) -> Counter:
    return kept((Counter, path, pattern), lambda: Counter(path, pattern))


def windows(turns: DataFrame, path: str, pattern: str, budget: int = BUDGET, history: int = HISTORY,
            block: int = BLOCK, near: int = NEAR) -> DataFrame:
    """Formatted windows of all conversations (columns: `WINDOW`); (block, window) orders those of a conversation.

    `fresh_from` is where the new turns begin, `targets` are the spans under the loss mask;
    both count code points of `text`.
    """
    def run(batches):
        count = _counter(path, pattern)
        yield from _packed((w for conv, number, _, rows in _grouped(batches)
                            for w in _windows(conv, number, rows, count, budget, history)), _WINDOW)

    return small_batches(_dealt(turns, block, near)).mapInArrow(run, WINDOW)


def digests(turns: DataFrame, path: str, pattern: str, budget: int = BUDGET, history: int = HISTORY,
            block: int = BLOCK, near: int = NEAR) -> DataFrame:
    """One row for each conversation, read back from its formatted windows (columns: `DIGEST`).

    A conversation's digests are sequential, so the blocks of a long one are read in
    order by one task, one block at a time.
    """
    def run(batches):
        count = _counter(path, pattern)

        def results():
            for conv, number, alone, rows in _grouped(batches):
                said, aims, n, loss_chars, chars = [], [], 0, 0, 0
                for w in _windows(conv, number, rows, count, budget, history):
                    back, loss = read(w[3], w[4], w[6])
                    said += [f"{role}\n{text}\n" for role, text in back]
                    aims += loss
                    n += len(back)
                    loss_chars += sum(map(len, loss))
                    chars += len(w[3])
                turns, loss = "".join(said).encode(), "".join(aims).encode()
                if alone:
                    turns, loss = hashlib.sha256(turns).digest(), hashlib.sha256(loss).digest()
                yield conv, number, alone, n, turns, loss, loss_chars, chars

        yield from _packed(results(), _READ)

    def join(batches):
        def results():
            key, state = None, None
            for batch in batches:
                for row in batch.to_pylist():
                    if state is None or row["conv_id"] != key:
                        if state:
                            yield finish(key, state)
                        key, state = row["conv_id"], [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                    state[0] += row["n_turns"]
                    state[1].update(row["turns"])
                    state[2] += row["loss_chars"]
                    state[3].update(row["loss"])
                    state[4] += row["formatted_chars"]
            if state:
                yield finish(key, state)

        def finish(key, state):
            return key, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]

        yield from _packed(results(), _DIGEST)

    found = stage(small_batches(_dealt(turns, block, near)).mapInArrow(run, READ), "chat-read")
    whole = found.where("alone").select("conv_id", "n_turns", F.lower(F.hex("turns")).alias("turns_sha256"), "loss_chars",
                                        F.lower(F.hex("loss")).alias("loss_sha256"), "formatted_chars")
    cut = found.where("not alone").repartition("conv_id").sortWithinPartitions("conv_id", "block")
    return whole.unionByName(small_batches(cut).mapInArrow(join, DIGEST))
