"""Chat formatting in budgeted windows.

Every turn is written ``[role]text</s>``.  A backslash is put before every backslash and before every ``[``, ``]`` and
``<`` of roles and texts, so that no control string can appear in them and reading back is exact.

Turns are formatted and counted (tokens of the byte-level vocabulary) before the shuffle.  Then the turns of a conversation
meet in order, and prefix sums of their tokens choose windows: a window holds the leading system turn, as many of the
preceding turns as fit in ``HISTORY`` tokens, and then new turns while the sum stays within ``BUDGET``.  A turn is never
cut: one that is too long on its own gets a window of its own, which may go beyond the budget.  Assistant texts are under
the loss mask in the window where they are new; the repeated ones are masked out.

A null text or role is the empty string.  Turns are ordered by turn, then role, then text, with null turns last; repeated rows are turns
of their own.  Rows without a conversation id form one conversation of their own.  An empty table gives no window.  A
conversation is streamed: at most one window of it is in memory.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .arrow import raw, tidy
from .byte_bpe import RANK_FILE, codec

BUDGET = 1024
HISTORY = 256
END = "</s>"
SPECIAL = re.compile(r"[\\\[\]<]")
UNESCAPE = re.compile(r"\\(.)", re.S)
TURN = re.compile(r"\[((?:[^\\\]]|\\.)*)\]((?:[^\\<]|\\.)*)</s>", re.S)
WINDOW = "conv_id long, window int, text string, repeated int, turns int, tokens long, loss array<struct<start:int,stop:int>>"


def escape(text: str) -> str:
    return SPECIAL.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return UNESCAPE.sub(r"\1", text)


def parse(text: str) -> list[tuple[str, str, int, int]]:
    """Role, text, and where the escaped text stands, of every turn of a formatted window."""
    out, at = [], 0
    while at < len(text):
        m = TURN.match(text, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(m[1]), unescape(m[2]), m.start(2), m.end(2)))
        at = m.end()
    return out


def formatted(conversations: DataFrame, path: str | None = None) -> DataFrame:
    """One row per turn: its written form, where the text stands in it, and its tokens."""
    path = path or public_tokenizers.path(RANK_FILE)
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                                F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))

    def run(batches):
        own = codec(path)
        for batch in batches:
            heads = [f"[{escape(r)}]" for r in batch.column("role").to_pylist()]
            bodies = [escape(t) for t in batch.column("text").to_pylist()]
            whole = pa.array([h + b + END for h, b in zip(heads, bodies)], pa.string())
            tokens = [len(ids) for ids in own.encode(*raw(whole))]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("conv_id", "turn", "role", "text")), whole, pa.array([len(h) for h in heads], pa.int32()),
                 pa.array(tokens, pa.int64())], names=["conv_id", "turn", "role", "text", "written", "head", "tokens"])
    return rows.mapInArrow(tidy(run), "conv_id long, turn long, role string, text string, written string, head int, tokens long")


class Windows:
    """The windows of one conversation, fed turn by turn."""

    def __init__(self, conv, budget: int, history: int):
        self.conv, self.budget, self.history = conv, budget, history
        self.system: tuple | None = None
        self.old: list[tuple] = []  # repeated turns of the open window
        self.new: list[tuple] = []
        self.number, self.used = 0, 0

    def add(self, turn: tuple) -> tuple | None:
        """``turn``: role, written, head, tokens.  A window that this turn closes, or None."""
        if self.number == 0 and not self.new and turn[0] == "system":
            self.system = turn
        closed = None
        if self.new and self.used + turn[3] > self.budget:
            closed = self.close()
            fixed = self.system[3] if self.system else 0
            room = min(self.history, self.budget - fixed - turn[3])
            past = [t for t in self.last if t is not self.system]
            sums = np.cumsum([t[3] for t in reversed(past)])
            count = int(np.searchsorted(sums, room, "right")) if room > 0 else 0
            self.old = ([self.system] if self.system else []) + past[len(past) - count:]
            self.used = sum(t[3] for t in self.old)
        self.new.append(turn)
        self.used += turn[3]
        return closed

    def close(self) -> tuple:
        parts, loss, at = [], [], 0
        for k, (role, written, head, _) in enumerate([*self.old, *self.new]):
            if role == "assistant" and k >= len(self.old):
                loss.append({"start": at + head, "stop": at + len(written) - len(END)})
            parts.append(written)
            at += len(written)
        out = (self.conv, self.number, "".join(parts), len(self.old), len(parts), self.used, loss)
        self.last = [*self.old, *self.new]
        self.number += 1
        self.old, self.new, self.used = [], [], 0
        return out


def _rows(batches) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _batches(rows: Iterator[tuple], schema: pa.Schema, most: int = 1000) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) >= most:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY, path: str | None = None) -> DataFrame:
    """One row per window: its text, how many of its turns are repeated, and the spans under the loss mask."""
    spans = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
    schema = pa.schema([("conv_id", pa.int64()), ("window", pa.int32()), ("text", pa.string()), ("repeated", pa.int32()),
                        ("turns", pa.int32()), ("tokens", pa.int64()), ("loss", spans)])

    def run(batches):
        def made():
            own = None
            for conv, role, written, head, tokens in _rows(batches):
                if own is None or own.conv != conv:
                    if own is not None:
                        yield own.close()
                    own = Windows(conv, budget, history)
                closed = own.add((role, written, head, tokens))
                if closed:
                    yield closed
            if own is not None:
                yield own.close()
        yield from _batches(made(), schema)
    ordered = (formatted(conversations, path).repartition("conv_id")
               .sortWithinPartitions("conv_id", F.col("turn").asc_nulls_last(), "role", "text"))
    return ordered.select("conv_id", "role", "written", "head", "tokens").mapInArrow(tidy(run), WINDOW)


def digests(made: DataFrame) -> DataFrame:
    """Read the windows of each conversation back, in order, and digest turns and loss text.

    ``made`` must hold the windows of a conversation together and in order, as ``windows`` gives them.
    """
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
                        ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def run(batches):
        def read():
            state = None
            for conv, text, repeated, loss in _rows(batches):
                if state is None or state[0] != conv:
                    if state is not None:
                        yield (state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5])
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said, _, _ in parse(text)[repeated:]:
                    state[1] += 1
                    state[2].update(f"{role}\n{said}\n".encode())
                for span in loss:
                    target = unescape(text[span["start"]:span["stop"]])
                    state[3] += len(target)
                    state[4].update(target.encode())
                state[5] += len(text)
            if state is not None:
                yield (state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5])
        yield from _batches(read(), schema)
    return made.select("conv_id", "text", "repeated", "loss").mapInArrow(
        tidy(run), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
