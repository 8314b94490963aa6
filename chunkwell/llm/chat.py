"""Chat formatting in token-budgeted windows of whole turns, with a mask of what is to be learnt.

A turn is `<|im_start|>role\\ntext<|im_end|>\\n`. Inside texts and roles, one backslash goes into each `<|` after
its `<` and the backslashes already there, which is undone by taking one out; a role's backslashes and newlines
are escaped as well, so that a role ends at its first newline.

Prefix sums of turn tokens choose the windows: a window holds the conversation's system turn (its first turn, if
its role is system), then the latest earlier turns within the history budget, then as many new turns as fit the
budget. History makes way for a new turn, oldest first. A window is over the budget only if it has one new turn that is
over it with the system turn alone. The mask covers the texts of assistant turns that are new in the window; repeated
history and the repeated system turn are not masked in again.

Null texts, roles and conversation ids: an empty text, an empty role, one conversation of its own. Turns order by
turn (nulls first), then role, then text; repeated rows are turns of their own. Memory is bounded by a window and
one turn, whatever a conversation's length. Extra columns are not carried. Empty tables give no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import bounded_batches, text_or_empty

START, END = "<|im_start|>", "<|im_end|>\n"
WINDOWS = "conv_id long, window int, formatted string, spans array<struct<start:long,end:long>>, n_context int, n_turns int, n_tokens long"
TURN = re.compile(re.escape(START) + r"([^\n]*)\n(.*?)" + re.escape(END), re.DOTALL)


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


class _Windows:
    """Collects one conversation's turns and gives out windows as they fill."""

    def __init__(self, conv, vocab, budget, history):
        self.conv, self.vocab, self.budget, self.history = conv, vocab, budget, history
        self.system = None
        self.past: deque = deque()  # (formatted, tokens) of the latest turns, within the history budget
        self.past_tokens = 0
        self.new: list = []
        self.prefix = [0]  # token sums of self.new
        self.number = 0
        self.first = True

    def add(self, role: str, text: str):
        head = f"{START}{escape_role(role)}\n"
        body = escape(text)
        turn = (head + body + END, len(head), len(head) + len(body), role == "assistant")
        tokens = len(self.vocab.encode_bytes(turn[0])) // 4
        if self.first and role == "system":
            self.first, self.system = False, (turn, tokens)
            self.new, self.prefix = [turn], [0, tokens]
            return
        self.first = False
        if self.new and self.context_tokens() + self.prefix[-1] + tokens > self.budget and not (self.number == 0 and self.system and len(self.new) == 1):
            yield self.flush()
        while not self.new and self.past and self.context_tokens() + tokens > self.budget:
            self.past_tokens -= self.past.popleft()[1]
        self.new.append(turn)
        self.prefix.append(self.prefix[-1] + tokens)

    def context(self) -> list:
        return ([self.system[0]] if self.system and self.number else []) + [t for t, _ in self.past]

    def context_tokens(self) -> int:
        return (self.system[1] if self.system and self.number else 0) + self.past_tokens

    def flush(self) -> tuple:
        context, spans, parts, at = self.context(), [], [], 0
        for k, (formatted, start, end, target) in enumerate(context + self.new):
            if target and k >= len(context):
                spans.append({"start": at + start, "end": at + end})
            parts.append(formatted)
            at += len(formatted)
        out = (self.conv, self.number, "".join(parts), spans, len(context), len(context) + len(self.new), self.context_tokens() + self.prefix[-1])
        for k, turn in enumerate(self.new):
            if not (self.number == 0 and k == 0 and self.system):
                self.past.append((turn, self.prefix[k + 1] - self.prefix[k]))
                self.past_tokens += self.past[-1][1]
        while self.past_tokens > self.history:
            self.past_tokens -= self.past.popleft()[1]
        self.new, self.prefix = [], [0]
        self.number += 1
        return out


def windows(df: DataFrame, budget: int = 1024, history: int = 256, path: str | None = None) -> DataFrame:
    """conv_id, window, formatted, spans (of the mask, in code points), n_context (turns that repeat), n_turns, n_tokens."""
    if not 0 <= history < budget:
        raise ValueError("history must be within the budget")
    path = path or bpe.default_path()
    bounded_batches(df.sparkSession)
    schema = pa.schema([("conv_id", pa.int64()), ("window", pa.int32()), ("formatted", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("n_context", pa.int32()), ("n_turns", pa.int32()), ("n_tokens", pa.int64())])

    def run(batches):
        vocab, current, out = bpe.vocabulary(path), None, []

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        for batch in batches:
            for conv, role, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if current is None or current.conv != conv:
                    if current is not None:
                        out.append(current.flush())
                    current = _Windows(conv, vocab, budget, history)
                out.extend(current.add(role, text))
                if len(out) >= 64:
                    yield batch_of(out)
                    out = []
        if current is not None:
            out.append(current.flush())
        if out:
            yield batch_of(out)

    turns = df.select(F.col("conv_id").cast("long").alias("conv_id"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), text_or_empty().alias("text"), F.col("turn").cast("long").alias("turn"))
    return turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text").mapInArrow(run, WINDOWS)


def read_back(formatted: str, spans: list[dict]) -> tuple[list[tuple[str, str]], list[str]]:
    """The (role, text) of all turns of a window, and its masked texts."""
    return [(unescape_role(m[1]), unescape(m[2])) for m in TURN.finditer(formatted)], [unescape(formatted[s["start"] : s["end"]]) for s in spans]


def digests(formatted: DataFrame) -> DataFrame:
    """What windows() reads back to: one row a conversation, whatever the order of rows."""

    def run(batches):
        done, state = [], None

        def close():
            done.append((state["conv"], state["turns"], state["all"].hexdigest(), state["chars"], state["loss"].hexdigest(), state["formatted"]))

        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("conv_id", "window", "formatted", "spans", "n_context")]
            for conv, window, text, spans, n_context in zip(*columns):
                if window == 0:
                    if state is not None:
                        close()
                    state = {"conv": conv, "turns": 0, "all": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "formatted": 0}
                turns, masked = read_back(text, spans)
                for role, said in turns[n_context:]:
                    state["turns"] += 1
                    state["all"].update(f"{role}\n{said}\n".encode())
                for said in masked:
                    state["chars"] += len(said)
                    state["loss"].update(said.encode())
                state["formatted"] += len(text)
            if len(done) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), types)], names=names)
                done = []
        if state is not None:
            close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), types)], names=names)

    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    rows = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "window")
    return rows.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
