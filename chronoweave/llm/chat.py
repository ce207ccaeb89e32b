"""Chat formatting: a finite-state machine over roles emits text segments with loss flags.

A :class:`Template` declares how a turn of a role opens and closes, which roles
are trained on, which role may follow which, and the control strings. Inside
texts and role names control strings are escaped: each becomes ``<|x`` + its
number + ``|>``. As ``<|`` is itself a control string, an escaped text holds
``<|`` only where an escape begins, so unescaping gives the text back and no
text can forge a turn.

Rows are dealt by conversation, sorted by turn, and streamed: a conversation is
never held as a whole, so its length is not bounded by memory.

Defined results: a null text or role is empty; turns are ordered by turn (null
first), then role, then text; repeated rows are repeated turns; a null conv_id
is one conversation; a turn order that the machine does not accept is emitted
all the same, with ``valid`` false from the offending turn on.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches


@dataclass(frozen=True)
class Template:
    """How turns are written, escaped, ordered and trained on."""

    open_start: str = "<|im_start|>"
    open_end: str = "\n"
    close: str = "<|im_end|>\n"
    loss_roles: frozenset[str] = frozenset({"assistant"})
    #: state -> role -> next state; the empty state is the start of a conversation
    moves: dict[str, dict[str, str]] = field(
        default_factory=lambda: {
            "": {"system": "system", "user": "user"},
            "system": {"user": "user"},
            "user": {"assistant": "assistant"},
            "assistant": {"user": "user"},
        }
    )
    #: What tokenizers take for control; ``<|`` must be the first.
    controls: tuple[str, ...] = ("<|", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<unk>", "<pad>")

    def escape(self, text: str, role: bool = False) -> str:
        """``text`` with every control string replaced; in a role also line ends."""
        strings = [*self.controls, *(["\n"] if role else [])]
        number = {c: i for i, c in enumerate(strings)}
        pattern = "|".join(re.escape(c) for c in sorted(strings, key=len, reverse=True))
        return re.sub(pattern, lambda m: f"<|x{number[m[0]]}|>", text)

    def unescape(self, text: str) -> str:
        strings = [*self.controls, "\n"]
        return re.sub(r"<\|x(\d+)\|>", lambda m: strings[int(m[1])], text)


class Machine:
    """Whether the roles so far are a legal order of turns."""

    def __init__(self, template: Template):
        self.moves = template.moves
        self.state: str | None = ""

    def step(self, role: str) -> bool:
        self.state = None if self.state is None else self.moves.get(self.state, {}).get(role)
        return self.state is not None


SEGMENTS = "conv_id bigint, turn_no bigint, segment bigint, text string, loss boolean, valid boolean"


def segments(conversations: DataFrame, template: Template = Template(), conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The formatted conversations, one row a segment, a conversation's in order.

    Columns: conv_id, turn_no and segment (from 0 in each conversation), text
    (a turn's opening, content or closing), loss (content of a trained role),
    valid (the turn order is legal so far). A partition holds whole
    conversations in order, so :func:`read_back` needs no further shuffle.
    """
    small_batches(conversations.sparkSession, 2048)
    empty = F.lit("")
    rows = conversations.select(
        F.col(conv_id).cast("long").alias("c"), F.col(turn).alias("n"),
        F.coalesce(F.col(role).cast("string"), empty).alias("r"), F.coalesce(F.col(text).cast("string"), empty).alias("t"),
    ).repartition("c").sortWithinPartitions("c", "n", "r", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, machine, number, segment, valid = object(), None, 0, 0, True
        for b in batches:
            out: list[tuple] = []
            for c, r, t in zip(b.column("c").to_pylist(), b.column("r").to_pylist(), b.column("t").to_pylist(), strict=True):
                if c != here:
                    here, machine, number, segment = c, Machine(template), 0, 0
                valid = machine.step(r)
                parts = (template.open_start + template.escape(r, True) + template.open_end, template.escape(t), template.close)
                for i, part in enumerate(parts):
                    out.append((c, number, segment + i, part, i == 1 and r in template.loss_roles, valid))
                number, segment = number + 1, segment + 3
            cols = list(zip(*out, strict=True)) or [[]] * 6
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cols, kinds, strict=True)], names=["conv_id", "turn_no", "segment", "text", "loss", "valid"])

    return rows.mapInArrow(run, SEGMENTS)


class Reader:
    """Reads one conversation's output back: what it says and what is trained on."""

    def __init__(self, template: Template):
        self.t = template
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()
        self.turns = self.loss_chars = self.chars = 0
        self.valid = True
        self.rest = ""

    def add(self, text: str, loss: bool, valid: bool) -> None:
        self.chars += len(text)
        self.valid &= valid
        if loss:
            said = self.t.unescape(text)
            self.loss_chars += len(said)
            self.loss.update(said.encode())
        self.rest += text
        # a turn is complete when its closing is: nothing inside can hold one
        while (end := self.rest.find(self.t.close)) >= 0:
            body, self.rest = self.rest[:end], self.rest[end + len(self.t.close) :]
            if not body.startswith(self.t.open_start):
                raise ValueError("a turn does not begin with its opening")
            role, _, said = body[len(self.t.open_start) :].partition(self.t.open_end)
            self.turns += 1
            for part in (role, said):
                self.all.update(self.t.unescape(part).encode() + b"\n")

    def row(self, conv_id: int | None) -> tuple:
        if self.rest:
            raise ValueError("a turn does not end with its closing")
        return conv_id, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.valid


DIGESTS = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, valid boolean"


def read_back(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """One row a conversation, parsed from the output of :func:`segments` alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, reader = None, None

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) or [[]] * 7
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_())
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid"]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cols, kinds, strict=True)], names=names)

        for b in batches:
            done = []
            for c, t, loss, valid in zip(*(b.column(k).to_pylist() for k in ("conv_id", "text", "loss", "valid")), strict=True):
                if reader is None or c != here:
                    if reader is not None:
                        done.append(reader.row(here))
                    here, reader = c, Reader(template)
                reader.add(t, loss, valid)
            yield batch(done)
        if reader is not None:
            yield batch([reader.row(here)])

    return formatted.mapInArrow(run, DIGESTS)
