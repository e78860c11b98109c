"""Chat formatting from a declarative template, with a finite-state machine over roles.

A turn is written as ``open role between text close``. Roles and texts are escaped so that no string
of the template can occur in them: a backslash is doubled, and one is set behind the first character
of every template string that a text holds, so ``[INST]`` becomes ``[\\INST]``. Reading back undoes
this exactly. The machine walks the roles of a conversation in the order of its turns and tells
whether their order is valid; invalid conversations are formatted whole all the same, and flagged.

Turns are dealt by conversation and sorted within partitions; formatting and reading back are streams
that hold one turn, so a conversation of any length is never in memory as a whole. One conversation is
one task's: what a turn may be, and the digest of all turns, follow from the turns before.

Defined results: a null text or role is empty. Turns with equal numbers go by role, then by text, and
repeated rows are repeated turns. Rows with a null conversation id form one conversation. An empty
table gives an empty table. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    open: str = "[INST]"
    between: str = "[/INST]"
    close: str = "</s>"
    #: Roles whose texts carry loss.
    loss_roles: tuple[str, ...] = ("assistant",)
    #: State -> role -> next state; a conversation may end in one of ``final``.
    moves: dict[str, dict[str, str]] = field(
        default_factory=lambda: {"start": {"system": "opened", "user": "asked"}, "opened": {"user": "asked"}, "asked": {"assistant": "answered"}, "answered": {"user": "asked"}}
    )
    final: tuple[str, ...] = ("asked", "answered")

    def __post_init__(self):
        strings = (self.open, self.between, self.close)
        heads = {s[0] for s in strings}
        if any(len(s) < 2 or "\\" in s or heads & set(s[1:]) for s in strings):
            raise ValueError("a template string has two characters or more, no backslash, and no first character of another behind its own")

    @property
    def control(self) -> re.Pattern:
        return re.compile("(?=" + "|".join(map(re.escape, (self.open, self.between, self.close))) + ")(.)", re.DOTALL)


def escape(text: str, control: re.Pattern) -> str:
    return control.sub(r"\1\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL) if "\\" in text else text


SEGMENTS = pa.list_(pa.struct([("text", pa.string()), ("loss", pa.bool_())]))


def _format(batches, template: Template) -> Iterator[pa.RecordBatch]:
    """From turns (conv_id, turn, role, text) in order: (conv_id, turn, segments, state)."""
    control, conv, state = template.control, object(), None
    for batch in batches:
        convs, turns, roles, texts = (batch.column(i).to_pylist() for i in range(4))
        segments, states = [], []
        for c, role, text in zip(convs, roles, texts, strict=True):
            if c != conv:
                conv, state = c, "start"
            role, text = role or "", text or ""
            state = template.moves.get(state, {}).get(role, "invalid")
            loss = role in template.loss_roles
            segments.append([{"text": template.open + escape(role, control) + template.between, "loss": False}, {"text": escape(text, control), "loss": loss}, {"text": template.close, "loss": False}])
            states.append(state)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(segments, SEGMENTS), pa.array(states, pa.string())], ["conv_id", "turn", "segments", "state"])


def format_conversations(turns: DataFrame, template: Template | None = None) -> DataFrame:
    """``(conv_id, turn, segments, state)``: each turn's segments with their loss flags, and the machine's state behind it.

    Rows are sorted by conversation and turn within partitions, all of a conversation in one.
    """
    template = template or Template()
    source = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    dealt = source.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.mapInArrow(lambda b: _format(b, template), "conv_id long, turn long, segments array<struct<text:string,loss:boolean>>, state string")


class Reader:
    """Reads a conversation's formatted text back, turn by turn."""

    def __init__(self, template: Template):
        self.template = template
        self.n, self.chars, self.loss_chars = 0, 0, 0
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, segments: list[dict]) -> None:
        t = self.template
        whole = "".join(s["text"] for s in segments)
        self.chars += len(whole)
        at = 0
        while at < len(whole):
            if not whole.startswith(t.open, at):
                raise ValueError("a turn must begin here")
            middle = whole.index(t.between, at)
            end = whole.index(t.close, middle + len(t.between))
            role, text = unescape(whole[at + len(t.open) : middle]), unescape(whole[middle + len(t.between) : end])
            self.turns.update(f"{role}\n{text}\n".encode())
            self.n += 1
            at = end + len(t.close)
        for s in segments:
            if s["loss"]:
                text = unescape(s["text"])
                self.loss.update(text.encode())
                self.loss_chars += len(text)


def _read(batches, template: Template) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
    conv, reader, state = None, None, None

    def row() -> tuple:
        return conv, reader.n, reader.turns.hexdigest(), reader.loss_chars, reader.loss.hexdigest(), reader.chars, state in template.final

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names)

    for batch in batches:
        rows = []
        for c, segments, now in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            if reader is None or c != conv:
                rows += [row()] if reader is not None else []
                conv, reader = c, Reader(template)
            reader.add(segments)
            state = now
        yield out(rows)
    yield out([row()] if reader is not None else [])


def read_back(formatted: DataFrame, template: Template | None = None) -> DataFrame:
    """Digests of each conversation, read from what ``format_conversations`` gave, in its partitions and order."""
    template = template or Template()
    return formatted.mapInArrow(lambda b: _read(b, template), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean")
