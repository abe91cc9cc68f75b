r"""Conversations as training text, with typed content parts.

A visitor flattens the parts of every message, in order. Text is escaped; an image, audio or
document part becomes a placeholder ``<|image:0|>`` with its number in the message, and its
reference is recorded with the number of tokens that will stand there. A turn is

    <|turn|>role<|text|>content<|end|>

Escaping is reversible: a backslash is doubled, and one is put behind the first character of
every control string inside a text (``<|``, ``</s>``, ``<s>``, ``[INST]``, ``[/INST]``), so that
none is left. Turns are formatted where their rows are. Only to read conversations back, rows
move to their conversation, sorted by turn, and are folded one after the other: a conversation
is never in memory as a whole.

Defined results: a null role, text, part list or part kind is empty; a part of unknown kind is a
document. Turns are in the order of turn (null first), then role, then content, so equal turns
and repeated rows have one defined order and all count. Rows without conversation form one
conversation. Columns other than the named ones are not read.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, StringType

from dripline.llm.support import ship

# Fixed values of the template.
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
TO_LEARN = "assistant"
KINDS = ("image", "audio", "document")

# Tokens of one unit: an image tile, a second of audio, a page.
UNIT_TOKENS = {"image": 256, "audio": 25, "document": 600}

PART_TYPE = "array<struct<type: string, text: string, ref: string, units: double>>"

_CONTROL = re.compile(r"\\|<(?=\||/?s>)|\[(?=/?INST\])")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_MARK = re.compile(r"<\|(image|audio|document):([0-9]+)\|>")
_TURNS = re.compile(r"<\|turn\|>(.*?)<\|text\|>(.*?)<\|end\|>", re.DOTALL)


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\\\" if m[0] == "\\" else m[0] + "\\", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


@dataclass
class Flattener:
    """Visits the parts of one message; collects its content, attachments and added tokens.

    Neighbouring texts are escaped together, as a control string may begin in one of them and end
    in the next.
    """

    unit_tokens: dict[str, int]
    pending: list[str] = field(default_factory=list)
    content: list[str] = field(default_factory=list)
    attachments: list[dict] = field(default_factory=list)
    added_tokens: int = 0

    def visit(self, part: dict) -> None:
        kind = part.get("type") or "text"
        getattr(self, f"visit_{kind}", self.visit_document)(part)

    def visit_text(self, part: dict) -> None:
        self.pending.append(part.get("text") or "")

    def visit_image(self, part: dict) -> None:
        self._attach("image", part)

    def visit_audio(self, part: dict) -> None:
        self._attach("audio", part)

    def visit_document(self, part: dict) -> None:
        self._attach("document", part)

    def _attach(self, kind: str, part: dict) -> None:
        units = part.get("units")
        units = 1.0 if units is None or not math.isfinite(units) else max(0.0, units)
        tokens = -int(-units * self.unit_tokens[kind] // 1)
        number = len(self.attachments)
        self._end_text()
        self.attachments.append(
            {"number": number, "kind": kind, "ref": part.get("ref") or "", "tokens": tokens}
        )
        self.content.append(f"<|{kind}:{number}|>")
        self.added_tokens += tokens

    def _end_text(self) -> None:
        self.content.append(escape("".join(self.pending)))
        self.pending.clear()

    def finished(self) -> str:
        self._end_text()
        return "".join(self.content)


def format_turn(
    role: str | None, content: str | list[dict] | None, unit_tokens: dict[str, int]
) -> tuple[str, list[dict], int]:
    """One formatted turn, its attachments, and the tokens their placeholders stand for."""
    parts = [{"type": "text", "text": content}] if isinstance(content, str) else content or []
    flat = Flattener(unit_tokens)
    for part in parts:
        flat.visit(part or {})
    text = TURN + escape(role or "") + TEXT + flat.finished() + END
    return text, flat.attachments, flat.added_tokens


def read_turns(formatted: str) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn of a formatted text; placeholders are left out of the text."""
    for role, content in _TURNS.findall(formatted):
        # Inside escaped text no "<|" is left, so every mark is a placeholder.
        yield unescape(role), unescape(_MARK.sub("", content))


def loss_spans(formatted: str) -> list[tuple[int, int]]:
    """(start, end) of the contents to learn from, in code points of the formatted text."""
    return [m.span(2) for m in _TURNS.finditer(formatted) if unescape(m[1]) == TO_LEARN]


_ATTACHMENT = pa.struct(
    [("number", pa.int32()), ("kind", pa.string()), ("ref", pa.string()), ("tokens", pa.int64())]
)
_TURN_SCHEMA = (
    "formatted string, learned boolean, "
    "attachments array<struct<number: int, kind: string, ref: string, tokens: bigint>>, "
    "added_tokens long"
)


def format_turns(
    messages: DataFrame,
    conversation: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    content: str = "text",
    unit_tokens: dict[str, int] | None = None,
) -> DataFrame:
    """One row per message: conv_id, turn, formatted, learned, attachments, added_tokens.

    ``content`` is a string column or an array of parts (:data:`PART_TYPE`).
    """
    ship(messages.sparkSession)
    costs = UNIT_TOKENS | (unit_tokens or {})
    chosen = messages.select(
        F.col(conversation).alias("conv_id"),
        F.col(turn).alias("turn"),
        F.col(role).cast("string").alias("role"),
        F.col(content).alias("content"),
    )
    kind = chosen.schema["content"].dataType
    if not isinstance(kind, (StringType, ArrayType)):
        raise TypeError(f"content is a string or an array of parts, not {kind.simpleString()}")
    types = [f"{x} {chosen.schema[x].dataType.simpleString()}" for x in ("conv_id", "turn")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roles = batch.column("role").to_pylist()
            done = [
                format_turn(a, b, costs)
                for a, b in zip(roles, batch.column("content").to_pylist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("conv_id"),
                    batch.column("turn"),
                    pa.array([x[0] for x in done], pa.string()),
                    pa.array([x == TO_LEARN for x in roles], pa.bool_()),
                    pa.array([x[1] for x in done], pa.list_(_ATTACHMENT)),
                    pa.array([x[2] for x in done], pa.int64()),
                ],
                names=["conv_id", "turn", "formatted", "learned", "attachments", "added_tokens"],
            )

    return chosen.mapInArrow(run, f"{', '.join(types)}, {_TURN_SCHEMA}")


@dataclass
class Digest:
    """What is read back from the turns of one conversation, turn after turn."""

    conversation: object
    n_turns: int = 0
    loss_chars: int = 0
    formatted_chars: int = 0
    turns: object = field(default_factory=hashlib.sha256)
    loss: object = field(default_factory=hashlib.sha256)

    def add(self, formatted: str) -> None:
        self.formatted_chars += len(formatted)
        for role, text in read_turns(formatted):
            self.n_turns += 1
            self.turns.update(f"{role}\n{text}\n".encode())
            if role == TO_LEARN:
                self.loss_chars += len(text)
                self.loss.update(text.encode())

    def row(self) -> tuple:
        return (
            self.conversation,
            self.n_turns,
            self.turns.hexdigest(),
            self.loss_chars,
            self.loss.hexdigest(),
            self.formatted_chars,
        )


_DIGEST_TYPES = {
    "n_turns": pa.int64(),
    "turns_sha256": pa.string(),
    "loss_chars": pa.int64(),
    "loss_sha256": pa.string(),
    "formatted_chars": pa.int64(),
}


def read_back(formatted: DataFrame) -> DataFrame:
    """One row per conversation, from the rows of :func:`format_turns`.

    conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.
    """
    id_field = formatted.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: Digest | None = None
        for batch in batches:
            done = []
            id_type = batch.schema.field("conv_id").type
            for conversation, text in zip(
                batch.column("conv_id").to_pylist(),
                batch.column("formatted").to_pylist(),
                strict=True,
            ):
                if current is None or current.conversation != conversation:
                    if current is not None:
                        done.append(current.row())
                    current = Digest(conversation)
                current.add(text)
            yield _rows(done, id_type)
        if current is not None:
            yield _rows([current.row()], id_type)

    return (
        formatted.select("conv_id", "turn", "formatted")
        .repartition("conv_id")
        # The formatted text starts with the role, so it orders by role, then content.
        .sortWithinPartitions("conv_id", "turn", "formatted")
        .select("conv_id", "formatted")
        .mapInArrow(
            run,
            f"conv_id {id_field}, n_turns long, turns_sha256 string, loss_chars long, "
            "loss_sha256 string, formatted_chars long",
        )
    )


def _rows(rows: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
    types = {"conv_id": id_type} | _DIGEST_TYPES
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(types)
    return pa.RecordBatch.from_arrays(
        [pa.array(list(x), t) for x, t in zip(columns, types.values(), strict=True)],
        names=list(types),
    )
