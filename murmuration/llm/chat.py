"""Chat formatting with typed content parts, and reading the formatted text back."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions

OPEN, BODY, CLOSE = "<s>[INST]", "[/INST]", "</s>"
#: What the template or a tokenizer could take for marks; none stays whole inside a text.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<part:")
_CONTROL = re.compile("|".join(map(re.escape, CONTROL)))
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_PLACE = re.compile(r"<part:(\w+):(\d+)>")
LOSS_ROLES = ("assistant",)


def escape(text: str) -> str:
    """Doubles backslashes, then puts one after the first character of each control string."""
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    """The inverse: a backslash goes and what follows it stays."""
    return _ESCAPED.sub(r"\1", text)


@dataclass
class TokenCosts:
    """What an attachment's placeholder expands to in a model that takes 28-pixel patches and 25 audio frames a second."""

    patch_pixels: int = 28
    audio_per_second: int = 25
    document_per_page: int = 512


@dataclass
class Flattener:
    """Visits typed parts in order: texts are escaped, others leave a numbered placeholder, a reference and a count.

    A part of a type that has no visitor leaves a placeholder of kind unknown, which expands to nothing.
    """

    costs: TokenCosts = field(default_factory=TokenCosts)
    attachments: list[tuple[int, str, str, int]] = field(default_factory=list)

    def visit(self, part: dict) -> str:
        handler = getattr(self, f"visit_{part.get('type')}", None)
        return handler(part) if handler else self._attach("unknown", part, 0)

    def visit_text(self, part: dict) -> str:
        return escape(part.get("text") or "")

    def visit_image(self, part: dict) -> str:
        side = self.costs.patch_pixels
        return self._attach("image", part, -(-(part.get("width") or 0) // side) * -(-(part.get("height") or 0) // side))

    def visit_audio(self, part: dict) -> str:
        return self._attach("audio", part, -int(-(part.get("seconds") or 0) * self.costs.audio_per_second // 1))

    def visit_document(self, part: dict) -> str:
        return self._attach("document", part, (part.get("pages") or 0) * self.costs.document_per_page)

    def _attach(self, kind: str, part: dict, tokens: int) -> str:
        number = len(self.attachments)
        self.attachments.append((number, kind, part.get("ref") or "", int(tokens)))
        return f"<part:{kind}:{number}>"


def format_turn(role: str | None, content: str | list[dict] | None, costs: TokenCosts | None = None):
    """(formatted turn, loss begin, loss end, attachments). content: a plain text, or typed parts."""
    parts = [{"type": "text", "text": content}] if content is None or isinstance(content, str) else content
    flat = Flattener(costs or TokenCosts())
    body = "".join(flat.visit(p) for p in parts)
    head = OPEN + escape(role or "") + BODY
    begin, end = (len(head), len(head) + len(body)) if role in LOSS_ROLES else (0, 0)
    return head + body + CLOSE, begin, end, flat.attachments


def read_turns(formatted: str) -> Iterator[tuple[str, str]]:
    """(role, content) of each turn, content still escaped."""
    at = 0
    while at < len(formatted):
        if not formatted.startswith(OPEN, at):
            raise ValueError(f"no turn begins at {at}")
        body = formatted.index(BODY, at + len(OPEN))
        close = formatted.index(CLOSE, body + len(BODY))
        yield unescape(formatted[at + len(OPEN) : body]), formatted[body + len(BODY) : close]
        at = close + len(CLOSE)


def read_parts(content: str) -> Iterator[tuple[str, str]]:
    """('text', unescaped) and (kind, number) parts of a turn's content, in order."""
    at = 0
    for m in _PLACE.finditer(content):
        if m.start() > at:
            yield "text", unescape(content[at : m.start()])
        yield m[1], m[2]
        at = m.end()
    if at < len(content):
        yield "text", unescape(content[at:])


_ATTACHMENT = "struct<number: int, kind: string, ref: string, tokens: long>"
FORMATTED = f"conv_id long, turn long, formatted string, loss_begin long, loss_end long, attachments array<{_ATTACHMENT}>"
_ATTACHMENTS = pa.list_(pa.struct([("number", pa.int32()), ("kind", pa.string()), ("ref", pa.string()), ("tokens", pa.int64())]))


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [format_turn(r, c) for r, c in zip(b.column("role").to_pylist(), b.column("content").to_pylist(), strict=True)]
        text, begin, end, found = zip(*rows, strict=True) if rows else ([], [], [], [])
        found = [[dict(zip(("number", "kind", "ref", "tokens"), a, strict=True)) for a in f] for f in found]
        columns = [pa.array(text, pa.string()), pa.array(begin, pa.int64()), pa.array(end, pa.int64()), pa.array(found, _ATTACHMENTS)]
        yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("turn"), *columns], names=["conv_id", "turn", "formatted", "loss_begin", "loss_end", "attachments"])


def format_conversations(turns: DataFrame, content: str = "text") -> DataFrame:
    """Each turn's formatted text, its loss span, attachment references and expanded token counts.

    content: the column that holds a string, or an array of structs with type and, by type, text, ref, width, height,
    seconds, pages. A conversation's text is its turns' laid end to end in order of turn (then role and text, where turns
    repeat; null turns come first). Nothing is shuffled, so a conversation of any length spreads over tasks. Null roles and
    contents count as empty; turns without a conv_id keep that, and read as one conversation; repeated turns all count; an
    empty table gives no rows; other columns are not read.
    """
    return turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col(content).alias("content")
    ).mapInArrow(_format, FORMATTED)


_DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of each conversation in a partition sorted by conversation and turn; holds one batch and two digests."""
    current, state = None, None

    def fresh():
        return {"turns": 0, "all": hashlib.sha256(), "loss": hashlib.sha256(), "loss_chars": 0, "chars": 0}

    def row():
        return current[0], state["turns"], state["all"].hexdigest(), state["loss_chars"], state["loss"].hexdigest(), state["chars"]

    def emit(rows):
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    for b in batches:
        done = []
        for conv, text, begin, end in zip(*(b.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_begin", "loss_end")), strict=True):
            if current != (conv,):
                if current:
                    done.append(row())
                current, state = (conv,), fresh()
            state["chars"] += len(text)
            for role, content in read_turns(text):
                state["turns"] += 1
                state["all"].update(f"{role}\n{''.join(t for k, t in read_parts(content) if k == 'text')}\n".encode())
            for kind, piece in read_parts(text[begin:end]):
                if kind == "text":
                    state["loss"].update(piece.encode())
                    state["loss_chars"] += len(piece)
        if done:
            yield emit(done)
    if current:
        yield emit([row()])


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation, digests of what the formatted text says, read from that text alone.

    A digest of a conversation takes its bytes in order, so its turns meet in one task, which streams them: memory does
    not grow with a conversation, nor with the number of its turns. Turns without a conv_id are one conversation, whose id
    is null. An empty table gives no rows; other columns are not read.
    """
    ordered = formatted.repartition(partitions(formatted.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "formatted")
    return ordered.select("conv_id", "formatted", "loss_begin", "loss_end").mapInArrow(_read_back, _DIGESTS)
