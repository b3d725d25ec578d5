"""Chat formatting with typed content parts.

A visitor flattens a message's parts in order: text is escaped, and each image, audio or document becomes a
placeholder; the attachment's reference, place and expanded token count are recorded. A turn is written as

    <|im_start|>ROLE newline BODY<|im_end|> newline

In bodies and roles every "<|", also one with backslashes between, takes one backslash more, so no control string can
come from a text and the escape can be taken back; in roles, backslashes and newlines are escaped as well. The loss
mask of an assistant's turn is its body.

Turns stay rows: a conversation is a sorted run of them that is streamed through, with a few counters held, however
long it is. Rows are ordered by turn (null last), then role, then text, or else the parts as JSON, by code point; rows of
a null conv_id are one conversation; null roles and texts are empty. Extra columns are dropped.

What is read back comes from the formatted text alone: turns and roles from its control strings, the loss from what lies
under the mask's places.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import small_batches

START, END = "<|im_start|>", "<|im_end|>"
PLACEHOLDERS = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
#: Pixels on a side of an image's tile, tokens per second of audio and per page of a document.
TILE, AUDIO_RATE, PAGE_TOKENS = 28, 25, 1000
PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
TURNS = (
    "conv_id long, turn long, place long, start long, formatted string, loss_start long, loss_end long,"
    " attachments array<struct<type:string,ref:string,start:bigint,tokens:bigint>>, attachment_tokens long"
)
_ATTACHMENTS = pa.list_(pa.struct([("type", pa.string()), ("ref", pa.string()), ("start", pa.int64()), ("tokens", pa.int64())]))
_TURN_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), _ATTACHMENTS, pa.int64()]
_TURN_NAMES = ["conv_id", "turn", "place", "start", "formatted", "loss_start", "loss_end", "attachments", "attachment_tokens"]
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, attachment_tokens long"
_MARK, _MARKED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
_PLACEHOLDER = re.compile("|".join(map(re.escape, PLACEHOLDERS.values())))
_TURN = re.compile(re.escape(START) + r"([^\n]*)\n(.*)" + re.escape(END) + "\n", re.S)


def escape(text: str) -> str:
    return _MARK.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _MARKED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role), flags=re.S)


class Flattener:
    """Visits parts in order; `body` and `attachments` (type, ref, start in the body, tokens) grow."""

    def __init__(self):
        self.body: list[str] = []
        self.length = 0
        self.attachments: list[dict] = []

    def visit(self, part: dict) -> None:
        getattr(self, f"visit_{part['type']}", self.visit_unknown)(part)

    def _write(self, text: str) -> None:
        self.body.append(text)
        self.length += len(text)

    def _attach(self, part: dict, tokens: int) -> None:
        self.attachments.append({"type": part["type"], "ref": part.get("ref"), "start": self.length, "tokens": tokens})
        self._write(PLACEHOLDERS[part["type"]])

    def visit_text(self, part: dict) -> None:
        self._write(escape(part.get("text") or ""))

    def visit_image(self, part: dict) -> None:
        """A token for each tile, the edges' parts of tiles included; at least one."""
        self._attach(part, max(1, math.ceil((part.get("width") or 0) / TILE) * math.ceil((part.get("height") or 0) / TILE)))

    def visit_audio(self, part: dict) -> None:
        self._attach(part, max(1, math.ceil((part.get("seconds") or 0) * AUDIO_RATE)))

    def visit_document(self, part: dict) -> None:
        self._attach(part, max(1, part.get("pages") or 0) * PAGE_TOKENS)

    def visit_unknown(self, part: dict) -> None:
        """Parts of no known type are kept as the text they have."""
        self.visit_text(part)


def format_turn(role: str, parts: list[dict]) -> tuple[str, int, int, list[dict]]:
    """(formatted, start of the body, its end, attachments with starts in the formatted turn)."""
    flat = Flattener()
    for part in parts:
        flat.visit(part)
    head = f"{START}{escape_role(role)}\n"
    body = "".join(flat.body)
    for a in flat.attachments:
        a["start"] += len(head)
    return f"{head}{body}{END}\n", len(head), len(head) + len(body), flat.attachments


def parse_turn(formatted: str) -> tuple[str, str]:
    """(role, text) of a formatted turn; placeholders leave no text."""
    m = _TURN.fullmatch(formatted)
    return unescape_role(m[1]), plain(m[2])


def plain(body: str) -> str:
    """The text of a body or of a part of it."""
    return "".join(map(unescape, _PLACEHOLDER.split(body)))


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    begun, conv, place, at = False, None, 0, 0
    for batch in batches:
        out: list[tuple] = []
        for conv_id, turn, role, parts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if not begun or conv_id != conv:
                begun, conv, place, at = True, conv_id, 0, 0
            text, lo, hi, attached = format_turn(role or "", [p for p in parts or [] if p])
            loss = (at + lo, at + hi) if role == "assistant" else (None, None)
            for a in attached:
                a["start"] += at
            out.append((conv_id, turn, place, at, text, *loss, attached, sum(a["tokens"] for a in attached)))
            place, at = place + 1, at + len(text)
        columns = zip(*out, strict=True) if out else [[]] * len(_TURN_NAMES)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TURN_TYPES, strict=True)], names=_TURN_NAMES)


def format_chat(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text or parts) -> a row per turn, each conversation's together and in order.

    The `formatted` values of a conversation, one after the other, are its text; start, loss_start, loss_end and the
    attachments' starts are code points of that text.
    """
    parts = F.col("parts").cast(f"array<{PART}>") if "parts" in messages.columns else F.array(
        F.struct(F.lit("text").alias("type"), F.col("text"), *(F.lit(None).alias(n) for n in ("ref", "width", "height", "seconds", "pages")))
    ).cast(f"array<{PART}>")
    rows = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), parts.alias("parts"))
    small_batches(messages.sparkSession)
    said = F.to_json("parts") if "parts" in messages.columns else F.col("parts")[0]["text"]
    order = [F.col("conv_id"), F.col("turn").asc_nulls_last(), F.coalesce("role", F.lit("")), F.coalesce(said, F.lit(""))]
    return rows.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(_format, TURNS)


class _Digest:
    def __init__(self, conv_id):
        self.conv_id, self.turns, self.loss_chars, self.chars, self.tokens = conv_id, 0, 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, formatted: str, mask: tuple[int, int] | None, tokens: int) -> None:
        """`mask`: places in `formatted`."""
        role, text = parse_turn(formatted)
        self.turns += 1
        self.chars += len(formatted)
        self.tokens += tokens
        self.all.update(f"{role}\n{text}\n".encode())
        if mask is not None:
            learned = plain(formatted[slice(*mask)])
            self.loss_chars += len(learned)
            self.loss.update(learned.encode())

    def row(self) -> dict:
        return {
            "conv_id": self.conv_id, "n_turns": self.turns, "turns_sha256": self.all.hexdigest(), "loss_chars": self.loss_chars,
            "loss_sha256": self.loss.hexdigest(), "formatted_chars": self.chars, "attachment_tokens": self.tokens,
        }


_DIGEST_SCHEMA = pa.schema(
    [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("attachment_tokens", pa.int64())]
)


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now: _Digest | None = None
    for batch in batches:
        done = []
        names = ("conv_id", "formatted", "start", "loss_start", "loss_end", "attachment_tokens")
        for conv_id, formatted, at, begin, end, tokens in zip(*(batch.column(n).to_pylist() for n in names), strict=True):
            if now is None or conv_id != now.conv_id:
                if now is not None:
                    done.append(now.row())
                now = _Digest(conv_id)
            now.add(formatted, None if begin is None else (max(0, begin - at), max(0, end - at)), tokens)
        yield pa.RecordBatch.from_pylist(done, _DIGEST_SCHEMA)
    if now is not None:
        yield pa.RecordBatch.from_pylist([now.row()], _DIGEST_SCHEMA)


def read_back(turns: DataFrame) -> DataFrame:
    """`format_chat`'s rows, as it returns them -> a row per conversation of what its formatted text says."""
    return turns.mapInArrow(_read_back, DIGESTS)
