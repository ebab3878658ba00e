"""Chat formatting of turns whose content is a list of typed parts.

A visitor flattens the parts of a turn - text, image, audio, document - into one string: texts are escaped, every other part
leaves a placeholder, numbered in order, and is recorded as an attachment with its reference and the number of tokens
that the placeholder will expand to. A turn is written as ``<turn ROLE>content</turn>`` and a line feed. In roles and texts a backslash
and the first character of anything that reads like a mark of the template get a backslash in front, so that what is
written can be read back exactly. Turns are formatted where they lie, then range-sorted by conversation and turn, so that one long
conversation is spread over partitions; its offsets are running totals over them.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import materialise
from millrace.operators.numbering import numbered

#: What the template writes, and what is escaped in texts: a backslash, and whatever could start a mark.
ESCAPED = re.compile(r"\\|<(?=/?turn|image|audio|document)")
ROLE_ESCAPED = re.compile(r"[\\<>]")
MARK = re.compile(r"\\(?P<plain>.)|<turn (?P<role>(?:[^\\>]|\\.)*)>|(?P<end></turn>\n)|<(?P<kind>image|audio|document) (?P<number>[0-9]+)>", re.DOTALL)
#: Links of Markdown with one of these endings are attachments of a text.
KINDS = {"png": "image", "jpg": "image", "jpeg": "image", "gif": "image", "webp": "image", "wav": "audio", "mp3": "audio", "flac": "audio", "ogg": "audio", "pdf": "document", "docx": "document"}
LINK = re.compile(rf"!\[[^\]\n]*\]\((?P<uri>[^()\s]+\.(?P<ending>{'|'.join(KINDS)}))\)", re.IGNORECASE)
PART = "struct<kind:string,text:string,uri:string,width:int,height:int,seconds:double,pages:int>"
ATTACHMENT = "struct<kind:string,uri:string,source:string,tokens:bigint>"
TURN = f"conv_id bigint, turn bigint, role string, loss boolean, formatted string, chars bigint, content_at bigint, content_chars bigint, attachments array<{ATTACHMENT}>, tokens bigint, tie bigint"


@dataclass(frozen=True)
class Expansion:
    """How many tokens a placeholder becomes: image patches, audio frames, pages; unknown sizes count as the given ones."""

    patch: int = 28
    frames_a_second: float = 25.0
    tokens_a_page: int = 512
    side: int = 448
    seconds: float = 1.0


@dataclass
class Flattener:
    """Visits the parts of one turn and collects its content and attachments."""

    expansion: Expansion
    content: list[str] = field(default_factory=list)
    text: list[str] = field(default_factory=list)
    attachments: list[dict[str, Any]] = field(default_factory=list)

    def visit(self, part: dict[str, Any]) -> None:
        visitor = getattr(self, f"visit_{part.get('kind')}", None)
        if visitor is None:
            raise ValueError(f"a part of kind {part.get('kind')!r}")
        visitor(part)

    def visit_text(self, part: dict[str, Any]) -> None:
        self.text.append(part.get("text") or "")  # neighbours are escaped as one: a mark may begin in one and end in the next

    def visit_image(self, part: dict[str, Any]) -> None:
        sides = [part.get(s) or self.expansion.side for s in ("width", "height")]
        self.attach(part, math.prod(-(-s // self.expansion.patch) for s in sides))

    def visit_audio(self, part: dict[str, Any]) -> None:
        seconds = part.get("seconds")
        self.attach(part, math.ceil((self.expansion.seconds if seconds is None else seconds) * self.expansion.frames_a_second))

    def visit_document(self, part: dict[str, Any]) -> None:
        self.attach(part, (part.get("pages") or 1) * self.expansion.tokens_a_page)

    def attach(self, part: dict[str, Any], tokens: int) -> None:
        self.close_text()
        self.attachments.append({"kind": part["kind"], "uri": part.get("uri"), "source": part.get("text"), "tokens": tokens})
        self.content.append(f"<{part['kind']} {len(self.attachments)}>")

    def close_text(self) -> None:
        self.content.append(ESCAPED.sub(r"\\\g<0>", "".join(self.text)))
        self.text = []

    def flatten(self, parts: list[dict[str, Any]]) -> str:
        for part in parts:
            self.visit(part)
        self.close_text()
        return "".join(self.content)


def parts_of(text: str) -> list[dict[str, Any]]:
    """A plain text as parts: links of Markdown to images, sounds and documents become attachments that keep how they were written."""
    parts, at = [], 0
    for link in LINK.finditer(text):
        parts += [{"kind": "text", "text": text[at:link.start()]}, {"kind": KINDS[link["ending"].lower()], "uri": link["uri"], "text": link[0]}]
        at = link.end()
    return [*parts, {"kind": "text", "text": text[at:]}]


def format_turns(turns: DataFrame, under_loss: tuple[str, ...] = ("assistant",), expansion: Expansion = Expansion()) -> DataFrame:
    """Each row of turns(conv_id, turn, role, text) or (conv_id, turn, role, parts: array<PART>) as formatted text.

    Returns conv_id, nth (of the turn in its conversation, from 0), start (characters, as code points, of the conversation before it), formatted,
    chars, loss (struct of start and end in the conversation, null for turns that aren't learnt), attachments and tokens (what
    its placeholders expand to). A conversation's text is that of its rows by nth, end to end. Turns come in the order of `turn`, null first,
    then of role and of a hash of what is written: repeated turns are each kept. Null texts, parts and roles count as empty; null conv_ids are one
    conversation. A loss of no characters is kept as an empty span. Other columns are ignored. An empty table gives no rows.
    Links in texts are split off only where there is no column `parts`. Kinds of part other than the four raise.
    """
    typed = "parts" in turns.columns
    content = F.col("parts").cast(f"array<{PART}>") if typed else F.col("text").cast("string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for conv_id, turn, role, held in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                flat = Flattener(expansion)
                body = flat.flatten(([p for p in held or [] if p]) if typed else parts_of(held or ""))
                head = f"<turn {ROLE_ESCAPED.sub(r'\\\g<0>', role or '')}>"
                whole = f"{head}{body}</turn>\n"
                tie = int.from_bytes(hashlib.blake2b(whole.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)
                out.append((conv_id, turn, role, role in under_loss, whole, len(whole), len(head), len(body), flat.attachments, sum(a["tokens"] for a in flat.attachments), tie))
            if out:
                names = [f.split(" ")[0] for f in re.split(r", (?=\w+ )", TURN)]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), ARROW, strict=True)], names)

    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), content.alias("content")).mapInArrow(run, TURN)
    rows = numbered(rows, ["conv_id"], ["turn", "role", "tie"], sums={"start": "chars"})
    begin = F.col("start") + F.col("content_at")
    loss = F.when(F.col("loss"), F.struct(begin.alias("start"), (begin + F.col("content_chars")).alias("end")))
    return rows.select("conv_id", "nth", "start", "formatted", "chars", loss.alias("loss"), "attachments", "tokens")


ARROW = [pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.string(), pa.int64(), pa.int64(), pa.int64(),
         pa.list_(pa.struct([("kind", pa.string()), ("uri", pa.string()), ("source", pa.string()), ("tokens", pa.int64())])), pa.int64(), pa.int64()]


def read_turns(formatted: str, attachments: list[dict[str, Any]]) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn in formatted text; placeholders become what their attachment was written as, if that is known.

    attachments are those of all the turns, in order. Raises if the text isn't what the template writes.
    """
    role, text, at, before, seen = None, [], 0, 0, 0
    for mark in MARK.finditer(formatted):
        text.append(formatted[at:mark.start()])
        at = mark.end()
        if mark["plain"] is not None:
            text.append(mark["plain"])
        elif mark["role"] is not None:
            if role is not None or any(text):
                raise ValueError("a turn begins inside another one")
            role, text = re.sub(r"\\(.)", r"\1", mark["role"], flags=re.DOTALL), []
        elif mark["end"]:
            if role is None:
                raise ValueError("a turn ends that hasn't begun")
            yield role, "".join(text)
            role, text, before = None, [], seen
        else:
            seen = max(seen, before + int(mark["number"]))
            text.append(attachments[before + int(mark["number"]) - 1]["source"] or mark[0])
    if role is not None or at != len(formatted):
        raise ValueError("a turn doesn't end")


def unescaped(span: str, attachments: list[dict[str, Any]]) -> str:
    """The text of a span of one turn's content."""
    def plain(mark: re.Match[str]) -> str:
        return mark["plain"] or attachments[int(mark["number"]) - 1]["source"] or mark[0]

    return MARK.sub(plain, span)


def digest(formatted: DataFrame) -> DataFrame:
    """Per conversation of format_turns(): conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, attachments, tokens.

    All is read back from what was written: role, line feed, text and line feed of each turn go into turns_sha256, the text of each
    span under the loss into loss_sha256. A hash runs through its conversation from end to end, so one conversation is read by one task, row after
    row; nothing but the hash is held. Raises if a span doesn't lie where its offsets say.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, None

        def row() -> list[Any]:
            n, turns, loss_chars, loss, chars, attached, tokens = held
            return [key[0], n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars, attached, tokens]

        for b in batches:
            out = []
            for conv_id, start, text, span, attachments, tokens in zip(*(b.column(c).to_pylist() for c in ("conv_id", "start", "formatted", "loss", "attachments", "tokens")), strict=True):
                if key != (conv_id,):
                    if key is not None:
                        out.append(row())
                    key, held = (conv_id,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0]
                if start != held[4]:
                    raise ValueError(f"conversation {conv_id} has a gap before {start}")
                for role, said in read_turns(text, attachments):
                    held[1].update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                    held[0] += 1
                if span:
                    said = unescaped(text[span["start"] - start: span["end"] - start], attachments)
                    held[2] += len(said)
                    held[3].update(said.encode("utf-8", "surrogatepass"))
                held[4] += len(text)
                held[5] += len(attachments)
                held[6] += tokens
            if out:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)
        if key is not None:
            yield pa.record_batch([pa.array([c], t) for c, t in zip(row(), kinds, strict=True)], names)

    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "attachments", "tokens"]
    return formatted.select("conv_id", "nth", "start", "formatted", "loss", "attachments", "tokens").repartition("conv_id").sortWithinPartitions("conv_id", "nth").mapInArrow(
        run, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, attachments bigint, tokens bigint")


def format_and_read(turns: DataFrame) -> DataFrame:
    """Format turns, write them, and return the digest of what is read back."""
    return digest(materialise(format_turns(turns), "chat"))
