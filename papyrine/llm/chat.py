"""Chat formatting: conversations of typed content parts to training text with a loss mask, and back.

A visitor walks a turn's parts in order: text is escaped, and an image, a recording or a document becomes a numbered
placeholder and an attachment record with its reference and the number of tokens that the placeholder expands to. A
template marks the turns. Its control strings, and strings that look like placeholders, get a backslash after their first
character where they occur in a text, and one backslash more where they have some; so no text can end a turn, and reading
takes exactly that backslash away.

Turns are dealt by ranges of (conversation, turn), so one huge conversation spreads over tasks. Neighbouring turns of a
conversation make up pieces of formatted text of a bounded length, which in order are the conversation.
"""

from __future__ import annotations

import hashlib
import math
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyrine.llm.common import Scratch, partitions_for, shuffle_partitions

#: A content part: what it is, its text, or where it is and how large (pixels, seconds or pages, by type).
PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
#: Characters after which a piece of formatted text ends with its turn.
PIECE = 1 << 15
_ATTACHMENT = "array<struct<turn:long,number:int,kind:string,ref:string,tokens:long>>"
PIECES = "conv_id {}, range int, piece int, n_turns long, text string, loss array<struct<start:long,end:long>>, attachments " + _ATTACHMENT


@dataclass(frozen=True)
class Template:
    """What stands before and after the text of a turn, by role; the role's name stands between two strings where it has
    no marks of its own. ``control`` are regular expressions of (first character, rest) of control strings."""

    roles: dict = field(default_factory=lambda: {"system": ("<<SYS>>\n", "\n<</SYS>>\n"), "user": ("<s>[INST] ", " [/INST]"), "assistant": (" ", " </s>")})
    other: tuple[str, str, str] = ("[ROLE]", "[/ROLE] ", " </s>")
    control: tuple = (("<", r"/?s>|</?SYS>>"), (r"\[", r"/?INST\]|/?ROLE\]|(?:IMAGE|AUDIO|DOCUMENT|FILE) [0-9]+\]"))
    loss: frozenset = frozenset({"assistant"})

    def pattern(self, least: int) -> str:
        """Control strings with ``least`` or more backslashes after the first character."""
        marks = "*" if least == 0 else "+"
        return "|".join(rf"(?<={head})\\{marks}(?={rest})" for head, rest in self.control)

    def escape(self, text: str) -> str:
        return re.sub(self.pattern(0), lambda m: "\\" + m[0], text)

    def unescape(self, text: str) -> str:
        return re.sub(self.pattern(1), lambda m: m[0][1:], text)

    def marks(self, role: str) -> tuple[str, str]:
        if role in self.roles:
            return self.roles[role]
        return self.other[0] + self.escape(role) + self.other[1], self.other[2]

    def turns(self, text: str):
        """(role, start, end) of each turn's text in formatted text."""
        at = 0
        while at < len(text):
            # The role whose mark is longest goes first: one may be the beginning of another.
            role = next((r for r, (mark, _) in sorted(self.roles.items(), key=lambda x: -len(x[1][0])) if text.startswith(mark, at)), None)
            if role is None:
                start = text.index(self.other[1], at)
                role, close = self.unescape(text[at + len(self.other[0]) : start]), self.other[2]
                start += len(self.other[1])
            else:
                start, close = at + len(self.roles[role][0]), self.roles[role][1]
            end = text.index(close, start)
            yield role, start, end
            at = end + len(close)


@dataclass(frozen=True)
class Rates:
    """Tokens of attachments: an image has one for each patch, and these are for a second, a page, or where the size isn't
    known."""

    patch: int = 28
    second: float = 25.0
    page: int = 768
    unknown: int = 256


class Flattener:
    """Visits the parts of one turn; ``text`` is their flat text, ``spans`` where text parts are in it, ``attachments``
    (number, kind, ref, tokens) in order."""

    def __init__(self, template: Template, rates: Rates):
        self.template, self.rates = template, rates
        self.out: list[str] = []
        self.open: list[str] = []
        self.size = 0
        self.spans: list[tuple[int, int]] = []
        self.attachments: list[tuple[int, str, str | None, int]] = []

    def visit(self, part: dict | None) -> None:
        if part is not None:
            getattr(self, f"visit_{part['type'] or 'text'}", self.visit_file)(part)

    def _add(self, text: str) -> None:
        self.out.append(text)
        self.size += len(text)

    def text(self) -> str:
        self._close()
        return "".join(self.out)

    def _close(self) -> None:
        """Texts that touch are escaped as one, as a control string may begin in one and end in the next."""
        start, text = self.size, self.template.escape("".join(self.open))
        self.open = []
        if text:
            self._add(text)
            self.spans.append((start, self.size))

    def _attach(self, part: dict, kind: str, tokens: float | None) -> None:
        self._close()
        n = len(self.attachments) + 1
        self._add(f"[{kind.upper()} {n}]")
        self.attachments.append((n, kind, part["ref"], self.rates.unknown if tokens is None else max(0, math.ceil(tokens))))

    def visit_text(self, part: dict) -> None:
        self.open.append(part["text"] or "")

    def visit_image(self, part: dict) -> None:
        w, h, patch = part["width"], part["height"], self.rates.patch
        self._attach(part, "image", None if w is None or h is None else math.ceil(w / patch) * math.ceil(h / patch))

    def visit_audio(self, part: dict) -> None:
        s = part["seconds"]
        self._attach(part, "audio", None if s is None or not math.isfinite(s) else s * self.rates.second)

    def visit_document(self, part: dict) -> None:
        self._attach(part, "document", None if part["pages"] is None else part["pages"] * self.rates.page)

    def visit_file(self, part: dict) -> None:
        self._attach(part, "file", None)


PLACEHOLDER = re.compile(r"\[(IMAGE|AUDIO|DOCUMENT|FILE) ([0-9]+)\]")


def parts_of(text: Column) -> Column:
    """A plain text as a turn's content."""
    names = [f.split(":") for f in PART[7:-1].split(",")]
    values = {"type": F.lit("text"), "text": F.coalesce(text, F.lit(""))}
    return F.array(F.struct(*[values.get(n, F.lit(None)).cast(k).alias(n) for n, k in names]))


def format_chats(turns: DataFrame, template: Template | None = None, rates: Rates | None = None) -> DataFrame:
    """Formatted pieces of (conv_id, turn, role, content: array of PART).

    Turns go by ``turn`` (null first); those of one number by role and a hash of their content. Null conversations are one
    conversation, a null role is an empty one, null content and null parts are nothing, a part without a type is text, one
    of another type than text, image, audio and document is a file. Rows that repeat are turns each time. A piece's rows
    are in order by (range, piece); ``loss`` are the spans of code points of its text that the loss counts, and a
    placeholder isn't among them. ``turn`` of an attachment counts the turns of its piece from 0. An empty table gives an
    empty one; other columns aren't read.
    """
    template, rates = template or Template(), rates or Rates()
    kind = turns.schema["conv_id"].dataType.simpleString()
    schema = PIECES.format(kind)
    arrow = pa.schema([("range", pa.int32()), ("piece", pa.int32()), ("n_turns", pa.int64()), ("text", pa.string()), ("loss", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("attachments", pa.list_(pa.struct([("turn", pa.int64()), ("number", pa.int32()), ("kind", pa.string()), ("ref", pa.string()), ("tokens", pa.int64())])))])

    def one(role: str, content) -> tuple[str, list, list]:
        flat = Flattener(template, rates)
        for part in content or ():
            flat.visit(part)
        before, after = template.marks(role)
        text = before + flat.text() + after
        spans = [(len(before) + a, len(before) + b) for a, b in flat.spans] if role in template.loss else []
        return text, spans, flat.attachments

    def run(batches):
        at, number = TaskContext.get().partitionId(), 0
        conv, texts, size, loss, attached = None, [], 0, [], []
        for batch in batches:
            keys, done = [], []

            def close():
                nonlocal number, texts, size, loss, attached
                if texts:
                    keys.append(conv)
                    done.append({"range": at, "piece": number, "n_turns": len(texts), "text": "".join(texts), "loss": loss, "attachments": attached})
                    number, texts, size, loss, attached = number + 1, [], 0, [], []

            for c, role, content in zip(*(batch[k] for k in ("conv_id", "role", "content")), strict=True):
                if c != conv or size > PIECE:
                    close()
                    conv = c
                text, spans, records = one(role.as_py() or "", content.as_py())
                loss += [{"start": size + a, "end": size + b} for a, b in spans]
                attached += [{"turn": len(texts), "number": n, "kind": k, "ref": r, "tokens": t} for n, k, r, t in records]
                texts.append(text)
                size += len(text)
            close()  # a piece doesn't wait for the next batch
            rows = pa.RecordBatch.from_pylist(done, arrow)
            ids = pa.array([x.as_py() for x in keys], batch.schema.field("conv_id").type)
            yield pa.RecordBatch.from_arrays([ids, *rows.columns], ["conv_id", *arrow.names])

    keyed = turns.select("conv_id", "turn", "role", "content", F.xxhash64(F.to_json("content")).alias("tie"))
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "tie")]
    ranged = keyed.repartitionByRange(partitions_for(keyed, shuffle_partitions(turns.sparkSession)), *order).sortWithinPartitions(*order)
    return ranged.select("conv_id", "role", "content").mapInArrow(run, schema)


def read_chats(pieces: DataFrame, template: Template | None = None) -> DataFrame:
    """The turns of formatted pieces: conv_id, range, piece, turn (within the piece), role, parts (type, text or the
    attachment's ref, in order)."""
    template = template or Template()
    kind = pieces.schema["conv_id"].dataType

    @F.udf("array<struct<role:string,parts:array<struct<type:string,text:string,ref:string>>>>", useArrow=True)
    def read(text, attachments):
        refs = {(a["turn"], a["number"]): a["ref"] for a in attachments}
        out = []
        for i, (role, a, b) in enumerate(template.turns(text)):
            parts, at = [], a
            for m in PLACEHOLDER.finditer(text, a, b):
                if m.start() > at:
                    parts.append(("text", template.unescape(text[at : m.start()]), None))
                parts.append((m[1].lower(), None, refs[i, int(m[2])]))
                at = m.end()
            if b > at:
                parts.append(("text", template.unescape(text[at:b]), None))
            out.append((role, parts))
        return out

    found = pieces.select("conv_id", "range", "piece", F.posexplode(read("text", "attachments")).alias("turn", "x"))
    return found.select(F.col("conv_id").cast(kind), "range", "piece", "turn", "x.role", "x.parts")


def chat_digests(pieces: DataFrame, template: Template | None = None) -> DataFrame:
    """Per conversation, read back from its formatted pieces: conv_id, n_turns, turns_sha256 (role, line feed, text, line
    feed for each turn), loss_chars and loss_sha256 (of the text under the mask, unescaped), formatted_chars, n_attachments,
    attachment_tokens.

    A digest of a whole conversation is made in its order. So the pieces of one conversation go through one task, in order
    and a few at a time: what a task holds is bounded, its time isn't where one conversation is most of the data.
    """
    template = template or Template()
    kind = pieces.schema["conv_id"].dataType.simpleString()
    names = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_attachments", "attachment_tokens"]

    def start():
        return {"n_turns": 0, "turns": hashlib.sha256(), "loss_chars": 0, "loss": hashlib.sha256(), "formatted_chars": 0, "n_attachments": 0, "attachment_tokens": 0}

    def run(batches):
        conv, sums, fields = None, None, None
        keys, done = [], []

        def close():
            keys.append(conv)
            done.append({**sums, "turns_sha256": sums["turns"].hexdigest(), "loss_sha256": sums["loss"].hexdigest()})

        def out():
            nonlocal keys, done
            columns = [pa.array(keys, fields), *(pa.array([d[n] for d in done], pa.string() if n.endswith("sha256") else pa.int64()) for n in names)]
            keys, done = [], []
            return pa.RecordBatch.from_arrays(columns, ["conv_id", *names])

        for batch in batches:
            fields = batch.schema.field("conv_id").type
            for c, text, loss, attachments in zip(*(batch[k] for k in ("conv_id", "text", "loss", "attachments")), strict=True):
                c, text = c.as_py(), text.as_py()
                if sums is None or c != conv:
                    if sums is not None:
                        close()
                    conv, sums = c, start()
                for role, a, b in template.turns(text):
                    said = "".join(map(template.unescape, PLACEHOLDER.split(text[a:b])[::3]))
                    sums["n_turns"] += 1
                    sums["turns"].update(f"{role}\n{said}\n".encode())
                for span in loss.as_py():
                    said = template.unescape(text[span["start"] : span["end"]])
                    sums["loss_chars"] += len(said)
                    sums["loss"].update(said.encode())
                sums["formatted_chars"] += len(text)
                for x in attachments.as_py():
                    sums["n_attachments"] += 1
                    sums["attachment_tokens"] += x["tokens"]
            if done:
                yield out()
        if sums is not None:
            close()
            yield out()

    parts = partitions_for(pieces, shuffle_partitions(pieces.sparkSession))
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "range", "piece")]
    dealt = pieces.select("conv_id", "range", "piece", "text", "loss", "attachments").repartition(parts, "conv_id").sortWithinPartitions(*order)
    return dealt.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_attachments long, attachment_tokens long")


def formatted_digests(turns: DataFrame, scratch: Scratch) -> DataFrame:
    """Writes the formatted pieces of (conv_id, turn, role, content), reads the table back and digests it."""
    return chat_digests(scratch.table(format_chats(turns), "formatted"))
