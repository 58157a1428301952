"""Chat formatting: exact round trips, the loss mask, attachments, and pieces of one huge conversation."""

import hashlib
import random

import pytest

pytest.importorskip("papyrine.llm.queries")

from pyspark.sql import functions as F  # noqa: E402

from papyrine.llm.chat import PIECE, Template, chat_digests, format_chats, formatted_digests, parts_of, read_chats  # noqa: E402
from papyrine.llm.common import Scratch  # noqa: E402

BITS = ["<", "[", "]", ">", "\\", "/", "s>", "</s>", "<s>", "[INST]", "[/INST]", " [/INST]", "<<SYS>>\n", "<</SYS>>", "[ROLE]", "[/ROLE] ", "[IMAGE 1]", "IMAGE 2]", "[FILE 0]", " ", "\n", "é", "😀", "x"]
SCHEMA = "conv_id long, turn long, role string, text string, n_turns string, piece string"


def noise(r):
    return "".join(r.choices(BITS, k=r.randrange(12)))


def test_escaping_is_reversible():
    r, t = random.Random(1), Template()
    for _ in range(20_000):
        turns = [(r.choice(["user", "assistant", "system", "tool", "", noise(r)]), noise(r)) for _ in range(3)]
        text = "".join(a + t.escape(said) + b for role, said in turns for a, b in [t.marks(role)])
        assert [(role, t.unescape(text[a:b])) for role, a, b in t.turns(text)] == turns
    assert t.escape("</s> <\\s> [INST] [\\\\/INST] <x>") == "<\\/s> <\\\\s> [\\INST] [\\\\\\/INST] <x>"


def brute(rows):
    out, t = {}, Template()
    for c, _, role, text in sorted(rows, key=lambda x: (x[1] is not None, x[1] or 0)):
        out.setdefault(c, []).append((role or "", text or ""))
    want = {}
    for c, turns in out.items():
        loss = "".join(x for role, x in turns if role == "assistant")
        size = sum(len(a) + len(t.escape(x)) + len(b) for role, x in turns for a, b in [t.marks(role)])
        want[c] = (len(turns), hashlib.sha256("".join(f"{role}\n{x}\n" for role, x in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), size, 0, 0)
    return want


def test_digests(spark):
    r = random.Random(2)
    rows = [(i, k, r.choice(["user", "assistant", "system", "tool", None]), r.choice([None, "", noise(r), noise(r) * 3])) for i in [*range(60), None] for k in r.sample([None, *range(9)], r.randrange(1, 9))]
    rows += [(500, k, "assistant" if k % 2 else "user", noise(r) * 40) for k in range(3000)] + [(501, 0, "assistant", "long </s> " * 50_000)]
    r.shuffle(rows)
    df = spark.createDataFrame([(*x, "a", "b") for x in rows], SCHEMA).repartition(7).withColumn("content", parts_of(F.col("text")))
    got = formatted_digests(df, Scratch(spark, "t"))
    assert {x.conv_id: tuple(x[1:]) for x in got.collect()} == brute(rows)
    pieces = format_chats(df).filter("conv_id = 500").collect()
    # The huge conversation is in pieces of several ranges, in order.
    assert len({x["range"] for x in pieces}) > 1 and all(len(x.text) < 2 * PIECE for x in pieces) and sum(x.n_turns for x in pieces) == 3000
    # Rows that repeat, and turns of one number, are turns each time.
    twice = spark.createDataFrame([(1, 0, "user", "b", "", ""), (1, 0, "assistant", "a", "", ""), (1, 0, "user", "b", "", "")], SCHEMA).withColumn("content", parts_of(F.col("text")))
    assert [(x.role, [p.text for p in x.parts]) for x in read_chats(format_chats(twice)).orderBy("range", "piece", "turn").collect()] == [("assistant", ["a"]), ("user", ["b"]), ("user", ["b"])]
    assert chat_digests(format_chats(df.limit(0))).count() == 0


def test_parts(spark):
    part = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
    rows = [
        (1, 0, "user", [("text", "look <", None, None, None, None, None), ("text", "s> [IMAGE 1]", None, None, None, None, None), ("image", None, "a.png", 56, 57, None, None), ("audio", None, "b.wav", None, None, 2.5, None), ("text", "\\s>", None, None, None, None, None)]),
        (1, 1, "assistant", [("text", "<", None, None, None, None, None), ("document", None, "c.pdf", None, None, None, 3), ("text", "\\s>", None, None, None, None, None), ("video", None, "d", None, None, None, None), ("image", None, None, None, 3, None, None), None, (None, "end", None, None, None, None, None)]),
        (1, 2, "assistant", None),
    ]
    pieces = format_chats(spark.createDataFrame(rows, f"conv_id long, turn long, role string, content array<{part}>"))
    found = pieces.orderBy("range", "piece").collect()
    assert "".join(x.text for x in found) == "<s>[INST] look <\\s> [\\IMAGE 1][IMAGE 1][AUDIO 2]\\s> [/INST] <[DOCUMENT 1]\\s>[FILE 2][IMAGE 3]end </s>  </s>"
    assert [tuple(a)[1:] for x in found for a in x.attachments] == [(1, "image", "a.png", 6), (2, "audio", "b.wav", 63), (1, "document", "c.pdf", 2304), (2, "file", "d", 256), (3, "image", None, 256)]
    assert [x.text[s.start : s.end] for x in found for s in x.loss] == ["<", "\\s>", "end"]
    back = [(y.role, [(p.type, p.text, p.ref) for p in y.parts]) for y in read_chats(pieces).orderBy("range", "piece", "turn").collect()]
    assert back == [
        ("user", [("text", "look <s> [IMAGE 1]", None), ("image", None, "a.png"), ("audio", None, "b.wav"), ("text", "\\s>", None)]),
        ("assistant", [("text", "<", None), ("document", None, "c.pdf"), ("text", "\\s>", None), ("file", None, "d"), ("image", None, None), ("text", "end", None)]),
        ("assistant", []),
    ]
    d = chat_digests(pieces).first()
    assert (d.n_turns, d.loss_chars, d.loss_sha256) == (3, 7, hashlib.sha256(b"<\\s>end").hexdigest()) and (d.n_attachments, d.attachment_tokens) == (5, 6 + 63 + 2304 + 512)
    assert d.turns_sha256 == hashlib.sha256(b"user\nlook <s> [IMAGE 1]\\s>\nassistant\n<\\s>end\nassistant\n\n").hexdigest()
