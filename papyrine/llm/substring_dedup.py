"""Suffix-array deduplication: removes every byte that lies in a LEAST-byte string which also starts earlier.

Equal strings of LEAST bytes have the same smallest hash of their GRAM-byte parts. Runs of consecutive starts with the
same smallest hash are the units of work: a run whose hash no other run has can't repeat anything and is done after one
count. Of equal runs all but the first are repeats as a whole. Only different runs with the same hash go, by that hash,
to buckets of bounded size, where interval expansion on a Burrows-Wheeler transform (bwt.py) finds the strings that they
share. Hashes with very many different runs, such as the edges of a passage that a third of all documents quote, are
compared string by string in a grouping that is combined before the shuffle. Copies of a whole document are equal runs
from end to end.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyrine.llm.bwt import STOP, repeated_prefixes
from papyrine.llm.common import Scratch
from papyrine.llm.shingles import _powers, mix

#: Bytes of a removable string, of the parts that are hashed, starts in a run, bytes of a bucket, runs that fill a bucket
#: by themselves (more make a hash hot).
LEAST, GRAM, RUN, BUCKET_BYTES, HOT = 100, 32, 256, 1 << 20, 8192
_REACH = LEAST - GRAM + 1
#: Ids of several rows that are broadcast.
REPEATED = 1_000_000


def runs_of(data: bytes) -> tuple[np.ndarray, ...]:
    """Runs of starts with one smallest hash: that hash, a hash of the run's bytes, first start, starts, and whether the
    smallest part stands more than once in it (a string may then repeat within the run)."""
    n = len(data)
    if n < LEAST:
        e = np.zeros(0, np.int64)
        return e, e, e, e, e.astype(bool)
    p, q = _powers(1 << max(20, n.bit_length()))
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)) * p[:n], out=total[1:])
    grams = mix((total[GRAM:] - total[:-GRAM]) * q[: n - GRAM + 1])
    low, width = grams, 1
    while 2 * width <= _REACH:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < _REACH:
        low = np.minimum(low[: len(low) - (_REACH - width)], low[_REACH - width :])
    first = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
    length = np.diff(np.append(first, len(low)))
    if length.max() > RUN:
        pieces = -(-length // RUN)
        part = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        first = np.repeat(first, pieces) + part * RUN
        length = np.minimum(np.repeat(length, pieces) - part * RUN, RUN)
    end = first + length + LEAST - 1
    whole = mix((total[end] - total[first]) * q[first] + length.astype(np.uint64))
    value = low[first]
    left = np.argmax(grams[first[:, None] + np.arange(_REACH)] == value[:, None], axis=1) + first
    last = first + length - 1
    right = last + _REACH - 1 - np.argmax(grams[last[:, None] + np.arange(_REACH - 1, -1, -1)] == value[:, None], axis=1)
    return value.view(np.int64), whole.view(np.int64), first, length, left != right


def _encode(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def _runs(batches):
    for batch in batches:
        out, held = [], 0
        for doc, part, text in zip(batch["doc_id"], batch["part"], batch["text"], strict=True):
            h, t, a, n, twice = runs_of(_encode(text))
            if len(h):
                out.append((np.full(len(h), doc), np.full(len(h), part), h, t, a, n, twice))
                held += len(h)
            if held > 50_000:
                yield _frame(out)
                out, held = [], 0
        if out:
            yield _frame(out)


def _frame(parts) -> pd.DataFrame:
    d, p, h, t, a, n, twice = (np.concatenate(x) for x in zip(*parts, strict=True))
    return pd.DataFrame({"doc_id": d, "part": p, "low": h, "run": t, "at": a.astype(np.int32), "n": n.astype(np.int32), "twice": twice})


def _cut(batches):
    """The bytes of listed runs."""
    for batch in batches:
        rows = []
        for doc, part, text, runs in zip(batch["doc_id"], batch["part"], batch["text"], batch["runs"], strict=True):
            data = _encode(text)
            rows += [(r["low"], doc, part, r["at"], data[r["at"] : r["at"] + r["n"] + LEAST - 1]) for r in runs]
        yield pd.DataFrame(rows, columns=["low", "doc_id", "part", "at", "bytes"])


def _expand(key, group: pd.DataFrame) -> pd.DataFrame:
    """Of the runs of a bucket, the ranges of starts whose strings also start earlier among them."""
    group = group.drop_duplicates(["doc_id", "part", "at"])  # rows that repeat a document have cut its runs again
    parts = group["bytes"].tolist()
    text = np.frombuffer(b"".join(p + bytes([STOP]) for p in parts), np.uint8)
    size = np.array([len(p) + 1 for p in parts])
    begin = np.cumsum(size) - size
    order, same = repeated_prefixes(text, LEAST)
    owner = np.repeat(np.arange(len(parts)), size)
    left = np.repeat(begin + size - 1, size) - np.arange(len(text))
    # Starts with whole strings, in sorted order; a class ends where the common prefix is shorter.
    group_of = np.cumsum(~same)
    shared = np.concatenate([same[1:], [False]]) | same
    on = shared & (left[order] >= LEAST)
    pos, cls = order[on], group_of[on]
    doc, part, at = (group[c].to_numpy(np.int64)[owner[pos]] for c in ("doc_id", "part", "at"))
    start = at + pos - begin[owner[pos]]
    o = np.lexsort((start, part, doc, cls))
    doc, part, start, cls = doc[o], part[o], start[o], cls[o]
    later = np.concatenate([[False], cls[1:] == cls[:-1]]) if len(cls) else np.zeros(0, bool)
    doc, part, start = doc[later], part[later], start[later]
    o = np.lexsort((start, part, doc))
    doc, part, start = doc[o], part[o], start[o]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (part[1:] != part[:-1]) | (start[1:] > start[:-1] + 1)
    at = np.flatnonzero(new)
    end = np.append(at[1:], len(doc)) - 1 if len(at) else at
    return pd.DataFrame({"doc_id": doc[at], "part": part[at], "a": start[at], "b": start[end] + LEAST})


def _finish(batches):
    for batch in batches:
        out = []
        for doc, text, ranges in zip(batch["doc_id"], batch["text"], batch["ranges"], strict=True):
            data = _encode(text)
            kept, at, removed, spans = [], 0, 0, 0
            for a, b in sorted((r["a"], r["b"]) for r in (ranges if ranges is not None else [])):
                if a > at or not spans:
                    kept.append(data[at:a])
                    spans += 1
                    at = a
                if b > at:
                    removed += b - at
                    at = b
            kept.append(data[at:])
            assert removed <= len(data), f"document {doc} has ranges of another one"
            out.append((doc, len(data), removed, spans, hashlib.sha256(b"".join(kept)).hexdigest()))
        yield pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def removed_ranges(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """Byte ranges [a, b) of strings that also start earlier, of documents (doc_id, part, text), in that order of documents."""
    runs = scratch.table(docs.mapInPandas(_runs, "doc_id long, part long, low long, run long, at int, n int, twice boolean"), "runs")
    lows = runs.groupBy("low").agg(F.count(F.lit(1)).alias("c"), F.min("run").alias("r0"), F.max("run").alias("r1"), F.max("twice").alias("t"))
    lows = lows.filter("c > 1 or t").select("low", ((F.col("r0") != F.col("r1")) | F.col("t")).alias("mixed"))
    runs = scratch.table(runs.join(lows, "low").drop("twice"), "shared")
    scratch.drop("runs")
    first = F.min(F.struct("doc_id", "part", "at")).alias("first")
    kinds = scratch.table(runs.groupBy("low", "run", "n", "mixed").agg(first, F.count(F.lit(1)).alias("c")), "kinds")
    many = kinds.filter("c > 1").select("low", "run", "first")
    later = runs.join(many, ["low", "run"]).filter(F.struct("doc_id", "part", "at") != F.col("first"))
    later = later.select("doc_id", "part", F.col("at").cast("long").alias("a"), (F.col("at") + F.col("n") + LEAST - 1).cast("long").alias("b"))

    mixed = kinds.filter("mixed").select("low", F.col("first.doc_id").alias("doc_id"), F.col("first.part").alias("part"), F.col("first.at").alias("at"), "n")
    each = mixed.groupBy("low").agg(F.count(F.lit(1)).alias("kinds"))
    hot = scratch.table(each.filter(F.col("kinds") > HOT).select("low"), "hot")
    lists = mixed.groupBy("doc_id", "part").agg(F.collect_list(F.struct("low", "at", "n")).alias("runs"))
    cut = docs.join(lists, ["doc_id", "part"]).mapInPandas(_cut, "low long, doc_id long, part long, at int, bytes binary")
    cut = scratch.table(cut, "cut")
    size = cut.agg(F.sum(F.octet_length("bytes"))).first()[0] or 0
    buckets = max(64, int(size // BUCKET_BYTES))
    cool = cut.join(hot, "low", "left_anti").withColumn("bucket", F.pmod(F.xxhash64("low"), F.lit(buckets)))
    found = cool.groupBy("bucket").applyInPandas(_expand, "doc_id long, part long, a long, b long")

    starts = F.sequence(F.lit(0), F.octet_length("bytes") - LEAST)
    grams = cut.join(hot, "low", "left_semi").select("doc_id", "part", "at", "bytes", F.explode(starts).alias("k"))
    grams = grams.select("doc_id", "part", (F.col("at") + F.col("k")).cast("long").alias("a"), F.md5(F.expr(f"substring(bytes, k + 1, {LEAST})")).alias("gram"))
    earliest = grams.groupBy("gram").agg(F.min(F.struct("doc_id", "part", "a")).alias("first"), F.count(F.lit(1)).alias("c")).filter("c > 1")
    again = grams.join(earliest, "gram").filter(F.struct("doc_id", "part", "a") != F.col("first"))
    return later.unionAll(found).unionAll(again.select("doc_id", "part", "a", (F.col("a") + LEAST).alias("b")))


def substring_dedup(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Strings are judged on the input, in the order of (doc_id, start); matches don't cross documents. A null text is
    empty. Null ids come before all others. Of rows that repeat an id, null among them, each text is a document of its
    own, and the one with the smaller hash comes first; rows that repeat both id and text are one document, whose result
    each of them gets. An empty table gives no rows, other columns aren't read.
    """
    none = -(1 << 63)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(none)).alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = _numbered(rows, none, scratch)
    ranges = scratch.table(removed_ranges(rows.filter(F.octet_length("text") >= LEAST), scratch), "ranges")
    for name in ("shared", "kinds", "cut"):
        scratch.drop(name)
    per_doc = ranges.groupBy("doc_id", "part").agg(F.collect_list(F.struct("a", "b")).alias("ranges"))
    done = rows.join(per_doc, ["doc_id", "part"], "left").select("doc_id", "text", "ranges").mapInPandas(_finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return done.withColumn("doc_id", F.when(F.col("doc_id") != none, F.col("doc_id")))


def _numbered(rows: DataFrame, none: int, scratch: Scratch) -> DataFrame:
    """``rows`` with ``part``, which tells texts of one id apart: 0 where a single row has the id, else a hash of the text.
    Ids alone are counted; those that several rows have are broadcast if they are at most REPEATED."""
    repeated = scratch.table(rows.filter(F.col("doc_id") != none).groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("doc_id", F.lit(True).alias("again")), "repeated")
    n = repeated.count()
    again = F.col("doc_id") == none
    if n:
        rows = rows.join(F.broadcast(repeated) if n <= REPEATED else repeated.hint("merge"), "doc_id", "left")
        again = again | F.coalesce("again", F.lit(False))
    return rows.select("doc_id", F.when(again, F.xxhash64("text")).otherwise(F.lit(0)).cast("long").alias("part"), "text")
