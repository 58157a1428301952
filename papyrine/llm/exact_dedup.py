"""Exact deduplication with mergeable counting quotient filters.

Each partition builds a counting quotient filter (CQF) of the 64-bit fingerprints of its texts. A filter is cut into
segments by the leading fingerprint bits; segments of all partitions with the same lead are merged losslessly, as
sorted lists of remainders whose counts add up. Fingerprints counted more than once route their documents to byte
verification: a grouping by the whole text, combined per partition before the shuffle, so a group that holds a third of
all rows arrives as one row per task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrine.llm.common import Scratch, lower_ascii, rows_of, shuffle_partitions

#: Fingerprints that a merged segment holds on average; it bounds the memory of one merge.
SEGMENT_ROWS = 500_000


class CountingQuotientFilter:
    """Lossless multiset of ``bits``-bit fingerprints.

    The quotient (leading ``q`` bits) selects a run, the remainders of a run are stored sorted. ``occupieds`` has one
    bit for each quotient with a run, ``runends`` one bit for each stored remainder that is the last of its run, and
    counts above one are kept beside their slots.
    """

    def __init__(self, prints: np.ndarray, counts: np.ndarray, q: int, bits: int):
        """``prints``: sorted distinct uint64 below 2**bits; ``counts``: how often each occurs."""
        self.q, self.r = q, bits - q
        quotient = (prints >> np.uint64(self.r)).astype(np.int64)
        self.remainders = prints & np.uint64((1 << self.r) - 1)
        occupied = np.zeros(1 << q, dtype=bool)
        occupied[quotient] = True
        ends = np.ones(len(prints), dtype=bool)
        ends[:-1] = quotient[1:] != quotient[:-1]
        self.n = len(prints)
        self.occupieds, self.runends = np.packbits(occupied), np.packbits(ends)
        self.many = np.flatnonzero(counts > 1).astype(np.uint32)
        self.extra = counts[self.many].astype(np.uint64)

    @staticmethod
    def width(r: int) -> int:
        """Bytes of a stored remainder."""
        return (r + 7) // 8

    def to_bytes(self) -> bytes:
        w = self.width(self.r)
        kept = self.remainders.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :w]
        head = np.array([self.q, self.r, self.n, len(self.many)], dtype="<u8")
        return b"".join(x.tobytes() for x in (head, self.occupieds, self.runends, kept, self.many, self.extra))

    @staticmethod
    def decode(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
        """The sorted fingerprints and their counts."""
        q, r, n, m = (int(x) for x in np.frombuffer(blob, "<u8", 4))
        at = 32
        size = ((1 << q) + 7) // 8
        runs = np.flatnonzero(np.unpackbits(np.frombuffer(blob, np.uint8, size, at), count=1 << q))
        at += size
        size = (n + 7) // 8
        ends = np.unpackbits(np.frombuffer(blob, np.uint8, size, at), count=n)
        at += size
        w = CountingQuotientFilter.width(r)
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :w] = np.frombuffer(blob, np.uint8, n * w, at).reshape(n, w)
        at += n * w
        counts = np.ones(n, np.uint64)
        many = np.frombuffer(blob, "<u4", m, at)
        counts[many] = np.frombuffer(blob, "<u8", m, at + 4 * m)
        run = np.concatenate([[0], np.cumsum(ends)[:-1]]).astype(np.int64) if n else np.zeros(0, np.int64)
        return (runs[run].astype(np.uint64) << np.uint64(r)) | wide.view("<u8").ravel(), counts


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Merges sorted lists of fingerprints; counts of equal ones add up."""
    prints = np.concatenate([p for p, _ in parts]) if parts else np.zeros(0, np.uint64)
    counts = np.concatenate([c for _, c in parts]) if parts else np.zeros(0, np.uint64)
    order = np.argsort(prints, kind="stable")
    prints, counts = prints[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], prints[1:] != prints[:-1]])) if len(prints) else np.zeros(0, int)
    return prints[first], np.add.reduceat(counts, first) if len(first) else counts


def _build(lead: int):
    """Of the column ``fp``, one row (segment, filter) for each segment that a partition has."""

    def run(batches):
        pool: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0
        for batch in batches:
            fp = batch["fp"].to_numpy(np.int64).view(np.uint64)
            prints, counts = np.unique(fp, return_counts=True)
            pool.append((prints, counts.astype(np.uint64)))
            held += len(prints)
            if held > 4 * SEGMENT_ROWS:
                pool = [_merge(pool)]
                held = 0
        prints, counts = _merge(pool)
        if not len(prints):
            return
        rest = 64 - lead
        segment = (prints >> np.uint64(rest)).astype(np.int64) if lead else np.zeros(len(prints), np.int64)
        first = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]]))
        out = []
        for a, b in zip(first, [*first[1:], len(prints)], strict=True):
            low = prints[a:b] & np.uint64((1 << rest) - 1)
            q = max(1, int(b - a).bit_length())
            out.append((int(segment[a]), CountingQuotientFilter(low, counts[a:b], q, rest).to_bytes()))
        yield pd.DataFrame(out, columns=["segment", "cqf"]).astype({"segment": "int64"})

    return run


def _repeated(lead: int):
    def run(key, group: pd.DataFrame) -> pd.DataFrame:
        prints, counts = _merge([CountingQuotientFilter.decode(x) for x in group["cqf"]])
        prints = prints[counts > 1]
        if lead:
            prints = prints | (np.uint64(key[0]) << np.uint64(64 - lead))
        return pd.DataFrame({"fp": prints.view(np.int64)})

    return run


def repeated_fingerprints(prints: DataFrame) -> DataFrame:
    """The values of ``fp`` (long) that occur more than once, by merged counting quotient filters."""
    spark = prints.sparkSession
    want = max(rows_of(prints) // SEGMENT_ROWS, 4 * shuffle_partitions(spark), 1)
    lead = min(20, (want - 1).bit_length())
    filters = prints.select("fp").mapInPandas(_build(lead), "segment long, cqf binary")
    return filters.groupBy("segment").applyInPandas(_repeated(lead), "fp long")


def exact_groups(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical after lower-casing A-Z; null counts as empty. The largest id of a group
    stays. Rows that repeat an id stay or go together, a null id is smaller than any other; an empty table gives no
    rows. Other columns, whatever their names, are ignored.
    """
    text = lower_ascii(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    norm = docs.select(F.col(id_col).alias("doc_id"), text.alias("norm"))
    norm = norm.withColumn("fp", F.xxhash64("norm"))
    ids = scratch.table(norm.select("doc_id", "fp", F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256")), "ids")
    twice = scratch.table(repeated_fingerprints(ids), "repeated")
    # Byte verification: grouping by the whole text; sha2 then only names a verified class.
    classes = (
        norm.join(twice, "fp", "left_semi")
        .groupBy("norm")
        .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .filter("group_size > 1")
        .select(F.sha2(F.col("norm").cast("binary"), 256).alias("class_sha"), "keep_id", "group_size")
    )
    joined = ids.join(classes, ids.text_sha256 == classes.class_sha, "left")
    return joined.select(
        "doc_id",
        F.coalesce("keep_id", "doc_id").alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.coalesce("keep_id", "doc_id")).alias("kept"),
        "text_sha256",
    )


def drop_exact_copies(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``docs`` without the rows whose text a row with a larger id has too; columns and row contents stay. Rows go by id and
    text, so others that repeat an id, null among them, stay."""
    scratch = Scratch(spark, "exact")
    gone = exact_groups(docs, scratch).filter(~F.col("kept")).select(F.col("doc_id").alias("__gone"), F.col("text_sha256").alias("__sha"))
    gone = scratch.last(gone.distinct())
    own = F.sha2(lower_ascii(F.coalesce(docs["text"].cast("string"), F.lit(""))).cast("binary"), 256)
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["__gone"]) & (own == gone["__sha"]), "left_anti")
