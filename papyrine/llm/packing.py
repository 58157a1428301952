"""Packing along a space-filling curve.

A document's hashed vector (each token id adds a fixed pseudo-random sign to one of many buckets) is projected to a few
dimensions; the cell that it falls into has a Hilbert key, and documents are range-sorted by that key. Each range then
fills sequences with neighbouring documents, cutting a document where a sequence is full.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyrine.llm.common import Scratch, partitions_for, shuffle_partitions, slices
from papyrine.llm.tokens import encoder

#: Hashed buckets of a document vector, dimensions that it is projected to, bits of a Hilbert coordinate.
BUCKETS, DIMS, BITS = 256, 4, 8


@lru_cache(maxsize=1)
def _projection(vocab: int) -> np.ndarray:
    """Row t: what one token t adds to the projected vector, its hashed sign times its bucket's row."""
    t = np.arange(vocab, dtype=np.uint64)
    h = (t + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    sign = np.where(h >> np.uint64(63), 1.0, -1.0)
    flat = np.random.default_rng(7).standard_normal((BUCKETS, DIMS))
    return (sign[:, None] * flat[((h >> np.uint64(20)) % np.uint64(BUCKETS)).astype(np.int64)]).astype(np.float32)


def hilbert_key(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The position along the Hilbert curve of integer points, one a row, each coordinate below 2**bits."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    # Undo the excess work of the curve's rotations, from the coarsest bit down.
    for b in range(bits - 1, 0, -1):
        q = 1 << b
        low = q - 1
        for i in range(n):
            on = (x[i] & q) != 0
            swap = (x[0] ^ x[i]) & low
            x[0] = np.where(on, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] = np.where(on, x[i], x[i] ^ swap)
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        t = np.where(x[n - 1] & (1 << b), t ^ ((1 << b) - 1), t)
    x ^= t
    key = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def curve_keys(ids: list[np.ndarray], vocab: int) -> np.ndarray:
    """The Hilbert key of each document; one without ids falls into the middle cell."""
    table = _projection(vocab)
    v = np.stack([table[x].sum(0) for x in ids]) if ids else np.zeros((0, DIMS), np.float32)
    v /= np.maximum(1e-9, np.linalg.norm(v, axis=1, keepdims=True))
    return hilbert_key(np.clip(((v + 1) / 2 * (1 << BITS)).astype(np.int64), 0, (1 << BITS) - 1))


def _encode(tokenizer: str, end_id: int):
    def run(batches):
        model = encoder(tokenizer)
        vocab = max(model.model.get_vocab_size(), end_id + 1)
        for batch in batches:
            for part in slices(batch, size=4 << 20):
                ids = [np.append(x, x.dtype.type(end_id)) for x in model.encode(part["text"].to_list())]
                yield pd.DataFrame({"doc_id": part["doc_id"].array, "key": curve_keys(ids, vocab), "width": [x.itemsize for x in ids], "ids": [x.tobytes() for x in ids]})

    return run


def _pack(length: int):
    def run(batches):
        # Sequence ids are unique without a count of all that came before: the range's number, then the place in it.
        base, used = TaskContext.get().partitionId() << 40, 0
        held: list[list] = []
        columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "seq", "offset"]

        def crc(ids, a, b):
            return zlib.crc32(ids[a:b].astype("<u4").tobytes())

        def close(pieces, size, seq):
            """Rows of pieces that lie one after the other in sequences of ``size`` ids."""
            out, offset = [], 0
            for doc, ids, at, n in pieces:
                while n:
                    take = min(n, size - offset)
                    out.append((doc, at, take, crc(ids, at, at + take), len(ids), base + seq, offset))
                    at, n, offset = at + take, n - take, offset + take
                    if offset == size:
                        seq, offset = seq + 1, 0
            return out, seq

        def frame(rows):
            return pd.DataFrame(rows, columns=columns).astype({"doc_id": "Int64"})

        seq = 0
        for batch in batches:
            for doc, width, blob in zip(batch["doc_id"], batch["width"], batch["ids"], strict=True):
                ids = np.frombuffer(blob, f"<u{width}")
                held.append([None if pd.isna(doc) else int(doc), ids, 0, len(ids)])
                used += len(ids)
            full, left, whole = used // length * length, [], []
            for piece in held:
                take = min(piece[3], full)
                full -= take
                if take:
                    whole.append((piece[0], piece[1], piece[2], take))
                if take < piece[3]:
                    left.append([piece[0], piece[1], piece[2] + take, piece[3] - take])
            rows, seq = close(whole, length, seq)
            held, used = left, used % length
            if rows:
                yield frame(rows)
        # The last ids of a range fill sequences whose lengths are powers of two: these take no padding.
        size = 1 << max(0, used.bit_length() - 1)
        while used:
            part, need = [], size
            for piece in held:
                take = min(piece[3], need)
                if take:
                    part.append((piece[0], piece[1], piece[2], take))
                    piece[2], piece[3], need = piece[2] + take, piece[3] - take, need - take
            held = [p for p in held if p[3]]
            rows, seq = close(part, size, seq)
            yield frame(rows)
            used -= size
            size = 1 << max(0, used.bit_length() - 1)

    return run


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, length: int = 2048, ranges: int | None = None) -> DataFrame:
    """Pieces of all documents in sequences of ``length`` ids (a power of two), neighbours along the curve together.

    Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. A null text is empty and still has its
    end id; a null doc_id stays null; rows that repeat an id are packed each; an empty table gives no pieces. Ids of
    each row lie in exactly one piece each, sequences have no gaps, and only sequences shorter than ``length`` are those
    that end a range: their lengths are powers of two, so nothing is padded.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    scratch = Scratch(spark, "packing")
    coded = scratch.table(rows.mapInPandas(_encode(tokenizer, end_id), "doc_id long, key long, width int, ids binary"), "ids")
    # Ties of the key, even a third of all rows, are split by the id.
    order = coded.repartitionByRange(ranges or partitions_for(docs, 2 * shuffle_partitions(spark)), "key", "doc_id").sortWithinPartitions("key", "doc_id")
    out = order.select("doc_id", "width", "ids").mapInPandas(_pack(length), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, seq long, offset long")
    return out.withColumnRenamed("seq", "sequence_id").select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
