"""Vector codes: integer vectors cut into parts, each part replaced by the index of its nearest codebook entry.

Vectors are laid out as blocks, columns of NumPy integers by part and dimension. A round of training goes over all blocks
with ``treeAggregate``: in a task distances to a part's entries accumulate one dimension at a time, and ``np.add.at`` adds
the parts to int64 tensors of sums and counts by entry. These are of one size whatever the input is (parts x entries x
dimensions), and tasks' tensors merge through a reduction tree. Everything is integer arithmetic, so the order of tasks and
their repetition don't change a result.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyrine.llm.common import Scratch, joined_by_share

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Vectors of a block; tasks' tensors that meet at a node of the reduction tree, about.
BLOCK, FAN_IN = 2048, 32
#: Integer components reach this at most: squared distances of parts of up to 2^8 dimensions fit in 64 bits.
LARGEST = 1 << 26


@dataclass(frozen=True)
class Codebooks:
    """``entries[part, entry]`` are integer components."""

    entries: np.ndarray

    def sha256(self) -> str:
        """Of all components by part, entry and position, as decimals with commas between."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def nearest(self, part: int, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of, and squared distance to, the nearest entry (the first of equals) for a block's (dimensions x vectors)."""
        entries = self.entries[part]
        far = np.zeros((entries.shape[0], columns.shape[1]), np.int64)
        for d, column in enumerate(columns.astype(np.int64)):
            off = column[None, :] - entries[:, d, None]
            far += off * off
        at = far.argmin(0)
        return at, far[at, np.arange(len(at))]

    def encode(self, block) -> tuple[np.ndarray, np.ndarray]:
        """Codes (vectors x parts) and errors of a block's vectors."""
        found = [self.nearest(p, columns(block, p)) for p in range(len(self.entries))]
        return np.stack([at for at, _ in found], 1).astype(np.uint8), np.sum([e for _, e in found], 0)

    def decode(self, code: str) -> np.ndarray:
        """The integer vector that a code stands for."""
        return np.concatenate([self.entries[p, k] for p, k in enumerate(bytes.fromhex(code))])


def columns(block, part: int) -> np.ndarray:
    """A part's dimensions x vectors."""
    return np.frombuffer(block["parts"][part], "<i4").reshape(-1, block["size"])


def finite(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(math.inf)))
    return vector.isNotNull() & ~F.coalesce(odd, F.lit(False))


def integers(vectors) -> np.ndarray:
    return np.floor(np.stack(vectors).astype(np.float64) * SCALE).astype(np.int64)


def to_blocks(vectors: DataFrame) -> DataFrame:
    """Columnar blocks of (id, label, vector): ids, labels, size and for each part an int32 matrix, dimension by dimension."""

    def run(batches):
        for batch in batches:
            for a in range(0, len(batch), BLOCK):
                rows = batch.iloc[a : a + BLOCK]
                whole = integers(rows["vector"]).astype("<i4")
                width = whole.shape[1] // PARTS
                parts = [np.ascontiguousarray(whole[:, p * width : (p + 1) * width].T).tobytes() for p in range(PARTS)]
                ids, labels = ([None if pd.isna(x) else x for x in rows[c]] for c in ("id", "label"))
                yield pd.DataFrame({"ids": [ids], "labels": [labels], "size": [len(rows)], "parts": [parts]})

    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema}
    return vectors.mapInPandas(run, f"ids array<{kinds['id']}>, labels array<{kinds['label']}>, size int, parts array<binary>")


def improved(blocks: DataFrame, books: Codebooks) -> Codebooks:
    """One round: each entry becomes the floor of the mean of the parts that are nearest to it; one without parts stays."""
    shape = books.entries.shape

    def add(tensors, block):
        sums, counts = tensors or (np.zeros(shape, np.int64), np.zeros(shape[:2], np.int64))
        for p in range(shape[0]):
            values = columns(block, p)
            at, _ = books.nearest(p, values)
            np.add.at(sums[p], at, values.T.astype(np.int64))
            np.add.at(counts[p], at, 1)
        return sums, counts

    def merge(a, b):
        if a is None or b is None:
            return a or b
        return a[0] + b[0], a[1] + b[1]

    rdd = blocks.select("size", "parts").rdd
    # With so many levels about FAN_IN tensors meet at each node, the driver's among them.
    depth = max(2, math.ceil(math.log(max(2, rdd.getNumPartitions()), FAN_IN)))
    sums, counts = rdd.treeAggregate(None, add, merge, depth)
    used = counts > 0
    out = books.entries.copy()
    out[used] = sums[used] // counts[used][:, None]
    return Codebooks(out)


def train(blocks: DataFrame, first: np.ndarray, rounds: int = ROUNDS) -> Codebooks:
    """Codebooks that start as the parts of some vectors (one a row of ``first``)."""
    books = Codebooks(np.ascontiguousarray(first.reshape(len(first), PARTS, -1).transpose(1, 0, 2)))
    for _ in range(rounds):
        books = improved(blocks, books)
    return books


def compress(vectors: DataFrame, scratch: Scratch, rounds: int = ROUNDS) -> tuple[DataFrame, Codebooks | None]:
    """(id, label, code, error) of the finite vectors among (id, label, vector), and the codebooks.

    Null vectors and those with null, NaN or infinite components are dropped. The dimension is the commonest multiple of 16
    among the others (the larger of equals); vectors of another one, or with a component whose integer is beyond LARGEST,
    can't be compared: they keep a row without code and error. The first codebooks are the vectors of the smallest ids;
    rows of one id go by their vectors, null ids come last. Rows that repeat are rows like others. Without any vector that
    can be compared there are no codebooks.
    """
    kept = vectors.filter(finite(F.col("vector")))
    size = F.size("vector")
    common = kept.filter(size % PARTS == 0).groupBy(size.alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    reach = F.lit(LARGEST / SCALE)
    fit = (size == F.lit(common.size if common else -1)) & ~F.exists("vector", lambda x: F.abs(x) >= reach)
    good = kept.filter(fit)
    first = good.orderBy(F.col("id").asc_nulls_last(), "vector").limit(ENTRIES).select("vector").collect()
    none = kept.filter(~fit).select("id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    if not first:
        return none, None
    blocks = scratch.table(to_blocks(good.select("id", "label", "vector")), "blocks")
    books = train(blocks, integers([r.vector for r in first]), rounds)

    def run(batches):
        for batch in batches:
            for block in batch.to_dict("records"):
                codes, errors = books.encode(block)
                yield pd.DataFrame({"id": pd.Series(list(block["ids"]), dtype=object), "label": pd.Series(list(block["labels"]), dtype=object), "code": [c.tobytes().hex() for c in codes], "error": errors})

    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema}
    coded = blocks.mapInPandas(run, f"id {kinds['id']}, label {kinds['label']}, code string, error long")
    return coded.unionByName(none), books


def code_vectors(table: DataFrame, scratch: Scratch) -> DataFrame:
    """Per finite vector of (vec_id, embedding, label): vec_id, code, error, label_error, codebooks_sha256.

    ``label_error`` is the sum of the errors of all rows of a label, null being one. What is dropped and what has no code is
    said in ``compress``; codebooks_sha256 is null if nothing can be compared. Other columns aren't read; an empty table
    gives an empty one.
    """
    coded, books = compress(table.select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("vector")), scratch)
    labelled = coded.select("id", "code", "error", F.col("label").isNull().alias("none"), F.coalesce(F.col("label"), F.lit(0)).alias("label"))
    rows = scratch.table(labelled, "codes")
    sums = scratch.table(rows.groupBy("none", "label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("rows")), "labels")
    found = joined_by_share(rows, sums, ["none", "label"], "rows")
    sha = F.lit(books.sha256() if books else None).cast("string")
    return scratch.last(found.select(F.col("id").alias("vec_id"), "code", "error", "label_error", sha.alias("codebooks_sha256")))
