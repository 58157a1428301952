"""Vector codes against plain Python integers."""

import hashlib
import math
import random

import pytest

pytest.importorskip("papyrine.llm.queries")

from papyrine.llm.common import Scratch  # noqa: E402
from papyrine.llm.vector_codes import code_vectors, compress  # noqa: E402

SCHEMA = "vec_id long, embedding array<float>, label int, code string, rows int"


def brute(rows, width):
    """rows: (id, vector, label); the contract, one number at a time."""
    kept = [(i, [math.floor(256 * x) for x in v], y) for i, v, y in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    cut = [[v[p * width : (p + 1) * width] for p in range(16)] for _, v, _ in kept]
    order = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, rows.index(rows[k]) * 0, kept[k][1]))[:64]
    books = [[list(cut[k][p]) for k in order] for p in range(16)]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(books[p]))

    for _ in range(2):
        new = []
        for p in range(16):
            at = [nearest(p, c[p])[1] for c in cut]
            new.append([[sum(c[p][d] for c, a in zip(cut, at) if a == k) // at.count(k) for d in range(width)] if k in at else e for k, e in enumerate(books[p])])
        books = new
    found = [[nearest(p, c[p]) for p in range(16)] for c in cut]
    errors = [sum(e for e, _ in f) for f in found]
    by_label = {}
    for (_, _, y), e in zip(kept, errors):
        by_label[y] = by_label.get(y, 0) + e
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [(i, "".join(f"{k:02x}" for _, k in f), e, by_label[y], sha) for (i, _, y), f, e in zip(kept, found, errors)]


def key(r):
    return tuple((x is None, x if x is not None else 0) for x in r)


def test_codes(spark):
    r = random.Random(2)
    rows = [(i * 3 % 301, [round(r.gauss(0, 1 + i % 3), 3) for _ in range(32)], [None, 0, 1, 2][i % 4]) for i in range(300)]
    rows = [(i, [float(__import__("numpy").float32(x)) for x in v], y) for i, v, y in rows]
    rows += [rows[5], (rows[6][0], rows[7][1], 9), (None, rows[8][1], 9), (900, None, 1), (901, [*rows[1][1][:31], None], 1), (902, [*rows[1][1][:31], math.nan], 1), (1, [-math.inf] * 32, 1)]
    # Clashing names aren't read.
    df = spark.createDataFrame([(*x, "c", 1) for x in rows], SCHEMA).repartition(5)
    got = code_vectors(df, Scratch(spark, "t"))
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(brute(rows, 2), key=key)


def test_few_and_odd_vectors(spark):
    def run(rows):
        return sorted(map(tuple, code_vectors(spark.createDataFrame([(*x, "c", 1) for x in rows], SCHEMA), Scratch(spark, "t")).collect()), key=key)

    assert run([]) == [] and run([(1, None, 1), (2, [None], 0)]) == []
    few = [(2, [0.5] * 16, None), (1, [-0.001] * 16, None), (1, [-0.001] * 16, 3)]
    assert run(few) == sorted(brute(few, 1), key=key)
    # Other dimensions, or components too large, are kept without a code.
    sha = brute(few, 1)[0][4]
    assert run([*few, (7, [1.0] * 17, 3), (8, [1.0] * 32, 5), (9, [3e38] * 16, None)]) == sorted([*brute(few, 1), (7, None, None, 0, sha), (8, None, None, None, sha), (9, None, None, 0, sha)], key=key)
    assert run([(1, [1.0] * 3, 1)]) == [(1, None, None, None, None)]
    assert [(c, e) for _, c, e, _, _ in run([(1, [], 1)])] == [("00" * 16, 0)]


def test_codes_stand_for_their_vectors(spark):
    df = spark.range(3000).selectExpr("id", "cast(id % 3 as int) label", "transform(sequence(0, 31), k -> cast(sin(id * (k + 1)) as float)) vector").repartition(7)
    coded, books = compress(df, Scratch(spark, "t"))
    assert books.entries.shape == (16, 64, 2)
    vectors = {x.id: x.vector for x in df.collect()}
    rows = coded.collect()
    assert len(rows) == 3000
    for x in rows[::100]:
        exact = [math.floor(256 * v) for v in vectors[x.id]]
        assert int(((books.decode(x.code) - exact) ** 2).sum()) == x.error
    assert sum(x.error for x in rows) < 0.2 * 3000 * 32 * 128**2
