"""Alignment of two tokenizers against two pointers in plain Python, and against the libraries."""

import hashlib
import random
from collections import Counter

import pytest

pytest.importorskip("papyrine.llm.queries")

from papyrine.llm.alignment import Aligner, align, align_tokenizers  # noqa: E402
from papyrine.llm.common import Scratch  # noqa: E402
from papyrine.llm.tokens import tokenizer_file  # noqa: E402

BITS = ["a", "the", " ", "  ", "   ", "\n", "\n\n", "\t", "é", "ﬁ", "Über", "</s>", "<|endoftext|>", "\x01", "\x00", "<0x41>", "日本", "😀", "word", ".", ", ", "▁", "\xa0", "\r", " of", " and"]


@pytest.fixture(scope="module")
def aligner():
    return Aligner(tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model"))


def brute(aligner, text):
    """Groups as (A ids, B ids): advance the side that is behind; where both stand at one byte a group ends."""
    if not text:
        return []
    a = aligner.a.model.encode(" " + text, add_special_tokens=False).ids
    b = aligner.b.model.encode(text)
    pieces = [aligner.bytes[0][i] for i in a], [aligner.bytes[1][i] for i in b]
    if any(b"".join(p) != (" " + text).encode() for p in pieces):
        return []
    out, i, j, at_a, at_b = [([], [])], 0, 0, 0, 0
    while i < len(a) or j < len(b):
        if at_a <= at_b and i < len(a):
            out[-1][0].append(a[i])
            at_a, i = at_a + len(pieces[0][i]), i + 1
        else:
            out[-1][1].append(b[j])
            at_b, j = at_b + len(pieces[1][j]), j + 1
        if at_a == at_b and j:
            out.append(([], []))
    return out[:-1]


def test_pieces_are_the_library_s(aligner):
    r = random.Random(4)
    texts = ["".join(r.choices(BITS, k=r.randrange(1, 25))) for _ in range(3000)] + [" ", "  ", "\n", " \n "]
    assert [x.tolist() for x in aligner.b.encode(texts)] == aligner.b.model.encode(texts)


def test_alignment(spark, aligner):
    r = random.Random(5)
    texts = ["".join(r.choices(BITS, k=r.randrange(1, 25))) for _ in range(400)] + [None, "", " ", "▁", "the", "the", "the " * 60_000]
    rows = [(None if i % 50 == 7 else i % 390, t, None, "x", 1) for i, t in enumerate(texts)]
    # Other columns may have any name, and repeated ids are rows of their own.
    docs = spark.createDataFrame(rows, "doc_id long, text string, block string, places string, n_a int").repartition(3)
    groups = [brute(aligner, t) for t in texts]
    count = Counter((a[-1], b[-1]) for g in groups for a, b in g)
    best = ({}, {})
    for pair, n in count.items():
        for side in (0, 1):
            best[side][pair[side]] = max(n, best[side].get(pair[side], 0))
    want = []
    for (i, *_), g in zip(rows, groups):
        links = [(a[-1], b[-1]) for a, b in g]
        said = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        want.append((-1 if i is None else i, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), len(links), sum(count[p] == best[1][p[1]] for p in links), sum(count[p] for p in links), hashlib.sha256(said.encode()).hexdigest() if g else "", sum(count[p] == best[0][p[0]] for p in links)))
    paths = tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model")
    got = align_tokenizers(docs, *paths, Scratch(spark, "t"))
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_best_a"]
    assert sorted((-1 if x.doc_id is None else x.doc_id, *x[1:]) for x in got.collect()) == sorted(want)
    assert sum(w[3] > 0 for w in want) > 200 and any(w[1] and w[3] < w[1] for w in want)
    assert align_tokenizers(docs.limit(0), *paths, Scratch(spark, "t")).count() == 0
    found = align(docs.filter("doc_id = 11"), *paths).orderBy("group").collect()
    assert [(x.a_ids, x.b_ids) for x in found] == groups[11] and found[0].start == 0 and found[-1].end == len((" " + texts[11]).encode())
