"""The pipeline against brute force: each stage on its own input, then run() as a whole."""

import re
import zlib

import pytest

pytest.importorskip("papyrine.llm.queries")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

from papyrine.llm import toxicity  # noqa: E402
from papyrine.llm.common import LOWER, UPPER, table  # noqa: E402
from papyrine.llm.tokens import Encoder, tokenizer_file  # noqa: E402

SF = "/root/testdata/sf0.001"
FOLD = str.maketrans(UPPER, LOWER)


def rejected(texts, labels):
    rows = [(texts[i], y) for i, y in labels if i in texts and zlib.crc32(str(i).encode()) % 3 != 1]
    model = toxicity.fit(sorted(rows))
    return {i for i, t in texts.items() if model.score([t])[0] >= toxicity.THRESHOLD}


def exact(texts):
    keep = {}
    for i, t in texts.items():
        keep[t.translate(FOLD)] = max(i, keep.get(t.translate(FOLD), i))
    return set(keep.values())


def near(texts):
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", t.translate(FOLD))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            n = len(sets[a] & sets[b])
            if a < b and n and 100 * n >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i for i in sets if find(i) == i}


def clean(texts, items):
    def cut(s):
        return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (s or "").translate(FOLD)) if w]

    wins = {tuple(w[k : k + 10]) for w in map(cut, items) if w for k in range(max(1, len(w) - 9))}
    sizes = {len(w) for w in wins}
    out = set()
    for i, t in texts.items():
        w = cut(t)
        if not any(tuple(w[k : k + n]) in wins for n in sizes for k in range(len(w) - n + 1)):
            out.add(i)
    return out


def test_pipeline(spark):
    docs = table(spark, SF, "documents")
    texts = {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}
    labels = [(r.doc_id, r.toxic) for r in table(spark, SF, "labels").collect()]
    items = [r.text for r in table(spark, SF, "benchmark").select("text").collect()]
    brute = [lambda t: set(t) - rejected(t, labels), exact, near, lambda t: clean(t, items)]
    kept, at = texts, docs
    for (name, stage), want in zip(corpus_pipeline.STAGES, brute, strict=False):
        at = stage(spark, at, SF)
        assert at.columns == docs.columns, name
        got = {r.doc_id for r in at.select("doc_id").collect()}
        if name == "toxicity":  # the sample's order doesn't change the fit beyond rounding
            assert len(got ^ want(kept)) <= 1
        else:
            assert got == want(kept), name
        kept = {i: kept[i] for i in got}
    model = Encoder(tokenizer_file("word_bpe_49k.json")).model
    rows = corpus_pipeline.run(spark, SF).toPandas()
    assert rows.groupby("doc_id").length.sum().to_dict() == {i: len(model.encode(t, add_special_tokens=False).ids) + 1 for i, t in kept.items()}


CLASH = "doc_id long, text string, lang string, source string, n_chars long, __gone string, key string, label string, component string, score string, ids string, window string, at string, hits string, kept string"


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Nulls in every column, empty and very long texts, ties, repeated rows, clashing names; and tables beside them."""
    long = " ".join(f"w{i % 9973}x{i // 9973}" for i in range(120_000))
    item = "one two three four five six seven eight nine ten eleven"
    rows = [(1, None), (2, ""), (3, " \t "), (None, "lone text without an id at all"), (None, "no id either and one two three four five six seven eight nine ten"), (4, long), (5, long.upper()), (6, f"{long} more"), (7, "same short text"), (7, "same short text"), (8, item + " and then more words"), (9, "a b c"), (10, "Same short text"), (None, None)]
    at = str(tmp_path_factory.mktemp("odd"))
    full = [(i, t, None, None, None, *(["x", None, "y", "z", "s", "i", "w", "a", "h", "k"])) for i, t in rows]
    spark.createDataFrame(full, CLASH).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None), (None, "zz"), (1, item)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame([(1, 0, None), (9, 1, 0), (None, 0, 1), (9, 1, 0), (7, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    vectors = [(1, [0.5] * 32, 1, "x"), (1, [0.5] * 32, 1, "x"), (None, [-0.25] * 32, None, None), (2, None, 1, None), (3, [1.0, None] * 16, None, None), (4, [float("nan")] * 32, 2, None), (5, [], None, None), (6, [1.0] * 3, 2, None), (7, [1e30] * 32, 1, None), (None, None, None, None)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int, code string").write.parquet(f"{at}/embeddings.parquet")
    said = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, None, None), (None, 1, "assistant", "b"), (None, 0, "user", long), (2, 0, "assistant", ""), (3, 5, "", "[INST]"), (-7, 2, "user", "more"), (4, 0, None, None)]
    spark.createDataFrame([(*x, "p", 1) for x in said], "conv_id long, turn long, role string, text string, piece string, n_turns int").write.parquet(f"{at}/conversations.parquet")
    none = str(tmp_path_factory.mktemp("none"))
    for t in ("documents", "benchmark", "labels", "embeddings", "conversations"):
        spark.read.parquet(f"{at}/{t}.parquet").limit(0).write.parquet(f"{none}/{t}.parquet")
    return at, none, rows


def test_stages_on_odd_rows(spark, odd):
    at, none, rows = odd
    docs = table(spark, at, "documents")
    want = {
        "toxicity": sorted((i or -1) for i, _ in rows),
        # Of equal texts the largest id: 4/5 and 7/7/10 have equal texts, 1, 2 and the second null id are empty.
        "exact dedup": sorted([2, 3, -1, -1, 5, 6, 8, 9, 10]),
        "MinHash near-dedup": sorted([1, 2, 3, -1, -1, -1, 4, 7, 7, 8, 9]),
        "benchmark decontamination": sorted((i or -1) for i, t in rows if "one two" not in (t or "")),
    }
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, at)
        assert got.columns == docs.columns
        assert sorted((r.doc_id or -1) for r in got.select("doc_id").collect()) == want[name], name
        assert stage(spark, table(spark, none, "documents"), none).count() == 0
    name, stage = corpus_pipeline.STAGES[-1]
    pieces = stage(spark, docs, at).toPandas()
    model = Encoder(tokenizer_file("word_bpe_49k.json")).model
    assert pieces.length.sum() == sum(len(model.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in rows)
    assert corpus_pipeline.run(spark, none).count() == 0


def test_queries_on_odd_rows(spark, odd):
    from papyrine.llm import queries

    at, none, rows = odd
    for name, query in queries.queries().items():
        got = query(spark, at).toPandas()
        if name == "op6_packing":
            assert set(got.doc_id.dropna().astype(int)) == {i for i, _ in rows if i is not None}
        elif name == "op12_vector_codes":
            # Null vectors and those with null or NaN components go; others keep a row, without a code where they can't be compared.
            assert sorted((int(i) if i == i and i is not None else -1, c is not None) for i, c in zip(got.vec_id.astype(object), got.code)) == [(-1, True), (1, True), (1, True), (5, False), (6, False), (7, False)]
        elif name == "op13_chat_format":
            assert sorted((int(i) if i == i and i is not None else -1, int(n)) for i, n in zip(got.conv_id.astype(object), got.n_turns)) == [(-7, 3), (-1, 2), (1, 3), (2, 1), (3, 1), (4, 1)]
        else:
            assert sorted(got.doc_id.fillna(-1).astype(int)) == sorted((i or -1) for i, _ in rows), name
        assert query(spark, none).count() == (name == "op13_chat_format"), name  # its own conversation is always there
    got = {r.doc_id: r for r in queries.op1_substring_dedup(spark, at).collect()}
    assert got[5].n_removed == 0 and got[6].n_removed > 600_000 and got[4].n_removed == 0
    got = {r.doc_id: r for r in queries.op10_exact_dedup(spark, at).collect()}
    assert got[4].keep_id == 5 and got[7].keep_id == 10 and got[7].group_size == 3
    # Rows of one id and text, and those of one id and different texts, have their own values.
    model = Encoder(tokenizer_file("byte_bpe_50k.json")).model
    sizes = sorted((-1 if i is None else i, len(model.encode(t or "", add_special_tokens=False).ids) + 1) for i, t in rows)
    assert sorted((-1 if x.doc_id is None else x.doc_id, x.n_tokens) for x in queries.op2_token_records(spark, at).collect()) == sizes
    tokens = sorted((-1 if x.doc_id is None else x.doc_id, x.n_a > 0, x.groups_sha256 != "") for x in queries.op11_tokenizer_alignment(spark, at).collect())
    assert tokens == sorted((-1 if i is None else i, bool(t), bool(t)) for i, t in rows)
    assert all(x.n_licenses == 0 for x in queries.op3_license_scan(spark, at).collect()) and all(x.spans == "" for x in queries.op8_secrets(spark, at).collect())
    near = {(x.doc_id, x.component_id) for x in queries.op4_near_dedup(spark, at).collect()}
    assert {(4, 4), (5, 4), (6, 4), (7, 7), (10, 7), (1, 1), (2, 2), (None, None)} <= near
