"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on windows of ordinary text, one on what toxic text says and ordinary text
hardly does: the runs of words that far more toxic texts hold. Every window of a text is compressed with the ordinary
dictionary and with that of toxic text; a window that gets shorter with the latter shares content with toxic text. The
largest differences of a text, and how many windows pass two thresholds taken from ordinary windows, are its features,
and a logistic curve fitted on the training rows turns them into a score.

Toxic text is ordinary text with something in it, so its compressor has the ordinary dictionary behind its own: alone,
the two differ by chance in the ordinary words that they hold, and these differences drown the others.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrine.llm.common import LOWER, UPPER, id_crc

#: Bounds of the training sample: texts of each class, bytes of a text that may be in it, windows that train a dictionary.
SAMPLE_TOXIC, SAMPLE_ORDINARY, SAMPLE_BYTES, SAMPLE_WINDOWS = 1500, 3000, 32_768, 60_000
#: Bytes of each trained dictionary, words in a window, compression level, the trainer's segment and its match length.
#: They were chosen by recall and log loss on one half of the training rows of sf0.1, fitted on the other half.
TOXIC_BYTES, ORDINARY_BYTES, WINDOW, LEVEL, SEGMENT, MATCH = 1024, 8192, 8, 6, 16, 6
#: A word is of toxic text if the likelihood ratio of how many texts of both classes hold it is this many deviations.
DEVIATIONS, LEAST = 6.0, 3
#: Shares of ordinary windows below the two thresholds of a window's difference.
QUANTILES = (0.99, 0.999)
#: Documents at or above this score are rejected.
THRESHOLD = 0.7

_FOLD = bytes.maketrans(UPPER.encode(), LOWER.encode())
_EDGES = b".,;:!?\"'()[]{}*%&#$_-"


def words_of(text: str) -> list[bytes]:
    """Lower-cased words between ASCII white space, as UTF-8 without marks at their edges; what is marks alone goes."""
    return [w for w in (w.strip(_EDGES) for w in text.encode("utf-8", "surrogatepass").translate(_FOLD).split()) if w]


def windows_of(text: str) -> list[bytes]:
    w = words_of(text)
    return [b" " + b" ".join(w[a : a + WINDOW]) + b" " for a in range(0, len(w), WINDOW)]


def _marked(bad: list[str], good: list[str]) -> set[bytes]:
    """Words that more toxic texts hold than chance explains."""
    a = Counter(w for t in bad for w in set(words_of(t)))
    b = Counter(w for t in good for w in set(words_of(t)))
    na, nb = len(bad), len(good)

    def part(n: int, size: int, share: float) -> float:
        out = n * np.log(n / (size * share)) if n else 0.0
        return out + ((size - n) * np.log((size - n) / (size * (1 - share))) if n < size else 0.0)

    out = set()
    for w, n in a.items():
        m, share = b[w], (n + b[w]) / (na + nb)
        if n >= LEAST and n * nb > m * na and 2 * (part(n, na, share) + part(m, nb, share)) > DEVIATIONS**2:
            out.add(w)
    return out


def _trained(samples: list[bytes], size: int) -> bytes:
    """A dictionary trained on samples; where these are too few or small for the trainer, they are its content."""
    import zstandard as Z

    if not samples:
        return b""
    copies = -(-400 // len(samples))  # the trainer wants some hundred samples
    try:
        return Z.train_dictionary(size, samples * copies, k=SEGMENT, d=MATCH, f=20, split_point=1.0, accel=1, level=LEVEL).as_bytes()
    except Z.ZstdError:
        return b"".join(samples)[-size:]


@dataclass(frozen=True)
class Model:
    """What workers need: two trained dictionaries, the thresholds and the calibration."""

    toxic: bytes
    ordinary: bytes
    thresholds: tuple[float, ...]
    weights: tuple[float, ...]

    def score(self, texts: list[str]) -> np.ndarray:
        z = features(self, texts) @ np.array(self.weights[1:]) + self.weights[0]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@lru_cache(maxsize=2)
def _compressors(toxic: bytes, ordinary: bytes):
    import zstandard as Z

    made, both = [], b" " + toxic + b" " + ordinary + b" "
    for content in (both, b" " + ordinary + b" "):
        shape = Z.ZstdCompressionParameters.from_level(LEVEL, source_size=8 * WINDOW, dict_size=len(both), min_match=4, write_content_size=False, write_checksum=False, write_dict_id=False)
        made.append(Z.ZstdCompressor(compression_params=shape, dict_data=Z.ZstdCompressionDict(content, dict_type=Z.DICT_TYPE_RAWCONTENT)))
    return made


def differences(model: Model, text: str) -> list[int]:
    """By how many bytes each window is shorter with the dictionary of toxic text."""
    with_toxic, without = _compressors(model.toxic, model.ordinary)
    return [len(without.compress(w)) - len(with_toxic.compress(w)) for w in windows_of(text)]


def features(model: Model, texts: list[str]) -> np.ndarray:
    """Of each text: its two largest differences, the logs of how many pass each threshold, and of its windows' number."""
    low, high = model.thresholds
    out = np.zeros((len(texts), 5))
    for i, text in enumerate(texts):
        gain = differences(model, text)
        top = sorted([0, 0, *gain])
        out[i] = top[-1], top[-2], np.log1p(sum(g > low for g in gain)), np.log1p(sum(g > high for g in gain)), np.log1p(len(gain))
    return out


def fit(rows: list[tuple[str, int]]) -> Model:
    """Trains both dictionaries and the curve on (text, toxic) rows; their order doesn't matter. Without rows of both
    classes every score is the share of toxic rows (0 without any)."""
    bad, good = (sorted({t for t, y in rows if bool(y) == want}) for want in (True, False))
    if not bad or not good:
        share = (len(bad) + 1e-9) / (len(bad) + len(good) + 2e-9) if rows else 0.0
        return Model(b"", b"", (0.0, 0.0), (float(np.log(max(share, 1e-9) / max(1 - share, 1e-9))), 0.0, 0.0, 0.0, 0.0, 0.0))
    marks = _marked(bad, good)
    said = [b" " + b"  ".join(w for w in words_of(t) if w in marks) + b" " for t in bad]
    plain = [w for t in good for w in windows_of(t)]
    if len(plain) > SAMPLE_WINDOWS:
        plain = [plain[i] for i in np.random.default_rng(0).choice(len(plain), SAMPLE_WINDOWS, False)]
    model = Model(_trained([s for s in said if len(s) > 2], TOXIC_BYTES), _trained(plain, ORDINARY_BYTES), (0.0, 0.0), ())
    usual = np.concatenate([np.array(differences(model, t)) for t in good])
    if len(usual):
        model = Model(model.toxic, model.ordinary, tuple(float(np.quantile(usual, q)) for q in QUANTILES), ())
    x = features(model, bad + good)
    y = np.array([1.0] * len(bad) + [0.0] * len(good))
    x1 = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x1.shape[1])
    for _ in range(60):  # Newton's method with a light ridge
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        h = x1.T @ (x1 * (p * (1 - p))[:, None]) + 0.01 * np.eye(len(w))
        w -= np.linalg.solve(h, x1.T @ (p - y) + 0.01 * w)
    return Model(model.toxic, model.ordinary, model.thresholds, tuple(float(v) for v in w))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fits on a bounded sample of labelled documents with crc32(doc_id as text) mod 3 != 1, chosen by a hash of ids.

    The ids are chosen first, among labels that have a document; only the texts of those travel. Null labels and ids
    aren't used; where an id has several labels the highest counts, where it has several texts the smallest. Reads
    nothing but text and ``toxic``. Empty tables give a model whose scores are all 0.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("y")).filter("y is not null and id is not null")
    known = known.filter(id_crc(F.col("id")) % 3 != 1).groupBy("id").agg((F.max("y") != 0).alias("y"))
    known = known.join(docs.select(F.col("doc_id").cast("long").alias("id")), "id", "left_semi")
    picked = None
    for y, n in ((True, SAMPLE_TOXIC), (False, SAMPLE_ORDINARY)):
        part = known.filter(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(n)
        picked = picked.unionAll(part) if picked is not None else part
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(picked), "id").filter(F.octet_length("text") <= SAMPLE_BYTES)
    return fit([(r.text, int(r.y)) for r in rows.groupBy("id").agg(F.min("text").alias("text"), F.max("y").alias("y")).collect()])


def toxic_score(model: Model, text: Column) -> Column:
    """The score of a text column; null text is empty text."""

    @F.pandas_udf("double")
    def scores(part: pd.Series) -> pd.Series:
        return pd.Series(model.score(part.to_list()))

    return scores(F.coalesce(text.cast("string"), F.lit("")))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``; null text is empty text. Rows that repeat an id are
    scored each, a null id stays null, an empty table gives no rows; other columns are ignored."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), toxic_score(model, F.col("text")).alias("score"))
    return rows.select(
        "doc_id",
        (id_crc(F.col("doc_id")) % 3 == 1).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def drop_toxic(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows that are rejected, each by its own text; columns as they are, null ids too. Nothing is
    shuffled."""
    return docs.filter(toxic_score(train(docs, labels), docs["text"]) < THRESHOLD)
