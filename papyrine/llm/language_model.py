"""Language-model scoring with an Elias-Fano n-gram trie of three levels.

Level one holds the words (64-bit hashes) with their counts and the weight that each, as a context, leaves to the level
below. Levels two and three are cut into shards by a trigram's first word and SALTS classes of its second, so a shard
has whole pairs and all that follows them: for each word its successors, for each pair its successors in turn, with
quantised smoothed probabilities. Monotone pointers say where the successors of a context begin and end; a search goes
from the word to its successors' range and from the pair to its own, and looks for the next word in that range alone.
Word ids are ranks in the shard's own list of words, and ids, made rising by the context's rank, pointers and words
are Elias-Fano coded. Shards are files of flat arrays in the shared folder, memory-mapped where they are read.

The model never travels: a scoring task sends the different trigrams of some million tokens to their shards, one task
opens each shard and answers, and the answers go back to where the documents' tokens are. No pair or trigram is dropped.
Shards are counted in TURNS and documents scored in ROUNDS, whose shuffle files go as each one ends. Trigrams travel as numbers: of a frequent word its
place in a bounded list that all tasks have, of others a place in the row's own list of hashes.

Probability of w after u v: P3(w | u v) + weight(u v) * (count(v w) / c(v) + weight(v) * (c(w) + 1) / (N + V + 1)),
with counts less a discount, quantised and rounded down, and weights taken from the quantised ones; weights are rounded
down to one in 65535, so the probabilities of all known words and one unknown sum to one but for that rounding.
"""

from __future__ import annotations

import json
import os
import uuid
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyrine.llm.common import id_crc
from papyrine.llm.elias_fano import EliasFano
from papyrine.llm.records import _open
from papyrine.llm.shingles import mix, word_hashes

#: Discount of a count, classes of second words over which a first word is spread.
DISCOUNT, SALTS = 0.75, 16
#: Bytes of training text behind one shard, and tokens that a task gathers before it hands them on.
SHARD_BYTES, FLUSH = 16 << 20, 1_000_000
#: Frequent words that travel as short numbers at most, bytes of text in which they are looked for.
FREQUENT, LOOKED_AT = 60_000, 8 << 20
#: Turns in which shards are counted, rounds in which documents are scored.
TURNS, ROUNDS = 2, 4
#: Hashes of the end, of what stands before the first word and of what follows the end.
END, BEGIN, STOP = np.uint64(0x5BD1E995A5A5A5A5), np.uint64(0x27D4EB2F165667C5), np.uint64(0x165667B19E3779F9)
#: Steps of a quantised number for each doubling, steps of a weight.
FINE, WEIGHTS = 8, 65535
#: Levels of rows that travel: documents' tokens, words, trigrams.
HOME, WORDS, GRAMS = 0, 1, 2
_ROW = "level int, shard long, chunk long, blob binary"


def quantise(count: np.ndarray) -> np.ndarray:
    """Code of a discounted count, rounded down; 1 stands for the discounted count of one, 0 for none."""
    return (1 + np.floor(FINE * np.log2(count - DISCOUNT + 1e-12) + 1e-9).astype(np.int64).clip(0, 254)).astype(np.uint8)


def value(code: np.ndarray) -> np.ndarray:
    return np.where(code <= 1, code * (1 - DISCOUNT), np.exp2((code.astype(np.float64) - 1) / FINE))


def quantise_share(share: np.ndarray) -> np.ndarray:
    """Code of a probability, rounded down; 255 stands for none, as for what is below its range."""
    return np.ceil(-FINE * np.log2(share) - 1e-9).clip(0, 255).astype(np.uint8)


def share(code: np.ndarray) -> np.ndarray:
    return np.where(code == 255, 0.0, np.exp2(-code.astype(np.float64) / FINE))


def _routes(h: np.ndarray) -> np.ndarray:
    """What of a word decides a shard: 28 bits as a first word, the class as a second."""
    return ((mix(h) >> np.uint64(36)) << np.uint64(4) | (h % np.uint64(SALTS))).astype(np.uint32)


def _gram_shard(first: np.ndarray, second: np.ndarray, bits: int) -> np.ndarray:
    spread = (first >> np.uint32(4)).astype(np.int64) + (second & np.uint32(SALTS - 1)).astype(np.int64) * 0x9E3779B
    return spread & ((1 << bits) - 1)


def _word_shard(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def _squeeze(*arrays: np.ndarray) -> bytes:
    """Arrays of numbers as one compressed blob, each in the least width, whole numbers as all lowest bytes, all next ones, ..."""
    import zstandard as Z

    kinds, parts = [], []
    for x in arrays:
        if x.dtype.kind in "iu" and x.dtype != np.uint64:
            most = int(x.max(initial=0))
            x = x.astype("<u1" if most < 1 << 8 else "<u2" if most < 1 << 16 else "<u4" if most < 1 << 32 else "<u8")
        kinds.append((x.dtype.str, len(x)))
        parts.append(x.tobytes() if x.dtype.kind == "f" else np.ascontiguousarray(x.view("u1").reshape(len(x), x.itemsize).T).tobytes())
    return Z.ZstdCompressor(level=1).compress(json.dumps(kinds).encode() + b"\n" + b"".join(parts))


def _unsqueeze(blob: bytes) -> list[np.ndarray]:
    import zstandard as Z

    data = Z.ZstdDecompressor().decompress(blob)
    at = data.index(b"\n") + 1
    out = []
    for kind, n in json.loads(data[: at - 1]):
        width = np.dtype(kind).itemsize
        x = np.frombuffer(data, "u1", n * width, at)
        out.append((x if np.dtype(kind).kind == "f" else np.ascontiguousarray(x.reshape(width, n).T).ravel()).view(kind))
        at += n * width
    return out


def tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens of all texts, an END after each text's words, and tokens of each text."""
    words, counts = word_hashes([t.encode("utf-8", "surrogatepass") for t in texts])
    out = np.full(len(words) + len(texts), END)
    ends = np.cumsum(counts + 1) - 1
    inner = np.ones(len(out), bool)
    inner[ends] = False
    out[inner] = words
    return out, counts + 1


def _chunks(texts: list[str], size: int):
    """Runs of texts of about ``size`` characters."""
    part: list[str] = []
    used = 0
    for t in texts:
        if part and used + len(t) > size:
            yield part
            part, used = [], 0
        part.append(t)
        used += len(t)
    if part:
        yield part


def trigrams(place: np.ndarray, counts: np.ndarray, begin: int, stop: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The three places of each trigram of documents whose tokens are ``place``.

    A document's sequence is BEGIN, BEGIN, its tokens and STOP: it has one trigram more than tokens, so the pair of its
    last word and END begins one too.
    """
    n = len(place) + 3 * len(counts)
    heads = np.cumsum(counts + 3) - counts - 3
    seq = np.full(n, begin, np.int64)
    inner = np.ones(n, bool)
    inner[heads] = inner[heads + 1] = inner[heads + counts + 2] = False
    seq[inner] = place
    seq[heads + counts + 2] = stop
    keep = np.ones(n, bool)
    keep[heads + counts + 1] = keep[heads + counts + 2] = False
    at = np.flatnonzero(keep)
    return seq[at], seq[at + 1], seq[at + 2]


def _distinct(i1, i2, i3, size: int, **also):
    """Different trigrams of places below ``size`` in rising order, and what np.unique is asked for beside them."""
    width = max(1, size.bit_length())
    if 3 * width < 64:
        key, *rest = np.unique((i1 << 2 * width) | (i2 << width) | i3, **also)
        mask = (1 << width) - 1
        return key >> 2 * width, (key >> width) & mask, key & mask, *rest
    pair, of = np.unique((i1 << 31) | i2, return_inverse=True)
    key, *rest = np.unique((of.astype(np.int64) << 31) | i3, **also)
    mask = (1 << 31) - 1
    return pair[key >> 31] >> 31, pair[key >> 31] & mask, key & mask, *rest


def _bounds(shard: np.ndarray):
    first = np.flatnonzero(np.diff(shard, prepend=-1))
    return zip(shard[first].tolist(), first.tolist(), np.append(first[1:], len(shard))[: len(first)].tolist(), strict=True)


def _numbers(words: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """The place of each word in ``frequent``, -1 where it isn't there."""
    if not len(frequent):
        return np.full(len(words), -1, np.int64)
    order = np.argsort(frequent)
    at = order[np.searchsorted(frequent, words, sorter=order).clip(max=len(frequent) - 1)]
    return np.where(frequent[at] == words, at, -1)


def _pack(grams: list[np.ndarray], words: np.ndarray, numbers: np.ndarray, known: int) -> bytes:
    """Trigrams, and their counts if there are any, as numbers of their words: below ``known`` those of frequent words, from
    there on places in the list of the others' hashes."""
    i = np.concatenate(grams[:3])
    at = numbers[i]
    other, back = np.unique(i[at < 0], return_inverse=True)
    at[at < 0] = known + back
    return _squeeze(words[other], *at.reshape(3, -1), *grams[3:])


def _rows(bits: int, scoring: bool, frequent: np.ndarray, turn: int = 0):
    """What a task sends: look-ups of words and trigrams and the documents' tokens, or counts of the trigrams whose shards
    have their ``turn``, with the first one counts of words too."""

    def flush(held, ids, chunk):
        token = np.concatenate([h[0] for h in held])
        counts = np.concatenate([h[1] for h in held])
        words, place, n = np.unique(np.concatenate([token, [BEGIN, STOP]]), return_inverse=True, return_counts=True)
        begin, stop = int(place[-2]), int(place[-1])
        place = place[:-2]
        n[begin] += len(counts) - 1  # how often nothing stands before: the count of the first context
        n[stop] -= 1
        routes = _routes(words)
        grams = trigrams(place, counts, begin, stop)
        if not scoring:
            mine = _gram_shard(routes[grams[0]], routes[grams[1]], bits) % TURNS == turn
            grams = [x[mine] for x in grams]
        grams = list(_distinct(*grams, len(words), return_counts=True))[: 3 if scoring else 4]
        shard = _gram_shard(routes[grams[0]], routes[grams[1]], bits)
        order = np.argsort(shard, kind="stable")
        grams, shard = [x[order] for x in grams], shard[order]
        out = []
        for s, a, b in _bounds(_word_shard(words, bits)) if scoring or not turn else ():
            out.append((WORDS, s, chunk, _squeeze(words[a:b]) if scoring else _squeeze(words[a:b], n[a:b])))
        numbers = _numbers(words, frequent)
        for s, a, b in _bounds(shard):
            out.append((GRAMS, s, chunk, _pack([x[a:b] for x in grams], words, numbers, len(frequent))))
        if scoring:
            null = np.array([i is None for i in ids])
            doc = np.array([0 if i is None else i for i in ids], np.int64).view(np.uint64)
            out.append((HOME, chunk, chunk, _squeeze(doc, null.astype(np.uint8), counts, place, routes.astype(np.uint32), np.array([begin, stop]))))
        return pd.DataFrame(out, columns=["level", "shard", "chunk", "blob"]).astype({"level": "int32"})

    def run(batches):
        chunk, held, ids, size = TaskContext.get().partitionId() << 32, [], [], 0
        for batch in batches:
            at = 0
            for part in _chunks(batch["text"].to_list(), 1 << 18):
                held.append(tokens(part))
                ids += [None if pd.isna(i) else int(i) for i in batch["doc_id"].iloc[at : at + len(part)]]
                at += len(part)
                size += len(held[-1][0])
                if size >= FLUSH:
                    yield flush(held, ids, chunk)
                    chunk, held, ids, size = chunk + 1, [], [], 0
        if held:
            yield flush(held, ids, chunk)

    return run


def _save(path: str, name: str, meta: dict, arrays: list[np.ndarray]) -> None:
    """One file: a line of JSON, padded, then the arrays; written aside and renamed."""
    store, at = _open(path)
    store.create_dir(at, recursive=True)
    sizes = [(x.dtype.str, len(x)) for x in arrays]
    head = json.dumps(meta | {"arrays": sizes}).encode()
    head += b" " * (-(len(head) + 1) % 64) + b"\n"
    own = f"{at}/.{name}-{os.getpid()}-{np.random.default_rng().integers(1 << 62)}"
    with store.open_output_stream(own) as f:
        f.write(head)
        for x in arrays:
            data = x.tobytes()
            f.write(data + bytes(-len(data) % 64))
    store.move(own, f"{at}/{name}")


def _load(path: str, name: str) -> tuple[list[EliasFano], list[np.ndarray]] | None:
    """Maps a shard of a local or mounted folder into memory; reads it from other stores. None where there is none."""
    from pyarrow import fs

    store, at = _open(path)
    local = f"{at}/{name}"
    if store.get_file_info(local).type == fs.FileType.NotFound:
        return None
    if os.path.exists(local):
        data = np.memmap(local, np.uint8, "r").view(np.ndarray)
    else:
        with store.open_input_file(local) as f:
            data = np.frombuffer(f.read(), np.uint8)
    end = 64
    while data[end - 1] != 10:
        end += 64
    meta, arrays = json.loads(data[:end].tobytes()), []
    for kind, n in meta["arrays"]:
        size = np.dtype(kind).itemsize * n
        arrays.append(data[end : end + size].view(kind))
        end += size + (-size % 64)
    f = len(EliasFano.FIELDS)
    coded = [EliasFano(n, low, *arrays[f * i : f * i + f]) for i, (n, low) in enumerate(meta["ef"])]
    return coded, arrays[f * len(coded) :]


def _coded(path: str, name: str, coded: list[EliasFano], rest: list[np.ndarray]) -> None:
    _save(path, name, {"ef": [(e.n, e.low) for e in coded]}, [*(getattr(e, f) for e in coded for f in EliasFano.FIELDS), *rest])


def _spans(rank: np.ndarray, n: int) -> np.ndarray:
    """Where each of n contexts' successors begin, and where the last ones end; ``rank`` rises."""
    return np.searchsorted(rank, np.arange(n + 1))


def _build(path: str, bits: int, frequent: np.ndarray):
    """Writes a shard of levels two and three, or adds up a shard of words; returns blobs for the shards of level one:
    words with counts, and what its pairs take from each context."""

    def grams(shard: int, blobs) -> list[tuple]:
        parts = [_unsqueeze(b) for b in blobs]
        used = np.zeros(len(frequent), bool)
        for p in parts:
            for x in p[1:4]:
                used[x[x < len(frequent)]] = True
        words = np.unique(np.concatenate([frequent[used], *(p[0] for p in parts)]))
        usual = np.searchsorted(words, frequent)
        maps = [np.concatenate([usual, np.searchsorted(words, p[0])]) for p in parts]
        i1, i2, i3 = (np.concatenate([m[p[k]] for m, p in zip(maps, parts, strict=True)]) for k in (1, 2, 3))
        n = np.concatenate([p[4] for p in parts]).astype(np.int64)
        del parts, maps
        pair, of = np.unique((i1.astype(np.uint64) << np.uint64(32)) | i2.astype(np.uint64), return_inverse=True)
        total = np.bincount(of, n, len(pair)).astype(np.int64)
        stop, begin = (int(np.searchsorted(words, h)) if (words == h).any() else -1 for h in (STOP, BEGIN))
        # Level three: different trigrams with their counts, those after the end left out.
        on = i3 != stop
        key = (of[on].astype(np.uint64) << np.uint64(32)) | i3[on].astype(np.uint64)
        gram, back = np.unique(key, return_inverse=True)
        m = np.bincount(back, n[on], len(gram)).astype(np.int64)
        up, last = (gram >> np.uint64(32)).astype(np.int64), gram & np.uint64(0xFFFFFFFF)
        code3 = quantise_share((m - DISCOUNT) / total[up]) if len(gram) else np.zeros(0, np.uint8)
        left = 1 - np.bincount(up, share(code3), len(pair))
        weight = np.floor(WEIGHTS * left).clip(1, WEIGHTS).astype("<u2")
        # Level two: pairs under their first word.
        first, second = (pair >> np.uint64(32)).astype(np.int64), pair & np.uint64(0xFFFFFFFF)
        context, rank = np.unique(first, return_inverse=True)
        code2 = quantise(total)
        code2[second.astype(np.int64) == begin] = 0  # nothing is followed by the mark before the first word
        v = max(1, len(words))
        coded = [
            EliasFano.of(words, 1 << 64),
            EliasFano.of(context, v),
            EliasFano.of(_spans(rank, len(context)), len(pair) + 1),
            EliasFano.of(rank.astype(np.uint64) * np.uint64(v) + second, len(context) * v),
            EliasFano.of(_spans(up, len(pair)), len(gram) + 1),
            EliasFano.of(up.astype(np.uint64) * np.uint64(v) + last, len(pair) * v),
        ]
        _coded(path, f"two-{shard}", coded, [code2, weight, code3])
        took, h = np.bincount(rank, value(code2), len(context)), words[context]
        order = np.argsort(h)
        h, took = h[order], took[order]
        return [(GRAMS, s, 0, _squeeze(h[a:b], took[a:b])) for s, a, b in _bounds(_word_shard(h, bits))]

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        level, shard = int(key[0]), int(key[1])
        if level == GRAMS:
            out = grams(shard, group["blob"])
        else:
            parts = [_unsqueeze(b) for b in group["blob"]]
            word, place = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            count = np.bincount(place, np.concatenate([p[1] for p in parts]).astype(np.int64), len(word)).astype(np.int64)
            out = [(WORDS, shard, 0, _squeeze(word, count))]
        return pd.DataFrame(out, columns=["level", "shard", "chunk", "blob"]).astype({"level": "int32"})

    return run


def _words(path: str):
    """Writes a shard of level one; returns its words and tokens."""

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        word, count = next(_unsqueeze(b) for n, b in zip(group["level"], group["blob"], strict=True) if n == WORDS)
        count = count.astype(np.int64)
        real = (word != BEGIN) & (word != STOP)
        left = count.astype(np.float64)
        for n, b in zip(group["level"], group["blob"], strict=True):
            if n == GRAMS:
                h, took = _unsqueeze(b)
                left[np.searchsorted(word, h)] -= took
        weight = np.floor(WEIGHTS * (left / np.maximum(count, 1))).clip(1, WEIGHTS).astype("<u2")
        weight[word == END] = WEIGHTS
        _coded(path, f"one-{key[0]}", [EliasFano.of(word, 1 << 64)], [count.astype("<u8"), weight])
        return pd.DataFrame({"words": [int((real & (count > 0)).sum())], "tokens": [int(count[real].sum())]})

    return run


def _among(listed: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The place of each of ``h`` in the sorted ``listed``, -1 where it isn't."""
    if not len(listed):
        return np.full(len(h), -1, np.int64)
    at = np.searchsorted(listed, h).clip(max=len(listed) - 1)
    return np.where(listed[at] == h, at, -1)


class Trie:
    """A written model: where it is, shard bits, known words V, training tokens N, and words that travel as numbers."""

    def __init__(self, path: str, bits: int, known: int, total: int, frequent: np.ndarray):
        self.path, self.bits, self.known, self.total, self.frequent = path, bits, known, total, frequent

    def answer_words(self, found, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts of words, and the weight that each leaves as a context (all where it is unknown)."""
        count, weight = np.zeros(len(h), np.int64), np.full(len(h), WEIGHTS, np.int64)
        if found:
            listed, (counts, weights) = found
            at = _among(listed, h)
            hit = at >= 0
            count[hit], weight[hit] = counts[at[hit]], weights[at[hit]]
        return count, weight

    def answer_grams(self, found, listed: np.ndarray, rank: np.ndarray, usual: np.ndarray, h: np.ndarray, i1, i2, i3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For trigrams (numbers of words, by first and second) the code of the pair's count, the weight of the pair as a
        context and the code of the trigram's share. ``listed`` are a shard's words, ``rank`` is theirs among its contexts,
        ``usual`` has the places of frequent words, ``h`` are the others."""
        n = len(i1)
        code2, weight, code3 = np.zeros(n, np.uint8), np.full(n, WEIGHTS, np.int64), np.full(n, 255, np.uint8)
        if not found or not n:
            return code2, weight, code3
        (_, _, spans2, nodes2, spans3, nodes3), (codes2, weights, codes3) = found
        v = np.uint64(max(1, len(listed)))
        word = np.concatenate([usual, _among(listed, h)])
        # Pairs first, each once: the range of the first word's successors, then the second word in it.
        i1, i2, i3 = i1.astype(np.int64), i2.astype(np.int64), i3.astype(np.int64)
        new = np.flatnonzero(np.diff(i1, prepend=-1) | np.diff(i2, prepend=-1))
        of = np.cumsum(np.bincount(new, minlength=n)) - 1
        first, second = word[i1[new]], word[i2[new]]
        r = np.where(first >= 0, rank[first], -1)
        on = np.flatnonzero((r >= 0) & (second >= 0))
        first, end = spans2.get(r[on]).astype(np.int64), spans2.get(r[on] + 1).astype(np.int64)
        pair = np.full(len(new), -1, np.int64)
        pair[on] = nodes2.search(r[on].astype(np.uint64) * v + second[on].astype(np.uint64), first, end)
        pair = pair[of]
        known = np.flatnonzero(pair >= 0)
        code2[known], weight[known] = codes2[pair[known]], weights[pair[known]]
        # Then the third word in the range of the pair's successors.
        on = known[word[i3[known]] >= 0]
        p = pair[on]
        first, end = spans3.get(p).astype(np.int64), spans3.get(p + 1).astype(np.int64)
        at = nodes3.search(p.astype(np.uint64) * v + word[i3[on]].astype(np.uint64), first, end)
        code3[on[at >= 0]] = codes3[at[at >= 0]]
        return code2, weight, code3

    def answers(self, level: int, shard: int, blobs) -> list[bytes]:
        """Answers to look-ups of one shard, which is opened once."""
        found = _load(self.path, f"{'one' if level == WORDS else 'two'}-{shard}")
        # Lists of words are decoded as a whole; successors are searched where they are.
        listed = found[0][0].decode() if found else np.zeros(0, np.uint64)
        if level == WORDS:
            opened = found and (listed, found[1])
            return [_squeeze(*self.answer_words(opened, *_unsqueeze(b))) for b in blobs]
        rank = np.full(len(listed), -1, np.int64)
        if found:
            context = found[0][1]
            rank[context.decode().astype(np.int64)] = np.arange(context.n)
        usual = _among(listed, self.frequent)
        return [_squeeze(*self.answer_grams(found, listed, rank, usual, *_unsqueeze(b))) for b in blobs]

    def combine(self, home: bytes, words: dict[int, bytes], grams: dict[int, bytes]) -> pd.DataFrame:
        """Scores of a chunk's documents from its tokens and the answers of all shards."""
        doc, null, counts, place, routes, (begin, stop) = _unsqueeze(home)
        counts, place, begin, stop = counts.astype(np.int64), place.astype(np.int64), int(begin), int(stop)
        count, weight = (np.concatenate(x) for x in zip(*(_unsqueeze(words[s]) for s in sorted(words)), strict=True))
        count, weight = count.astype(np.float64), weight.astype(np.float64) / WEIGHTS
        i1, i2, i3 = trigrams(place, counts, begin, stop)
        a1, a2, _, back = _distinct(i1, i2, i3, len(routes), return_inverse=True)
        got = [np.concatenate(x) for x in zip(*(_unsqueeze(grams[s]) for s in sorted(grams)), strict=True)]
        at = np.empty(len(a1), np.int64)
        at[np.argsort(_gram_shard(routes[a1], routes[a2], self.bits), kind="stable")] = np.arange(len(a1))
        at = at[back]
        pair, left, three = value(got[0][at].astype(np.uint8)), got[1][at] / WEIGHTS, share(got[2][at].astype(np.uint8))
        uni = (count + 1) / (self.total + self.known + 1)
        # A token's trigram ends with it, and its pair begins the next trigram.
        on = np.flatnonzero(i3 != stop)
        v, w = i2[on], i3[on]
        full = np.log10(three[on] + left[on] * (pair[on + 1] / np.maximum(count[v], 1) + weight[v] * uni[w]))
        base = np.log10(uni)
        starts = np.cumsum(counts) - counts
        ids = pd.arrays.IntegerArray(doc.view(np.int64).copy(), null.astype(bool))
        sums = [np.add.reduceat(x, starts) for x in ((count > 0)[w].astype(np.int64), base[w], full)]
        return pd.DataFrame({"doc_id": ids, "n_tokens": counts, "n_known": sums[0], "base_score": sums[1], "score": sums[2]})


def _text_rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


@contextmanager
def _freed(spark):
    """Queries that begin meanwhile leave no shuffle files when they end."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if was is None else spark.conf.set(name, was)


def _counts(batches):
    for batch in batches:
        for part in _chunks(batch["text"].to_list(), 1 << 20):
            word, n = np.unique(tokens(part)[0], return_counts=True)
            yield pd.DataFrame({"word": word.view(np.int64), "n": n})


def _frequent(rows: DataFrame, size: int) -> np.ndarray:
    """Hashes of frequent words, the commonest first. They are looked for in some LOOKED_AT bytes of text, chosen by hash;
    which ones are found decides how much room rows take on their way, never a result."""
    parts = max(1, size // LOOKED_AT)
    some = rows.filter(F.pmod(F.xxhash64("text"), F.lit(parts)) == 0)
    found = some.mapInPandas(_counts, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).filter("n > 1")
    best = found.orderBy(F.desc("n"), "word").limit(FREQUENT).toPandas()
    return best["word"].to_numpy(np.int64).view(np.uint64)


def train(docs: DataFrame, path: str) -> Trie:
    """Counts all words, pairs and trigrams of ``docs`` and writes the trie under ``path``, a shared folder. Null text is
    empty and counts one end; rows that repeat an id count each; an empty table gives an empty model."""
    rows = _text_rows(docs)
    spark = docs.sparkSession
    with _freed(spark):
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        bits = min(24, max(4, int(size // SHARD_BYTES).bit_length()))
        frequent = _frequent(rows, size)
        for turn in range(TURNS):
            sent = rows.mapInPandas(_rows(bits, False, frequent, turn), _ROW)
            built = sent.groupBy("level", "shard").applyInPandas(_build(f"{path}/trie", bits, frequent), _ROW)
            built.write.mode("append").parquet(f"{path}/contexts")
        ones = spark.read.schema(_ROW).parquet(f"{path}/contexts")
        known, total = ones.groupBy("shard").applyInPandas(_words(f"{path}/trie"), "words long, tokens long").agg(F.sum("words"), F.sum("tokens")).first()
    return Trie(f"{path}/trie", bits, int(known or 0), int(total or 0), frequent)


def _answer(model: Trie):
    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        if int(key[0]) != HOME:
            group = group.assign(blob=model.answers(int(key[0]), int(key[1]), group["blob"]))
        return group

    return run


def _combine(model: Trie):
    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        of = {level: dict(zip(part["shard"], part["blob"], strict=True)) for level, part in group.groupby("level")}
        return model.combine(next(iter(of[HOME].values())), of[WORDS], of[GRAMS])

    return run


def score(docs: DataFrame, model: Trie) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row; a null text is one end, rows
    that repeat an id are scored each, a null id stays null, an empty table gives no rows, other columns are ignored.

    ``docs`` is read once for each round, which has the texts of some hashes, and must be the same each time. Scores are
    written beside the model."""
    rows, spark, path = _text_rows(docs), docs.sparkSession, f"{model.path}/scores-{uuid.uuid4().hex}"
    kind = "doc_id long, n_tokens long, n_known long, base_score double, score double"
    with _freed(spark):
        for k in range(ROUNDS):
            some = rows.filter(F.pmod(F.xxhash64("text"), F.lit(ROUNDS)) == k)
            sent = some.mapInPandas(_rows(model.bits, True, model.frequent), _ROW)
            back = sent.groupBy("level", "shard").applyInPandas(_answer(model), _ROW)
            back.groupBy("chunk").applyInPandas(_combine(model), kind).write.mode("append").parquet(path)
    out = spark.read.schema(kind).parquet(path)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score")


def held_out(doc_id):
    return id_crc(doc_id) % 7 == 2
