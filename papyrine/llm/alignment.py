"""Alignment of two tokenizers over a corpus.

Each text is encoded by a byte-level BPE (A) and a sentencepiece model (B). Both give the same bytes, so cumulative token
lengths are ends in one byte string: a two-pointer merge of the two lists of ends finds where both end, which cuts the
tokens into groups and links the two tokens that end there. Spark counts each pair of ids over the corpus and brings the
counts, and whether they are the highest of their A or B id, back to the documents.

Documents are encoded in blocks of a bounded size (a longer document is a block of its own). A block lists each of its
pairs once, with a count, and its documents hold places in that list. So a pair travels once a block, not once a link, and
counts come back to a block as one short list.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyrine.llm.common import Scratch, joined_by_share, partitions_for, shuffle_partitions, slices
from papyrine.llm.tokens import Encoder, encoder

#: Characters of a block.
BLOCK = 4 << 20
#: The mark that sentencepiece writes for a blank.
BLANK = "▁"
_CUT = re.compile(r"(?<=[^ ])(?= )|(?=\n)")

_DOCS = "block long, doc_id {}, n_a long, n_b long, n_groups long, groups_sha256 string, places binary, width int, a array<int>, b array<int>, n array<long>"


class PieceEncoder(Encoder):
    """Ids of whole texts, equal to those of the sentencepiece library, which puts a blank before each text.

    No entry of the vocabulary holds a blank after another character, or a line feed; so the ids of a text are those of its
    parts that begin at a blank run or a line feed, one after the other. Parts repeat, and each is encoded once. A
    vocabulary with such entries is used without parts.
    """

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        self.entries = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.type = np.dtype("<u2" if len(self.entries) <= 1 << 16 else "<u4")
        self.blank = self.model.piece_to_id(BLANK)
        self.parts = not any(BLANK in p.lstrip(BLANK) or "\n" in p for p in self.entries)
        self.known: dict[str, bytes] = {}

    def token_bytes(self) -> list[bytes]:
        return [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace(BLANK, " ").encode() for i, p in enumerate(self.entries)]

    def _learn(self, pieces: list[str]):
        for a in range(0, len(pieces), 4096):
            part = pieces[a : a + 4096]
            # The library adds the blank that a part begins with; to a part that begins with a line feed it adds one too many.
            found = self.model.encode([p[1:] if p[0] == " " else p for p in part], num_threads=1)
            for p, ids in zip(part, found, strict=True):
                ids = [self.blank] if p == " " else ids if p[0] == " " else ids[1:]
                yield p, np.array(ids, self.type).tobytes()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """One array of ids for each text, which isn't empty."""
        if not self.parts:
            return [np.array(x, self.type) for x in self.model.encode(texts, num_threads=1)]
        column = pa.array([" " + t for t in texts], pa.large_string())
        whole = pc.match_substring(column, BLANK).to_numpy(zero_copy_only=False)
        odd = pc.match_substring_regex(column, "\x01|  ").to_numpy(zero_copy_only=False)
        out: list[np.ndarray] = [None] * len(texts)
        for i in np.flatnonzero(whole).tolist():  # the library takes its mark for a blank
            out[i] = np.array(self.model.encode(texts[i], num_threads=1), self.type)
        for at, cut in ((np.flatnonzero(~odd & ~whole), True), (np.flatnonzero(odd & ~whole), False)):
            if not len(at):
                continue
            if cut:
                marked = pc.replace_substring(pc.replace_substring(column.take(pa.array(at)), " ", "\x01 "), "\n", "\x01\n")
                lists = pc.split_pattern(pc.utf8_slice_codeunits(marked, 1), "\x01")
            else:
                lists = pa.array([[p for p in _CUT.split(" " + texts[i]) if p] for i in at], pa.large_list(pa.large_string()))
            for i, ids in zip(at.tolist(), self._encode(lists), strict=True):
                out[i] = ids
        return out


@lru_cache(maxsize=1)
def _byte_level() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable ones for themselves, the others, in
    order, for the letters from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Aligner:
    """Both encoders, and by id the bytes of each token and its decimal text with the sign that follows it."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = encoder(a_path), PieceEncoder(b_path)
        letter = _byte_level()
        a_bytes = [b""] * self.a.model.get_vocab_size()
        for token, i in self.a.model.get_vocab().items():
            a_bytes[i] = bytes(letter[c] for c in token) if all(c in letter for c in token) else token.encode()
        self.bytes = a_bytes, self.b.token_bytes()
        self.size = tuple(np.array([len(x) for x in t], np.int64) for t in self.bytes)
        # Row i of a table: "i,"; row n + i: the sign that ends a group's side.
        self.signs = tuple(np.array([f"{i}{s}" for s in (",", end) for i in range(len(t))], "S") for t, end in zip(self.bytes, "|;", strict=True))

    def encode(self, texts: list[str]):
        """For texts: the A ids and B ids of each, empty arrays where the bytes of either aren't those of the text with
        its leading blank."""
        none = np.zeros(0, self.a.type), np.zeros(0, self.b.type)
        at = [i for i, t in enumerate(texts) if t]
        out = [none] * len(texts)
        found = zip(at, self.a.encode([" " + texts[i] for i in at]), self.b.encode([texts[i] for i in at]), strict=True)
        for i, a, b in found:
            raw = (" " + texts[i]).encode()
            if all(b"".join(map(t.__getitem__, ids.tolist())) == raw for t, ids in zip(self.bytes, (a, b), strict=True)):
                out[i] = a, b
        return out


class Merge:
    """Groups and links of a run of documents: the byte ends of all their A tokens and of all their B tokens, merged.

    ``last_a[g]`` and ``last_b[g]`` are the places, among all tokens of the run, of the linked tokens of group g.
    """

    def __init__(self, aligner: Aligner, pairs: list[tuple[np.ndarray, np.ndarray]]):
        self.aligner = aligner
        self.a, self.b = (np.concatenate([p[k] for p in pairs]).astype(np.int64) for k in (0, 1))
        self.n_a, self.n_b = (np.array([len(p[k]) for p in pairs], np.int64) for k in (0, 1))
        # Documents lie one after the other, and both sides of each have the same length; so its end is a common one.
        ends_a, ends_b = (np.cumsum(aligner.size[k][ids]) for k, ids in ((0, self.a), (1, self.b)))
        # The second pointer: for each A end the first B end that isn't before it.
        pointer = np.searchsorted(ends_b, ends_a)
        both = ends_b[pointer] == ends_a if len(ends_a) else np.zeros(0, bool)
        self.last_a, self.last_b = np.flatnonzero(both), pointer[both]
        self.ends = ends_a[both]
        stop = np.cumsum(self.n_a)
        self.group_stop = np.searchsorted(self.last_a, stop)  # groups of documents up to each
        self.n_groups = np.diff(self.group_stop, prepend=0)

    def texts(self) -> list[bytes]:
        """``a1,a2|b1;a3|b2,b3`` for each document."""
        end_a, end_b = np.zeros(len(self.a), bool), np.zeros(len(self.b), bool)
        end_a[self.last_a] = end_b[self.last_b] = True
        group_a, group_b = (np.cumsum(e) - e for e in (end_a, end_b))
        # Within a group A tokens come first: before an A token stand all B tokens of earlier groups.
        before = np.append(0, self.last_b + 1)
        (sign_a, sign_b), (size_a, size_b) = self.aligner.signs, map(len, self.aligner.bytes)
        width = max(sign_a.itemsize, sign_b.itemsize)
        out = np.zeros(len(self.a) + len(self.b), f"S{width}")
        out[np.arange(len(self.a)) + before[group_a]] = sign_a[self.a + size_a * end_a]
        out[np.arange(len(self.b)) + (self.last_a + 1)[group_b]] = sign_b[self.b + size_b * end_b]
        raw = out.view(np.uint8)
        full = raw != 0
        cuts = np.append(0, np.cumsum(full.reshape(-1, width).sum(1)))[np.append(0, np.cumsum(self.n_a + self.n_b))].tolist()
        blob = raw[full].tobytes()
        return [blob[x : max(x, y - 1)] for x, y in zip(cuts, cuts[1:])]


@lru_cache(maxsize=1)
def _aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


def _merged(aligner: Aligner, texts) -> Merge:
    return Merge(aligner, aligner.encode(["" if t is None or t != t else t for t in texts]))


def align(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """The groups themselves: doc_id, group (from 0), start and end (bytes of the text with its leading blank), a_ids,
    b_ids; the last of either are linked. Documents without tokens have none."""

    def run(batches):
        aligner = _aligner(a_path, b_path)
        for batch in batches:
            for part in slices(batch):
                m = _merged(aligner, part["text"])
                number = np.concatenate([np.arange(n) for n in m.n_groups])
                start = np.append(0, m.ends[:-1]) if len(m.ends) else m.ends
                first = start[np.flatnonzero(number == 0)] if len(number) else start
                base = np.repeat(first, m.n_groups[m.n_groups > 0])
                yield pd.DataFrame({
                    "doc_id": part["doc_id"].repeat(m.n_groups).array, "group": number, "start": start - base, "end": m.ends - base,
                    "a_ids": np.split(m.a, m.last_a[:-1] + 1) if len(number) else [], "b_ids": np.split(m.b, m.last_b[:-1] + 1) if len(number) else [],
                })

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, group long, start long, end long, a_ids array<int>, b_ids array<int>")


def _encoded(a_path: str, b_path: str):
    def run(batches):
        aligner = _aligner(a_path, b_path)
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in slices(batch, size=BLOCK):
                m = _merged(aligner, part["text"])
                pairs, place, n = np.unique(m.a[m.last_a] << 32 | m.b[m.last_b], return_inverse=True, return_counts=True)
                # Frequent pairs first, so that most places are small numbers.
                order = np.argsort(-n, kind="stable")
                rank = np.empty(len(order), np.int64)
                rank[order] = np.arange(len(order))
                pairs, n = pairs[order], n[order]
                kind = np.dtype("<u2" if len(pairs) <= 1 << 16 else "<u4")
                places = rank[place].astype(kind)
                stop = m.group_stop.tolist()
                rest = [None] * (len(part) - 1)
                yield pd.DataFrame({
                    "block": block, "doc_id": part["doc_id"].array, "n_a": m.n_a, "n_b": m.n_b, "n_groups": m.n_groups,
                    "groups_sha256": [hashlib.sha256(t).hexdigest() if t else "" for t in m.texts()],
                    "places": [places[x:y].tobytes() for x, y in zip([0, *stop], stop)], "width": kind.itemsize,
                    "a": [pairs >> 32, *rest], "b": [pairs & 0xFFFFFFFF, *rest], "n": [n, *rest],
                })
                block += 1

    return run


def pair_counts(pairs: DataFrame) -> DataFrame:
    """Pairs (a, b, n) to a, b, links (the sum of n), rows (how many rows had the pair), highest_a and highest_b: whether no
    pair with the same a, or b, has more links. An id has a row at most in either table of maxima, so both are no larger
    than a vocabulary."""
    counts = pairs.groupBy("a", "b").agg(F.sum("n").alias("links"), F.count(F.lit(1)).alias("rows"))
    for side in ("a", "b"):
        most = counts.groupBy(side).agg(F.max("links").alias(f"most_{side}"))
        counts = counts.join(F.broadcast(most), side)
    return counts.select("a", "b", "links", "rows", (F.col("links") == F.col("most_a")).alias("highest_a"), (F.col("links") == F.col("most_b")).alias("highest_b"))


def _totals(key, docs: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
    """Sums over a block's documents of what their links' pairs have."""
    size = len(counts)
    table = np.zeros((3, size), np.int64)
    table[:, counts["place"].to_numpy()] = counts[["links", "highest_a", "highest_b"]].to_numpy().T.astype(np.int64)
    width = {2: "<u2", 4: "<u4"}
    found = [table[:, np.frombuffer(p, width[w])].sum(1) for p, w in zip(docs["places"], docs["width"], strict=True)]
    sums = np.stack(found) if found else np.zeros((0, 3), np.int64)
    return pd.DataFrame({
        "doc_id": docs["doc_id"].array, "n_a": docs["n_a"], "n_b": docs["n_b"], "n_groups": docs["n_groups"], "n_links": docs["n_groups"],
        "n_best": sums[:, 2], "count_sum": sums[:, 0], "groups_sha256": docs["groups_sha256"], "n_best_a": sums[:, 1],
    })


def align_tokenizers(docs: DataFrame, a_path: str, b_path: str, scratch: Scratch) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, n_best_a.

    ``n_best`` and ``n_best_a`` count links whose pair has the most links of its B id, or A id; ties count. Null and empty
    texts, and those that either vocabulary can't give back byte by byte, have no tokens: zeros and an empty
    groups_sha256. Rows stand for themselves: null and repeated ids are rows like others, repeated rows count each time;
    other columns aren't read. An empty table gives an empty one. Strings of special tokens are plain text.

    No token has zero bytes, so at most one token of either side ends at a place, and there is a link for each group.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    encoded = scratch.table(docs.mapInPandas(_encoded(a_path, b_path), _DOCS.format(kind)), "encoded")
    lists = encoded.filter(F.col("a").isNotNull()).select(F.col("block").alias("home"), F.posexplode(F.arrays_zip("a", "b", "n")).alias("place", "x"))
    pairs = lists.select("home", "place", "x.a", "x.b", "x.n")
    counts = scratch.table(pair_counts(pairs), "counts")
    known = joined_by_share(pairs.select("home", "place", "a", "b"), counts, ["a", "b"], "rows").select("home", "place", "links", "highest_a", "highest_b")
    parts = partitions_for(encoded, shuffle_partitions(spark))
    rows = encoded.select("block", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "places", "width").repartition(parts, "block")
    out = rows.groupBy("block").cogroup(known.repartition(parts, "home").groupBy("home"))
    schema = f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, n_best_a long"
    return scratch.last(out.applyInPandas(_totals, schema))
