"""Exact, cached encoding with public tokenizer files.

Text is cut where the tokenizer cuts it in any case. Pieces repeat, so each worker lets the tokenizers library encode a
piece once and keeps its ids. New pieces that are a single word are encoded many at a time as one text, as the tokens of
that text show where a word begins or ends; the number of words found must be that of the pieces, or each is encoded by
itself. The cache is emptied when it is full, so memory stays bounded.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces kept by a worker; a longer piece than KEEP_CHARS isn't kept.
KEEP, KEEP_CHARS = 700_000, 64
#: Words that are encoded as one text.
TOGETHER = 256

#: What makes cuts unsure: white space other than a blank or line feed, our own mark, and the one letter whose small form
#: ends in a sign that is no letter; blanks or line feeds in a row; a comma or full stop, before white space, that doesn't
#: follow a letter or digit. In texts without these every single blank or line feed is a sure cut, and so is the comma or
#: full stop before one.
_UNSURE_RE2 = r"[\x01\x{130}\t\r\x0b\x0c\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|[ \n][ \n]|(?:^|[^\pL\pN])[.,][ \n]"
_SURE_SPACE = re.compile(r"(?<=\S)(?= \S)")


def _pieces_byte(text: str) -> list[str]:
    """Pieces of a text of unsure cuts whose encodings, one after the other, are that of the text, for GPT-2 style
    byte-level splitting."""
    return _SURE_SPACE.split(text)


def _pieces_word(text: str) -> list[str]:
    """The same for the BPE that lower-cases and drops white space."""
    return re.split(r"[ \n]+", text)


CUTS = {"byte_bpe_50k.json": _pieces_byte, "word_bpe_49k.json": _pieces_word}
#: How texts of sure cuts are cut: strings that are replaced, then the string between pieces.
_REPLACED = {
    _pieces_byte: [(".\n", "\x01.\n"), ("\n", "\x01\n\x01"), (", ", "\x01, "), (". ", "\x01. "), (" ", "\x01 ")],
    _pieces_word: [(", ", " , "), (". ", " . "), (".\n", " .\n"), ("\n", " ")],
}
_SPLIT = {_pieces_byte: "\x01", _pieces_word: " "}
#: How a word's tokens are told apart in these files: the first begins with the mark of a blank, or the last has the
#: mark of a word's end; and what stands between words in a text of many.
FIRST, LAST = "\u0120", "</w>"


class Encoder:
    """Ids of whole texts, equal to ``encode_batch(texts, add_special_tokens=False)`` of the tokenizers library.

    Strings of special tokens in a text are ordinary text. A file that CUTS doesn't name is used without the cache.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True
        self.type = np.dtype("<u2" if self.model.get_vocab_size() <= 1 << 16 else "<u4")
        self.cut = CUTS.get(os.path.basename(path), lambda text: [text])
        self.known: dict[str, bytes] = {}
        marks = {_pieces_byte: lambda t: t.startswith(FIRST), _pieces_word: lambda t: t.endswith(LAST)}.get(self.cut)
        self.edge = None
        if marks:
            self.edge = np.zeros(self.model.get_vocab_size(), bool)
            self.edge[[i for t, i in self.model.get_vocab().items() if marks(t)]] = True

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.type) for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: list[str]):
        """Each of some new pieces with its ids."""
        byte = self.cut is _pieces_byte
        words, rest = [], []
        for p in pieces:
            one = self.edge is not None and (p[:1] == " " and p[1:].isalpha() if byte else p.isalpha())
            (words if one else rest).append(p)
        groups = [words[a : a + TOGETHER] for a in range(0, len(words), TOGETHER)]
        for a in range(0, len(groups), 16):
            part = groups[a : a + 16]
            for group, ids in zip(part, self._ids([("" if byte else " ").join(g) for g in part]), strict=True):
                at = np.flatnonzero(self.edge[ids])
                bounds = np.append(at, len(ids)) if byte else np.append(0, at + 1)
                if len(at) != len(group) or bounds[0] != 0 or bounds[-1] != len(ids):
                    rest += group
                    continue
                blob, cuts = ids.tobytes(), (bounds * ids.itemsize).tolist()
                yield from zip(group, [blob[x:y] for x, y in zip(cuts, cuts[1:])], strict=True)
        for a in range(0, len(rest), 4096):
            part = rest[a : a + 4096]
            yield from zip(part, [x.tobytes() for x in self._ids(part)], strict=True)

    def _blobs(self, pieces: list[str]) -> list[bytes]:
        """The ids of different pieces."""
        new = [p for p in pieces if p not in self.known]
        if len(self.known) + len(new) > KEEP:
            self.known, new = {}, pieces
        known, own = self.known, {}
        for piece, ids in self._learn(new):
            (known if len(piece) <= KEEP_CHARS else own)[piece] = ids
        return [own[p] if p in own else known[p] for p in pieces] if own else list(map(known.__getitem__, pieces))

    def _encode(self, lists: pa.Array) -> list[np.ndarray]:
        """One array of ids for each list of pieces."""
        coded = lists.values.dictionary_encode()
        place = coded.indices.to_numpy()
        blobs = self._blobs(coded.dictionary.to_pylist())
        size = np.fromiter(map(len, blobs), np.int64, len(blobs)) // self.type.itemsize
        ids = np.frombuffer(b"".join(blobs), self.type)
        lengths = size[place]
        ends = np.cumsum(lengths)
        # Each piece's ids are copied from where they are in ``ids`` to where the piece is.
        shift = np.repeat((np.cumsum(size) - size)[place] - (ends - lengths), lengths)
        out = ids[shift + np.arange(len(shift))]
        bounds = np.append(0, ends)[lists.offsets.to_numpy()]
        return [out[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """One array of unsigned 16- or 32-bit ids for each text."""
        try:
            column = pa.array(texts, pa.large_string())
        except UnicodeEncodeError:  # half surrogates aren't text to the libraries
            raise ValueError("text isn't valid Unicode") from None
        if self.edge is None or not len(texts):
            return self._ids(texts)
        odd = pc.match_substring_regex(column, _UNSURE_RE2)
        out: list[np.ndarray] = [None] * len(texts)
        sure = np.flatnonzero(~odd.to_numpy(zero_copy_only=False))
        if len(sure):
            parts = column.take(pa.array(sure))
            for a, b in _REPLACED[self.cut]:
                parts = pc.replace_substring(parts, a, b)
            for i, ids in zip(sure.tolist(), self._encode(pc.split_pattern(parts, _SPLIT[self.cut])), strict=True):
                out[i] = ids
        rest = np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist()
        if rest:
            lists = pa.array([self.cut(texts[i]) for i in rest], pa.large_list(pa.large_string()))
            for i, ids in zip(rest, self._encode(lists), strict=True):
                out[i] = ids
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def tokenizer_file(name: str) -> str:
    """Where the installed public tokenizer file is; the import is kept here as only workers and queries need it."""
    import public_tokenizers

    return public_tokenizers.path(name)
