"""License scans: MinHash bands over overlapping windows retrieve templates, exact shingle containment verifies.

Windows of 2B shingles at every B, for block sizes B = 4, 8, 16, ..., cover each document; a template of n shingles is
looked up with the smallest B >= n, so it lies in one window as a whole. A window that holds three quarters of the
template then has a Jaccard similarity of 0.375 / 2.125 = 0.176 with it at least, and BANDS bands of one row collide with a
probability of 1 - (1 - 0.176) ** BANDS, more than 0.99999. What is retrieved is verified on the window and a block on
either side: the share of the template's shingles found there must reach CONTAINMENT.

Words are compared without the punctuation at their edges, and those without a letter or digit (comment markers, rules)
are passed over, in documents and templates alike; places are counted in words as they stand.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import lru_cache
from importlib.resources import files

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyrine.llm.shingles import _FOLD, _SPACE, SHINGLE, _combine, _powers, mix

#: Bands of one row, least share of a template's shingles, shingles in the smallest block.
BANDS, CONTAINMENT, BLOCK = 64, 0.75, 4

#: Least words of a paragraph that stands for its license.
PARAGRAPH = 12

#: License notices by SPDX id; ids joined by ``|`` share the text.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "Apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "GPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "BSD-2-Clause|BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}

_FACTORS = mix(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)
_BITS = 20


#: Bytes of letters, digits and of characters beyond ASCII; of the latter, punctuation and symbols are folded to '.' before.
_CORE = np.zeros(256, bool)
_CORE[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


@lru_cache(maxsize=1)
def _marks() -> dict[int, str]:
    return {c: "." for c in range(0x80, sys.maxunicode + 1) if unicodedata.category(chr(c))[0] in "PS"}


def _bare_words(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words without the punctuation at their edges, and which words of the text they are."""
    if not text.isascii():
        text = text.translate(_marks())
    data = np.frombuffer(text.encode("utf-8", "surrogatepass").translate(_FOLD) + b" ", np.uint8)
    edge = np.diff(np.concatenate([[True], _SPACE[data]]).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    core = _CORE[data]
    before, at = np.concatenate([[0], np.cumsum(core)]), np.flatnonzero(core)
    place = np.flatnonzero(before[end] > before[start])
    a, b = at[before[start[place]]], at[before[end[place]] - 1] + 1
    p, q = _powers(1 << max(20, len(data).bit_length()))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * p[: len(data)], out=total[1:])
    return mix((total[b] - total[a]) * q[a]), place


def _shingles(text: str) -> tuple[np.ndarray, np.ndarray]:
    words, place = _bare_words(text)
    if len(words) >= SHINGLE:
        return _combine(words, SHINGLE), place
    return (_combine(words, len(words)) if len(words) else words), place


#: Names of licenses as notices have them, by SPDX id.
NAMES = {
    "MIT": ("the MIT License",),
    "Apache-2.0": ("the Apache License, Version 2.0", "the Apache License 2.0"),
    "BSD-2-Clause": ("the BSD 2-Clause License", "the 2-Clause BSD License"),
    "BSD-3-Clause": ("the BSD 3-Clause License", "the 3-Clause BSD License"),
    "ISC": ("the ISC License",),
    "MPL-2.0": ("the Mozilla Public License, v. 2.0", "the Mozilla Public License, version 2.0", "the Mozilla Public License 2.0"),
    **{
        f"{short}-{v}": (f"the GNU {long} General Public License, version {v.removesuffix('.0')}".replace("  ", " "), f"the GNU {long} General Public License v{v}".replace("  ", " "), f"the GNU {short} version {v.removesuffix('.0')}")
        for short, long, versions in (("GPL", "", ("2.0", "3.0")), ("LGPL", "Lesser", ("2.1", "3.0")), ("AGPL", "Affero", ("3.0",)))
        for v in versions
    },
    "CC0-1.0": ("the CC0 1.0 Universal", "CC0 1.0 Universal"),
    **{
        f"CC-{kind}-{v}": (f"CC {kind} {v}", f"a Creative Commons {name} {v} International License", f"the Creative Commons {name} {v} International License")
        for kind, name in (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"))
        for v in ("4.0",)
    },
}


def _notices() -> list[tuple[str, str]]:
    """Usual wordings; a name of less than five words counts with what stands before it."""
    return [
        (f"{i}-notice", f"{verb} under {terms}{name}")
        for i, names in NAMES.items()
        for name in names
        for verb in ("Licensed", "Released", "Distributed")
        for terms in ("", "the terms of ")
        if len(f"{verb} under {terms}{name}".split()) >= SHINGLE
    ]


@lru_cache(maxsize=1)
def all_templates() -> tuple[tuple[str, str], ...]:
    """(id, text) of the fixed values, of notices and of each paragraph of the whole texts in ``license_texts``. Of a
    paragraph that several licenses have, the id is all of theirs."""
    owners: dict[tuple, set[str]] = {}
    text: dict[tuple, str] = {}
    for f in sorted(files("papyrine.llm").joinpath("license_texts").iterdir(), key=lambda x: x.name):
        if f.name.endswith(".txt"):
            for part in re.split(r"\n[ \t\f]*\n", f.read_text("utf-8")):
                words, _ = _bare_words(part)
                if len(words) >= PARAGRAPH:
                    key = tuple(words.tolist())
                    owners.setdefault(key, set()).add(f.name.removesuffix(".txt"))
                    text[key] = part
    return (*TEMPLATES.items(), *_notices(), *(("|".join(sorted(owners[k])), text[k]) for k in text))


def resolve(names: set[str]) -> dict[str, str]:
    """What to call each name of one document: a shared text is the license of those that have it whose own text is there
    too; the shared text of both BSD licenses without a third clause is BSD-2-Clause; others keep all ids."""
    out = {}
    for name in names:
        ids = name.split("|")
        own = [i for i in ids if i in names]
        out[name] = own[0] if len(own) == 1 else "BSD-2-Clause" if ids == ["BSD-2-Clause", "BSD-3-Clause"] else name
    return out


class Scanner:
    """Templates arranged for retrieval; several may have the same id."""

    def __init__(self, templates: tuple[tuple[str, str], ...]):
        self.sets: dict[tuple[str, str], np.ndarray] = {}
        self.bands: dict[int, tuple[np.ndarray, dict]] = {}
        for name in sorted(set(templates)):
            text = name[1]
            s = np.unique(_shingles(text)[0])
            if not len(s):
                continue
            self.sets[name] = s
            block = BLOCK
            while block < len(s):
                block *= 2
            table, names = self.bands.setdefault(block, (np.zeros(1 << _BITS, bool), {}))
            for j, v in enumerate(np.multiply.outer(_FACTORS, s).min(axis=1).tolist()):
                table[v >> (64 - _BITS)] = True
                names.setdefault((j, v), set()).add(name)

    def retrieve(self, s: np.ndarray) -> set[tuple[tuple[str, str], int, int]]:
        """(template, first shingle, end) of windows that share a band with a template."""
        found: set[tuple[tuple[str, str], int, int]] = set()
        if not len(s) or not self.bands:
            return found
        low = np.concatenate([np.minimum.reduceat(np.multiply.outer(_FACTORS, s[a : a + 4096]), np.arange(0, len(s[a : a + 4096]), BLOCK), axis=1) for a in range(0, len(s), 4096)], axis=1)
        block = BLOCK
        while block <= max(self.bands):
            if block in self.bands:
                table, names = self.bands[block]
                window = np.minimum(low[:, :-1], low[:, 1:]) if low.shape[1] > 1 else low
                for j, w in zip(*np.nonzero(table[(window >> np.uint64(64 - _BITS)).astype(np.int64)]), strict=True):
                    for name in names.get((int(j), int(window[j, w])), ()):
                        found.add((name, int(w) * block, (int(w) + 2) * block))
            if low.shape[1] % 2:
                low = np.concatenate([low, low[:, -1:]], axis=1)
            low = np.minimum(low[:, ::2], low[:, 1::2])
            block *= 2
        return found

    def scan(self, text: str) -> list[tuple[int, int, str, float]]:
        """(first word, end, template, containment), overlapping places of a template joined into the best one."""
        s, place = _shingles(text)
        places: dict[tuple[str, str], list[tuple[int, int, float]]] = {}
        for name, a, b in sorted(self.retrieve(s), key=lambda x: x[1:]):
            own, block = self.sets[name], (b - a) // 2
            a, b = max(0, a - block), min(len(s), b + block)
            hit = np.flatnonzero(np.isin(s[a:b], own))
            if not len(hit):
                continue
            share = len(np.unique(s[a + hit])) / len(own)
            if share >= CONTAINMENT:
                one = (int(place[a + hit[0]]), int(place[min(len(place), a + int(hit[-1]) + SHINGLE) - 1]) + 1, share)
                known = places.setdefault(name, [])
                if known and one[0] < known[-1][1]:
                    known[-1] = (min(known[-1][0], one[0]), max(known[-1][1], one[1]), max(known[-1][2], one[2]))
                else:
                    known.append(one)
        best: dict[tuple[int, int, str], float] = {}
        for (name, _), at in places.items():
            for a, b, share in at:
                best[a, b, name] = max(share, best.get((a, b, name), 0))
        return sorted((*k, share) for k, share in best.items())


@lru_cache(maxsize=2)
def _scanner(templates: tuple[tuple[str, str], ...]) -> Scanner:
    return Scanner(templates)


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_licenses, licenses (ids, sorted, comma-joined), spans (id:first word:end by
    place, comma-joined), containment (the largest, 0 without any).

    Null or blank texts have no license; rows that repeat an id are scanned each; null ids stay null; an empty table
    gives no rows. Templates are few and travel with the tasks.
    """
    listed = all_templates() if templates is None else tuple(sorted(templates.items()))

    def run(batches):
        scanner = _scanner(listed)
        for batch in batches:
            out = []
            for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                found = scanner.scan(text)
                called = resolve({n for _, _, n, _ in found})
                found = [(a, b, called[n], x) for a, b, n, x in found]
                names = sorted(set(called.values()))
                out.append((doc, len(names), ",".join(names), ",".join(f"{n}:{a}:{b}" for a, b, n, _ in found), max((x[3] for x in found), default=0.0)))
            yield pd.DataFrame(out, columns=["doc_id", "n_licenses", "licenses", "spans", "containment"]).astype({"doc_id": "Int64"})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInPandas(run, "doc_id long, n_licenses long, licenses string, spans string, containment double")
