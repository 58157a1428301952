"""License and secret scans against exhaustive recounts."""

import random
import re

import numpy as np
import pytest

pytest.importorskip("papyrine.llm.queries")

from papyrine.llm import licenses, secrets  # noqa: E402
from papyrine.llm.common import Scratch, table  # noqa: E402

SF = "/root/testdata/sf0.001"


def every_window(scanner, text):
    """Templates of which some window holds enough shingles: all windows against all templates, nothing retrieved."""
    s, _ = licenses._shingles(text)
    out = set()
    for name, own in scanner.sets.items():
        block = licenses.BLOCK
        while block < len(own):
            block *= 2
        here = np.isin(s, own)
        for a in range(0, max(1, len(s)), block):
            low, high = max(0, a - block), min(len(s), a + 3 * block)
            if len(np.unique(s[low:high][here[low:high]])) >= licenses.CONTAINMENT * len(own):
                out.add(name)
                break
    return out


def test_licenses_against_every_window():
    r = random.Random(11)
    listed = licenses.all_templates()
    scanner = licenses.Scanner(listed)
    words = "lorem ipsum dolor sit amet licensed under the terms of software provided as is without warranty".split()

    def filler(n):
        return " ".join(r.choices(words, k=n))

    texts = []
    for name, text in r.sample(listed, 60):
        w = text.split()
        cut = r.choice([1.0, 1.0, 0.95, 0.6])
        kept = w[: max(1, int(len(w) * cut))]
        for _ in range(r.choice([0, 0, len(w) // 100])):
            kept[r.randrange(len(kept))] = "edited"
        texts.append(f"{filler(r.randrange(300))} {' '.join(kept)} {filler(r.randrange(300))}")
    texts += [filler(500), "", " ".join(t for _, t in r.sample(listed, 5))]
    full = 0
    for text in texts:
        found = {name for name, _, _ in scanner.retrieve(licenses._shingles(text)[0])}
        exact = every_window(scanner, text)
        # What is verified is never more than what every window holds; of templates of three shingles or more nothing is missed.
        said = {n for _, _, n, _ in scanner.scan(text)}
        assert said <= {name for name, _ in exact}
        missed = {x for x in exact - found if len(scanner.sets[x]) > 2}
        assert not missed, missed
        assert {n for n, t in exact if len(scanner.sets[n, t]) > 2} <= said
        full += len(exact)
    assert full > 60


def test_secrets_against_a_recount(spark):
    """Every value of the whole table, with its documents and sources, by dictionaries."""
    r = random.Random(12)
    alphabet = "abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789"
    made = ["".join(r.choices(alphabet, k=r.randrange(20, 40))) for _ in range(40)] + ["aA1" * 8]
    rows = []
    for x in table(spark, SF, "documents").select("doc_id", "text", "source").collect():
        text = x.text or ""
        for _ in range(r.choice([0, 0, 1, 3])):
            at = r.randrange(len(text) + 1)
            text = text[:at] + r.choice(["", " ", 'token="', "password: "]) + r.choice(made[: r.choice([3, 41])]) + r.choice(["", " ", '"']) + text[at:]
        rows.append((x.doc_id, text, x.source))
    rows += [(None, f"x {made[0]} y", None), (None, f"x {made[5]} y", "s"), (7, f"again {made[6]}", "s"), (7, f"again {made[6]}", "s")]

    held, by_row = {}, []
    for i, text, source in rows:
        spans = [(m.start(), m.end(), k, m[g]) for k, (p, g, least) in enumerate(secrets.BASE.values()) for m in re.finditer(p, text) if len(m[g]) >= least]
        spans += [(m.start(), m.end(), 3, m[0]) for m in re.finditer(secrets.EXTRA, text) if not any(a < m.end() and m.start() < b for a, b, *_ in spans)]
        by_row.append(spans)
        for *_, v in spans:
            sources, docs = held.setdefault(v, (set(), set()))
            sources.add(source or "")
            docs.add(i)
    example = {v: len(s) > secrets.MAX_SOURCES or len(d) > secrets.MAX_DOCUMENTS for v, (s, d) in held.items()}
    want = []
    for (i, text, _), spans in zip(rows, by_row):
        live = [x for x in spans if not example[x[3]] and len(set(x[3])) >= secrets.MIN_DISTINCT]
        shown = sorted((a, k, b) for a, b, k, _ in spans if k < 3 or any(x[0] == a and x[2] == 3 for x in live))
        # Rows of one id and text share what is counted for them.
        times = sum(j == i and t == text for j, t, _ in rows)
        want.append((-1 if i is None else i, ",".join(f"{secrets.ORDER[k]}:{a}:{b}" for a, k, b in shown), times * len(live), times * sum(example[v] for *_, v in spans)))
    got = secrets.scan(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3), Scratch(spark, "t")).collect()
    assert sorted((-1 if x.doc_id is None else x.doc_id, x.spans, x.n_live, x.n_example) for x in got) == sorted(want)
    assert sum("live:" in w[1] for w in want) > 20 and sum(w[3] > 0 for w in want) > 20
