"""CSS selectors: lists, combinators, attributes, and the structural classes that documents need."""

from __future__ import annotations

import re
from functools import lru_cache

from papyrine.html.dom import Node

_PART = re.compile(r"""\s*([>+~])\s*|(\s+)|(\*|[A-Za-z_][\w-]*)|\#([\w-]+)|\.([\w-]+)|\[\s*([\w:-]+)\s*(?:([~|^$*]?=)\s*(?:"([^"]*)"|'([^']*)'|([^\]\s]+))\s*([iI])?\s*)?\]|:(not|is)\(([^()]*(?:\([^()]*\)[^()]*)*)\)|:(first-child|last-child|only-child|empty|root|nth-child)(?:\(([^)]*)\))?""")


class SelectorError(ValueError):
    pass


@lru_cache(maxsize=1024)
def compile_selector(css: str) -> tuple:
    """A list of alternatives, each a list of (combinator, tests) from the right."""
    alternatives, depth, at = [], 0, 0
    for i, c in enumerate(css + ","):
        depth += (c in "([") - (c in ")]")
        if c == "," and not depth:
            alternatives.append(css[at:i].strip())
            at = i + 1
    if depth or not all(alternatives):
        raise SelectorError(css)
    return tuple(_chain(a) for a in alternatives)


def _chain(css: str) -> tuple:
    steps, tests, join, at = [], [], "", 0
    while at < len(css):
        m = _PART.match(css, at)
        if not m or m.end() == at:
            raise SelectorError(css)
        at = m.end()
        if m[1] or m[2]:
            if not tests:
                raise SelectorError(css)
            steps.append((join, tuple(tests)))
            tests, join = [], m[1] or " "
        elif m[3]:
            if m[3] != "*":
                tests.append(("tag", m[3].lower()))
            else:
                tests.append(("any",))
        elif m[4]:
            tests.append(("attr", "id", "=", m[4], False))
        elif m[5]:
            tests.append(("attr", "class", "~=", m[5], False))
        elif m[6]:
            tests.append(("attr", m[6].lower(), m[7] or "", next((g for g in m.groups()[7:10] if g is not None), ""), bool(m[11])))
        elif m[12]:
            tests.append((m[12], compile_selector(m[13])))
        else:
            tests.append(("place", m[14], m[15] or ""))
    if not tests:
        raise SelectorError(css)
    return tuple(reversed([*steps, (join, tuple(tests))]))


def nth_terms(spec: str) -> tuple[int, int] | None:
    """(a, b) of an+b, null where it is none."""
    spec = {"odd": "2n+1", "even": "2n"}.get(spec.strip().lower(), spec.replace(" ", "").lower())
    m = re.fullmatch(r"(?:([+-]?\d*)n)?([+-]?\d+)?", spec)
    if not m:
        return None
    a = 0 if m[1] is None else int(m[1] + "1" if m[1] in ("", "+", "-") else m[1])
    return a, int(m[2] or 0)


def _nth(spec: str, i: int) -> bool:
    terms = nth_terms(spec)
    if terms is None:
        return False
    a, b = terms
    return i == b if not a else (i - b) % a == 0 and (i - b) // a >= 0


def _holds(n: Node, test: tuple) -> bool:
    kind = test[0]
    if kind == "any":
        return True
    if kind == "tag":
        return n.tag == test[1]
    if kind == "attr":
        value = n.attrs.get(test[1])
        if value is None:
            return False
        op, want = test[2], test[3]
        if test[4]:
            value, want = value.lower(), want.lower()
        if not op:
            return True
        if op in ("^=", "$=", "*=") and not want:
            return False
        return {"=": value == want, "~=": want in value.split(), "|=": value == want or value.startswith(want + "-"), "^=": value.startswith(want), "$=": value.endswith(want), "*=": want in value}[op]
    if kind in ("not", "is"):
        return any(_match(n, c, 0) for c in test[1]) == (kind == "is")
    if test[1] == "root":
        return n.tag == "html"
    if test[1] == "empty":
        return not any(c.tag != "!" for c in n.children)
    own = n.parent.element_children() if n.parent else [n]
    i = next(k for k, c in enumerate(own) if c is n)
    return {"first-child": i == 0, "last-child": i == len(own) - 1, "only-child": len(own) == 1}.get(test[1], False) or test[1] == "nth-child" and _nth(test[2], i + 1)


def _match(n: Node, chain: tuple, k: int) -> bool:
    # The combinator of a step says how it hangs on the step to its left.
    join, tests = chain[k]
    if not all(_holds(n, t) for t in tests):
        return False
    if k + 1 == len(chain):
        return True
    if join == ">":
        return n.parent is not None and n.parent.tag[0] != "#" and _match(n.parent, chain, k + 1)
    if join == " ":
        return any(_match(a, chain, k + 1) for a in n.ancestors() if a.tag[0] != "#")
    own = n.parent.element_children() if n.parent else []
    before = own[: next((i for i, c in enumerate(own) if c is n), 0)]
    return any(_match(b, chain, k + 1) for b in (before[-1:] if join == "+" else before))


def matches(n: Node, css: str) -> bool:
    return any(_match(n, c, 0) for c in compile_selector(css))


def select(root: Node, css: str) -> list[Node]:
    """Matching elements in document order."""
    chains = compile_selector(css)
    return [n for n in root.elements() if any(_match(n, c, 0) for c in chains)]
