"""String functions as Catalyst columns. Line anchors mean line feeds only, white space is Unicode's."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def compress_whitespace(x: Column) -> Column:
    """Runs of ASCII white space become one space."""
    return F.regexp_replace(x, r"[ \t\n\r\f]+", " ")


def trim_document(x: Column) -> Column:
    """Tabs, line ends and blanks at both ends go; other white space stays."""
    return F.regexp_replace(x, r"\A[\t\n\r ]+|[\t\n\r ]+\z", "")


def trim_lines(x: Column) -> Column:
    """Trailing white space of every line goes; CRLF becomes LF, and a final line feed goes too."""
    return F.regexp_replace(F.regexp_replace(x, r"(?U)[\s&&[^\n]]+(?=\n|\z)", ""), r"\n\z", "")


def final_newline(x: Column, policy: str = "ensure") -> Column:
    """ensure: exactly as it is, plus a line feed where there is none; suppress: no line feeds at the end; preserve."""
    if policy == "ensure":
        return F.when(F.endswith(x, F.lit("\n")), x).otherwise(F.concat(x, F.lit("\n")))
    return F.regexp_replace(x, r"\n+\z", "") if policy == "suppress" else x


def fold_nbsp(x: Column) -> Column:
    """No-break, figure and narrow no-break spaces become spaces."""
    return F.translate(x, "\u00a0\u2007\u202f", "   ")


def normalize(x: Column, form: str = "NFC") -> Column:
    """Unicode normalisation (NFC, NFKC, NFD, NFKD); texts in ASCII don't leave the JVM. Arrow's own function doesn't compose
    what it has decomposed, so Python's does the work, a few texts at a time: batches stay in Arrow's memory."""

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for a in range(0, len(batch), 200):
                yield pa.array([None if t is None else unicodedata.normalize(form, t) for t in batch.slice(a, 200).to_pylist()], pa.string())

    # Texts that need nothing are null for the workers.
    wide = x.rlike(r"[^\x00-\x7F]")
    return F.when(wide, run(F.when(wide, x))).otherwise(x)


def yaml_quote(x: Column) -> Column:
    """A double-quoted YAML scalar."""
    steps = (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"))
    return F.concat(F.lit('"'), reduce(lambda c, s: F.replace(c, F.lit(s[0]), F.lit(s[1])), steps, x), F.lit('"'))


def frontmatter(title: Column, description: Column, canonical_url: Column) -> Column:
    """A YAML block of the fields that are set; empty where none is."""
    named = (("title", title), ("description", description), ("canonical_url", canonical_url))
    lines = F.array_compact(F.array(*[F.when(c.isNotNull(), F.concat(F.lit(f"{k}: "), yaml_quote(c))) for k, c in named]))
    return F.when(F.size(lines) > 0, F.concat(F.lit("---\n"), F.array_join(lines, "\n"), F.lit("\n---\n"))).otherwise("")


def escape_mdx(x: Column) -> Column:
    """Backslashes braces, and ``<`` where a JSX tag could begin."""
    return F.regexp_replace(F.regexp_replace(x, r"([{}])", r"\\$1"), r"<(?=[A-Za-z/>])", r"\\<")


def escape_html_like(x: Column) -> Column:
    """Backslashes ``<`` where HTML could begin: a tag, an instruction, a declaration that isn't CDATA."""
    return F.regexp_replace(x, r"<(?=[A-Za-z?]|/[A-Za-z]|!(?!\[CDATA\[|\\\[CDATA\\\[))", r"\\<")


def escape_markdown(x: Column) -> Column:
    """Backslashes what Markdown would read as markup in a line of prose."""
    special = x.rlike(r"^[=~>\-+#0-9]|[\\*_`\[\]]")
    y = F.regexp_replace(x, r"([\\*_`\[\]])", r"\\$1")
    y = F.regexp_replace(y, r"^(?=[=~>]|[-+] |#+ )", r"\\")
    return F.when(special, F.regexp_replace(y, r"^(\p{N}+)\.(?=\.* )", r"$1\\.")).otherwise(x)


def csv_quote(x: Column) -> Column:
    """A CSV field, quoted where it has a comma, quote or line feed."""
    return F.when(x.rlike('[,"\n]'), F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(x)


def fence(x: Column, mark: str = "`") -> Column:
    """The shortest run of three or more marks that the content doesn't have."""
    runs = F.transform(F.regexp_extract_all(x, F.lit(f"({mark}{{3,}})"), F.lit(1)), F.length)
    return F.repeat(F.lit(mark), F.greatest(F.lit(3), F.coalesce(F.array_max(runs), F.lit(0)) + 1))


#: What is unwrapped (first group stays) or removed to get plain text, in this order.
MARKDOWN_STEPS = (
    (r"```[^\n]*\n?([\s\S]*?)```", "$1"),
    (r"~~~[^\n]*\n?([\s\S]*?)~~~", "$1"),
    (r"`([^`]+)`", "$1"),
    (r"!\[([^\]]*)\]\([^)]*\)", "$1"),
    (r"\[([^\]]+)\]\([^)]*\)", "$1"),
    (r"\*\*([^*]+)\*\*", "$1"),
    (r"__([^_]+)__", "$1"),
    (r"\*([^*\n]+)\*", "$1"),
    (r"_([^_\n]+)_", "$1"),
    (r"~~([^~]+)~~", "$1"),
    (r"==([^=\n]+)==", "$1"),
    (r"\+\+([^+\n]+)\+\+", "$1"),
    (r"\^([^^\s]+)\^", "$1"),
    (r"~([^~\s]+)~", "$1"),
    (r"(?m)^#{1,6}\s+", ""),
    (r"(?m)^>\s?", ""),
    (r"(?m)^[-*+]\s+", ""),
    (r"(?m)^\d+\.\s+", ""),
    (r"(?m)^---+\s*$", ""),
)
#: Fixed value: Unicode's white space, for character classes.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_BLANKS = "".join(map(chr, [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
#: Escaped punctuation waits in the private-use area while markup is removed.
HIDDEN = "".join(chr(0xE100 + ord(c)) for c in PUNCTUATION)


#: What a text must hold for a step to do anything, in the steps' order; None where there is no such string.
_MARKS = ("```", "~~~", "`", "![", "](", "**", "__", "*", "_", "~~", "==", "++", "^", "~", "#", ">", None, None, "---")


def _where(x: Column, mark: str | None, f: Callable[[Column], Column]) -> Column:
    """``f`` of the texts that hold the mark; the text is bound once, so steps don't multiply the expression."""
    if mark is None:
        return f(x)
    return F.transform(F.array(x), lambda v: F.when(v.contains(mark), f(v)).otherwise(v))[0]


def strip_markdown(x: Column) -> Column:
    """Plain text of Markdown: markup goes, backslash escapes become what they stand for, blank lines collapse. White
    space and digits are Unicode's."""

    def hide(v: Column) -> Column:
        pairs = sorted(zip(PUNCTUATION, HIDDEN, strict=True), key=lambda p: p[0] != "\\")
        return reduce(lambda y, ch: F.replace(y, F.lit("\\" + ch[0]), F.lit(ch[1])), pairs, v)

    x = _where(x, "\\", hide)
    for (pattern, to), mark in zip(MARKDOWN_STEPS, _MARKS, strict=True):
        # Classes are Unicode's only where a pattern has one.
        wide = "U" if "\\s" in pattern or "\\d" in pattern else ""
        flags = f"(?{wide}md)" if pattern.startswith("(?m)") else f"(?{wide})" if wide else ""
        x = _where(x, mark, lambda v, p=flags + pattern.removeprefix("(?m)"), t=to: F.regexp_replace(v, p, t))
    x = F.translate(x, HIDDEN, PUNCTUATION)
    x = F.btrim(x, F.lit(_BLANKS))
    return _where(x, "\n\n\n", lambda v: F.regexp_replace(v, r"\n{3,}", "\n\n"))
