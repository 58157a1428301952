"""Conversion of one document, and of tables of documents."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyrine.html.clean import bad_selectors, check_limits, clean, metadata
from papyrine.html.dom import HEADINGS, Node, parse, serialize
from papyrine.html.render import Renderer, mdx, plain_text, post_process, yaml_block
from papyrine.options import Options

#: Levels that are rendered where no limit of depth is set; deeper documents have an error.
DEEP = 10_000
META = "title string, description string, canonical_url string, og_title string, og_description string, og_image string, twitter_title string, twitter_description string"
SCHEMA = f"markdown string, {META}, diagnostics array<struct<kind:string,message:string,rule:string>>, error string"


class Backend(Protocol):
    """What turns a cleaned tree into Markdown; it must be picklable to go to the workers."""

    def render(self, root: Node, o: Options) -> str: ...


class NativeBackend:
    """The engine's own renderer."""

    def render(self, root: Node, o: Options) -> str:
        return Renderer(o).document(root)


def convert(html: str, o: Options | None = None, backend: Backend | None = None) -> dict:
    """Markdown, metadata and diagnostics of an HTML text; strict options raise on a limit."""
    o = o or Options()
    # Rendering takes a few calls for each level; Python's own calls need no more than memory.
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 8 * (o.max_dom_depth or DEEP) + 1000))
    root = parse(html)
    found = bad_selectors(o) + check_limits(root, o, len(html.encode("utf-8", "surrogatepass")))
    meta = {k: v if o.metadata is None or k in o.metadata else None for k, v in metadata(root).items()}
    clean(root, o)
    s = post_process((backend or NativeBackend()).render(root, o), o)
    if o.profile == "plain-text":
        s = plain_text(s)
    elif o.profile == "mdx-safe":
        s = mdx(s)
    elif o.profile == "obsidian":
        s = yaml_block(meta) + s
    if o.max_output_bytes and len(s.encode("utf-8", "surrogatepass")) > o.max_output_bytes:
        if o.strict:
            raise ValueError("max-output-bytes")
        found.append(("max-output-bytes", f"output has {len(s.encode())} bytes"))
    return {"markdown": s, **meta, "diagnostics": [{"kind": "warning", "message": m, "rule": r} for r, m in found]}


def clean_html(html: str, o: Options | None = None) -> str:
    root = parse(html)
    clean(root, o or Options())
    return serialize(root)


def _rows(html: pd.Series, o: Options, backend: Backend | None) -> list[dict]:
    out = []
    for x in html:
        try:
            out.append({**convert(x or "", o, backend), "error": None})
        except Exception as e:  # one document must not fail the others, whatever it is that it trips over
            out.append({"error": f"{type(e).__name__}: {e}", "diagnostics": []})
    return out


def convert_table(docs: DataFrame, o: Options | None = None, html: str = "html", partitions: int | None = None, backend: Backend | None = None) -> DataFrame:
    """``docs`` with a column ``result`` (Markdown, metadata, diagnostics, error) in place of its HTML.

    One Arrow-batched pass, without state, so it serves streams as well; results leave a few documents at a time. A document
    that can't be converted has an error instead of failing the job. Null HTML is empty. Small inputs that scan as one partition are spread first.
    """
    o = o or Options()
    if partitions:
        docs = docs.repartition(partitions)

    @F.pandas_udf(SCHEMA)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in f"markdown string, {META}".split(", ")] + ["diagnostics", "error"]
        for part in _parts(batches):
            done = _rows(part, o, backend)
            yield pd.DataFrame({n: pd.Series([r.get(n) for r in done], dtype=object) for n in names})

    # Not deterministic as far as the optimizer goes: a struct that is used twice is still made once.
    return docs.withColumn("result", run.asNondeterministic()(F.col(html))).drop(html)


def _tried(f, otherwise):
    """One document must not fail the others: what it trips over gives ``otherwise``."""
    try:
        return f()
    except Exception:
        return otherwise


def metadata_table(docs: DataFrame, html: str = "html", bare: bool = True) -> DataFrame:
    """``docs`` with a column ``meta`` (the eight metadata fields) in place of its HTML; parsed, neither cleaned nor rendered.
    Without ``bare``, here and below, references need their semicolon."""

    @F.pandas_udf(META)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in _parts(batches):
            done = [_tried(lambda x=x: metadata(parse(x or "", bare)), {}) for x in part]
            yield pd.DataFrame({n: pd.Series([r.get(n) for r in done], dtype=object) for n in (f.split()[0] for f in META.split(", "))})

    return docs.withColumn("meta", run.asNondeterministic()(F.col(html))).drop(html)


def clean_table(docs: DataFrame, o: Options | None = None, html: str = "html") -> DataFrame:
    """``docs`` with a column ``cleaned`` (HTML after all rewrites; null where the document fails) in place of its HTML."""
    o = o or Options()

    def one(x: str) -> str | None:
        try:
            return clean_html(x or "", o)
        except Exception:
            return None

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in _parts(batches):
            yield pd.Series([one(x) for x in part], dtype=object)

    return docs.withColumn("cleaned", run(F.col(html))).drop(html)


def _parts(batches: Iterator, rows: int = 200) -> Iterator:
    """Batches a few documents at a time, as what is found in a document takes many times its room."""
    for batch in batches:
        for a in range(0, len(batch), rows):
            yield batch.iloc[a : a + rows]


def _found(docs: DataFrame, key: str, html: str, rows, schema: str, bare: bool = True) -> DataFrame:
    """A row for each thing that ``rows`` finds in a document's tree, with the document's key."""
    kind = docs.schema[key].dataType.simpleString()
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches):
        for batch in _parts(batches):
            out = [(k, *r) for k, h in zip(batch[key], batch[html], strict=True) for r in _tried(lambda h=h: rows(parse(h or "", bare)), [])]
            yield pd.DataFrame(out, columns=[key, *names])

    return docs.select(key, html).mapInPandas(run, f"{key} {kind}, {schema}")


def links(docs: DataFrame, key: str, html: str = "html") -> DataFrame:
    """The anchors of documents in order: key, ord, href, text, title, rel (null where an attribute isn't there)."""

    def rows(root):
        found = [n for n in root.elements() if n.tag == "a" and "href" in n.attrs]
        return [(i, n.attrs["href"], n.inner_text().strip(), n.attrs.get("title"), n.attrs.get("rel")) for i, n in enumerate(found)]

    return _found(docs, key, html, rows, "ord int, href string, text string, title string, rel string")


def headings(docs: DataFrame, key: str, html: str = "html", bare: bool = True) -> DataFrame:
    """The headings of documents in order: key, ord, level, text."""

    def rows(root):
        return [(i, int(n.tag[1]), " ".join(n.inner_text().split())) for i, n in enumerate(n for n in root.elements() if n.tag in HEADINGS)]

    return _found(docs, key, html, rows, "ord int, level int, text string", bare)


def tables(docs: DataFrame, key: str, html: str = "html") -> DataFrame:
    """The cells of documents' tables: key, table, row, cell, header, text; cells of an inner table are its own."""

    def rows(root):
        at: dict[int, list[int]] = {}
        order = [n for n in root.elements() if n.tag == "table"]
        number = {id(t): i for i, t in enumerate(order)}
        out = []
        for n in root.elements():
            if n.tag not in ("tr", "td", "th"):
                continue
            t = next((a for a in n.ancestors() if a.tag == "table"), None)
            if t is None:
                continue
            place = at.setdefault(id(t), [-1, -1])
            if n.tag == "tr":
                place[0], place[1] = place[0] + 1, -1
            else:
                place[1] += 1
                out.append((number[id(t)], place[0], place[1], n.tag == "th", " ".join(n.inner_text().split())))
        return out

    return _found(docs, key, html, rows, "table int, row int, cell int, header boolean, text string")


def node_rows(html: str, tags: frozenset[str] | None = None, bare: bool = True) -> list[tuple]:
    """(id, parent, depth, ord, tag, attrs, text, end) of every element, text and comment in document order, or of some tags
    alone. A node's descendants are those whose ids lie after its own, up to ``end``."""
    found, out = [], []
    todo = [(c, -1, 1, i) for i, c in reversed(list(enumerate(parse(html or "", bare).children)))]
    while todo:
        n, up, depth, at = todo.pop()
        own = len(found)
        found.append((n, up, depth, at))
        todo.extend((c, own, depth + 1, i) for i, c in reversed(list(enumerate(n.children))))
    size = [1] * len(found)
    for own in range(len(found) - 1, -1, -1):
        if (up := found[own][1]) >= 0:
            size[up] += size[own]
    for own, (n, up, depth, at) in enumerate(found):
        if tags is None or n.tag in tags:
            out.append((own, up, depth, at, n.tag, [(k, v) for k, v in n.attrs.items()], n.text, own + size[own] - 1))
    return out


NODE = "id int, parent int, depth int, ord int, tag string, attrs array<struct<name:string,value:string>>, text string, end int"


def _whole(key, f):
    """What a document gives; one that can't be read fails the job by its key, as without rows it would look like one that has none."""
    try:
        return f()
    except Exception as e:
        raise ValueError(f"document {key!r} can't be parsed: {type(e).__name__}: {e}") from e


def dom_nodes(docs: DataFrame, key: str, html: str = "html", tags: tuple[str, ...] | None = None, bare: bool = True) -> DataFrame:
    """A row for each node: the key, id, parent (-1: none), depth, ord, tag (null: text, !: comment), attrs, text, end. With
    ``tags``, only elements with these leave the workers. Null HTML is empty. Every text has a tree; a document whose parsing fails all
    the same fails the job.

    ``papyrine.plans.nodes`` has what joins, prunes and selects these rows; there the key must be one document's.
    """
    wanted = None if tags is None else frozenset(tags)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for batch in _parts(batches):
            rows = [(k, *r[:5], [{"name": a, "value": v} for a, v in r[5]], *r[6:]) for k, h in zip(batch[key], batch[html], strict=True) for r in _whole(k, lambda h=h: node_rows(h, wanted, bare))]
            yield pd.DataFrame(rows, columns=[key, *(f.split()[0] for f in NODE.replace("struct<name:string,value:string>", "x").split(", "))])

    return docs.select(key, html).mapInPandas(run, f"{key} {kind}, {NODE}")
