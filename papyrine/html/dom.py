"""A small HTML tree: forgiving parse in the manner of the WHATWG algorithm, selectors and serialization."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import escape, unescape
from html.entities import html5

#: Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta source track wbr param".split())
RAW = frozenset("script style xmp iframe noembed noframes noscript".split())
RCDATA = frozenset(("title", "textarea"))
HEAD = frozenset("base link meta title style script noscript template".split())
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form header hgroup main menu nav ol p pre search section summary table ul hr h1 h2 h3 h4 h5 h6 li dd dt".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
SCOPE = frozenset("html table td th caption template marquee object applet".split())
SPECIAL = frozenset("address article aside blockquote body caption center col colgroup dd details dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup html iframe li main menu nav noscript object ol p pre section select summary table tbody td template tfoot th thead tr ul".split())
IMPLIED = frozenset("dd dt li optgroup option p rb rp rt rtc".split())
TABLE_PARTS = frozenset("caption colgroup col tbody tfoot thead tr td th".split())

_TOKEN = re.compile(r"<!--(.*?)(?:-->|--!>|\Z)|<!--?>|<(?:[!?]|/(?![A-Za-z]))([^>]*)(?:>|\Z)|<(/?)([A-Za-z][^\t\n\f\r />]*)", re.S)
_ATTR = re.compile(r"""[\s/]*(>|([^\s/>=][^\s/>=]*|=[^\s/>=]*)(?:\s*=\s*(?:"([^"]*)(?:"|\Z)|'([^']*)(?:'|\Z)|([^\s>]*)))?)""")
_REF = re.compile(r"&(#[0-9]+;?|#[xX][0-9A-Fa-f]+;?|[A-Za-z][A-Za-z0-9]*;?)(?![=A-Za-z0-9]|(?<!;)=)|&[A-Za-z0-9#]+;")
_CLOSED = re.compile(r"&(#[0-9]+|#[xX][0-9A-Fa-f]+|[A-Za-z][A-Za-z0-9]*);")
_DIGITS = re.compile(r"&#0*([0-9]{1,8})[0-9]*")


class Node:
    """An element (tag), text (tag None) or comment (tag '!')."""

    __slots__ = ("tag", "attrs", "children", "parent", "text")

    def __init__(self, tag: str | None, attrs: dict[str, str] | None = None, text: str = ""):
        self.tag, self.attrs, self.children, self.parent, self.text = tag, attrs or {}, [], None, text

    def append(self, child: Node) -> None:
        child.detach()
        child.parent = self
        self.children.append(child)

    def insert_before(self, child: Node, ref: Node) -> None:
        child.detach()
        child.parent = self
        self.children.insert(self.index(ref), child)

    def index(self, child: Node) -> int:
        return next(i for i, c in enumerate(self.children) if c is child)

    def detach(self) -> None:
        if self.parent is not None:
            del self.parent.children[self.parent.index(self)]
            self.parent = None

    def unwrap(self) -> None:
        """Puts the children, in order, where the element is."""
        at, parent = self.parent.index(self), self.parent
        parent.children[at : at + 1] = self.children
        for c in self.children:
            c.parent = parent
        self.children, self.parent = [], None

    def replace_text(self, text: str) -> None:
        node = Node(None, text=text)
        node.parent = self.parent
        self.parent.children[self.parent.index(self)] = node
        self.parent = None

    def walk(self) -> Iterator[Node]:
        """This node and all below, in document order, without recursion."""
        todo = [self]
        while todo:
            n = todo.pop()
            yield n
            todo.extend(reversed(n.children))

    def elements(self) -> Iterator[Node]:
        return (n for n in self.walk() if n.tag and n.tag[0] not in "!#")

    def inner_text(self) -> str:
        return "".join(n.text for n in self.walk() if n.tag is None)

    def ancestors(self) -> Iterator[Node]:
        n = self.parent
        while n is not None:
            yield n
            n = n.parent

    def element_children(self) -> list[Node]:
        return [c for c in self.children if c.tag and c.tag[0] not in "!#"]


def _text(raw: str) -> str:
    """``unescape`` for numbers of any length: Python reads none of more than 4,300 digits, and none of eight is a character."""
    return unescape(_DIGITS.sub(r"&#\1", raw) if "&#" in raw else raw)


def _attr_text(raw: str) -> str:
    return _REF.sub(lambda m: _text(m[0]), raw) if "&" in raw else raw


def _closed_text(raw: str) -> str:
    return _CLOSED.sub(lambda m: _text(m[0]) if m[1][0] == "#" or f"{m[1]};" in html5 else m[0], raw) if "&" in raw else raw


def tokens(html: str, bare: bool = True) -> Iterator[tuple]:
    """('text', s), ('start', tag, attrs, self-closing), ('end', tag), ('comment', s). References without a semicolon count
    as the standard has it, or, without ``bare``, are text."""
    decoded, value_of = (_text, _attr_text) if bare else (_closed_text, _closed_text)
    html = html.replace("\r\n", "\n").replace("\r", "\n")
    at, n = 0, len(html)
    while at < n:
        m = _TOKEN.search(html, at)
        if not m:
            yield ("text", decoded(html[at:]))
            return
        if m.start() > at:
            yield ("text", decoded(html[at : m.start()]))
        at = m.end()
        if m[4] is None:
            if m[1] is not None or m[2] is None:
                yield ("comment", m[1] or "")
            elif not m[2].lower().startswith("doctype") and m[0] != "</>":
                yield ("comment", m[2])
            continue
        tag, attrs, closed = m[4].lower(), {}, False
        while at < n:
            a = _ATTR.match(html, at)
            if not a:
                at = n
                break
            closed = a[1] == ">" and html[max(0, a.start(1) - 1)] == "/"
            at = a.end()
            if a[1] == ">":
                break
            name = a[2].lower()
            value = next((g for g in a.groups()[2:] if g is not None), "")
            attrs.setdefault(name, value_of(value))
        else:
            return
        if m[3]:
            yield ("end", tag)
            continue
        yield ("start", tag, attrs, closed)
        if tag in RAW or tag in RCDATA:
            end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(html, at)
            stop = end.start() if end else n
            if stop > at:
                yield ("text", html[at:stop] if tag in RAW else decoded(html[at:stop]))
            at = stop
        elif tag == "plaintext":
            yield ("text", html[at:])
            return


class _Builder:
    def __init__(self):
        self.root = Node("#document")
        self.html, self.head, self.body = Node("html"), Node("head"), Node("body")
        self.root.append(self.html)
        self.html.append(self.head)
        self.html.append(self.body)
        self.stack = [self.html, self.body]
        self.active: list[Node | None] = []
        self.in_head: Node | None = None
        self.started = False

    # -- the stack of open elements
    def open(self, names, stop=SCOPE) -> Node | None:
        for n in reversed(self.stack):
            if n.tag in names:
                return n
            if n.tag in stop:
                return None
        return None

    def pop_to(self, node: Node) -> None:
        while self.stack.pop() is not node:
            pass

    def close_implied(self, but: str = "") -> None:
        while self.stack[-1].tag in IMPLIED and self.stack[-1].tag != but:
            self.stack.pop()

    def close_p(self) -> None:
        if p := self.open(("p",), SCOPE | {"button"}):
            self.pop_to(p)

    def place(self) -> tuple[Node, Node | None]:
        """Where a node goes: (parent, before). What can't stand in a table goes before it."""
        top = self.stack[-1]
        if top.tag in ("table", "tbody", "tfoot", "thead", "tr"):
            for i in range(len(self.stack) - 1, 0, -1):
                if self.stack[i].tag == "table":
                    t = self.stack[i]
                    return (t.parent, t) if t.parent is not None else (self.stack[i - 1], None)
        return top, None

    def put(self, node: Node, foster: bool = True) -> None:
        parent, before = self.place() if foster else (self.stack[-1], None)
        if before is None:
            parent.append(node)
        else:
            parent.insert_before(node, before)

    def push(self, tag: str, attrs: dict, foster: bool = True) -> Node:
        node = Node(tag, dict(sorted(attrs.items())))
        self.put(node, foster)
        self.stack.append(node)
        return node

    def reconstruct(self) -> None:
        """Opens again the formatting elements that are still in force."""
        i = len(self.active)
        while i and self.active[i - 1] is not None and not any(n is self.active[i - 1] for n in self.stack):
            i -= 1
        for k in range(i, len(self.active)):
            old = self.active[k]
            self.active[k] = self.push(old.tag, old.attrs)

    def activate(self, node: Node) -> None:
        same = []
        for n in reversed(self.active):
            if n is None:
                break
            if n.tag == node.tag and n.attrs == node.attrs:
                same.append(n)
        if len(same) >= 3:
            self.active = [n for n in self.active if n is not same[-1]]
        self.active.append(node)

    def adopt(self, tag: str) -> None:
        """The adoption agency algorithm for a formatting end tag."""
        if self.stack[-1].tag == tag and not any(n is self.stack[-1] for n in self.active):
            self.stack.pop()
            return
        for _ in range(8):
            fmt = None
            for n in reversed(self.active):
                if n is None:
                    break
                if n.tag == tag:
                    fmt = n
                    break
            if fmt is None:
                self.end_other(tag)
                return
            if not any(n is fmt for n in self.stack):
                self.active = [n for n in self.active if n is not fmt]
                return
            at = next(i for i, n in enumerate(self.stack) if n is fmt)
            if any(n.tag in SCOPE for n in self.stack[at + 1 :]):
                return
            far = next((n for n in self.stack[at + 1 :] if n.tag in SPECIAL), None)
            if far is None:
                self.pop_to(fmt)
                self.active = [n for n in self.active if n is not fmt]
                return
            common, mark, last = self.stack[at - 1], next(i for i, n in enumerate(self.active) if n is fmt), far
            k = next(i for i, n in enumerate(self.stack) if n is far)
            for count in range(1, len(self.stack)):
                k -= 1
                node = self.stack[k]
                if node is fmt:
                    break
                known = next((i for i, n in enumerate(self.active) if n is node), None)
                if known is not None and count > 3:
                    del self.active[known]
                    mark -= known < mark
                    known = None
                if known is None:
                    del self.stack[k]
                    continue
                fresh = Node(node.tag, node.attrs)
                self.active[known] = self.stack[k] = fresh
                if last is far:
                    mark = known + 1
                fresh.append(last)
                last = fresh
            if common.tag in ("table", "tbody", "tfoot", "thead", "tr"):
                keep, self.stack = self.stack, self.stack[: at]
                last.detach()
                self.put(last)
                self.stack = keep
            else:
                common.append(last)
            fresh = Node(fmt.tag, fmt.attrs)
            for c in list(far.children):
                fresh.append(c)
            far.append(fresh)
            gone = next(i for i, n in enumerate(self.active) if n is fmt)
            del self.active[gone]
            self.active.insert(mark - (gone < mark), fresh)
            self.stack = [n for n in self.stack if n is not fmt]
            self.stack.insert(next(i for i, n in enumerate(self.stack) if n is far) + 1, fresh)

    def end_other(self, tag: str) -> None:
        for n in reversed(self.stack[2:]):
            if n.tag == tag:
                self.close_implied(tag)
                self.pop_to(n)
                return
            if n.tag in SPECIAL:
                return

    def clear_marker(self) -> None:
        while self.active and self.active.pop() is not None:
            pass

    # -- tokens
    def text(self, s: str) -> None:
        if self.in_head is not None:
            self.in_head.append(Node(None, text=s))
            return
        if not self.started:
            s = s.lstrip(" \t\n\f\r")
            if not s:
                return
            self.started = True
        top = self.stack[-1]
        if top.tag not in RAW and top.tag not in RCDATA:
            if not (top.tag in ("table", "tbody", "tfoot", "thead", "tr") and not s.strip()):
                self.reconstruct()
        top = self.stack[-1]
        parent, before = self.place() if s.strip() else (top, None)
        near = parent.children[parent.index(before) - 1] if before is not None and parent.index(before) else (parent.children[-1] if before is None and parent.children else None)
        if near is not None and near.tag is None:
            near.text += s
        elif before is None:
            parent.append(Node(None, text=s))
        else:
            parent.insert_before(Node(None, text=s), before)

    def comment(self, s: str) -> None:
        (self.stack[-1] if self.started else self.html).append(Node("!", text=s))

    def start(self, tag: str, attrs: dict, closed: bool) -> None:
        if tag in ("html", "body", "head"):
            to = {"html": self.html, "body": self.body}.get(tag)
            if to is not None:
                for k, v in attrs.items():
                    to.attrs.setdefault(k, v)
                to.attrs = dict(sorted(to.attrs.items()))
            self.started = self.started or tag == "body"
            return
        if not self.started and tag in HEAD:
            node = Node(tag, dict(sorted(attrs.items())))
            self.head.append(node)
            if tag not in VOID:
                self.in_head = node
            return
        self.in_head, self.started = None, True
        if tag in TABLE_PARTS:
            return self.table_part(tag, attrs)
        if tag in CLOSES_P:
            self.close_p()
        if tag in HEADINGS and self.stack[-1].tag in HEADINGS:
            self.stack.pop()
        if tag in ("li", "dd", "dt"):
            ends = ("li",) if tag == "li" else ("dd", "dt")
            for n in reversed(self.stack):
                if n.tag in ends:
                    self.close_implied(n.tag)
                    self.pop_to(n)
                    break
                if n.tag in SPECIAL and n.tag not in ("address", "div", "p"):
                    break
            self.close_p()
        if tag in ("option", "optgroup") and self.stack[-1].tag == "option":
            self.stack.pop()
        if tag == "button" and (b := self.open(("button",))):
            self.pop_to(b)
        if tag == "a":
            for n in reversed(self.active):
                if n is None:
                    break
                if n.tag == "a":
                    self.adopt("a")
                    self.active = [x for x in self.active if x is not n]
                    self.stack = [x for x in self.stack if x is not n]
                    break
        if tag in FORMATTING:
            self.reconstruct()
            if tag == "nobr" and self.open(("nobr",)):
                self.adopt("nobr")
                self.reconstruct()
            self.activate(self.push(tag, attrs))
            return
        if tag not in CLOSES_P and tag not in RAW and tag not in ("textarea", "title", "param", "source", "track"):
            self.reconstruct()
        self.push("img" if tag == "image" else tag, attrs, foster=not (tag in ("script", "style", "template") or (tag == "input" and attrs.get("type", "").lower() == "hidden")))
        if tag in VOID or closed and self.stack[-1].tag in VOID | {"img"} or tag == "image" or closed and self.open(("svg", "math")):
            self.stack.pop()
        elif tag in ("applet", "marquee", "object"):
            self.active.append(None)

    def table_part(self, tag: str, attrs: dict) -> None:
        table = self.open(("table",), frozenset(("html", "template")))
        if table is None:
            return
        back = {"tr": ("table", "tbody", "tfoot", "thead"), "td": ("tr", "table", "tbody", "tfoot", "thead"), "col": ("colgroup", "table")}
        stop = back.get("td" if tag == "th" else tag, ("table",))
        while self.stack[-1].tag not in stop:
            if self.stack.pop().tag in ("td", "th", "caption"):
                self.clear_marker()
        if tag in ("tr", "td", "th") and self.stack[-1].tag == "table":
            self.push("tbody", {}, False)
        if tag in ("td", "th") and self.stack[-1].tag != "tr":
            self.push("tr", {}, False)
        if tag == "col" and self.stack[-1].tag == "table":
            self.push("colgroup", {}, False)
        self.push(tag, attrs, False)
        if tag == "col":
            self.stack.pop()
        elif tag in ("td", "th", "caption"):
            self.active.append(None)

    def end(self, tag: str) -> None:
        if self.in_head is not None and self.in_head.tag == tag:
            self.in_head = None
            return
        if tag in ("html", "body", "head"):
            return
        if tag == "br":
            return self.start("br", {}, False)
        if not self.started:
            return
        if tag == "p":
            if not self.open(("p",), SCOPE | {"button"}):
                self.push("p", {})
            self.close_p()
        elif tag in FORMATTING:
            self.adopt(tag)
        elif tag in HEADINGS:
            if h := self.open(HEADINGS):
                self.pop_to(h)
        elif tag in TABLE_PARTS or tag == "table":
            if n := self.open((tag,), frozenset(("html", "template", "table")) - {tag}):
                while True:
                    top = self.stack.pop()
                    if top.tag in ("td", "th", "caption"):
                        self.clear_marker()
                    if top is n:
                        break
        elif tag in SPECIAL or tag in ("button", "object", "applet", "marquee"):
            stop = SCOPE | {"ol", "ul"} if tag == "li" else SCOPE
            if n := self.open((tag,), stop - {tag}):
                self.pop_to(n)
                if tag in ("object", "applet", "marquee"):
                    self.clear_marker()
        else:
            self.end_other(tag)


def parse(html: str, bare: bool = True) -> Node:
    """The document node of an HTML text; every text has one. ``bare`` is that of ``tokens``."""
    b = _Builder()
    for t in tokens(html, bare):
        getattr(b, t[0])(*t[1:])
    return b.root


def serialize(node: Node) -> str:
    out: list[str] = []
    todo: list = [node]
    while todo:
        n = todo.pop()
        if isinstance(n, str):
            out.append(n)
        elif n.tag is None:
            out.append(n.text if n.parent is not None and n.parent.tag in RAW else escape(n.text, quote=False).replace("\u00a0", "&nbsp;"))
        elif n.tag == "!":
            out.append(f"<!--{n.text}-->")
        else:
            if n.tag != "#document":
                out.append(f"<{n.tag}" + "".join(f' {k}="{escape(v, quote=False).replace(chr(34), "&quot;")}"' for k, v in n.attrs.items()) + ">")
                if n.tag in VOID:
                    continue
                todo.append(f"</{n.tag}>")
            todo.extend(reversed(n.children))
    return "".join(out)
