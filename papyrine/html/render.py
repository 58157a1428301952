"""Renders a cleaned document as Markdown: one function for each kind of element, text joined at its seams."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

from papyrine.functions import text as T
from papyrine.html.clean import rule_of
from papyrine.html.dom import HEADINGS, Node, serialize
from papyrine.options import EXTENDED, Options

#: Elements that are set off as blocks.
BLOCKS = frozenset("address article aside base basefont blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frame frameset h1 h2 h3 h4 h5 h6 head header hr html iframe legend li link main menu menuitem nav noframes ol optgroup option p param pre script search section source style summary table tbody td textarea tfoot th thead title tr track ul".split())
_SPACES = re.compile(r"[ \t\n\r\f]+")
_PLAIN = re.compile(r"[A-Za-z](?:[^\\*_`\[\]<\s]|(?<! ) (?! ))*")
_HTML = re.compile(r"<(?=[A-Za-z?]|/[A-Za-z]|!(?!\[CDATA\[|\\\[CDATA\\\[))")
_INLINE_MARKS = re.compile(r"([\\*_`\[\]])")
_WRAPS = {"strong": "**", "b": "**", "em": "*", "i": "*"}
_EXTRA = {"mark": "==", "ins": "++", "sub": "~", "sup": "^"}


def escape_text(s: str) -> str:
    """Backslashes what Markdown or HTML would read as markup."""
    if not s:
        return s
    if s[0] in "=~>-+#0123456789" or _INLINE_MARKS.search(s):
        s = _INLINE_MARKS.sub(r"\\\1", s)
        if s[0] in "=~>" or re.match(r"[-+] |#+ ", s):
            s = "\\" + s
        elif m := re.match(r"(\d+)\.(?=\.* )", s):
            s = f"{m[1]}\\.{s[m.end():]}"
    return _HTML.sub(r"\\<", s)


def join(left: str, right: str) -> str:
    """Two pieces of output: at the seam at most two line feeds, and one of two spaces."""
    if not left or not right:
        return left + right
    a, b = left.rstrip("\n"), right.lstrip("\n")
    n = len(left) - len(a) + len(right) - len(b)
    if n and (len(a) < len(left) and len(b) < len(right)):
        n = min(2, max(len(left) - len(a), len(right) - len(b)))
    if not n and left[-1] == " " and right[0] == " ":
        return left + right[1:]
    return a + "\n" * min(2, n) + b


def block(s: str) -> str:
    return f"\n\n{s}\n\n" if s else ""


def indent(s: str, pad: str) -> str:
    first, *rest = s.split("\n")
    return "\n".join([first, *((pad + x.rstrip()) if x.strip() else "" for x in rest)])


def csv_field(s: str) -> str:
    return '"' + s.replace('"', '""') + '"' if re.search('[,"\n]', s) else s


def fence_for(content: str, mark: str) -> str:
    runs = [len(m) for m in re.findall(re.escape(mark) + "{3,}", content)]
    return mark * (max(runs) + 1 if runs else 3)


class Renderer:
    """Holds what one document gathers while it is rendered."""

    def __init__(self, o: Options):
        self.o = o
        self.extended = o.profile in EXTENDED
        self.gfm = self.extended or o.profile == "gfm"
        self.links: list[str] = []
        self.images: list[str] = []
        #: Definitions that wait for the next heading, and how many references have been made, where placement isn't "end".
        self.waiting: list[str] = []
        self.made = 0
        self.in_pre = 0
        self.by_tag: dict[str, Callable[[Node], str]] = {
            "br": lambda n: "\\\n" if o.hard_break_style == "backslash" else "  \n",
            "hr": lambda n: block({"dashes": "- - -", "asterisks": "* * *", "underscores": "_ _ _"}[o.hr_style]),
            "p": lambda n: block(self.inside(n).strip("\n")),
            "a": self.anchor, "img": self.image, "ul": self.listing, "ol": self.listing, "li": self.item,
            "blockquote": self.quote, "pre": self.pre, "code": self.code, "table": self.table, "span": self.span,
            "input": self.checkbox, "x-rule": self.custom, "script": self.script, "math": self.mathml,
        }
        for t in HEADINGS:
            self.by_tag[t] = self.heading
        for t in _WRAPS:
            self.by_tag[t] = lambda n: self.wrapped(n, _WRAPS[n.tag])
        if self.gfm:
            for t in ("del", "s", "strike"):
                self.by_tag[t] = lambda n: self.wrapped(n, "~~")
        if self.extended:
            for t in _EXTRA:
                self.by_tag[t] = self.extra
            for t in ("samp", "var"):
                self.by_tag[t] = lambda n: f"`{self.inside(n)}`"
            self.by_tag["q"] = lambda n: f'"{self.inside(n)}"'
            self.by_tag["cite"] = lambda n: self.wrapped(n, "*")
            self.by_tag["address"] = lambda n: block(self.inside(n).strip())
            if o.profile != "mdx-safe":
                self.by_tag["kbd"] = lambda n: f"<kbd>{self.inside(n)}</kbd>"
        if o.definition_lists:
            self.by_tag["dl"] = self.definitions
        self.by_tag["div"] = self.div

    def document(self, root: Node) -> str:
        out = self.inside(root).strip("\n")
        for part in (self.waiting, self.links, self.images):
            if part:
                out += "\n\n" + "\n".join(part)
        return out.rstrip("\n")

    # -- the walk
    def inside(self, node: Node) -> str:
        is_block = node.tag in BLOCKS or node.tag == "#document"
        own = node.tag in ("pre", "code")
        self.in_pre += own
        pre = self.in_pre > 0
        out, trim = "", is_block and not pre
        for child in self.merged(node.children):
            if child.tag == "!":
                continue
            if child.tag is None:
                new = self.text(child, pre, trim, out)
            else:
                if child.tag in BLOCKS:
                    out = out.rstrip(" ")
                new = self.element(child)
            out = join(out, new)
            if new:
                trim = child.tag in BLOCKS and not pre
        self.in_pre -= own
        return out.rstrip(" \t\r\n") if node.tag == "#document" else out

    def text(self, n: Node, pre: bool, trim: bool, out: str) -> str:
        if pre:
            return n.text
        s = n.text if _PLAIN.fullmatch(n.text) else _SPACES.sub(" ", escape_text(n.text))
        return s.lstrip(" ") if trim or s[:1] == " " and out[-1:] in (" ", "\n") else s

    def merged(self, children: list[Node]) -> list[Node]:
        """Neighbours that are the same inline element around one text are one."""
        out: list[Node] = []
        for c in children:
            p = out[-1] if out else None
            same = {"b": "strong", "i": "em"}
            if (
                p is not None and c.tag and p.tag and c.tag not in BLOCKS and c.tag not in ("a", "template") and c.tag[0] not in "!#"
                and same.get(c.tag, c.tag) == same.get(p.tag, p.tag) and c.attrs == p.attrs
                and len(c.children) == 1 == len(p.children) and c.children[0].tag is None and p.children[0].tag is None
            ):
                both = Node(p.tag, p.attrs)
                both.append(Node(None, text=p.children[0].text + c.children[0].text))
                both.parent = c.parent
                out[-1] = both
            else:
                out.append(c)
        return out

    def element(self, n: Node) -> str:
        if handler := self.by_tag.get(n.tag):
            return handler(n)
        inner = self.inside(n)
        return block(inner.strip("\n")) if n.tag in BLOCKS else inner

    # -- elements
    def heading(self, n: Node) -> str:
        before, self.waiting = (self.waiting, []) if self.o.reference_placement == "section-end" else ([], self.waiting)
        flushed = block("\n".join(before))
        s = self.inside(n)
        s, level = (s if "\n\n" in s else _SPACES.sub(" ", s)).strip(), int(n.tag[1])
        if not s:
            return flushed
        made = f"{s}\n{'=-'[level - 1] * len(s)}" if self.o.heading_style == "setext" and level < 3 else f"{'#' * level} {s}"
        return join(flushed, block(made))

    def wrapped(self, n: Node, mark: str) -> str:
        s = self.inside(n)
        core = s.strip()
        if not core:
            return ""
        at = s.index(core)
        return s[:at] + mark + core + mark + s[at + len(core) :]

    def extra(self, n: Node) -> str:
        link = [c for c in n.children if c.tag or c.text.strip()]
        if n.tag == "sup" and self.o.footnotes and len(link) == 1 and link[0].tag == "a" and link[0].attrs.get("href", "").startswith("#fn"):
            return f"[^{link[0].attrs['href'][3:].lstrip('-:_')}]"
        s = self.inside(n)
        return f"{_EXTRA[n.tag]}{s}{_EXTRA[n.tag]}" if s.strip() else ""

    def anchor(self, n: Node) -> str:
        label = self.inside(n)
        href = n.attrs.get("href")
        if href is None:
            return label
        if self.o.profile == "obsidian" and ("wikilink" in n.attrs.get("class", "").split() or n.attrs.get("rel") == "wikilink"):
            return f"[[{href}]]" if label.strip() in ("", href) else f"[[{href}|{label.strip()}]]"
        title = n.attrs.get("title", "").replace('"', '\\"')
        if self.o.link_style == "reference" and self.o.reference_placement != "end":
            return self.referred(f"[{label.strip().replace(']', chr(92) + ']')}]", "ref", href, n.attrs.get("title", ""))
        to = href.replace("(", "\\(").replace(")", "\\)")
        to = f"<{to}>" if " " in to else to
        to += f' "{title}"' if title else ""
        core = label.strip()
        if self.o.link_style == "inline":
            made = f"[{core}]({to})"
        elif self.o.link_style == "reference":
            self.links.append(f"[{len(self.links) + 1}]: {to}")
            made = f"[{core}][{len(self.links)}]"
        else:
            self.links.append(f"[{core}]: {to}")
            made = f"[{core}][]" if self.o.link_style == "collapsed-reference" else f"[{core}]"
        return " " * (label[:1] == " ") + made + " " * (len(label) > 1 and label[-1:] == " ")

    def referred(self, shown: str, kind: str, to: str, title: str) -> str:
        """A numbered reference whose definition stands beside it or before the next heading."""
        self.made += 1
        name = f"{kind}{self.made}"
        definition = f"[{name}]: {to}" + (f' "{title}"' if title else "")
        if self.o.reference_placement == "adjacent":
            return f"{shown}[{name}]\n\n{definition}\n\n"
        self.waiting.append(definition)
        return f"{shown}[{name}]"

    def image(self, n: Node) -> str:
        src = n.attrs.get("src", n.attrs.get("href"))
        if src is None:
            return ""
        alt = re.sub(r"\n+", "\n", n.attrs.get("alt", "")).replace('"', '\\"')
        title = n.attrs.get("title", "").replace('"', '\\"')
        if self.o.image_mode == "reference" and self.o.reference_placement != "end":
            return self.referred(f"![{n.attrs.get('alt', '').replace(']', chr(92) + ']')}]", "img", src, n.attrs.get("title", ""))
        if self.o.image_mode == "reference":
            self.images.append(f"[img{len(self.images) + 1}]: {src}" + (f' "{title}"' if title else ""))
            return f"![{alt}][img{len(self.images)}]"
        src = src.replace("(", "\\(").replace(")", "\\)")
        return f"![{alt}]({f'<{src}>' if ' ' in src else src}" + (f' "{title}"' if title else "") + ")"

    def listing(self, n: Node) -> str:
        if n.tag == "ul":
            s = self.inside(n).strip("\n")
        else:
            items = [c for c in n.element_children()]
            try:
                start = max(1, int(n.attrs.get("start", "1")))
            except ValueError:
                start = 1
            width = len(str(start + max(0, len(items) - 1)))
            lines = []
            for i, c in enumerate(items):
                mark = f"{start + i}.".ljust(width + 1) + "  "
                body = self.inside(c).strip("\n") if c.tag == "li" else self.element(c).strip("\n")
                lines.append(mark + indent(body, " " * len(mark)))
            s = "\n".join(lines)
        if not s.strip():
            return ""
        return f"\n{s}\n" if n.parent is not None and n.parent.tag == "li" else block(s)

    def item(self, n: Node) -> str:
        if self.o.footnotes and n.attrs.get("id", "").startswith("fn"):
            for a in [x for x in n.elements() if x.tag == "a" and x.attrs.get("href", "").startswith("#fnref")]:
                a.detach()
            return block(f"[^{n.attrs['id'][2:].lstrip('-:_')}]: {self.inside(n).strip()}")
        mark = "*   " if self.o.bullet_marker == "asterisk" else "-   "
        return "\n" + mark + indent(self.inside(n).strip("\n").strip(" "), "    ") + "\n"

    def quote(self, n: Node) -> str:
        return self.alert(n) or block("\n".join(f"> {x}" for x in self.inside(n).strip("\n").split("\n")))

    def div(self, n: Node) -> str:
        if "mermaid" in n.attrs.get("class", "").split() and (s := self.mermaid(n)) is not None:
            return s
        return self.alert(n) or block(self.inside(n).strip("\n"))

    def alert(self, n: Node) -> str:
        if not self.extended or self.o.profile == "mdx-safe":
            return ""
        kind = next((c[15:] for c in n.attrs.get("class", "").split() if c.startswith("markdown-alert-")), None)
        if kind is None:
            return ""
        for p in [c for c in n.element_children() if "markdown-alert-title" in c.attrs.get("class", "").split()]:
            p.detach()
        return block("\n".join([f"> [!{kind.upper()}]", *(f"> {x}" for x in self.inside(n).strip("\n").split("\n"))]))

    def mermaid(self, n: Node) -> str | None:
        if self.o.mermaid == "drop":
            return ""
        if self.o.mermaid == "preserve-html":
            return None
        return block(f"```mermaid\n{n.inner_text().strip()}\n```")

    def pre(self, n: Node) -> str:
        if "mermaid" in n.attrs.get("class", "").split() and (s := self.mermaid(n)) is not None:
            return s
        return block(self.inside(n).strip("\n"))

    def code(self, n: Node) -> str:
        if self.in_pre:
            s = n.inner_text().removesuffix("\n")
            own = f"{n.attrs.get('class', '')} {n.parent.attrs.get('class', '')}".split()
            named = next((c[9:] for c in own if c.startswith("language-")), "")
            f = fence_for(s, "~" if self.o.code_fence == "tildes" else "`")
            return f"\n\n{f}{named}\n{s}\n{f}\n\n"
        s = n.inner_text().strip()
        if "`" not in s:
            return f"`{s}`" if s else ""
        return f"`` {s} ``" if s[0] == "`" or s[-1] == "`" else f"``{s}``"

    def span(self, n: Node) -> str:
        display = {"math math-inline": "$", "math math-display": "$$"}.get(n.attrs.get("class", ""))
        if display and len(n.children) == 1 and n.children[0].tag is None:
            return f"{display}{n.children[0].text}{display}"
        return self.inside(n)

    def math(self, s: str, display: bool) -> str:
        s = s.strip()
        how = self.o.math_output
        if how == "preserve-html":
            return block(s)
        if not s or how == "plain":
            return s
        if how == "fenced":
            return block(f"```math\n{s}\n```") if display else f"`{s}`"
        return block(f"$${s}$$") if display or how == "block-dollar" else f"${s}$"

    def script(self, n: Node) -> str:
        if not self.o.math_enabled or "math" not in n.attrs.get("type", ""):
            return ""
        return self.math(n.inner_text(), "mode=display" in n.attrs.get("type", ""))

    def mathml(self, n: Node) -> str:
        return self.math(n.inner_text(), n.attrs.get("display") == "block") if self.o.math_enabled else self.inside(n)

    def checkbox(self, n: Node) -> str:
        if self.o.task_lists and n.attrs.get("type", "").lower() == "checkbox":
            return "[x] " if "checked" in n.attrs else "[ ] "
        return ""

    def definitions(self, n: Node) -> str:
        lines, term = [], ""
        for c in n.element_children():
            s = self.inside(c).strip()
            if c.tag == "dt":
                term = s
            elif c.tag == "dd":
                lines.append(f"{term}: {s}")
        return block("\n".join(lines))

    def custom(self, n: Node) -> str:
        _, action, template, _ = rule_of(n, self.o)
        if action == "markdown-template":
            filled = template.replace("{text}", self.inside(n).strip())
            return re.sub(r"\{attr:([\w:-]+)\}", lambda m: n.attrs.get(m[1], ""), filled)
        if action == "fenced":
            s = n.inner_text().strip("\n")
            f = fence_for(s, "`")
            return block(f"{f}{template}\n{s}\n{f}")
        return self.anchor(n) if action == "link" else self.image(n)

    def cell(self, c: Node) -> str:
        return self.inside(c).strip().replace("\r", "").replace("\n", " ")

    def table(self, n: Node) -> str:
        how = n.attrs.pop("#table", "")
        rows = [r for r in n.elements() if r.tag == "tr"]
        if how == "html-fallback":
            s = serialize(n)
            f = fence_for(s, "`")
            return block(f"{f}html\n{s}\n{f}")
        if how == "csv-like":
            lines = [",".join(csv_field(" ".join(c.inner_text().split())) for c in r.element_children()) for r in rows]
            return block("```csv\n" + "\n".join(lines).rstrip("\n") + "\n```")
        if any(a.tag in ("td", "th") for a in n.ancestors()):
            return self.inside(n)
        captions = [self.inside(c).strip() for c in n.element_children() if c.tag == "caption"]
        cells = [[c for c in r.element_children() if c.tag in ("td", "th")] for r in rows]
        top = next((i for i, r in enumerate(rows) if r.parent.tag == "thead" or cells[i] and all(c.tag == "th" for c in cells[i])), None)
        filled = [[self.cell(c) for c in r] for r in cells]
        head = filled[top] if top is not None else []
        body = [r for i, r in enumerate(filled) if i != top and r]
        if not head and not body:
            return block("\n".join(captions))
        count = max(len(r) for r in [head, *body])
        width = [max(3 if head else 0, *(len(r[i]) if i < len(r) else 0 for r in [head, *body])) for i in range(count)]

        def line(r: list[str]) -> str:
            return "| " + " | ".join((r[i] if i < len(r) else "").replace("|", "&#124;").ljust(width[i]) for i in range(count)) + " |"

        lines = [*captions, *([line(head), "| " + " | ".join("-" * w for w in width) + " |"] if head else []), *map(line, body)]
        return block("\n".join(lines))


def post_process(s: str, o: Options) -> str:
    if o.trailing_whitespace == "trim":
        s = "\n".join(x.rstrip() for x in s.split("\n"))
    if o.final_newline == "ensure":
        s = s if s.endswith("\n") else s + "\n"
    elif o.final_newline == "suppress":
        s = s.rstrip("\n")
    if o.unicode_normalization != "off":
        s = unicodedata.normalize(o.unicode_normalization.upper(), s)
    return s.translate({0xA0: " ", 0x2007: " ", 0x202F: " "}) if o.normalize_whitespace else s


def plain_text(s: str) -> str:
    """The Python twin of ``functions.text.strip_markdown``."""
    hide = dict(zip(T.PUNCTUATION, T.HIDDEN, strict=True))
    s = re.sub(r"\\([!-/:-@\[-`{-~])", lambda m: hide[m[1]], s)
    for pattern, to in T.MARKDOWN_STEPS:
        # Unicode white space, without the separators that Python alone counts as such.
        pattern = pattern.replace("[\\s\\S]", "(?s:.)").replace("[^^\\s]", f"[^^{T.SPACE}]").replace("[^~\\s]", f"[^~{T.SPACE}]").replace("\\s", f"[{T.SPACE}]")
        s = re.sub(pattern, to.replace("$1", r"\1"), s)
    s = s.translate(dict(zip(map(ord, T.HIDDEN), T.PUNCTUATION, strict=True)))
    return re.sub(r"\n{3,}", "\n\n", re.sub(f"^[{T.SPACE}]+|[{T.SPACE}]+\\Z", "", s))


def mdx(s: str) -> str:
    return re.sub(r"<(?=[A-Za-z/>])", r"\\<", re.sub(r"([{}])", r"\\\1", s))


def yaml_block(meta: dict[str, str | None]) -> str:
    def quoted(v: str) -> str:
        return '"' + v.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t") + '"'

    lines = [f"{k}: {quoted(meta[k])}" for k in ("title", "description", "canonical_url") if meta.get(k) is not None]
    return "---\n" + "\n".join(lines) + "\n---\n" if lines else ""


