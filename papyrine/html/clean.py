"""Rewrites of a parsed document, in a fixed order, before it is rendered."""

from __future__ import annotations

import re

from papyrine.functions.code import detect_language_py
from papyrine.functions.url import pick_srcset_py, rewrite_py
from papyrine.html.dom import HEADINGS, Node
from papyrine.html.select import SelectorError, compile_selector, select
from papyrine.options import Options

_HIDING = re.compile(r"display: ?none|visibility: ?hidden")
#: Fixed values: (metadata field, element, attribute that is matched, its value, attribute that is read).
META = (
    ("description", "meta", "name", "description", "content"),
    ("canonical_url", "link", "rel", "canonical", "href"),
    ("og_title", "meta", "property", "og:title", "content"),
    ("og_description", "meta", "property", "og:description", "content"),
    ("og_image", "meta", "property", "og:image", "content"),
    ("twitter_title", "meta", "name", "twitter:title", "content"),
    ("twitter_description", "meta", "name", "twitter:description", "content"),
)

class LimitError(ValueError):
    pass


def metadata(root: Node) -> dict[str, str | None]:
    """Eight fields of the document as it came, each from the first element that has it."""
    out: dict[str, str | None] = {"title": None, **{m[0]: None for m in META}}
    seen: set[str] = set()
    for n in root.elements():
        if n.tag == "title" and out["title"] is None:
            out["title"] = n.inner_text().strip()
        elif n.tag in ("meta", "link"):
            for name, tag, key, want, read in META:
                # The first element of its kind decides, whether it has a value or not.
                if name not in seen and n.tag == tag and n.attrs.get(key) == want:
                    seen.add(name)
                    out[name] = n.attrs[read].strip() if read in n.attrs else None
    return out


def depths(root: Node):
    """(node, depth) of all below the root, whose children have depth 1."""
    todo = [(c, 1) for c in reversed(root.children)]
    while todo:
        n, d = todo.pop()
        yield n, d
        todo.extend((c, d + 1) for c in reversed(n.children))


def check_limits(root: Node, o: Options, n_bytes: int) -> list[tuple[str, str]]:
    """(rule, message) warnings; strict options raise the first."""
    found = []
    if o.max_input_bytes and n_bytes > o.max_input_bytes:
        found.append(("max-input-bytes", f"input has {n_bytes} bytes"))
    if o.max_node_count and (n := sum(1 for _ in root.walk())) > o.max_node_count:
        found.append(("max-node-count", f"document has {n} nodes"))
    if o.max_dom_depth:
        over = [n for n, d in depths(root) if d > o.max_dom_depth]
        if over:
            found.append(("max-dom-depth", f"document is deeper than {o.max_dom_depth}"))
    if o.max_attribute_len and (n := max((len(v.encode()) for e in root.elements() for v in e.attrs.values()), default=0)) > o.max_attribute_len:
        found.append(("max-attribute-len", f"an attribute has {n} bytes"))
    if found and o.strict:
        raise LimitError(": ".join(found[0]))
    if o.max_dom_depth and found:
        for n in [n for n, d in depths(root) if d == o.max_dom_depth + 1]:
            n.detach()
    return found


def _hidden(n: Node) -> bool:
    a = n.attrs
    return "hidden" in a or a.get("aria-hidden") == "true" or "style" in a and bool(_HIDING.search(a["style"]))


def _select(root: Node, css: str) -> list[Node]:
    try:
        return select(root, css)
    except SelectorError:
        return []


def _math_script(n: Node) -> bool:
    return n.tag == "script" and n.attrs.get("type", "").startswith(("math/", "text/asciimath"))


def bad_selectors(o: Options) -> list[tuple[str, str]]:
    """A (rule, message) warning for each selector that can't be read; it selects nothing. Strict options don't load."""
    found = []
    asked = [*o.remove_selectors, *o.unwrap_selectors, *o.keep_only_selectors, *(s for r in o.custom_rules for s in r[0])]
    for css in [*asked, *filter(None, (o.extract_selector, o.main_content_selector))]:
        try:
            compile_selector(css)
        except SelectorError:
            found.append(("selector", f"invalid selector {css!r}"))
    return found


def _act(n: Node, action: str) -> None:
    if n.parent is None:
        return
    if action == "drop":
        n.detach()
    elif action == "unwrap":
        n.unwrap()
    elif action == "text":
        n.replace_text(n.inner_text())


def complex_table(t: Node) -> bool:
    """Nested tables, spans, or rows of unequal lengths."""
    rows = [r for r in t.elements() if r.tag == "tr"]
    if any(n is not t and n.tag == "table" for n in t.elements()):
        return True
    sizes = set()
    for r in rows:
        cells = [c for c in r.element_children() if c.tag in ("td", "th")]
        sizes.add(len(cells))
        spans = [[c.attrs[k].strip() for k in ("colspan", "rowspan") if k in c.attrs] for c in cells]
        # The first cell of a row that has a span attribute decides.
        if any(s not in ("", "1") for s in next(filter(None, spans), ())):
            return True
    return len(rows) > 1 and (len(sizes) > 1 or 0 in sizes)


def clean(root: Node, o: Options) -> None:
    """All rewrites, in place."""
    removed = {t.lower() for t in o.remove_tags}
    for n in list(root.elements()):
        if n.parent is None:
            continue
        drop = n.tag in removed and not (o.math_enabled and _math_script(n))
        if drop or o.hidden_content_policy == "hide" and _hidden(n):
            n.detach()
    if o.footnotes:
        for css in (".footnotes ol", ".footnote-list", "ol.footnotes"):
            for n in _select(root, css):
                _act(n, "unwrap")
    for css, action in o.per_tag_behavior:
        for n in _select(root, css):
            _act(n, action)
    if o.heading_offset:
        for n in root.elements():
            if n.tag in HEADINGS:
                n.tag = f"h{min(6, max(1, int(n.tag[1]) + o.heading_offset))}"
    for css in o.remove_selectors:
        for n in _select(root, css):
            n.detach()
    for css in o.unwrap_selectors:
        for n in _select(root, css):
            _act(n, "unwrap")
    for css in (*filter(None, (o.extract_selector, o.main_content_selector)), *o.keep_only_selectors):
        if found := _select(root, css):
            body = next((n for n in root.elements() if n.tag == "body"), root)
            keep = found[0]
            if keep is not body:
                keep.detach()
                for c in list(body.children):
                    c.detach()
                body.append(keep)
            break
    rules = sorted(o.custom_rules, key=lambda r: -r[3])
    for selectors, action, _, _ in rules:
        if action in ("drop", "unwrap", "text"):
            for css in selectors:
                for n in _select(root, css):
                    _act(n, action)
    _elements(root, o)
    for k, (selectors, action, _, _) in enumerate(rules):
        if action in ("markdown-template", "fenced", "link", "image"):
            for css in selectors:
                for n in _select(root, css):
                    if n.tag != "#rule":
                        n.attrs = {**n.attrs, "#tag": n.tag, "#rule": str(k)}
                        n.tag = "x-rule"
    for n in root.elements():
        for key in ("href", "src", "srcset"):
            if key in n.attrs:
                at = n.attrs[key]
                if key == "srcset":
                    at = pick_srcset_py(at, o.responsive_image_policy)
                    if not at:
                        continue
                n.attrs[key] = rewrite_py(at, o.base_url, list(o.url_rewrite_rules), o.remove_tracking_params, o.tracking_params, o.blocked_url_schemes, o.allowed_url_schemes)
        if o.title_attribute == "ignore":
            n.attrs.pop("title", None)


def _elements(root: Node, o: Options) -> None:
    for n in list(root.elements()):
        if n.parent is None:
            continue
        tag = n.tag
        if tag == "details" and o.details_handling != "expand":
            summary = next((c for c in n.element_children() if c.tag == "summary"), None)
            if o.details_handling == "summary-only" and summary is not None:
                n.replace_text(summary.inner_text().strip())
            else:
                n.detach()
        elif tag == "form":
            n.detach() if o.form_handling == "drop" else n.replace_text(_form(n))
        elif "-" in tag and tag != "annotation-xml" and o.custom_element_policy != "preserve-html":
            _act(n, o.custom_element_policy)
        elif tag == "table":
            how = o.table_handling
            if how == "gfm" and complex_table(n):
                how = "html-fallback" if o.difficult_table_strategy == "html-fallback" else "flatten"
            if how == "drop":
                n.detach()
            elif how == "flatten":
                rows = [[c.inner_text().strip() for c in r.elements() if c.tag in ("td", "th")] for r in n.elements() if r.tag == "tr"]
                text = "\n\n".join(" | ".join(filter(None, r)) for r in rows if any(r))
                n.replace_text(f"\n\n{text}\n\n") if text else n.detach()
            elif how in ("csv-like", "html-fallback"):
                n.attrs["#table"] = how
        elif tag in ("video", "audio", "figure", "figcaption", "source") and o.media_policy != "inline" or tag == "figure":
            if o.media_policy == "drop":
                n.detach()
            elif o.media_policy == "placeholder" and tag in ("video", "audio"):
                src = n.attrs.get("src", "")
                n.replace_text(f"({tag.upper()}: {src})" if src else f"({tag.upper()})")
            elif tag == "figure":
                n.unwrap()
        elif tag == "code" and any(a.tag == "pre" for a in n.ancestors()):
            _language(n, o)
        elif tag == "img":
            _image(n, o)


def _form(form: Node) -> str:
    lines = []
    for c in form.elements():
        if c.tag in ("input", "button", "select", "textarea"):
            label, value = _label(c), c.attrs.get("value") or c.attrs.get("placeholder") or ""
            if label or value:
                lines.append(f"{label}: {value}".strip())
    return "\n".join(lines)


def _label(control: Node) -> str:
    """The text of the nearest label that names the control's id in its ``for`` or within any attribute."""
    own, at = control.attrs.get("id"), control.parent
    while own is not None and at is not None:
        for x in at.elements():
            if x.tag == "label" and any(k == "for" and v == own or own in v for k, v in x.attrs.items()):
                return x.inner_text().strip()
        at = at.parent
    return ""


def _language(code: Node, o: Options) -> None:
    for n in (code, code.parent if code.parent.tag == "pre" else None):
        for pattern in o.code_language_patterns if n is not None else ():
            if m := re.search(pattern, n.attrs.get("class", "")):
                named = m.groupdict().get("lang") or (m[1] if m.re.groups else m[0])
                code.attrs["class"] = f"language-{named}"
                return
    if o.detect_languages and (found := detect_language_py(code.inner_text())):
        code.attrs["class"] = f"language-{found}"


def _image(n: Node, o: Options) -> None:
    if o.image_mode == "skip":
        n.detach()
        return
    if "src" not in n.attrs:
        lazy = next((n.attrs[a] for a in o.lazy_image_attrs if a in n.attrs), None)
        if lazy is not None:
            n.attrs["src"] = lazy
        elif "srcset" in n.attrs:
            n.attrs["src"] = pick_srcset_py(n.attrs["srcset"], o.responsive_image_policy)
    if o.preserve_image_metadata and ("width" in n.attrs or "height" in n.attrs):
        n.attrs["alt"] = f"{n.attrs.get('alt', '')} ({n.attrs.get('width', '?')}x{n.attrs.get('height', '?')})".strip()
    if o.image_mode == "alt-text":
        alt = n.attrs.get("alt", "")
        n.replace_text(f"(Image: {alt})" if alt else "")


def rule_of(n: Node, o: Options) -> tuple:
    return sorted(o.custom_rules, key=lambda r: -r[3])[int(n.attrs["#rule"])]


__all__ = ["clean", "check_limits", "complex_table", "depths", "metadata", "rule_of"]
