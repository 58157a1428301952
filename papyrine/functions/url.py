"""URL functions as Catalyst columns, with the Python twins that the tree code calls."""

from __future__ import annotations

import re
from urllib.parse import parse_qsl, quote_plus, urljoin

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query keys that track, and schemes that are blocked.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid")
BLOCKED = ("javascript", "data", "file")

#: The largest width that counts.
MOST = 2**32 - 1
_ABSOLUTE = r"^[A-Za-z][A-Za-z0-9+.-]*:"


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def strip_tracking(url: Column, extra: tuple[str, ...] = ()) -> Column:
    """An absolute URL without tracking parameters; the others are written again as form data, the fragment stays.
    Relative URLs, and those without a query, are as they were."""
    parts = F.regexp_extract(url, r"^([^?#]*)\?([^#]*)", 2)
    head, tail = F.substring_index(url, "?", 1), F.regexp_extract(url, r"(#[\s\S]*)$", 1)

    def form(c: Column) -> Column:
        return F.url_encode(F.coalesce(F.try_url_decode(c), c))

    pairs = F.filter(F.split(parts, "&"), lambda p: p != "")
    kept = F.filter(pairs, lambda p: ~F.coalesce(F.try_url_decode(F.substring_index(p, "=", 1)), F.lit("")).isin(*TRACKING, *extra))
    again = F.transform(kept, lambda p: F.concat(form(F.substring_index(p, "=", 1)), F.lit("="), form(F.regexp_extract(p, r"\A[^=]*=?([\s\S]*)\z", 1))))
    query = F.when(F.size(again) > 0, F.concat(F.lit("?"), F.array_join(again, "&"))).otherwise("")
    return F.when(url.rlike(_ABSOLUTE) & url.rlike(r"^[^#]*\?"), F.concat(head, query, tail)).otherwise(url)


def block_scheme(url: Column, blocked: tuple[str, ...] = BLOCKED, allowed: tuple[str, ...] = ()) -> Column:
    """Empty where the scheme is blocked and not allowed. Leading control characters and blanks don't hide a scheme."""
    scheme = F.lower(F.substring_index(F.regexp_replace(url, r"^[\x00-\x20]+", ""), ":", 1))
    return F.when(scheme.isin(*[b.lower() for b in blocked if b.lower() not in {a.lower() for a in allowed}]), "").otherwise(url)


#: Scheme, authority with its slashes, path, query and fragment with their marks.
_URL = r"^([A-Za-z][A-Za-z0-9+.-]*:)?(//[^/?#]*)?([^?#]*)(\?[^#]*)?(#[\s\S]*)?"


def _without_dots(path: Column) -> Column:
    """A path that begins with a slash, its ``.`` and ``..`` segments resolved: a fold over the segments in order, in which
    ``..`` takes the last one back. Nothing goes above the root."""
    parts = F.split(F.substring(path, F.lit(2), F.length(path)), "/")
    none = F.array().cast("array<string>")

    def step(acc: Column, part: Column) -> Column:
        up = F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
        return F.when(part == "..", up).when(part == ".", acc).otherwise(F.concat(acc, F.array(part)))

    folded = F.aggregate(parts, none, step)
    last = F.element_at(parts, -1)
    return F.concat(F.lit("/"), F.array_join(F.when(last.isin(".", ".."), F.concat(folded, F.array(F.lit("")))).otherwise(folded), "/"))


def resolve(url: Column, base: Column) -> Column:
    """A reference resolved against an absolute hierarchical URL, by RFC 3986, 5.2.

    A reference with another scheme, or with the base's scheme and an authority, is absolute and stays as it is; with the
    base's scheme alone it is relative. An empty one is the base without its fragment. A base that isn't absolute with an
    authority, or null, leaves the reference as it is; a null reference is null.
    """
    scheme, authority, path, query, fragment = (F.regexp_extract(url, _URL, k) for k in range(1, 6))
    b_scheme, b_authority, b_path, b_query = (F.regexp_extract(base, _URL, k) for k in range(1, 5))
    folder = F.when(b_path == "", "/").otherwise(F.regexp_extract(b_path, r"^(.*/)", 1))
    merged = F.when(path.startswith("/"), path).otherwise(F.concat(folder, path))
    whole = F.when(path == "", b_path).when(~merged.contains("/."), merged).otherwise(_without_dots(merged))
    asked = F.when((path == "") & (query == ""), b_query).otherwise(query)
    own = F.when(authority != "", F.concat(b_scheme, authority, F.when(path.contains("/."), _without_dots(path)).otherwise(path), query, fragment))
    relative = own.otherwise(F.concat(b_scheme, b_authority, whole, asked, fragment))
    absolute = (scheme != "") & ((F.lower(scheme) != F.lower(b_scheme)) | (authority != ""))
    usable = base.isNotNull() & (b_scheme != "") & (b_authority != "")
    return F.when(absolute | ~usable, url).otherwise(relative)


def rewrite(url: Column, rules: list[tuple[str, str]]) -> Column:
    """Applies (pattern, replacement) rules one after the other; ``$1`` and ``${name}`` refer to groups."""
    for pattern, to in rules:
        url = F.regexp_replace(url, re.sub(r"\(\?P<", "(?<", pattern), to)
    return url


def pick_srcset(srcset: Column, policy: str = "first-srcset") -> Column:
    """The first candidate's URL, or that of the largest, the last of equals: by its second word, whole ``w`` pixels up to
    MOST or ``x`` densities times 1000; what can't be read is 0."""
    items = F.filter(F.transform(F.split(srcset, ","), lambda c: F.regexp_replace(F.trim(c), r"\s+", " ")), lambda c: c != "")
    url = F.transform(items, lambda c: F.substring_index(c, " ", 1))
    if policy != "largest":
        return F.coalesce(F.try_element_at(url, F.lit(1)), F.lit(""))

    def weight(c: Column) -> Column:
        d = F.split(c, " ")[1]
        n = F.substring(d, F.lit(1), F.length(d) - 1)
        pixels = F.when(n.rlike(r"\A\+?[0-9]+\z"), n.try_cast("long"))
        dense = F.when(n.rlike(r"\A\+?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z"), n.try_cast("float") * 1000).cast("double")
        size = F.when(d.endswith("w"), F.when(pixels <= MOST, pixels)).when(d.endswith("x") & dense.isNotNull(), F.least(dense, F.lit(float(MOST))).cast("long"))
        return F.when(F.size(F.split(c, " ")) > 1, F.coalesce(size, F.lit(0))).otherwise(F.lit(0)).cast("long")

    return F.coalesce(F.array_max(F.transform(items, lambda c, i: F.struct(weight(c).alias("w"), i.alias("i"), F.substring_index(c, " ", 1).alias("u"))))["u"], F.lit(""))


def rewrite_url(url: Column, rules: list[tuple[str, str]] = (), strip: bool = True, tracking: tuple[str, ...] = (), blocked: tuple[str, ...] = BLOCKED, allowed: tuple[str, ...] = (), base: Column | None = None) -> Column:
    """The whole chain as a column: scheme, base, rules, tracking parameters. A blocked scheme gives an empty text."""
    kept = rewrite(url if base is None else resolve(url, base), list(rules))
    kept = strip_tracking(kept, tracking) if strip else kept
    return F.when(block_scheme(url, blocked, allowed) == "", F.lit("")).otherwise(kept)


def rewrite_srcset(srcset: Column, policy: str = "first-srcset", rules: list[tuple[str, str]] = ()) -> Column:
    """The chosen candidate's URL, rewritten; a srcset without candidates stays."""
    chosen = pick_srcset(srcset, policy)
    return F.when(chosen == "", srcset).otherwise(rewrite_url(chosen, rules))


def escape_destination(url: Column) -> Column:
    return F.regexp_replace(url, r"([()])", r"\\$1")


def rewrite_py(url: str, base: str | None, rules: list[tuple[str, str]], strip: bool, tracking: tuple[str, ...], blocked: tuple[str, ...], allowed: tuple[str, ...]) -> str:
    """The whole chain for one URL: scheme, base, rules, tracking."""
    scheme = url.lstrip("".join(map(chr, range(33)))).split(":", 1)[0].lower()
    if scheme in {b.lower() for b in blocked} - {a.lower() for a in allowed}:
        return ""
    if base:
        try:
            url = urljoin(base, url)
        except ValueError:
            pass
    for pattern, to in rules:
        url = re.sub(pattern, re.sub(r"\$(\d+)|\$\{(\w+)\}", lambda m: f"\\g<{m[1] or m[2]}>", to.replace("\\", "\\\\")), url)
    if strip and "?" in url.split("#", 1)[0] and re.match(_ABSOLUTE, url):
        head, _, rest = url.partition("?")
        query, mark, tail = rest.partition("#")
        kept = [(k, v) for k, v in parse_qsl(query, keep_blank_values=True) if k not in TRACKING and k not in tracking]
        form = "&".join(f"{_form(k)}={_form(v)}" for k, v in kept)
        url = head + (f"?{form}" if form else "") + mark + tail
    return url


def _form(x: str) -> str:
    return quote_plus(x, safe="*").replace("~", "%7E")


def pick_srcset_py(srcset: str, policy: str) -> str:
    items = [c.split() for c in srcset.split(",") if c.strip()]
    if not items:
        return ""
    if policy != "largest":
        return items[0][0]

    def weight(c: list[str]) -> int:
        n = c[1][:-1] if len(c) > 1 else ""
        if len(c) > 1 and c[1][-1] == "w" and re.fullmatch(r"\+?[0-9]+", n):
            return int(n) if int(n) <= MOST else 0
        if len(c) > 1 and c[1][-1] == "x" and re.fullmatch(r"\+?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?", n):
            return int(min(float(MOST), float(n) * 1000))
        return 0

    return max(enumerate(items), key=lambda ic: (weight(ic[1]), ic[0]))[1][0]
