import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from papyrine.convert import clean_html, convert
from papyrine.html.dom import parse, serialize
from papyrine.html.select import SelectorError, compile_selector, select
from papyrine.options import PROFILES, ConfigError, Options, load_options


def md(html, profile="commonmark", **o):
    return convert(html, Options.of(profile, **o))["markdown"]


@pytest.mark.parametrize(
    ("html", "body"),
    [
        ("<b>x <i>y</b> z</i>", "<b>x <i>y</i></b><i> z</i>"),
        ("<table><tr><td>1<td>2<tr>x<td>3</table>y", "x<table><tbody><tr><td>1</td><td>2</td></tr><tr><td>3</td></tr></tbody></table>y"),
        ("<p>a<b>b<p>c</p>d", "<p>a<b>b</b></p><p><b>c</b></p><b>d</b>"),
        ("<ul><li>a<li>b<ul><li>c</ul></ul>", "<ul><li>a</li><li>b<ul><li>c</li></ul></li></ul>"),
        ("<dl><dt>a<dd>b<dt>c</dl>", "<dl><dt>a</dt><dd>b</dd><dt>c</dt></dl>"),
        ("<p>x</br>y</p></p>", "<p>x<br>y</p><p></p>"),
        ("<body><script>var a='</p><b>';</script>t", "<script>var a='</p><b>';</script>t"),
        ("&copy; &amp;&nbsp;<a href='?a=1&copy=2'>l</a>", '© &amp;&nbsp;<a href="?a=1&amp;copy=2">l</a>'),
    ],
)
def test_tree(html, body):
    assert serialize(parse(html)) == f"<html><head></head><body>{body}</body></html>"


@pytest.mark.parametrize("bare", [True, False])
def test_numbers_of_any_length(bare):
    for number, c in (("9" * 5000, "\ufffd"), ("0" * 5000 + "65", "A"), ("0" * 5000, "\ufffd"), ("12345678", "\ufffd"), ("1114111", ""), ("128512", "\U0001f600"), ("x" + "0" * 5000 + "41", "A")):
        root = parse(f"<p title='a&#{number}; b'>a&#{number}; b", bare)
        p = next(n for n in root.elements() if n.tag == "p")
        assert p.inner_text() == p.attrs["title"] == f"a{c} b"


def test_selectors():
    t = parse("<div id=d class='a b'><p lang=en-x>1</p><p title='q r'>2</p></div><p>3</p>")
    for css, want in (("div > p", "12"), ("div + p", "3"), ("p:not([title])", "13"), (".a.b p:last-child", "2"), ("[lang|=en], #d + p", "13"), ("p:nth-child(odd)", "1"), ("[title~=r]", "2")):
        assert "".join(n.inner_text() for n in select(t, css)) == want, css
    for bad in ("", "p >", "p,,a", "[", "p:what"):
        with pytest.raises(SelectorError):
            compile_selector(bad)


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<h1>A</h1><p>x <strong>b</strong> <em>i</em></p>", "# A\n\nx **b** *i*\n"),
        ("<ul><li>a<ul><li>b</li></ul></li><li>c</li></ul>", "-   a\n    -   b\n-   c\n"),
        ("<ol start=9><li>a</li><li>b</li></ol>", "9.   a\n10.  b\n"),
        ("<blockquote><p>a</p><p>b</p></blockquote>", "> a\n>\n> b\n"),
        ("<pre><code class=language-py>x = 1\n</code></pre>", "```py\nx = 1\n```\n"),
        ("<p>use <code>a`b</code></p>", "use ``a`b``\n"),
        ("<p>1. a_b * [c] &lt;d&gt;</p>", "1\\. a\\_b \\* \\[c\\] \\<d>\n"),
        ("<a href='javascript:x'>t</a>", "[t]()\n"),
        ("<a href='https://h/p?utm_source=a&b=1#f'>t</a>", "[t](https://h/p?b=1#f)\n"),
        ("<p>a<br>b</p><hr>", "a\nb\n\n- - -\n"),
        ("<p hidden>x</p><p style='display: none'>y</p>z", "z\n"),
        ("<img data-src=a.png alt='q'>", "![q](a.png)\n"),
        ("<table><tr><th>a<th>b<tr><td>1<td>2|</table>", "| a   | b   |\n| --- | --- |\n| 1   | 2&#124; |\n"),
        ("<li><input type=checkbox checked> done</li>", "-   [x] done\n"),
    ],
)
def test_render(html, want):
    assert md(html) == want


def test_profiles():
    html = "<title>T</title><p><del>a</del> <mark>b</mark> <kbd>c</kbd></p><div class='markdown-alert markdown-alert-note'><p class=markdown-alert-title>Note</p><p>hi</p></div>"
    assert md(html) == "a b c\n\nNote\n\nhi\n"
    assert "~~a~~ b" in md(html, "gfm")
    assert "~~a~~ ==b== <kbd>c</kbd>" in md(html, "extended") and "> [!NOTE]\n> hi" in md(html, "extended")
    assert md(html, "obsidian").startswith('---\ntitle: "T"\n---\n')
    assert md("<p><b>a</b> <a href=u>l</a> x_y {z}</p>", "plain-text") == "a l x_y {z}"
    assert md("<p>{z}</p>", "mdx-safe") == "\\{z\\}\n"


def test_options_and_rules():
    html = "<main><p class=ad>ad</p><h1>T</h1><x-y>in</x-y><p data-k=v>p</p></main><p>out</p>"
    assert md(html, extract_selector="main", remove_selectors=(".ad",), heading_offset=2) == "### T\n\nin\n\np\n"
    assert "<<v p>>" in md(html, custom_rules=((("[data-k]",), "markdown-template", "<<{attr:data-k} {text}>>", 1),))
    assert md("<a href=u>a</a>", link_style="reference") == "[a][1]\n\n[1]: u\n"
    assert md("<table><tr><td rowspan=2>a<td>b<tr><td>c</table>", difficult_table_strategy="flatten") == "a | b c\n"
    assert "```csv\na,b\n```" in md("<table><tr><td>a<td>b</table>", table_handling="csv-like")
    with pytest.raises(ConfigError):
        Options.of(heading_style="x")
    with pytest.raises(ConfigError):
        Options.of(remove_selectors=("[",), strict=True)
    assert convert("<p>x", Options.of(remove_selectors=("[",)))["diagnostics"][0]["rule"] == "selector"
    assert Options.of("extended", footnotes=False).footnotes is False
    assert load_options(env={"PAPYRINE_RENDER__BULLET": "asterisk"}, profile="gfm").bullet_marker == "asterisk"


def test_limits():
    deep = "<div>" * 300 + "x"
    assert convert(deep)["diagnostics"]
    with pytest.raises(ValueError):
        convert(deep, Options.of(strict=True))
    assert convert("<p>x", Options.of(max_output_bytes=1))["diagnostics"]


def test_metadata():
    r = convert("<title> T </title><meta name=description content=D><link rel=canonical href=/c><meta property=og:title content=O>")
    assert (r["title"], r["description"], r["canonical_url"], r["og_title"]) == ("T", "D", "/c", "O")
    assert clean_html("<script>x</script><p>y") == "<html><body><p>y</p></body></html>"


PIECES = ["<p>", "</p>", "<b>", "</b>", "<table>", "<tr>", "<td>", "</table>", "<a href='x'>", "</a>", "<ul>", "<li>", "</ul>", "<pre>", "<code>", "</code>", "</pre>", "<h2>", "&amp;", "&#0;", "<!--", "-->", "<", ">", '"', "x y", "\n", "*", "_", "<svg/>", "<math>", "<i>", "</i>", "<div>", "</div>", "<input type=checkbox>", "<br>"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=40))
def test_any_markup_converts_and_repeats(parts):
    html = "".join(parts)
    for profile in PROFILES:
        assert md(html, profile) == md(html, profile)


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=200))
def test_any_text_converts(s):
    assert isinstance(md(s), str)


def test_long_text():
    assert len(md("a" * (1 << 20))) == (1 << 20) + 1
    random.seed(1)
    assert md("".join(random.choice(PIECES) for _ in range(5000))) is not None


def test_rendered_once():
    import time

    began = time.time()
    assert md("<h1><div>" * 120 + "x").count("x") == 1 and time.time() - began < 1
    html = "<h1><a href=u>a</a></h1><p><img src=i alt=q>"
    assert md(html, link_style="reference") == "# [a][1]\n\n![q](i)\n\n[1]: u\n"
    assert md(f"<h2>{html[4:15]}</h2>", link_style="reference").count("[1]: ") <= 1


def test_reference_placement():
    html = "<p><a href=u>A</a> and <a href=v title='B b'>B</a></p><h2>Next</h2><p><a href=w>C</a><img src=i alt=I>"
    o = {"link_style": "reference", "title_attribute": "inline"}
    assert md(html, reference_placement="adjacent", **o).startswith('[A][ref1]\n\n[ref1]: u\n\nand [B][ref2]\n\n[ref2]: v "B b"')
    assert md(html, reference_placement="section-end", **o) == '[A][ref1] and [B][ref2]\n\n[ref1]: u\n[ref2]: v "B b"\n\n## Next\n\n[C][ref3]![I](i)\n\n[ref3]: w\n'
    assert "![I][img4]" in md(html, reference_placement="section-end", image_mode="reference", **o)


def test_tables_by_option():
    hard = "<p>a<table><tr><td rowspan=2>b<td>c<tr><td>d</table>x"
    assert "```csv\nb,c\nd\n```" in md(hard, table_handling="csv-like")
    assert "```html" in md(hard, table_handling="html-fallback") and "b" not in md(hard, table_handling="drop")
    assert "```html" in md(hard, difficult_table_strategy="html-fallback") and "b | c d x" in md(hard)
    assert "```csv\n\na,\n```" not in md("<table><tr><td><tr><td>a</table>", table_handling="csv-like")
    assert "|" in md("<table><tr><td colspan=1>a<td colspan=2>b</table>")  # the first cell with a span decides


def test_math_output():
    html = "<p>E: <script type='math/tex'>a+b</script>; <script type='math/tex; mode=display'>c</script></p>"
    one = {how: md(html, "extended", math_output=how) for how in ("inline-dollar", "block-dollar", "fenced", "plain")}
    assert "$a+b$" in one["inline-dollar"] and "$$c$$" in one["inline-dollar"] and "$$a+b$$" in one["block-dollar"]
    assert "`a+b`" in one["fenced"] and "```math\nc\n```" in one["fenced"] and "$" not in one["plain"]


def test_srcset_and_forms():
    html = "<img srcset='a infw, b 1w, c 1e3w, d 0.5x' alt=q>"
    assert md(html) == "![q](a)\n" and md(html, responsive_image_policy="largest") == "![q](d)\n"
    assert 'srcset="https://h/b"' in clean_html("<img src=s srcset='a 1w, b 2w'>", Options.of(base_url="https://h/", responsive_image_policy="largest"))
    form = "<div><label data-x='for-k1'>Name</label></div><form><input id=k1 value=v><button>go</button></form>"
    assert "Name: v" in md(form, form_handling="readable")


def test_plain_text_is_unicode():
    from papyrine.html.render import plain_text

    assert plain_text("#\u00a0x\n\u0661.\u2003y\n~a\u00a0b~\n---\u00a0\nz\x1f") == "x\ny\n~a\u00a0b~\n\nz\x1f"


def test_backend(spark):
    from papyrine.convert import convert_table

    class Loud:
        def render(self, root, o):
            if root.inner_text() == "bad":
                raise RuntimeError("no")
            return root.inner_text().upper()

    docs = spark.createDataFrame([(1, "<p>a"), (2, "bad"), (3, None)], "i int, html string")
    got = {r.i: (r.result.markdown, r.result.error) for r in convert_table(docs, backend=Loud()).collect()}
    assert got == {1: ("A\n", None), 2: (None, "RuntimeError: no"), 3: ("\n", None)}


def test_results_leave_a_few_at_a_time(monkeypatch):
    import pandas as pd

    from papyrine import convert as C

    sizes = []
    monkeypatch.setattr(C, "_rows", lambda part, o, backend: sizes.append(len(part)) or [{"markdown": x} for x in part])
    monkeypatch.setattr(C.F, "pandas_udf", lambda kind: lambda f: sizes.append(sum(len(x) for x in f(iter([pd.Series(["x"] * 1001)])))) or _Stop.stop())
    with pytest.raises(_Stop):
        C.convert_table(None)
    assert max(sizes[:-1]) <= 200 and sum(sizes[:-1]) == sizes[-1] == 1001


class _Stop(Exception):
    @classmethod
    def stop(cls):
        raise cls
