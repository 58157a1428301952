"""Node-table operators against walks over the same trees."""

import random

import pytest
from pyspark.sql import functions as F

from papyrine.convert import dom_nodes
from papyrine.html.clean import _label, complex_table, depths
from papyrine.html.dom import parse
from papyrine.html.select import select
from papyrine.plans import nodes as N

TAGS = ["div", "p", "span", "ul", "li", "section", "b", "article", "h2", "form"]


def tree(r, n=40):
    """Random HTML whose tree is what it says: nested elements, texts, comments."""
    out, open_ = [], []
    for i in range(n):
        c = r.random()
        if open_ and c < 0.35:
            out.append(f"</{open_.pop()}>")
        elif c < 0.5:
            out.append(r.choice([f"t{i} ", "<!-- c -->", "<br>", "<img src='x' title='t'>", f"<a href='/{i}'>l{i}</a>"]))
        else:
            tag = r.choice(["div", "section", "span", "article", "x-y"])
            attrs = "".join(r.sample([" id='i%d'" % r.randrange(3), " class='a b'", " class='b'", " data-k='Val ue'", " hidden"], r.randrange(3)))
            attrs = attrs if attrs.count("class") < 2 else " class='a'"
            out.append(f"<{tag}{attrs}>")
            open_.append(tag)
    return "".join(out)


@pytest.fixture(scope="module")
def pages(spark):
    r = random.Random(8)
    rows = [(i, tree(r, r.randrange(5, 70))) for i in range(120)] + [(900, ""), (901, None), (902, "<div>" * 300 + "deep")]
    return rows, spark.createDataFrame(rows, "page_id long, html string").repartition(4)


@pytest.fixture(scope="module")
def table(spark, pages, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("nodes"))
    dom_nodes(pages[1], "page_id").write.parquet(f"{at}/n")
    return spark.read.parquet(f"{at}/n")


def numbered(html):
    root = parse(html or "")
    return root, {id(n): i - 1 for i, n in enumerate(root.walk())}


SELECTORS = [
    "div span", "div > span", "div + span", "div ~ span", "section div > .a", "div.a, span#i1, br", "[data-k^='Val']", "[class~=b] a", "*:first-child", "div :last-child",
    "span:only-child", "div:not(.a)", "article > div ~ span a[href]", ":is(div > span, section + div) img", ":empty", "div:nth-child(2n+1) > *", "x-y:nth-child(2)", "html > body > div",
    "body *:not(div span)", "[data-k='val ue' i]", "div div div", ":root", "a + img", "p",
]


@pytest.mark.parametrize("css", SELECTORS)
def test_select(pages, table, css):
    want = set()
    for i, html in pages[0]:
        root, ids = numbered(html)
        want |= {(i, ids[id(n)]) for n in select(root, css)}
    found = N.select_nodes(table, "page_id", css)
    assert {(x.page_id, x.id) for x in found.collect()} == want
    plan = N.select_nodes(table, "page_id", css)._jdf.queryExecution().executedPlan().toString()
    alone = css in ("div.a, span#i1, br", "[data-k^='Val']", "div:not(.a)", "[data-k='val ue' i]", ":root", "p")
    assert "Cartesian" not in plan and "NestedLoop" not in plan and "Join" not in plan and plan.count("Exchange hashpartitioning") == (not alone), plan


def test_remove_unwrap_keep(pages, table):
    removed = {(x.page_id, x.id) for x in N.remove_nodes(table, "page_id", ".a, img").collect()}
    unwrapped = {(x.page_id, x.id): (x.parent, x.depth) for x in N.unwrap_nodes(table, "page_id", "div, span").collect()}
    kept = {(x.page_id, x.id) for x in N.keep_only(table, "page_id", "nav", "section.a", "article").collect()}
    want_removed, want_unwrapped, want_kept = set(), {}, set()
    for i, html in pages[0]:
        root, ids = numbered(html)
        gone = {id(n) for n in select(root, ".a, img")}
        flat = {id(n) for n in select(root, "div, span")}
        one = next((x for css in ("nav", "section.a", "article") for x in select(root, css)[:1]), root)
        for n in root.walk():
            if n is root:
                continue
            up = [n, *n.ancestors()]
            if not any(id(a) in gone for a in up):
                want_removed.add((i, ids[id(n)]))
            if id(n) not in flat:
                left = [a for a in n.ancestors() if id(a) not in flat]
                want_unwrapped[i, ids[id(n)]] = (ids[id(left[0])] if left[0] is not root else -1, len(left))
            if any(a is one for a in up):
                want_kept.add((i, ids[id(n)]))
    assert removed == want_removed and unwrapped == want_unwrapped and kept == want_kept


def test_limits(pages, table):
    rows = {x.page_id: x for x in N.node_limits(table, "page_id", 30, 5, 4).collect()}
    subtrees = {(x.page_id, x.id): x.n_nodes for x in N.pruned_subtrees(table, "page_id", 5).collect()}
    left = {(x.page_id, x.id) for x in N.prune_depth(table, 5).collect()}
    for i, html in pages[0]:
        root, ids = numbered(html)
        deep = [(n, d) for n, d in depths(root)]
        cut = {(i, ids[id(n)]): sum(1 for _ in n.walk()) for n, d in deep if d == 6}
        assert {k: v for k, v in subtrees.items() if k[0] == i} == cut
        assert {k for k in left if k[0] == i} == {(i, ids[id(n)]) for n, d in deep if d <= 5}
        longest = max((len(v) for n in root.elements() for v in n.attrs.values()), default=0)
        rules = [x for x, on in (("max-node-count", len(deep) > 30), ("max-dom-depth", any(d > 5 for _, d in deep)), ("max-attribute-len", longest > 4)) if on]
        x = rows[i]
        assert (x.n_nodes, x.depth, x.longest_attribute, x.pruned_subtrees, x.pruned_nodes, x.rules) == (len(deep), max(d for _, d in deep), longest, len(cut), sum(cut.values()), rules)
    assert N.prune_depth(table, 0).count() == table.count() and N.pruned_subtrees(table, "page_id", 0).count() == 0


def placed(t):
    """The grid of a tree's table, by a set of taken places."""
    own = lambda tags: [n for n in t.elements() if n.tag in tags and next(a for a in n.ancestors() if a.tag == "table") is t]
    taken, out = set(), []
    for r, row in enumerate(own(("tr",))):
        at = 0
        for c in [c for c in own(("td", "th")) if next((a for a in c.ancestors() if a.tag == "tr"), None) is row]:
            spans = [int(v) if (v := c.attrs.get(k, "1").strip()).isdigit() else 1 for k in ("colspan", "rowspan")]
            w, h = spans[0] or 1, spans[1] or 65534
            while (r, at) in taken:
                at += 1
            taken |= {(r + i, at + k) for i in range(min(h, 40)) for k in range(w)}
            text = "".join(x.text for x in c.walk() if x.tag is None and next(a for a in x.ancestors() if a.tag in ("td", "th")) is c)
            out.append((r, at, w, h, c.tag == "th", " ".join(text.split())))
            at += w
    return out


def test_table_grid(spark):
    r, rows = random.Random(3), []

    def table(depth=0):
        out = "<table>"
        for _ in range(r.randrange(0, 6)):
            out += "<tr>" + "".join(f"<{(t := r.choice(['td', 'td', 'th']))}" + r.choice(["", "", "", " colspan=2", " rowspan=2", " colspan='3' rowspan=2", " rowspan=0", " colspan=x", " colspan=' 1 '"]) + f"> c{r.randrange(99)} <b>x</b>" + (table(1) if depth == 0 and r.random() < 0.05 else "") + f"</{t}>" for _ in range(r.randrange(0, 5)))
        return out + "</table>"

    rows = [(i, "<p>a</p>" + table() + r.choice(["", table()])) for i in range(150)]
    want = []
    for i, html in rows:
        for k, t in enumerate(n for n in parse(html).elements() if n.tag == "table"):
            want += [(i, k, *x, complex_table(t)) for x in placed(t)]
    got = N.table_grid(dom_nodes(spark.createDataFrame(rows, "page_id long, html string"), "page_id"), "page_id")
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 500
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_form_labels(spark):
    r, rows = random.Random(4), []
    for i in range(150):
        bits = []
        for _ in range(r.randrange(1, 14)):
            k = r.randrange(4)
            bits.append(r.choice([f"<input id=f{k}>", f"<label for=f{k}> n{r.randrange(99)} <b>b</b></label>", "<div>", "</div>", f"<select id='f{k}'><option>o</select>", f"<label class='x-f{k}'>c{r.randrange(99)}</label>", "<fieldset>", "</fieldset>", "<input>", "<label>none</label>", f"<label for='f{k}'><input id='f{k}'>in</label>", "<textarea id=''></textarea>"]))
        rows.append((i, "<form>" + "".join(bits) + "</form>"))
    want = []
    for i, html in rows:
        root, ids = numbered(html)
        for n in root.elements():
            if n.tag in N.CONTROLS and "id" in n.attrs:
                want.append((i, ids[id(n)], n.tag, n.attrs["id"], _label(n)))
    got = N.form_labels(dom_nodes(spark.createDataFrame(rows, "page_id long, html string"), "page_id"), "page_id")
    assert sorted((*x[:4], x.label or "") for x in got.collect()) == sorted(want) and sum(bool(w[4]) for w in want) > 100


def test_references(spark, table, pages):
    rows = [(1, "<a href=/0>z</a><h1>A <a href=/1>x</a></h1><p><img src=i><a>no</a><a href=/2 title=t>y</a></p><h2>B</h2><img><img src=j>"), (2, "<p>none")]
    got = N.page_references(dom_nodes(spark.createDataFrame(rows, "page_id long, html string"), "page_id"), "page_id").orderBy("number").collect()
    assert [(x.section, x.number, x.kind, x.target, x.title) for x in got] == [(0, 1, "ref", "/0", ""), (1, 2, "ref", "/1", ""), (1, 3, "img", "i", ""), (1, 4, "ref", "/2", "t"), (2, 5, "img", "j", "")]
    assert got[0].place is not None and got[4].place is None and len({x.place for x in got}) == 3
    for i, html in pages[0][:40]:
        root, ids = numbered(html)
        want = [("ref" if n.tag == "a" else "img") for n in root.elements() if n.tag == "a" and "href" in n.attrs or n.tag == "img" and "src" in n.attrs]
        found = N.page_references(table.filter(F.col("page_id") == i), "page_id").orderBy("number").collect() if i < 5 else None
        assert found is None or [x.kind for x in found] == want


def test_resolve(spark):
    from urllib.parse import urljoin

    from papyrine.functions import url

    r = random.Random(7)
    bits = ["a", "b.c", "..", ".", "x y", "...", ".h", "%2e"]

    def path():
        return "/".join(r.choices(bits, k=r.randrange(1, 6))) + r.choice(["", "/"])

    def ref():
        tail = r.choice(["", "", "?q=1/../2", "#f/../g", "?a#b"])
        return r.choice([path() + tail, "/" + path() + tail, "../" * r.randrange(6) + path(), tail or "#x", "//h2/" + r.choice(["a/b", ""]) + tail, "http://o/p" + tail, "mailto:x@y", "https://o/q", "tel:1"])

    bases = ["http://h", "http://h/", "http://h/a", "http://h/a/b/", "https://u@h:8/a/b/c?x=1", "http://h/a/b?q#f", "http://h/a/../b/c"]
    rows = [(r.choice(bases), ref()) for _ in range(10_000)]
    got = spark.createDataFrame(rows, "base string, ref string").select("base", "ref", url.resolve(F.col("ref"), F.col("base")).alias("u")).collect()
    wrong = [tuple(x) for x in got if x.u != urljoin(x.base, x.ref)]
    assert not wrong, wrong[:5]
    odd = [("http://h/a?q#f", "", "http://h/a?q"), (None, "a", "a"), ("rel", "a", "a"), ("http://h/a", None, None), ("http://h/a/b", "http:c", "http://h/a/c"), ("http://h/a/b", "c//d/../e", "http://h/a/c//e")]
    got = spark.createDataFrame([x[:2] for x in odd], "base string, ref string").select(url.resolve(F.col("ref"), F.col("base"))).collect()
    assert [x[0] for x in got] == [x[2] for x in odd]
    x = spark.createDataFrame([("http://h/p?a=1&utm_source=x#f\ng",)], "u string").select(url.strip_tracking(F.col("u"))).first()[0]
    assert x == "http://h/p?a=1#f\ng"


def test_nodes_are_dealt_by_size(table, monkeypatch):
    def dealt_to(found):
        return found.rdd.getNumPartitions()

    few = dealt_to(N.flag_all(table, "page_id", {"x": "div > .a"}))
    monkeypatch.setattr(N, "PART_BYTES", 2000)
    for found in (N.flag_all(table, "page_id", {"x": "div > .a"}), N.remove_nodes(table, "page_id", "p"), N.keep_only(table, "page_id", "p"), N.table_grid(table, "page_id")):
        assert dealt_to(found) > few
