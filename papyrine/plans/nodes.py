"""Operators over node tables: selectors, removals, limits, grids, labels, references.

A node's ``id`` is its place in document order and ``end`` the last id below it, so what is below what is a matter of
intervals, and intervals of a tree nest. A node has an ancestor among some nodes exactly if the largest ``end`` of those that
stand before it reaches it: a running maximum, no join. Children and siblings are windows over a family (a node and its
children, or the children of one parent). All windows of an operator are within a document, so its rows are dealt once, by the
document's key, and no pair of nodes is ever made.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyrine.html.select import compile_selector, nth_terms

_BEFORE = (Window.unboundedPreceding, -1)
_SO_FAR = (Window.unboundedPreceding, Window.currentRow)


def is_element(tag: str = "tag") -> Column:
    return F.coalesce(~F.substring(F.col(tag), 1, 1).isin("!", "#"), F.lit(False))


def attribute(name: str, attrs: str = "attrs") -> Column:
    """The value of an attribute, null where the node hasn't got it."""
    return F.get(F.filter(attrs, lambda a: a["name"] == name), 0)["value"]


#: Estimated bytes of a node table in one partition, and where an estimate is only that nothing is known.
PART_BYTES, UNKNOWN = 4 << 20, 1 << 50


def dealt(nodes: DataFrame, key: str) -> DataFrame:
    """``nodes`` dealt by document to as many partitions as their size asks for. Without a number Spark would join small
    partitions by their compressed bytes, which for nodes are a hundredth of what sorts of them take."""
    size = int(nodes._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if size >= UNKNOWN:
        return nodes.repartition(key)
    return nodes.repartition(max(nodes.sparkSession.sparkContext.defaultParallelism, -(-size // PART_BYTES)), key)


def _document(key: str):
    return Window.partitionBy(key).orderBy("id")


def _siblings(key: str):
    return Window.partitionBy(key, "parent").orderBy("id")


def below(nodes: DataFrame, key: str, flag: Column, name: str, itself: bool = False) -> DataFrame:
    """Adds whether a flagged node stands above (or is the node, with ``itself``)."""
    reach = F.max(F.when(flag, F.col("end"))).over(_document(key).rowsBetween(*(_SO_FAR if itself else _BEFORE)))
    return nodes.withColumn(name, F.coalesce(reach >= F.col("id"), F.lit(False)))


def _families(nodes: DataFrame, key: str, head: Column, child: Column):
    """Each node twice: as the head of its own family and as a child in its parent's. Columns __family, __head."""
    both = F.array(F.struct(head.alias("f"), F.lit(True).alias("h")), F.struct(child.alias("f"), F.lit(False).alias("h")))
    return nodes.withColumn("__x", F.explode(both)).withColumns({"__family": F.col("__x.f"), "__head": F.col("__x.h")}).drop("__x")


class _Selector:
    """Adds columns for the parts of a selector, from its left to its right."""

    def __init__(self, nodes: DataFrame, key: str, attrs: dict | None = None):
        self.nodes, self.key, self.number = nodes, key, itertools.count()
        self.attrs = attrs or {}
        self.kept = [c for c in nodes.columns if c not in self.attrs.values()]

    def _add(self, value: Column) -> Column:
        name = f"__s{next(self.number)}"
        self.nodes = self.nodes.withColumn(name, F.coalesce(value, F.lit(False)))
        return F.col(name)

    def any_of(self, chains: tuple) -> Column:
        """A column that says which nodes one of the alternatives selects."""
        out = F.lit(False)
        for chain in chains:
            out = out | self._chain(chain)
        return self._add(out)

    def _chain(self, chain: tuple) -> Column:
        left = None
        for join, tests in reversed(chain):
            own = is_element()
            for test in tests:
                own = own & self._test(test)
            left = self._add(own) if left is None else self._add(own & self._joined(join, left))
        return left

    def _joined(self, join: str, left: Column) -> Column:
        """Whether the node hangs on a node that ``left`` flags, in the combinator's way."""
        if join == " ":
            reach = F.max(F.when(left, F.col("end"))).over(_document(self.key).rowsBetween(*_BEFORE))
            return reach >= F.col("id")
        if join == ">":
            twice = _families(self.nodes, self.key, F.col("id"), F.col("parent"))
            family = Window.partitionBy(self.key, "__family")
            name = f"__s{next(self.number)}"
            flagged = F.max(F.when(F.col("__head"), left)).over(family)
            self.nodes = twice.withColumn(name, F.coalesce(flagged, F.lit(False))).filter(~F.col("__head")).drop("__family", "__head")
            return F.col(name)
        flags = F.when(is_element(), left)
        before = _siblings(self.key).rowsBetween(*_BEFORE)
        return F.last(flags, ignorenulls=True).over(before) if join == "+" else F.max(flags).over(before)

    def _test(self, test: tuple) -> Column:
        kind = test[0]
        if kind == "any":
            return F.lit(True)
        if kind == "tag":
            return F.col("tag") == test[1]
        if kind == "attr":
            return F.col(self.attrs[test])
        if kind in ("not", "is"):
            found = self.any_of(test[1])
            return found if kind == "is" else ~found
        return self._place(test[1], test[2])

    def _place(self, place: str, spec: str) -> Column:
        if place == "root":
            return F.col("tag") == "html"
        if place == "empty":
            twice = _families(self.nodes, self.key, F.col("id"), F.col("parent"))
            name = f"__s{next(self.number)}"
            some = F.max(~F.col("__head") & ~F.col("tag").eqNullSafe("!")).over(Window.partitionBy(self.key, "__family"))
            self.nodes = twice.withColumn(name, ~some).filter("__head").drop("__family", "__head")
            return F.col(name)
        one = F.when(is_element(), 1)
        nth = F.sum(one).over(_siblings(self.key).rowsBetween(*_SO_FAR))
        own = F.count(one).over(Window.partitionBy(self.key, "parent"))
        if place == "nth-child":
            terms = nth_terms(spec)
            if terms is None:
                return F.lit(False)
            a, b = terms
            return nth == b if not a else ((nth - b) % a == 0) & ((nth - b) / a >= 0)
        return {"first-child": nth == 1, "last-child": nth == own, "only-child": own == 1}[place]


def _attribute_test(name: str, op: str, want: str, fold: bool) -> Column:
    value = attribute(name)
    if fold:
        value, want = F.lower(value), want.lower()
    if not op:
        return value.isNotNull()
    if op in ("^=", "$=", "*=") and not want:
        return F.lit(False)
    words = F.split(value, r"[\s\x1c-\x1f\x85\p{Z}]+")
    return {"=": value == want, "~=": F.array_contains(words, want) & F.lit(bool(want)), "|=": (value == want) | value.startswith(want + "-"), "^=": value.startswith(want), "$=": value.endswith(want), "*=": value.contains(want)}[op]


def _attribute_tests(chains: tuple) -> dict:
    """The tests of attributes in a selector, in their order."""
    out = {}
    for test in (t for chain in chains for _, own in chain for t in own):
        out |= {test: None} if test[0] == "attr" else _attribute_tests(test[1]) if test[0] in ("not", "is") else {}
    return out


def _looks_around(chains: tuple) -> bool:
    """Whether a selector asks for more than a node's own tag and attributes."""
    tests = [t for chain in chains for _, own in chain for t in own]
    return any(len(chain) > 1 for chain in chains) or any(t[0] == "place" and t[1] != "root" or t[0] in ("not", "is") and _looks_around(t[1]) for t in tests)


def flag_nodes(nodes: DataFrame, key: str, css: str, name: str = "selected") -> DataFrame:
    """``nodes`` with a column that says which elements the selector selects. Rows are dealt by document, once, if the
    selector has combinators or asks for places, and else not at all."""
    return flag_all(nodes, key, {name: css})


def flag_all(nodes: DataFrame, key: str, named: dict[str, str]) -> DataFrame:
    """``nodes`` with a column for each of several selectors; rows are dealt once for all."""
    chains = {name: compile_selector(css) for name, css in named.items()}
    # Attributes are tested where the nodes are; what they say travels, they needn't.
    attrs = {test: f"__a{i}" for i, test in enumerate(_attribute_tests(tuple(itertools.chain(*chains.values()))))}
    nodes = nodes.withColumns({name: F.coalesce(_attribute_test(*test[1:]), F.lit(False)) for test, name in attrs.items()}) if attrs else nodes
    s = _Selector(dealt(nodes, key) if any(map(_looks_around, chains.values())) else nodes, key, attrs)
    found = [s.any_of(c).alias(name) for name, c in chains.items()]
    return s.nodes.select(*s.kept, *found)


def _flagged(nodes: DataFrame, key: str, named: dict[str, str]) -> DataFrame:
    """``flag_all`` for operators with windows of their own: dealt by document in any case, once."""
    found = flag_all(nodes, key, named)
    return found if any(_looks_around(compile_selector(css)) for css in named.values()) else dealt(found, key)


def select_nodes(nodes: DataFrame, key: str, css: str) -> DataFrame:
    """The elements that the selector selects."""
    return flag_nodes(nodes, key, css, "__selected").filter("__selected").drop("__selected")


def remove_nodes(nodes: DataFrame, key: str, css: str) -> DataFrame:
    """``nodes`` without the selected elements and all below them."""
    return below(_flagged(nodes, key, {"__gone": css}), key, F.col("__gone"), "__below", itself=True).filter("not __below").drop("__gone", "__below")


def unwrap_nodes(nodes: DataFrame, key: str, css: str) -> DataFrame:
    """``nodes`` without the selected elements; what is below them hangs on the nearest one left, so parent and depth change.
    ``ord`` stays as it was; ids still give the order."""
    flagged = _flagged(nodes, key, {"__gone": css})
    # An interval opens at its node and closes after its end: how many selected ones are open is how many levels go.
    opens = F.struct((F.col("id") * 2).alias("at"), F.lit(1).alias("step"), F.lit(False).alias("node"))
    closes = F.struct((F.col("end") * 2 + 1).alias("at"), F.lit(-1).alias("step"), F.lit(False).alias("node"))
    is_node = F.struct((F.col("id") * 2).alias("at"), F.lit(0).alias("step"), F.lit(True).alias("node"))
    marks = flagged.withColumn("__m", F.explode(F.when(F.col("__gone"), F.array(opens, closes)).otherwise(F.array(is_node))))
    levels = F.sum("__m.step").over(Window.partitionBy(key).orderBy("__m.at").rowsBetween(*_SO_FAR))
    left = marks.withColumn("depth", (F.col("depth") - levels).cast("int")).filter("__m.node").drop("__m", "__gone")
    # A node's parent is the last one before it that is a level higher.
    twice = _families(left, key, F.col("depth"), F.col("depth") - 1)
    last = Window.partitionBy(key, "__family").orderBy("id", "__head").rowsBetween(*_BEFORE)
    parent = F.last(F.when(F.col("__head"), F.col("id")), ignorenulls=True).over(last)
    return twice.withColumn("parent", F.coalesce(parent, F.lit(-1))).filter("not __head").drop("__family", "__head").select(*nodes.columns)


def keep_only(nodes: DataFrame, key: str, *css: str) -> DataFrame:
    """Of each document the subtree of one element: the first that the first selector with a match selects. Documents
    without a match stay whole."""
    names = [f"__k{i}" for i in range(len(css))]
    flagged = _flagged(nodes, key, dict(zip(names, css, strict=True)))
    rank = F.coalesce(*[F.when(F.col(n), i) for i, n in enumerate(names)])
    own = F.min(F.when(rank.isNotNull(), F.struct(rank.alias("r"), F.col("id").alias("a"), F.col("end").alias("b")))).over(Window.partitionBy(key))
    kept = flagged.withColumn("__own", own)
    return kept.filter(F.col("__own").isNull() | F.col("id").between(F.col("__own.a"), F.col("__own.b"))).drop("__own", *names)


def prune_depth(nodes: DataFrame, limit: int) -> DataFrame:
    """``nodes`` without what is deeper than ``limit`` (0: no limit)."""
    return nodes.filter(F.col("depth") <= limit) if limit else nodes


def pruned_subtrees(nodes: DataFrame, key: str, limit: int) -> DataFrame:
    """The subtrees that ``prune_depth`` takes away: key, id, parent, tag (null: text), n_nodes. An interval's length is its
    count, so rows are filtered, not joined."""
    size = (F.col("end") - F.col("id") + 1).cast("long")
    return nodes.filter(F.col("depth") == limit + 1 if limit else F.lit(False)).select(key, "id", "parent", "tag", size.alias("n_nodes"))


def node_limits(nodes: DataFrame, key: str, max_nodes: int = 0, max_depth: int = 0, max_attribute: int = 0) -> DataFrame:
    """Per document: n_nodes, depth, longest_attribute (bytes), pruned_subtrees and pruned_nodes at ``max_depth``, and rules
    (what is over a limit; 0 is none). Partial counts are made before rows are dealt."""
    longest = F.coalesce(F.array_max(F.transform("attrs", lambda a: F.octet_length(a["value"]))), F.lit(0))
    deep = F.col("depth") > (max_depth or 1 << 30)
    cut = F.col("depth") == (max_depth or 1 << 30) + 1
    sums = nodes.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_nodes"), F.max("depth").alias("depth"), F.max(longest).cast("long").alias("longest_attribute"),
        F.count_if(cut).alias("pruned_subtrees"), F.count_if(deep).alias("pruned_nodes"),
    )
    over = [("max-node-count", F.col("n_nodes") > max_nodes, max_nodes), ("max-dom-depth", F.col("pruned_nodes") > 0, max_depth), ("max-attribute-len", F.col("longest_attribute") > max_attribute, max_attribute)]
    rules = F.array_compact(F.array(*[F.when(test, F.lit(rule)) for rule, test, limit in over if limit] or [F.lit(None).cast("string")]))
    return sums.withColumn("rules", rules)


def nearest(nodes: DataFrame, key: str, flag: Column, name: str) -> DataFrame:
    """Adds the id of the nearest flagged node above or at a node, null where there is none.

    Flagged intervals open and close along the document, and how many are open is a level; the nearest one is the last that
    opened at the node's level.
    """
    opens = F.struct((F.col("id") * 2).alias("at"), F.when(flag, 1).otherwise(0).alias("step"), F.lit(True).alias("node"))
    closes = F.struct((F.col("end") * 2 + 1).alias("at"), F.lit(-1).alias("step"), F.lit(False).alias("node"))
    marks = nodes.withColumn("__m", F.explode(F.when(flag, F.array(opens, closes)).otherwise(F.array(opens))))
    level = F.sum("__m.step").over(Window.partitionBy(key).orderBy("__m.at").rowsBetween(*_SO_FAR))
    left = marks.withColumn("__level", level).filter("__m.node").drop("__m")
    last = F.last(F.when(flag, F.col("id")), ignorenulls=True).over(Window.partitionBy(key, "__level").orderBy("id").rowsBetween(*_SO_FAR))
    return left.withColumn(name, F.when(F.col("__level") > 0, last)).drop("__level")


def span(name: str, most: int, whole: int) -> Column:
    """The number of a span attribute: 1 where there is none, ``whole`` for 0, ``most`` at most."""
    digits = F.regexp_extract(F.coalesce(attribute(name), F.lit("")), r"^[\s]*[+]?([0-9]+)", 1)
    n = F.when(F.length(digits) > 9, most).otherwise(F.least(F.lit(most), F.coalesce(digits.try_cast("int"), F.lit(1))))
    return F.when(n == 0, whole).otherwise(n)


#: The standard's limits of spans; a rowspan of 0 reaches to the table's end.
MOST_COLUMNS, MOST_ROWS = 1000, 65534
_PLACED = "array<struct<id:int,column:int,colspan:int,rowspan:int>>"


def _place_row(row: Column, busy: Column) -> Column:
    """Cells of a row put into the columns that are free: (column, busy, placed). ``busy[c]`` is for how many rows from this
    one column c is taken."""
    start = F.struct(F.lit(0).alias("column"), busy.alias("busy"), F.array().cast(_PLACED).alias("placed"))

    def step(acc: Column, cell: Column) -> Column:
        width = F.size(acc["busy"])
        taken = lambda k: F.coalesce(F.get(acc["busy"], k), F.lit(0))
        # The column behind all others is free, so there is a first.
        at = F.get(F.filter(F.sequence(acc["column"], F.greatest(acc["column"], width)), lambda k: taken(k) == 0), 0)
        after = at + cell["colspan"]
        own = F.transform(F.sequence(F.lit(0), F.greatest(width, after) - 1), lambda k: F.when((k >= at) & (k < after), F.greatest(cell["rowspan"], taken(k))).otherwise(taken(k)))
        one = F.struct(cell["id"].alias("id"), at.alias("column"), cell["colspan"].alias("colspan"), cell["rowspan"].alias("rowspan"))
        return F.struct(after.alias("column"), own.alias("busy"), F.concat(acc["placed"], F.array(one)).alias("placed"))

    return F.aggregate(row["cells"], start, step)


def table_grid(nodes: DataFrame, key: str) -> DataFrame:
    """The cells of documents' tables at their places: key, table, row, column (from 0), colspan, rowspan, header, text, complex.

    A row's cells go, in order, to the first columns that no cell of an earlier row reaches into; an ordered fold over a table's
    rows carries for how long each column is taken. Cells of an inner table are its own, and a cell's text is without theirs. A
    table is complex with an inner table, a span other than 1 (the first cell with a span attribute decides for its row), or
    rows of different or no cells where there are several. ``table`` counts a document's tables in order.
    """
    is_table, is_row, is_cell = (F.coalesce(F.col("tag").isin(*t), F.lit(False)) for t in (("table",), ("tr",), ("td", "th")))
    is_text = F.col("tag").isNull()
    trivial = lambda name: F.coalesce(F.trim(attribute(name)), F.lit("")).isin("", "1")
    # Only what tables are made of is dealt, with what its attributes say in place of them.
    found = nodes.filter(is_table | is_row | is_cell | is_text).select(
        key, "id", "end", "tag", "text", F.when(is_cell, span("colspan", MOST_COLUMNS, 1)).alias("colspan"), F.when(is_cell, span("rowspan", MOST_ROWS, MOST_ROWS)).alias("rowspan"),
        F.when(is_cell & (attribute("colspan").isNotNull() | attribute("rowspan").isNotNull()), ~(trivial("colspan") & trivial("rowspan"))).alias("spans"),
    )
    found = dealt(found, key)
    for flag, name in ((is_table, "__table"), (is_row, "__row"), (is_cell, "__cell")):
        found = nearest(found, key, flag, name)
    # A row or cell counts for the innermost table that it stands in; one whose row is outside of that table has none. All
    # that follows groups what is in one place already: a cell with its texts, a row with its cells, a table with its rows.
    found = found.filter((is_table | is_row | is_cell & (F.col("__row") > F.col("__table")) | is_text & (F.col("__cell") > F.col("__table"))) & F.col("__table").isNotNull())
    kind = F.when(is_table, "table").when(is_row, "row").when(is_cell, "cell")
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(is_text, F.struct("id", "text")))), lambda x: x["text"]), "")
    own = lambda name: F.max(F.when(~is_text, F.col(name))).alias(name)
    entries = found.groupBy(key, F.when(is_text, F.col("__cell")).otherwise(F.col("id")).alias("entry")).agg(
        F.max(kind).alias("kind"), own("__table"), own("__row"), own("end"), own("colspan"), own("rowspan"), own("spans"), F.max(F.coalesce(F.col("tag") == "th", F.lit(False))).alias("header"), said.alias("text")
    )
    here = lambda name: F.col("kind") == name
    row = F.when(here("table"), -1).when(here("row"), F.col("entry")).otherwise(F.col("__row")).alias("row")
    rows = entries.filter("kind is not null").groupBy(key, "__table", row).agg(
        F.max(F.when(here("table"), F.col("end"))).alias("end"),
        F.array_sort(F.collect_list(F.when(here("cell"), F.struct(F.col("entry").alias("id"), "colspan", "rowspan", "header", "text")))).alias("cells"),
        F.min(F.when(here("cell") & F.col("spans").isNotNull(), F.struct("entry", "spans")))["spans"].alias("spans"),
    )
    real, wide = F.col("row") >= 0, F.size("cells")
    folded = rows.groupBy(key, "__table").agg(
        F.max("end").alias("end"), F.array_sort(F.collect_list(F.when(real, F.struct(F.col("row").alias("id"), "cells")))).alias("rows"),
        F.count_if(real).alias("n"), F.min(F.when(real, wide)).alias("least"), F.max(F.when(real, wide)).alias("most"), F.coalesce(F.bool_or("spans"), F.lit(False)).alias("spans"),
    )
    tables = Window.partitionBy(key).orderBy("__table")
    nested = F.coalesce(F.lead("__table").over(tables) <= F.col("end"), F.lit(False))
    complex_ = nested | F.col("spans") | ((F.col("n") > 1) & ((F.col("least") != F.col("most")) | (F.col("least") == 0)))
    start = F.struct(F.array().cast("array<int>").alias("busy"), F.array().cast(f"array<{_PLACED}>").alias("out"))

    def step(acc: Column, row: Column) -> Column:
        placed = _place_row(row, acc["busy"])
        return F.struct(F.transform(placed["busy"], lambda b: F.greatest(b - 1, F.lit(0))).alias("busy"), F.concat(acc["out"], F.array(placed["placed"])).alias("out"))

    placed = folded.select(key, (F.row_number().over(tables) - 1).alias("table"), complex_.alias("complex"), "rows", F.aggregate("rows", start, step, lambda acc: acc["out"]).alias("out"))
    # Cells are placed in their order.
    whole = F.transform("rows", lambda r, i: F.transform(r["cells"], lambda c, j: F.struct(F.get(F.get("out", i), j)["column"].alias("column"), c["colspan"].alias("colspan"), c["rowspan"].alias("rowspan"), c["header"].alias("header"), c["text"].alias("text"))))
    out = placed.select(key, "table", "complex", F.posexplode(whole).alias("row", "c")).select(key, "table", "complex", "row", F.explode("c").alias("c"))
    words = F.trim(F.regexp_replace("c.text", r"[\s\x1c-\x1f\x85\p{Z}]+", " "))
    return out.select(key, "table", "row", "c.column", "c.colspan", "c.rowspan", "c.header", words.alias("text"), "complex")


CONTROLS = ("input", "button", "select", "textarea")


def form_labels(nodes: DataFrame, key: str) -> DataFrame:
    """Form controls with an id and their labels: key, id, tag, control_id, label (trimmed text; null without one).

    A label refers to a control by ``for``, or by any attribute that holds the control's id. Of several the one in the smallest
    element that holds both counts, of these the first. Only elements above controls can be that, which a running minimum
    tells; they meet the pairs of controls and labels of their document by interval.
    """
    found = nodes.select(key, "id", "end", "depth", "tag", "attrs", "text")
    found = dealt(found, key)
    control = F.col("tag").isin(*CONTROLS) & attribute("id").isNotNull()
    after = Window.partitionBy(key).orderBy("id").rowsBetween(1, Window.unboundedFollowing)
    found = found.withColumn("__next", F.min(F.when(control, F.col("id"))).over(after))
    scopes = found.filter(is_element() & (F.col("__next") <= F.col("end"))).select(key, F.col("id").alias("s"), F.col("end").alias("s_end"), F.col("depth").alias("s_depth"))
    controls = found.filter(control).select(key, "id", "tag", attribute("id").alias("control_id"))
    labels = found.filter(F.col("tag") == "label").select(key, F.col("id").alias("l"), F.col("end").alias("l_end"), F.transform("attrs", lambda a: a["value"]).alias("values"))
    texts = found.filter(F.col("tag").isNull()).select(key, F.col("id").alias("t"), "text")
    pairs = controls.join(labels, key).filter(F.exists("values", lambda v: v.contains(F.col("control_id"))))
    held = pairs.join(scopes, key).filter((F.col("s") < F.col("id")) & (F.col("s") <= F.col("l")) & (F.col("s_end") >= F.greatest("id", "l")))
    best = held.groupBy(key, "id").agg(F.min(F.struct((-F.col("s_depth")).alias("d"), "l", "l_end")).alias("b")).select(key, "id", "b.l", "b.l_end")
    said = best.join(texts, key).filter((F.col("t") > F.col("l")) & (F.col("t") <= F.col("l_end"))).groupBy(key, "id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("t", "text"))), lambda x: x["text"]), "").alias("said"))
    named = best.select(key, "id", F.lit(True).alias("has")).join(said, [key, "id"], "left")
    strip = r"^[\s\x1c-\x1f\x85\p{Z}]+|[\s\x1c-\x1f\x85\p{Z}]+$"
    text = F.when(F.col("has"), F.regexp_replace(F.coalesce("said", F.lit("")), strip, ""))
    return controls.join(named, [key, "id"], "left").select(key, "id", "tag", "control_id", text.alias("label"))


HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")


def page_references(nodes: DataFrame, key: str) -> DataFrame:
    """Links and images as numbered references: key, section, number, kind (ref, img), target, title, place.

    One counter runs over a document's links and images. A section begins at a heading, and is 0 before the first; its
    definitions stand before the next heading, whose id is ``place`` (null: the document's end). A heading's own links are in the
    section that it begins.
    """
    heading = F.col("tag").isin(*HEADINGS)
    kind = F.when((F.col("tag") == "a") & attribute("href").isNotNull(), "ref").when((F.col("tag") == "img") & attribute("src").isNotNull(), "img")
    order = _document(key)
    found = nodes.select(key, "id", F.coalesce(heading, F.lit(False)).alias("heading"), kind.alias("kind"), F.coalesce(F.when(F.col("tag") == "a", attribute("href")), attribute("src")).alias("target"), F.coalesce(attribute("title"), F.lit("")).alias("title"))
    found = dealt(found.filter("heading or kind is not null"), key)
    numbered = found.select(
        key, F.count_if("heading").over(order.rowsBetween(*_SO_FAR)).alias("section"), F.count("kind").over(order.rowsBetween(*_SO_FAR)).alias("number"), "kind", "target", "title",
        F.min(F.when(F.col("heading"), F.col("id"))).over(order.rowsBetween(1, Window.unboundedFollowing)).alias("place"),
    )
    return numbered.filter("kind is not null")
