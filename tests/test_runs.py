"""Repeated runs: incremental conversion and line differences."""

import random

import pytest
from pyspark.sql import functions as F

from papyrine.convert import NativeBackend
from papyrine.options import Options
from papyrine.plans import incremental as I
from papyrine.plans.diff import _longest, line_changes


def test_incremental(spark, tmp_path):
    name = f"t{random.randrange(10**9)}"
    count = spark.sparkContext.accumulator(0)

    class Counting(NativeBackend):
        def render(self, root, o):
            count.add(1)
            return super().render(root, o)

    pages = spark.range(40, numPartitions=3).selectExpr("id", "concat('<h1>', id, '</h1>') html")

    def run(pages, last, this, o=None):
        before = count.value
        out = I.next_manifest(spark, pages, last, this, "id", 4, o, backend=Counting())
        return {r.id: r for r in out.collect()}, count.value - before

    I.save_bucketed(pages, f"{name}_p", "id", 4)
    first, n = run(f"{name}_p", None, f"{name}_a")
    assert n == 40 and all(r.converted and r.changed for r in first.values())
    again, n = run(f"{name}_p", f"{name}_a", f"{name}_b")
    assert n == 0 and not any(r.converted or r.changed for r in again.values()) and {i: r.output_hash for i, r in again.items()} == {i: r.output_hash for i, r in first.items()}
    # Both scans are in buckets, and nothing above them is dealt anew.
    plan = I.convert_changed(spark, f"{name}_p", f"{name}_b", "id")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan and plan.count("SelectedBucketsCount: 4 out of 4") == 2, plan
    later = pages.filter("id <> 3").withColumn("html", F.expr("case when id = 5 then '<h1>x' when id = 6 then html || ' ' else html end")).unionAll(spark.sql("select 90L, '<p>new'"))
    I.save_bucketed(later, f"{name}_q", "id", 4)
    third, n = run(f"{name}_q", f"{name}_b", f"{name}_c")
    # 6 differs but for its output; 3 is gone.
    assert n == 3 and {i for i, r in third.items() if r.converted} == {5, 6, 90} and {i for i, r in third.items() if r.changed} == {5, 90} and 3 not in third and len(third) == 40
    assert {r.id: r.markdown for r in spark.table(f"{name}_c_outputs").collect()} == {5: "# x\n", 6: "# 6\n", 90: "new\n"}
    _, n = run(f"{name}_q", f"{name}_c", f"{name}_d", Options.of("gfm"))
    assert n == 40  # other options, other outputs


def test_longest():
    r = random.Random(1)
    for _ in range(300):
        x = r.sample(range(30), r.randrange(12))
        keep = _longest(x)
        kept = [x[i] for i in keep]
        best = max((bin(m).count("1") for m in range(1 << len(x)) if (s := [x[i] for i in range(len(x)) if m >> i & 1]) == sorted(s)), default=0)
        assert kept == sorted(kept) and keep == sorted(keep) and len(kept) == best


def applied(old, changes):
    """The new text: what comes stands at its place, what stays fills the others in order."""
    gone = {c.line for c in changes if c.sign == "-"}
    come = {c.line: c.text for c in changes if c.sign == "+"}
    stay = [x for i, x in enumerate(old.split("\n")) if i not in gone]
    out = [come[i] if i in come else stay.pop(0) for i in range(len(stay) + len(come))]
    assert not stay
    return "\n".join(out)


def test_line_changes(spark):
    r = random.Random(2)
    rows = []
    for i in range(250):
        old = [r.choice(["a", "b", "", "x", f"line {r.randrange(40)}", f"own {i} {r.random()}"]) for _ in range(r.randrange(0, 40))]
        new = list(old)
        for _ in range(r.randrange(0, 6)):
            k = r.randrange(len(new) + 1)
            act = r.randrange(4)
            if act == 0:
                new[k:k] = [r.choice(["a", "", f"new {r.random()}"])]
            elif act == 1:
                del new[k : k + r.randrange(4)]
            elif act == 2 and new:
                a = r.randrange(len(new))
                new[k:k] = new[a : a + 5]
            else:
                r.shuffle(new[k : k + 3])
                new[k : k + 2] = reversed(new[k : k + 2])
        rows.append((str(i), "\n".join(old), "\n".join(new)))
    rows += [("null", None, "a\nb"), ("gone", "a\nb\n", None), ("same", "a", "a"), ("all", "a\nb", "c\nd"), ("end", "a", "a\n")]
    got = {}
    for x in line_changes(spark.createDataFrame(rows, "path string, old string, new string")).collect():
        got.setdefault(x.path, []).append(x)
    import difflib

    size = best = 0
    for path, old, new in rows:
        assert applied(old or "", got.get(path, [])) == (new or ""), path
        size += len(got.get(path, []))
        best += sum(x[0] in "+-" for x in difflib.ndiff((old or "").split("\n"), (new or "").split("\n")))
    assert "same" not in got and [(x.line, x.sign, x.text) for x in got["end"]] == [(1, "+", "")]
    assert size <= 1.1 * best  # no longer than what another method finds
    for x in ("gone", "null"):
        assert got[x]
    assert line_changes(spark.createDataFrame([], "path string, old string, new string")).count() == 0


@pytest.fixture(autouse=True, scope="module")
def cleaned(spark):
    yield
    for t in spark.catalog.listTables():
        if t.name.startswith("t") and t.tableType == "MANAGED":
            spark.sql(f"drop table {t.name}")
