import os

import duckdb
import pytest

import __spark_entry__
from papyrine.plans import catalog

SF = os.environ.get("PAPYRINE_TEST_TABLES", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, name):
    rows = catalog.queries()[name](spark, SF).toPandas()
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert len(rows) and rows["error"].isna().all()
        return
    c = duckdb.connect()
    for t in ("pages", "documents"):
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = c.sql(sql).df()
    cols = sorted(want.columns)
    assert cols == sorted(rows.columns)
    assert sorted(map(tuple, rows[cols].astype(str).values)) == sorted(map(tuple, want[cols].astype(str).values))


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_stream_is_batch(spark, tmp_path):
    from papyrine.streaming.convert import convert_requests

    rows = [(f'{{"html": "<h1>{i}</h1>"}}',) for i in range(5)]
    spark.createDataFrame(rows, "value string").write.text(str(tmp_path / "in"))
    batch = {r.value for r in convert_requests(spark.read.text(str(tmp_path / "in"))).collect()}
    s = convert_requests(spark.readStream.text(str(tmp_path / "in"))).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True)
    s.start(str(tmp_path / "out")).awaitTermination()
    assert {r.value for r in spark.read.parquet(str(tmp_path / "out")).collect()} == batch and len(batch) == 5


def test_files(spark, tmp_path):
    from papyrine.sources.files import glob_base, read_html, read_stdin

    (tmp_path / "v1.2" / "sub").mkdir(parents=True)
    top = tmp_path / "v1.2"
    (top / "a.HTML").write_text("<p>a")
    (top / "b.txt").write_text("no")
    (top / "bad.html").write_bytes(b"<p>\xff")
    (top / "sub" / "c.htm").write_bytes(b"\xef\xbb\xbf<p>\xc3\xa9")
    (top / "sub" / "d.html").write_bytes("<p>x".encode("utf-16"))
    got = {os.path.basename(r.path): (r.html, r.error is None) for r in read_html(spark, str(top)).collect()}
    assert got == {"a.HTML": ("<p>a", True), "bad.html": (None, False)}
    assert {r.html for r in read_html(spark, str(top), recursive=True).collect()} == {"<p>a", None, "<p>é", "<p>x"}
    assert {r.html for r in read_html(spark, f"{top}/**/*.htm").collect()} == {"<p>é"}
    assert [r.html for r in read_html(spark, str(top / "b.txt")).collect()] == ["no"]
    assert [r.html for r in read_html(spark, str(top / "bad.html"), encoding="ISO-8859-1").collect()] == ["<p>ÿ"]
    assert [glob_base(x) for x in ("/a/b/**/*.html", "/a/b*.html", "x*", "/a/b")] == ["/a/b", "/a", ".", "/a/b"]
    import io

    assert [tuple(r) for r in read_stdin(spark, io.BytesIO(b"<p>in")).collect()] == [(None, "<p>in")]


def test_file_sink(spark, tmp_path):
    import io

    from papyrine.sources.files import write_files, write_stdout

    rows = [(f"{tmp_path}/o/{i}/x.md", f"# {i}\n") for i in range(6)]
    done = spark.createDataFrame(rows, "output_path string, markdown string").selectExpr("*", "timestamp'2020-01-02 03:04:05' as modified")
    assert not any(r.written for r in write_files(done, dry_run=True).collect()) and not (tmp_path / "o").exists()
    assert all(r.written for r in write_files(done, timestamps=True).collect())
    assert {p.read_text() for p in tmp_path.glob("o/*/*")} == {t for _, t in rows} and os.path.getmtime(rows[0][0]) == 1577934245
    with pytest.raises(FileExistsError):
        write_files(done, "fail-if-exists")
    assert all(r.skipped for r in write_files(done, "skip-existing").collect())
    with pytest.raises(ValueError):
        write_files(done.unionAll(done))
    out = io.StringIO()
    assert write_stdout(done, stream=out) == 6 and out.getvalue().count("#") == 6


def test_batch_tables(spark, tmp_path):
    from papyrine.convert import convert_table, tables
    from papyrine.options import Options, discover, load_options, show
    from papyrine.plans import batch
    from papyrine.plans.corpus import corpus

    pages = corpus(spark, 8, 3)
    assert pages.select("kind").distinct().count() == 4 and pages.exceptAll(corpus(spark, 8, 3)).isEmpty()
    done = convert_table(pages.withColumn("input_path", pages.url), Options.of("extended", max_input_bytes=10))
    found = batch.diagnostics(done).collect()
    assert {r.rule for r in found} == {"max-input-bytes"} and len(found) == 8
    assert all(r.result.markdown.startswith(f"# Page {r.page_id}") for r in done.collect())
    cells = tables(pages.filter("kind = 'tables'"), "page_id")
    assert cells.count() == 2 * 4 * (2 + 3 * 2) and cells.filter("header").count() == 2 * 4 * 2
    jobs = done.selectExpr("input_path", "concat('o/', page_id, '.md') as output_path", "result.markdown as html", "result.markdown as markdown")
    batch.write_manifest(batch.records(jobs), str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m" / "counts")).first().files == 8 and spark.read.json(str(tmp_path / "m" / "files")).count() == 8
    (tmp_path / "c" / "papyrine").mkdir(parents=True)
    (tmp_path / "c" / "papyrine" / "config.toml").write_text("[render]\nbullet = 'asterisk'\n")
    (tmp_path / ".papyrine.toml").write_text("profile = 'gfm'\n")
    o = load_options(*discover(str(tmp_path / "c"), str(tmp_path)), env={})
    assert (o.bullet_marker, o.profile) == ("asterisk", "gfm")
    (tmp_path / "all.json").write_text(show(o))
    assert load_options(str(tmp_path / "all.json"), env={}) == o


def test_column_twins(spark):
    import random

    from pyspark.sql import functions as F

    from papyrine.functions import text, url
    from papyrine.html.render import plain_text

    r = random.Random(6)
    bits = ["#", "# ", "1. ", "\u0661.", "~", "~~", "==", "--", "---", "*", "**", "_", "`", "```", "[", "](", ")", "!", ">", "\\\\", "+", "++", "^", "a", "b c", " ", "\u00a0", "\u2003", "\x1c", "\x85", "\u2028", "\n", "\n\n\n", "\r", "\t", "é"]
    made = ["".join(r.choices(bits, k=r.randrange(30))) for _ in range(1500)]
    got = spark.createDataFrame(list(enumerate(made)), "i int, x string").select("i", text.strip_markdown(F.col("x")).alias("y")).collect()
    wrong = [(made[x.i], x.y, plain_text(made[x.i])) for x in got if x.y != plain_text(made[x.i])]
    assert not wrong, wrong[:3]
    words = ["a", " ", "  ", ",", "1w", "2x", "1e3w", "infw", "0.5x", "1e2x", "3", "nanx", "+7w", "99999999999w", "99999999999x", ".5x", "w", "b"]
    sets = [" ".join(r.choices(words, k=r.randrange(8))) for _ in range(800)]
    for policy in ("first-srcset", "largest"):
        got = spark.createDataFrame(list(enumerate(sets)), "i int, x string").select("i", url.pick_srcset(F.col("x"), policy).alias("y")).collect()
        wrong = [(sets[x.i], x.y, url.pick_srcset_py(sets[x.i], policy)) for x in got if x.y != url.pick_srcset_py(sets[x.i], policy)]
        assert not wrong, wrong[:3]


def test_language_twin(spark):
    import random

    from pyspark.sql import functions as F

    from papyrine.functions import code

    r = random.Random(9)
    bits = ["<?php", "#!", "/usr/bin/env python3", " /bin/sh", "/usr/bin/python", "<!DOCTYPE html", "<?xml", "<html", "package main", "func f(", "fn g (", "pub fn h(", "std::", "#include <a.hpp>", '#include "a"', "def f(", "class A {", "System.out", "console.log(", "document.x", "SELECT * FROM t", "$(", "echo x", "using System", "@import y", "{ 'a", '[ "', "{ }", "<p>", "word", " ", "  ", "\n", "\n", "\t", ";"]
    made = ["".join(r.choices(bits, k=r.randrange(1, 9))) for _ in range(3000)]
    got = spark.createDataFrame(list(enumerate(made)), "i int, x string").select("i", code.detect_language(F.col("x")).alias("y")).collect()
    assert [(made[x.i], x.y) for x in got if x.y != code.detect_language_py(made[x.i])] == []
    assert len({x.y for x in got}) > 15


def test_normal_forms(spark):
    import unicodedata

    from pyspark.sql import functions as F

    from papyrine.functions import text

    made = ["", "plain", "é", "ﬁ", "ẛ̣", "Å̧", "가", None, "½ ＡＢ"]
    for form in ("NFC", "NFKC"):
        got = spark.createDataFrame([(x,) for x in made], "x string").select(text.normalize(F.col("x"), form).alias("y")).collect()
        assert [r.y for r in got] == [None if x is None else unicodedata.normalize(form, x) for x in made]


CUT = ["page_headings", "page_title", "removed_nodes", "table_grid", "form_labels"]


@pytest.mark.parametrize("name", CUT)
def test_references_without_semicolon(spark, tmp_path, name):
    cut = ["a &amp; b &amp", "&copy", "x &quot;y&quot", "&amp;amp &middot;", "plain &notit; & c"]
    html = [f'<title>{x}</title></head><body><nav><ul><li><a href="/">{x}</a></li></ul></nav><article><h1>{x}</h1><p>{x}</p></article></body>' for x in cut]
    spark.createDataFrame([(i, "http://a", h) for i, h in enumerate(html)], "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    rows = catalog.queries()[name](spark, str(tmp_path)).toPandas()
    c = duckdb.connect()
    c.sql(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    want = c.sql(catalog.oracle_sql()[name]).df()
    cols = sorted(want.columns)
    assert sorted(map(tuple, rows[cols].astype(str).values)) == sorted(map(tuple, want[cols].astype(str).values))


UNREAD = ["removed_nodes", "select_nodes"]


@pytest.mark.parametrize("name", UNREAD)
def test_a_failure_is_no_result(spark, tmp_path, name):
    page = '<html><head><title>{0}</title></head><body><nav><ul><li><a href="/{0}">{0}</a></li><li><a href="/">b</a></li></ul></nav><div class="ad">x</div><article><h1>t</h1><p>a<br>b</p></article></body></html>'
    # Python reads no number of so many digits.
    html = [page.format("x"), page.format("&#" + "9" * 5000 + ";"), None, "", page.format("&#" + "0" * 5000 + "65;")]
    spark.createDataFrame([(i, "http://a", h) for i, h in enumerate(html)], "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    rows = catalog.queries()[name](spark, str(tmp_path)).collect()
    c = duckdb.connect()
    c.sql(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    want = c.sql(catalog.oracle_sql()[name])
    assert sorted((tuple(r[n] for n in want.columns) for r in rows), key=lambda r: r[0]) == sorted(want.fetchall()) and len(rows) == 5
    # Bytes are no text, so none of these can be parsed.
    spark.createDataFrame([(7, "http://a", b"<p>a")], "page_id long, url string, html binary").write.parquet(str(tmp_path / "b" / "pages.parquet"))
    with pytest.raises(Exception, match="document 7 can't be parsed"):
        catalog.queries()[name](spark, str(tmp_path / "b")).collect()


def test_normal_forms_leave_a_few_at_a_time(monkeypatch):
    import pyarrow as pa

    from papyrine.functions import text

    class Stop(Exception):
        pass

    sizes = []

    def held(kind):
        def run(f):
            sizes.extend(len(x) for x in f(iter([pa.array(["é", None] * 300)])))
            raise Stop

        return run

    monkeypatch.setattr(text.F, "arrow_udf", held)
    with pytest.raises(Stop):
        text.normalize(None)
    assert sizes == [200] * 3
