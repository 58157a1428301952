"""A deterministic corpus of HTML pages for benches, made by column expressions: four kinds of page, any number of each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("wiki", "news", "docs", "tables")


def _many(n: int, each) -> Column:
    return F.array_join(F.transform(F.sequence(F.lit(1), F.lit(n)), each), "")


def corpus(spark: SparkSession, pages: int, sections: int = 20) -> DataFrame:
    """(page_id, kind, url, html) of ``pages`` pages; the same numbers give the same pages."""
    page = spark.range(pages).withColumnRenamed("id", "page_id")
    i = F.col("page_id").cast("string")

    def prose(s: Column) -> Column:
        s = s.cast("string")
        return F.concat(F.lit("<p>Part "), s, F.lit(' of <a href="/topic/'), i, F.lit('">the topic</a> has <b>strong</b> and <i>light</i> words, some <code>code()</code> and a mark<sup><a href="#fn'), s, F.lit('">['), s, F.lit("]</a></sup>.</p>"))

    def rows(s: Column) -> Column:
        s = s.cast("string")
        return F.concat(F.lit("<tr><td>"), s, F.lit("</td><td>item "), s, F.lit(" | of page "), i, F.lit("</td></tr>"))

    table = F.concat(F.lit("<table><thead><tr><th>Number</th><th>Item</th></tr></thead><tbody>"), _many(sections, rows), F.lit("</tbody></table>"))
    body = {
        "wiki": F.concat(_many(sections, lambda s: F.concat(F.lit("<h2>Section "), s.cast("string"), F.lit("</h2>"), prose(s))), table),
        "news": F.concat(F.lit("<nav><ul><li><a href='/'>Home</a></li></ul></nav><article>"), _many(sections, prose), F.lit("<img data-src='/i.png' alt='photo'></article><footer>&copy; paper</footer>")),
        "docs": _many(sections, lambda s: F.concat(F.lit("<h3>fn_"), s.cast("string"), F.lit("</h3><pre><code class='language-rust'>fn f"), s.cast("string"), F.lit("() -&gt; u8 { 1 }\n</code></pre><ul><li>one<ul><li>two</li></ul></li></ul>"))),
        "tables": F.concat(*[table] * 4),
    }
    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), (F.col("page_id") % len(KINDS) + 1).cast("int"))
    chosen = F.coalesce(*[F.when(kind == k, b) for k, b in body.items()])
    html = F.concat(F.lit("<html><head><title>Page "), i, F.lit("</title></head><body><h1>Page "), i, F.lit("</h1>"), chosen, F.lit("</body></html>"))
    return page.select("page_id", kind.alias("kind"), F.concat(F.lit("https://corpus.example/"), kind, F.lit("/"), i).alias("url"), html.alias("html"))
