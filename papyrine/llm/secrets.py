"""Secret scans with corpus-wide ownership, in DataFrame functions alone.

Base detectors give spans of three kinds. On top of that, candidate values (base values and further long mixed tokens)
are hashed and counted over distinct sources and documents: a value that more than a few sources or documents share is a
copied example, one that few hold and that looks random is live. The table has neither repositories nor owners: a
document (its id) stands for a repository, a source for an owner. Live tokens outside the base spans add spans of kind
``live``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyrine.llm.common import Scratch

#: kind -> (pattern, group whose length counts, least length). Kinds are listed in the order that breaks ties.
BASE = {
    "assign": (r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),
}
#: Further candidates: long tokens with a digit and letters of both cases.
EXTRA = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[A-Z0-9+/_-]*[a-z])(?=[a-z0-9+/_-]*[A-Z])[A-Za-z0-9+/_-]{20,}"
ORDER = ("assign", "access", "hex", "live")
#: A value that more sources or more documents than this share is an example (a document and its mirror in one other
#: source aren't enough); a live value has this many different characters.
MAX_SOURCES, MAX_DOCUMENTS, MIN_DISTINCT = 2, 3, 10
HOT = 1000

_SPAN = "array<struct<kind:int,start:int,end:int,value:string>>"


def spans(text: Column, kind: int, pattern: str, group: int, least: int) -> Column:
    """Leftmost matches of ``pattern`` that don't overlap and whose ``group`` has ``least`` characters, with code-point
    offsets: the pieces between matches and the matches alternate, so their running lengths are the offsets."""
    lit = F.lit(pattern)
    pairs = F.arrays_zip(
        F.split(text, pattern, -1).alias("piece"),
        F.regexp_extract_all(text, lit, F.lit(0)).alias("whole"),
        F.regexp_extract_all(text, lit, F.lit(group)).alias("part"),
    )
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("found"))

    def step(acc: Column, x: Column) -> Column:
        a = acc["at"] + F.length(x["piece"])
        b = a + F.coalesce(F.length(x["whole"]), F.lit(0))
        one = F.array(F.struct(F.lit(kind).alias("kind"), a.alias("start"), b.alias("end"), x["part"].alias("value")))
        return F.struct(b.alias("at"), F.when(F.length(x["part"]) >= least, F.concat(acc["found"], one)).otherwise(acc["found"]).alias("found"))

    found = F.aggregate(pairs, start, step, lambda acc: acc["found"])
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(_SPAN))


def _joined(found: Column) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined."""
    keyed = F.array_sort(F.transform(found, lambda x: F.struct(x["start"], x["kind"], x["end"])))
    name = F.array(*[F.lit(k) for k in ORDER])
    return F.array_join(F.transform(keyed, lambda x: F.concat_ws(":", F.element_at(name, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def _is(kind: int):
    return lambda x: x == kind


def scan(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example.

    A null text is empty and has no spans. ``n_live`` counts the document's values that at most MAX_SOURCES
    sources and MAX_DOCUMENTS documents hold, ``n_example`` those that more share; a null source is a source of its own.
    Rows that repeat an id get the extra spans that any of them has only where their own text has them, as spans are
    joined by id and text hash; a null id is an id. An empty table gives no rows, other columns are ignored.
    """
    scratch = scratch or Scratch(docs.sparkSession, "secrets")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), text.alias("text"))
    base = F.concat(*[spans(F.col("text"), i, *BASE[k]) for i, k in enumerate(BASE)])
    rows = rows.select("doc_id", "source", F.xxhash64("text").alias("text_key"), base.alias("base"), spans(F.col("text"), 3, EXTRA, 0, 20).alias("extra"))
    # A further candidate that a base span covers, wholly or in part, is that span's.
    free = F.filter("extra", lambda e: ~F.exists("base", lambda b: (b["start"] < e["end"]) & (e["start"] < b["end"])))
    # Patterns run over each text once: what they find is written, and all else is done with that.
    rows = scratch.table(rows.withColumn("extra", free), "found")

    # Ownership: one row for each value and source, and for each value and document, after partial counts, then one for
    # each value. The struct makes a null id count.
    held = rows.filter("size(base) + size(extra) > 0").select("doc_id", "text_key", "source", F.inline(F.concat("base", "extra")))
    held = held.withColumn("value_key", F.xxhash64("value"))
    owners = held.groupBy("value_key").agg(F.count_distinct("source").alias("n_sources"), F.count_distinct(F.struct("doc_id")).alias("n_docs"), F.count(F.lit(1)).alias("n"))
    owners = scratch.table(owners.select("value_key", "n", ((F.col("n_sources") > MAX_SOURCES) | (F.col("n_docs") > MAX_DOCUMENTS)).alias("example")), "owners")
    mixed = F.size(F.array_distinct(F.split("value", ""))) >= MIN_DISTINCT
    # Values that more than one in HOT of all spans have are joined by broadcast: there are fewer than HOT of them.
    least = (owners.agg(F.sum("n")).first()[0] or 0) // HOT + 1
    often, others = owners.filter(F.col("n") > least), owners.filter(F.col("n") <= least)
    marked = held.join(F.broadcast(often.select("value_key", F.col("example").alias("known"))), "value_key", "left")
    rare = marked.filter("known is null").drop("known").join(others.select("value_key", "example"), "value_key")
    judged = marked.filter("known is not null").withColumnRenamed("known", "example").unionByName(rare).select("doc_id", "text_key", "kind", "start", "end", (~F.col("example") & mixed).alias("live"), "example")
    per_doc = judged.groupBy("doc_id", "text_key").agg(
        F.collect_set(F.when((F.col("kind") == 3) & F.col("live"), F.struct("kind", "start", "end"))).alias("added"),
        F.count_if("live").alias("n_live"),
        F.count_if("example").alias("n_example"),
    )
    bare = F.transform("base", lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    left = rows.select("doc_id", "text_key", bare.alias("base"))
    right = per_doc.select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"), "added", "n_live", "n_example")
    both = left.join(right, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_key") == F.col("__key")), "left")
    none = F.array().cast("array<struct<kind:int,start:int,end:int>>")
    kinds = F.transform("base", lambda x: x["kind"])
    count = [F.size(F.filter(kinds, _is(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(BASE)]
    return scratch.last(both.select(
        "doc_id",
        *count,
        F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _joined(F.concat("base", F.coalesce("added", none))).alias("spans"),
        F.coalesce("n_live", F.lit(0)).alias("n_live"),
        F.coalesce("n_example", F.lit(0)).alias("n_example"),
    ))
