"""Benchmark decontamination with a positional inverted index, in DataFrame functions alone.

The index holds (term, doc_id, position) postings of training tokens, as a written table. Each window of a test item is
looked up from its rarest terms: the list of the rarest, shifted back by the term's offset in the window, gives places
where the window could start; the shifted list of the next rarest is intersected with it; the few places left are
compared with the whole window. Only terms that some window looks up are posted, so the index is a small share of the
corpus, and which terms those are follows from counts over the whole corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papyrine.llm.common import LOWER, UPPER, Scratch

#: Words of a window; slack of a proximity match, in words.
WINDOW, SLACK = 10, 4
#: Places of a cell in which two lists are met.
CELL = 40
#: Rows from the items that are broadcast (of at most WINDOW words each); classes of documents beyond that.
SMALL, SALTS = 500_000, 16
#: Characters that aren't part of a word.
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words of a text, lower-cased in A-Z; null has none."""
    pieces = F.split(F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER), _BETWEEN, -1)
    return F.filter(pieces, lambda w: w != "")


def text_key(text: Column) -> Column:
    """What tells rows of one id apart."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def windows(items: DataFrame) -> DataFrame:
    """item_id (string), window id, its words: every WINDOW consecutive words, or all of a shorter item. The same words
    are one window, whichever items have them."""
    w = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), words(F.col("text")).alias("w")).filter("size(w) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - (WINDOW - 1)))
    rows = w.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i, WINDOW))).alias("words")).distinct()
    return rows.withColumn("window", F.xxhash64(F.array_join("words", " ")))


def lookups(found: DataFrame, counts: DataFrame) -> DataFrame:
    """Of each distinct window its two rarest terms with their offsets: window, words, rank (1 or 2), term, offset.

    Ties go to the smaller term, so neighbouring windows look up the same occurrence. Of a term that a window repeats
    the first place counts. A window with one distinct term is looked up by that alone.
    """
    each = found.select("window", "words").dropDuplicates(["window"]).select("window", "words", F.posexplode("words").alias("offset", "term"))
    each = each.groupBy("window", "words", "term").agg(F.min("offset").alias("offset")).join(counts, "term", "left")
    key = F.struct(F.coalesce("n", F.lit(0)).alias("n"), "term", "offset")
    ranked = each.groupBy("window", "words").agg(F.slice(F.array_sort(F.collect_list(key)), 1, 2).alias("best"))
    out = ranked.select("window", "words", F.size("best").alias("n_terms"), F.posexplode("best").alias("rank", "t"))
    return out.select("window", "words", "n_terms", (F.col("rank") + 1).alias("rank"), F.col("t.term").alias("term"), F.col("t.offset").alias("offset"), F.col("t.n").alias("n"))


class Index:
    """Positional postings of ``docs`` for the windows of ``items``, and the searches that use them.

    What comes from the items is joined by broadcast as long as it has at most SMALL rows, so that a term, however frequent,
    is met where its postings lie; beyond that postings are dealt by SALTS classes of documents.
    """

    def __init__(self, docs: DataFrame, items: DataFrame, scratch: Scratch, small: int = SMALL):
        self.scratch, self.small = scratch, small
        self.texts = docs.select(F.col("doc_id").alias("doc_id"), F.col("text").alias("text"))
        self.docs = self.texts.select("doc_id", words(F.col("text")).alias("w"))
        self.items = scratch.table(windows(items), "windows")
        terms = scratch.table(self.items.select(F.explode("words").alias("term")).distinct(), "terms")
        tokens = self.docs.select(F.explode("w").alias("term"))
        # Counts over all documents of the terms that windows have; partial counts leave a row for each term and task.
        counts = tokens.join(self._bounded(terms), "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("n"))
        self.lookups = scratch.table(lookups(self.items, scratch.table(counts, "counts")), "lookups")
        posted = scratch.table(self.lookups.filter("n > 0").select("term").distinct(), "posted")
        places = self.docs.select("doc_id", F.posexplode("w").alias("pos", "term")).join(self._bounded(posted), "term", "left_semi")
        self.postings = scratch.table(places, "postings")

    def _bounded(self, df: DataFrame) -> DataFrame:
        return F.broadcast(df) if df.count() <= self.small else df

    def _starts(self, rank: int) -> DataFrame:
        """Offset-adjusted lists: where a window could start, by its term of this rank."""
        look = self.lookups.filter(F.col("rank") == rank).select("window", "term", "offset", "n_terms")
        if look.count() <= self.small:
            found = self.postings.join(F.broadcast(look), "term")
        else:
            dealt = self.postings.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
            found = dealt.join(look.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))), ["term", "salt"])
        return found.select("window", "n_terms", "doc_id", (F.col("pos") - F.col("offset")).alias("at"))

    def _pairs(self, slack: int) -> DataFrame:
        """Where the lists of a window's two rarest terms meet, at most ``slack`` places from each other: window, doc_id,
        at, at2. Lists are met in cells of CELL places, the rarer one in the next cell too where it is near."""
        size = CELL if slack else 1
        near = [F.floor((F.col("at") + k) / size).cast("int") for k in (-slack, slack)]
        a = self._starts(1).filter("n_terms > 1").select("window", F.col("doc_id").alias("a_doc"), "at", F.explode(F.sequence(*near)).alias("cell"))
        # Both lists grow with the corpus, so neither is ever broadcast.
        a = a.hint("merge")
        b = self._starts(2).select("window", "doc_id", F.col("at").alias("at2"), F.floor(F.col("at") / size).cast("int").alias("cell"))
        met = b.join(a, (a["window"] == b["window"]) & a["a_doc"].eqNullSafe(b["doc_id"]) & (a["cell"] == b["cell"])).filter(F.abs(F.col("at") - F.col("at2")) <= slack)
        return met.select(b["window"], "doc_id", "at", "at2")

    def phrases(self, pairs: DataFrame | None = None) -> DataFrame:
        """Exact occurrences: doc_id, text_key, window, at (word position, from 0), size. Lists that meet at the same place are
        candidates; these are compared with the words of their documents, the only ones whose texts are read again."""
        pairs = self._pairs(0) if pairs is None else pairs
        places = pairs.filter("at = at2 and at >= 0").select("window", "doc_id", "at")
        places = places.unionByName(self._starts(1).filter("n_terms = 1 and at >= 0").select("window", "doc_id", "at"))
        look = self.lookups.filter("rank = 1").select("window", F.col("words").alias("want"))
        per_doc = places.groupBy("doc_id").agg(F.collect_set(F.struct("window", "at")).alias("places"))
        per_doc = self.scratch.table(per_doc.withColumnRenamed("doc_id", "__id"), "candidates")
        # Candidates grow with the corpus, so they are never broadcast.
        known = self.texts.join(per_doc.hint("merge"), F.col("doc_id").eqNullSafe(F.col("__id")))
        known = known.select("doc_id", "places", words(F.col("text")).alias("w"), text_key(F.col("text")).alias("text_key"))
        own = known.select("doc_id", "text_key", F.explode("places").alias("p"), "w").select("doc_id", "text_key", "p.window", "p.at", F.slice("w", F.col("p.at") + 1, WINDOW).alias("has"))
        right = own.join(self._bounded(look), "window").filter(F.slice("has", F.lit(1), F.size("want")) == F.col("want"))
        return right.select("doc_id", "text_key", "window", "at", F.size("want").alias("size")).distinct()

    def proximity(self, pairs: DataFrame) -> DataFrame:
        """Windows whose two rarest terms stand near their places to each other: doc_id, window, at, shift. Exact places
        have shift 0."""
        return pairs.select("doc_id", "window", "at", (F.col("at2") - F.col("at")).alias("shift")).distinct()


def report(docs: DataFrame, items: DataFrame, scratch: Scratch, proximity: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated; with ``proximity`` n_near too.

    A word inside any occurrence of any window is hit. ``n_near`` counts windows that come near in the document without
    occurring (proximity matches). Null or empty texts have no words; items without words have no windows; rows that
    repeat an id share what any of them has; a null id is an id; item ids that repeat are one item.
    """
    index = Index(docs, items, scratch)
    pairs = scratch.table(index._pairs(SLACK), "pairs") if proximity else None
    hits = scratch.table(index.phrases(pairs), "hits")
    covered = hits.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct(F.col("at").alias("a"), (F.col("at") + F.col("size")).alias("b")))).alias("runs"))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    total = F.aggregate(
        "runs",
        start,
        lambda acc, x: F.struct((acc["n"] + F.greatest(F.lit(0), x["b"] - F.greatest(x["a"], acc["end"]))).alias("n"), F.greatest(acc["end"], x["b"]).alias("end")),
        lambda acc: acc["n"].cast("long"),
    )
    named = hits.select("doc_id", "window").distinct().join(index.items.select("item_id", "window"), "window")
    named = named.groupBy("doc_id").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    out = index.docs.select("doc_id", F.size("w").cast("long").alias("n_words"))
    parts = [covered.select("doc_id", total.alias("n_hit")), named]
    if proximity:
        near, exact = index.proximity(pairs).select("doc_id", "window").distinct(), hits.select(F.col("doc_id").alias("__id"), F.col("window").alias("__w")).distinct()
        near = near.join(exact, (F.col("window") == F.col("__w")) & F.col("doc_id").eqNullSafe(F.col("__id")), "left_anti")
        near = near.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_near"))
        parts.append(near)
    for part in parts:
        part = part.withColumnRenamed("doc_id", "__id")
        out = out.join(part, out["doc_id"].eqNullSafe(part["__id"]), "left").drop("__id")
    items_of = F.coalesce("items", F.array().cast(T.ArrayType(T.StringType())))
    hit = F.coalesce("n_hit", F.lit(0))
    return scratch.last(out.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size(items_of).cast("long").alias("n_items"),
        F.sha2(F.array_join(items_of, ",").cast("binary"), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
        *([F.coalesce("n_near", F.lit(0)).alias("n_near")] if proximity else []),
    ))


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without the documents in which a window of a test item occurs; columns as they are. Rows go by id and text,
    so others that repeat an id, null among them, stay."""
    scratch = Scratch(docs.sparkSession, "leaks")
    hits = scratch.last(Index(docs, items, scratch).phrases().select(F.col("doc_id").alias("__gone"), F.col("text_key").alias("__key")).distinct())
    return docs.join(hits, docs["doc_id"].eqNullSafe(hits["__gone"]) & (text_key(docs["text"]) == hits["__key"]), "left_anti")
