"""Line differences of pairs of texts, as joins and windows over a table of lines.

Lines that are equal at the beginning or end of both texts are left out, before any row is dealt; later the same is done at the
edges of each stretch. Of what is left, a line that stands once in the old stretch and once in the new one is a candidate; the
longest run of candidates that keeps both orders gives anchors, which cut the stretch into shorter ones, in which further lines
are unique. Where none are, lines that repeat are paired by their first, second and further places in the stretch. This goes on
until no stretch has an anchor more; what is left has gone or come.
"""

from __future__ import annotations

from bisect import bisect_left

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from papyrine.sources.store import shared_folder

#: Most rounds of anchors; a stretch that has common lines after that is left as changed, which is still a right difference.
ROUNDS = 12


def _longest(places: list[int]) -> list[int]:
    """Indexes of a longest increasing subsequence."""
    tails: list[int] = []
    at: list[int] = []
    before: list[int] = []
    for i, p in enumerate(places):
        k = bisect_left(tails, p)
        before.append(at[k - 1] if k else -1)
        tails[k : k + 1], at[k : k + 1] = [p], [i]
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


@F.pandas_udf(ArrayType(IntegerType()))
def _ordered(places: pd.Series) -> pd.Series:
    return pd.Series([_longest(list(p)) for p in places])


def _stretches(lines: DataFrame) -> DataFrame:
    """Adds ``stretch``: the old place of the last matched line before. Matches keep both orders, so both sides agree."""
    side = Window.partitionBy("path", "old").orderBy("no")
    return lines.withColumn("stretch", F.coalesce(F.last("mate", ignorenulls=True).over(side.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1)))


def _edges(lines: DataFrame, last: bool) -> DataFrame:
    """Matches equal lines from the beginning, or the end, of each stretch on."""
    open_ = F.col("mate").isNull()
    order = F.desc("no") if last else F.asc("no")
    rank = F.sum(F.when(open_, 1)).over(Window.partitionBy("path", "old", "stretch").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = _stretches(lines).withColumn("rank", F.when(open_, rank))
    # The lines of one rank in a stretch: one of either side, or one alone.
    both = Window.partitionBy("path", "stretch", "rank")
    equal = open_ & (F.count(F.lit(1)).over(both) == 2) & (F.min("hash").over(both) == F.max("hash").over(both)) & (F.min("text").over(both) == F.max("text").over(both))
    ranked = ranked.withColumns({"equal": equal, "peer": F.max(F.when(F.col("old"), F.col("no"))).over(both)})
    run = F.min(F.when(open_, F.col("equal"))).over(Window.partitionBy("path", "stretch").orderBy("rank"))
    return ranked.withColumn("mate", F.when(open_ & run, F.col("peer")).otherwise(F.col("mate"))).select(*lines.columns)


def _anchors(lines: DataFrame, repeated: bool) -> DataFrame:
    """(path, a, b) of new anchors: the old and new places of lines that stand once in their stretch's old and new part, or
    with ``repeated`` of the first, second, ... occurrences of a line in both."""
    rows = _stretches(lines).filter("mate is null")
    line = ["path", "stretch", "hash", "text"]
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy(*line, "old").orderBy("no")))
    found = rows.groupBy(*line, "nth").agg(F.max(F.when(F.col("old"), F.col("no"))).alias("a"), F.max(F.when(~F.col("old"), F.col("no"))).alias("b"))
    if not repeated:
        found = found.withColumn("most", F.max("nth").over(Window.partitionBy(*line))).filter("most = 1")
    pairs = found.filter("a is not null and b is not null").groupBy("path", "stretch").agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("pairs"))
    kept = pairs.withColumn("keep", _ordered(F.transform("pairs", lambda p: p["b"])))
    return kept.select("path", F.explode(F.transform("keep", lambda i: F.get("pairs", i))).alias("p")).select("path", F.col("p.a").alias("a"), F.col("p.b").alias("b"))


def line_changes(texts: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """What turns old texts into new ones: path, line, sign (- for a line that goes, + for one that comes), text, of
    (path, old, new).

    ``line`` counts from 0, in the old text for - and in the new one for +. The old lines without those that go, in order, fill
    the places of the new text that no line comes to. Null is an empty text, which is one empty line; texts that are equal
    have no rows and their lines aren't looked at. Paths are distinct and not null.
    """
    spark = texts.sparkSession
    old, new = (F.coalesce(c, F.lit("")) for c in ("old", "new"))
    cut = texts.filter(old != new).select("path", F.split(old, "\n", -1).alias("a"), F.split(new, "\n", -1).alias("b"))
    # Where both begin or end alike nothing needs to be looked at: the middles alone become rows, by a fold within the row.
    unlike = lambda x, y: F.array_position(F.zip_with(x, y, lambda p, q: p.eqNullSafe(q)), F.lit(False)).cast("int") - 1
    cut = cut.withColumn("head", unlike(F.col("a"), F.col("b")))
    cut = cut.select("path", "head", *(F.slice(c, F.col("head") + 1, F.greatest(F.size(c) - F.col("head"), F.lit(0))).alias(c) for c in ("a", "b")))
    cut = cut.withColumn("tail", unlike(F.reverse("a"), F.reverse("b")))
    middle = [F.struct(F.lit(c == "a").alias("old"), F.slice(c, F.lit(1), F.size(c) - F.col("tail")).alias("l")) for c in ("a", "b")]
    lines = cut.select("path", "head", F.explode(F.array(*middle)).alias("s")).select("path", "head", "s.old", F.posexplode("s.l").alias("at", "text"))
    lines = lines.select("path", "old", (F.col("at") + F.col("head")).alias("no"), "text", F.xxhash64("text").alias("hash"), F.lit(None).cast("int").alias("mate"))
    root = shared_folder(spark, "lines")

    def written(df: DataFrame, k: int) -> DataFrame:
        df.write.parquet(f"{root}/{k}")
        return spark.read.schema(df.schema).parquet(f"{root}/{k}")

    lines, repeated = written(lines, 0), False
    for k in range(1, rounds + 1):
        anchors = written(_anchors(lines, repeated), 1000 + k)
        if anchors.isEmpty():
            if repeated:
                break
            repeated = True
            continue
        sides = anchors.select("path", F.explode(F.array(F.struct(F.lit(True).alias("old"), F.col("a").alias("no"), F.col("a").alias("m")), F.struct(F.lit(False).alias("old"), F.col("b").alias("no"), F.col("a").alias("m")))).alias("s")).select("path", "s.old", "s.no", "s.m")
        matched = lines.join(sides, ["path", "old", "no"], "left").withColumn("mate", F.coalesce("mate", "m")).select(*lines.columns).repartition("path")
        lines = written(_edges(_edges(matched, False), True), k)
    return lines.filter("mate is null").select("path", F.col("no").cast("long").alias("line"), F.when(F.col("old"), "-").otherwise("+").alias("sign"), "text")
