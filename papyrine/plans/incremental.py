"""Repeated conversion of a collection that changes little: only pages that are new or differ are converted.

The pages and the manifest of the last run are tables bucketed by the same key into the same number of buckets, so a run joins
them bucket by bucket: neither side is shuffled, and of an unchanged page no more is read than what its hash takes. The filter
stands below the conversion, so what hasn't changed never reaches a Python worker. The next manifest, hashes alone, is bucketed
as the last one; it comes out of the join in buckets already, and so is written without a shuffle too.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrine.convert import Backend, convert_table
from papyrine.options import Options, show

MANIFEST = "input_hash string, options_hash string, output_hash string, error string"


def save_bucketed(df: DataFrame, name: str, key: str, buckets: int, mode: str = "errorifexists") -> None:
    """``df`` as a table bucketed and sorted by ``key``."""
    df.write.mode(mode).format("parquet").bucketBy(buckets, key).sortBy(key).saveAsTable(name)


def options_hash(o: Options) -> str:
    """What tells runs with different options apart."""
    return hashlib.sha256(show(o).encode()).hexdigest()


def compared(spark: SparkSession, pages: str, manifest: str | None, key: str, o: Options, html: str = "html") -> DataFrame:
    """Each page of the table ``pages`` with its input_hash and what the last run's ``manifest`` has of it (``last``: null for
    a page that it hasn't got), and ``stale``: whether the page or the options have changed, or the last run failed on it.
    Pages that are gone have no row. Keys are distinct."""
    found = spark.table(pages).withColumn("input_hash", F.sha2(F.coalesce(html, F.lit("")).cast("binary"), 256))
    if manifest is None:
        return found.withColumns({"last": F.lit(None).cast(f"struct<{MANIFEST.replace(' ', ':').replace(',:', ',')}>"), "stale": F.lit(True)})
    last = spark.table(manifest).select(F.col(key).alias("__key"), F.struct(*[n.split()[0] for n in MANIFEST.split(", ")]).alias("last"))
    # Both sides are in buckets; a broadcast or a shuffle would do work that has been done.
    joined = found.join(last.hint("merge"), F.col(key) == F.col("__key"), "left").drop("__key")
    same = F.col("last.input_hash").eqNullSafe(F.col("input_hash")) & F.col("last.options_hash").eqNullSafe(options_hash(o)) & F.col("last.error").isNull()
    return joined.withColumn("stale", ~F.coalesce(same, F.lit(False)))


def convert_changed(spark: SparkSession, pages: str, manifest: str | None, key: str, o: Options | None = None, html: str = "html", backend: Backend | None = None) -> DataFrame:
    """The pages that are stale, converted: key, input_hash, options_hash, output_hash, markdown, error."""
    o = o or Options()
    stale = compared(spark, pages, manifest, key, o, html).filter("stale").select(key, "input_hash", F.col(html).alias("html"))
    done = convert_table(stale, o, backend=backend)
    text = F.col("result.markdown")
    return done.select(key, "input_hash", F.lit(options_hash(o)).alias("options_hash"), F.sha2(text.cast("binary"), 256).alias("output_hash"), text.alias("markdown"), F.col("result.error").alias("error"))


def next_manifest(spark: SparkSession, pages: str, manifest: str | None, name: str, key: str, buckets: int, o: Options | None = None, html: str = "html", backend: Backend | None = None) -> DataFrame:
    """Runs a conversion: the outputs of stale pages become the table ``name``_outputs, and the table ``name`` the manifest of
    all pages, with ``converted`` and ``changed`` (the output is new or differs from the last run's). Pages that are gone
    aren't in it."""
    o = o or Options()
    save_bucketed(convert_changed(spark, pages, manifest, key, o, html, backend), f"{name}_outputs", key, buckets)
    fresh = spark.table(f"{name}_outputs").drop("markdown")
    if manifest is None:
        out = fresh.withColumns({"converted": F.lit(True), "changed": F.lit(True)})
    else:
        kept = compared(spark, pages, manifest, key, o, html).filter("not stale").select(key, "last.*", F.lit(False).alias("converted"), F.lit(False).alias("changed"))
        old = spark.table(manifest).select(F.col(key).alias("__key"), F.col("output_hash").alias("__old")).hint("merge")
        differs = ~F.col("__old").eqNullSafe(F.col("output_hash"))
        out = kept.unionByName(fresh.join(old, F.col(key) == F.col("__key"), "left").select(*fresh.columns, F.lit(True).alias("converted"), differs.alias("changed")))
    save_bucketed(out, name, key, buckets)
    return spark.table(name)
