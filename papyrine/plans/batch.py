"""The batch layer as DataFrame operations: output paths, collisions, hashes, change detection, manifests, diffs."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def output_path(path: Column, directory: str, base: str = "", mirror: bool = False) -> Column:
    """``directory``/stem.md; with ``mirror`` the path below ``base`` is kept."""
    if mirror:
        rest = F.regexp_replace(F.replace(path, F.lit(base), F.lit("")), "^/+", "")
    else:
        rest = F.regexp_extract(path, r"([^/]*)$", 1)
    return F.concat(F.lit(f"{directory.rstrip('/')}/"), F.regexp_replace(rest, r"(?<=[^/])\.[^./]*$", ""), F.lit(".md"))


def collisions(jobs: DataFrame, output: str = "output_path") -> DataFrame:
    """Outputs that several inputs would write."""
    return jobs.groupBy(output).agg(F.count(F.lit(1)).alias("inputs")).filter("inputs > 1")


def records(jobs: DataFrame, previous: DataFrame | None = None, policy: str = "overwrite") -> DataFrame:
    """Adds input_hash, output_hash, changed and skipped to jobs (input_path, output_path, html, markdown).

    ``previous`` (output_path, markdown) is what is there already; with the policy skip-existing those are skipped,
    with fail-if-exists the first one raises.
    """
    out = jobs.withColumns({"input_hash": F.sha2(F.col("html").cast("binary"), 256), "output_hash": F.sha2(F.col("markdown").cast("binary"), 256)})
    if previous is None:
        return out.withColumns({"changed": F.lit(True), "skipped": F.lit(False)})
    # Hashes travel, old texts don't.
    old = previous.select("output_path", F.sha2(F.col("markdown").cast("binary"), 256).alias("__old"), F.lit(True).alias("__there"))
    out = out.join(old, "output_path", "left")
    there = F.coalesce("__there", F.lit(False))
    if policy == "fail-if-exists":
        stop = F.raise_error(F.concat(F.lit("output exists: "), F.col("output_path")))
        out = out.filter(F.when(there, stop.cast("boolean")).otherwise(True))
    skipped = there if policy == "skip-existing" else F.lit(False)
    return out.withColumns({"changed": ~F.col("__there").eqNullSafe(True) | ~F.col("output_hash").eqNullSafe(F.col("__old")), "skipped": skipped}).drop("__old", "__there")


def manifest(found: DataFrame) -> DataFrame:
    """Counts of a run; the per-file rows stay a table, as a list of them would grow with the input."""
    return found.agg(
        F.count(F.lit(1)).alias("files"),
        F.count_if(F.col("changed") & ~F.col("skipped")).alias("changed"),
        F.count_if("skipped").alias("skipped"),
        (F.count_if(F.col("error").isNotNull()) if "error" in found.columns else F.lit(0).cast("long")).alias("errors"),
    )


def diagnostics(found: DataFrame, key: str = "input_path", result: str = "result") -> DataFrame:
    """A row for each diagnostic and error of converted documents: the key, kind, rule, message."""
    listed = found.select(key, F.explode(f"{result}.diagnostics").alias("d")).select(key, "d.kind", "d.rule", "d.message")
    failed = found.filter(F.col(f"{result}.error").isNotNull())
    return listed.unionByName(failed.select(key, F.lit("error").alias("kind"), F.lit("").alias("rule"), F.col(f"{result}.error").alias("message")))


def write_manifest(found: DataFrame, path: str) -> None:
    """The manifest as JSON: a line for each file below ``path``/files, and the counts below ``path``/counts."""
    wanted = ("input_path", "output_path", "title", "description", "canonical_url", "input_hash", "output_hash", "skipped", "changed", "error")
    found.select(*[c for c in wanted if c in found.columns]).write.mode("overwrite").json(f"{path}/files")
    manifest(found).coalesce(1).write.mode("overwrite").json(f"{path}/counts")


def triage(found: DataFrame) -> DataFrame:
    """How many documents failed, by the kind of error."""
    return found.groupBy(F.coalesce(F.substring_index("error", ":", 1), F.lit("ok")).alias("outcome")).agg(F.count(F.lit(1)).alias("files"))


@F.pandas_udf(StringType())
def line_diff(old: pd.Series, new: pd.Series) -> pd.Series:
    """Lines that go (-) and come (+); null where nothing changes."""

    def one(a, b):
        d = [x for x in difflib.ndiff((a or "").splitlines(), (b or "").splitlines()) if x[0] in "+-"]
        return "\n".join(f"{x[0]}{x[2:]}" for x in d) or None

    return pd.Series([one(a, b) for a, b in zip(old, new, strict=True)])
