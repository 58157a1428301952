"""Scans of HTML files, and sinks: a Markdown file for each row, standard output, tables."""

from __future__ import annotations

import os
import re
import sys
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrine.plans import batch
from papyrine.sources.store import codec, decoded

_WILD = re.compile(r"[*?\[]")
_HTML = r"(?i)[.]html?$"


def glob_base(pattern: str) -> str:
    """The folder that a glob's literal part names; outputs are mirrored below it. A plain path is its own base."""
    m = _WILD.search(pattern)
    if not m:
        return pattern
    literal = pattern[: m.start()]
    return literal.rstrip("/") or "/" if literal.endswith("/") else (os.path.dirname(literal) or ".")


def _glob_regex(pattern: str) -> str:
    """A pattern over whole paths: ``**`` spans folders, ``*`` and ``?`` stay in a name."""
    out, i = "", 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out, i = out + "(?:[^/]+/)*", i + 3
            continue
        if pattern.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        c = pattern[i]
        if c == "[" and (end := pattern.find("]", i + 2)) > 0:
            out, i = out + "[" + pattern[i + 1 : end].replace("!", "^", 1) + "]", end + 1
            continue
        out += {"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c))
        i += 1
    return f"(?:^|/){out.lstrip('/')}$"


def _is_folder(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return store.exists(at) and store.getFileStatus(at).isDirectory()


def read_html(spark: SparkSession, *paths: str, recursive: bool = False, encoding: str | None = None) -> DataFrame:
    """(path, base, html, error, modified) of files, folders (.html and .htm in any case) and globs.

    A file that is named is read whatever its suffix is; ``base`` is the folder that outputs are mirrored below. A file
    whose bytes aren't text in its encoding has an error and no html. A file that several inputs name comes once for
    each base; contents are never shuffled.
    """
    parts = []
    for p in paths:
        scan = spark.read.format("binaryFile")
        if _WILD.search(p):
            base = glob_base(p)
            df = scan.option("recursiveFileLookup", "**" in p).load(base if "**" in p else p)
            df = df.filter(F.col("path").rlike(_glob_regex(p))) if "**" in p else df
        elif _is_folder(spark, p):
            base = p
            df = scan.option("recursiveFileLookup", recursive).load(p).filter(F.col("path").rlike(_HTML))
        else:
            base = os.path.dirname(p) or "."
            df = scan.load(p)
        parts.append(df.withColumn("base", F.lit(base)))
    df = parts[0]
    for more in parts[1:]:
        df = df.unionByName(more)
    out = df.withColumn("__text", decode(F.col("content"), encoding))
    return out.select("path", "base", "__text.html", "__text.error", F.col("modificationTime").alias("modified"))


def decode(content: Column, encoding: str | None = None) -> Column:
    """(html, error) of bytes: by a byte-order mark, else the given encoding, else UTF-8. Bytes that aren't that have an error
    and no html, whatever the encoding is; an unknown encoding is refused outright."""
    if encoding:
        codec(encoding)

    @F.pandas_udf("html string, error string")
    def run(part: pd.Series) -> pd.DataFrame:
        rows = [(None, None) if raw is None else decoded(raw, encoding) for raw in part]
        error = [wrong and f"could not decode as {wrong} (invalid byte sequence)" for _, wrong in rows]
        return pd.DataFrame({"html": pd.Series([t for t, _ in rows], dtype=object), "error": pd.Series(error, dtype=object)})

    return run(content)


def read_stdin(spark: SparkSession, stream=None) -> DataFrame:
    """One document without a path, from standard input."""
    raw = (stream or sys.stdin.buffer).read()
    one = spark.createDataFrame([(None, bytearray(raw))], "path string, content binary")
    return one.select("path", decode(F.col("content"))["html"].alias("html"))


def write_stdout(done: DataFrame, column: str = "markdown", stream=None) -> int:
    """Writes the texts one after the other, a partition at a time, so the driver holds no more than that."""
    out, n = stream or sys.stdout, 0
    for row in done.select(column).toLocalIterator():
        out.write(row[0] or "")
        n += 1
    return n


POLICIES = ("overwrite", "skip-existing", "fail-if-exists")


def _local(path: str) -> str:
    return path.removeprefix("file://").removeprefix("file:")


def write_files(done: DataFrame, policy: str = "overwrite", atomic: bool = True, timestamps: bool = False, dry_run: bool = False) -> DataFrame:
    """A file for each row (output_path, markdown, and ``modified`` where timestamps are kept) in a folder that all
    executors share; returns (output_path, written, skipped), evaluated when it is asked for.

    Two rows with one output, and with fail-if-exists an output that is there, stop the job before anything is written.
    An atomic file is written under a name of its own and renamed, so a lost task leaves no torn file and its rerun ends
    with the same files. A dry run only says what would be written.
    """
    if policy not in POLICIES:
        raise ValueError(f"policy {policy!r} is none of {', '.join(POLICIES)}")
    twice = batch.collisions(done).limit(1).collect()
    if twice:
        raise ValueError(f"{twice[0][1]} inputs map to the same output {twice[0][0]}; mirror folders to keep them apart")
    columns = ["output_path", "markdown"] + (["modified"] if timestamps else [])

    def there(batches):
        for b in batches:
            yield pd.DataFrame({"output_path": [p for p in b["output_path"] if os.path.exists(_local(p))]})

    if policy == "fail-if-exists":
        found = done.select("output_path").mapInPandas(there, "output_path string").limit(1).collect()
        if found:
            raise FileExistsError(found[0][0])

    def run(batches):
        for b in batches:
            out = []
            for i, (path, text) in enumerate(zip(b["output_path"], b["markdown"], strict=True)):
                at = _local(path)
                skip = policy == "skip-existing" and os.path.exists(at)
                if not skip and not dry_run:
                    os.makedirs(os.path.dirname(at) or ".", exist_ok=True)
                    own = f"{at}.{uuid.uuid4().hex}.tmp" if atomic else at
                    with open(own, "w", encoding="utf-8", newline="") as f:
                        f.write(text or "")
                    if timestamps and not pd.isna(b["modified"].iloc[i]):
                        os.utime(own, (b["modified"].iloc[i].timestamp(),) * 2)
                    if atomic:
                        os.replace(own, at)
                out.append((path, not skip and not dry_run, skip))
            yield pd.DataFrame(out, columns=["output_path", "written", "skipped"])

    return done.select(*columns).mapInPandas(run, "output_path string, written boolean, skipped boolean")


def write_markdown(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """The converted table as Parquet; Spark's commit protocol makes it all or nothing."""
    df.write.mode(mode).parquet(path)
