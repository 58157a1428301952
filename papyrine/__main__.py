"""Command line: ``python -m papyrine INPUT... [options]``; files, folders and globs to Markdown by Spark.

Exit codes: 0, 1 where a conversion failed or a file couldn't be read, 2 for settings, undecodable inputs, outputs that may
not be written, and a check that found changes.
"""

from __future__ import annotations

import argparse
import os
import re
import sys

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrine.convert import convert_table
from papyrine.options import CHOICES, METADATA, ConfigError, Options, discover, load_options, show
from papyrine.plans.batch import diagnostics
from papyrine.plans.diff import line_changes
from papyrine.sources.files import read_stdin, write_stdout
from papyrine.sources.pages import read_pages
from papyrine.sources.sink import POLICIES, save_files

#: Settings with an option of their own: the option's name and the setting's.
WORDS = {"profile": "profile", "heading-style": "heading_style", "bullet": "bullet_marker", "link-style": "link_style", "reference-placement": "reference_placement", "image-mode": "image_mode", "code-fence": "code_fence", "hr-style": "hr_style", "br-style": "hard_break_style"}
LISTS = {"skip-tags": "remove_tags", "remove-selectors": "remove_selectors", "unwrap-selectors": "unwrap_selectors", "keep-only-selectors": "keep_only_selectors"}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="papyrine", description="Clean Markdown or text from HTML files")
    p.add_argument("inputs", nargs="*", help="files, folders (.html and .htm) or globs; - or none: standard input")
    p.add_argument("-o", "--output", metavar="PATH", help="output file of a single input; -: standard output")
    p.add_argument("--output-dir", metavar="DIR", help="folder of outputs (default with several inputs: the current one)")
    p.add_argument("-m", "--mirror", action="store_true", help="keep folders below an input's own")
    p.add_argument("-r", "--recursive", action="store_true")
    p.add_argument("--output-policy", choices=POLICIES, default="overwrite")
    p.add_argument("--atomic", action="store_true", help="outputs appear whole, by a rename; they always do")
    p.add_argument("--preserve-timestamps", action="store_true")
    p.add_argument("--manifest", metavar="NAME", help="name of the manifest below the output folder (default: manifest.json)")
    for name in ("check", "diff", "dry-run", "strict", "normalize-whitespace", "print-default-config", "print-effective-config"):
        p.add_argument(f"--{name}", action="store_true")
    p.add_argument("--encoding")
    p.add_argument("-c", "--config", metavar="PATH", help="TOML or JSON")
    for name, setting in WORDS.items():
        p.add_argument(f"--{name}", choices=CHOICES[setting], dest=setting)
    for name, setting in LISTS.items():
        p.add_argument(f"--{name}", dest=setting, type=lambda x: tuple(x.split(",")))
    p.add_argument("--extract-selector")
    p.add_argument("--base-url")
    p.add_argument("--remove-tracking-params", nargs="?", const="true", choices=("true", "false"))
    for name in ("title", "description", "canonical_url"):
        p.add_argument(f"--metadata-{name.replace('_', '-')}", action="append_const", dest="metadata", const=METADATA[name])
    p.add_argument("-j", "--jobs", type=int, help="local cores; 0: all")
    p.add_argument("-q", "--quiet", action="store_true")
    p.add_argument("-v", "--verbose", action="count", default=0)
    return p


def options(a: argparse.Namespace) -> Options:
    """Configuration files, the environment, then the command line."""
    flags = {n: getattr(a, n) for n in [*WORDS.values(), *LISTS.values(), "extract_selector", "base_url"]}
    flags |= {"strict": a.strict or None, "normalize_whitespace": a.normalize_whitespace or None}
    if a.remove_tracking_params:
        flags["remove_tracking_params"] = a.remove_tracking_params == "true"
    if a.metadata:
        flags["metadata"] = tuple(a.metadata)
    o = load_options(*([a.config] if a.config else discover()), **flags)
    # On the command line metadata is asked for by field.
    return o if o.metadata is not None else load_options(*([a.config] if a.config else discover()), **flags, metadata=())


def say(*lines: str) -> None:
    for x in lines:
        print(f"papyrine: {x}", file=sys.stderr)


def outputs(pages: DataFrame, mirror: bool) -> DataFrame:
    """``output_path`` below the output folder: the file's name, or with ``mirror`` its path below its input's folder."""
    below = F.regexp_replace(F.expr("substring(path, length(base) + 1)"), "^/+", "") if mirror else F.regexp_extract("path", "([^/]*)$", 1)
    return pages.withColumn("output_path", F.concat(F.regexp_replace(below, r"(?<=[^/])\.[^./]*$", ""), F.lit(".md")))


def run(a: argparse.Namespace, spark: SparkSession) -> int:
    o = options(a)
    several = len(a.inputs) != 1 or any(re.search(r"[*?\[]", x) or os.path.isdir(x) for x in a.inputs)
    stdin = not a.inputs or a.inputs == ["-"]
    pages = read_stdin(spark).withColumns({"error": F.lit(None).cast("string"), "modified": F.lit(None).cast("timestamp")}) if stdin else read_pages(spark, *a.inputs, recursive=a.recursive, encoding=a.encoding)
    if a.output and not a.output_dir and not stdin and several and pages.limit(2).count() > 1:
        raise ConfigError("an output folder is needed for several inputs")
    unread = [] if stdin else [r.error for r in pages.filter("error is not null").select("error").toLocalIterator()]
    say(*unread)
    pages = pages.filter("error is null").withColumn("input_hash", F.sha2(F.col("html").cast("binary"), 256))
    to_file = a.output if a.output and a.output != "-" and not a.output_dir else None
    if not a.output_dir and not to_file and (stdin or not several):
        done = convert_table(pages, o)
        failed = [r for r in done.select("result.error").collect() if r.error] if stdin or not several else []
        say(*(r.error for r in failed))
        if not failed and not a.dry_run and not a.check:
            write_stdout(done.select(F.col("result.markdown").alias("markdown")))
        return 1 if failed else 2 if unread else 0
    root = os.path.dirname(os.path.abspath(to_file)) if to_file else os.path.abspath(a.output_dir or ".")
    named = pages.withColumn("output_path", F.lit(os.path.basename(to_file))) if to_file else outputs(pages, a.mirror)
    done = convert_table(named, o)
    rows = done.select(F.col("path").alias("input_path"), "output_path", "input_hash", "modified", *(f"result.{c}" for c in ("markdown", "title", "description", "canonical_url", "diagnostics", "error")))
    if a.verbose and not a.quiet:
        say(*(f"[{d.input_path or '<stdin>'}] {d.kind}: {d.message}" for d in diagnostics(done.withColumn("input_path", F.col("path"))).toLocalIterator()))
    if a.dry_run:
        if not a.quiet:
            say("dry run, no output will be written", *(f"would write {r.output_path}" for r in rows.filter("error is null").select("output_path").toLocalIterator()))
        return 1 if rows.filter("error is not null").limit(1).count() else 2 if unread else 0
    records = save_files(rows, root, policy=a.output_policy, check=a.check, timestamps=a.preserve_timestamps, manifest=a.manifest or "manifest.json")
    counts = records.agg(F.count_if("changed").alias("changed"), F.count_if(F.col("error").isNotNull()).alias("errors")).first()
    if not a.quiet and not a.check:
        say(*(f"skipped {r.input} (output exists)" if r.skipped else f"converted {r.input}" for r in records.filter("error is null").toLocalIterator()))
    say(*(f"{r.input}: {r.error}" for r in records.filter("error is not null").toLocalIterator()))
    if a.check and a.diff and counts.changed:
        changed = records.filter("changed").select(F.col("output").alias("output_path")).join(rows, "output_path")
        there = read_pages(spark, root, recursive=True, suffixes=".md").select(F.expr(f"substring(path, {len(root) + 2})").alias("output_path"), F.col("html").alias("old"))
        found = changed.join(there, "output_path", "left").select(F.col("output_path").alias("path"), "old", F.col("markdown").alias("new"))
        for x in line_changes(found).orderBy("path", "line", F.desc("sign")).toLocalIterator():
            print(f"{x.path}:{x.line + 1}: {x.sign}{x.text}", file=sys.stderr)
    if a.check and counts.changed:
        say(f"--check failed: {counts.changed} output(s) changed")
        return 2
    return 2 if unread else 1 if counts.errors else 0


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    try:
        a = parser().parse_args(argv)
    except SystemExit as e:
        return int(e.code or 0)
    try:
        if a.print_default_config:
            print(show(Options(), "toml"), end="")
            return 0
        if a.print_effective_config:
            print(show(options(a)))
            return 0
        if a.dry_run and a.check:
            raise ConfigError("--dry-run and --check exclude each other")
        own = spark or SparkSession.builder.appName("papyrine").config("spark.master", f"local[{a.jobs or '*'}]").config("spark.ui.showConsoleProgress", "false").getOrCreate()
        try:
            return run(a, own)
        finally:
            if spark is None:
                own.stop()
    except (ConfigError, ValueError) as e:
        say(f"configuration error: {e}")
        return 2
    except PySparkException as e:
        found = re.search(r"(FileExistsError|FileNotFoundError|ValueError|OSError): ([^\n]*)", str(e))
        say(found[2] if found else str(e))
        return 2 if found and found[1] in ("FileExistsError", "ValueError") else 1
    except OSError as e:
        say(str(e))
        return 1


if __name__ == "__main__":
    sys.exit(main())
