"""Markdown files as a sink with a job commit, for batch writes and for streams.

A task writes its files to a folder of its own below ``_staging``; the message that it ends with names that folder and has
counts, while the records of its files stay there as lines of JSON. Only when all tasks have ended the driver moves the files
of the attempts that count to their places, a rename each, and then writes the manifest, which so says that all of them are
there. A failed job deletes what was staged; an attempt whose message doesn't count is deleted with it. Nothing of a task is
ever seen at an output's place before the commit.

In a stream each batch has a manifest by its number. A batch whose manifest is there has been committed, and its repetition is
dropped.
"""

from __future__ import annotations

import hashlib
import json
import posixpath
import time
import uuid
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceStreamArrowWriter, WriterCommitMessage

from papyrine.plans import batch
from papyrine.sources.store import store

POLICIES = ("overwrite", "skip-existing", "fail-if-exists")
#: Columns that a record takes over from a row, where they are there.
CARRIED = {"input_path": "input", "title": "title", "description": "description", "canonical_url": "canonical_url", "input_hash": "input_hash", "diagnostics": "diagnostics", "error": "error"}
RECORDS = "records.jsonl"
#: Bytes of a batch on its way to a Python worker while files are written.
BATCH_BYTES = 4 << 20


@dataclass
class Staged(WriterCommitMessage):
    """A task's folder and how many of its files are what."""

    folder: str
    counts: dict


class _Sink:
    """What batch and stream writers share. Options: path (the outputs' root), policy, check (compare, write nothing),
    timestamps (outputs get their input's), manifest (the file's name)."""

    def __init__(self, options: dict, schema):
        self.root, self.policy = options["path"], options.get("policy", "overwrite")
        self.check, self.timestamps = (options.get(k, "false").lower() == "true" for k in ("check", "timestamps"))
        self.manifest = options.get("manifest", "manifest.json")
        if self.policy not in POLICIES:
            raise ValueError(f"policy {self.policy!r} is none of {', '.join(POLICIES)}")
        if missing := {"output_path", "markdown"} - set(schema.names):
            raise ValueError(f"no column {', '.join(sorted(missing))}")

    #: The folder below ``_staging`` that a job's tasks share.
    job = ""

    def _store(self) -> tuple[fs.FileSystem, str, str]:
        files, root = store(self.root)
        return files, root.rstrip("/"), f"{root.rstrip('/')}/_staging/{self.job}"

    def write(self, batches) -> Staged:
        files, root, staging = self._store()
        own = f"{staging}/{uuid.uuid4().hex}"
        self._begin(files, staging)
        files.create_dir(own, recursive=False)
        counts = {"files": 0, "changed": 0, "skipped": 0, "errors": 0}
        made, seen = {own}, set()
        with files.open_output_stream(f"{own}/{RECORDS}") as records:
            for b in (part for whole in batches for part in _parts(whole)):
                for row in b.to_pylist():
                    record = self._one(files, root, own, row, made, seen)
                    counts["files"] += 1
                    counts["changed"] += record["changed"] is True
                    counts["skipped"] += record["skipped"]
                    counts["errors"] += record.get("error") is not None
                    records.write(json.dumps(record, ensure_ascii=False, default=str).encode() + b"\n")
        return Staged(own, counts)

    def _one(self, files, root: str, own: str, row: dict, made: set, seen: set) -> dict:
        name = posixpath.normpath(row["output_path"] or "")
        if name.startswith(("/", "../", "_staging/")) or name in ("", ".", ".."):
            raise ValueError(f"output path {row['output_path']!r} isn't below the sink's folder")
        if name in seen:
            raise ValueError(f"several inputs map to the same output {name}; mirror folders to keep them apart")
        seen.add(name)
        text = (row["markdown"] or "").encode()
        record = {v: row.get(k) for k, v in CARRIED.items() if k in row} | {"output": name, "output_hash": hashlib.sha256(text).hexdigest(), "skipped": False, "changed": None, "written": False}
        if record.get("diagnostics"):
            record["diagnostics"] = [f"{d['kind']}: {d['message']}" if isinstance(d, dict) else d for d in record["diagnostics"]]
        if record.get("error") is not None:
            return record
        if self.check:
            record["changed"] = self._differs(files, f"{root}/{name}", text)
            return record
        if self.policy != "overwrite" and files.get_file_info(f"{root}/{name}").type != fs.FileType.NotFound:
            if self.policy == "fail-if-exists":
                raise FileExistsError(f"output file already exists (fail-if-exists): {name}")
            record["skipped"] = True
            return record
        # One level after the other: a task that outlives its job must not make the job's folder anew.
        levels = posixpath.dirname(f"files/{name}").split("/")
        for k in range(len(levels)):
            folder = "/".join([own, *levels[: k + 1]])
            if folder not in made:
                files.create_dir(folder, recursive=False)
                made.add(folder)
        with files.open_output_stream(f"{own}/files/{name}") as out:
            out.write(text)
        if self.timestamps and row.get("modified") is not None:
            self._keep_time(files, f"{own}/files/{name}", row["modified"].timestamp())
        return record | {"written": True}

    @staticmethod
    def _differs(files, path: str, text: bytes) -> bool:
        info = files.get_file_info(path)
        if info.type != fs.FileType.File or info.size != len(text):
            return True
        with files.open_input_stream(path) as there:
            return there.read() != text

    @staticmethod
    def _keep_time(files, path: str, seconds: float) -> None:
        """Object stores set times themselves; only a mounted folder can keep another one."""
        if isinstance(files, fs.LocalFileSystem):
            import os

            os.utime(path, (seconds, seconds))

    def _publish(self, messages: list, manifest: str) -> None:
        files, root, staging = self._store()
        good = [m for m in messages if m is not None]
        made: set[str] = set()

        def move(folder: str, name: str) -> None:
            files.move(f"{folder}/files/{name}", f"{root}/{name}")

        totals = {k: sum(m.counts[k] for m in good) for k in ("files", "changed", "skipped", "errors")}
        files.create_dir(posixpath.dirname(f"{root}/{manifest}"))
        files.create_dir(staging)
        with files.open_output_stream(f"{staging}/manifest") as out, ThreadPoolExecutor(16) as pool:
            out.write(b'{"files": [')
            first = True
            for m in good:
                with files.open_input_stream(f"{m.folder}/{RECORDS}", compression=None, buffer_size=1 << 20) as lines:
                    moves = []
                    for line in _lines(lines):
                        record = json.loads(line)
                        if record.pop("written"):
                            folder = posixpath.dirname(f"{root}/{record['output']}")
                            if folder not in made:
                                files.create_dir(folder)
                                made.add(folder)
                            moves.append(pool.submit(move, m.folder, record["output"]))
                            if len(moves) >= 4096:
                                _done(moves)
                        out.write((b"\n" if first else b",\n") + json.dumps(record, ensure_ascii=False).encode())
                        first = False
                    _done(moves)
            out.write(f'\n], "changed_count": {totals["changed"]}, "skipped_count": {totals["skipped"]}, "error_count": {totals["errors"]}}}\n'.encode())
        # The manifest comes last: where it is, all outputs are.
        files.move(f"{staging}/manifest", f"{root}/{manifest}")
        self._clear()

    def _begin(self, files, staging: str) -> None:
        """Called by a task before it writes."""

    def _clear(self) -> None:
        """Deletes what is staged. Tasks that still run may write meanwhile; once the folder is gone they fail."""
        files, root, staging = self._store()
        for last in (False, False, False, False, True):
            if files.get_file_info(staging).type != fs.FileType.Directory:
                break
            try:
                files.delete_dir(staging)
            except OSError:
                if last:
                    raise
                time.sleep(0.2)
        top = f"{root}/_staging"
        if files.get_file_info(top).type == fs.FileType.Directory and not files.get_file_info(fs.FileSelector(top)):
            files.delete_dir(top)


def _parts(batch, rows: int = 256):
    """A batch a few rows at a time, as Python's strings take room."""
    return (batch.slice(a, rows) for a in range(0, batch.num_rows, rows))


def _lines(stream):
    """Lines of a byte stream, a block at a time."""
    rest = b""
    while block := stream.read(1 << 20):
        *lines, rest = (rest + block).split(b"\n")
        yield from lines
    if rest:
        yield rest


def _done(moves: list) -> None:
    for m in moves:
        m.result()
    moves.clear()


class SinkWriter(_Sink, DataSourceArrowWriter):
    def __init__(self, options: dict, schema):
        super().__init__(options, schema)
        self.job = uuid.uuid4().hex
        files, _, staging = self._store()
        files.create_dir(staging)

    def commit(self, messages: list) -> None:
        self._publish(messages, self.manifest)

    def abort(self, messages: list) -> None:
        self._clear()


class SinkStreamWriter(_Sink, DataSourceStreamArrowWriter):
    """One stream writes below a root; what its lost attempts have staged goes with the next batch's commit."""

    job = "stream"

    def _begin(self, files, staging: str) -> None:
        files.create_dir(staging)

    def commit(self, messages: list, batchId: int) -> None:
        files, root, _ = self._store()
        done = f"_batches/{batchId}.json"
        if files.get_file_info(f"{root}/{done}").type == fs.FileType.File:
            self._clear()
        else:
            self._publish(messages, done)

    def abort(self, messages: list, batchId: int) -> None:
        self._clear()


class MarkdownSink(DataSource):
    """``output_path`` (below the root) and ``markdown`` to files; see ``_Sink`` for options."""

    @classmethod
    def name(cls) -> str:
        return "markdown_files"

    def writer(self, schema, overwrite: bool) -> SinkWriter:
        return SinkWriter(self.options, schema)

    def streamWriter(self, schema, overwrite: bool) -> SinkStreamWriter:
        return SinkStreamWriter(self.options, schema)


@contextmanager
def _small_batches(spark):
    """Queries that begin meanwhile hand rows to Python workers by BATCH_BYTES, whatever rows hold; a longer row goes alone."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    was = spark.conf.get(name)
    spark.conf.set(name, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(name, was)


def save_files(done: DataFrame, root: str, **options) -> DataFrame:
    """Writes ``done`` below ``root`` and returns the manifest's records (input, output, hashes, skipped, changed, error) as
    a table.

    Two rows with one output stop the job before anything is written: paths alone are counted, by a shuffle of paths. Rows
    with an error are recorded and not written. ``options`` are those of ``_Sink``.
    """
    twice = batch.collisions(done).limit(1).collect()
    if twice:
        raise ValueError(f"{twice[0][1]} inputs map to the same output {twice[0][0]}; mirror folders to keep them apart")
    spark = done.sparkSession
    spark.dataSource.register(MarkdownSink)
    named = {k: str(v).lower() if isinstance(v, bool) else str(v) for k, v in options.items()}
    with _small_batches(spark):
        done.write.format("markdown_files").options(**named, path=root).mode("append").save()
    return read_manifest(spark, root, named.get("manifest", "manifest.json"))


RECORD = "input string, output string, title string, description string, canonical_url string, input_hash string, output_hash string, skipped boolean, changed boolean, diagnostics array<string>, error string"


def read_manifest(spark, root: str, name: str = "manifest.json") -> DataFrame:
    """The records of a manifest as a table. A record is a line of the document, so it is read in splits, not whole."""
    lines = spark.read.text(f"{root.rstrip('/')}/{name}", lineSep="\n").filter(F.col("value").startswith('{"') & ~F.col("value").startswith('{"files": ['))
    return lines.select(F.from_json(F.rtrim(F.col("value"), F.lit(",")), RECORD).alias("r")).select("r.*")


def stream_files(done: DataFrame, root: str, checkpoint: str, **options):
    """A writer of the stream ``done`` (output_path, markdown, ...) below ``root``; start it for the query."""
    done.sparkSession.dataSource.register(MarkdownSink)
    named = {k: str(v).lower() if isinstance(v, bool) else str(v) for k, v in options.items()}
    return done.writeStream.format("markdown_files").options(**named, path=root).option("checkpointLocation", checkpoint).outputMode("append")
