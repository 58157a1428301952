"""HTML files as a data source, for batch reads and for streams.

``spark.read.format("html_pages").option("recursive", "true").load(path)`` lists files on the driver, packs small ones into
input partitions of about ``partitionBytes`` and decodes each file by itself: one whose bytes aren't text in its encoding, or
that is gone when it is read, is a row with an error and no html.

As a stream the offset is a time, and a batch holds the files whose modification time lies between two offsets; it is found
again by listing, so a number is all that is kept, and it never goes back. Files are to appear whole, by a rename or in one
write, with the time at which they appear. The offset stays ``settleSeconds`` behind the driver's clock, as others of the same
time may still come and clocks differ.
"""

from __future__ import annotations

import json
import time
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from papyrine.sources.files import _glob_regex, glob_base
from papyrine.sources.store import HTML, File, codec, decoded, listed, packed, scheme, store

PAGE = "path string, base string, html string, error string, size long, modified timestamp"
#: Bytes and files that a task reads at a time.
READ_BYTES, READ_FILES = 8 << 20, 256
_ARROW = pa.schema([("path", pa.string()), ("base", pa.string()), ("html", pa.string()), ("error", pa.string()), ("size", pa.int64()), ("modified", pa.timestamp("us", "UTC"))])


class Files(InputPartition):
    """The files of one task."""

    def __init__(self, files: list[File]):
        self.files = files


class _Pages:
    """What batch and stream readers share: listing, packing, reading."""

    def __init__(self, options: dict):
        self.paths = json.loads(options["paths"]) if "paths" in options else [options["path"]]
        self.recursive = options.get("recursive", "false").lower() == "true"
        self.encoding = options.get("encoding")
        self.suffixes = tuple(options.get("suffixes", ",".join(HTML)).lower().split(","))
        self.target = int(options.get("partitionBytes", 32 << 20))
        if self.encoding:
            codec(self.encoding)
        self.settle = float(options.get("settleSeconds", 2))

    def listed(self) -> list[File]:
        found = []
        for path in self.paths:
            at = scheme(path)
            found += [f._replace(path=at + f.path, base=at + f.base) for f in listed(path, self.recursive, glob_base, _glob_regex, self.suffixes)]
        return found

    def pack(self, files: list[File]) -> list[Files]:
        return [Files(b) for b in packed(files, self.target)] if files else []

    def read(self, partition: Files):
        where = store(self.paths[0])[0]

        def one(f: File) -> tuple:
            try:
                with where.open_input_stream(f.path[len(scheme(f.path)) :]) as source:
                    raw = source.read()
            except OSError as e:
                return None, f"could not read {f.path}: {type(e).__name__}", f.size
            html, wrong = decoded(raw, self.encoding)
            return html, wrong and f"could not decode {f.path} as {wrong} (invalid byte sequence)", len(raw)

        with ThreadPoolExecutor(8) as pool:
            at = 0
            while at < len(partition.files):
                size, part = 0, []
                while at < len(partition.files) and len(part) < READ_FILES and (not part or size + partition.files[at].size <= READ_BYTES):
                    part.append(partition.files[at])
                    size, at = size + partition.files[at].size, at + 1
                html, error, sizes = zip(*pool.map(one, part), strict=True)
                columns = [[f.path for f in part], [f.base for f in part], html, error, sizes, [f.modified // 1000 for f in part]]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _ARROW.types, strict=True)], schema=_ARROW)


class PageReader(_Pages, DataSourceReader):
    def partitions(self) -> list[Files]:
        return self.pack(self.listed()) or [Files([])]


class PageStreamReader(_Pages, DataSourceStreamReader):
    last: int | None = None

    def initialOffset(self) -> dict:
        return {"before": 0}

    def latestOffset(self) -> dict:
        before = time.time_ns() - int(self.settle * 1e9)
        if self.last is None or any(self.last <= f.modified < before for f in self.listed()):
            self.last = before
        return {"before": self.last}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        return self.pack([f for f in self.listed() if start["before"] <= f.modified < end["before"]])


class PageSource(DataSource):
    """Options: path or paths, recursive, encoding, suffixes (of files in folders, comma-separated), partitionBytes,
    settleSeconds (streams)."""

    @classmethod
    def name(cls) -> str:
        return "html_pages"

    def schema(self) -> str:
        return PAGE

    def reader(self, schema) -> PageReader:
        return PageReader(self.options)

    def streamReader(self, schema) -> PageStreamReader:
        return PageStreamReader(self.options)


def _source(spark: SparkSession, reader, paths: tuple, options: dict):
    spark.dataSource.register(PageSource)
    named = {k: str(v).lower() if isinstance(v, bool) else str(v) for k, v in options.items() if v is not None}
    return reader.format("html_pages").options(**named, paths=json.dumps(list(paths))).load()


def read_pages(spark: SparkSession, *paths: str, **options) -> DataFrame:
    """(path, base, html, error, size, modified) of files, folders and globs of one store."""
    return _source(spark, spark.read, paths, options)


def stream_pages(spark: SparkSession, *paths: str, **options) -> DataFrame:
    """The same rows as a stream: each file once, as it appears."""
    return _source(spark, spark.readStream, paths, options)
