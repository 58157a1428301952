"""Files of a store that driver and executors share, by path or URI: listing, packing, decoding."""

from __future__ import annotations

import codecs
import heapq
import os
import re
import tempfile
import uuid
from typing import NamedTuple

from pyarrow import fs
from pyspark.sql import SparkSession

#: What a file costs to open, in bytes that could be read meanwhile.
OPEN_COST = 1 << 16

# Labels of web encodings whose decoder isn't the one that Python has under the same name.
LABELS = {
    "ascii": "cp1252", "us-ascii": "cp1252", "latin1": "cp1252", "l1": "cp1252", "iso-8859-1": "cp1252", "iso8859-1": "cp1252",
    "iso_8859-1": "cp1252", "windows-1252": "cp1252", "x-cp1252": "cp1252", "utf-16": "utf-16-le", "utf8": "utf-8",
    "shift_jis": "cp932", "shift-jis": "cp932", "sjis": "cp932", "windows-31j": "cp932", "x-sjis": "cp932", "gb2312": "gbk", "euc-kr": "cp949", "ks_c_5601-1987": "cp949",
}
BOMS = ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be"))


def codec(label: str) -> str:
    """The name of Python's decoder for an encoding's label; ValueError where there is none."""
    name = label.strip().lower()
    try:
        return codecs.lookup(LABELS.get(name, name)).name
    except LookupError:
        raise ValueError(f"unknown encoding: {label}") from None


def _same(e: UnicodeDecodeError):
    """Bytes that windows-1252 doesn't define are the control characters of the same number."""
    return "".join(map(chr, e.object[e.start : e.end])), e.end


codecs.register_error("papyrine-same", _same)


def decoded(raw: bytes, encoding: str | None = None) -> tuple[str | None, str | None]:
    """(text, None), or (None, name of the encoding that the bytes aren't). A byte-order mark decides, then the given
    encoding, then UTF-8."""
    mark, name = next(((m, n) for m, n in BOMS if raw.startswith(m)), (b"", codec(encoding) if encoding else "utf-8"))
    try:
        return raw[len(mark) :].decode(name, "papyrine-same" if name == "cp1252" else "strict"), None
    except UnicodeDecodeError:
        return None, name


def store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI and the path within it. A path without a scheme is local to every machine."""
    if re.match(r"[A-Za-z][A-Za-z0-9+.-]+:/", path):
        return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    return fs.LocalFileSystem(), os.path.abspath(path)


def scheme(path: str) -> str:
    """What stands before a store's own path in a URI of the same store."""
    found = re.match(r"([A-Za-z][A-Za-z0-9+.-]+://[^/]*)/", path)
    return found[1] if found and not path.startswith("file:") else ""


class File(NamedTuple):
    path: str
    base: str
    size: int
    modified: int


HTML = (".html", ".htm")


def listed(path: str, recursive: bool, glob_base, glob_regex, suffixes: tuple[str, ...] = HTML) -> list[File]:
    """The files that an input names: a file itself, a folder's files with one of the suffixes, what a glob matches (of a
    folder that it matches, that folder's files). Folders that begin with ``_`` are the sinks' own and aren't searched."""
    files, inner = store(path)

    def entry(info: fs.FileInfo, base: str) -> File:
        return File(info.path, base, info.size or 0, info.mtime_ns or 0)

    def below(folder: str, deep: bool, base: str) -> list[File]:
        found = files.get_file_info(fs.FileSelector(folder, recursive=deep))
        own = (x for x in found if x.is_file and x.base_name.lower().endswith(suffixes))
        return [entry(x, base) for x in own if not re.search(r"(^|/)_", x.path[len(folder) :])]

    if re.search(r"[*?\[]", inner):
        base = glob_base(inner)
        fits = re.compile(glob_regex(inner)).search
        out = {}
        for x in files.get_file_info(fs.FileSelector(base, recursive=True)):
            if fits(x.path):
                for f in [entry(x, base)] if x.is_file else below(x.path, recursive, base):
                    out[f.path] = f
        return list(out.values())
    info = files.get_file_info(inner)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    return below(inner, recursive, inner) if info.type == fs.FileType.Directory else [entry(info, os.path.dirname(inner) or ".")]


def packed(files: list[File], target: int) -> list[list[File]]:
    """Files dealt to bins of about ``target`` bytes: the largest first, each to the bin that has least so far. So bins
    differ by one file at most, and a file that is larger than a bin has one for itself."""
    total = sum(f.size + OPEN_COST for f in files)
    n = max(1, min(len(files), -(-total // target)))
    bins: list[list[File]] = [[] for _ in range(n)]
    least = [(0, k) for k in range(n)]
    for f in sorted(files, key=lambda f: (-f.size, f.path)):
        size, k = least[0]
        bins[k].append(f)
        heapq.heapreplace(least, (size + f.size + OPEN_COST, k))
    return [b for b in bins if b]


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path where driver and executors both find it: below ``spark.checkpoint.dir``; only where that is unset,
    as on one machine, in a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="papyrine-")
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found.rstrip('/')}/{name}-{uuid.uuid4().hex}"
