"""Token-ID output as length-delimited binary records with a separate offset index.

A shard file is a run of records: length (u64), masked CRC-32C of the length (u32), data, masked CRC-32C of the data
(u32), all little-endian, the framing that TFRecord readers know. The data is a header (doc_id i64, flags u8 with bit 0
for a null id, id width u8, 6 zero bytes) and the ids. Beside ``shard-k.rec`` lies ``shard-k.idx``: for each record its
byte offset, doc_id and token count (three i64), so a reader can fetch records in any order.

Shards follow ascending ids. A task writes to a name of its own and renames it when it is whole, so a retried or
duplicate task can't leave a torn shard.
"""

from __future__ import annotations

import os
import uuid
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyrine.llm.common import partitions_for, shuffle_partitions, slices
from papyrine.llm.tokens import encoder

#: Reversed Castagnoli polynomial, the constant of masked checksums, and bytes that one step of the sums covers.
POLY, MASK, BLOCK = 0x82F63B78, 0xA282EAD8, 256
HEADER = 16


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Byte tables of CRC-32C for four bytes at a time, and those that carry a sum over BLOCK zero bytes."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(POLY), t >> 1).astype(np.uint32)
    step = [t]
    for _ in range(3):
        step.append((step[-1] >> 8) ^ t[step[-1] & 255])
    unit = np.uint32(1) << np.arange(32, dtype=np.uint32)
    for _ in range(BLOCK):
        unit = (unit >> np.uint32(8)) ^ t[unit & np.uint32(255)]
    far = np.zeros((4, 256), np.uint32)
    for k in range(4):
        for bit in range(8):
            far[k, (np.arange(256) >> bit) & 1 == 1] ^= unit[8 * k + bit]
    return np.stack(step), far


def crc32c(parts: list[bytes]) -> np.ndarray:
    """CRC-32C of each byte string; all are summed side by side, in blocks. Strings hold four bytes at least."""
    step, far = _tables()
    if not parts:
        return np.zeros(0, np.uint32)
    sizes = np.array([len(p) for p in parts], np.int64)
    blocks = -(-sizes // BLOCK)
    ends = np.cumsum(blocks)
    data = np.zeros(int(ends[-1]) * BLOCK, np.uint8)
    # Leading zeros don't change a sum that starts at zero; inverting the first four bytes stands for its usual start.
    for p, end, size in zip(parts, ends * BLOCK, sizes, strict=True):
        data[end - size : end] = np.frombuffer(p, np.uint8)
        data[end - size : end - size + 4] ^= 255
    words = data.view("<u4").reshape(-1, BLOCK // 4)
    sums = np.zeros(len(words), np.uint32)
    for k in range(words.shape[1]):
        x = sums ^ words[:, k]
        sums = step[3][x & 255] ^ step[2][(x >> 8) & 255] ^ step[1][(x >> 16) & 255] ^ step[0][x >> 24]
    first = ends - blocks
    out = np.zeros(len(parts), np.uint32)
    for k in range(int(blocks.max())):
        on = np.flatnonzero(blocks > k)
        x = out[on]
        out[on] = far[0][x & 255] ^ far[1][(x >> 8) & 255] ^ far[2][(x >> 16) & 255] ^ far[3][x >> 24] ^ sums[first[on] + k]
    return ~out


def masked(sums: np.ndarray) -> np.ndarray:
    """The rotated and offset form in which a checksum is stored."""
    return ((sums >> np.uint32(15)) | (sums << np.uint32(17))) + np.uint32(MASK)


def frame(datas: list[bytes]) -> list[bytes]:
    """The records of some serialized sequences."""
    heads = [len(d).to_bytes(8, "little") for d in datas]
    a, b = masked(crc32c(heads)).astype("<u4"), masked(crc32c(datas)).astype("<u4")
    return [h + a[i].tobytes() + d + b[i].tobytes() for i, (h, d) in enumerate(zip(heads, datas, strict=True))]


def unframe(blob: bytes | memoryview) -> list[memoryview]:
    """The data of the whole records in ``blob``; a wrong checksum or a torn record raises ValueError."""
    view, at, heads, datas, want = memoryview(blob), 0, [], [], []
    while at < len(view):
        size = int.from_bytes(view[at : at + 8], "little")
        end = at + 16 + size
        if end > len(view):
            raise ValueError("torn record")
        heads.append(view[at : at + 8])
        datas.append(view[at + 12 : end - 4])
        want.append((int.from_bytes(view[at + 8 : at + 12], "little"), int.from_bytes(view[end - 4 : end], "little")))
        at = end
    want = np.array(want, np.uint32).reshape(-1, 2)
    if not (np.array_equal(masked(crc32c(heads)), want[:, 0]) and np.array_equal(masked(crc32c(datas)), want[:, 1])):
        raise ValueError("wrong checksum")
    return datas


def _open(path: str):
    """A pyarrow file system and the path in it; any store that pyarrow reaches will do."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))


def _writer(path: str, tokenizer: str, end_id: int):
    def run(batches):
        shard = TaskContext.get().partitionId()
        store, at = _open(path)
        store.create_dir(at, recursive=True)
        name, own = f"{at}/shard-{shard:06d}", f"{at}/.{shard:06d}-{uuid.uuid4().hex}"
        model, offset, n_docs, n_tokens = encoder(tokenizer), 0, 0, 0
        with store.open_output_stream(own + ".rec") as rec, store.open_output_stream(own + ".idx") as idx:
            for batch in (part for whole in batches for part in slices(whole, size=4 << 20)):
                ids = model.encode(batch["text"].to_list())
                null = batch["doc_id"].isna().to_numpy()
                doc = batch["doc_id"].fillna(0).to_numpy(np.int64)
                wide = ids[0].dtype if ids else np.dtype("<u2")
                datas = [
                    doc[i].tobytes() + bytes((int(null[i]), wide.itemsize)) + bytes(6) + x.tobytes() + wide.type(end_id).tobytes()
                    for i, x in enumerate(ids)
                ]
                index = []
                for i, record in enumerate(frame(datas)):
                    rec.write(record)
                    index.append((offset, doc[i], len(ids[i]) + 1))
                    offset += len(record)
                idx.write(np.array(index, "<i8").tobytes())
                n_docs, n_tokens = n_docs + len(ids), n_tokens + sum(map(len, ids)) + len(ids)
        for kind in (".rec", ".idx"):
            store.move(own + kind, name + kind)
        yield pd.DataFrame({"shard": [shard], "docs": [n_docs], "tokens": [n_tokens]})

    return run


def write_records(docs: DataFrame, path: str, tokenizer: str, end_id: int, shards: int | None = None) -> DataFrame:
    """Encodes whole texts (null: empty), ends each with ``end_id`` and writes them under ``path``; returns the manifest.

    The manifest has a row (shard, docs, tokens, start) for each shard, start counting the ids of all shards before it.
    Documents lie in ascending doc_id order, null ids first; rows that repeat an id lie side by side. An empty table
    gives no records. ``path`` is in a store that all executors share.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.repartitionByRange(shards or partitions_for(docs, 4 * shuffle_partitions(spark)), "doc_id").sortWithinPartitions("doc_id")
    wrote = rows.mapInPandas(_writer(path, tokenizer, end_id), "shard long, docs long, tokens long")
    # As in any commit protocol, the driver gets one small row from each shard that was written.
    found, start, out = sorted(wrote.collect()), 0, []
    for shard, n, tokens in found:
        out.append((shard, n, tokens, start))
        start += tokens
    return spark.createDataFrame(out, "shard long, docs long, tokens long, start long")


def _reader(path: str):
    def run(batches):
        store, at = _open(path)
        for batch in batches:
            for shard, start in zip(batch["shard"], batch["start"], strict=True):
                with store.open_input_file(f"{at}/shard-{shard:06d}.idx") as f:
                    index = np.frombuffer(f.read(), "<i8").reshape(-1, 3)
                with store.open_input_file(f"{at}/shard-{shard:06d}.rec") as f:
                    size = f.size()
                    bounds = np.append(index[:, 0], size)
                    a = 0
                    while a < len(index):
                        b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + (8 << 20), "right")) - 1)
                        f.seek(int(bounds[a]))
                        out = []
                        for data in unframe(f.read(int(bounds[b] - bounds[a]))):
                            doc, null, width = int.from_bytes(data[:8], "little", signed=True), data[8], data[9]
                            ids = np.frombuffer(data[HEADER:], f"<u{width}")
                            out.append((None if null else doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                            start += len(ids)
                        yield pd.DataFrame(out, columns=["doc_id", "start", "n_tokens", "ids_crc32"]).astype({"doc_id": "Int64"})
                        a = b

    return run


def read_records(manifest: DataFrame, path: str) -> DataFrame:
    """Reads shards back, checks every sum, and returns doc_id, start, n_tokens, ids_crc32 of each record."""
    spark = manifest.sparkSession
    parts = manifest.filter("docs > 0").select("shard", "start").repartition(max(4 * shuffle_partitions(spark), manifest.count()), "shard")
    return parts.mapInPandas(_reader(path), "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_some(path: str, shard: int, rows: list[int]) -> list[np.ndarray]:
    """The ids of some records of a shard in the order asked for, found by the index, as a shuffling reader does."""
    store, at = _open(path)
    with store.open_input_file(f"{at}/shard-{shard:06d}.idx") as f:
        index = np.frombuffer(f.read(), "<i8").reshape(-1, 3)
    out = []
    with store.open_input_file(f"{at}/shard-{shard:06d}.rec") as f:
        ends = np.append(index[1:, 0], f.size())
        for r in rows:
            f.seek(int(index[r, 0]))
            (data,) = unframe(f.read(int(ends[r] - index[r, 0])))
            out.append(np.frombuffer(data[HEADER:], f"<u{data[9]}"))
    return out


def remove(path: str) -> None:
    store, at = _open(path)
    if os.path.basename(at):
        store.delete_dir(at)
