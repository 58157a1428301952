"""Shared helpers of the training-data operators: session scratch tables, null-safe inputs and text primitives."""

from __future__ import annotations

import tempfile
import uuid
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The input table ``name``, wherever Spark can read it."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z; every other character stays, null stays."""
    return F.translate(text, UPPER, LOWER)


def shared_root(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is read from ``spark.checkpoint.dir``; only where that is unset (tests on one machine) a folder of our own is
    chosen and set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="papyrine-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Scratch:
    """A folder in the shared root for the written tables of one operator call; tables cut lineage and survive lost
    executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Writes ``df`` as Parquet (zstd) and returns the reread table."""
        df.write.option("compression", "zstd").parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def _path(self, name: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def drop(self, name: str = "") -> None:
        """Deletes one table, or all."""
        at, store = self._path(name)
        store.delete(at, True)

    def last(self, df: DataFrame, name: str = "result") -> DataFrame:
        """Writes ``df``, deletes all other tables of the folder and returns the reread one."""
        out = self.table(df, name)
        at, store = self._path("")
        for found in store.listStatus(at):
            if found.getPath().getName() != name:
                store.delete(found.getPath(), True)
        return out


def slices(batch, column: str = "text", size: int = 1 << 20):
    """Runs of rows of a pandas batch whose ``column`` holds about ``size`` characters; a longer row is a run of its own."""
    ends = batch[column].str.len().cumsum().to_numpy()
    a = 0
    while a < len(batch):
        b = max(a + 1, int(ends.searchsorted((ends[a - 1] if a else 0) + size, "right")))
        yield batch.iloc[a:b]
        a = b


def rows_of(df: DataFrame) -> int:
    """Row count; on Parquet this reads footers only."""
    return df.count()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def partitions_for(df: DataFrame, least: int, size: int = 64 << 20, most: int = 200_000) -> int:
    """Partitions that hold about ``size`` bytes of ``df`` each, by the optimizer's estimate; ``least`` where it has none
    or the table is small."""
    found = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return least if found >= 1 << 60 else max(least, min(most, found // size))


#: One key in so many rows is a frequent one; there can't be more of these than this.
SHARE = 1000


def joined_by_share(rows: DataFrame, found: DataFrame, keys: list[str], count: str) -> DataFrame:
    """Inner join of ``rows`` with ``found``, which has a row for each key and, in ``count``, how many of ``rows`` have it.

    Keys that hold more than a thousandth of all rows, at most SHARE of them, are broadcast, so no task gets all rows of
    one; the others meet by shuffle. Both sides are read twice and must be written tables. Keys aren't null.
    """
    total = found.agg(F.sum(count)).first()[0] or 0
    frequent = F.col(count) * SHARE > total
    here = F.broadcast(found.filter(frequent))
    some = rows.join(here, keys)
    rest = rows.join(F.broadcast(found.filter(frequent).select(*keys)), keys, "left_anti").join(found.filter(~frequent), keys)
    return some.unionByName(rest)


def id_crc(doc_id: Column) -> Column:
    """crc32 of the decimal text of an id; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def crc32_u32(ids) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4").tobytes())
