"""What several operators share: word lists, folds, caches, scratch tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadspark.sources.stage import fresh_path



def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fold(doc_id: str, folds: int) -> Column:
    """crc32 of the id as text, modulo `folds`; a null id falls into fold 0."""
    crc = F.crc32(F.col(doc_id).cast("string").cast("binary"))
    return F.coalesce(crc % folds, F.lit(0)).cast("int")


def raw(column: str = "text") -> Column:
    """The UTF-8 bytes of a text column; null counts as empty."""
    return F.coalesce(F.col(column).cast("string").cast("binary"), F.lit(b""))


def one_text(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, text): of the rows that agree in `keys`, the text of the smallest hash."""
    return rows.groupBy(*keys).agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))


def free_name(df: DataFrame, wish: str) -> str:
    """A column name that `df` does not use yet."""
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish = f"_{wish}"
    return wish


def portions(batch: pa.RecordBatch, column: int, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch that hold about `size` bytes in a binary column each."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    group = np.cumsum(lengths, dtype=np.int64) // size
    edges = np.flatnonzero(np.diff(group)) + 1
    for a, b in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows]):
        if b > a:
            yield batch.slice(a, b - a)


class Memo(dict):
    """A bounded cache of a pure function: emptied when full, so memory stays flat."""

    def __init__(self, make: Callable, limit: int):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        value = self[key] = self.make(key)
        return value


class Scratch:
    """Tables written once into the shared folder and deleted when they are done with.

    A written table cuts the lineage: a lost executor costs a re-read. `drop` removes
    the tables that no later step reads.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name, self.tables = spark, name, []

    def path(self) -> str:
        return fresh_path(self.spark, self.name)

    def write(self, df: DataFrame) -> DataFrame:
        path = self.path()
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.tables.append((out, path))
        return out

    def drop(self, *keep: DataFrame) -> None:
        """Delete the written tables but those in `keep`."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        stay = [(df, path) for df, path in self.tables if any(df is k for k in keep)]
        for path in {p for _, p in self.tables} - {p for _, p in stay}:
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(conf).delete(where, True)
        self.tables = stay
