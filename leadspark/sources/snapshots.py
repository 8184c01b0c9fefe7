"""A table in hash buckets whose versions share the buckets they did not change."""

import json
from uuid import uuid4

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Batch names a version remembers, so that a retried one is known.
REMEMBERED = 10_000


def renamed(spark: SparkSession, source: str, target: str) -> bool:
    """Rename a file or folder unless the target exists."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    hadoop = jvm.org.apache.hadoop.fs
    start, end = hadoop.Path(source), hadoop.Path(target)
    system = end.getFileSystem(conf)
    context = hadoop.FileContext.getFileContext(system.getUri(), conf)
    options = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 0)
    try:
        context.rename(system.makeQualified(start), system.makeQualified(end), options)
    except Py4JJavaError:
        if system.exists(end):
            return False
        raise
    return True


class Snapshot:
    """Rows by hash of `key` in `buckets` folders; a version is a small file that lists them.

    `commit` writes the rows of some buckets under new names and then puts the next version's
    file in place by a rename that fails if the name is taken, so readers see whole versions
    and of two writers one must start again. A batch name makes a commit safe to repeat.
    Files of older versions stay until `vacuum`.
    """

    def __init__(self, spark: SparkSession, folder: str, key: str, buckets: int = 256):
        self.spark, self.folder, self.key, self.buckets = spark, folder.rstrip("/"), key, buckets

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def buckets_of(self, rows: DataFrame) -> list[int]:
        """The buckets that `rows` fall into: at most as many as there are."""
        return sorted(r[0] for r in rows.select(self.bucket().alias("bucket")).distinct().collect())

    def _system(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def version(self) -> dict:
        """The newest version: number, schema, batches, and per bucket its path and rows."""
        where, system = self._system(f"{self.folder}/versions")
        numbers = [int(f.getPath().getName()[:-5]) for f in system.listStatus(where) if f.getPath().getName().endswith(".json")] if system.exists(where) else []
        if not numbers:
            return {"number": 0, "schema": None, "batches": [], "parts": {}, "buckets": self.buckets}
        text = self.spark.read.text(f"{self.folder}/versions/{max(numbers):010d}.json", wholetext=True).first()[0]
        found = json.loads(text)
        self.buckets = found["buckets"]
        return found

    def read(self, only: list[int] | None = None) -> DataFrame | None:
        """The newest version, or some of its buckets; None before the first commit."""
        now = self.version()
        if now["schema"] is None:
            return None
        schema = StructType.fromJson(now["schema"])
        parts = [p["path"] for b, p in now["parts"].items() if only is None or int(b) in only]
        paths = [f"{self.folder}/{p}" for p in parts]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def rows(self, but: list[int] | None = None) -> int:
        """Rows of the newest version, as counted when they were written; `but` some buckets."""
        return sum(p["rows"] for b, p in self.version()["parts"].items() if int(b) not in (but or ()))

    def commit(self, rows: DataFrame, touched: list[int] | None, batch: str | None = None) -> bool:
        """Put `rows` in place of the `touched` buckets (all if None).

        False if `batch` was committed before; then nothing is written. Raises
        FileExistsError if another writer was first.
        """
        now = self.version()
        if batch is not None and batch in now["batches"]:
            return False
        name = f"data/{now['number'] + 1:010d}-{uuid4().hex}"
        bucket = F.col("_bucket")
        dealt = rows.withColumn("_bucket", self.bucket()).repartition("_bucket")
        dealt.write.partitionBy("_bucket").parquet(f"{self.folder}/{name}")
        written = self.spark.read.schema(StructType([*rows.schema.fields, *StructType.fromDDL("_bucket int").fields])).parquet(f"{self.folder}/{name}")
        counts = {str(r[0]): r[1] for r in written.groupBy(bucket).count().collect()}
        gone = set(now["parts"]) if touched is None else {str(b) for b in touched}
        if touched is not None and not set(counts) <= gone:
            raise ValueError("rows outside the touched buckets")
        parts = {b: p for b, p in now["parts"].items() if b not in gone}
        parts |= {b: {"path": f"{name}/_bucket={b}", "rows": n} for b, n in counts.items()}
        batches = [*now["batches"], *([batch] if batch is not None else [])][-REMEMBERED:]
        self._put({"number": now["number"] + 1, "schema": json.loads(rows.schema.json()), "buckets": self.buckets, "batches": batches, "parts": parts})
        return True

    def _put(self, version: dict) -> None:
        draft, target = f"{self.folder}/versions/.{uuid4().hex}", f"{self.folder}/versions/{version['number']:010d}.json"
        where, system = self._system(draft)
        out = system.create(where)
        out.write(bytearray(json.dumps(version).encode()))
        out.close()
        if not renamed(self.spark, draft, target):
            system.delete(where, False)
            raise FileExistsError(f"{target} was written by another commit")

    def vacuum(self) -> None:
        """Delete files and versions that the newest version does not name; no reader may use them."""
        now = self.version()
        kept = {p["path"] for p in now["parts"].values()}
        where, system = self._system(f"{self.folder}/data")
        for write in system.listStatus(where):
            for part in system.listStatus(write.getPath()):
                if f"data/{write.getPath().getName()}/{part.getPath().getName()}" not in kept:
                    system.delete(part.getPath(), True)
        where, system = self._system(f"{self.folder}/versions")
        for file in system.listStatus(where):
            if file.getPath().getName() != f"{now['number']:010d}.json":
                system.delete(file.getPath(), False)
