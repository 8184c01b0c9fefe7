"""Intermediate tables in the cluster's shared folder."""

import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir.

    Where it is unset, a local session uses a folder beside its warehouse; any other
    session is refused, as its executors would not see one another's files.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a shared folder")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_stage"


def fresh_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def staged(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write `df` once and read it back.

    Cuts the lineage where a table feeds several branches: the branches read the
    written columns instead of repeating the work, and a lost executor costs a
    re-read rather than a recomputation. `release` deletes it again.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete every intermediate table of this process, once its results are written."""
    while _written:
        path = spark._jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
