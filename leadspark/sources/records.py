"""CSV files read in splits, line breaks inside quotes included."""

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .stage import staged

BOM = "﻿"
RECORD, HEAD, MIDDLE, TAIL = range(4)
_SHAPE = "file string, block long, seq long, kind int, cells array<string>, text string, first boolean"


def cells(record: str) -> list[str]:
    """The cells of one record: a quote opens and closes anywhere, a doubled one inside quotes is a quote.

    Carriage returns outside quotes go; a line break inside quotes is LF.
    """
    if '"' not in record:
        return record.replace("\r", "").split(",")
    out, cell = [], ""
    parts = record.split('"')
    for k, part in enumerate(parts):
        if k % 2:
            cell += part.replace("\r\n", "\n")
        elif not part and 0 < k < len(parts) - 1:
            cell += '"'
        else:
            first, *rest = part.replace("\r", "").split(",")
            cell += first
            for following in rest:
                out.append(cell)
                cell = following
    return [*out, cell]


def _split_key(file: str | Column, block) -> Column:
    return F.xxhash64(file, block)


def _odd_splits(lines: DataFrame) -> set[int]:
    """Keys of the splits that begin inside quotes: 8 bytes per split at most.

    The quotes of a split are counted on its own; what a split begins with is the parity of
    all counts before it in its file.
    """
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    counts = lines.groupBy("file", "block").agg(F.sum(quotes).alias("n"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    odd = counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).filter("before % 2 = 1")
    return {r[0] for r in odd.select(_split_key("file", "block")).toLocalIterator()}


def _assembled(odd):
    """Lines of splits, in order, to whole records and to the ends of those that cross a split."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([
            ("file", pa.string()), ("block", pa.int64()), ("seq", pa.int64()), ("kind", pa.int32()),
            ("cells", pa.list_(pa.string())), ("text", pa.string()), ("first", pa.bool_()),
        ])
        ready: list[tuple] = []
        now, held, open_, began_open, seq, seen = None, [], False, False, 0, False

        def end_of_split():
            if held:
                ready.append((*now, seq, MIDDLE if began_open else TAIL, None, "\n".join(held), False))

        def out(force):
            if ready and (force or len(ready) >= 5_000):
                columns = [pa.array(c, f.type) for c, f in zip(zip(*ready), schema)]
                ready.clear()
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

        for batch in batches:
            names = [batch.column(k).to_pylist() for k in range(4)]
            for value, file, block, key in zip(*names):
                if (file, block) != now:
                    end_of_split()
                    now, held, seq, seen = (file, block), [], 0, False
                    open_ = began_open = key in odd.value
                    if block == 0:
                        value = value.removeprefix(BOM)
                held.append(value)
                open_ ^= value.count('"') % 2 == 1
                if open_:
                    continue
                text, held = "\n".join(held), []
                if began_open:
                    ready.append((*now, seq, HEAD, None, text, False))
                    began_open = False
                else:
                    found = cells(text)
                    if any(found):
                        ready.append((*now, seq, RECORD, found, None, not seen))
                        seen = True
                seq += 1
                yield from out(False)
        end_of_split()
        yield from out(True)

    return run


def _joined(pieces: DataFrame) -> DataFrame:
    """Records that cross splits, at most one per split: a tail, splits inside it, and a head."""
    order = Window.partitionBy("file").orderBy("block", "kind", "seq")
    owner = F.last(F.when(F.col("kind") == TAIL, F.struct("block", "seq")), ignorenulls=True).over(order)
    whole = pieces.withColumn("owner", owner).groupBy("file", "owner").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "kind", "text"))), lambda p: p["text"]), "\n").alias("text")
    )
    parse = F.udf(cells, "array<string>", useArrow=False)
    found = whole.select("file", F.col("owner.block").alias("block"), F.col("owner.seq").alias("seq"), parse("text").alias("cells"))
    # a record that crosses the first split's end may be the header; it is told by its place
    return found.filter(F.exists("cells", lambda c: c != "")).select("file", "block", "seq", "cells", (F.col("block") == 0).alias("first"))


def records(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, seq, cells, first): the records of the CSV files under `path` that are not blank.

    Files are read as lines in splits of their own, by as many tasks as they have splits.
    Quotes are counted per split first, so each split knows whether it begins inside a
    quoted cell; records inside a split are put together in its task, those that cross
    into another from their ends. `block` and `seq` are the place of a record in its file;
    `first` marks the candidates for the first record of the file, one or two per split. A
    quote that the file never closes ends with its last line, without that line's break.
    """
    meta = F.col("_metadata")
    lines = spark.read.option("lineSep", "\n").text(path)
    lines = lines.select("value", meta["file_path"].alias("file"), meta["file_block_start"].alias("block"))
    odd = spark.sparkContext.broadcast(_odd_splits(lines))
    found = staged(lines.withColumn("key", _split_key("file", "block")).mapInArrow(_assembled(odd), _SHAPE), "csv")
    whole = found.filter(F.col("kind") == RECORD).select("file", "block", "seq", "cells", "first")
    return whole.unionByName(_joined(found.filter(F.col("kind") != RECORD)))
