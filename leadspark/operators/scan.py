"""Running totals over a whole table, without putting it into one task."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.stage import staged


def running_total(rows: DataFrame, order: list[str], value: str, name: str = "before") -> DataFrame:
    """`rows` with the sum of `value` over all rows that stand earlier in `order`.

    The rows are cut into ranges of `order` and written with the number of their range,
    so every later step sees the same cut. Each range is summed, the sums of the ranges
    (one row each) are put in order, and a row adds the sums of the ranges before its own
    to its place inside it. `order` names every row apart; nulls come first.
    """
    block = "_block"
    cut = staged(rows.repartitionByRange(*order).withColumn(block, F.spark_partition_id()), "ranges")
    before = Window.orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    sums = cut.groupBy(block).agg(F.sum(value).alias("_sum"))
    offsets = sums.select(block, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(block).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = F.coalesce(F.sum(value).over(inside), F.lit(0))
    return (
        cut.withColumn(name, own)
        .join(F.broadcast(offsets), block)
        .withColumn(name, F.col(name) + F.col("_offset"))
        .drop(block, "_offset")
    )
