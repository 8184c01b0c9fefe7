"""Left joins from many rows to one row per key, safe for hot keys."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROWS_PER_TASK = 1_000_000
# Keys that may need salts: with ROWS_PER_TASK, all of them in up to 10^12 rows.
MAX_HOT_KEYS = 1_000_000
# Rows without a key match nothing; they are spread over this many places.
SPREAD = 1 << 20


def hot_keys(
    counts: DataFrame, on: list[str], n: str = "n", rows_per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """Keys heavier than one task should hold, with the number of salts they need.

    At most one row per `rows_per_task` input rows and never more than MAX_HOT_KEYS
    (some 40 MB), so it is safe to broadcast; a key outside a full list holds less than
    1/MAX_HOT_KEYS of all rows.
    """
    return (
        counts.filter(F.col(n) > rows_per_task)
        .orderBy(F.desc(n))
        .limit(MAX_HOT_KEYS)
        .select(*on, F.ceil(F.col(n) / rows_per_task).cast("int").alias("_salts"))
    )


def join_by_key(
    rows: DataFrame,
    dim: DataFrame,
    on: list[str],
    row_id: str,
    counts: DataFrame | None = None,
    rows_per_task: int = ROWS_PER_TASK,
    null_safe: bool = False,
) -> DataFrame:
    """`rows` left join `dim` (one row per key).

    Rows of a hot key are spread over as many salts as their number asks for and
    the one matching `dim` row is repeated per salt. The salt is a hash of
    `row_id`, so a recomputed task places every row where it was before.
    `counts` (keys and `n`) saves the counting pass when the caller has it. With
    `null_safe`, NULL is a key like any other; otherwise rows with a NULL in their
    key match nothing and are spread evenly.
    """
    if counts is None:
        counts = rows.groupBy(*on).agg(F.count(F.lit(1)).alias("n"))
    keys = {c: f"_key_{k}" for k, c in enumerate(on)}
    hot = hot_keys(counts, on, rows_per_task=rows_per_task).withColumnsRenamed(keys)

    def same(left: str, right: str) -> Column:
        return F.col(left).eqNullSafe(F.col(right)) if null_safe else F.col(left) == F.col(right)

    def salted(df: DataFrame) -> DataFrame:
        return df.join(F.broadcast(hot), reduce(Column.__and__, [same(c, k) for c, k in keys.items()]), "left").drop(*keys.values())

    salt = F.pmod(F.xxhash64(row_id), F.coalesce("_salts", F.lit(1)))
    if not null_safe:
        missing = reduce(Column.__or__, [F.col(c).isNull() for c in on])
        salt = F.when(missing, F.pmod(F.xxhash64(row_id), F.lit(SPREAD))).otherwise(salt)
    salted_rows = salted(rows).withColumn("_salt", salt.cast("int")).drop("_salts")
    salted_dim = (
        salted(dim)
        .withColumn("_dim_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)))
        .drop("_salts")
        .withColumnsRenamed(keys)
    )
    match = reduce(Column.__and__, [same(c, k) for c, k in keys.items()]) & (F.col("_salt") == F.col("_dim_salt"))
    return salted_rows.join(salted_dim, match, "left").drop("_salt", "_dim_salt", *keys.values())
