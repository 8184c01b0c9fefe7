"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadspark.llm.common import free_name

#: Target weight of a source: its number of documents to this power.
POWER = 0.5
#: More sources than this are joined by a shuffle instead of a broadcast.
BROADCAST_SOURCES = 100_000
#: Means above this are drawn as a sum of independent draws, as exp(-mean) would vanish.
PART = 256.0


def uniform(text: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of an MD5."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def poisson(mean: str, seed: Column) -> Column:
    """The Poisson quantile with the given mean of a uniform number seeded by `seed`.

    The count is how many k have a distribution function of at most u. The sum runs far
    enough that the rest of the distribution is below the last bit of u.
    """
    part = F.greatest(F.ceil(F.col(mean) / PART), F.lit(1)).cast("int")
    each = F.col(mean) / part
    last = F.ceil(each + 12 * F.sqrt(each) + 20).cast("int")

    def draw(j: Column) -> Column:
        u = uniform(F.concat(seed, F.lit("|"), j.cast("string")))
        start = F.struct(
            F.exp(-each).alias("p"), F.exp(-each).alias("cdf"), F.lit(0).cast("int").alias("n")
        )

        def step(acc: Column, k: Column) -> Column:
            p = acc["p"] * each / k
            return F.struct(
                p.alias("p"), (acc["cdf"] + p).alias("cdf"),
                (acc["n"] + F.when(u >= acc["cdf"], 1).otherwise(0)).cast("int").alias("n"),
            )

        return F.aggregate(F.sequence(F.lit(1), last), start, step, lambda acc: acc["n"])

    return F.aggregate(F.transform(F.sequence(F.lit(1), part), draw), F.lit(0), lambda a, b: a + b)


def rates(docs: DataFrame, weights: DataFrame | None = None, size: float = 1.0) -> DataFrame:
    """(source, n, rate): mean repetitions of a document per source.

    `weights` (source, weight) gives the target shares; without it a source weighs its
    number of documents to the power POWER. `size` scales the expected number of
    documents relative to the input. A null source is a source of its own. Sources
    without a positive weight get rate 0.
    """
    counts = docs.groupBy(F.col("source").cast("string").alias("source")).agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        weighed = counts.withColumn("weight", F.pow(F.col("n").cast("double"), F.lit(POWER)))
    else:
        given = weights.select(F.col("source").cast("string").alias("name"), F.col("weight").cast("double").alias("weight"))
        weighed = counts.join(given, F.col("source").eqNullSafe(F.col("name")), "left").drop("name")
        weighed = weighed.withColumn("weight", F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0)))
    total = weighed.agg(F.sum("n"), F.sum("weight")).first()
    all_n, all_weight = total[0] or 0, total[1] or 0.0
    rate = F.col("weight") / all_weight * all_n * size / F.col("n") if all_weight > 0 else F.lit(0.0)
    return weighed.select("source", "n", rate.alias("rate"))


def mix(docs: DataFrame, weights: DataFrame | None = None, size: float = 1.0, seed: int = 42) -> DataFrame:
    """Each document as often as its Poisson draw says, in a globally random order.

    Columns of `docs` plus copies (the document's count), copy (from 0), rate and
    shuffle_key; a column of `docs` that has such a name gives way to a prefixed one of
    ours. Draws depend on the seed and doc_id only, so repeated rows are repeated
    equally; a null doc_id is drawn as the text "null". Rows are dealt to partitions by
    a hash of document and copy and sorted by it, which orders the whole table at
    random without sampling it first.
    """
    mean = rates(docs, weights, size).withColumn("rate", F.round("rate", 9))
    if mean.count() <= BROADCAST_SOURCES:
        mean = F.broadcast(mean)
    name, rate, copies, copy, key = (free_name(docs, n) for n in ("source_name", "rate", "copies", "copy", "shuffle_key"))
    mean = mean.select(F.col("source").alias(name), F.col("rate").alias(rate))
    doc = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    drawn = docs.join(mean, F.col("source").cast("string").eqNullSafe(F.col(name))).drop(name)
    drawn = drawn.withColumn(copies, poisson(rate, F.concat(F.lit(f"{seed}|"), doc))).filter(F.col(copies) > 0)
    out = drawn.withColumn(copy, F.explode(F.sequence(F.lit(0), F.col(copies) - 1)))
    order = F.md5(F.concat(F.lit(f"{seed}|order|"), doc, F.lit("|"), F.col(copy).cast("string")).cast("binary"))
    return out.withColumn(key, order).repartition(key).sortWithinPartitions(key)
