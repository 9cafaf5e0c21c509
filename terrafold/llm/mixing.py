"""Mixing sources to target weights by Poisson replication.

A source of n documents and weight w gets a mean repetition rate
``w * total / n``.  Each document draws a uniform number from a hash of its id,
its text and the seed; inverting the Poisson distribution with that rate gives
its number of copies, and the copies are dealt to partitions and ordered by
another hash, which shuffles them globally.

Defined results: rows without a source form a source of their own (null);
sources without a weight get 1, a weight of 0 drops a source; equal rows draw
equal numbers; null and empty texts draw by their id; long texts enter by their
md5; an empty table gives an empty table; other columns pass through, but columns
named as a result (RESULTS) are replaced by it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Sources up to this number are broadcast (a source takes about 100 bytes); more are joined by shuffle.
MAX_BROADCAST_SOURCES = 50_000
#: Parts into which a source's documents are dealt where they're joined.
SALTS = 32
RESULTS = ("mix_rate", "mix_copies", "mix_copy", "mix_order")
#: The inversion counts terms of the distribution function up to mean + TAIL * sqrt(mean) + TAIL.  Uniform
#: numbers have 48 bits, and more is drawn with a probability below 2**-49 for any mean (at 0.1 about
#: 1e-23, at 1 about 1e-20, from 100 on below exp(-45)), so no draw is cut off.
TAIL = 10
#: Means above this start at mean - TAIL * sqrt(mean) - TAIL, as exp(-mean) would come to 0 in doubles.
LARGE = 500.0


def uniform(key: Column, seed: str) -> Column:
    """A number in (0, 1) from 48 bits of an md5, the same in any engine."""
    digest = F.md5(F.concat(key, F.lit(":" + seed)).cast("binary"))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 48))


def poisson_count(u: Column, mean: Column) -> Column:
    """Smallest k whose distribution function reaches u: terms are added in a fold."""
    steps = (mean + F.lit(float(TAIL)) * F.sqrt(mean) + F.lit(float(TAIL))).cast("int")
    large = mean > LARGE
    first = F.when(large, F.floor(mean - F.lit(float(TAIL)) * F.sqrt(mean) - F.lit(float(TAIL)))).otherwise(0).cast("int")
    # Stirling's series for the factorial, right to doubles where it is used
    k = F.greatest(first, F.lit(1)).cast("double")
    log_factorial = (k + 0.5) * F.log(k) - k + F.lit(0.5 * math.log(2 * math.pi)) + F.lit(1 / 12) / k - F.lit(1 / 360) / F.pow(k, F.lit(3.0))
    p = F.when(large, F.exp(first * F.log(mean) - mean - log_factorial)).otherwise(F.exp(-mean))
    start = F.struct(p.alias("p"), p.alias("f"), first.alias("k"))

    def add(acc: Column, i: Column) -> Column:
        p = acc["p"] * mean / i
        more = acc["f"] < u
        return F.struct(
            p.alias("p"),
            F.when(more, acc["f"] + p).otherwise(acc["f"]).alias("f"),
            F.when(more, i).otherwise(acc["k"]).alias("k"),
        )

    return F.aggregate(F.sequence(first + 1, F.greatest(steps, F.lit(1))), start, add, lambda acc: acc["k"])


def source_rates(docs: DataFrame, weights: dict[str, float] | None, power: float, epochs: float, source: str) -> DataFrame:
    """(source, n, rate): target share of a source over its share now, times
    ``epochs``.  Without ``weights`` the target of a source is n ** power."""
    counts = docs.groupBy(F.col(source).alias("mix_source")).agg(F.count("*").alias("n"))
    if weights is None:
        target = F.pow(F.col("n").cast("double"), F.lit(power))
    else:
        pairs = F.create_map(*[F.lit(x) for kv in sorted(weights.items()) for x in kv]) if weights else None
        known = F.element_at(pairs, F.coalesce("mix_source", F.lit(""))) if pairs is not None else F.lit(None)
        target = F.coalesce(known.cast("double"), F.lit(1.0))
    totals = counts.select("mix_source", "n", target.alias("target"))
    whole = totals.agg(F.sum("n").alias("all_n"), F.sum("target").alias("all_target"))
    return (
        totals.join(F.broadcast(whole))  # one row
        .select(
            "mix_source",
            F.coalesce(F.lit(epochs) * F.try_divide("target", "all_target") * F.col("all_n") / F.col("n"), F.lit(0.0)).alias("rate"),
        )
    )


def mixed_rows(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    power: float = 0.7,
    epochs: float = 1.0,
    seed: str = "mix-1",
    source: str = "source",
    text: str = "text",
    id_column: str = "doc_id",
) -> DataFrame:
    """A row for each copy: the document as the struct ``row``, and RESULTS."""
    if not (math.isfinite(epochs) and epochs >= 0):
        raise ValueError("epochs must be finite and not negative")
    rates = cut(source_rates(docs, weights, power, epochs, source))  # a row a source
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    key = F.concat_ws(":", F.coalesce(F.col(id_column).cast("string"), F.lit("null")), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))
    rows = docs.select(row.alias("row"), F.col(source).alias("mix_source"), key.alias("key"))
    if rates.count() <= MAX_BROADCAST_SOURCES:  # checked before they're broadcast
        joined = rows.join(F.broadcast(rates.withColumnRenamed("mix_source", "of")), F.col("mix_source").eqNullSafe(F.col("of")))
    else:
        # a source may hold a third of all documents: it's dealt by a salt
        salted = rates.withColumnRenamed("mix_source", "of").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int")).join(
            salted, F.col("mix_source").eqNullSafe(F.col("of")) & (F.col("salt") == F.col("part"))
        )
    drawn = (
        joined.select("row", "key", F.col("rate").alias("mix_rate"))
        .withColumn("mix_copies", poisson_count(uniform(F.col("key"), seed), F.col("mix_rate")))
        .where(F.col("mix_copies") > 0)
        .withColumn("mix_copy", F.explode(F.sequence(F.lit(1), F.col("mix_copies"))))
        .withColumn("mix_order", uniform(F.concat_ws(":", "key", F.col("mix_copy").cast("string")), seed + ":order"))
        .drop("key")
    )
    return drawn.repartition(F.col("mix_order")).sortWithinPartitions("mix_order")


def mix_sources(docs: DataFrame, *args, **named) -> DataFrame:
    """``docs`` replicated, with ``mix_rate``, ``mix_copies``, ``mix_copy`` (from 1)
    and ``mix_order`` (the shuffled order); arguments as those of ``mixed_rows``."""
    own = [F.col(f"row.`{c}`") for c in docs.columns if c not in RESULTS]
    return mixed_rows(docs, *args, **named).select(*own, *RESULTS)
