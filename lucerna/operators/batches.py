"""Splitting a table into a ladder of batches, and seeded orders that any engine can reproduce.

Orders come from ``md5(seed:id)``, never from a random generator, so a batch or a sample is the same on any number
of partitions and in plain SQL.
"""

from __future__ import annotations

from itertools import pairwise

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def shuffle_key(seed: int, *ids: str) -> Column:
    """The seeded place of a row, as a hex digest of its ids."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(F.col(i).cast("string"), F.lit("")) for i in ids]))


def ladder(n: int, steps: tuple[float, ...]) -> list[int]:
    """Batch sizes from cumulative fractions: each batch has a row at least; rows beyond the last step are unused."""
    ends = [0]
    for s in steps:
        end = int(n * s)
        ends.append(max(end, ends[-1] + 1))
    if ends[-1] > n:
        raise ValueError(f"{len(steps)} batches don't fit in {n} rows")
    return [b - a for a, b in pairwise(ends)]


def ranked(df: DataFrame, seed: int, *ids: str, name: str = "_rank", slices: int = 4096) -> DataFrame:
    """``df`` with each row's rank (from 1) in the seeded order, without gathering the rows in one task.

    The digest's first digits cut the order into slices; ranks inside a slice are added to the counts of the slices
    before it, and only those counts meet.
    """
    digits = max(1, len(f"{slices - 1:x}"))
    keyed = df.withColumn("_b_key", shuffle_key(seed, *ids)).withColumn("_b_slice", F.substring("_b_key", 1, digits))
    before = Window.orderBy("_b_slice").rowsBetween(Window.unboundedPreceding, -1)
    counts = keyed.groupBy("_b_slice").agg(F.count("*").alias("_b_n")).select("_b_slice", F.coalesce(F.sum("_b_n").over(before), F.lit(0)).alias("_b_before"))
    inside = F.row_number().over(Window.partitionBy("_b_slice").orderBy("_b_key", *ids))
    return keyed.withColumn("_b_in", inside).join(counts, "_b_slice").withColumn(name, F.col("_b_in") + F.col("_b_before")).drop("_b_key", "_b_slice", "_b_in", "_b_before")


def with_batches(df: DataFrame, steps: tuple[float, ...], seed: int, *ids: str, name: str = "batch_id") -> DataFrame:
    """``df`` with the batch of each row (from 0); rows beyond the last step go."""
    sizes = ladder(df.count(), steps)
    end, batch = 0, F.lit(None).cast("int")
    for k, size in reversed(list(enumerate(sizes))):
        end = sum(sizes[: k + 1])
        batch = F.when(F.col("_rank") <= end, k).otherwise(batch)
    return ranked(df, seed, *ids).withColumn(name, batch).filter(F.col(name).isNotNull()).drop("_rank")


def sample(df: DataFrame, n: int, seed: int, *ids: str) -> DataFrame:
    """Exactly ``n`` rows (or all): the first in the seeded order."""
    return df.orderBy(shuffle_key(seed, *ids), *ids).limit(n)
