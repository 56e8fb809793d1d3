"""Relational builders of the data sets: join chains, grouped concatenation, top-N, pattern search, quotas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def left_chain(first: DataFrame, *steps: tuple[DataFrame, str | list[str], str]) -> DataFrame:
    """Left equi-joins one after another; columns that clash get the step's suffix. Spark picks each join's kind."""
    out = first
    for other, keys, suffix in steps:
        keys = [keys] if isinstance(keys, str) else keys
        clash = {c: c + suffix for c in other.columns if c in out.columns and c not in keys}
        out = out.join(other.withColumnsRenamed(clash), keys, "left")
    return out


def concat_distinct(df: DataFrame, keys: list[str], columns: list[str], position: str | Column | None = None, sep: str = ",") -> DataFrame:
    """One row for each key with each column's distinct values joined, in order of first position (or of value).

    Values are made distinct before they meet, so a group costs its distinct values only.
    """
    out = None
    for c in columns:
        place = F.min(position) if position is not None else F.min(c)
        once = df.filter(F.col(c).isNotNull()).groupBy(*keys, c).agg(place.alias("_at"))
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", F.col(c).cast("string").alias("v")))), lambda x: x["v"]), sep)
        one = once.groupBy(*keys).agg(joined.alias(c))
        out = one if out is None else out.join(one, keys, "full")
    return out


def top_groups(df: DataFrame, key: str, n: int, name: str = "n") -> DataFrame:
    """The ``n`` most frequent keys; ties by key."""
    return df.groupBy(key).agg(F.count("*").alias(name)).orderBy(F.desc(name), key).limit(n)


def pattern_argmax(df: DataFrame, key: str, value: str, patterns: tuple[str, ...], least_rows: int = 50, name: str = "score") -> DataFrame:
    """The key whose rows with a pattern have the most rows times distinct values, at least ``least_rows`` rows.

    Patterns are tried in order; a later one wins only with a higher score. Ties go to the smallest key.
    """
    parts = []
    for i, p in enumerate(patterns):
        per = df.filter(F.contains(F.col(value), F.lit(p))).groupBy(key).agg(F.count("*").alias("rows"), F.countDistinct(value).alias("kinds"))
        parts.append(per.filter(F.col("rows") >= least_rows).select(key, (F.col("rows") * F.col("kinds")).alias(name), F.lit(i).alias("_i")))
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole.orderBy(F.desc(name), "_i", key).limit(1).drop("_i")


def quota_sample(rows: DataFrame, key: str, order: list[str | Column], quota: int) -> DataFrame:
    """At most ``quota`` rows for each key, the first in order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("_n") <= quota).drop("_n")


def filled_quota(rows: DataFrame, key: str, wanted: list, order: list[str | Column], total: int, quota: int) -> DataFrame:
    """``total`` rows, keys in the order wanted: each gives ``quota`` rows at most, and what is missing is filled up
    with the following rows of the same order."""
    ranks = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    at = F.array_position(F.array(*[F.lit(k) for k in wanted]), F.col(key))
    numbered = rows.filter(F.col(key).isin(list(wanted))).withColumn("_n", ranks).withColumn("_k", at)
    return numbered.orderBy(F.when(F.col("_n") <= quota, 0).otherwise(1), "_k", "_n").limit(total).drop("_n", "_k")
