"""Set operations on row keys and the quality of a query's answer."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .buckets import CANDIDATE, DISCARDED, SELECTED


def row_keys(df: DataFrame, selected: list[str]) -> DataFrame:
    """Distinct tuples of the selected columns."""
    return df.select(*selected).distinct()


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Keys in exactly one of the two: one pass over both, null-safe, with no join."""
    both = row_keys(a, a.columns).withColumn("_side", F.lit(1)).unionByName(row_keys(b, a.columns).withColumn("_side", F.lit(-1)))
    return both.groupBy(*a.columns).agg(F.sum("_side").alias("_side")).filter("_side <> 0").select(*a.columns)


def union_view(*parts: DataFrame) -> DataFrame:
    """Rows of all parts; columns that a part lacks are null."""
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p, allowMissingColumns=True)
    return whole


@dataclass(frozen=True)
class Quality:
    tp: int
    fp: int
    fn: int
    omega: int

    @property
    def precision(self) -> float:
        return self.tp / (self.tp + self.fp) if self.tp + self.fp else float(not self.fn)

    @property
    def recall(self) -> float:
        return self.tp / (self.tp + self.fn) if self.tp + self.fn else float(not self.fp)

    @property
    def f1(self) -> float:
        p, r = self.precision, self.recall
        return 2 * p * r / (p + r) if p + r else 0.0

    @property
    def err(self) -> float:
        return (self.fp + self.fn) / self.omega if self.omega else float(bool(self.fp + self.fn))


def quality_table(truth: DataFrame, found: DataFrame, selected: list[str], omega: int) -> DataFrame:
    """One row: tp, fp, fn, omega, precision, recall, f1, err. Keys are compared as sets, omega counts rows."""
    sides = row_keys(truth, selected).withColumn("_t", F.lit(1)).withColumn("_f", F.lit(0)).unionByName(row_keys(found, selected).withColumn("_t", F.lit(0)).withColumn("_f", F.lit(1)))
    each = sides.groupBy(*selected).agg(F.max("_t").alias("t"), F.max("_f").alias("f"))
    count = lambda test: F.count(F.when(test, 1))
    sums = each.agg(count((F.col("t") == 1) & (F.col("f") == 1)).alias("tp"), count((F.col("t") == 0) & (F.col("f") == 1)).alias("fp"), count((F.col("t") == 1) & (F.col("f") == 0)).alias("fn"))
    share = lambda a, b, other: F.when(F.col(a) + F.col(b) > 0, F.col(a) / (F.col(a) + F.col(b))).otherwise((F.col(other) == 0).cast("double"))
    out = sums.withColumn("omega", F.lit(omega).cast("long")).withColumn("precision", share("tp", "fp", "fn")).withColumn("recall", share("tp", "fn", "fp"))
    both = F.col("precision") + F.col("recall")
    out = out.withColumn("f1", F.when(both > 0, 2 * F.col("precision") * F.col("recall") / both).otherwise(F.lit(0.0)))
    return out.withColumn("err", F.when(F.col("omega") > 0, (F.col("fp") + F.col("fn")) / F.col("omega")).otherwise((F.col("fp") + F.col("fn") > 0).cast("double")))


def quality(truth: DataFrame, found: DataFrame, selected: list[str], omega: int) -> Quality:
    r = quality_table(truth, found, selected, omega).first()
    return Quality(r["tp"], r["fp"], r["fn"], r["omega"])


def bucket_quality(rows: DataFrame, selected: list[str], predicted: str = "predicted") -> Quality:
    """Quality over a bucket table: annotated true rows count as retrieved, discarded true rows as missed."""
    true = rows.filter("label")
    found = rows.filter((F.col("bucket") == SELECTED) | ((F.col("bucket") == CANDIDATE) & (F.col(predicted) == 1)))
    kept_truth = true.filter(F.col("bucket").isin(CANDIDATE, SELECTED, DISCARDED))
    return quality(kept_truth, found, selected, rows.count())
