"""Candidates of queries in one long table: (query, batch_id, row) with a bucket, a label and a propagated label.

``bucket`` is ``candidate``, ``selected`` (labelled true by an annotator) or ``discarded`` (filtered out, or labelled
false).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.predicates import ucq
from ..model import SemCQ, Ucq

CANDIDATE, SELECTED, DISCARDED = "candidate", "selected", "discarded"


def initialise(df: DataFrame, query: SemCQ, name: str) -> DataFrame:
    """Rows that the static conjunction accepts, over all batches at once; the filter stands before anything else so
    that it reaches the scan."""
    kept = df.filter(ucq([list(query.sigma)], df.schema)) if query.sigma else df
    return kept.select("*", F.lit(name).alias("query"), F.lit(CANDIDATE).alias("bucket"))


def refine(rows: DataFrame, groups: Ucq) -> DataFrame:
    """Candidates that a prefilter rejects become discarded; one pass, nothing is dropped."""
    accepted = ucq(groups, rows.schema)
    return rows.withColumn("bucket", F.when((F.col("bucket") == CANDIDATE) & ~accepted, DISCARDED).otherwise(F.col("bucket")))


def introduced_misses(rows: DataFrame) -> int:
    """True rows that a prefilter has discarded."""
    return rows.filter((F.col("bucket") == DISCARDED) & F.col("label")).count()


def with_truth(rows: DataFrame, truth: DataFrame, keys: list[str], name: str = "label") -> DataFrame:
    """``rows`` with a Boolean: is its key among the true ones? An existence join; repeated true keys don't matter."""
    marked = truth.select(*keys).distinct().withColumn("_truth", F.lit(True))
    return rows.join(marked, keys, "left").withColumn(name, F.coalesce("_truth", F.lit(False))).drop("_truth")


def annotate(rows: DataFrame, labelled: DataFrame, row_id: str) -> DataFrame:
    """Labelled rows (row_id, human) leave the candidates: true ones are selected, false ones discarded."""
    human = labelled.select(row_id, F.col("human").alias("_human"))
    moved = F.when(F.col("_human").isNull(), F.col("bucket")).when(F.col("_human"), SELECTED).otherwise(DISCARDED)
    return rows.join(human, row_id, "left").withColumn("bucket", moved).withColumn("annotated", F.col("_human").isNotNull()).drop("_human")


def remaining(rows: DataFrame, labelled: DataFrame, row_id: str) -> DataFrame:
    """Rows that have no label yet."""
    return rows.join(labelled.select(row_id), row_id, "left_anti")


def stream_statistics(rows: DataFrame, label: str | Column = "label") -> DataFrame:
    """batch_id (null: overall), n, selectivity: one rollup gives each batch and all of them."""
    c = F.col(label) if isinstance(label, str) else label
    return rows.rollup("batch_id").agg(F.count("*").alias("n"), F.avg(c.cast("int").cast("double")).alias("selectivity")).select("batch_id", "n", "selectivity")


def accumulated_selectivity(rows: DataFrame) -> DataFrame:
    """batch_id, candidates, selectivity over all batches so far: true rows that aren't discarded, of all candidates."""
    n = F.count(F.when(F.col("bucket") != DISCARDED, 1))
    true = F.count(F.when((F.col("bucket") != DISCARDED) & F.col("label"), 1))
    so_far = Window.orderBy("batch_id").rowsBetween(Window.unboundedPreceding, 0)
    each = rows.groupBy("batch_id").agg(n.alias("n"), true.alias("true"))
    all_n = F.sum("n").over(so_far)
    return each.select("batch_id", all_n.alias("candidates"), F.when(all_n > 0, F.sum("true").over(so_far) / all_n).otherwise(F.lit(0.0)).alias("selectivity"))
