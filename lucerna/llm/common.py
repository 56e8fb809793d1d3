"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# What separates words in every contract of this subpackage.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. Only a session that runs on one machine as a whole may name none: then one of
    our own will do; on a cluster that is an error, as each executor would write to its own disk."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="lucerna-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors, gives exact sizes."""
    path = f"{shared_dir(df.sparkSession)}/lucerna-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    _written.append(path)
    held = df.sparkSession.read.schema(df.schema).parquet(path)
    held._written_at = path
    return held


#: Folders that ``materialise`` has written and nobody has discarded.
_written: list[str] = []


def discard(*tables: DataFrame) -> None:
    """Delete what ``materialise`` wrote for tables that nothing reads any more."""
    for t in tables:
        if path := getattr(t, "_written_at", None):
            _delete(t.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path).getParent()
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    if path in _written:
        _written.remove(path)


@contextmanager
def only(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Of all that is written inside, only the tables put into the list stay."""
    before, kept = set(_written), []
    yield kept
    stay = {getattr(t, "_written_at", None) for t in kept}
    for path in [p for p in _written if p not in before and p not in stay]:
        _delete(spark, path)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Arrow batches of few rows for what is run inside: long texts then take little memory on their way to workers."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_or_empty(text: str | Column = "text") -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def word_count(text: Column) -> Column:
    """Words of a text, as a long."""
    return F.regexp_count(text, F.lit(WORD_CLASS + "+")).cast("long")


def bucket_prefix(df: DataFrame, group: list[str], bucket: str, sizes: dict[str, Column]) -> DataFrame:
    """Exclusive prefix sums over the buckets of each group: one row for each (group, bucket).

    Together with a window inside (group, bucket) this ranks or sums a group of any size without
    gathering it in one task; only the bucket totals of a group meet.
    """
    totals = df.groupBy(*group, bucket).agg(*[F.sum(c).alias(f"_t_{k}") for k, c in sizes.items()])
    before = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(*group, bucket, *[F.coalesce(F.sum(f"_t_{k}").over(before), F.lit(0)).alias(f"before_{k}") for k in sizes])


def bucketed_positions(df: DataFrame, group: list[str], bucket: str, order: list[str], sizes: dict[str, Column]) -> DataFrame:
    """``df`` with a column ``start_<k>`` for each size: the sum over the rows of its group that come before it.

    Rows are ordered by bucket, then by ``order`` inside it. Buckets must be small.
    """
    inside = Window.partitionBy(*group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = df.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"_in_{k}") for k, c in sizes.items()])
    joined = local.join(bucket_prefix(df, group, bucket, sizes), [*group, bucket])
    return joined.select(*df.columns, *[(F.col(f"_in_{k}") + F.col(f"before_{k}")).alias(f"start_{k}") for k in sizes])
