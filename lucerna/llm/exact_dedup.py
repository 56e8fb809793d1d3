"""Exact deduplication by two-pass Bloom filtering, with DataFrame functions only.

Pass 1 sets one bit for each normalised text in a Bloom filter of 64-bit words, sized by the number of rows
(``cells_per_row`` bits a row). Each task builds its part of the filter, the parts are merged by OR, and each word
counts the rows that set its bits: where there are more rows than bits, some bit was set twice, and the word stays
in the second filter, of possible repeats. Pass 2 probes that: rows it rules out have no equal and pass straight
through; the others shuffle on their digest and are compared exactly. The second filter is sent to all executors
while it has at most ``broadcast_words`` words; a larger one stays partitioned by word and is joined by a shuffle.

Defined cases: a null text counts as empty; empty texts equal each other; of equal texts the row with the
smallest doc_id stays, a null doc_id comes last, and of repeated rows with the same doc_id one stays. An
empty table gives an empty result. Extra columns pass through ``exact_dedup`` untouched; names starting with
``_dd_`` are reserved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, materialise, text_or_empty

#: Bits of the filter for each row, and words of it (16 bytes each) that are sent to all executors, at most.
CELLS = 32
BROADCAST_WORDS = 1 << 20


def normalised(text: Column) -> Column:
    """Each run of white space becomes one space; runs that are one space already need no work."""
    return F.regexp_replace(text, SPACE_CLASS + r"{2,}|[\x09-\x0D]", " ")


def _probe(docs: DataFrame, text_col: str, cells_per_row: int, broadcast_words: int) -> DataFrame:
    """``docs`` with _dd_flag: true where the text may occur twice, false only where it can't."""
    rows = max(1, docs.count())
    n_words = 1 << max(4, (rows * cells_per_row - 1).bit_length() - 6)
    placed = docs.withColumn("_dd_hash", F.xxhash64(normalised(text_or_empty(text_col))))
    placed = placed.withColumn("_dd_at", F.col("_dd_hash").bitwiseAND(F.lit(n_words - 1).cast("long")))
    bit = F.expr("shiftleft(1L, cast(shiftrightunsigned(_dd_hash, 58) as int))")
    first = placed.select(F.col("_dd_at").alias("_dd_word"), bit.alias("_dd_bit")).groupBy("_dd_word").agg(F.bit_or("_dd_bit").alias("_dd_bits"), F.count("*").alias("n"))
    second = materialise(first.filter(F.col("n") > F.bit_count("_dd_bits")).select("_dd_word", "_dd_bits"), "filter")
    filtered = F.broadcast(second) if second.count() <= broadcast_words else second
    probed = placed.join(filtered, F.col("_dd_at") == F.col("_dd_word"), "left")
    return probed.withColumn("_dd_flag", F.coalesce(F.col("_dd_bits").bitwiseAND(bit), F.lit(0).cast("long")) != 0)


def _groups(flagged: DataFrame, id_col: str) -> DataFrame:
    """Groups of two or more equal rows: digest, the row that stays, size."""
    first = F.min(F.struct(F.col(id_col).isNull().alias("n"), F.col(id_col).alias("i"), F.col("_dd_row").alias("r")))
    groups = flagged.groupBy("_dd_sha").agg(first.alias("f"), F.count("*").alias("_dd_size")).filter("_dd_size > 1")
    return groups.select(F.col("_dd_sha").alias("_dd_key"), F.col("f.i").alias("_dd_keep"), F.col("f.r").alias("_dd_first"), "_dd_size")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cells_per_row: int = CELLS, broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256."""
    sha = F.sha2(normalised(text_or_empty(text_col)), 256)
    probed = _probe(docs.select(id_col, text_col), text_col, cells_per_row, broadcast_words)
    thin = materialise(probed.select(id_col, sha.alias("_dd_sha"), "_dd_flag", F.monotonically_increasing_id().alias("_dd_row")), "digests")
    flagged = thin.filter("_dd_flag")
    # the digest is compared in upper case so that both sides are exchanged anew: then Spark can split a hot group
    groups = _groups(flagged, id_col).withColumn("_dd_key", F.upper("_dd_key"))
    joined = flagged.join(groups, F.upper("_dd_sha") == F.col("_dd_key"), "left")
    keep = F.when(F.col("_dd_size").isNull(), F.col(id_col)).otherwise(F.col("_dd_keep"))
    some = joined.select(
        id_col, keep.alias("keep_id"), F.coalesce("_dd_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("_dd_row") == F.col("_dd_first"), F.lit(True)).alias("kept"), F.col("_dd_sha").alias("text_sha256"),
    )
    rest = thin.filter("not _dd_flag").select(id_col, F.col(id_col).alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("_dd_sha").alias("text_sha256"))
    return rest.unionAll(some)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cells_per_row: int = CELLS, broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """The documents that stay, with all their columns. Rows without a possible equal are never moved."""
    sha = F.sha2(normalised(text_or_empty(text_col)), 256)
    probed = _probe(docs, text_col, cells_per_row, broadcast_words)
    held = materialise(probed.filter("_dd_flag").select(*docs.columns, sha.alias("_dd_sha"), F.monotonically_increasing_id().alias("_dd_row")), "repeats")
    groups = _groups(held.select(id_col, "_dd_sha", "_dd_row"), id_col).withColumn("_dd_key", F.upper("_dd_key"))
    lost = held.select("_dd_sha", "_dd_row").join(groups, F.upper("_dd_sha") == F.col("_dd_key")).filter("_dd_row <> _dd_first").select("_dd_row")
    some = held.join(lost, "_dd_row", "left_anti").select(*docs.columns)
    return probed.filter("not _dd_flag").select(*docs.columns).unionAll(some)
