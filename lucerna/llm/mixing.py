"""Mixing sources to target weights with a low-discrepancy schedule.

Golden-ratio points run through the cumulative targets and give every slot of the schedule a source; slots are
ranked per source. The documents of a source, shuffled by a hash, form a line of words that is read up to twice and
cut into blocks of ``block`` words; the slot of rank r takes block r. The last slot of a source is cut short so
that the words taken equal the rounded target; the few slots that the schedule leaves short are added at its end.

Targets: sources in order of code points (null last) weigh ``weights`` in turn and share ``share`` times all words;
none gets more than ``repeats`` times its own words, and the excess is shared out again by weight.

Defined cases: a null text has no words and takes none; a null source is a source of its own; repeated rows are
separate documents; an empty table gives an empty result. Extra columns are kept by ``mix_documents``; names
starting with ``_m_`` are reserved.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bucketed_positions, materialise, text_or_empty, word_count

WEIGHTS = (3, 1, 2)
SHARE = 1.5
REPEATS = 2
BLOCK = 1024
#: Cells of the grid on which points meet the sources' intervals.
GRID = 1024
#: Rows that a window may sort at once.
BUCKET_ROWS = 1024


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """One row for each source: _m_sid, source, source_size, target, _m_need (words to take), _m_low, _m_high.

    Only one row per source meets in one task, for ranks and running sums.
    """
    totals = sized.groupBy("source").agg(F.sum("_m_size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("_m_sid") % len(weights)) + 1).cast("int"))
    ranked = totals.withColumn("_m_sid", (F.row_number().over(by_name) - 1).cast("long")).withColumn("_m_w", weight.cast("double"))
    ranked = materialise(ranked.withColumn("_m_cap", (repeats * F.col("source_size")).cast("double")), "sources")
    # the level L with sum(min(L * weight, cap)) = budget: try each number of capped sources, in order of cap per weight
    ratio = F.col("_m_cap") / F.col("_m_w")
    every, upto = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing), Window.orderBy("_m_ratio", "_m_sid")
    tried = ranked.withColumn("_m_ratio", ratio).select(
        F.col("_m_ratio"), (F.sum(F.col("source_size").cast("double")).over(every) * share).alias("budget"), F.sum("_m_w").over(every).alias("w"),
        F.coalesce(F.sum("_m_cap").over(upto.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("cap_before"),
        F.coalesce(F.sum("_m_w").over(upto.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("w_before"),
    )
    level = tried.select(((F.col("budget") - F.col("cap_before")) / (F.col("w") - F.col("w_before"))).alias("level"), "_m_ratio")
    # levels fall once one is low enough, so the greatest of those is the first, however ratios tie; without one, all sources are capped
    first = level.filter("level <= _m_ratio").agg(F.max("level").alias("level")).first()
    target = F.least(F.lit(float("inf") if first["level"] is None else float(first["level"])) * F.col("_m_w"), F.col("_m_cap"))
    held = ranked.withColumn("target", target).withColumn("_m_need", F.least(F.round("target"), F.col("_m_cap")).cast("long"))
    high = F.sum("_m_need").over(Window.orderBy("_m_sid").rowsBetween(Window.unboundedPreceding, 0))
    return materialise(held.withColumn("_m_high", high).withColumn("_m_low", F.col("_m_high") - F.col("_m_need")).drop("_m_w", "_m_cap"), "targets")


def schedule(targets: DataFrame, block: int = BLOCK) -> DataFrame:
    """The slots of the mix: _m_sid, _m_rank (of the slot in its source), slot (its place in the schedule)."""
    spark = targets.sparkSession
    budget, n_sources = targets.agg(F.coalesce(F.max("_m_high"), F.lit(0)), F.count("*")).first()
    n_slots = -(-budget // block)
    golden = (5**0.5 - 1) / 2
    point = (F.col("slot") + 0.5) * golden
    slots = spark.range(n_slots).select(F.col("id").alias("slot")).withColumn("_m_u", (point - F.floor(point)) * budget)
    slots = slots.withColumn("_m_cell", F.floor(F.col("_m_u") * GRID / max(1, budget)))
    cell = lambda c: F.floor(F.col(c) * F.lit(GRID) / F.lit(float(max(1, budget))))
    spans = targets.filter("_m_need > 0").select("_m_sid", "_m_low", "_m_high", F.explode(F.sequence(cell("_m_low"), cell("_m_high"))).alias("_m_cell"))
    given = slots.join(spans, "_m_cell").filter("_m_u >= _m_low and _m_u < _m_high").select("_m_sid", "slot")
    given = given.withColumn("_m_b", F.floor(F.col("slot") / BUCKET_ROWS))
    ranked = materialise(bucketed_positions(given, ["_m_sid"], "_m_b", ["slot"], {"rank": F.lit(1).cast("long")}), "slots")
    counts = ranked.groupBy("_m_sid").agg(F.count("*").alias("_m_n"))
    asked = targets.select("_m_sid", F.ceil(F.col("_m_need") / block).alias("_m_k"))
    short = asked.join(counts, "_m_sid", "left").withColumn("_m_n", F.coalesce("_m_n", F.lit(0))).filter("_m_n < _m_k")
    added = short.select("_m_sid", F.explode(F.sequence("_m_n", F.col("_m_k") - 1)).alias("_m_rank")).select("_m_sid", "_m_rank", (n_slots + F.col("_m_rank") * n_sources + F.col("_m_sid")).alias("slot"))
    return ranked.join(asked, "_m_sid").filter("start_rank < _m_k").select("_m_sid", F.col("start_rank").alias("_m_rank"), "slot").unionAll(added)


def _positions(rows: DataFrame, targets: DataFrame, seed: int) -> DataFrame:
    """``rows`` (_m_row, doc_id, source, _m_size) with what their source has and their start on its line of words."""
    named = targets.withColumnRenamed("source", "_m_source")
    placed = rows.join(named, F.col("source").eqNullSafe(F.col("_m_source")))
    n_buckets = -(-max(1, rows.count()) // BUCKET_ROWS)
    key = F.xxhash64(F.lit(seed), "doc_id")
    placed = placed.withColumn("_m_key", key).withColumn("_m_b", F.pmod("_m_key", F.lit(n_buckets)))
    return bucketed_positions(placed, ["_m_sid"], "_m_b", ["_m_key", "_m_size", "_m_row"], {"word": F.col("_m_size")})


def mix(rows: DataFrame, block: int = BLOCK, seed: int = 7) -> DataFrame:
    """Pieces of the mix, joined from the schedule's slots and the shuffled blocks.

    ``rows`` has _m_row (unique), doc_id, source and _m_size. One row for each piece: the columns of ``rows``,
    source_size, target, slot, pass (0 or 1), low and high (words of the document); documents that the mix leaves out
    come once, with a null slot.
    """
    targets = source_targets(rows)
    slots = schedule(targets, block).withColumnRenamed("_m_sid", "_m_s")
    line = _positions(rows, targets, seed)

    def pieces(turn: int):
        at = F.col("source_size") * turn + F.col("start_word")
        end = F.least(at + F.col("_m_size"), F.col("_m_need"))
        one = lambda r: F.struct(F.lit(turn).alias("pass"), r.alias("_m_rank"), (F.greatest(at, r * block) - at).alias("low"), (F.least(end, (r + 1) * block) - at).alias("high"))
        none = F.array().cast("array<struct<pass:int,_m_rank:bigint,low:bigint,high:bigint>>")
        return F.when(end > at, F.transform(F.sequence(F.floor(at / block), F.floor((end - 1) / block)), one)).otherwise(none)

    cut = line.withColumn("_m_piece", F.explode_outer(F.concat(pieces(0), pieces(1))))
    # left-out documents get a rank that no slot has, another for each, so that they don't meet in one task
    rank = F.coalesce(F.col("_m_piece._m_rank"), -1 - F.col("_m_row"))
    cut = cut.withColumn("_m_rank", rank).select(*rows.columns, "source_size", "target", "_m_sid", "_m_rank", "_m_piece.pass", "_m_piece.low", "_m_piece.high")
    joined = cut.join(slots.withColumnRenamed("_m_rank", "_m_r"), (F.col("_m_sid") == F.col("_m_s")) & (F.col("_m_rank") == F.col("_m_r")), "left")
    return joined.select(*rows.columns, "source_size", "target", "slot", "pass", "low", "high")


def sized_rows(docs: DataFrame) -> DataFrame:
    """Thin rows for ``mix``."""
    return docs.select("doc_id", "source", word_count(text_or_empty("text")).alias("_m_size"))


def taken_words(docs: DataFrame, block: int = BLOCK, seed: int = 7) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken."""
    rows = materialise(sized_rows(docs).withColumn("_m_row", F.monotonically_increasing_id()), "sizes")
    words = F.sum(F.when(F.col("slot").isNotNull(), F.col("high") - F.col("low")).otherwise(0)).cast("long")
    each = mix(rows, block, seed).groupBy("_m_row", "doc_id", "_m_size", "source_size", "target").agg(words.alias("taken"))
    return each.select("doc_id", F.col("_m_size").alias("size"), "source_size", "target", "taken")


def mix_documents(docs: DataFrame, block: int = BLOCK, seed: int = 7) -> DataFrame:
    """The mixed corpus: a document comes once, and whole, for each pass that takes at least half of its words.

    So the last document of a source comes in or stays out, whichever is nearer the target; a document without words
    is taken by no pass.
    """
    held = materialise(docs.withColumns({"_m_size": word_count(text_or_empty("text")), "_m_row": F.monotonically_increasing_id()}), "mixed-rows")
    each = mix(held.select("_m_row", "doc_id", "source", "_m_size"), block, seed).filter("slot is not null")
    per_pass = each.groupBy(F.col("_m_row").alias("_m_id"), "_m_size", "pass").agg(F.max("high").alias("_m_take"))
    taken = per_pass.filter(2 * F.col("_m_take") >= F.col("_m_size")).select("_m_id")
    return held.join(taken, F.col("_m_row") == F.col("_m_id")).select(*docs.columns)
