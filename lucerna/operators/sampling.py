"""Annotation samples: which rows to label, by strata of a proxy label, with diverse anchors for texts."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import as_bool
from ..parallel import InheritableThreadPool
from .batches import shuffle_key

RANDOM, ADAPTIVE, HYBRID = "random", "adaptive", "hybrid"
#: Anchors of a stratum, at most.
ANCHORS = 2
#: Terms of the text vectors that diversity is measured with: the most frequent ones.
TERMS = 8192

# Words that carry no topic.
STOP_WORDS = (
    "a an and are as at be but by for from had has have he her his i if in into is it its of on or she so that the their "
    "them then there these they this to was we were what when which who will with you your"
).split()


def strategy_for(has_text: bool, has_proxy: bool) -> str:
    """Texts: hybrid; otherwise adaptive with a proxy label, else random."""
    return HYBRID if has_text else ADAPTIVE if has_proxy else RANDOM


def clamped_budget(budget: int, n: int) -> int:
    return max(0, min(budget, n))


def positive_count(budget: int, positive: int, negative: int) -> int:
    """Labels for the positive stratum: half, with one for each side, what a side can't use going to the other."""
    if not positive:
        return 0
    if not negative:
        return budget
    want = math.floor(budget / 2 + 0.5)
    if budget >= 2:
        want = min(max(want, 1), budget - 1)
    want = min(want, positive)
    return want + (budget - want) - min(budget - want, negative)


def text_terms(column: str) -> Column:
    """Lower-case words and word pairs of a text without stop words."""
    words = F.filter(F.split(F.lower(F.coalesce(F.col(column).cast("string"), F.lit(""))), r"[^\p{L}\p{N}_]+"), lambda w: (F.length(w) > 1) & ~w.isin(STOP_WORDS))
    pairs = F.when(F.size(words) > 1, F.zip_with(F.slice(words, F.lit(1), F.size(words) - 1), F.slice(words, F.lit(2), F.size(words) - 1), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>"))
    return F.concat(words, pairs)


def text_vectors(rows: DataFrame, row_id: str, column: str) -> DataFrame:
    """row_id, term, x: unit TF-IDF vectors over the ``TERMS`` most frequent terms, with idf = ln((1 + n) / (1 + df)) + 1."""
    n = rows.count()
    tf = rows.select(row_id, F.explode(text_terms(column)).alias("term")).groupBy(row_id, "term").agg(F.count("*").alias("tf"))
    # at most TERMS short rows
    df = F.broadcast(tf.groupBy("term").agg(F.sum("tf").alias("_all"), F.count("*").alias("df")).orderBy(F.desc("_all"), "term").limit(TERMS).select("term", "df"))
    idf = F.log((1.0 + n) / (1.0 + F.col("df"))) + 1.0
    raw = tf.join(df, "term").select(row_id, "term", (F.col("tf") * idf).alias("x"))
    norm = raw.groupBy(row_id).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    return raw.join(norm, row_id).select(row_id, "term", (F.col("x") / F.col("norm")).alias("x"))


def diverse_rows(rows: DataFrame, row_id: str, column: str, count: int) -> list:
    """Ids of ``count`` rows far apart: the one nearest the centroid, then each least like all chosen so far (to nine digits;
    of equals the least id)."""
    vectors = text_vectors(rows, row_id, column).cache()
    try:
        centroid = vectors.groupBy("term").agg((F.sum("x") / max(1, rows.count())).alias("c"))
        like = vectors.join(centroid, "term").groupBy(row_id).agg(F.sum(F.col("x") * F.col("c")).alias("s"))
        chosen = [r[0] for r in rows.select(row_id).join(like, row_id, "left").orderBy(F.desc(F.round(F.coalesce("s", F.lit(0.0)), 9)), row_id).limit(min(1, count)).collect()]
        while chosen and len(chosen) < count:
            picked = vectors.filter(F.col(row_id).isin(chosen)).select(F.col(row_id).alias("_c"), "term", F.col("x").alias("_x"))
            near = vectors.join(picked, "term").groupBy(row_id, "_c").agg(F.sum(F.col("x") * F.col("_x")).alias("s")).groupBy(row_id).agg(F.max("s").alias("s"))
            following = rows.select(row_id).filter(~F.col(row_id).isin(chosen)).join(near, row_id, "left").orderBy(F.round(F.coalesce("s", F.lit(0.0)), 9), row_id).limit(1).collect()
            if not following:
                break
            chosen.append(following[0][0])
        return chosen
    finally:
        vectors.unpersist()


@dataclass(frozen=True)
class Selection:
    """What to label: (row id, stratum, anchor) with the size of each stratum."""

    mode: str
    rows: tuple[tuple, ...]
    population: dict[str, int]

    @property
    def ids(self) -> list:
        return [r[0] for r in self.rows]

    def frame(self, spark, row_id: str, id_type: str) -> DataFrame:
        data = [(i, s, a, self.population[s]) for i, s, a in self.rows]
        return spark.createDataFrame(data, f"{row_id} {id_type}, stratum string, is_anchor boolean, population_size long")


def _stratum(rows: DataFrame, row_id: str, count: int, size: int, seed: int, text: str | None) -> list[tuple]:
    """One stratum: all of it as anchors if it is small, else anchors (for texts) and seeded picks."""
    if not count:
        return []
    if size <= count:
        return [(r[0], True) for r in rows.select(row_id).orderBy(row_id).collect()]
    anchors = diverse_rows(rows, row_id, text, min(ANCHORS, count - 1)) if text and count > 1 else []
    rest = rows.filter(~F.col(row_id).isin(anchors)) if anchors else rows
    picks = rest.select(row_id).orderBy(shuffle_key(seed, row_id), row_id).limit(count - len(anchors)).collect()
    return [(a, True) for a in anchors] + [(r[0], False) for r in picks]


def select_sample(rows: DataFrame, row_id: str, budget: int, strategy: str, seed: int, proxy: str | None = None, text: str | None = None) -> Selection:
    """Rows to label within the budget. ``proxy`` is a cheap Boolean guess that makes the strata.

    Adaptive sampling is plain random sampling where that is likely to meet both classes anyway (two or more of the
    rarer one expected). Nothing but the chosen ids reaches the driver.
    """
    if strategy == RANDOM or proxy is None:
        n = rows.count()
        budget = clamped_budget(budget, n)
        return Selection(RANDOM, tuple((i, "all", a) for i, a in _stratum(rows, row_id, budget, n, seed, None)), {"all": n})
    guess = F.coalesce(as_bool(F.col(proxy), proxy), F.lit(False))
    sizes = {r["g"]: r["count"] for r in rows.groupBy(guess.alias("g")).count().collect()}
    positive, negative = sizes.get(True, 0), sizes.get(False, 0)
    n = positive + negative
    budget = clamped_budget(budget, n)
    if strategy == ADAPTIVE and n and budget * min(positive, negative) / n >= 2:
        return Selection(RANDOM, tuple((i, "all", a) for i, a in _stratum(rows, row_id, budget, n, seed, None)), {"all": n})
    take = positive_count(budget, positive, negative)
    text = text if strategy == HYBRID else None
    sides = [("positive", guess, take, positive, seed), ("negative", ~guess, budget - take, negative, seed + 1)]
    with InheritableThreadPool(len(sides)) as pool:
        found = pool.map(lambda s: [(i, s[0], a) for i, a in _stratum(rows.filter(s[1]), row_id, s[2], s[3], s[4], text)], sides)
    chosen = [c for side in found for c in side]
    return Selection(strategy, tuple(chosen), {s: k for s, k in (("positive", positive), ("negative", negative)) if k})


def stratified_table(rows: DataFrame, row_id: str, stratum: str, budget: int, seed: int) -> DataFrame:
    """The same allotment as one declarative plan: row_id, stratum, population_size of the rows to label."""
    sizes = {bool(r[0]): r["count"] for r in rows.groupBy(stratum).count().collect()}
    budget = clamped_budget(budget, sum(sizes.values()))
    take = positive_count(budget, sizes.get(True, 0), sizes.get(False, 0))


    def part(value: bool, count: int) -> DataFrame:  # a limited sort keeps no more than ``count`` rows of a task
        of = rows.filter(F.col(stratum) == F.lit(value)).select(row_id, F.lit(value).alias("stratum"), F.lit(sizes.get(value, 0)).cast("long").alias("population_size"))
        return of.orderBy(shuffle_key(seed, row_id), row_id).limit(count)

    return part(True, take).unionAll(part(False, budget - take))
