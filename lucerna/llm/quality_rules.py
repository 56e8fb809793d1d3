"""Quality rules: a threshold table compiled into one Spark projection, without user functions.

``measures`` gives the counts of every whole text, ``compile_rules`` turns a table of thresholds into one Boolean
column over them. Windows of five words are compared by a 64-bit hash inside one document.

Defined cases: a null text has no words and fails the base rules; ratios of a text without words (or lines) are
zero; repeated rows are judged each by itself; an empty table gives an empty result. Extra columns are kept by
``apply_rules`` and left out of the query; names starting with ``_q_`` are reserved.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, WORD_CLASS, text_or_empty

# Function words of the four languages of the corpus.
STOP_WORDS = (
    "the of and to in a is that it for on was with as by be this "
    "der die das und ist nicht mit von zu den sich auf ein eine "
    "le la les de des et un une en que pour dans est pas "
    "el los las y del por con para una se al"
).split()


@dataclass(frozen=True)
class Rule:
    """``measure`` must be at least ``least`` and at most ``most`` (None: no bound) in texts of ``from_words`` or more."""

    measure: str
    least: float | None = None
    most: float | None = None
    from_words: int = 0


#: Verdict of the method, over the measures named in ``ratios``.
RULES = (
    Rule("words", least=10),
    Rule("mean_word_chars", least=2.0, most=15.0),
    Rule("symbol_ratio", most=0.05),
    Rule("stop_word_ratio", least=0.03, from_words=50),  # a short text may have none by chance
    Rule("dup_line_ratio", most=0.5),
)


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body, or a loop in it, uses it."""
    return F.get(F.transform(F.array(value), body), 0)


def repeat_words(words: Column) -> Column:
    """Words in five-word windows that occur twice or more in the array ``words``."""
    hashes = F.transform(F.sequence(F.lit(1), F.size(words) - 4), lambda i: F.xxhash64(F.slice(words, i, 5)))
    # only a text with a repeated window pays for sorting its windows
    some = lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), _let(F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), _covered)).otherwise(F.lit(0))
    return F.when(F.size(words) >= 5, _let(hashes, some)).otherwise(F.lit(0)).cast("long")


def _covered(pairs: Column) -> Column:
    """Words covered by the repeated ones of the sorted windows (hash, place)."""
    same = lambda x, i: F.coalesce(x["h"] == F.get(pairs, i)["h"], F.lit(False))
    places = F.array_sort(F.transform(F.filter(pairs, lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x["i"]))
    start = F.struct(F.lit(0).alias("n"), F.lit(-5).alias("last"))
    return F.aggregate(places, start, lambda a, p: F.struct((a["n"] + F.least(F.lit(5), p - a["last"])).alias("n"), p.alias("last")), lambda a: a["n"])


def measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_stop_words and n_repeat_words (long)."""
    spaced = docs.withColumn("_q_text", text_or_empty(text_col))
    split = spaced.withColumns({
        "_q_words": F.filter(F.split("_q_text", SPACE_CLASS + "+"), lambda w: w != ""),
        "_q_lines": F.filter(F.split("_q_text", "\n"), lambda x: x.rlike(WORD_CLASS)),
    })
    counted = split.withColumns({
        "n_words": F.size("_q_words").cast("long"),
        "word_chars": F.length(F.array_join("_q_words", "")).cast("long"),
        "n_symbols": F.regexp_count("_q_text", F.lit(r"[#*$%&|<>]")).cast("long"),
        "n_lines": F.size("_q_lines").cast("long"),
        "n_dup_lines": (F.size("_q_lines") - F.size(F.array_distinct("_q_lines"))).cast("long"),
        "n_stop_words": F.size(F.filter("_q_words", lambda w: F.lower(w).isin(STOP_WORDS))).cast("long"),
        "n_repeat_words": _let(F.col("_q_words"), repeat_words),
    })
    return counted.drop("_q_text", "_q_words", "_q_lines")


def ratios() -> dict[str, Column]:
    """What rules can bound, over the columns of ``measures``."""
    per = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return {
        "words": F.col("n_words").cast("double"),
        "mean_word_chars": per("word_chars", "n_words"),
        "symbol_ratio": per("n_symbols", "word_chars"),
        "stop_word_ratio": per("n_stop_words", "n_words"),
        "dup_line_ratio": per("n_dup_lines", "n_lines"),
        "repeat_word_ratio": per("n_repeat_words", "n_words"),
    }


def compile_rules(rules: tuple[Rule, ...] = RULES) -> Column:
    """One Boolean column: every rule of the table holds."""
    known = ratios()
    tests = []
    for r in rules:
        low = [known[r.measure] >= r.least] if r.least is not None else []
        high = [known[r.measure] <= r.most] if r.most is not None else []
        tests += [(F.col("n_words") < r.from_words) | test if r.from_words else test for test in low + high]
    return reduce(Column.__and__, tests, F.lit(True))


def apply_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """``docs`` with the measures, base_failed and kept."""
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return measures(docs, text_col).withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & compile_rules(rules))
