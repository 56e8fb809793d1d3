"""Column profiles, label encoding and standardisation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def numeric_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column_name, min_value, max_value of numeric columns: one aggregate over one scan, unpivoted afterwards."""
    columns = columns if columns is not None else numeric_columns(df)
    sums = df.agg(*[f(c).cast("double").alias(f"{n}_{i}") for i, c in enumerate(columns) for f, n in ((F.min, "lo"), (F.max, "hi"))])
    return sums.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"lo_{i}").alias("min_value"), F.col(f"hi_{i}").alias("max_value")) for i, c in enumerate(columns)])))


def categorical_profile(df: DataFrame, columns: list[str], top: int = 20) -> DataFrame:
    """column_name, value, n, n_distinct: the ``top`` most frequent values of each column and how many it has.

    All columns are counted in one pass; ties are ordered by value.
    """
    long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns])))
    counts = long.groupBy("column_name", "value").agg(F.count("*").alias("n"))
    distinct = counts.groupBy("column_name").agg(F.count("value").alias("n_distinct"))
    place = F.row_number().over(Window.partitionBy("column_name").orderBy(F.desc("n"), "value"))
    return counts.withColumn("_place", place).filter(F.col("_place") <= top).drop("_place").join(distinct, "column_name").select("column_name", "value", "n", "n_distinct")


def schema_text(df: DataFrame) -> str:
    """A table's profile as text, for prompts."""
    numbers = numeric_columns(df)
    rest = [c for c in df.columns if c not in numbers and not c.startswith("_")]
    lines = [f"{r['column_name']}: from {r['min_value']} to {r['max_value']}" for r in (numeric_profile(df, numbers).collect() if numbers else [])]
    if rest:
        values: dict[str, list] = {}
        for r in sorted(categorical_profile(df, rest).collect(), key=lambda r: (r["column_name"], -r["n"], r["value"] or "")):
            values.setdefault(f"{r['column_name']} ({r['n_distinct']} values)", []).append(f"{r['value']!r} x{r['n']}")
        lines += [f"{c}: {', '.join(v)}" for c, v in values.items()]
    return "\n".join(lines)


def label_codes(df: DataFrame, column: str) -> DataFrame:
    """value, code: the rank of each distinct value as text, from 0; one dictionary for all frames that share it."""
    text = F.coalesce(F.col(column).cast("string"), F.lit(""))
    # values are ranked by their first letters apart; only the sizes of these slices meet in one task
    values = df.select(text.alias("value")).distinct().withColumn("_s", F.substring("value", 1, 4))
    before = Window.orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    sizes = values.groupBy("_s").agg(F.count("*").alias("_n")).select("_s", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_s").orderBy("value"))
    return values.withColumn("_in", inside).join(sizes, "_s").select("value", (F.col("_in") + F.col("_before") - 1).cast("long").alias("code"))


def encoded(df: DataFrame, column: str, codes: DataFrame | None = None, name: str | None = None) -> DataFrame:
    """``df`` with the codes of a text column; values that the dictionary lacks get -1."""
    codes = label_codes(df, column) if codes is None else codes
    table = codes.select(F.col("value").alias("_value"), F.col("code").alias("_code"))
    joined = df.join(table, F.coalesce(F.col(column).cast("string"), F.lit("")) == F.col("_value"), "left")
    return joined.withColumn(name or column, F.coalesce("_code", F.lit(-1).cast("long"))).drop("_value", "_code")


def moments(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation of each column; a deviation of zero counts as one."""
    r = df.agg(*[f(c).alias(f"{n}_{i}") for i, c in enumerate(columns) for f, n in ((F.avg, "m"), (F.stddev_pop, "s"))]).first()
    return {c: (r[f"m_{i}"] or 0.0, r[f"s_{i}"] or 1.0) for i, c in enumerate(columns)}


def standardised(df: DataFrame, columns: list[str], fit: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """``df`` with the columns centred and scaled; ``fit`` from another frame keeps both on one scale."""
    fit = moments(df, columns) if fit is None else fit
    return df.withColumns({c: (F.col(c).cast("double") - F.lit(fit[c][0])) / F.lit(fit[c][1]) for c in columns})
