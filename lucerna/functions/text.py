"""Scalar functions over text: vectors of items, Boolean coercion, serialised rows and guards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import Kind


def items(c: Column) -> Column:
    """The items of a comma-separated vector: trimmed, without empty ones; a null vector has none."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")


def reduce_items(values: Column, kind: Kind) -> Column:
    """One value from an array of item values: OR of Booleans, sum of numbers; nothing gives false or 0."""
    if kind is Kind.BOOL:
        return F.exists(values, lambda x: x)
    if kind is Kind.UNDEFINED:
        raise ValueError("items of undefined type can't be reduced")
    zero = F.lit(0).cast(kind.sql)
    return F.aggregate(values, zero, lambda a, x: a + F.coalesce(x.cast(kind.sql), zero))


def map_items(df: DataFrame, column: str, ask, kind: Kind, name: str) -> DataFrame:
    """``ask(item)`` over each item of a vector column, reduced to one value; rows without items keep their place."""
    return df.withColumn(name, reduce_items(F.transform(items(F.col(column)), ask), kind))


def as_bool(c: Column, name: str = "label") -> Column:
    """Strict Boolean coercion: true/false, 1/0 in any case and spacing; anything else (also null) is an error."""
    text = F.lower(F.trim(c.cast("string")))
    wrong = F.raise_error(F.concat(F.lit(f"{name} is not Boolean: "), F.coalesce(text, F.lit("null"))))
    return F.when(text.isin("true", "1"), True).when(text.isin("false", "0"), False).otherwise(wrong.cast("boolean"))


def serialised(columns: list[str], sep: str = ", ") -> Column:
    """A row as ``name: value, ...``; a missing value is an empty one."""
    return F.concat_ws(sep, *[F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns])


def without_comma(c: Column, name: str) -> Column:
    """The value, or an error where it holds a comma and so would break a vector."""
    wrong = F.raise_error(F.concat(F.lit(f"{name} holds a comma: "), c))
    return F.when(F.contains(F.coalesce(c, F.lit("")), F.lit(",")), wrong.cast("string")).otherwise(c)


def one_line(c: Column) -> Column:
    """Line ends as spaces."""
    return F.translate(c, "\n\r", "  ")
