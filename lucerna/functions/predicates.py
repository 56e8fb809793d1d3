"""Predicates, unions of conjunctive queries and learned rules, compiled to columns.

Null model: a missing value counts as the empty string. Comparisons know the column's type, so a numeric column is
never compared with a string: ``!= ""`` there means "is present".
"""

from __future__ import annotations

from functools import reduce
from itertools import product
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import Predicate, Rules, Ucq

_COMPARE = {
    ">": Column.__gt__, ">=": Column.__ge__, "<": Column.__lt__, "<=": Column.__le__, "==": Column.__eq__, "!=": Column.__ne__,
}


def _quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def predicate(p: Predicate, schema: T.StructType) -> Column:
    """A Boolean column that is never null, in a form that scans can take over (no function around the column)."""
    if p.field not in schema.names:
        raise ValueError(f"unknown field {p.field!r}")
    kind, c = schema[p.field].dataType, _quoted(p.field)
    text = isinstance(kind, (T.StringType, T.VarcharType, T.CharType))
    if p.value == "" and isinstance(p.value, str) and p.op in ("==", "!="):
        # "is missing" and "is present"; only a text can be empty as well
        if p.op == "==":
            return c.isNull() | (c == "") if text else c.isNull()
        return c.isNotNull() & (c != "") if text else c.isNotNull()
    timed = isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType))
    value = F.lit(str(p.value)) if text else F.lit(p.value).try_cast(kind) if isinstance(p.value, str) and not timed else F.lit(p.value)
    if p.op == "==":
        return c.isNotNull() & F.coalesce(c == value, F.lit(False)) if isinstance(p.value, str) and not text else c.eqNullSafe(value)
    test = _COMPARE[p.op](c, value)
    if isinstance(p.value, str) and not text:  # a value that doesn't parse is equal to nothing, and in no range
        test = F.coalesce(test, F.lit(p.op == "!="))
    return c.isNull() | test if p.op == "!=" else c.isNotNull() & test


def ucq(groups: Ucq, schema: T.StructType) -> Column:
    """OR of ANDs. Without groups, or with an empty one, every row is accepted."""
    if not groups or any(not g for g in groups):
        return F.lit(True)
    return reduce(Column.__or__, [reduce(Column.__and__, [predicate(p, schema) for p in g]) for g in groups])


def retrieve(df: DataFrame, groups: Ucq) -> DataFrame:
    """Rows that a union of conjunctive queries accepts."""
    return df.filter(ucq(groups, df.schema)) if groups and all(groups) else df


def known_groups(groups: Ucq, columns: list[str]) -> Ucq:
    """Groups that mention no unknown column."""
    return [g for g in groups if all(p.field in columns for p in g)]


def expand(fields: list[str], op: str, values: list[Any]) -> Ucq:
    """Alternatives over several fields and values, in normal form.

    ``==``: any field equals any value. ``!=``: no field equals any value. Ranges use the first field and value.
    """
    if not fields or not values:
        raise ValueError("no field or no value")
    if op == "==":
        return [[Predicate(f, op, v)] for f, v in product(fields, values)]
    if op == "!=":
        return [[Predicate(f, op, v) for f, v in product(fields, values)]]
    return [[Predicate(fields[0], op, values[0])]]


def conjunction(parts: list[Ucq]) -> Ucq:
    """AND of unions, in normal form."""
    return [[p for g in choice for p in g] for choice in product(*parts)]


def rules_column(rules: Rules, schema: T.StructType) -> Column:
    """1 where some rule holds, else 0; no rule: 0, an empty rule: 1. A condition on a missing number fails.

    A threshold on a text column is a string: codes are ranks of sorted values, so a bound on a code is one on the text.
    """
    if not rules:
        return F.lit(0)
    if any(not r for r in rules):
        return F.lit(1)

    def one(feature: str, threshold: float | str, op: str) -> Column:
        if feature not in schema.names:
            raise ValueError(f"unknown feature {feature!r}")
        c = _quoted(feature)
        if isinstance(threshold, str):  # a missing text is the empty one, which is below any other
            return c.isNull() | (c <= threshold) if op == "<=" else c.isNotNull() & (c > threshold)
        x = c if isinstance(schema[feature].dataType, T.DoubleType) else c.cast("double")
        return c.isNotNull() & (x <= threshold if op == "<=" else x > threshold)

    hit = reduce(Column.__or__, [reduce(Column.__and__, [one(*c) for c in r]) for r in rules])
    return hit.cast("int")


def apply_rules(df: DataFrame, rules: Rules, name: str = "predicted") -> DataFrame:
    """``df`` with a column of 0 and 1. The plan is a plain projection: a filter on it reaches the scan."""
    return df.withColumn(name, rules_column(rules, df.schema))


def rules_text(rules: Rules) -> str:
    """Rules as one line of SQL."""
    if not rules:
        return "FALSE"
    if any(not r for r in rules):
        return "TRUE"
    return " OR ".join("(" + " AND ".join(f"{f} {op} {t!r}" if isinstance(t, str) else f"{f} {op} {t:g}" for f, t, op in r) + ")" for r in rules)
