"""Experiments: grids of settings, traces collected by dotted fields, and reports."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from itertools import product
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.predicates import rules_column, rules_text
from ..model import Config, SemCQ
from ..sources.datasets import result_table
from .engine import Engine, QueryState


def grid(overrides: dict[str, list[Any]]) -> Iterator[dict[str, Any]]:
    """Every combination of the listed values; without lists, one empty one."""
    names = list(overrides)
    for values in product(*[overrides[n] if isinstance(overrides[n], list) else [overrides[n]] for n in names]):
        yield dict(zip(names, values, strict=True))


def nested(value: Any, path: str) -> Any:
    """A field by its dotted path; None where it ends early."""
    for key in path.split("."):
        value = value.get(key) if isinstance(value, dict) else getattr(value, key, None)
        if value is None:
            return None
    return value


def chosen_rounds(trace: list[dict[str, Any]], which: str | int | list[int]) -> list[dict[str, Any]]:
    """All rows of a trace (``ALL``), the last (``LAST``), or those listed."""
    if which == "ALL":
        return trace
    if which == "LAST":
        return trace[-1:]
    wanted = [which] if isinstance(which, int) else list(which)
    return [trace[i] for i in wanted if -len(trace) <= i < len(trace)]


def collect(trace: list[dict[str, Any]], fields: list[str], which: str | int | list[int] = "ALL") -> list[dict[str, Any]]:
    """Rows of a trace with some of its fields."""
    return [{"query": r.get("query"), "candidate": r.get("candidate"), **{f: nested(r, f) for f in fields}} for r in chosen_rounds(trace, which)]


@dataclass
class Experiment:
    """An engine run under every combination of settings; rows of all runs, ready for one table."""

    engine: Engine
    overrides: dict[str, list[Any]] = field(default_factory=dict)
    fields: tuple[str, ...] = ("pred_eval.f1", "trans_eval.f1", "L_static", "L_rew", "penalty_rew", "L_obj", "L_LOO", "penalty_LOO", "L_subj", "selectivity", "features")
    which: str | int | list[int] = "ALL"
    with_certificate: bool = False
    payloads: list[dict[str, Any]] = field(default_factory=list)

    def rows(self) -> list[dict[str, Any]]:
        out = []
        self.payloads.clear()
        for settings in grid(self.overrides):
            engine = replace(self.engine, config=replace(self.engine.config, **settings), seconds={})
            engine.backend.reset_usage()
            states = engine.run(self.with_certificate)
            self.payloads.append({"settings": settings} | payload(engine, states))
            for s in states.values():
                bounds = {"bound": s.certificate.bound, "f1_bound": s.f1_bound} if s.certificate else {}
                out += [settings | r | bounds for r in collect(s.trace(engine.config), list(self.fields), self.which)]
        return out

    def table(self) -> DataFrame:
        return result_table(self.engine.spark, self.rows())


# -- reports ------------------------------------------------------------------------------------------------------


def overview(spark: SparkSession, states: dict[str, QueryState], config: Config) -> DataFrame:
    """One row for each query: losses, quality and rules of the chosen rewrite."""
    rows = []
    for s in states.values():
        t = next(r for r in s.trace(config) if r["chosen"])
        rows.append({k: t[k] for k in ("query", "kind", "features", "depth", "L_subj", "L_obj", "L_static", "selectivity", "rules")} | {"pred_f1": nested(t, "pred_eval.f1"), "trans_f1": nested(t, "trans_eval.f1"), "bound": s.certificate and s.certificate.bound, "f1_bound": s.f1_bound})
    return result_table(spark, rows)


def average_loss(states: dict[str, QueryState], config: Config) -> float:
    losses = [s.attempt.loss(config) for s in states.values() if s.attempts]
    return sum(losses) / len(losses) if losses else 0.0


def rounds(spark: SparkSession, states: dict[str, QueryState]) -> DataFrame:
    """One row for each query and batch after the first."""
    return result_table(spark, [{"query": n} | r for n, s in states.items() for r in s.rounds])


def selected_rules(spark: SparkSession, engine: Engine, states: dict[str, QueryState]) -> DataFrame:
    """One row for each rule of the chosen rewrites, over the table's own columns, with the rows it accepts alone."""
    rows = []
    for n, s in states.items():
        rules = engine.raw_rules(s)
        columns = [rules_column([r], s.rows.schema) for r in rules]
        hits = s.rows.agg(*[F.sum(c).alias(f"r{i}") for i, c in enumerate(columns)]).first() if rules else []
        rows += [{"query": n, "rule": i, "text": rules_text([r]), "accepted": hits[i] or 0} for i, r in enumerate(rules)]
    return result_table(spark, rows)


def usage_report(spark: SparkSession, parts: dict[str, dict[str, float]]) -> DataFrame:
    """Calls, tokens and costs of each run, and of all of them."""
    return result_table(spark, [{"run": n} | u for n, u in parts.items()] + [{"run": "all"} | usage_totals(list(parts.values()))])


def footprint(df: DataFrame) -> int:
    """Bytes that the optimizer expects of a table: files read, or rows times their width."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def payload(engine: Engine, states: dict[str, QueryState]) -> dict[str, Any]:
    """The result of a run as plain values."""
    return {
        "seconds": dict(engine.seconds), "usage": engine.backend.usage(), "trace": engine.trace(states), "L_avg": average_loss(states, engine.config),
        "certificates": {n: s.certificate.bound for n, s in states.items() if s.certificate}, "rounds": {n: s.rounds for n, s in states.items()},
        "bytes": {n: footprint(s.rows) for n, s in states.items()},
    }


def usage_totals(parts: list[dict[str, float]]) -> dict[str, float]:
    names = sorted({k for p in parts for k in p})
    return {n: sum(p.get(n, 0) for p in parts) for n in names}


def describe(query: SemCQ) -> str:
    static = " and ".join(map(str, query.sigma)) or "all rows"
    return f"{', '.join(query.selected)} where {static}; " + "; ".join(p.condition for p in query.semantics)
