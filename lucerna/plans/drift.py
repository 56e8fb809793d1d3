"""Drifted queries: answer a later query from what an earlier one has left behind.

A view keeps the earlier query's rows with their features, and its rules. A new query that means the same reuses the
rules; one that needs no other column gets rules made for the view; one contained in the first runs on the view; any
other runs in full.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.predicates import apply_rules, rules_text
from ..model import SEMANTIC_PREFIX, Rules, SemCQ
from ..operators import buckets as B
from ..operators.quality import Quality, quality
from ..sources.datasets import append_journal
from .engine import Engine, QueryState

MODES = ("rerun", "reuse", "align", "selective")


@dataclass
class View:
    """A materialised view of an answered query."""

    query: SemCQ
    rows: DataFrame
    rules: Rules
    features: list[str] = field(default_factory=list)
    f1: float | None = None

    @classmethod
    def of(cls, engine: Engine, state: QueryState) -> View:
        return cls(state.query, state.rows, engine.raw_rules(state), [s.target for s in state.features], state.translation and state.translation.f1)

    def effective_rules(self) -> Rules:
        """Rules; where none were learned, every predicate's own feature must hold."""
        own = [f for f in self.features if f.startswith(SEMANTIC_PREFIX)]
        return self.rules or ([[(f, 0.5, ">") for f in own]] if own else [])

    def save(self, path: str) -> None:
        """Rows as Parquet, rules and features as one JSON row beside them."""
        self.rows.write.mode("overwrite").parquet(f"{path}/rows")
        state = json.dumps({"rules": self.rules, "features": self.features, "f1": self.f1})
        self.rows.sparkSession.createDataFrame([(state,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/state")

    @classmethod
    def load(cls, spark: SparkSession, path: str, query: SemCQ) -> View:
        state = json.loads(spark.read.text(f"{path}/state").first()[0])
        return cls(query, spark.read.parquet(f"{path}/rows"), [[tuple(c) for c in r] for r in state["rules"]], state["features"], state["f1"])


@dataclass(frozen=True)
class Outcome:
    route: str
    relation: str
    rules: Rules
    quality: Quality

    def row(self, first: str, second: str, mode: str) -> dict[str, Any]:
        return {"first": first, "second": second, "mode": mode, "route": self.route, "relation": self.relation, "rules": rules_text(self.rules), "f1": self.quality.f1, "err": self.quality.err}


def state_path(root: str, group: str, query: str, engine: Engine) -> str:
    """Where the view of a query lives: runs of other settings or backends have other folders."""
    key = hashlib.sha1(f"{engine.config}|{engine.backend.name}".encode()).hexdigest()[:12]
    return f"{root.rstrip('/')}/{group}/{query}-{key}"


def view_of(engine: Engine, name: str, path: str, fresh: bool = False) -> View:
    """The view of an answered query: loaded if it is there, else the query runs and its view is saved."""
    spark = engine.spark
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/state/_SUCCESS")
    if fresh or not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        View.of(engine, engine.run_query(name, engine.partition())).save(path)
    return View.load(spark, path, engine.queries[name])


def run_group(engine: Engine, group: str, pairs: list[tuple[str, str]], mode: str, root: str, fresh: bool = False) -> list[dict[str, Any]]:
    """Each pair's second query, answered with the help of the first one's view; a line for each goes to the journal."""
    out = []
    for first, second in pairs:
        engine.backend.reset_usage()
        outcome = route(engine, second, view_of(engine, first, state_path(root, group, first, engine), fresh), mode)
        out.append(outcome.row(first, second, mode) | {"group": group} | engine.backend.usage())
    append_journal(engine.spark, f"{root.rstrip('/')}/journal", out)
    return out


def answer_by_rules(view: View, rules: Rules, selected: list[str]) -> DataFrame:
    """Rows of the view that the rules accept, and rows annotated as true."""
    rows = apply_rules(view.rows, rules)
    return rows.filter((F.col("predicted") == 1) | (F.col("bucket") == B.SELECTED)).select(*selected).distinct()


def judged(view: View, rules: Rules, query: SemCQ, truth: DataFrame) -> Quality:
    """Quality of rules over the whole view, against the new query's truth."""
    found = apply_rules(view.rows, rules).filter("predicted = 1")
    true = view.rows.join(truth.select(*query.selected).distinct(), list(query.selected), "left_semi")
    return quality(true, found, list(query.selected), view.rows.count())


def route(engine: Engine, name: str, view: View, mode: str = "selective") -> Outcome:
    """Answer ``engine.queries[name]`` with the help of a view, under one of the modes.

    ``rerun`` ignores the view; ``reuse`` applies its rules unseen; ``align`` asks how the queries relate and reuses,
    narrows or reruns; ``selective`` also tries rules made from the view's columns.
    """
    if mode not in MODES:
        raise ValueError(f"mode: one of {MODES}")
    query, truth = engine.queries[name], engine.truth[name]
    if mode == "rerun":
        return _full(engine, name, "unasked")
    if mode == "reuse":
        rules = view.effective_rules()
        return Outcome("reuse", "unasked", rules, judged(view, rules, query, truth))
    relation = engine.backend.relate(query, view.query)
    if relation == "same":
        rules = view.effective_rules()
        return Outcome("reuse", relation, rules, judged(view, rules, query, truth))
    if mode == "selective" and engine.backend.supports(query, view.rows.columns):
        made = engine.backend.regenerate(query, view.rows.columns)
        if made and valid_rules(made, view.rows.columns):
            return Outcome("regenerate", relation, made, judged(view, made, query, truth))
    if relation == "contained":
        return _narrowed(engine, name, view)
    return _full(engine, name, relation)


def valid_rules(rules: Rules, columns: list[str]) -> bool:
    return all(r and all(f in columns and op in ("<=", ">") and isinstance(t, (int, float, str)) for f, t, op in r) for r in rules)


def _full(engine: Engine, name: str, relation: str) -> Outcome:
    state = engine.run_query(name, engine.partition())
    return Outcome("rerun", relation, engine.raw_rules(state), state.translation)


def _narrowed(engine: Engine, name: str, view: View) -> Outcome:
    """Run on the rows that the first query's rules accept: all of its union, not one conjunction of it."""
    kept = apply_rules(view.rows, view.effective_rules()).filter((F.col("predicted") == 1) | (F.col("bucket") == B.SELECTED))
    inner = replace(engine, table=kept.select(*engine.table.columns))
    state = inner.run_query(name, inner.partition())
    found = inner.answer(name, state)
    true = engine.table.join(engine.truth[name].select(*state.query.selected).distinct(), list(state.query.selected), "left_semi")
    return Outcome("narrowed", "contained", inner.raw_rules(state), quality(true, found, list(state.query.selected), engine.table.count()))
