"""The engine: from a semantic query to a union of plain rules, with losses, certificates and batch updates.

Order of the operators is fixed: static filter, prefilter, semantic map. So the static filter reaches the scan, and no
backend ever sees a row that plain predicates could have ruled out. Only labelling budgets' worth of rows, counts
and losses reach the driver.
"""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass, field, replace
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.predicates import apply_rules, known_groups, rules_text
from ..functions.text import serialised
from ..model import Config, FeatureSpec, Kind, Modality, Predicate, Rules, SemCQ, SemPredicate, TableRoles, Ucq, normal_prompt, semantic_feature
from ..operators import buckets as B
from ..operators.batches import shuffle_key, with_batches
from ..operators.certify import Certificate, certificate, f1_bound
from ..operators.confidence import class_distance, combined_confidence, select_empirical, select_incremental, structural_confidence, weighted_features
from ..operators.features import FeatureCache, PseudoLabelCache, accepted, predicate_budgets, rank_features, table_fingerprint, with_mandatory
from ..operators.forest import CONFIDENCE, Forest, ForestConfig, choose_depth, importances, loo_grid, propagate, train
from ..operators.profile import label_codes, moments
from ..operators.quality import Quality, bucket_quality
from ..operators.rewrite import Candidate, arity, best_candidate, candidates, extract_rules, least_prefix
from ..operators.sampling import Selection, select_sample, strategy_for
from ..operators.weights import balanced_weights, beta_selectivity, objective_penalty, weighted_loss
from ..parallel import InheritableThreadPool
from ..sources.backends import SemanticBackend
from ..sources.datasets import StateStore

#: Pseudo-labelled rows that a forest is fitted on, at most, by default: the setting ``most_pseudo`` of an engine.
MOST_PSEUDO = 2_000
#: Candidates that are evaluated at once.
PARALLEL = 4
#: How much the penalties weigh in the static loss.
PENALTY = 0.01
CODE = "code__"


@dataclass
class Attempt:
    """One rewrite candidate, evaluated."""

    candidate: Candidate
    depth: int
    forest: Forest | None
    rules: Rules
    loo_loss: float
    loo_penalty: float
    rewrite_loss: float
    rewrite_penalty: float
    seconds: float = 0.0

    @property
    def subjective(self) -> float:
        return self.loo_loss + PENALTY * self.loo_penalty

    @property
    def objective(self) -> float:
        return self.rewrite_loss + PENALTY * self.rewrite_penalty

    def loss(self, config: Config) -> float:
        return (self.subjective if config.enable_subj else 0.0) + (self.objective if config.enable_obj else 0.0)


@dataclass
class QueryState:
    """What the engine knows of one query; data frames are immutable, so a copy of it is a snapshot."""

    name: str
    query: SemCQ
    rows: DataFrame
    features: list[FeatureSpec] = field(default_factory=list)
    base: list[str] = field(default_factory=list)
    selection: Selection | None = None
    labelled: pd.DataFrame = field(default_factory=pd.DataFrame)
    pseudo: pd.DataFrame = field(default_factory=pd.DataFrame)
    pi: float = 0.5
    bounds: tuple[float, float] = (0.0, 1.0)
    attempts: list[Attempt] = field(default_factory=list)
    best: int = 0
    prediction: Quality | None = None
    translation: Quality | None = None
    certificate: Certificate | None = None
    f1_bound: float | None = None
    rounds: list[dict[str, Any]] = field(default_factory=list)

    @property
    def attempt(self) -> Attempt:
        return self.attempts[self.best]

    @property
    def rules(self) -> Rules:
        return self.attempt.rules

    def trace(self, config: Config) -> list[dict[str, Any]]:
        out = []
        for i, a in enumerate(self.attempts):
            out.append({
                "query": self.name, "candidate": i, "kind": a.candidate.kind, "features": list(a.candidate.features), "depth": a.depth, "chosen": i == self.best,
                "rules": rules_text(a.rules), "L_LOO": a.loo_loss, "penalty_LOO": a.loo_penalty, "L_subj": a.subjective, "L_rew": a.rewrite_loss,
                "penalty_rew": a.rewrite_penalty, "L_obj": a.objective, "L_static": a.subjective + a.objective, "selectivity": self.pi, "seconds": a.seconds,
                "pred_eval": self.prediction and {"f1": self.prediction.f1, "err": self.prediction.err}, "trans_eval": self.translation and {"f1": self.translation.f1, "err": self.translation.err},
            })
        return out


@dataclass
class Engine:
    """Runs queries over one table.

    ``truth`` has, for each query, the keys (``selected`` columns) of its true rows: what a human annotator answers.
    ``row_id`` names a unique column. ``cache`` is a folder for materialised features, if any, and ``store`` one for
    proposals, prefilters and certificates. A backend whose answers cost something always has a cache, for the run at least.
    """

    table: DataFrame
    roles: TableRoles
    queries: dict[str, SemCQ]
    truth: dict[str, DataFrame]
    backend: SemanticBackend
    row_id: str
    config: Config = field(default_factory=Config)
    cache: FeatureCache | None = None
    seconds: dict[str, float] = field(default_factory=dict)
    store: StateStore | None = None
    pseudo_labels: PseudoLabelCache | None = None
    most_pseudo: int = MOST_PSEUDO

    def __post_init__(self):
        if self.cache is None and not self.backend.repeatable:
            shared = self.spark.conf.get("spark.checkpoint.dir", None) or self.spark.sparkContext.getConf().get("spark.checkpoint.dir")
            self.cache = FeatureCache(f"{shared.rstrip('/')}/features-{uuid.uuid4().hex}") if shared else None

    @property
    def spark(self) -> SparkSession:
        return self.table.sparkSession

    # -- phases ---------------------------------------------------------------------------------------------------

    def _timed(self, phase: str, since: float) -> None:
        self.seconds[phase] = self.seconds.get(phase, 0.0) + time.time() - since

    def partition(self) -> DataFrame:
        if len(self.config.dynamic_setting) == 1 and self.config.dynamic_setting[0] == 1.0:
            return self.table.withColumn("batch_id", F.lit(0))
        return with_batches(self.table, self.config.dynamic_setting, self.config.random_seed, self.row_id)

    def start(self, name: str, batched: DataFrame) -> QueryState:
        """Static filter, truth and prefilter."""
        query = self.queries[name]
        rows = B.with_truth(B.initialise(batched, query, name), self.truth[name], list(query.selected))
        groups = known_groups(self._prefilter(query), self.table.columns)
        rows = B.refine(rows, groups).withColumn("annotated", F.lit(False))
        return QueryState(name, query, rows, base=[c for c in self.roles.base if c in self.table.columns])

    def _prefilter(self, query: SemCQ) -> Ucq:
        """The backend's prefilter, from the store if one is there whose columns all exist."""
        if self.store is None:
            return self.backend.prefilter(query, self.table)
        key = f"prefilter|{self.backend.name}|{[_predicate_key(p) for p in query.semantics]}|{sorted(self.table.columns)}"
        held = self.store.get(key, lambda v: all(p["field"] in self.table.columns for g in v for p in g))
        if held is None:
            groups = self.backend.prefilter(query, self.table)
            self.store.put(key, [[{"field": p.field, "op": p.op, "value": p.value} for p in g] for g in groups])
            return groups
        return [[Predicate(**p) for p in g] for g in held]

    def _proposals(self, p: SemPredicate, budget: int) -> list[FeatureSpec]:
        """Proposals for a predicate, from the store if it has them; they depend on the predicate and the budget only."""
        key = f"propose|{self.backend.name}|{_predicate_key(p)}|{budget}"
        held = self.store.get(key) if self.store else None
        if held is not None:
            return [FeatureSpec(x["source"], Modality(x["modality"]), x["target"], x["prompt"], Kind(x["kind"])) for x in held]
        specs = self.backend.propose(p, self.table.columns, budget)
        if self.store:
            self.store.put(key, [{"source": s.source, "modality": s.modality.value, "target": s.target, "prompt": s.prompt, "kind": s.kind.value} for s in specs])
        return specs

    def propose(self, state: QueryState) -> None:
        """Mandatory features of the predicates, and proposals within the feature budget."""
        proposed, taken = [], set()
        budgets = predicate_budgets(len(state.query.semantics), self.config.b_fs)
        for p, budget in zip(state.query.semantics, budgets, strict=True):
            if self.config.enable_enrich:
                proposed += accepted(self._proposals(p, budget), p, self.table.columns, taken, budget)
        state.features = with_mandatory(state.query, proposed)

    def extract(self, rows: DataFrame, specs: list[FeatureSpec]) -> DataFrame:
        for spec in specs:
            if spec.target not in rows.columns:
                rows = self.cache.materialise(rows, spec, self.backend) if self.cache else self.backend.extract(rows, [spec])
        return rows

    def candidates_of(self, state: QueryState, batch: int | None = 0) -> DataFrame:
        rows = state.rows.filter(F.col("bucket") == B.CANDIDATE)
        return rows if batch is None else rows.filter(F.col("batch_id") == batch)

    def annotate(self, state: QueryState) -> None:
        """Choose rows of batch 0, label them, and move them out of the candidates. One class only: try other seeds."""
        mandatory = [semantic_feature(p) for p in state.query.semantics]
        make = lambda rows: self.extract(rows, mandatory).withColumn("proxy", all_hold(mandatory))
        pool = self.candidates_of(state)
        pool = self.pseudo_labels.labelled(pool, self.row_id, mandatory, self.backend.name, make) if self.pseudo_labels else make(pool)
        pool = pool.persist()
        texts = [p.field for p in state.query.semantics if p.modality.is_text]
        strategy = strategy_for(bool(texts), bool(state.query.semantics))
        for seed in [self.config.random_seed, *range(43)]:
            selection = select_sample(pool, self.row_id, self.config.b_lab, strategy, seed, "proxy" if state.query.semantics else None, texts[0] if texts else None)
            chosen = pool.filter(F.col(self.row_id).isin(selection.ids)).select(self.row_id, F.col("label" if self.config.enable_hitl else "proxy").alias("human")) if selection.ids else None
            labels = {r[0]: bool(r[1]) for r in chosen.collect()} if chosen is not None else {}
            if len(set(labels.values())) == 2 or len(labels) < 2:
                break
        pool.unpersist()
        state.selection = selection
        if labels:
            human = self.spark.createDataFrame(list(labels.items()), T.StructType([self.table.schema[self.row_id], T.StructField("human", T.BooleanType())]))
            state.rows = B.annotate(state.rows.drop("annotated"), human, self.row_id)
        state.pi = self._selectivity(selection, labels)

    def _selectivity(self, selection: Selection, labels: dict) -> float:
        by = {s: [labels[i] for i, t, _ in selection.rows if t == s and i in labels] for s in selection.population}
        if set(by) == {"positive", "negative"}:
            return beta_selectivity(*[(selection.population[s], len(by[s]), sum(by[s])) for s in ("positive", "negative")])
        known = [x for v in by.values() for x in v]
        return sum(known) / len(known) if known else 0.5

    def materialise(self, state: QueryState) -> None:
        """Codes of text columns, features of labelled rows, ranking and trimming, then features of all rows."""
        state.rows = self._coded(state)
        labelled = self.extract(state.rows.filter("annotated"), state.features)
        names = [s.target for s in state.features]
        keep = [self.row_id, "label", *state.base, *names]
        held = labelled.select(*keep).orderBy(self.row_id).toPandas()
        weight = importances(_matrix(held, names), held["label"].to_numpy(int), names, self.config.random_seed) if len(held) and names else {}
        kept = rank_features(state.features, weight, max(self.config.b_se, len({semantic_feature(p).budget_key for p in state.query.semantics})))
        state.features = kept if self.config.enable_enrich else [s for s in kept if s.mandatory and self.config.enable_rewrite and not state.base] or kept[:0]
        state.rows = self.extract(state.rows, state.features).persist()
        strata = {i: s for i, s, _ in state.selection.rows}
        rates = {s: state.selection.population[s] / max(1, sum(t == s for t in strata.values())) for s in state.selection.population}
        raw = np.array([rates.get(strata.get(i), 1.0) for i in held[self.row_id]])
        held["weight"] = raw / raw.mean() if len(raw) else raw
        state.labelled = held

    def _coded(self, state: QueryState) -> DataFrame:
        """Text base columns get a numeric twin, from one dictionary over all rows of the query."""
        rows, base = state.rows, []
        for c in state.base:
            if isinstance(rows.schema[c].dataType, T.StringType):
                codes = label_codes(rows, c).select(F.col("value").alias("_value"), F.col("code").cast("double").alias(CODE + c))
                rows = rows.join(codes, F.coalesce(F.col(c), F.lit("")) == F.col("_value"), "left").drop("_value")
                base.append(CODE + c)
            else:
                base.append(c)
        state.base = base
        return rows

    def expand(self, state: QueryState, batch: int = 0) -> None:
        """Pseudo-labelled rows from the surest candidates."""
        if not self.config.enable_coreset_expansion or not len(state.labelled):
            return
        names = [*state.base, *[s.target for s in state.features]]
        rows = self.candidates_of(state, batch)
        conf = self._confidence(state, rows, names)
        scored = rows.withColumn("confidence", conf).select(self.row_id, "confidence", *names).persist()
        if batch == 0:
            picked = select_empirical(scored, self.row_id, state.pi)
        else:
            picked = select_incremental(scored, self.row_id, state.pi, *state.bounds)
        some = picked.orderBy(shuffle_key(self.config.random_seed, self.row_id), self.row_id).limit(self.most_pseudo).toPandas()
        r = picked.agg(F.min("confidence"), F.max("confidence")).first()
        if r[0] is not None:
            state.bounds = (r[0], r[1])
        scored.unpersist()
        if len(some):
            some = some.rename(columns={"pseudo_label": "label"}).assign(weight=1.0).drop(columns="confidence")
            state.pseudo = pd.concat([state.pseudo, some]) if len(state.pseudo) else some

    def _confidence(self, state: QueryState, rows: DataFrame, names: list[str]):
        y = state.labelled["label"].to_numpy(int)
        x = _matrix(state.labelled, names)
        forest = train(x, y, names, CONFIDENCE, balanced_weights(y, state.labelled["weight"].to_numpy(float)), self.config.random_seed)
        predicted = forest.column() if self.config.enable_conf_pred and names else None
        structural = None
        if self.config.enable_conf_struct and names:
            weight = importances(x, y, names, self.config.random_seed)
            scaled = rows.select(*[c.alias(n) for c, n in zip(weighted_features(weight, names), names, strict=True)])
            fit = moments(scaled, names)
            mean, dev = np.array([fit[n][0] for n in names]), np.array([fit[n][1] for n in names])
            points = (x * np.array([weight[n] for n in names]) - mean) / dev
            at = [(c - F.lit(float(m))) / F.lit(float(s)) for c, m, s in zip(weighted_features(weight, names), mean, dev, strict=True)]
            near = [class_distance(at, points[y == v].tolist(), self.config.k_neighbors) for v in (1, 0)]
            structural = structural_confidence(*near)
        return combined_confidence(state.pi, predicted, structural)

    # -- rewriting ------------------------------------------------------------------------------------------------

    def _coreset(self, state: QueryState) -> pd.DataFrame:
        return pd.concat([state.labelled, state.pseudo]) if len(state.pseudo) else state.labelled

    def rewrite(self, state: QueryState) -> None:
        """Evaluate all candidates on batch 0 and keep the one of least loss (the later of equals)."""
        ranked = [s.target for s in state.features]
        required = {semantic_feature(p).target for p in state.query.semantics} & set(ranked)
        options = candidates(ranked, least_prefix(ranked, required), state.base)
        grids = {str(i): list(c.features) for i, c in enumerate(options) if c.features}
        held, n_queries = state.labelled, len(self.queries)
        losses: dict[tuple[str, int], tuple[float, float]] = {}
        if len(held) > 1 and grids:
            names = sorted({f for g in grids.values() for f in g})
            numeric = pd.DataFrame(_matrix(held, names), columns=names).assign(label=held["label"].to_numpy(int))
            table = loo_grid(numeric, names, self.spark, n_queries, self.config.delta, self.config.loo_step, self.config.random_seed, grids)
            losses = {(r["candidate"], r["depth"]): (r["loss"], r["penalty"]) for r in table.collect()}
        # candidates don't depend on each other: their jobs run side by side
        with InheritableThreadPool(PARALLEL) as pool:
            state.attempts = pool.map(lambda ic: self._attempt(state, ic[1], [losses.get((str(ic[0]), d), (0.0, 0.0)) for d in (1, 2, 3)]), enumerate(options))
        state.best = best_candidate([a.loss(self.config) for a in state.attempts])

    def _attempt(self, state: QueryState, option: Candidate, grid: list[tuple[float, float]]) -> Attempt:
        began, names = time.time(), list(option.features)
        depth = choose_depth([a + b for a, b in grid], len(state.labelled), self.config.loo_step) + 1
        coreset = self._coreset(state)
        forest = train(_matrix(coreset, names), coreset["label"].to_numpy(int), names, ForestConfig(depth=depth), seed=self.config.random_seed) if len(coreset) and names else None
        rows = propagate(self.candidates_of(state).select(self.row_id, *names), forest).persist()
        held = state.labelled
        reference = (_matrix(held, names), held["label"].to_numpy(int), balanced_weights(held["label"].to_numpy(int), held["weight"].to_numpy(float))) if len(held) else None
        rules = extract_rules(rows, names, "propagated", self.config.b_rew, reference) if forest else [[]]
        judged = apply_rules(rows, rules)
        pairs = {(r["propagated"], r["predicted"]): r["count"] for r in judged.groupBy("propagated", "predicted").count().collect()}
        rows.unpersist()
        n = sum(pairs.values())
        loss = sum(c * weighted_loss(np.array([a]), np.array([b]), state.pi) for (a, b), c in pairs.items()) / n if n else 0.0
        penalty = objective_penalty(n + len(held), state.pi, self.config.b_rew, arity(rules), len(self.queries), self.config.delta)
        return Attempt(option, depth, forest, rules, *grid[depth - 1], loss, penalty, time.time() - began)

    def raw_rules(self, state: QueryState, rules: Rules | None = None) -> Rules:
        """Rules over the table's own columns: a bound on the code of a text is a bound on the text."""
        rules = state.rules if rules is None else rules
        wanted = {(f, int(np.floor(t))) for r in rules for f, t, _ in r if f.startswith(CODE)}
        values = {}
        for f, code in wanted:
            c = f.removeprefix(CODE)
            at = state.rows.filter(F.col(f) <= code).agg(F.max(F.coalesce(F.col(c), F.lit("")))).first()[0]
            values[f, code] = "" if at is None else at
        return [[(f.removeprefix(CODE), values[f, int(np.floor(t))], op) if f.startswith(CODE) else (f, t, op) for f, t, op in r] for r in rules]

    def evaluate(self, state: QueryState, batch: int | None = 0) -> None:
        rows = state.rows if batch is None else state.rows.filter(F.col("batch_id") == batch)
        guessed = propagate(rows, state.attempt.forest, "predicted")
        state.prediction = bucket_quality(guessed, list(state.query.selected))
        state.translation = bucket_quality(apply_rules(rows, state.rules), list(state.query.selected))

    def answer(self, name: str, state: QueryState, batch: int | None = None) -> DataFrame:
        """The query's answer: annotated true rows, and candidates that the rules accept."""
        rows = apply_rules(state.rows if batch is None else state.rows.filter(F.col("batch_id") == batch), state.rules)
        hit = (F.col("bucket") == B.SELECTED) | ((F.col("bucket") == B.CANDIDATE) & (F.col("predicted") == 1))
        return rows.filter(hit).select(*state.query.selected).distinct()

    def answer_over(self, table: DataFrame, state: QueryState) -> DataFrame:
        """The rules' answer over another table of the same columns: the static filter, the features that the rules read, and
        the rules. Nothing is learned, so the plan is one scan without any exchange but the final one."""
        rules = self.raw_rules(state)
        read = {f for r in rules for f, _, _ in r}
        rows = self.extract(B.initialise(table, state.query, state.name), [s for s in state.features if s.target in read])
        return apply_rules(rows, rules).filter("predicted = 1").select(*state.query.selected).distinct()

    def certify(self, state: QueryState, ratio: float = 0.7) -> None:
        """Learn again from a part of the annotations, and bound the final rules' errors by the rest."""
        held = state.labelled
        n_train = int(ratio * len(held) + 0.5)
        order = sorted(range(len(held)), key=lambda i: _digest(self.config.random_seed, held[self.row_id].iloc[i]))
        part, rest = held.iloc[sorted(order[:n_train])], held.iloc[sorted(order[n_train:])]
        probe = replace(state, labelled=part, pseudo=pd.DataFrame(), attempts=[])
        option = state.attempt.candidate
        if len(part):
            self.expand(probe)
            attempt = self._attempt(probe, option, [(0.0, 0.0)] * 3 if state.attempt.depth == 1 else [(9.9, 0.0)] * (state.attempt.depth - 1) + [(0.0, 0.0)] * (4 - state.attempt.depth))
            probe_rules = attempt.rules
        else:
            probe_rules = state.rules
        rows = apply_rules(apply_rules(self.candidates_of(state), state.rules, "final"), probe_rules, "probe")
        r = rows.agg(F.count("*").alias("n"), F.count_if(F.col("final") != F.col("probe")).alias("d")).first()
        names = list(option.features)
        wrong = lambda pdf: int((_applied(probe_rules, pdf, names) != pdf["label"].to_numpy(int)).sum()) if len(pdf) else 0
        state.certificate = certificate(r["n"] + len(held), r["d"], len(part), wrong(part), len(rest), wrong(rest), self.config.delta, len(self.queries))
        state.f1_bound = f1_bound(state.certificate.bound, state.pi)

    # -- whole runs -----------------------------------------------------------------------------------------------

    def run_query(self, name: str, batched: DataFrame, with_certificate: bool = False) -> QueryState:
        began = time.time()
        state = self.start(name, batched)
        self.propose(state)
        self._timed("prepare", began)
        for phase in ("annotate", "materialise", "expand", "rewrite", "evaluate"):
            began = time.time()
            getattr(self, phase)(state)
            self._timed(phase, began)
        if with_certificate:
            began = time.time()
            self.certify(state)
            self._timed("certify", began)
        return state

    def without_rewrite(self, name: str) -> DataFrame:
        """The backend decides every row from its serialised columns; nothing is learned."""
        query = self.queries[name]
        rows = B.initialise(self.table, query, name)
        inputs = self.roles.features(self.table.columns) + [p.field for p in query.semantics]
        line = serialised(list(dict.fromkeys(inputs)))
        for p in query.semantics:
            spec = replace(semantic_feature(p), source="_line", modality=Modality.TEXT)
            rows = self.backend.extract(rows.withColumn("_line", line), [spec]).filter(F.col(spec.target)).drop("_line")
        return rows.select(*query.selected).distinct()

    def run(self, with_certificate: bool = False) -> dict[str, QueryState]:
        """All queries; then, with several batches, their updates."""
        batched = self.partition().persist()
        held = self._held_certificates() if with_certificate else None
        states = {n: self.run_query(n, batched, with_certificate and held is None) for n in self.queries}
        for n, s in states.items() if held else ():
            s.certificate = Certificate(**held[n])
            s.f1_bound = f1_bound(s.certificate.bound, s.pi)
        if with_certificate and held is None and self.store:
            self.store.put(self._certificate_key(), {n: vars(s.certificate) for n, s in states.items()})
        if len(self.config.dynamic_setting) > 1:
            from ..streaming.incremental import run_rounds

            began = time.time()
            for state in states.values():
                run_rounds(self, state)
            self._timed("incremental", began)
        return states

    def _certificate_key(self) -> str:
        """All that certificates depend on: queries, settings, backend and the rows' ids."""
        return f"certificate|{self.backend.name}|{sorted((n, repr(q)) for n, q in self.queries.items())}|{self.config}|{table_fingerprint(self.table, [self.row_id])}"

    def _held_certificates(self) -> dict[str, dict] | None:
        return self.store.get(self._certificate_key(), lambda v: set(v) == set(self.queries)) if self.store else None

    def trace(self, states: dict[str, QueryState]) -> list[dict[str, Any]]:
        return [row for s in states.values() for row in s.trace(self.config)]


def all_hold(specs: list[FeatureSpec]) -> Column:
    """Do all Boolean features of a row hold? A missing one doesn't."""
    out = F.lit(True)
    for s in specs:
        out = out & F.coalesce(F.col(s.target), F.lit(False))
    return out


def _predicate_key(p: SemPredicate) -> tuple[str, str, str]:
    return p.field, p.modality.value, normal_prompt(p.prompt or p.condition)


def _matrix(held: pd.DataFrame, names: list[str]) -> np.ndarray:
    if not len(held) or not names:
        return np.zeros((len(held), len(names)))
    return held[names].astype(float).fillna(0.0).to_numpy()


def _applied(rules: Rules, held: pd.DataFrame, names: list[str]) -> np.ndarray:
    from ..operators.rewrite import rules_mask

    return rules_mask(rules, _matrix(held, names), names).astype(int)


def _digest(seed: int, row_id: Any) -> str:
    import hashlib

    return hashlib.md5(f"{seed}:{row_id}".encode()).hexdigest()


