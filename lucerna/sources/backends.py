"""Semantic backends: what answers a feature's prompt for a value.

``LexicalBackend`` compiles registered conditions to native columns (deterministic, offline), ``ReplayBackend`` joins
recorded answers, and ``HttpBackend`` asks an OpenAI-compatible endpoint from the executors.
"""

from __future__ import annotations

import base64
import io
import json
import time
import urllib.error
import urllib.request
import uuid
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import items, map_items, reduce_items
from ..model import FeatureSpec, Kind, Modality, Rules, SemCQ, SemPredicate, Ucq, normal_prompt
from . import prompts


class SemanticBackend(ABC):
    """Extraction is required; proposals, prefilters and relations default to the safe answer: nothing."""

    name = "backend"
    #: Are answers free and the same when asked again? If not, the engine keeps them for the run at least.
    repeatable = True

    @abstractmethod
    def extract(self, df: DataFrame, specs: list[FeatureSpec]) -> DataFrame:
        """``df`` with one typed column for each spec."""

    def propose(self, predicate: SemPredicate, columns: list[str], budget: int) -> list[FeatureSpec]:
        """Derived features that may help to decide a predicate."""
        return []

    def prefilter(self, query: SemCQ, df: DataFrame) -> Ucq:
        """A union that every true row satisfies; no group: no filter."""
        return []

    def relate(self, new: SemCQ, first: SemCQ) -> str:
        """``same``, ``contained`` (the new answer is part of the first one) or ``neither``."""
        a, b = ({(p.field, normal_prompt(p.condition)) for p in q.semantics} for q in (new, first))
        return "same" if a == b else "contained" if a > b else "neither"

    def supports(self, query: SemCQ, columns: list[str]) -> bool:
        """Can the query be decided from these columns alone?"""
        return False

    def regenerate(self, query: SemCQ, columns: list[str]) -> Rules | None:
        """Rules for the query over materialised columns."""
        return None

    def usage(self) -> dict[str, float]:
        return {"calls": 0, "input_tokens": 0, "output_tokens": 0, "cost": 0.0}

    def reset_usage(self) -> None:
        """Start counting anew."""


@dataclass
class LexicalBackend(SemanticBackend):
    """Conditions as expressions. ``catalogue`` maps a prompt to a function from the source column to the value;
    ``related`` lists derived features to propose for it, ``implied`` the prefilter it allows."""

    catalogue: dict[str, Callable[[Column], Column]]
    related: dict[str, list[FeatureSpec]] = field(default_factory=dict)
    implied: dict[str, Ucq] = field(default_factory=dict)
    same_as: dict[str, str] = field(default_factory=dict)
    name: str = "lexical"

    def __post_init__(self):
        for table in ("catalogue", "related", "implied"):
            setattr(self, table, {normal_prompt(k): v for k, v in getattr(self, table).items()})
        self.same_as = {normal_prompt(k): normal_prompt(v) for k, v in self.same_as.items()}

    def _meaning(self, prompt: str) -> str:
        p = normal_prompt(prompt)
        return self.same_as.get(p, p)

    def extract(self, df: DataFrame, specs: list[FeatureSpec]) -> DataFrame:
        for s in specs:
            ask = self.catalogue.get(self._meaning(s.prompt))
            if ask is None:
                raise ValueError(f"no expression for the prompt {s.prompt!r}")
            if s.modality.is_vector:
                df = map_items(df, s.source, ask, s.kind, s.target)
            else:
                zero = F.lit(False) if s.kind is Kind.BOOL else F.lit(0)
                df = df.withColumn(s.target, F.coalesce(ask(F.coalesce(F.col(s.source), F.lit(""))), zero).cast(s.kind.sql))
        return df

    def propose(self, predicate: SemPredicate, columns: list[str], budget: int) -> list[FeatureSpec]:
        return self.related.get(self._meaning(predicate.prompt or predicate.condition), [])[:budget]

    def prefilter(self, query: SemCQ, df: DataFrame) -> Ucq:
        from ..functions.predicates import conjunction

        known = [self.implied[m] for p in query.semantics if (m := self._meaning(p.prompt or p.condition)) in self.implied]
        return conjunction(known) if known else []

    def _meanings(self, q: SemCQ) -> set[tuple[str, str]]:
        return {(p.field, self._meaning(p.prompt or p.condition)) for p in q.semantics}

    def relate(self, new: SemCQ, first: SemCQ) -> str:
        a, b = self._meanings(new), self._meanings(first)
        return "same" if a == b else "contained" if a > b else "neither"

    def supports(self, query: SemCQ, columns: list[str]) -> bool:
        return self.regenerate(query, columns) is not None

    def regenerate(self, query: SemCQ, columns: list[str]) -> Rules | None:
        from ..model import semantic_feature

        targets = [semantic_feature(SemPredicate(p.field, p.modality, p.condition, self._meaning(p.prompt or p.condition))).target for p in query.semantics]
        own = [semantic_feature(p).target for p in query.semantics]
        chosen = [o if o in columns else t for o, t in zip(own, targets, strict=True)]
        return [[(t, 0.5, ">") for t in chosen]] if chosen and all(t in columns for t in chosen) else None


@dataclass
class ReplayBackend(SemanticBackend):
    """Recorded answers: a table with the source value and a column for each target. A value without an answer is null."""

    recorded: DataFrame
    source: str
    name: str = "replay"

    def extract(self, df: DataFrame, specs: list[FeatureSpec]) -> DataFrame:
        answers = self.recorded.select(F.col(self.source).alias("_source"), *[F.col(s.target).cast(s.kind.sql).alias(s.target) for s in specs]).dropDuplicates(["_source"])
        return df.join(answers, F.col(specs[0].source).eqNullSafe(F.col("_source")), "left").drop("_source")


@dataclass(frozen=True)
class Endpoint:
    """An OpenAI-compatible server. Concurrency is shared out over the partitions that ask."""

    url: str
    model: str
    key: str = ""
    parallelism: int = 20
    timeout: float = 30.0
    retries: int = 3
    input_cost: float = 0.0  # for a million tokens
    output_cost: float = 0.0
    max_tokens: int = 16384
    seed: int = 42
    structured: bool = False  # hold answers to a JSON schema


def retry_wait(attempt: int) -> float:
    return float(min(2**attempt, 30))


def json_value(text: str) -> Any:
    """What an answer's JSON has under ``value`` (or all of it); fences and Python's Booleans are put right. ValueError
    without JSON."""
    body = text.strip().strip("`").removeprefix("json").strip()
    raw = body[body.index("{") : body.rindex("}") + 1]
    try:
        value: Any = json.loads(raw)
    except ValueError:
        value = json.loads(raw.replace("True", "true").replace("False", "false").replace("None", "null"))
    return value.get("value", value) if isinstance(value, dict) else value


def parse_answer(text: str, kind: Kind) -> bool | int | float:
    """A typed value from an answer: JSON with ``value``, or the bare value; true and false in any case."""
    try:
        value = json_value(text)
    except ValueError:
        value = text.strip().strip("`").removeprefix("json").strip()
    if kind is Kind.BOOL:
        word = str(value).strip().rstrip(".").lower()
        if word in ("true", "1", "yes"):
            return True
        if word in ("false", "0", "no"):
            return False
        raise ValueError(f"not a Boolean answer: {text!r}")
    return int(float(value)) if kind is Kind.INT else float(value)


def encoded_image(raw: bytes, small: int = 448 * 448, side: int = 640, quality: int = 85) -> str:
    """A data URL: images of few pixels as they are, larger ones as a JPEG that fits in a square of ``side``."""
    try:
        from PIL import Image
    except ImportError:  # without an image library the bytes go as they are
        return "data:image/jpeg;base64," + base64.b64encode(raw).decode()
    image = Image.open(io.BytesIO(raw))
    if image.width * image.height > small:
        image.thumbnail((side, side))
        out = io.BytesIO()
        image.convert("RGB").save(out, "JPEG", quality=quality)
        raw = out.getvalue()
    return "data:image/jpeg;base64," + base64.b64encode(raw).decode()


#: Items of a vector that one question about all of them shows, at most (the limit of the interface that is matched).
SHOWN_ITEMS = 5


def described(metadata: dict[str, Any] | None) -> str:
    """What is known of an item besides itself, as a line before it."""
    known = {k: v for k, v in (metadata or {}).items() if v not in (None, "")}
    return "About it: " + ", ".join(f"{k} = {v}" for k, v in known.items()) + "\n" if known else ""


def message(prompt: str, value: str | bytes | list, modality: Modality, metadata: dict[str, Any] | list[dict[str, Any]] | None = None) -> list[dict]:
    """The messages of one question: about a text or an image, or about a vector of these as a whole (its first
    ``SHOWN_ITEMS`` items), each after what is known of it."""
    form = "Answer with JSON only: {\"value\": ...}."
    values = value[:SHOWN_ITEMS] if isinstance(value, list) else [value]
    about = [described(m) for m in (metadata if isinstance(metadata, list) else [metadata] * len(values))][: len(values)]
    about += [""] * (len(values) - len(about))
    if modality.is_text:
        shown = "\n\n".join(f"{a}Text:\n{v}" for a, v in zip(about, values, strict=True))
        return [{"role": "system", "content": form}, {"role": "user", "content": f"{prompt}\n\n{shown}"}]
    parts: list[dict] = [{"type": "text", "text": prompt}]
    for a, v in zip(about, values, strict=True):
        parts += [{"type": "text", "text": a.strip()}] if a else []
        parts.append({"type": "image_url", "image_url": {"url": encoded_image(v)}})
    return [{"role": "system", "content": form}, {"role": "user", "content": parts}]


#: Schemas of the answers that come as structures, by what is asked for.
_TYPES = {Kind.BOOL: "boolean", Kind.INT: "integer", Kind.FLOAT: "number"}


def answer_schema(kind: Kind) -> dict:
    """The JSON schema of ``{"value": ...}`` for servers that hold answers to one."""
    return {"type": "json_schema", "json_schema": {"name": "answer", "strict": True, "schema": {"type": "object", "properties": {"value": {"type": _TYPES[kind]}}, "required": ["value"], "additionalProperties": False}}}


def ask_once(endpoint: Endpoint, messages: list[dict], form: dict | None = None) -> tuple[str, int, int]:
    """One call: (answer, input tokens, output tokens). ``form`` asks for an answer that keeps to a schema."""
    body = {"model": endpoint.model, "messages": messages, "temperature": 0.0, "top_p": 1.0, "max_tokens": endpoint.max_tokens, "seed": endpoint.seed}
    body |= {"response_format": form} if form else {}
    request = urllib.request.Request(endpoint.url.rstrip("/") + "/chat/completions", json.dumps(body).encode(), {"Content-Type": "application/json", "Authorization": f"Bearer {endpoint.key}"})
    with urllib.request.urlopen(request, timeout=endpoint.timeout) as reply:
        got = json.load(reply)
    usage = got.get("usage") or {}
    return got["choices"][0]["message"]["content"], int(usage.get("prompt_tokens", 0)), int(usage.get("completion_tokens", 0))


def ask(endpoint: Endpoint, messages: list[dict], kind: Kind, wait: Callable[[float], None] = time.sleep) -> tuple[Any, int, int]:
    """A typed answer, with retries; None when all fail."""
    tokens = [0, 0]
    for attempt in range(endpoint.retries + 1):
        try:
            text, n_in, n_out = ask_once(endpoint, messages, answer_schema(kind)) if endpoint.structured else ask_once(endpoint, messages)
            tokens = [tokens[0] + n_in, tokens[1] + n_out]
            return parse_answer(text, kind), *tokens
        except (urllib.error.URLError, TimeoutError, OSError, KeyError, ValueError):
            if attempt < endpoint.retries:
                wait(retry_wait(attempt))
    return None, *tokens


@dataclass
class HttpBackend(SemanticBackend):
    """Answers from an endpoint: distinct values only, a bounded pool of calls in each partition, usage as columns.

    ``parallelism`` calls of the endpoint are shared out over ``partitions`` tasks, both settings of the user. Calls are
    not repeatable, so answers are written to ``folder`` before they are used (the session's shared folder by default);
    with a feature cache they are also kept for later runs. A value that no call answers is null.
    """

    endpoint: Endpoint
    partitions: int = 4
    name: str = "http"
    folder: str | None = None
    repeatable = False
    _used: list[tuple[int, int, int]] = field(default_factory=list)

    def __post_init__(self):
        self.name = f"http:{self.endpoint.model}"

    def _answers(self, values: DataFrame, spec: FeatureSpec) -> DataFrame:
        endpoint, pool = self.endpoint, max(1, self.endpoint.parallelism // self.partitions)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            with ThreadPoolExecutor(pool) as threads:
                for batch in batches:
                    got = list(threads.map(lambda v: ask(endpoint, message(spec.prompt, v, spec.modality), spec.kind), batch["_value"]))
                    out = batch.assign(_answer=pd.Series([g[0] for g in got], dtype=object), _in=[g[1] for g in got], _out=[g[2] for g in got])
                    yield out[["_value", "_answer", "_in", "_out"]]

        kind = values.schema["_value"].dataType.simpleString()
        return values.repartition(self.partitions).mapInPandas(run, f"_value {kind}, _answer {spec.kind.sql}, _in long, _out long")

    def _kept(self, answers: DataFrame) -> DataFrame:
        """Written once, so that every use of the answers sees the same ones, even after executors were lost."""
        spark = answers.sparkSession
        root = self.folder or spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not root:
            return answers.persist()
        path = f"{root.rstrip('/')}/answers-{uuid.uuid4().hex}"
        answers.write.parquet(path)
        return spark.read.schema(answers.schema).parquet(path)

    def extract(self, df: DataFrame, specs: list[FeatureSpec]) -> DataFrame:
        for s in specs:
            source = items(F.col(s.source)) if s.modality.is_vector else F.col(s.source)
            values = df.select((F.explode(source) if s.modality.is_vector else source).alias("_value")).filter("_value is not null").distinct()
            answers = self._kept(self._answers(values, s))
            r = answers.agg(F.count("*"), F.sum("_in"), F.sum("_out")).first()
            self._used.append((r[0], r[1] or 0, r[2] or 0))
            if not s.modality.is_vector:
                joined = df.join(answers.select("_value", F.col("_answer").alias(s.target)), F.col(s.source) == F.col("_value"), "left")
                df = joined.drop("_value")
                continue
            # a row's answers are those of its vector: they are joined by the vector, not by a row number
            each = df.select(F.col(s.source).alias("_vector")).distinct().select("_vector", F.explode(items(F.col("_vector"))).alias("_value"))
            summed = each.join(answers.select("_value", "_answer"), "_value").groupBy("_vector").agg(F.collect_list("_answer").alias("_answers"))
            value = reduce_items(F.coalesce("_answers", F.array().cast(f"array<{s.kind.sql}>")), s.kind)
            df = df.join(summed, F.col(s.source) == F.col("_vector"), "left").withColumn(s.target, value.cast(s.kind.sql)).drop("_vector", "_answers")
        return df

    def _told(self, text: str) -> Any:
        """The JSON value of a call's answer; None if there is none."""
        try:
            answer, n_in, n_out = ask_once(self.endpoint, [{"role": "user", "content": text}])
            self._used.append((1, n_in, n_out))
            return json_value(answer)
        except (urllib.error.URLError, OSError, KeyError, ValueError, TypeError):
            return None

    def propose(self, predicate: SemPredicate, columns: list[str], budget: int) -> list[FeatureSpec]:
        """Three calls: proposals, an audit of each of them, and a review of what says the same twice."""
        if budget <= 0:
            return []
        listed = self._told(prompts.proposal(predicate, columns, budget))
        specs = [s for s in map(lambda x: _spec(predicate, x), listed if isinstance(listed, list) else []) if s]
        if specs:
            kept = self._told(prompts.audit(predicate, specs))
            specs = [s for s in specs if s.target in kept] if isinstance(kept, list) else specs
        if len(specs) > 1:
            twice = self._told(prompts.redundancy(specs))
            specs = [s for s in specs if s.target not in twice] if isinstance(twice, list) else specs
        return specs[:budget]

    def prefilter(self, query: SemCQ, df: DataFrame) -> Ucq:
        """Two calls: which columns bear on which condition, and conditions over those that every wanted row meets."""
        from ..functions.predicates import expand, known_groups
        from ..operators.profile import schema_text

        profile = schema_text(df)
        relevant = self._told(prompts.relevant(query, profile))
        groups = {str(k): [c for c in v if c in df.columns] for k, v in relevant.items() if isinstance(v, list)} if isinstance(relevant, dict) else {}
        listed = self._told(prompts.prefilter(query, profile, groups))
        try:
            return known_groups([g for x in listed or [] for g in expand(*checked(x))], df.columns)
        except (KeyError, TypeError, ValueError):
            return []

    def relate(self, new: SemCQ, first: SemCQ) -> str:
        """The endpoint's view of two queries; queries of the same text need no call, and without an answer they are apart."""
        if super().relate(new, first) == "same" and set(new.sigma) == set(first.sigma):
            return "same"
        found = self._told(prompts.relation(new, first))
        return found if found in ("same", "contained", "neither") else "neither"

    def supports(self, query: SemCQ, columns: list[str]) -> bool:
        return self._told(prompts.support(query, columns)) is True

    def regenerate(self, query: SemCQ, columns: list[str]) -> Rules | None:
        """Rules of the endpoint over the columns; None unless every condition is (known column, number, <= or >)."""
        listed = self._told(prompts.rules(query, columns))
        try:
            made = [[(c["feature"], float(c["threshold"]), c["op"]) for c in rule] for rule in listed]
        except (KeyError, TypeError, ValueError):
            return None
        good = made and all(r and all(f in columns and op in ("<=", ">") for f, _, op in r) for r in made)
        return made if good else None

    def usage(self) -> dict[str, float]:
        calls, n_in, n_out = (sum(u[i] for u in self._used) for i in range(3))
        return {"calls": calls, "input_tokens": n_in, "output_tokens": n_out, "cost": (n_in * self.endpoint.input_cost + n_out * self.endpoint.output_cost) / 1e6}

    def reset_usage(self) -> None:
        self._used.clear()


def _spec(predicate: SemPredicate, given: Any) -> FeatureSpec | None:
    """A feature from a proposal (a mapping, or one written as text); None where it has no name, question or known type."""
    try:
        x = json_value(given) if isinstance(given, str) else given
        return FeatureSpec(predicate.field, predicate.modality, x["name"], x["question"], Kind(x["type"]))
    except (KeyError, TypeError, ValueError):
        return None


def checked(given: dict[str, Any]) -> tuple[list[str], str, list[Any]]:
    """A condition's fields, operator and values: fields must not be empty, and only == and != take several values."""
    fields, op, values = list(given["fields"]), given["op"], list(given["values"])
    if not fields or not values or (len(values) > 1 and op not in ("==", "!=")):
        raise ValueError(f"not a condition: {given!r}")
    return fields, op, values


def conservative(prompt: str) -> str:
    """A prompt for cheap proxy labels: in doubt, false."""
    return f"{prompt}\nAnswer true only where the text says so plainly; in doubt answer false."
