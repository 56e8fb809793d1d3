"""Query model: static and semantic predicates, queries, feature specs, learned rules, roles and configuration."""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field, fields
from enum import Enum
from typing import Any

Scalar = bool | int | float | str

OPERATORS = (">", ">=", "<", "<=", "==", "!=")


class Modality(str, Enum):
    TEXT = "Text"
    IMAGE = "Image"
    VECTOR_TEXT = "VectorText"
    VECTOR_IMAGE = "VectorImage"

    @property
    def is_vector(self) -> bool:
        """A comma-separated list of items in one column."""
        return self in (Modality.VECTOR_TEXT, Modality.VECTOR_IMAGE)

    @property
    def is_text(self) -> bool:
        return self in (Modality.TEXT, Modality.VECTOR_TEXT)


class Kind(str, Enum):
    """Types that a feature can have; ``undefined`` parses but can't be materialised."""

    BOOL = "bool"
    INT = "int"
    FLOAT = "float"
    UNDEFINED = "undefined"

    @property
    def sql(self) -> str:
        try:
            return {Kind.BOOL: "boolean", Kind.INT: "bigint", Kind.FLOAT: "double"}[self]
        except KeyError:
            raise ValueError("a feature of undefined type can't be materialised") from None


@dataclass(frozen=True)
class Predicate:
    """``field op value`` over one column."""

    field: str
    op: str
    value: Scalar

    def __post_init__(self):
        if self.op not in OPERATORS:
            raise ValueError(f"unknown operator {self.op!r}")
        if not isinstance(self.value, (bool, int, float, str)):
            raise ValueError(f"unsupported value {self.value!r}")

    def __str__(self) -> str:
        return f"{self.field} {self.op} {self.value!r}"


#: OR of ANDs; no group, or any empty group, accepts every row.
Ucq = list[list[Predicate]]

#: One learned condition: (feature, threshold, "<=" or ">"); a text column has a text as threshold.
Condition = tuple[str, float | str, str]
#: OR of ANDs; no rule rejects every row, an empty rule accepts every row.
Rules = list[list[Condition]]


@dataclass(frozen=True)
class SemPredicate:
    """A predicate in natural language over one column."""

    field: str
    modality: Modality
    condition: str
    prompt: str = ""

    def __post_init__(self):
        object.__setattr__(self, "modality", Modality(self.modality))


@dataclass(frozen=True)
class SemCQ:
    """A semantic conjunctive query: projection, one static conjunction, semantic predicates joined by AND."""

    selected: tuple[str, ...]
    sigma: tuple[Predicate, ...] = ()
    semantics: tuple[SemPredicate, ...] = ()

    def __post_init__(self):
        for name in ("selected", "sigma", "semantics"):
            object.__setattr__(self, name, tuple(getattr(self, name)))
        if not self.selected:
            raise ValueError("a query selects at least one column")


@dataclass(frozen=True)
class FeatureSpec:
    """One derived feature: what to read, what to ask, what comes out."""

    source: str
    modality: Modality
    target: str
    prompt: str
    kind: Kind = Kind.BOOL

    def __post_init__(self):
        object.__setattr__(self, "modality", Modality(self.modality))
        object.__setattr__(self, "kind", Kind(self.kind))

    @property
    def mandatory(self) -> bool:
        return self.target.startswith(SEMANTIC_PREFIX)

    @property
    def key(self) -> tuple:
        """What makes two specs the same feature."""
        return (self.source, self.modality, self.target, normal_prompt(self.prompt), self.kind)

    @property
    def budget_key(self) -> tuple:
        """Specs with the same key share one place in the feature budget."""
        if self.mandatory:
            return ("semantic", self.source, normal_prompt(self.prompt), self.kind)
        return ("derived", self.source, self.target, self.kind)


#: Name prefix of the features that stand for semantic predicates.
SEMANTIC_PREFIX = "llm_label_semantic_"


def normal_prompt(prompt: str) -> str:
    """Prompts that differ in case and white space only are the same."""
    return re.sub(r"\s+", " ", prompt.strip()).casefold()


def semantic_feature(p: SemPredicate) -> FeatureSpec:
    """The mandatory Boolean feature of a semantic predicate, named by a digest of it."""
    text = normal_prompt(p.prompt or p.condition)
    digest = hashlib.sha1("\x1f".join((p.field, p.modality.value, text)).encode()).hexdigest()
    return FeatureSpec(p.field, p.modality, SEMANTIC_PREFIX + digest[:12], p.prompt or p.condition, Kind.BOOL)


@dataclass(frozen=True)
class TableRoles:
    """Roles of a table's columns; every other column is an external (materialised) feature."""

    base: tuple[str, ...] = ()
    ids: tuple[str, ...] = ()
    payload: tuple[str, ...] = ()

    def external(self, columns: list[str]) -> list[str]:
        """External columns, sorted by name."""
        return sorted(set(columns) - {*self.base, *self.ids, *self.payload} - {c for c in columns if c.startswith("_")})

    def features(self, columns: list[str]) -> list[str]:
        """Classifier inputs in their order: base as configured, then external by name."""
        return [c for c in self.base if c in columns] + self.external(columns)


@dataclass(frozen=True)
class Config:
    """Settings of a run. Keys and defaults are part of the interface."""

    random_seed: int = 42
    b_lab: int = 20
    b_se: int = 5
    b_rew: int = 5
    b_fs: int = 10
    k_neighbors: int = 5
    enable_hitl: bool = True
    enable_conf_struct: bool = True
    enable_conf_pred: bool = True
    enable_enrich: bool = True
    enable_rewrite: bool = True
    enable_subj: bool = True
    enable_obj: bool = True
    enable_coreset_expansion: bool = True
    loo_step: int = 1
    delta: float = 0.2
    dynamic_setting: tuple[float, ...] = field(default=(1.0,))

    #: Least values of the whole numbers. A rule budget of zero has no loss (its logarithm), so it is refused.
    LEAST = {"b_lab": 0, "b_se": 0, "b_rew": 1, "b_fs": 0, "k_neighbors": 1, "loo_step": 1}

    def __post_init__(self):
        for f in fields(self):
            value = getattr(self, f.name)
            if f.name == "dynamic_setting":
                steps = tuple(value)
                real = all(isinstance(s, (int, float)) and not isinstance(s, bool) and 0 < s <= 1 for s in steps)
                if not steps or not real or any(a >= b for a, b in zip(steps, steps[1:], strict=False)):
                    raise ValueError("dynamic_setting: steps in (0, 1], strictly rising")
                object.__setattr__(self, "dynamic_setting", steps)
            elif f.name == "delta":
                if isinstance(value, bool) or not isinstance(value, (int, float)) or not 0 < value < 1:
                    raise ValueError("delta: between 0 and 1")
            elif f.name.startswith("enable_"):
                if not isinstance(value, bool):
                    raise ValueError(f"{f.name}: true or false")
            elif isinstance(value, bool) or not isinstance(value, int) or value < self.LEAST.get(f.name, value):
                raise ValueError(f"{f.name}: a whole number of at least {self.LEAST.get(f.name, 'any')}")

    @classmethod
    def parse(cls, given: dict[str, Any]) -> Config:
        """All keys must be there, no other may be, and no value may be a mapping."""
        names = {f.name for f in fields(cls)}
        if set(given) != names:
            raise ValueError(f"missing keys {sorted(names - set(given))}, unknown keys {sorted(set(given) - names)}")
        return cls(**given)
