"""Texts of the questions that an endpoint is asked about queries, features and rules. Each asks for JSON with ``value``."""

from __future__ import annotations

from ..model import FeatureSpec, SemCQ, SemPredicate


def wanted(query: SemCQ) -> str:
    """A query as text."""
    static = " and ".join(map(str, query.sigma)) or "no plain condition"
    return f"rows with {static}, of which holds: " + "; ".join(f"{p.condition} (column {p.field!r})" for p in query.semantics)


def proposal(p: SemPredicate, columns: list[str], budget: int) -> str:
    return (
        f"A table column {p.field!r} is to be searched for: {p.condition}. Columns there already: {', '.join(columns)}. Propose up to {budget} short features of one value "
        'that help to decide this, as JSON: {"value": [{"name": ..., "question": ..., "type": "bool"|"int"|"float"}]}. Names are identifiers.'
    )


def _listed(specs: list[FeatureSpec]) -> str:
    return "\n".join(f"- {s.target} ({s.kind.value}): {s.prompt}" for s in specs)


def audit(p: SemPredicate, specs: list[FeatureSpec]) -> str:
    return (
        f"Features proposed to decide whether holds: {p.condition}.\n{_listed(specs)}\nAudit them: which can be read off column {p.field!r} alone, have one value of their type, "
        'and bear on the condition? Give the names to keep as JSON: {"value": [...]}.'
    )


def redundancy(specs: list[FeatureSpec]) -> str:
    return f"Features of one column:\n{_listed(specs)}\n" 'Which are redundant, as another one in the list says the same? Give the names to leave out as JSON: {"value": [...]}.'


def relevant(query: SemCQ, profile: str) -> str:
    conditions = "\n".join(f"{i}: {p.condition}" for i, p in enumerate(query.semantics))
    return f"Table:\n{profile}\n\nConditions:\n{conditions}\n" 'Group the relevant columns: which columns bear on which condition? JSON: {"value": {"0": ["column", ...], ...}}.'


def prefilter(query: SemCQ, profile: str, groups: dict[str, list[str]]) -> str:
    named = [f"{query.semantics[int(k)].condition}: {', '.join(v)}" for k, v in groups.items() if v and k.isdigit() and int(k) < len(query.semantics)]
    hint = "Relevant columns:\n" + "\n".join(named) + "\n" if named else ""
    return (
        f"Table:\n{profile}\n\n{hint}Rows wanted: {'; '.join(p.condition for p in query.semantics)}. Give conditions that every wanted row certainly "
        'meets, as JSON: {"value": [{"fields": [...], "op": "==", "values": [...]}]}; an empty list if there is none.'
    )


def relation(new: SemCQ, first: SemCQ) -> str:
    return (
        f"First query: {wanted(first)}.\nSecond query: {wanted(new)}.\nHow do they relate? same: they ask for the same rows in other words. contained: every row of the second one "
        'is a row of the first. neither: anything else, also in doubt. JSON: {"value": "same"|"contained"|"neither"}.'
    )


def support(query: SemCQ, columns: list[str]) -> str:
    return f"Query: {wanted(query)}.\nColumns with values: {', '.join(columns)}.\n" 'Can these columns alone decide the query, without reading texts or images? JSON: {"value": true|false}.'


def rules(query: SemCQ, columns: list[str]) -> str:
    return (
        f"Query: {wanted(query)}.\nColumns with values: {', '.join(columns)}. Booleans count as 0 and 1.\nGive rules that decide the query: a row is wanted if all conditions of some rule hold. "
        'JSON: {"value": [[{"feature": "column", "op": ">"|"<=", "threshold": number}, ...], ...]}.'
    )
