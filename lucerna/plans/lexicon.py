"""Semantic predicates over the ``documents`` table, and the lexical backend that answers them offline.

Patterns are restricted to what both Java and RE2 accept, so that Spark and plain SQL read the same expressions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import FeatureSpec, Kind, Modality, Predicate, SemCQ, SemPredicate
from ..sources.backends import LexicalBackend

# Words of insult, and signs of machine junk.
INSULTS = "trash|clown|scum|idiot|worthless|moron|pathetic|loser|disgusting|stupid"
JUNK = r"!|[#*%|]{2}"

TOXIC = SemPredicate("text", Modality.TEXT, "The document is toxic", "Is this document toxic?")
JUNKY = SemPredicate("text", Modality.TEXT, "The document is of low quality", "Is this document of low quality?")
BOTH = (TOXIC, JUNKY)


def matches(pattern: str):
    return lambda c: F.lower(c).rlike(pattern)


def count_of(pattern: str):
    return lambda c: F.regexp_count(F.lower(c), F.lit(pattern))


def ratio_of(pattern: str):
    return lambda c: F.when(F.length(c) > 0, F.regexp_count(c, F.lit(pattern)) / F.length(c)).otherwise(F.lit(0.0))


DERIVED = {
    "n_insults": FeatureSpec("text", Modality.TEXT, "n_insults", "How many insults are in the text?", Kind.INT),
    "n_exclaims": FeatureSpec("text", Modality.TEXT, "n_exclaims", "How many exclamation marks are in the text?", Kind.INT),
    "symbol_share": FeatureSpec("text", Modality.TEXT, "symbol_share", "Which share of the characters are symbols?", Kind.FLOAT),
    "has_license": FeatureSpec("text", Modality.TEXT, "has_license", "Does the text speak of a license?", Kind.BOOL),
    "has_number": FeatureSpec("text", Modality.TEXT, "has_number", "Is there a long number in the text?", Kind.BOOL),
}


def backend() -> LexicalBackend:
    d = DERIVED
    return LexicalBackend(
        catalogue={
            TOXIC.prompt: matches(INSULTS), JUNKY.prompt: matches(JUNK),
            d["n_insults"].prompt: count_of(INSULTS), d["n_exclaims"].prompt: count_of("!"), d["symbol_share"].prompt: ratio_of(r"[#*$%&|<>]"),
            d["has_license"].prompt: matches("license|all rights reserved"), d["has_number"].prompt: matches("[0-9]{7}"),
        },
        related={TOXIC.prompt: [d["n_insults"], d["n_exclaims"], d["has_license"]], JUNKY.prompt: [d["symbol_share"], d["n_exclaims"], d["has_number"]]},
        implied={TOXIC.prompt: [[Predicate("n_chars", ">", 0)]], JUNKY.prompt: [[Predicate("n_chars", ">", 0)]]},
        same_as={"Does the document insult people?": TOXIC.prompt},
    )


def toxic_query(lang: str = "en") -> SemCQ:
    return SemCQ(("doc_id",), (Predicate("lang", "==", lang), Predicate("text", "!=", "")), (TOXIC,))


def toxic_again(lang: str = "en") -> SemCQ:
    """The same question in other words."""
    return SemCQ(("doc_id",), (Predicate("lang", "==", lang), Predicate("text", "!=", "")), (SemPredicate("text", Modality.TEXT, "The document insults people", "Does the document insult people?"),))


def junk_query() -> SemCQ:
    return SemCQ(("doc_id",), (Predicate("n_chars", ">", 0),), (JUNKY,))


def toxic_and_junk() -> SemCQ:
    return SemCQ(("doc_id",), (Predicate("text", "!=", ""),), BOTH)


def lexical_column(p: SemPredicate) -> Column:
    return backend().catalogue[p.prompt.strip().casefold()](F.coalesce(F.col(p.field), F.lit("")))
