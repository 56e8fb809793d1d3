"""A corpus pipeline of five stages; each works on all that the one before has kept and written.

Toxic documents go, of equal texts one stays, of near copies one stays, sources are mixed to their target weights
(a document may come once or twice), and what is left is packed into length buckets and batches.

Defined cases: a null text is scored, compared and packed like an empty one, and the mix takes no document without words;
a null doc_id has no label and stays in near-dedup; of repeated rows one stays; a null source is a source of its own;
an empty table goes through all stages and stays empty. Extra columns go along, whatever their names, but for the
prefixes ``_t_``, ``_dd_``, ``_s_``, ``_m_`` and ``_p_``, which are reserved.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lucerna.llm.common import discard, documents, materialise, only
from lucerna.llm.exact_dedup import exact_dedup
from lucerna.llm.mixing import mix_documents
from lucerna.llm.packing import pack
from lucerna.llm.simhash import near_dedup
from lucerna.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier (fitted on the labelled ones among them) calls toxic go."""
    return drop_toxic(docs, documents(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space, the one with the least doc_id stays."""
    return exact_dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies within three bits, and all of a similarity of 0.8 or more over five-word shingles."""
    return near_dedup(docs, every=True)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: whole documents, each at most twice."""
    return mix_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Length buckets of least padding, and batches of a token budget in each; adds n_tokens, bucket, batch and more."""
    return pack(docs)


STAGES = [("toxicity", toxicity), ("exact dedup", exact), ("SimHash near-dedup", near), ("mixing", mixing), ("packing", packing)]

#: The stages learn a model and iterate; SQL can't express them. Tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages. What a stage has written for itself goes once its result is there, and so does the result before."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        with only(spark) as kept:
            last, docs = docs, materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
            kept.append(docs)
        discard(last)
    return docs
