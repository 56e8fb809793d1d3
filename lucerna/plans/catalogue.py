"""Queries over the test tables, one or more for each operator of the engine, and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.predicates import apply_rules, expand, retrieve, ucq
from ..functions.text import as_bool, items, map_items, one_line, serialised
from ..model import Config, Kind, Predicate, TableRoles, semantic_feature
from ..operators import buckets as B
from ..operators.batches import ladder, sample, shuffle_key, with_batches
from ..operators.builders import concat_distinct, filled_quota, left_chain, pattern_argmax, quota_sample, top_groups
from ..operators.certify import f1_bound_column, most_errors, reoptimisation_threshold, smoothed, updated_certificate
from ..operators.confidence import class_distance, combined_confidence, confidence_ranks, select_empirical, select_incremental, structural_confidence
from ..operators.features import row_hash
from ..operators.forest import ForestConfig, loo_grid, train
from ..operators.profile import categorical_profile, encoded, numeric_profile, standardised
from ..operators.quality import quality_table, symmetric_difference, union_view
from ..operators.rewrite import extract_rules
from ..operators.sampling import stratified_table
from ..operators.weights import class_balanced, sampling_weights, selectivity_table, weighted_loss_column
from ..streaming.incremental import run_rounds
from .drift import View, answer_by_rules
from .engine import Engine
from .lexicon import DERIVED, INSULTS, JUNK, JUNKY, TOXIC, backend, junk_query, lexical_column, toxic_again, toxic_and_junk, toxic_query

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
SEED = 42


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their labels."""
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")


# -- predicates ---------------------------------------------------------------------------------------------------

_SIX = [(">", 150000.0), (">=", 150000.0), ("<", 50000.0), ("<=", 50000.0), ("==", "F"), ("!=", "F")]


@query(
    """
SELECT count(*) FILTER (WHERE o_totalprice > 150000) AS gt, count(*) FILTER (WHERE o_totalprice >= 150000) AS ge,
       count(*) FILTER (WHERE o_totalprice < 50000) AS lt, count(*) FILTER (WHERE o_totalprice <= 50000) AS le,
       count(*) FILTER (WHERE o_orderstatus = 'F') AS eq, count(*) FILTER (WHERE coalesce(o_orderstatus, '') <> 'F') AS ne,
       count(*) FILTER (WHERE o_totalprice IS NOT NULL) AS present
FROM orders"""
)
def f_predicates_six(spark, sf_dir):
    df = table(spark, sf_dir, "orders")
    names = ("gt", "ge", "lt", "le", "eq", "ne")
    tests = [Predicate("o_orderstatus" if isinstance(v, str) else "o_totalprice", op, v) for op, v in _SIX]
    counts = [F.count_if(ucq([[p]], df.schema)).alias(n) for p, n in zip(tests, names, strict=True)]
    return df.agg(*counts, F.count_if(ucq([[Predicate("o_totalprice", "!=", "")]], df.schema)).alias("present"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_quantity > 45 AND l_returnflag = 'R') OR (l_discount <= 0.01 AND l_linestatus <> 'F')")
def f_ucq(spark, sf_dir):
    groups = [[Predicate("l_quantity", ">", 45), Predicate("l_returnflag", "==", "R")], [Predicate("l_discount", "<=", 0.01), Predicate("l_linestatus", "!=", "F")]]
    return retrieve(table(spark, sf_dir, "lineitem"), groups).select("l_orderkey", "l_linenumber")


@query("SELECT n_nationkey, n_name FROM nation")
def f_ucq_empty(spark, sf_dir):
    df = table(spark, sf_dir, "nation")
    return retrieve(retrieve(df, []), [[Predicate("n_name", "==", "x")], []]).select("n_nationkey", "n_name")


@query("SELECT p_partkey FROM part WHERE (p_size IN (1, 5, 9) OR p_size IN (1, 5, 9)) AND p_brand NOT IN ('Brand#11', 'Brand#23')")
def f_dnf_expand(spark, sf_dir):
    df = retrieve(table(spark, sf_dir, "part"), expand(["p_size"], "==", [1, 5, 9]))
    return retrieve(df, expand(["p_brand"], "!=", ["Brand#11", "Brand#23"])).select("p_partkey")


_RULES = [[("l_quantity", 10.5, ">"), ("l_quantity", 20.5, "<=")], [("l_discount", 0.085, ">")]]


@query(
    """
SELECT l_linestatus, sum(CASE WHEN (l_quantity > 10.5 AND l_quantity <= 20.5) OR l_discount > 0.085 THEN 1 ELSE 0 END)::BIGINT AS accepted, count(*) AS n
FROM lineitem GROUP BY l_linestatus"""
)
def f_rules_apply(spark, sf_dir):
    out = apply_rules(table(spark, sf_dir, "lineitem"), _RULES)
    return out.groupBy("l_linestatus").agg(F.sum("predicted").alias("accepted"), F.count("*").alias("n"))


@query(
    f"""
SELECT bucket, count(*) AS n, sum(toxic)::BIGINT AS true_rows FROM (
  SELECT toxic, CASE WHEN regexp_matches(lower(text), '{INSULTS}') OR n_chars > 2000 THEN 'candidate' ELSE 'discarded' END AS bucket
  FROM documents JOIN labels USING (doc_id) WHERE lang = 'en' AND text <> '')
GROUP BY bucket"""
)
def f_refine_buckets(spark, sf_dir):
    rows = B.initialise(labelled(spark, sf_dir), toxic_query(), "toxic").withColumn("insult", lexical_column(TOXIC))
    rows = B.refine(rows, [[Predicate("insult", "==", True)], [Predicate("n_chars", ">", 2000)]])
    return rows.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("toxic").alias("true_rows"))


@query(
    """
WITH t AS (SELECT *, CASE WHEN value > 50 THEN 1 ELSE 0 END AS label, (epoch_ms(ts) // 86400000)::BIGINT AS batch_id FROM events WHERE event_type <> 'error'),
e AS (SELECT batch_id, count(*) AS n, sum(label) AS t FROM t GROUP BY batch_id)
SELECT batch_id, sum(n) OVER (ORDER BY batch_id)::BIGINT AS candidates, round(sum(t) OVER (ORDER BY batch_id) / sum(n) OVER (ORDER BY batch_id), 9) AS selectivity FROM e"""
)
def a_accumulated_selectivity(spark, sf_dir):
    df = table(spark, sf_dir, "events").withColumn("bucket", F.when(F.col("event_type") == "error", B.DISCARDED).otherwise(B.CANDIDATE))
    day = F.floor(F.unix_millis(F.col("ts").cast("timestamp")) / 86400000)
    rows = df.withColumn("label", F.col("value") > 50).withColumn("batch_id", day)
    return B.accumulated_selectivity(rows).filter("candidates > 0").withColumn("selectivity", F.round("selectivity", 9))


@query("SELECT doc_id, coalesce(CASE lower(trim(CAST(toxic AS VARCHAR))) WHEN '1' THEN TRUE WHEN '0' THEN FALSE END, FALSE) AS toxic FROM labels")
def f_bool_coercion(spark, sf_dir):
    return table(spark, sf_dir, "labels").select("doc_id", as_bool(F.col("toxic"), "toxic").alias("toxic"))



# -- projections --------------------------------------------------------------------------------------------------


@query("SELECT c_acctbal, c_mktsegment, c_custkey * 2 AS doubled FROM customer")
def p_active_features(spark, sf_dir):
    df = table(spark, sf_dir, "customer").withColumn("doubled", F.col("c_custkey") * 2)
    roles = TableRoles(base=("c_mktsegment", "c_acctbal"), ids=("c_custkey", "c_nationkey"), payload=("c_name",))
    return df.select(*roles.features(df.columns))


@query("SELECT n_nationkey, 'n_name: ' || n_name || ', n_regionkey: ' || CAST(n_regionkey AS VARCHAR) AS line FROM nation")
def m_row_serialize(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", serialised(["n_name", "n_regionkey"]).alias("line"))


@query("SELECT page_id, translate(html, chr(10) || chr(13), '  ') AS line, substring(url, 22) AS path FROM pages")
def p_text_cleanup(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", one_line(F.col("html")).alias("line"), F.substring("url", 22, 2**31 - 1).alias("path"))


# -- semantic map -------------------------------------------------------------------------------------------------


@query("SELECT p_partkey, len(list_filter(string_split(replace(p_name, ' ', ','), ','), lambda x: x LIKE 'g%' OR x LIKE '%e')) > 0 AS hit FROM part")
def m_vector_bool_or(spark, sf_dir):
    df = table(spark, sf_dir, "part").withColumn("words", F.replace("p_name", F.lit(" "), F.lit(",")))
    return map_items(df, "words", lambda x: x.startswith("g") | x.endswith("e"), Kind.BOOL, "hit").select("p_partkey", "hit")


@query("SELECT p_partkey, length(replace(p_name, ' ', ''))::BIGINT AS letters, len(string_split(p_name, ' '))::INTEGER AS n_items FROM part")
def m_vector_int_sum(spark, sf_dir):
    df = table(spark, sf_dir, "part").withColumn("words", F.replace("p_name", F.lit(" "), F.lit(" , ,")))
    return map_items(df, "words", F.length, Kind.INT, "letters").select("p_partkey", "letters", F.size(items(F.col("words"))).alias("n_items"))


@query(
    f"""
SELECT doc_id, regexp_matches(lower(text), '{INSULTS}') AS toxic, len(regexp_extract_all(lower(text), '{INSULTS}'))::BIGINT AS n_insults,
       len(regexp_extract_all(text, '!'))::BIGINT AS n_exclaims, round(len(regexp_extract_all(text, '[#*$%&|<>]')) / length(text), 9) AS symbol_share
FROM documents"""
)
def m_lexical_features(spark, sf_dir):
    specs = [semantic_feature(TOXIC), *(DERIVED[d] for d in ("n_insults", "n_exclaims", "symbol_share"))]
    out = backend().extract(table(spark, sf_dir, "documents"), specs)
    return out.select("doc_id", F.col(specs[0].target).alias("toxic"), "n_insults", "n_exclaims", F.round("symbol_share", 9).alias("symbol_share"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def m_parse_struct(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


# -- joins --------------------------------------------------------------------------------------------------------


@query(
    """
SELECT o_orderkey, c_name, n_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey"""
)
def j_left_chain(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    nation = table(spark, sf_dir, "nation").withColumnRenamed("n_nationkey", "c_nationkey")
    out = left_chain(orders, (table(spark, sf_dir, "customer"), "c_custkey", "_customer"), (nation, "c_nationkey", "_nation"))
    return out.select("o_orderkey", "c_name", "n_name")


@query("SELECT doc_id, EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND toxic = 1) AS label FROM documents d")
def j_label_semijoin(spark, sf_dir):
    docs, truth = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").filter("toxic = 1")
    return B.with_truth(docs, truth, ["doc_id"]).select("doc_id", "label")



def _annotated_vectors(spark, sf_dir, n=24):
    """A seeded annotation sample of the vectors: (points of label 3 and below, points above)."""
    rows = sample(table(spark, sf_dir, "embeddings"), n, SEED, "vec_id").collect()
    return [r["embedding"] for r in rows if r["label"] <= 3], [r["embedding"] for r in rows if r["label"] > 3]


_KNN = """
WITH s AS (SELECT vec_id, embedding, label <= 3 AS pos FROM embeddings ORDER BY md5('42:' || vec_id), vec_id LIMIT 24),
d AS (SELECT e.vec_id, s.pos, sqrt(list_sum(list_transform(range(1, len(e.embedding) + 1), lambda i: (e.embedding[i]::DOUBLE - s.embedding[i]::DOUBLE) ^ 2))) AS dist
      FROM embeddings e CROSS JOIN s),
k AS (SELECT *, row_number() OVER (PARTITION BY vec_id, pos ORDER BY dist) AS r FROM d),
m AS (SELECT vec_id, avg(dist) FILTER (WHERE pos) AS dp, avg(dist) FILTER (WHERE NOT pos) AS dn FROM k WHERE r <= 5 GROUP BY vec_id)"""


@query(_KNN + " SELECT vec_id, round(dp, 6) AS d_positive, round(dn, 6) AS d_negative, round((1 / (dp + 1e-6)) / (1 / (dp + 1e-6) + 1 / (dn + 1e-6)), 6) AS confidence FROM m")
def j_knn_class_mean(spark, sf_dir):
    df = table(spark, sf_dir, "embeddings")
    positive, negative = _annotated_vectors(spark, sf_dir)
    width = len(positive[0])
    at = [F.get("embedding", i) for i in range(width)]
    near = df.select("vec_id", class_distance(at, positive, 5).alias("dp"), class_distance(at, negative, 5).alias("dn"))
    return near.select("vec_id", F.round("dp", 6).alias("d_positive"), F.round("dn", 6).alias("d_negative"), F.round(structural_confidence(F.col("dp"), F.col("dn")), 6).alias("confidence"))


# -- aggregates ---------------------------------------------------------------------------------------------------


@query("SELECT s_nationkey, string_agg(DISTINCT CAST(s_acctbal > 0 AS VARCHAR), ',' ORDER BY CAST(s_acctbal > 0 AS VARCHAR)) AS solvent FROM supplier GROUP BY s_nationkey")
def a_group_concat_distinct(spark, sf_dir):
    df = table(spark, sf_dir, "supplier").withColumn("solvent", (F.col("s_acctbal") > 0).cast("string"))
    return concat_distinct(df, ["s_nationkey"], ["solvent"])


@query("SELECT p_brand, string_agg(w, ',' ORDER BY first_key, w) AS words FROM (SELECT p_brand, split_part(p_name, ' ', 1) AS w, min(p_partkey) AS first_key FROM part GROUP BY ALL) GROUP BY p_brand")
def a_group_concat_first_seen(spark, sf_dir):
    df = table(spark, sf_dir, "part").withColumn("words", F.split_part("p_name", F.lit(" "), F.lit(1)))
    return concat_distinct(df, ["p_brand"], ["words"], "p_partkey")


@query("SELECT user_id, count(*) AS n FROM events GROUP BY user_id ORDER BY n DESC, user_id LIMIT 20")
def a_topn_count(spark, sf_dir):
    return top_groups(table(spark, sf_dir, "events"), "user_id", 20)


@query(
    """
WITH p AS (
  SELECT event_type, count(*) * count(DISTINCT props) AS score, 0 AS i FROM events WHERE contains(props, '5') GROUP BY event_type HAVING count(*) >= 50
  UNION ALL SELECT event_type, count(*) * count(DISTINCT props), 1 FROM events WHERE contains(props, '10') GROUP BY event_type HAVING count(*) >= 50)
SELECT event_type, score FROM p ORDER BY score DESC, i, event_type LIMIT 1"""
)
def a_pattern_argmax(spark, sf_dir):
    return pattern_argmax(table(spark, sf_dir, "events"), "event_type", "props", ("5", "10"))


@query(
    """
SELECT 'c_custkey' AS column_name, min(c_custkey)::DOUBLE AS min_value, max(c_custkey)::DOUBLE AS max_value FROM customer
UNION ALL SELECT 'c_nationkey', min(c_nationkey)::DOUBLE, max(c_nationkey)::DOUBLE FROM customer
UNION ALL SELECT 'c_acctbal', min(c_acctbal), max(c_acctbal) FROM customer"""
)
def a_profile_numeric(spark, sf_dir):
    return numeric_profile(table(spark, sf_dir, "customer"))


@query(
    """
WITH v AS (SELECT 'event_type' AS column_name, event_type AS value FROM events UNION ALL SELECT 'props', props FROM events),
c AS (SELECT column_name, value, count(*) AS n FROM v GROUP BY ALL),
d AS (SELECT column_name, count(value) AS n_distinct FROM c GROUP BY column_name),
r AS (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY n DESC, value) AS place FROM c)
SELECT column_name, value, n, n_distinct FROM r JOIN d USING (column_name) WHERE place <= 20"""
)
def a_profile_categorical(spark, sf_dir):
    return categorical_profile(table(spark, sf_dir, "events"), ["event_type", "props"])


@query(
    """
WITH n AS (SELECT count(*) AS n FROM events),
r AS (SELECT *, row_number() OVER (ORDER BY md5('42:' || event_id), event_id) AS p FROM events),
b AS (SELECT value > 50 AS label, CASE WHEN p <= floor(n * 0.6) THEN 0 WHEN p <= floor(n * 0.8) THEN 1 ELSE 2 END AS batch_id FROM r, n)
SELECT batch_id, count(*) AS n, round(avg(label::INT), 9) AS selectivity FROM b GROUP BY ROLLUP (batch_id)"""
)
def a_stream_stat(spark, sf_dir):
    rows = with_batches(table(spark, sf_dir, "events"), (0.6, 0.8, 1.0), SEED, "event_id").withColumn("label", F.col("value") > 50)
    return B.stream_statistics(rows).withColumn("selectivity", F.round("selectivity", 9))


_QUALITY = f"""
WITH x AS (SELECT doc_id, toxic = 1 AS t, regexp_matches(lower(text), '{INSULTS}') AS f FROM documents JOIN labels USING (doc_id)),
c AS (SELECT count(*) FILTER (WHERE t AND f) AS tp, count(*) FILTER (WHERE f AND NOT t) AS fp, count(*) FILTER (WHERE t AND NOT f) AS fn, count(*) AS omega FROM x)
SELECT tp, fp, fn, omega, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall, 2 * tp / (2 * tp + fp + fn) AS f1, (fp + fn) / omega AS err FROM c"""


@query(
    f"""
SELECT tp, fp, fn, omega, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, round(err, 9) AS err FROM ({_QUALITY})"""
)
def a_quality_sets(spark, sf_dir):
    df = labelled(spark, sf_dir)
    out = quality_table(df.filter("toxic = 1"), df.filter(lexical_column(TOXIC)), ["doc_id"], df.count())
    return out.select("tp", "fp", "fn", "omega", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1", "err")])


@query(
    f"""
SELECT lang, round(avg(CASE WHEN toxic = 1 AND g = 0 THEN 0.9 / 0.1 WHEN toxic = 0 AND g = 1 THEN 1.0 ELSE 0.0 END), 9) AS loss
FROM (SELECT lang, toxic, regexp_matches(lower(text), '{INSULTS}')::INT AS g FROM documents JOIN labels USING (doc_id)) GROUP BY lang"""
)
def a_weighted_loss(spark, sf_dir):
    df = labelled(spark, sf_dir).withColumn("g", lexical_column(TOXIC).cast("int"))
    return df.groupBy("lang").agg(F.round(F.avg(weighted_loss_column(F.col("toxic"), F.col("g"), 0.1)), 9).alias("loss"))


@query("SELECT doc_id, toxic, round(1.0 / (2 * count(*) OVER (PARTITION BY toxic)), 12) AS weight FROM labels")
def a_balanced_weights(spark, sf_dir):
    return class_balanced(table(spark, sf_dir, "labels"), "toxic").select("doc_id", "toxic", F.round("weight", 12).alias("weight"))


_SAMPLE = """
WITH g AS (SELECT doc_id, toxic = 1 AS stratum FROM labels),
c AS (SELECT count(*) FILTER (WHERE stratum) AS p, count(*) FILTER (WHERE NOT stratum) AS q FROM g),
r AS (SELECT g.*, row_number() OVER (PARTITION BY stratum ORDER BY md5('42:' || doc_id), doc_id) AS place FROM g),
a AS (SELECT least(10, p) + (20 - least(10, p)) - least(20 - least(10, p), q) AS take, p, q FROM c),
s AS (SELECT doc_id, stratum, CASE WHEN stratum THEN p ELSE q END AS population_size FROM r, a WHERE place <= CASE WHEN stratum THEN take ELSE 20 - take END)"""


@query(_SAMPLE + " SELECT doc_id, stratum, population_size FROM s")
def l_stratified_sample(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").withColumn("guess", F.col("toxic") == 1)
    return stratified_table(rows, "doc_id", "guess", 20, SEED)


@query(_SAMPLE + ", w AS (SELECT *, population_size / count(*) OVER (PARTITION BY stratum) AS raw FROM s) SELECT doc_id, round(raw / avg(raw) OVER (), 9) AS weight FROM w")
def a_sampling_weights(spark, sf_dir):
    chosen = l_stratified_sample(spark, sf_dir)
    return sampling_weights(chosen, "stratum", F.col("population_size")).select("doc_id", F.round("weight", 9).alias("weight"))


@query(
    _SAMPLE
    + """, e AS (SELECT s.stratum, max(population_size) AS pop, count(*) AS n, count(*) FILTER (WHERE quality = 0) AS t FROM s JOIN labels USING (doc_id) GROUP BY s.stratum)
SELECT round(sum(pop * (1 + t) / (2 + n)) / sum(pop), 9) AS selectivity FROM e"""
)
def a_selectivity_beta(spark, sf_dir):
    chosen = l_stratified_sample(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id").withColumn("label", F.col("quality") == 0)
    return selectivity_table(chosen).select(F.round("selectivity", 9).alias("selectivity"))


@query("SELECT c_custkey, round((c_acctbal - avg(c_acctbal) OVER ()) / stddev_pop(c_acctbal) OVER (), 6) AS c_acctbal FROM customer")
def a_standardize(spark, sf_dir):
    return standardised(table(spark, sf_dir, "customer"), ["c_acctbal"]).select("c_custkey", F.round("c_acctbal", 6).alias("c_acctbal"))


# -- windows, ranks, samples --------------------------------------------------------------------------------------


@query("SELECT doc_id, dense_rank() OVER (ORDER BY lang) - 1 AS lang, dense_rank() OVER (ORDER BY source) - 1 AS source FROM documents")
def w_label_encode(spark, sf_dir):
    return encoded(encoded(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "lang"), "source").select("doc_id", "lang", "source")


@query("SELECT doc_id FROM documents ORDER BY md5('42:' || doc_id), doc_id LIMIT 100")
def w_md5_sample(spark, sf_dir):
    return sample(table(spark, sf_dir, "documents"), 100, SEED, "doc_id").select("doc_id")


_SCORED = _KNN + ", c AS (SELECT vec_id, round((1 / (dp + 1e-6)) / (1 / (dp + 1e-6) + 1 / (dn + 1e-6)), 5) AS confidence FROM m), r AS (SELECT *, row_number() OVER (ORDER BY confidence DESC, vec_id) AS place, count(*) OVER () AS n FROM c)"


def _scored(spark, sf_dir):
    df = table(spark, sf_dir, "embeddings")
    positive, negative = _annotated_vectors(spark, sf_dir)
    at = [F.get("embedding", i) for i in range(len(positive[0]))]
    structure = structural_confidence(class_distance(at, positive, 5), class_distance(at, negative, 5))
    # kept, as ranks and counts read it several times
    return df.select("vec_id", F.round(combined_confidence(0.0, None, structure), 5).alias("confidence")).persist()


@query(
    _SCORED
    + """ SELECT vec_id, CASE WHEN place <= floor(0.2 * floor(n * 0.4)) THEN 1 ELSE 0 END AS pseudo_label FROM r
WHERE place <= floor(0.2 * floor(n * 0.4)) OR place > n - floor(0.2 * (n - floor(n * 0.4)))"""
)
def w_conf_select_empirical(spark, sf_dir):
    return select_empirical(_scored(spark, sf_dir), "vec_id", 0.4).select("vec_id", "pseudo_label")


@query(_SCORED + " SELECT vec_id, CASE WHEN place <= floor(n * 0.4) THEN 1 ELSE 0 END AS pseudo_label FROM r WHERE (place <= floor(n * 0.4) AND confidence >= 0.6) OR (place > floor(n * 0.4) AND confidence <= 0.45)")
def w_conf_select_inc(spark, sf_dir):
    return select_incremental(_scored(spark, sf_dir), "vec_id", 0.4, 0.45, 0.6).select("vec_id", "pseudo_label")


@query("SELECT vec_id, label, row_number() OVER (ORDER BY label / 10.0 DESC, vec_id) AS place FROM embeddings")
def w_confidence_rank(spark, sf_dir):
    df = table(spark, sf_dir, "embeddings").withColumn("confidence", F.col("label") / 10.0)
    return confidence_ranks(df, "vec_id").select("vec_id", "label", F.col("_place").alias("place"))


# -- sets ---------------------------------------------------------------------------------------------------------


@query(
    f"""
WITH a AS (SELECT doc_id FROM documents WHERE regexp_matches(lower(text), '{INSULTS}')), b AS (SELECT doc_id FROM documents WHERE regexp_matches(lower(text), '{JUNK}'))
(SELECT doc_id FROM a EXCEPT SELECT doc_id FROM b) UNION (SELECT doc_id FROM b EXCEPT SELECT doc_id FROM a)"""
)
def u_symdiff(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return symmetric_difference(docs.filter(F.lower("text").rlike(INSULTS)).select("doc_id"), docs.filter(F.lower("text").rlike(JUNK)).select("doc_id"))


@query(
    """
SELECT doc_id, 'residual' AS part, NULL AS toxic FROM documents WHERE lang = 'en'
UNION ALL SELECT doc_id, 'selected', toxic FROM labels WHERE toxic = 1 UNION ALL SELECT doc_id, 'discarded', toxic FROM labels WHERE toxic = 0"""
)
def u_union_view(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    part = lambda df, name: df.withColumn("part", F.lit(name))
    return union_view(part(docs.filter("lang = 'en'").select("doc_id"), "residual"), part(labels.filter("toxic = 1").select("doc_id", "toxic"), "selected"), part(labels.filter("toxic = 0").select("doc_id", "toxic"), "discarded"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def u_unlabelled(spark, sf_dir):
    return B.remaining(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id").select("doc_id")


@query("SELECT count(*) AS n, count(DISTINCT text) AS n_texts FROM documents")
def s_row_fingerprints(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(row_hash(["text"]).alias("h"))
    return rows.agg(F.count("*").alias("n"), F.countDistinct("h").alias("n_texts"))


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY md5('42:' || o_orderkey), o_orderkey) AS r FROM orders) WHERE r <= 3")
def b_quota(spark, sf_dir):
    return quota_sample(table(spark, sf_dir, "orders"), "o_custkey", [shuffle_key(SEED, "o_orderkey"), "o_orderkey"], 3).select("o_custkey", "o_orderkey")


@query(
    """
WITH m AS (SELECT o_custkey, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, o_custkey) AS k FROM orders GROUP BY o_custkey ORDER BY k LIMIT 20),
r AS (SELECT o.o_custkey, o.o_orderkey, k, row_number() OVER (PARTITION BY o.o_custkey ORDER BY md5('42:' || o_orderkey), o_orderkey) AS r FROM orders o JOIN m USING (o_custkey))
SELECT o_custkey, o_orderkey FROM r ORDER BY CASE WHEN r <= 5 THEN 0 ELSE 1 END, k, r LIMIT 150"""
)
def b_movie_quota(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    wanted = [r["o_custkey"] for r in top_groups(orders, "o_custkey", 20).collect()]
    return filled_quota(orders, "o_custkey", wanted, [shuffle_key(SEED, "o_orderkey"), "o_orderkey"], 150, 5).select("o_custkey", "o_orderkey")


# -- learning -----------------------------------------------------------------------------------------------------


def _training(spark, sf_dir, budget=40):
    """Labelled documents with features, and a seeded sample of them on the driver."""
    specs = [DERIVED[d] for d in ("n_insults", "n_exclaims", "symbol_share")]
    rows = backend().extract(labelled(spark, sf_dir), specs).withColumn("label", F.col("toxic"))
    names = [s.target for s in specs]
    chosen = stratified_table(rows.withColumn("guess", lexical_column(TOXIC)), "doc_id", "guess", budget, SEED).select("doc_id")
    return rows, names, rows.join(chosen, "doc_id", "left_semi").select("doc_id", "label", *names).orderBy("doc_id").toPandas()


@query()
def l_forest_propagate(spark, sf_dir):
    rows, names, some = _training(spark, sf_dir)
    forest = train(some[names].to_numpy(float), some["label"].to_numpy(int), names, ForestConfig(), seed=SEED)
    return rows.select("doc_id", "toxic", F.round(forest.column(), 6).alias("confidence"))


@query()
def l_rewrite_toxic(spark, sf_dir):
    rows, names, some = _training(spark, sf_dir)
    x, y = some[names].to_numpy(float), some["label"].to_numpy(int)
    forest = train(x, y, names, ForestConfig(), seed=SEED)
    guessed = rows.withColumn("propagated", (forest.column() > 0.5).cast("int"))
    rules = extract_rules(guessed, names, "propagated", 5, (x, y, np.ones(len(y))))
    return apply_rules(rows, rules).select("doc_id", "toxic", "predicted")


@query()
def l_loo(spark, sf_dir):
    _, names, some = _training(spark, sf_dir, 20)
    prefixes = {f"first {k}": names[:k] for k in range(1, len(names) + 1)}
    return loo_grid(some, names, spark, 1, 0.2, seed=SEED, candidates=prefixes)


# -- certificates and batches -------------------------------------------------------------------------------------


@query(
    """
WITH g AS (SELECT 86::BIGINT AS population, 6::BIGINT AS drawn UNION ALL SELECT count(*), 20 FROM labels),
s AS (SELECT *, unnest([0, 1, 2])::BIGINT AS seen FROM g),
k AS (SELECT *, unnest(range(0, population + 1)) AS k FROM s),
t AS (SELECT k.*, i, lgamma(k.k + 1) - lgamma(i + 1) - lgamma(greatest(k.k - i, 0) + 1) + lgamma(population - k.k + 1) - lgamma(drawn - i + 1)
             - lgamma(greatest(population - k.k - drawn + i, 0) + 1) - (lgamma(population + 1) - lgamma(drawn + 1) - lgamma(population - drawn + 1)) AS e
      FROM k, (SELECT unnest(range(0, 3)) AS i) WHERE i <= seen),
c AS (SELECT population, drawn, seen, k, sum(CASE WHEN i <= k AND drawn - i <= population - k THEN exp(e) ELSE 0 END) AS cdf FROM t GROUP BY ALL)
SELECT population, drawn, seen, max(k) AS most_errors FROM c WHERE (CASE WHEN seen >= least(drawn, k) THEN 1.0 ELSE cdf END) > 0.2 GROUP BY ALL"""
)
def c_certificate(spark, sf_dir):
    n = table(spark, sf_dir, "labels").count()
    rows = [(m, h, x, most_errors(m, h, x, 0.2)) for m, h in ((86, 6), (n, 20)) for x in (0, 1, 2)]
    return spark.createDataFrame(rows, "population long, drawn long, seen long, most_errors long")


@query("SELECT lang, round(CASE WHEN 0.05 < pi THEN 2 * (pi - 0.05) / (2 * pi - 0.05) ELSE 0 END, 9) AS f1_bound FROM (SELECT lang, avg(toxic) AS pi FROM documents JOIN labels USING (doc_id) GROUP BY lang)")
def c_error_bound(spark, sf_dir):
    rates = labelled(spark, sf_dir).groupBy("lang").agg(F.avg("toxic").alias("pi"))
    return rates.select("lang", F.round(f1_bound_column(0.05, F.col("pi")), 9).alias("f1_bound"))


_BATCHED = """
WITH n AS (SELECT count(*) AS n FROM events),
r AS (SELECT *, row_number() OVER (ORDER BY md5('42:' || event_id), event_id) AS p FROM events),
b AS (SELECT CASE WHEN p <= floor(n * 0.6) THEN 0 ELSE 1 END AS batch_id, value > 50 AS old_label, value > 52 AS new_label FROM r, n),
s AS (SELECT count(*) FILTER (WHERE batch_id = 0) AS prev, count(*) FILTER (WHERE batch_id = 1) AS curr, count(*) FILTER (WHERE batch_id = 0 AND old_label <> new_label) AS changed FROM b)"""


@query(
    _BATCHED
    + """ SELECT round(curr / (prev + curr), 9) AS data_error, round(changed / (prev + 5), 9) AS prediction_error,
       round(least(1.0, prev / (prev + curr) * 0.1 + curr / (prev + curr) + changed / (prev + 5)), 9) AS bound,
       round(curr / (prev + curr) + changed / (prev + 5) + 0.05, 9) AS smoothed FROM s"""
)
def i_inc_certificate(spark, sf_dir):
    rows = with_batches(table(spark, sf_dir, "events"), (0.6, 1.0), SEED, "event_id").withColumns({"old": F.col("value") > 50, "new": F.col("value") > 52})
    r = rows.agg(F.count_if(F.col("batch_id") == 0).alias("prev"), F.count_if(F.col("batch_id") == 1).alias("curr"), F.count_if((F.col("batch_id") == 0) & (F.col("old") != F.col("new"))).alias("changed")).first()
    u = updated_certificate(r["prev"], r["curr"], 0.1, r["changed"], r["prev"], 5)
    return spark.createDataFrame([tuple(round(x, 9) for x in (u.data_error, u.prediction_error, u.bound, smoothed(u, 0.1)))], "data_error double, prediction_error double, bound double, smoothed double")


@query(_BATCHED + " SELECT round(curr / (prev + curr) + sqrt(ln(2 / 0.2) / (2 * prev)), 9) AS threshold FROM s")
def i_threshold(spark, sf_dir):
    sizes = ladder(table(spark, sf_dir, "events").count(), (0.6, 1.0))
    return spark.createDataFrame([(round(reoptimisation_threshold(sizes, 0.2), 9),)], "threshold double")



@query(
    """
SELECT time_bucket(INTERVAL 1 DAY, ts) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL"""
)
def x_daily_windows(spark, sf_dir):
    """Event-time windows: an addition of this engine."""
    df = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    each = df.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return each.select(F.col("w.start").cast("timestamp_ntz").alias("day"), "event_type", "n", "total")


# -- whole engine -------------------------------------------------------------------------------------------------


def demonstration_engine(spark: SparkSession, sf_dir: str, **settings) -> Engine:
    """Semantic queries over the labelled documents, answered by the lexical backend."""
    labels = table(spark, sf_dir, "labels")
    docs = table(spark, sf_dir, "documents").join(labels.select("doc_id"), "doc_id", "left_semi")
    truth = {"toxic": labels.filter("toxic = 1").select("doc_id"), "junk": labels.filter("quality = 0").select("doc_id")}
    roles = TableRoles(base=("lang", "source", "n_chars"), ids=("doc_id",), payload=("text",))
    queries = {"toxic": toxic_query(), "junk": junk_query()}
    return Engine(docs, roles, queries, truth, backend(), "doc_id", Config(**settings))


@query(f"SELECT doc_id FROM documents WHERE lang = 'en' AND text <> '' AND regexp_matches(lower(text), '{INSULTS}')")
def e_semantic_query(spark, sf_dir):
    """A semantic query from end to end: labels, features, forest, rewrite. The rules are learned where there are labels and
    answer all documents, by a plain filter. With the labels of sf0.01 they come out as the predicate itself, which the SQL
    states; with the few of sf0.001 no rule is found."""
    engine = demonstration_engine(spark, sf_dir)
    state = engine.run_query("toxic", engine.partition())
    return engine.answer_over(table(spark, sf_dir, "documents"), state)


@query(f"SELECT doc_id FROM documents WHERE lang = 'en' AND text <> '' AND regexp_matches(lower(text), '{INSULTS}')")
def e_without_rewrite(spark, sf_dir):
    """The backend decides every row of the table from its serialised columns."""
    return replace(demonstration_engine(spark, sf_dir), table=table(spark, sf_dir, "documents")).without_rewrite("toxic")


def _toxic_view(spark, sf_dir) -> View:
    """What an answered query leaves behind: its rows with their features; no rules were learned."""
    rows = B.initialise(labelled(spark, sf_dir), toxic_query(), "toxic")
    specs = [semantic_feature(TOXIC), semantic_feature(JUNKY)]
    return View(toxic_query(), backend().extract(rows, specs), [], [specs[0].target])


@query(f"SELECT doc_id FROM documents JOIN labels USING (doc_id) WHERE lang = 'en' AND text <> '' AND regexp_matches(lower(text), '{INSULTS}')")
def d_reuse_view(spark, sf_dir):
    view = _toxic_view(spark, sf_dir)
    assert backend().relate(toxic_again(), view.query) == "same"
    return answer_by_rules(view, view.effective_rules(), ["doc_id"])


@query(f"SELECT doc_id FROM documents JOIN labels USING (doc_id) WHERE lang = 'en' AND text <> '' AND regexp_matches(lower(text), '{INSULTS}') AND regexp_matches(lower(text), '{JUNK}')")
def d_contained(spark, sf_dir):
    view, wanted = _toxic_view(spark, sf_dir), toxic_and_junk()
    assert backend().relate(wanted, view.query) == "contained"
    return answer_by_rules(view, backend().regenerate(wanted, view.rows.columns), ["doc_id"])


@query()
def i_rounds(spark, sf_dir):
    """Batches after the first: certificates carried along, and whether to learn anew."""
    engine = demonstration_engine(spark, sf_dir, dynamic_setting=(0.6, 0.8, 1.0))
    state = engine.run_query("toxic", engine.partition().persist(), True)
    run_rounds(engine, state)
    keep = ("batch", "candidates", "data_error", "prediction_error", "bound", "smoothed", "threshold", "f1")
    return spark.createDataFrame([tuple(r[k] for k in keep) for r in state.rounds], "batch int, candidates long, data_error double, prediction_error double, bound double, smoothed double, threshold double, f1 double")
