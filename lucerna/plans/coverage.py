"""More queries of the catalogue: caches and sinks, learning, rewriting, certificates and drift, with their SQL."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache
from types import SimpleNamespace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.predicates import apply_rules, known_groups, retrieve
from ..functions.text import without_comma
from ..model import FeatureSpec, Predicate, TableRoles, semantic_feature
from ..operators import buckets as B
from ..operators.batches import sample, with_batches
from ..operators.certify import certificate, f1_bound, split_annotations
from ..operators.confidence import class_distance, combined_confidence, select_balanced, structural_confidence, weighted_features
from ..operators.features import FeatureCache, PseudoLabelCache, active_columns, expected_columns, predicate_budgets, rank_features, sync_columns
from ..operators.forest import Forest, ForestConfig, choose_depth, depth_grid, propagate, train
from ..operators.profile import standardised
from ..operators.quality import bucket_quality, row_keys, union_view
from ..operators.rewrite import best_candidate, candidates, extract_rules, least_prefix
from ..operators.sampling import ANCHORS, STOP_WORDS, clamped_budget, diverse_rows, positive_count
from ..operators.weights import objective_penalty, subjective_penalty, weighted_loss
from ..sources.datasets import append_journal, existing_files, ground_truth, load_dataset, save_csv
from ..streaming.incremental import carried_over
from .catalogue import _KNN, SEED, _annotated_vectors, _scored, _SCORED, _toxic_view, demonstration_engine, labelled, query, table
from .drift import View, answer_by_rules, route
from .engine import PENALTY, all_hold
from .experiments import usage_report
from .lexicon import DERIVED, INSULTS, JUNK, JUNKY, TOXIC, backend, lexical_column, toxic_again, toxic_and_junk, toxic_query

# The lexical features, as SQL.
_INSULTS = f"len(regexp_extract_all(lower(text), '{INSULTS}'))"
_EXCLAIMS = "len(regexp_extract_all(text, '!'))"
_SYMBOLS = "CASE WHEN length(text) > 0 THEN len(regexp_extract_all(text, '[#*$%&|<>]')) / length(text) ELSE 0.0 END"
_TOXIC = f"regexp_matches(lower(text), '{INSULTS}')"
_JUNK = f"regexp_matches(lower(text), '{JUNK}')"
_NAMES = ("n_insults", "n_exclaims", "symbol_share")


def scratch(spark: SparkSession) -> str:
    """A folder that all executors see: below the session's shared one, or a local one where all run on this machine."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{(at or tempfile.mkdtemp(prefix='lucerna-')).rstrip('/')}/catalogue-{uuid.uuid4().hex}"


def _featured(spark, sf_dir, names=_NAMES) -> DataFrame:
    return backend().extract(table(spark, sf_dir, "documents"), [DERIVED[n] for n in names])


# -- projections and filters --------------------------------------------------------------------------------------


@query(
    f"""
WITH d AS (SELECT n_chars, {_INSULTS} AS a, {_EXCLAIMS} AS b, length(lang) AS c FROM documents)
SELECT 'prefix' AS kind, 'n_chars,n_exclaims,n_insults' AS columns, count(*) AS n, sum(n_chars + a + b)::DOUBLE AS total FROM d
UNION ALL SELECT 'prefix', 'n_chars,lang_length,n_exclaims,n_insults', count(*), sum(n_chars + a + b + c)::DOUBLE FROM d
UNION ALL SELECT 'external_forest', 'lang_length,n_exclaims,n_insults', count(*), sum(a + b + c)::DOUBLE FROM d"""
)
def p_candidate_projection(spark, sf_dir):
    """What each rewrite candidate may read: prefixes of the ranked features with the base ones, and all without them."""
    df = _featured(spark, sf_dir, ("n_insults", "n_exclaims")).withColumn("lang_length", F.length("lang"))
    ranked, base, parts = ["n_exclaims", "n_insults", "lang_length"], ["n_chars"], []
    for c in candidates(ranked, least_prefix(ranked, {"n_insults"}), base):
        wanted = [f for f in c.features if f not in base]
        columns = active_columns(df.columns, base if c.kind == "prefix" else [], wanted)
        total = sum((F.col(x) for x in columns[1:]), F.col(columns[0]))
        parts.append(df.select(*columns).agg(F.count("*").alias("n"), F.sum(total).cast("double").alias("total")).select(F.lit(c.kind).alias("kind"), F.lit(",".join(columns)).alias("columns"), "n", "total"))
    return union_view(*parts)


@query(f"SELECT doc_id, {_INSULTS}::INT AS n_insults, {_EXCLAIMS}::INT AS n_exclaims FROM documents")
def p_sync_columns(spark, sf_dir):
    """Features no longer asked for go, missing ones are added, the others stay."""
    earlier, wanted = [DERIVED["n_insults"], DERIVED["has_license"]], [DERIVED["n_insults"], DERIVED["n_exclaims"]]
    docs = table(spark, sf_dir, "documents")
    kept, missing = sync_columns(backend().extract(docs, earlier), wanted, earlier)
    out = backend().extract(kept, missing)
    if set(out.columns) != expected_columns(docs.columns, wanted) or missing != wanted[1:]:
        raise AssertionError("columns are out of step with the features")
    return out.select("doc_id", "n_insults", "n_exclaims")


@query(f"SELECT doc_id, {_TOXIC} AND {_JUNK} AS proxy FROM documents")
def f_semantic_all(spark, sf_dir):
    specs = [semantic_feature(TOXIC), semantic_feature(JUNKY)]
    return backend().extract(table(spark, sf_dir, "documents"), specs).select("doc_id", all_hold(specs).alias("proxy"))


@query("SELECT o_orderkey FROM orders WHERE o_totalprice > 200000")
def f_known_groups(spark, sf_dir):
    df = table(spark, sf_dir, "orders")
    groups = [[Predicate("o_totalprice", ">", 200000)], [Predicate("o_colour", "==", "red")], [Predicate("o_orderkey", ">", 0), Predicate("none", "==", 1)]]
    return retrieve(df, known_groups(groups, df.columns)).select("o_orderkey")


@query(
    """
WITH h AS (SELECT doc_id, toxic = 1 AS human FROM labels ORDER BY md5('42:' || doc_id), doc_id LIMIT 50)
SELECT CASE WHEN human IS NULL THEN 'candidate' WHEN human THEN 'selected' ELSE 'discarded' END AS bucket, human IS NOT NULL AS annotated, count(*) AS n
FROM documents LEFT JOIN h USING (doc_id) GROUP BY ALL"""
)
def f_annotate(spark, sf_dir):
    """Labelled rows leave the candidates, aligned by their id."""
    human = sample(table(spark, sf_dir, "labels"), 50, SEED, "doc_id").select("doc_id", (F.col("toxic") == 1).alias("human"))
    rows = table(spark, sf_dir, "documents").withColumn("bucket", F.lit(B.CANDIDATE))
    return B.annotate(rows, human, "doc_id").groupBy("bucket", "annotated").agg(F.count("*").alias("n"))


@query("SELECT count(*) FILTER (WHERE NOT contains(text, ',')) AS passed, count(*) FILTER (WHERE contains(text, ',')) > 0 AS refused FROM documents")
def f_comma_refused(spark, sf_dir):
    """Values without a comma pass the guard; one with a comma is an error."""
    docs, guard = table(spark, sf_dir, "documents"), without_comma(F.col("text"), "text")
    passed = docs.filter(~F.contains("text", F.lit(","))).select(guard.alias("v")).agg(F.count("v").alias("n")).first()["n"]
    try:
        docs.agg(F.count(guard)).collect()
        refused = False
    except Exception as error:
        refused = "holds a comma" in str(error)
    return spark.createDataFrame([(passed, refused)], "passed long, refused boolean")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 250000)")
def j_existing(spark, sf_dir):
    rich = table(spark, sf_dir, "orders").filter("o_totalprice > 250000")
    return existing_files(table(spark, sf_dir, "customer"), "c_custkey", rich, "o_custkey").select("c_custkey", "c_name")


# -- ranks, sets, weights -----------------------------------------------------------------------------------------


@query(
    _SCORED
    + """, cut AS (SELECT *, floor(0.2 * least(floor(n * 0.4), n - floor(n * 0.4))) AS step FROM r)
SELECT vec_id, CASE WHEN place <= step THEN 1 ELSE 0 END AS pseudo_label FROM cut WHERE place <= step OR place > n - step"""
)
def w_conf_select_balanced(spark, sf_dir):
    return select_balanced(_scored(spark, sf_dir), "vec_id", 0.4).select("vec_id", "pseudo_label")


@query(
    f"""
WITH f AS (SELECT avg({_INSULTS}) AS a, avg({_EXCLAIMS}) AS b, avg({_SYMBOLS}) AS c FROM documents),
w AS (SELECT 'n_insults' AS feature, 1 AS seen, a AS w FROM f UNION ALL SELECT 'n_exclaims', 2, b FROM f UNION ALL SELECT 'symbol_share', 3, c FROM f),
r AS (SELECT feature, row_number() OVER (ORDER BY w DESC, seen) AS k FROM w)
SELECT '{semantic_feature(TOXIC).target}' AS feature, 0::BIGINT AS place UNION ALL SELECT feature, k FROM r WHERE k <= 2"""
)
def w_feature_rank(spark, sf_dir):
    """Mandatory features first, then by falling weight, within the budget."""
    means = _featured(spark, sf_dir).agg(*[F.avg(n).alias(n) for n in _NAMES]).first().asDict()
    kept = rank_features([semantic_feature(TOXIC), *(DERIVED[n] for n in _NAMES)], means, 3)
    return spark.createDataFrame([(s.target, i) for i, s in enumerate(kept)], "feature string, place long")


_LOSSES = "WITH l AS (SELECT lang, round(avg(toxic), 1) AS loss, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY lang), k AS (SELECT *, row_number() OVER (ORDER BY lang) - 1 AS i, sum(n) OVER () AS m FROM l)"


@query(_LOSSES + " SELECT (SELECT i FROM k ORDER BY loss, i DESC LIMIT 1) AS best, (SELECT min(i) FROM k WHERE loss <= (SELECT min(loss) FROM k) + 1.0 / ceil(m / 100.0) + 1e-12) AS depth, 3::BIGINT AS depths")
def w_candidate_choice(spark, sf_dir):
    """The candidate of least loss (the later of equals), and the shallowest forest within one left-out row of the least."""
    rows = labelled(spark, sf_dir).groupBy("lang").agg(F.round(F.avg("toxic"), 1).alias("loss"), F.count("*").alias("n")).orderBy("lang").collect()
    losses = [r["loss"] for r in rows]
    return spark.createDataFrame([(best_candidate(losses), choose_depth(losses, sum(r["n"] for r in rows), 100), len(depth_grid()))], "best long, depth long, depths long")


_WORDS = ", ".join(f"'{w}'" for w in STOP_WORDS)


@query(
    rf"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}_]+'), lambda w: length(w) > 1 AND w NOT IN ({_WORDS})) AS w FROM documents),
t AS (SELECT doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM d),
f AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
v AS (SELECT term, sum(tf) AS total, count(*) AS df FROM f GROUP BY term ORDER BY total DESC, term LIMIT 8192),
r AS (SELECT doc_id, term, tf * (ln((1.0 + (SELECT count(*) FROM documents)) / (1.0 + df)) + 1.0) AS x FROM f JOIN v USING (term)),
u AS (SELECT doc_id, term, x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)) AS x FROM r),
c AS (SELECT term, sum(x) / (SELECT count(*) FROM documents) AS c FROM u GROUP BY term),
s AS (SELECT doc_id, sum(x * c) AS s FROM u JOIN c USING (term) GROUP BY doc_id),
a AS (SELECT doc_id FROM documents LEFT JOIN s USING (doc_id) ORDER BY round(coalesce(s, 0.0), 9) DESC, doc_id LIMIT 1),
n AS (SELECT u.doc_id, sum(u.x * o.x) AS s FROM u JOIN u o ON o.term = u.term AND o.doc_id = (SELECT doc_id FROM a) GROUP BY u.doc_id),
b AS (SELECT doc_id FROM documents LEFT JOIN n USING (doc_id) WHERE doc_id <> (SELECT doc_id FROM a) ORDER BY round(coalesce(s, 0.0), 9), doc_id LIMIT 1)
SELECT 0::BIGINT AS place, doc_id FROM a UNION ALL SELECT 1, doc_id FROM b"""
)
def w_diverse_rows(spark, sf_dir):
    """Anchors: the row nearest the centroid of the TF-IDF vectors, then the one least like it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return spark.createDataFrame(list(enumerate(diverse_rows(docs, "doc_id", "text", ANCHORS))), "place long, doc_id long")


@query("SELECT DISTINCT user_id, event_type FROM events")
def u_union_distinct(spark, sf_dir):
    """Keys over all batches, each once."""
    rows = with_batches(table(spark, sf_dir, "events"), (0.5, 1.0), SEED, "event_id")
    return row_keys(union_view(*[row_keys(rows.filter(F.col("batch_id") == b), ["user_id", "event_type"]) for b in (0, 1)]), ["user_id", "event_type"])


@query(
    f"""
WITH h AS (SELECT doc_id FROM labels ORDER BY md5('42:' || doc_id), doc_id LIMIT 50),
x AS (SELECT toxic = 1 AS t, CASE WHEN h.doc_id IS NOT NULL THEN toxic = 1 ELSE {_TOXIC} END AS f FROM documents JOIN labels USING (doc_id) LEFT JOIN h USING (doc_id))
SELECT count(*) FILTER (WHERE t AND f) AS tp, count(*) FILTER (WHERE f AND NOT t) AS fp, count(*) FILTER (WHERE t AND NOT f) AS fn, count(*) AS omega FROM x"""
)
def u_bucket_quality(spark, sf_dir):
    """Annotated true rows count as found, whatever the rules say; discarded true rows are missed."""
    human = sample(table(spark, sf_dir, "labels"), 50, SEED, "doc_id").select("doc_id", (F.col("toxic") == 1).alias("human"))
    rows = labelled(spark, sf_dir).withColumn("bucket", F.lit(B.CANDIDATE)).withColumn("label", F.col("toxic") == 1)
    q = bucket_quality(B.annotate(rows, human, "doc_id").withColumn("predicted", lexical_column(TOXIC).cast("int")), ["doc_id"])
    return spark.createDataFrame([(q.tp, q.fp, q.fn, q.omega)], "tp long, fp long, fn long, omega long")


@query(
    """
SELECT 'all' AS run, CAST(sum(n) AS VARCHAR) AS calls, CAST(sum(n) * 2 AS VARCHAR) AS input_tokens FROM (SELECT count(*) AS n FROM labels UNION ALL SELECT count(*) FROM nation)
UNION ALL SELECT 'labels', CAST(count(*) AS VARCHAR), CAST(count(*) * 2 AS VARCHAR) FROM labels UNION ALL SELECT 'nation', CAST(count(*) AS VARCHAR), CAST(count(*) * 2 AS VARCHAR) FROM nation"""
)
def a_usage_totals(spark, sf_dir):
    sizes = {n: table(spark, sf_dir, n).count() for n in ("labels", "nation")}
    return usage_report(spark, {n: {"calls": k, "input_tokens": 2 * k} for n, k in sizes.items()})


# -- sources, sinks and caches ------------------------------------------------------------------------------------


@query("SELECT n_name, n_regionkey::BIGINT AS n_regionkey, n_regionkey = 1 AS label FROM nation")
def s_dataset(spark, sf_dir):
    """A data set on disk: a table, the roles of its columns, and the true rows of a query."""
    root, nation = scratch(spark), table(spark, sf_dir, "nation")
    nation.select("n_nationkey", "n_name", "n_regionkey").write.csv(f"{root}/data_full.csv", header=True)
    nation.filter("n_regionkey = 1").select("n_nationkey", "n_name").write.csv(f"{root}/ground_truth/q.csv", header=True)
    config = '{"base_features": ["n_name", "n_regionkey"], "id_features": ["n_nationkey"], "foreign_keys": []}'
    spark.createDataFrame([(config,)], "value string").coalesce(1).write.text(f"{root}/config.yaml")
    df, roles = load_dataset(spark, root)
    rows = B.with_truth(df, ground_truth(spark, root, "q", ["n_nationkey"]), ["n_nationkey"])
    return rows.select(*[F.col(c) for c in roles.features(df.columns)], "label").withColumn("n_regionkey", F.col("n_regionkey").cast("long"))


@query(f"SELECT doc_id, {_INSULTS}::INT AS n_insults FROM documents")
def s_feature_cache(spark, sf_dir):
    """Features of some rows are cached first; then only the values not there yet are asked for."""
    docs, cache = table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), FeatureCache(scratch(spark))
    cache.materialise(docs.filter("lang = 'en'"), DERIVED["n_insults"], backend())
    return cache.materialise(docs, DERIVED["n_insults"], backend()).select("doc_id", "n_insults")


@query(f"SELECT doc_id, {_TOXIC} AS proxy FROM documents")
def s_pseudo_labels(spark, sf_dir):
    """Pseudo-labels from the cache: the second time nothing is made."""
    docs, cache, specs, made = table(spark, sf_dir, "documents").select("doc_id", "text"), PseudoLabelCache(scratch(spark)), [semantic_feature(TOXIC)], []

    def make(rows):
        made.append(1)
        return backend().extract(rows, specs).withColumn("proxy", all_hold(specs))

    for order in ("doc_id", "text"):  # the key doesn't depend on the order of rows
        out = cache.labelled(docs.orderBy(order), "doc_id", specs, "lexical", make)
    if len(made) != 1:
        raise AssertionError("the cache was missed")
    return out.select("doc_id", "proxy")


@query("SELECT n_nationkey::BIGINT AS n_nationkey, '{\"name\":\"' || n_name || '\",\"region\":' || n_regionkey || '}' AS place FROM nation")
def s_csv_sink(spark, sf_dir):
    """A CSV whose structures are JSON, read back."""
    path = scratch(spark)
    save_csv(table(spark, sf_dir, "nation").select("n_nationkey", F.struct(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region")).alias("place")), path)
    return spark.read.csv(path, header=True, escape='"', schema="n_nationkey long, place string")


@query("SELECT 2 * count(*) AS n, count(DISTINCT r_name) AS n_names FROM region")
def s_journal(spark, sf_dir):
    """A journal that grows by two runs' lines."""
    path, rows = scratch(spark), [{"name": r["r_name"]} for r in table(spark, sf_dir, "region").collect()]
    for _ in range(2):
        append_journal(spark, path, rows)
    return spark.read.json(path).agg(F.count("*").alias("n"), F.countDistinct("name").alias("n_names"))


@query(f"SELECT doc_id FROM documents JOIN labels USING (doc_id) WHERE lang = 'en' AND text <> '' AND {_TOXIC}")
def s_saved_view(spark, sf_dir):
    """The view of a query, saved and loaded."""
    path = scratch(spark)
    _toxic_view(spark, sf_dir).save(path)
    view = View.load(spark, path, toxic_query())
    return answer_by_rules(view, view.effective_rules(), ["doc_id"])


# -- learning and rewriting ---------------------------------------------------------------------------------------


@lru_cache(1)
def fixed_forest() -> Forest:
    """A forest over the lexical features, trained on made-up rows; its trees are also written as SQL."""
    rng = np.random.default_rng(5)
    x = np.column_stack([rng.integers(0, 5, 400), rng.integers(0, 8, 400), rng.random(400) / 10])
    y = ((x[:, 0] > 1) | ((x[:, 1] > 4) & (x[:, 2] > 0.03))).astype(int)
    return train(x, y, list(_NAMES), ForestConfig(12, 3, 2), seed=SEED)


_FOREST = fixed_forest().sql('"', "CAST({!r} AS DOUBLE)")
_VALUES = f"SELECT doc_id, {_INSULTS} AS n_insults, {_EXCLAIMS} AS n_exclaims, {_SYMBOLS} AS symbol_share FROM documents"


@query(f"SELECT doc_id, round({_FOREST}, 9) AS confidence, CASE WHEN {_FOREST} > 0.5 THEN 1 ELSE 0 END AS propagated FROM ({_VALUES})")
def l_forest_columns(spark, sf_dir):
    """A forest's probability and label of every row, as plain expressions."""
    forest = fixed_forest()
    return propagate(_featured(spark, sf_dir), forest).select("doc_id", F.round(forest.column(), 9).alias("confidence"), "propagated")


@query(
    f"""
WITH v AS ({_VALUES}), w AS (SELECT doc_id, n_insults * 0.5 AS a, n_exclaims * 0.25 AS b FROM v)
SELECT doc_id, round((a - avg(a) OVER ()) / stddev_pop(a) OVER (), 6) AS n_insults, round((b - avg(b) OVER ()) / stddev_pop(b) OVER (), 6) AS n_exclaims FROM w"""
)
def l_weighted_features(spark, sf_dir):
    names = ["n_insults", "n_exclaims"]
    scaled = _featured(spark, sf_dir, names).select("doc_id", *[c.alias(n) for n, c in zip(names, weighted_features({"n_insults": 0.5, "n_exclaims": 0.25}, names), strict=True)])
    return standardised(scaled, names).select("doc_id", *[F.round(n, 6).alias(n) for n in names])


@query(
    _KNN
    + """, s2 AS (SELECT vec_id, (1 / (dp + 1e-6)) / (1 / (dp + 1e-6) + 1 / (dn + 1e-6)) AS structure FROM m)
SELECT e.vec_id, round(0.3 * (CASE WHEN e.embedding[1] > 0 THEN 1.0 ELSE 0.0 END) + 0.7 * structure, 6) AS confidence FROM embeddings e JOIN s2 USING (vec_id)"""
)
def l_combined_confidence(spark, sf_dir):
    """Prediction and structure, weighted by the selectivity; the forest here is one that learned the sign of a number."""
    forest = train(np.array([[-1.0], [1.0]] * 20), np.array([0, 1] * 20), ["first"], ForestConfig(5, 1, 1), seed=SEED)
    df = table(spark, sf_dir, "embeddings").withColumn("first", F.get("embedding", 0))
    positive, negative = _annotated_vectors(spark, sf_dir)
    at = [F.get("embedding", i) for i in range(len(positive[0]))]
    structure = structural_confidence(class_distance(at, positive, 5), class_distance(at, negative, 5))
    return df.select("vec_id", F.round(combined_confidence(0.3, forest.column(), structure), 6).alias("confidence"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 24 OR l_discount < 0.035 THEN 1 ELSE 0 END AS predicted FROM lineitem")
def l_rules_recovered(spark, sf_dir):
    """Rules for labels that two intervals decide: the extracted union is those intervals."""
    rows = table(spark, sf_dir, "lineitem").withColumn("propagated", ((F.col("l_quantity") > 24) | (F.col("l_discount") < 0.035)).cast("int"))
    return apply_rules(rows, extract_rules(rows, ["l_quantity", "l_discount"], "propagated", 5)).select("l_orderkey", "l_linenumber", "predicted")


@query("SELECT l_orderkey, l_linenumber, 1 AS everything, 0 AS nothing FROM lineitem")
def l_rules_of_one_label(spark, sf_dir):
    """One label only, and no feature at all: all rows or none."""
    rows = table(spark, sf_dir, "lineitem").withColumns({"one": F.lit(1), "zero": F.lit(0)})
    out = apply_rules(rows, extract_rules(rows, [], "one", 5), "everything")
    return apply_rules(out, extract_rules(rows, ["l_quantity"], "zero", 5), "nothing").select("l_orderkey", "l_linenumber", "everything", "nothing")


_COUNTS = "WITH c AS (SELECT count(*) AS n, avg(toxic) AS pi FROM labels), g AS (SELECT *, greatest(pi, 1 - pi) / least(pi, 1 - pi) AS gamma FROM c)"


@query(
    _COUNTS
    + """, q AS (SELECT avg(CASE WHEN toxic = 1 AND quality = 1 THEN greatest(pi, 1 - pi) / pi WHEN toxic = 0 AND quality = 0 THEN greatest(pi, 1 - pi) / (1 - pi) ELSE 0 END) AS loss FROM labels, c),
p AS (SELECT gamma * sqrt((5 * 2 * ln(5) * ln(n) + ln(2 * 2 / 0.2)) / n) AS objective, gamma * sqrt(ln(2 * 2 / 0.2) / (2 * n)) AS subjective FROM g)
SELECT round(objective, 9) AS objective, round(subjective, 9) AS subjective, round(loss + loss + 0.01 * (objective + subjective), 9) AS total FROM p, q"""
)
def l_losses(spark, sf_dir):
    """Penalties of both losses, and their sum for one rewrite."""
    rows = table(spark, sf_dir, "labels").select("toxic", "quality").toPandas()  # labels are a budget's worth
    n, pi = len(rows), float(rows["toxic"].mean())
    loss = weighted_loss(rows["toxic"].to_numpy(), 1 - rows["quality"].to_numpy(), pi)
    objective, subjective = objective_penalty(n, pi, 5, 2, 2, 0.2), subjective_penalty(n, pi, 2, 0.2)
    return spark.createDataFrame([tuple(round(v, 9) for v in (objective, subjective, loss + loss + PENALTY * (objective + subjective)))], "objective double, subjective double, total double")


@query(
    """
WITH g AS (SELECT b, p, q, least(b, p + q) AS clamped FROM range(0, 9) AS x(b), range(0, 7) AS y(p), range(0, 7) AS z(q)),
w AS (SELECT *, CASE WHEN clamped >= 2 THEN least(greatest(floor(clamped / 2.0 + 0.5), 1), clamped - 1) ELSE floor(clamped / 2.0 + 0.5) END AS want FROM g)
SELECT b, p, q, CASE WHEN p = 0 THEN 0 WHEN q = 0 THEN clamped ELSE least(want, p) + (clamped - least(want, p)) - least(clamped - least(want, p), q) END::BIGINT AS positive FROM w"""
)
def l_allotment(spark, sf_dir):
    """How a labelling budget is shared out over two strata, for all small sizes."""
    rows = [(b, p, q, positive_count(clamped_budget(b, p + q), p, q)) for b in range(9) for p in range(7) for q in range(7)]
    return spark.createDataFrame(rows, "b long, p long, q long, positive long")


@query("SELECT n, total, i, CASE WHEN i < total % n THEN total // n + 1 ELSE total // n END AS budget FROM range(1, 5) AS a(n), range(0, 11) AS b(total), range(0, 4) AS c(i) WHERE i < n")
def l_feature_budgets(spark, sf_dir):
    rows = [(n, total, i, b) for n in range(1, 5) for total in range(11) for i, b in enumerate(predicate_budgets(n, total))]
    return spark.createDataFrame(rows, "n long, total long, i long, budget long")


# -- certificates, batches, drift ---------------------------------------------------------------------------------


@query(
    """
WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) AS p, count(*) OVER () AS m FROM labels)
SELECT doc_id, CASE WHEN p <= floor(0.7 * m + 0.5) THEN 'train' ELSE 'verify' END AS part FROM r"""
)
def c_split(spark, sf_dir):
    some, rest = split_annotations(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", SEED)
    return some.withColumn("part", F.lit("train")).unionAll(rest.withColumn("part", F.lit("verify")))


@query(
    f"""
WITH x AS (SELECT {_TOXIC} AS a, {_TOXIC} OR {_JUNK} AS b FROM documents),
s AS (SELECT count(*) AS n, count(*) FILTER (WHERE a <> b) AS d, count(*) - 40 AS pop, 20 AS h, 1 AS x FROM x),
k AS (SELECT s.*, unnest(range(0, pop + 1)) AS k FROM s),
t AS (SELECT k.*, i, lgamma(k.k + 1) - lgamma(i + 1) - lgamma(greatest(k.k - i, 0) + 1) + lgamma(pop - k.k + 1) - lgamma(h - i + 1) - lgamma(greatest(pop - k.k - h + i, 0) + 1)
             - (lgamma(pop + 1) - lgamma(h + 1) - lgamma(pop - h + 1)) AS e FROM k, (SELECT unnest(range(0, 2)) AS i)),
c AS (SELECT k, max(x) AS x, max(h) AS h, sum(CASE WHEN i <= k AND h - i <= pop - k THEN exp(e) ELSE 0 END) AS cdf FROM t GROUP BY k),
m AS (SELECT max(k) AS unseen FROM c WHERE (CASE WHEN x >= least(h, k) THEN 1.0 ELSE cdf END) > 0.2 / 2)
SELECT unseen, round(least(1.0, d / n + (2 + unseen) / n), 9) AS bound FROM s, m"""
)
def c_bound(spark, sf_dir):
    """The certificate of two sets of rules, with two errors in training and one among twenty verified rows."""
    rows = table(spark, sf_dir, "documents").select(lexical_column(TOXIC).alias("a"), (lexical_column(TOXIC) | lexical_column(JUNKY)).alias("b"))
    r = rows.agg(F.count("*").alias("n"), F.count_if(F.col("a") != F.col("b")).alias("d")).first()
    c = certificate(r["n"], r["d"], 40, 2, 20, 1, 0.2, 2)
    return spark.createDataFrame([(c.unseen_errors, round(c.bound, 9))], "unseen long, bound double")


@query("SELECT 0::BIGINT AS candidates, 0.0::DOUBLE AS data_error, 0.0::DOUBLE AS prediction_error, round(e / 2, 9) AS bound, round(e / 4, 9) AS smoothed, round(CASE WHEN e / 2 < pi THEN 2 * (pi - e / 2) / (2 * pi - e / 2) ELSE 0 END, 9) AS f1_bound FROM (SELECT avg(toxic) AS e, avg(quality) AS pi FROM labels)")
def i_carried_over(spark, sf_dir):
    """A batch without candidates: the bound stays, and no error is added."""
    r = table(spark, sf_dir, "labels").agg(F.avg("toxic").alias("e"), F.avg("quality").alias("pi")).first()
    row = carried_over(SimpleNamespace(rounds=[{"bound": r["e"] / 2}], certificate=None, pi=r["pi"]), 1)
    keep = ("data_error", "prediction_error", "bound", "smoothed", "f1_bound")
    return spark.createDataFrame([(row["candidates"], *(round(row[k], 9) for k in keep))], "candidates long, " + ", ".join(f"{k} double" for k in keep))


_DRIFT = f"""
WITH v AS (SELECT toxic = 1 AS t, toxic = 1 AND quality = 0 AS t2, {_TOXIC} AS a, {_JUNK} AS b FROM documents JOIN labels USING (doc_id) WHERE lang = 'en' AND text <> ''),
o AS (
  SELECT 'reuse' AS mode, 'reuse' AS route, 'unasked' AS relation, t, a AS f FROM v UNION ALL SELECT 'align', 'reuse', 'same', t, a FROM v
  UNION ALL SELECT 'selective', 'regenerate', 'contained', t2, a AND b FROM v)
SELECT mode, route, relation, count(*) FILTER (WHERE t AND f) AS tp, count(*) FILTER (WHERE f AND NOT t) AS fp, count(*) FILTER (WHERE t AND NOT f) AS fn, count(*) AS omega FROM o GROUP BY ALL"""


@query(_DRIFT)
def d_route(spark, sf_dir):
    """Later queries through the router: rules reused unseen, reused as the question is the same, and made for the view."""
    labels = table(spark, sf_dir, "labels")
    engine = demonstration_engine(spark, sf_dir)
    engine.queries |= {"again": toxic_again(), "both": toxic_and_junk()}
    engine.truth |= {"again": engine.truth["toxic"], "both": labels.filter("toxic = 1 and quality = 0").select("doc_id")}
    view, rows = _toxic_view(spark, sf_dir), []
    for mode, name in (("reuse", "again"), ("align", "again"), ("selective", "both")):
        o = route(engine, name, view, mode)
        rows.append((mode, o.route, o.relation, o.quality.tp, o.quality.fp, o.quality.fn, o.quality.omega))
    return spark.createDataFrame(rows, "mode string, route string, relation string, tp long, fp long, fn long, omega long")
