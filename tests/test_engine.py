from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from lucerna.functions.predicates import apply_rules
from lucerna.model import SemCQ
from lucerna.operators import buckets as B
from lucerna.plans import lexicon
from lucerna.plans.catalogue import demonstration_engine
from lucerna.operators.features import PseudoLabelCache
from lucerna.plans.drift import MODES, View, route, run_group, state_path, valid_rules
from lucerna.plans.experiments import Experiment, average_loss, footprint, overview, payload, rounds, selected_rules, usage_report
from lucerna.sources.datasets import StateStore
from lucerna.streaming.incremental import Feed, windowed_counts

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def done(spark):
    engine = demonstration_engine(spark, DATA, dynamic_setting=(0.7, 1.0))
    engine.queries = {"toxic": lexicon.toxic_query()}
    return engine, engine.run(True)


def test_rewrite_answers_well(done):
    engine, states = done
    s = states["toxic"]
    assert s.translation.f1 > 0.8 and s.prediction.f1 > 0.8
    assert len(s.labelled) == 20 and 0 < s.pi < 1 and s.rules
    assert 0 <= s.certificate.bound <= 1 and 0 <= s.f1_bound <= 1
    assert engine.answer("toxic", s).count() > 0


def test_buckets_stay_disjoint_and_whole(done):
    engine, states = done
    rows = states["toxic"].rows
    assert rows.count() == rows.select("doc_id").distinct().count() == engine.table.filter("lang = 'en' and text <> ''").count()
    assert rows.filter("bucket = 'selected' and not label").count() == 0 and rows.filter("annotated").count() == 20


def test_trace_and_reports(spark, done, tmp_path):
    engine, states = done
    trace = engine.trace(states)
    assert sum(t["chosen"] for t in trace) == 1 and all(t["L_static"] == pytest.approx(t["L_subj"] + t["L_obj"]) for t in trace)
    assert overview(spark, states, engine.config).count() == 1 and rounds(spark, states).count() == 1 and average_loss(states, engine.config) >= 0
    assert set(payload(engine, states)) == {"seconds", "usage", "trace", "L_avg", "certificates", "rounds", "bytes"}
    listed = selected_rules(spark, engine, states).collect()
    assert len(listed) == len(states["toxic"].rules) and all(int(r.accepted) >= 0 and r.text for r in listed)
    assert usage_report(spark, {"a": {"calls": 1}, "b": {"calls": 2}}).filter("run = 'all' and calls = '3'").count() == 1
    assert footprint(engine.table) > 0
    everywhere = engine.answer_over(spark.read.parquet(f"{DATA}/documents.parquet"), states["toxic"])
    assert engine.answer("toxic", states["toxic"]).join(everywhere, "doc_id", "left_anti").filter("doc_id is null").count() == 0
    assert everywhere.count() >= apply_rules(states["toxic"].rows, states["toxic"].rules).filter("predicted = 1").count()


def test_proposals_prefilters_and_certificates_are_kept(spark, tmp_path):
    """A second run asks the backend for neither, and takes the certificates as they are."""
    engine = demonstration_engine(spark, DATA)
    engine.queries, engine.store = {"toxic": lexicon.toxic_query()}, StateStore(spark, str(tmp_path / "state"))
    engine.pseudo_labels = PseudoLabelCache(str(tmp_path / "pseudo"))
    first = engine.run(True)["toxic"]
    asked = []

    class Counted(type(engine.backend)):
        def propose(self, *args):
            asked.append("propose")
            return super().propose(*args)

        def prefilter(self, *args):
            asked.append("prefilter")
            return super().prefilter(*args)

    engine.backend.__class__ = Counted
    again = engine.run(True)["toxic"]
    assert not asked and again.certificate == first.certificate and again.f1_bound == first.f1_bound and again.rules == first.rules
    engine.config = replace(engine.config, delta=0.3)
    assert engine._held_certificates() is None


def test_experiments_with_certificates(done):
    engine, _ = done
    experiment = Experiment(replace(engine, config=replace(engine.config, dynamic_setting=(1.0,))), {"b_rew": [3]}, ("L_obj",), "LAST", True)
    rows = experiment.rows()
    assert len(rows) == 1 and 0 <= rows[0]["bound"] <= 1 and experiment.payloads[0]["settings"] == {"b_rew": 3}


def test_drift_groups_keep_views_and_a_journal(spark, tmp_path):
    engine = demonstration_engine(spark, DATA)
    engine.queries = {"toxic": lexicon.toxic_query(), "again": lexicon.toxic_again()}
    engine.truth["again"] = engine.truth["toxic"]
    for fresh in (True, False):
        out = run_group(engine, "g", [("toxic", "again")], "align", str(tmp_path), fresh)
        assert [(r["first"], r["second"], r["route"], r["relation"]) for r in out] == [("toxic", "again", "reuse", "same")]
    assert spark.read.json(str(tmp_path / "journal")).count() == 2
    assert state_path("r", "g", "q", engine) != state_path("r", "g", "q", replace(engine, config=replace(engine.config, b_lab=9)))


def test_a_round_moves_the_certificate(done):
    r = done[1]["toxic"].rounds[0]
    assert r["candidates"] > 0 and 0 < r["data_error"] < 1 and 0 <= r["bound"] <= 1 and r["threshold"] > 0


def test_the_static_filter_reaches_the_scan(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = lexicon.backend().extract(B.initialise(docs, lexicon.toxic_query(), "q"), [lexicon.DERIVED["n_insults"]])
    plan = apply_rules(rows, [[("n_insults", 0.5, ">")]]).filter("predicted = 1").select("doc_id")._jdf.queryExecution().executedPlan().toString()
    assert "lang" in plan.split("PushedFilters")[1].split("]")[0] and "Python" not in plan and "Exchange" not in plan


def test_drift(spark, done, tmp_path):
    engine, states = done
    view = View.of(engine, states["toxic"])
    view.save(str(tmp_path / "view"))
    view = View.load(spark, str(tmp_path / "view"), view.query)
    other = demonstration_engine(spark, DATA)
    other.queries = {"again": lexicon.toxic_again(), "junk": lexicon.junk_query(), "both": lexicon.toxic_and_junk()}
    both = other.truth["toxic"].join(other.truth["junk"], "doc_id", "left_semi")
    other.truth = {"again": other.truth["toxic"], "junk": other.truth["junk"], "both": both}
    assert route(other, "again", view, "align").route == "reuse" and route(other, "again", view, "reuse").quality.f1 > 0.8
    assert route(other, "again", view, "selective").relation == "same"
    narrowed = route(other, "both", view, "align")
    assert narrowed.route == "narrowed" and narrowed.row("toxic", "both", "align")["mode"] == "align"
    assert valid_rules([[("doc_id", 1.0, ">")]], ["doc_id"]) and not valid_rules([[("x", 1.0, ">")]], ["doc_id"]) and len(MODES) == 4
    with pytest.raises(ValueError):
        route(other, "again", view, "other")


def test_without_enrichment_or_predicates(spark):
    engine = demonstration_engine(spark, DATA, enable_enrich=False, enable_coreset_expansion=False)
    engine.queries = {"toxic": lexicon.toxic_query()}
    state = engine.run_query("toxic", engine.partition())
    assert state.attempts and state.translation.omega > 0
    engine.queries, engine.truth = {"all": SemCQ(("doc_id",))}, {"all": engine.table.select("doc_id")}
    assert engine.without_rewrite("all").count() == engine.table.count()


def test_stream_is_answered_by_rules(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    source = str(tmp_path / "in")
    docs.repartition(3).write.parquet(source)
    feed = Feed(lambda b: lexicon.backend().extract(b, [lexicon.DERIVED["n_insults"]]), [[("n_insults", 0.5, ">")]], str(tmp_path / "out"))
    feed.start(spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(source), str(tmp_path / "c")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == docs.filter(F.lower("text").rlike(lexicon.INSULTS)).count() and sum(feed.sizes) == docs.count() and len(feed.sizes) == 3


def test_event_time_windows(spark, tmp_path):
    events = spark.read.parquet(f"{DATA}/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    counted = windowed_counts(stream, "ts", "event_type", "1 day").writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    counted.awaitTermination()
    assert spark.table("windows").agg(F.sum("count")).first()[0] == events.count()
