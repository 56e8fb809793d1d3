import json
import threading
import urllib.error
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

import lucerna.sources.backends as backends
from lucerna.model import FeatureSpec, Kind, Modality, SemPredicate
from lucerna.operators.features import FeatureCache
from lucerna.plans import lexicon, scenarios
from lucerna.sources.backends import Endpoint, HttpBackend, ReplayBackend, answer_schema, ask, checked, conservative, described, message, parse_answer, retry_wait


@pytest.fixture(scope="module")
def server():
    """A stub of an OpenAI-compatible server: true for texts with an a; every text's first call fails."""
    seen: dict[str, int] = {}

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            asked = body["messages"][-1]["content"]
            seen[asked] = seen.get(asked, 0) + 1
            if seen[asked] == 1 and "flaky" in asked:
                self.send_response(503)
                self.end_headers()
                return
            if "Audit" in asked:
                answer = json.dumps({"value": ["n_a", "n_b", "has_a"]})
            elif "redundant" in asked:
                answer = json.dumps({"value": ["n_b"]})
            elif "Propose" in asked:
                listed = [{"name": n, "question": f"{n}?", "type": "int"} for n in ("n_a", "n_b", "n_wild")]
                answer = json.dumps({"value": [*listed, {"name": "odd", "question": "?", "type": "list"}, '{"name": "has_a", "question": "Any a?", "type": "bool"}', 5]})
            elif "Group the relevant" in asked:
                answer = "{'value': {'0': ['k', 'nowhere']}}".replace("'", '"')
            elif "How do they relate" in asked:
                first, second = asked.split("Second query: ")
                pairs = {scenarios.queries_of("mmqa", [b])[b].semantics[0].condition: c for b, c in scenarios.PARAPHRASES.values()}
                same = any(a in first and b in second.split(".\nHow")[0] for a, b in pairs.items())
                answer = json.dumps({"value": "same" if same else "contained" if "n_chars" in second and "n_chars" not in first else "unknown"})
            elif "Can these columns alone" in asked:
                answer = json.dumps({"value": "n_a" in asked})
            elif "Give rules" in asked:
                answer = json.dumps({"value": [[{"feature": "n_a" if "n_a" in asked else "zz", "op": ">", "threshold": 1}]]})
            elif "certainly" in asked:
                answer = json.dumps({"value": [{"fields": ["k"], "op": ">", "values": [0]}, {"fields": ["zz"], "op": "==", "values": [1]}]})
            else:
                answer = "```json\n" + str({"value": "a" in asked.split("Text:")[-1]}).replace("'", '"') + "\n```"
            reply = json.dumps({"choices": [{"message": {"content": answer}}], "usage": {"prompt_tokens": 7, "completion_tokens": 2}}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(reply)

        def log_message(self, *args):
            pass

    httpd = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=httpd.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{httpd.server_port}", seen
    httpd.shutdown()


def test_answers_are_parsed():
    assert parse_answer("True", Kind.BOOL) is True and parse_answer(' {"value": "false"} ', Kind.BOOL) is False
    assert parse_answer('{"value": True}', Kind.BOOL) is True and parse_answer('{"value": 3}', Kind.INT) == 3 and parse_answer("2.5", Kind.FLOAT) == 2.5
    with pytest.raises(ValueError):
        parse_answer("perhaps", Kind.BOOL)
    assert [retry_wait(a) for a in (0, 1, 4, 9)] == [1, 2, 16, 30] and "doubt" in conservative("x")
    assert message("p", b"\x00", Modality.IMAGE)[1]["content"][0]["text"] == "p" if not _has_pillow() else True


def _has_pillow():
    try:
        import PIL  # noqa: F401
    except ImportError:
        return False
    return True


def test_http_backend(spark, server):
    url, seen = server
    http = HttpBackend(Endpoint(url, "stub", input_cost=1.0, output_cost=2.0), partitions=2)
    df = spark.createDataFrame([(1, "banana"), (2, "fig"), (3, "banana"), (4, None)], "k int, t string")
    out = http.extract(df, [FeatureSpec("t", "Text", "has_a", "Is there an a?", "bool")])
    assert {r.k: r.has_a for r in out.collect()} == {1: True, 2: False, 3: True, 4: None}
    assert http.usage()["calls"] == 2 and http.usage()["cost"] == pytest.approx((14 + 8) / 1e6)
    v = spark.createDataFrame([(1, "fig, banana"), (2, "fig"), (3, "")], "k int, t string")
    out = http.extract(v, [FeatureSpec("t", "VectorText", "any_a", "Is there an a?", "bool")])
    assert {r.k: r.any_a for r in out.collect()} == {1: True, 2: False, 3: False}
    p = SemPredicate("t", "Text", "good")
    assert [(s.target, s.kind) for s in http.propose(p, ["t"], 3)] == [("n_a", Kind.INT), ("has_a", Kind.BOOL)] and http.propose(p, ["t"], 0) == []
    http.reset_usage()
    assert http.usage()["calls"] == 0
    groups = http.prefilter(lexicon.toxic_query(), df)
    assert [[str(p) for p in g] for g in groups] == [["k > 0"]]
    assert any("Relevant columns" in a and ": k\n" in a for a in seen if isinstance(a, str))


def test_drift_questions_to_an_endpoint(server):
    """The seven paraphrases are found to be the same, a narrower query contained, any other answer apart."""
    http, new = HttpBackend(Endpoint(server[0], "stub")), scenarios.paraphrased()
    for name, (first, _) in scenarios.PARAPHRASES.items():
        assert http.relate(new[name], scenarios.queries_of("mmqa", [first])[first]) == "same"
    assert len(scenarios.PARAPHRASES) == 7 and http.relate(lexicon.junk_query(), lexicon.toxic_query()) == "contained"
    assert http.relate(lexicon.toxic_query(), lexicon.junk_query()) == "neither"
    asked = http.usage()["calls"]
    assert http.relate(lexicon.toxic_query(), lexicon.toxic_query()) == "same" and http.usage()["calls"] == asked
    assert http.supports(lexicon.toxic_query(), ["n_a"]) and not http.supports(lexicon.toxic_query(), ["b"])
    assert http.regenerate(lexicon.toxic_query(), ["n_a"]) == [[("n_a", 1.0, ">")]] and http.regenerate(lexicon.toxic_query(), ["b"]) is None


def test_messages_of_vectors_and_metadata():
    texts = message("Any?", list("abcdefg"), Modality.VECTOR_TEXT, [{"film": "x", "year": None}, {}])[1]["content"]
    assert texts.count("Text:") == 5 and "About it: film = x\nText:\na" in texts and "year" not in texts and "\ng" not in texts
    assert described({}) == described(None) == "" and answer_schema(Kind.INT)["json_schema"]["schema"]["properties"]["value"] == {"type": "integer"}
    assert checked({"fields": ["a"], "op": "==", "values": [1, 2]}) == (["a"], "==", [1, 2])
    for wrong in ({"fields": [], "op": "==", "values": [1]}, {"fields": ["a"], "op": ">", "values": [1, 2]}, {"fields": ["a"], "op": ">", "values": []}):
        with pytest.raises(ValueError):
            checked(wrong)


def test_unanswered_values_are_asked_again(spark, monkeypatch, tmp_path):
    """What a failing endpoint doesn't answer is null for now, and not kept."""
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, t string")
    spec, cache = FeatureSpec("t", "Text", "x", "x?", "bool"), FeatureCache(str(tmp_path))

    class Half(ReplayBackend):
        pass

    some = Half(spark.createDataFrame([("a", True)], "t string, x boolean"), "t")
    assert {r.k: r.x for r in cache.materialise(df, spec, some).collect()} == {1: True, 2: None}
    every = Half(spark.createDataFrame([("a", False), ("b", False)], "t string, x boolean"), "t")
    assert {r.k: r.x for r in cache.materialise(df, spec, every).collect()} == {1: True, 2: False}


def test_retries(server, monkeypatch):
    url, seen = server
    waits = []
    value, n_in, _ = ask(Endpoint(url, "stub"), message("flaky", "an apple", Modality.TEXT), Kind.BOOL, waits.append)
    assert value is True and waits == [1.0] and n_in == 7
    monkeypatch.setattr(backends, "ask_once", lambda *a: (_ for _ in ()).throw(urllib.error.URLError("down")))
    assert ask(Endpoint(url, "stub", retries=2), [], Kind.BOOL, waits.append)[0] is None and len(waits) == 3


def test_lexical_and_replay(spark):
    df = spark.createDataFrame([(1, "You IDIOT!"), (2, "fine"), (3, None)], "k int, text string")
    lex = lexicon.backend()
    spec = FeatureSpec("text", "Text", "bad", lexicon.TOXIC.prompt, "bool")
    out = lex.extract(df, [spec, lexicon.DERIVED["n_exclaims"]])
    assert {r.k: (r.bad, r.n_exclaims) for r in out.collect()} == {1: (True, 1), 2: (False, 0), 3: (False, 0)}
    again = ReplayBackend(out, "text").extract(df, [spec])
    assert {r.k: r.bad for r in again.collect()} == {1: True, 2: False, 3: False}
    with pytest.raises(ValueError):
        lex.extract(df, [FeatureSpec("text", "Text", "x", "unknown?", "bool")])
    assert lex.relate(lexicon.toxic_again(), lexicon.toxic_query()) == "same" and lex.relate(lexicon.toxic_and_junk(), lexicon.toxic_query()) == "contained"
    assert lex.relate(lexicon.junk_query(), lexicon.toxic_query()) == "neither" and not lex.supports(lexicon.junk_query(), ["text"])
    plan = out.filter(F.col("bad"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan
