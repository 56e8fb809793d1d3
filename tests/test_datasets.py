import json

from lucerna.model import TableRoles
from lucerna.plans import scenarios
from lucerna.plans.experiments import chosen_rounds, collect, grid, nested
from lucerna.sources.datasets import StateStore, append_journal, existing_files, filled, flat_structs, ground_truth, load_dataset, result_table, roles_from, run_path, save_csv, scan_images


def test_data_set_with_roles(spark, tmp_path):
    (tmp_path / "ground_truth").mkdir()
    (tmp_path / "config.yaml").write_text(json.dumps({"base_features": ["age"], "id_features": ["pid"], "foreign_keys": ["note"]}))
    (tmp_path / "data_full.csv").write_text('pid,age,note,extra\n1,30,"a ""b"",\nc",x\n2,,,y\n')
    (tmp_path / "ground_truth" / "Q1.csv").write_text("pid,other\n1,a\n1,b\n")
    df, roles = load_dataset(spark, str(tmp_path))
    assert roles == TableRoles(("age",), ("pid",), ("note",)) == roles_from(df.select("note", "pid", "age"))
    assert {r.pid: (r.age, r.note) for r in filled(df).collect()} == {1: (30, 'a "b",\nc'), 2: (None, "")}
    assert ground_truth(spark, str(tmp_path), "Q1", ["pid"]).collect() == [(1,)]


def test_images_and_structs(spark, tmp_path):
    (tmp_path / "a.jpg").write_bytes(b"\x01\x02")
    (tmp_path / "b.txt").write_bytes(b"no")
    files = scan_images(spark, str(tmp_path))
    assert [bytes(r.content) for r in files.collect()] == [b"\x01\x02"]
    rows = spark.createDataFrame([(files.first().path,), ("gone",)], "path string")
    assert existing_files(rows, "path", files).count() == 1
    nested_rows = spark.createDataFrame([(("shoe", 1), (2,), [1, 2])], "m struct<typeName:string,id:int>, o struct<z:int>, a array<int>")
    assert flat_structs(nested_rows).first() == ("shoe", '{"z":2}', "[1,2]")


def test_sinks(spark, tmp_path):
    table = result_table(spark, [{"a": 1, "b": [1]}, {"c": "x"}])
    assert table.columns == ["a", "b", "c"] and table.collect() == [("1", "[1]", None), (None, None, "x")]
    save_csv(table, str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out"), header=True).count() == 2
    for i in range(2):
        append_journal(spark, str(tmp_path / "journal"), [{"i": i}])
    assert sorted(r.i for r in spark.read.json(str(tmp_path / "journal")).collect()) == [0, 1]
    store = StateStore(spark, str(tmp_path / "state"))
    assert store.get("k") is None
    store.put("k", {"x": 1})
    assert store.get("k") == {"x": 1} and store.get("k", lambda v: "y" in v) is None and StateStore(spark, str(tmp_path / "state"), False).get("k") is None
    assert run_path("r/", "g", "s", {"b": 1, "a": 2}, (0.5, 1.0)) == "r/g/s/a=2/b=1/steps=0.5-1"


def test_grids_and_scenarios():
    assert list(grid({"a": [1, 2], "b": [3]})) == [{"a": 1, "b": 3}, {"a": 2, "b": 3}] and list(grid({})) == [{}]
    trace = [{"query": "q", "candidate": i, "e": {"f1": i}} for i in range(3)]
    assert nested(trace[1], "e.f1") == 1 and nested(trace[1], "e.x.y") is None
    assert [r["e.f1"] for r in collect(trace, ["e.f1"], "LAST")] == [2] and len(chosen_rounds(trace, [0, 9])) == 1
    assert sum(map(len, scenarios.SCENARIOS.values())) == 17 and len(scenarios.paraphrased()) == 7
    assert scenarios.truth_name("Q3a_p") == "Q3a" and set(scenarios.queries_of("mmqa", ["Q3a_p"])) == {"Q3a_p"}
    assert all(a in scenarios.SCENARIOS["mmqa"] for pairs in scenarios.DRIFT_GROUPS.values() for a, _ in pairs)
