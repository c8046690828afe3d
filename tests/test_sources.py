"""Rules files, snapshots, kept indexes."""

import json

from plinth.operators import degree, retrieval
from plinth.sources import rules

YAML = """
courses: {W 1: {units: 1.5}, W 2: {}, W 3: null}
groups:
- {id: a, type: all_of, members: [W 1, {one_of: [W 2, W 3]}]}
- {id: b, type: units_from, units_required: 6, options: [W 4]}
conditionals:
- {id: n, when: {taken: W 2}, effects: [{ineligible: W 4}, {modify_group: {id: b, set_options: [W 5], add_pattern: {subject: W}}}]}
credit_exclusions: [{set: [W 1, V 1], source: x}]
prerequisites: {W 4: {prereq: {all_of: [W 1]}, source: said, coreq: W 2, coreq_source: too}, W 5: null}
"""


def test_rules_file(tmp_path):
    (tmp_path / "r.yaml").write_text(YAML)
    p = rules.read_program(f"{tmp_path}/r.yaml")
    assert (p.named, p.units, p.exclusions) == (("W 1", "W 2", "W 3"), {"W 1": 1.5}, (("W 1", "V 1"),))
    slots, ineligible, applied = degree.requirements(p, {"W 2"})
    assert [(s.group, sorted(s.options), s.units) for s in slots] == [("a", ["W 1"], None), ("a", ["W 2", "W 3"], None), ("b", ["W 5"], 6.0)]
    assert (ineligible, applied) == ({"W 4"}, ["n"]) and slots[2].label == "6.0u from ['W 5'] or {'subject': 'W'}"
    assert p.prerequisites["W 4"] == degree.Prerequisite({"all_of": ["W 1"]}, "said", "W 2", "too") and p.prerequisites["W 5"] == degree.Prerequisite()
    (tmp_path / "e.yaml").write_text("")
    assert rules.read_program(f"{tmp_path}/e.yaml") == degree.Program((), ())


def test_snapshot_document(spark, tmp_path):
    data = {"snapshot_date": "2027-01-02", "term_order": ["Winter Term 2027", "Fall Term 2027"], "courses": {"W 1": {"units": 3, "subject": "W", "level": 100, "terms": ["Fall Term 2027"]}, "W 2": {}}}
    (tmp_path / "s.json").write_text(json.dumps(data, indent=1))
    rows = {r["course_id"]: r for r in rules.read_snapshot(spark, f"{tmp_path}/s.json").collect()}
    assert (rows["W 1"]["units"], rows["W 1"]["level"], rows["W 1"]["terms"], rows["W 1"]["snapshot_id"]) == (3.0, 100, ["Fall Term 2027"], "2027-01-02")
    assert (rows["W 2"]["units"], rows["W 2"]["terms"]) == (0.0, [])
    assert [tuple(r) for r in rules.read_terms(spark, f"{tmp_path}/s.json").select("term", "ord", "season").orderBy("ord").collect()] == [("Winter Term 2027", 0, "Winter"), ("Fall Term 2027", 1, "Fall")]


def test_kept_index(spark, tmp_path):
    docs = spark.createDataFrame([("a", "red loom red"), ("b", "blue wheel"), ("c", None)], "id string, text string")
    tf = retrieval.term_frequencies(docs, "id", "text")
    idf = retrieval.inverse_frequencies(tf, "id", 3)
    rules.save_index(f"{tmp_path}/i", docs, retrieval.weights(tf, idf, "id"), idf, size=1024, kind="hashed")
    kept = rules.load_index(spark, f"{tmp_path}/i")
    asked = retrieval.weights(retrieval.term_frequencies(spark.createDataFrame([("q", "a red thing")], "q string, text string"), "q", "text"), kept["idf"], "q")
    assert kept["weights"].withColumnRenamed("w", "v").join(asked, "bucket").groupBy("id").count().first()["id"] == "a"
    assert {r["name"]: r["value"] for r in kept["meta"].collect()} == {"kind": "hashed", "size": "1024"}


def test_search_in_blocks(spark, monkeypatch):
    docs = spark.createDataFrame([("a", "red loom red"), ("b", "blue wheel"), ("c", None), ("d", "loom wheel")], "id string, text string")
    asked = spark.createDataFrame([("p", "loom"), ("q", "wheel red"), ("r", ""), ("s", "nothing alike")], "q string, text string")
    want = sorted(tuple(r) for r in retrieval.search(docs, asked, "id", "q", k=2).collect())
    assert {r[0] for r in want} == {"p", "q"} and [r[1] for r in want if r[0] == "p"] == ["a", "d"] or [r[1] for r in want if r[0] == "p"] == ["d", "a"]
    monkeypatch.setattr(retrieval, "QUERIES", 1)
    assert sorted(tuple(r) for r in retrieval.search(docs, asked, "id", "q", k=2).collect()) == want
