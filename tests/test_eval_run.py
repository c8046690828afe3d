"""Query sets of four types, results by configuration, files and reports of an evaluation."""

import json

import pytest

from plinth.operators import degree, eval_run, reports

ROW = "config string, type string, quality double, citation_ok boolean, cost_usd double, hit_tokens int, prompt_tokens int, latency_s double"


@pytest.fixture(scope="module")
def table(spark):
    rows = [("b", "factual_offered", 1.0, True, 0.5, 3, 4, 2.0), ("b", "factual_offered", 0.0, False, 0.25, 0, 4, 1.0), ("b", "plan_validity", 1.0, False, 0.25, 1, 2, 4.0), ("a", "plan_validity", 0.5, True, 0.5, 0, 0, None)]
    return eval_run.results(spark.createDataFrame(rows, ROW)).cache()


def test_results(table):
    got = {r["config"]: r for r in table.collect()}
    b, a = got["b"], got["a"]
    assert table.columns[:11] == ["config", "quality_overall", "factual_offered", "factual_prereq", "plan_validity", "plan_construction", "citation_pass_rate", "cost_usd_total", "latency_p50", "latency_p95", "cache_hit_rate"]
    assert (b["quality_overall"], b["factual_offered"], b["factual_prereq"], b["plan_validity"], b["citation_pass_rate"], b["cost_usd_total"], b["cache_hit_rate"], b["latency_p50"], b["n"]) == (0.6667, 0.5, None, 1.0, 0.5, 1.0, 0.4, 2.0, 3)
    assert (a["quality_overall"], a["citation_pass_rate"], a["cache_hit_rate"], a["latency_p50"]) == (0.5, None, 0.0, None)


def test_files(spark, table, tmp_path):
    eval_run.write_results(table, f"{tmp_path}/r", snapshot="s1", n_queries=4)
    data = json.loads("\n".join(p.read_text() for p in (tmp_path / "r" / "results.json").glob("part-*")))
    assert data["b"]["quality_overall"] == 0.6667 and data["a"]["latency_p50"] is None and data["meta"] == {"snapshot": "s1", "n_queries": 4}
    rows = spark.read.option("header", "true").csv(f"{tmp_path}/r/results.csv")
    assert rows.columns == list(eval_run.RESULTS) and [r["config"] for r in rows.collect()] == ["a", "b"]


def test_report(spark, table, tmp_path):
    facts = lambda *x: spark.createDataFrame([*x], "question string, value string")
    fresh = eval_run.freshness(facts(("A offered?", "yes"), ("B seats", "5"), ("C", "1")), facts(("A offered?", "no"), ("B seats", "5")), facts(("P", "r")), facts(("P", "r")))
    assert {(r["question"], r["kind"]): r["changed"] for r in fresh.collect()} == {("A offered?", "data"): True, ("B seats", "data"): False, ("C", "data"): True, ("P", "rule"): False}
    flips = spark.createDataFrame([(True,), (False,), (False,), (False,)], "flipped boolean")
    reports.write_markdown(eval_run.report(table, {"snapshot": "s1", "stub": True}, fresh, flips), f"{tmp_path}/r.md")
    text = (tmp_path / "r.md").read_text()
    for line in (
        "# Evaluation", "> Answers are a stub's", "- Best over all: b (0.667); least: 0.500", "- Best for plan_validity: b (1.000); least: 0.500", "- Cheapest: a ($0.500000 in all)", "| metric | a | b |", "| quality_overall | 0.5000 | 0.6667 |",
        "| latency_p50 | - | 2.0000 |", "| A offered? | data | yes | no | yes |", "2 of 3 data facts changed; 1 of 1 rule facts are stable.", "1 of 4 paraphrases change the route (0.25).",
    ):
        assert line in text, (line, text)
    assert "factual_prereq: " not in text and text.index("## Findings") < text.index("Best over all") < text.index("## By configuration") < text.index("| metric |") < text.index("## Freshness")
    assert eval_run.findings(table.limit(0)).collect() == []


def test_query_set(spark):
    offered = spark.createDataFrame([(0, "A 1", "Fall Term 2026")], "n int, course string, term string")
    prereq = spark.createDataFrame([(12, "B 2")], "n int, course string")
    plans = spark.createDataFrame([("p", -1, None, 0, "T 1", 3), ("p", 0, "Fall", 0, "A 1", 3), ("p", 0, "Fall", 1, "B 2", 3), ("p", 1, "Winter", 0, "C 3", 3)], f"{degree.PLAN}, n int")
    taken = spark.createDataFrame([(0, []), (1, ["A 1", "B 2"]), (2, None)], "n int, taken array<string>")
    got = {r["id"]: r for r in eval_run.query_set(offered, prereq, plans, taken).collect()}
    assert got["factual_offered_000"]["text"] == "Is A 1 offered in Fall Term 2026?" and got["factual_prereq_012"]["text"] == "What is the prerequisite for B 2?"
    assert got["plan_validity_003"]["text"].endswith("plan valid? Already completed: T 1. Fall: A 1, B 2 | Winter: C 3") and got["plan_validity_003"]["plan"] == "p"
    assert " I am starting fresh. Use" in got["plan_construction_000"]["text"] and got["plan_construction_002"]["taken"] == []
    assert " I have already completed: A 1, B 2. Use" in got["plan_construction_001"]["text"] and len(got) == 6
