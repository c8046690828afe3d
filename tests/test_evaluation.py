"""Questions under three configurations, and grades."""

import pytest

from plinth.operators import degree, evaluation, grading
from plinth.plans.program import PROGRAM
from plinth.sources import documents

SPANS = [("A::course", "[A::course] CMPUT 174 Fall Term 2026 prerequisite none", "CMPUT 174 CMPUT 174 offered in Fall Term 2026"), ("B::course", "[B::course] MATH 125", "MATH 125 lines")]
RULES = "[prereq:CMPUT 204] CMPUT 175 or 275\n[group:core] all"


@pytest.fixture(scope="module")
def answered(spark):
    q = documents.questions(spark, [("CMPUT 174", "Fall Term 2026"), ("MATH 125", "Spring Term 2026")], ["CMPUT 204", "STAT 265"])
    return evaluation.answers(q, spark.createDataFrame(SPANS, "id string, text string, embed_text string"), RULES, k=1)


def test_answers(answered):
    got = {(r["config"], r["id"]): r for r in answered.collect()}
    assert len(got) == 12
    assert {r["route"] for (c, _), r in got.items() if c == "rag_always"} == {"rag"}
    assert got["routed", "factual_offered_000"]["route"] == "rag" and got["routed", "factual_prereq_000"]["route"] == "cag"
    assert got["rag_always", "factual_offered_000"]["answer"].endswith("[A::course] CMPUT 174 Fall Term 2026 prerequisite none")
    assert got["cag_always", "factual_offered_000"]["clauses"] == ["prereq:CMPUT 204"]
    assert got["rag_always", "factual_offered_000"]["span_ids"] == ["A::course"]
    assert all(r["cost_usd"] > 0 for r in got.values())


def test_grades(spark):
    kind = "config string, id string, course string, term string, answer string, clauses array<string>, plan string"
    rows = [
        ("c", "1", "CMPUT 174", "Fall Term 2026", "Yes, it runs at 9:00.", [], None),
        ("c", "2", "CMPUT 174", "Spring Term 2026", "It is not offered in Spring Term 2026.", [], None),
        ("c", "3", "CMPUT 174", "Fall Term 2026", "perhaps", [], None),
    ]
    offered = spark.createDataFrame([("CMPUT 174", "Fall Term 2026")], "course string, term string")
    facts = spark.createDataFrame([("CMPUT 174", ["Fall Term 2026"], ["09:00"])], "course string, terms array<string>, times array<string>")
    got = {r["id"]: (r["quality"], r["citation_ok"]) for r in evaluation.grade_offered(spark.createDataFrame(rows, kind), offered, facts).collect()}
    assert got == {"1": (1.0, True), "2": (1.0, False), "3": (0.0, True)}
    rows = [
        ("c", "1", "CMPUT 204", None, "CMPUT 175 and CMPUT 272", [], None), ("c", "2", "CMPUT 204", None, "CMPUT 275, CMPUT 272, MATH 134", ["prereq:CMPUT 204"], None),
        ("c", "3", "STAT 265", None, "None.", ["prereq:MATH 1"], None), ("c", "4", "STAT 265", None, "CMPUT 174", [], None), ("c", "5", "CMPUT 355", None, "CMPUT 201", [], None),
    ]
    got = {r["id"]: (round(r["quality"], 3), r["citation_ok"]) for r in evaluation.grade_prereq(spark.createDataFrame(rows, kind), PROGRAM).collect()}
    assert got == {"1": (0.667, True), "2": (1.0, True), "3": (1.0, False), "4": (0.5, True), "5": (1.0, True)}
    rows = [("c", str(k), None, None, a, [], "p" if k < 3 else "q") for k, a in enumerate(["This is valid.", "It does not satisfy the rules", "hm", "The plan is invalid"])]
    verdicts = spark.createDataFrame([("p", True), ("q", False)], "plan string, valid boolean")
    assert [r["quality"] for r in evaluation.grade_validity(spark.createDataFrame(rows, kind), verdicts).orderBy("id").collect()] == [1.0, 0.0, 0.0, 1.0]


def test_plans_in_answers(spark):
    texts = [
        ("a", "text\n```yaml\nterms:\n- {name: First, course: A 1}\n- junk\n- {term: Winter 2027, courses: [B 2, null, 'C 3']}\n```"),
        ("b", "no plan: ["), ("c", None), ("d", "```json\n{\"other\": 1}\n```\n```\nterms: [{term: Fall, courses: A 1}]\ntaken: [T 9]\n```"), ("e", "terms:\ntaken: T 1"), ("f", "{}"),
    ]
    asked = spark.createDataFrame(texts, "id string, answer string")
    got = sorted(((r["plan"], r["term_idx"], r["term"], r["pos"], r["course"]) for r in evaluation.plans_in(asked).collect()), key=str)
    assert got == [("a", 0, "Fall (plan term 1)", 0, "A 1"), ("a", 1, "Winter 2027", 0, "B 2"), ("a", 1, "Winter 2027", 1, "C 3"), ("d", -1, None, 0, "T 9"), ("d", 0, "Fall", 0, "A 1"), ("e", -1, None, 0, "T 1")]
    assert sorted(r["id"] for r in evaluation.with_plan(asked).collect()) == ["a", "d", "e"]
    rows = spark.createDataFrame([("c", "1", "terms:\n- term: Fall\n  courses: [CMPUT 174]", ["MATH 125"]), ("c", "2", "none", None)], "config string, id string, answer string, taken array<string>")
    plans = evaluation.plans_in(rows, "id", "answer", "taken")
    assert [(r["term_idx"], r["course"]) for r in plans.orderBy("term_idx").collect()] == [(-1, "MATH 125"), (0, "CMPUT 174")]
    assert documents.plan_text(plans).first()["text"] == "Already completed: MATH 125. Fall: CMPUT 174"
    offered = spark.createDataFrame([("CMPUT 174", "Fall Term 2026")], "course string, term string")
    graded = evaluation.grade_construction(rows, PROGRAM, {"CMPUT 174": ("CMPUT", 100, 3.0)}, offered, "taken").collect()
    assert {r["id"]: r["quality"] for r in graded} == {"1": 0.0, "2": 0.0}


def test_odd_answers_stop_nothing(spark):
    loop = "a: &a [*a]\nterms: *a"
    said = ["terms: 2026-13-45", "terms:\n- {2026-01-01: x, term: Fall, courses: [A 1, 2026-01-02]}", "```yaml\nterms: 2026-13-45\n```\n```yaml\nterms: [{term: Fall, course: B 2}]\n```", loop, "? [a, b]\n: terms", "terms: !!python/object:x {}", "\x00", "1: 2\nterms: {1: 2}"]
    rows = spark.createDataFrame([(str(k), x) for k, x in enumerate(said)], "id string, answer string")
    got = sorted((r["plan"], r["course"]) for r in evaluation.plans_in(rows).collect())
    assert got == [("1", "2026-01-02"), ("1", "A 1"), ("2", "B 2")]


def test_plan_files(spark, tmp_path):
    (tmp_path / "a.plan.yaml").write_text("plan_id: x\nextra: 1\ntaken: [T 1]\nterms:\n- term: Fall\n  courses: [A 1, B 2]\n")
    (tmp_path / "b.plan.yaml").write_text("expected: valid\n")
    got = documents.plan_files(spark, str(tmp_path)).orderBy("term_idx", "pos").collect()
    assert [(r["plan"], r["term_idx"], r["course"]) for r in got] == [("x", -1, "T 1"), ("x", 0, "A 1"), ("x", 0, "B 2")]
    assert got and spark.createDataFrame([], degree.PLAN).columns == ["plan", "term_idx", "term", "pos", "course"]


def test_prices(spark):
    from pyspark.sql import functions as F

    assert spark.range(1).select(grading.cost(F.lit(0), F.lit(1_000_000), F.lit(0))).first()[0] == 0.14


def test_gold_and_grades_by_type(spark):
    q = [("1", "factual_offered", "CMPUT 174", "Fall Term 2026", None), ("2", "factual_offered", "CMPUT 174", "Spring Term 2026", None), ("3", "factual_prereq", "CMPUT 204", None, None), ("4", "plan_validity", None, None, "p"), ("5", "plan_validity", None, None, "q"), ("6", "riddle", None, None, None)]
    questions = spark.createDataFrame(q, "id string, type string, course string, term string, plan string")
    offered = spark.createDataFrame([("CMPUT 174", "Fall Term 2026")], "course string, term string")
    failures = spark.createDataFrame([("p", "not_offered"), ("p", "duplicate_course"), ("p", "not_offered")], "plan string, code string")
    got = {r["id"]: r for r in evaluation.gold(questions, offered, PROGRAM, failures).collect()}
    assert [got[k]["offered"] for k in "123"] == [True, False, None]
    assert got["3"]["prereq_courses"][:3] == ["CMPUT 175", "CMPUT 272", "CMPUT 275"] and got["3"]["source"].startswith("CMPUT 175 or 275")
    assert (got["4"]["valid"], got["4"]["failure_codes"], got["5"]["valid"], got["5"]["failure_codes"]) == (False, ["duplicate_course", "not_offered"], True, [])
    said = {"1": "Yes, offered.", "2": "Yes, it is offered.", "3": "CMPUT 175 and CMPUT 272", "4": "The plan is invalid", "5": "The plan is invalid", "6": "?"}
    rows = questions.where("id <> '7'").selectExpr("'c' AS config", "*").join(spark.createDataFrame([*said.items()], "id string, answer string"), "id").selectExpr("*", "cast(array() as array<string>) AS clauses", "cast(array() as array<string>) AS held")
    rows = rows.unionByName(rows.where("id = '6'").selectExpr("config", "'7' AS id", "'plan_construction' AS type", "course", "term", "plan", "'no plan' AS answer", "clauses", "held"))
    facts = spark.createDataFrame([("CMPUT 174", ["Fall Term 2026"], ["09:00"])], "course string, terms array<string>, times array<string>")
    verdicts = spark.createDataFrame([("p", False), ("q", True)], "plan string, valid boolean")
    got = {r["id"]: round(r["quality"], 3) for r in evaluation.grade(rows, offered, facts, PROGRAM, {}, verdicts, "held").collect()}
    assert got == {"1": 1.0, "2": 0.0, "3": 0.667, "4": 1.0, "5": 0.0, "6": 0.0, "7": 0.0}
