"""What is shuffled and judged grows no faster than what is told apart."""

from plinth.operators import degree, evaluation, grading, rules
from plinth.plans import degrees, tables
from plinth.plans.registry import QUERIES, Tables


def test_gold_joins_each_type_alone(spark):
    rows = [("o", "factual_offered", "A 100", "Fall Term 2026", None), ("p", "factual_prereq", "A 100", None, None), ("v", "plan_validity", None, None, "1"), ("w", "plan_validity", None, None, "2"), ("x", None, None, None, None)]
    asked = spark.createDataFrame(rows, "id string, type string, course string, term string, plan string")
    offered = spark.createDataFrame([("A 100", "Fall Term 2026")], "course string, term string")
    program = degree.Program((), (), prerequisites={"A 100": degree.Prerequisite({"one_of": ["B 1", "C 2"]}, "s")})
    out = evaluation.gold(asked, offered, program, spark.createDataFrame([("2", "x")], "plan string, code string"))
    assert out._jdf.queryExecution().optimizedPlan().nodeName() == "Union"
    want = {("o", True, None, None, None, None), ("p", None, ("B 1", "C 2"), "s", None, None), ("v", None, None, None, True, ()), ("w", None, None, None, False, ("x",)), ("x", *[None] * 5)}
    assert {tuple(tuple(v) if isinstance(v, list) else v for v in (r[0], *r[2:])) for r in out.collect()} == want


def test_equal_plans_are_judged_once(spark, sf_dir, monkeypatch):
    judged, real = [], degree.validate
    monkeypatch.setattr(degree, "validate", lambda plans, *a: judged.append(plans.select("plan").distinct().count()) or real(plans, *a))
    n = QUERIES["solve_round_trip"](spark, sf_dir).count()
    assert 0 < judged[0] <= 2 ** len(degrees.OPENING) < n


def test_equal_answers_are_audited_once(spark, monkeypatch):
    audited, real = [], grading.audit
    monkeypatch.setattr(grading, "audit", lambda answers, facts: audited.append(answers.count()) or real(answers, facts))
    rows = spark.createDataFrame([("c", str(k), "AB 100", "Fall Term 2026", "Yes, in Fall Term 2027." if k % 2 else None) for k in range(100)], "config string, id string, course string, term string, answer string")
    facts = spark.createDataFrame([("AB 100", ["Fall Term 2026"], [])], "course string, terms array<string>, times array<string>")
    out = evaluation.grade_offered(rows, facts.selectExpr("course", "explode(terms) as term"), facts)
    assert sorted((int(r["id"]) % 2, r["quality"], r["citation_ok"]) for r in out.collect()) == [(0, 0.0, True)] * 50 + [(1, 1.0, False)] * 50
    assert audited == [2]


def test_nodes_without_children(spark):
    tree = spark.createDataFrame([("e", 0, None, "one_of", None, 0), ("a", 0, None, "all_of", None, 0), ("c", 0, None, "course", "x", 0)], rules.NODE)
    sets = spark.createDataFrame([(1, "x"), (2, "y")], "k int, course string")
    got = {(r["k"], r["expr_id"]): r["ok"] for r in rules.evaluate_nodes(sets, tree, "k").collect()}
    assert got == {(1, "e"): False, (1, "a"): True, (1, "c"): True, (2, "e"): False, (2, "a"): True, (2, "c"): False}


def test_plans_are_dealt_before_they_are_gathered(spark, sf_dir):
    t = Tables(spark, sf_dir)
    for rows in (tables.masks(t), degrees.scheduled(t)):
        assert rows.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism
