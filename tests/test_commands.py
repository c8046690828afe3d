"""The commands of the package."""

import json

from plinth.__main__ import main


def test_list_and_route(spark, capsys):
    assert main(["list"]) == 0 and "validate_union" in capsys.readouterr().out.split()
    assert main(["route", "Is CMPUT 174 offered in Fall Term 2026?"]) == 0
    assert capsys.readouterr().out.strip() in ("rag", "cag", "compound")


def test_run(spark, sf_dir, capsys, tmp_path):
    assert main(["run", "counts_by_type", sf_dir]) == 0 and "assistant" in capsys.readouterr().out
    assert main(["run", "counts_by_type", sf_dir, "--out", f"{tmp_path}/o"]) == 0
    assert spark.read.parquet(f"{tmp_path}/o").count() > 0
    assert main(["explain", "counts_by_type", sf_dir]) == 0


def test_validate(spark, tmp_path, capsys):
    (tmp_path / "plans").mkdir()
    (tmp_path / "plans" / "a.plan.yaml").write_text("plan_id: x\nterms:\n- term: Fall Term 2026\n  courses: [CMPUT 174, CMPUT 174]\n")
    (tmp_path / "offered.json").write_text(json.dumps({"course": "CMPUT 174", "term": "Fall Term 2026", "subject": "CMPUT", "level": 100, "units": 3.0}))
    assert main(["validate", f"{tmp_path}/plans", f"{tmp_path}/offered.json"]) == 1
    out = capsys.readouterr().out
    assert out.startswith("x: invalid") and "duplicate_course: course credited more than once [CMPUT 174]" in out


def test_solve(spark, tmp_path, capsys):
    from plinth.plans.degrees import CATALOGUE, SEASONS

    lines = [json.dumps({"course": c, "term": f"{s} Term 2026", "subject": CATALOGUE[c][0], "level": CATALOGUE[c][1], "units": 3.0}) for c in SEASONS for s in SEASONS[c]]
    (tmp_path / "offered.json").write_text("\n".join(lines))
    assert main(["solve", f"{tmp_path}/offered.json", "--taken", "CMPUT 174, MATH 125"]) == 0
    (tmp_path / "plans").mkdir()
    (tmp_path / "plans" / "s.plan.yaml").write_text(capsys.readouterr().out)
    assert main(["validate", f"{tmp_path}/plans", f"{tmp_path}/offered.json"]) == 0 and "shortest: valid" in capsys.readouterr().out
    assert main(["solve", f"{tmp_path}/offered.json", "--horizon", "2"]) == 1 and "no plan within 2 terms" in capsys.readouterr().out
    (tmp_path / "gold.yaml").write_text("courses: {W 1: {units: 3}}\ngroups:\n- {id: g, type: all_of, members: [W 1]}\n")
    (tmp_path / "w.json").write_text(json.dumps({"course": "W 1", "term": "Winter Term 2026", "subject": "W", "level": 100, "units": 3.0}))
    assert main(["solve", f"{tmp_path}/w.json", "--gold", f"{tmp_path}/gold.yaml"]) == 0 and "Term 2 (Winter)" in capsys.readouterr().out


def test_parse_and_report(spark, tmp_path, capsys):
    from test_courses import page

    (tmp_path / "pages").mkdir()
    (tmp_path / "pages" / "GEOL__341.html").write_text(page())
    (tmp_path / "pages" / "ART__9.html").write_text("<h1>ART 9</h1>")
    assert main(["parse", f"{tmp_path}/pages", f"{tmp_path}/out"]) == 0 and "2 courses, 2 with flags" in capsys.readouterr().out
    text = (tmp_path / "out" / "report.md").read_text()
    for line in ("- Courses: 2", "- Sections: 4", "- GEOL 341: parsed 4, stated 7", "- section-count-mismatch (1): GEOL 341: [GEOL 341] section-count-mismatch: parsed=4 meta=7", "- orphan-time-col (1): ", "- missing-description (1): ART 9"):
        assert line in text, (line, text)
    assert text.index('"course_id":"GEOL 341"') < text.index('"course_id":"ART 9"')
    assert {r["course_id"] for r in spark.read.json(f"{tmp_path}/out/courses").collect()} == {"GEOL 341", "ART 9"}


def test_index_evaluate_drift(spark, tmp_path, capsys):
    from plinth.sources.snapshots import Store

    (tmp_path / "t.json").write_text("\n".join(json.dumps({"id": k, "text": t}) for k, t in (("a", "red loom"), ("b", "blue wheel"))))
    assert main(["index", f"{tmp_path}/t.json", f"{tmp_path}/i"]) == 0 and main(["search", f"{tmp_path}/i", "a red thing", "-k", "1"]) == 0
    assert capsys.readouterr().out.startswith("1. a (")
    (tmp_path / "a.json").write_text(json.dumps({"config": "routed", "id": "1", "type": "plan_validity", "quality": 1.0, "citation_ok": True, "cost_usd": 0.5, "hit_tokens": 1, "prompt_tokens": 2, "latency_s": 1.0}))
    assert main(["evaluate", f"{tmp_path}/a.json", f"{tmp_path}/e", "--snapshot", "s"]) == 0 and "| quality_overall | 1.0000 |" in (tmp_path / "e" / "report.md").read_text()
    store = Store(spark, f"{tmp_path}/s")
    for v in (1, 2):
        store.write(spark.createDataFrame([("x", v), ("y", 5)], "k string, v int"), "c")
    assert main(["drift", f"{tmp_path}/s", "c@1", "c", "--keys", "k", "--value", "v"]) == 0 and capsys.readouterr().out == "x: 1 -> 2\n"
