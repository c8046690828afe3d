"""Program pages of our own, the text of rules, reports."""

import pytest
from pyspark.sql import functions as F

from plinth.operators import degree, programs, reports, rules_text

CORE = '<div class="acalog-core"><h{0}>{1}</h{0}>{2}</div>'
COURSE = '<li class="acalog-course"><span><a href="#">{0}</a></span></li>'
PAGE = (
    "<html><head><title>Program: Weaving - University of Alberta</title></head><body><table><tr><td class='block_content'><h1>Bachelor of Arts in Weaving</h1>"
    + CORE.format(2, "Core", "<ul>" + COURSE.format("WEAV 101 - Looms") + "<li>or a loom of your own</li></ul>" + CORE.format(3, "6 units from", COURSE.format("WEAV 210A - Felt") + COURSE.format("E E 220 - Wire") + COURSE.format("see adviser")))
    + CORE.format(2, "3 units in dyes", "") + CORE.format(2, "One of the following", "<div class='left'>" + CORE.format(4, "Paths", COURSE.format("DYE 9")) + "</div>")
    + "</td></tr></table></body></html>"
)


def test_program_page(spark):
    pages = spark.createDataFrame([("7", PAGE), ("8", "<title>Program: Clay - University of Alberta</title>"), ("9", None), ("10", "<div class='block_content'><h1>Master of Clay</h1></div>")], "poid string, html string")
    got = {r["poid"]: r for r in programs.parse_programs(pages).collect()}
    assert [tuple(b) for b in got["7"]["requirement_blocks_raw"]] == [
        ("Core", "Core or a loom of your own", ["WEAV 101"]), ("Core / 6 units from", "6 units from", ["WEAV 210A", "E E 220", "see adviser"]), ("3 units in dyes", "3 units in dyes", []),
        ("One of the following", "One of the following", []), ("One of the following / Paths", None, ["DYE 9"]),
    ]
    assert (got["7"]["program_name"], got["7"]["degree"], got["7"]["parse_confidence"]) == ("Bachelor of Arts in Weaving", "BA", "needs_review")
    assert got["7"]["flags"] == ["1 unparseable course code(s) in Core / 6 units from", "rule-block-empty: 3 units in dyes"]
    assert (got["8"]["program_name"], got["8"]["flags"], got["8"]["requirement_blocks_raw"]) == ("Clay", ["no-block_content-container"], [])
    assert got["9"]["parse_confidence"] == "needs_review"
    assert (got["10"]["degree"], got["10"]["flags"]) == ("M?", ["no-acalog-core-blocks"])


def test_repeated_pages(spark):
    pages = spark.createDataFrame([("7", PAGE), ("7", PAGE), (None, PAGE), (None, None)], "poid string, html string").repartition(2)
    got = programs.parse_programs(pages).collect()
    assert sorted((r["poid"] or "", len(r["requirement_blocks_raw"]), len(r["flags"])) for r in got) == [("", 0, 1), ("", 5, 2), ("7", 5, 2), ("7", 5, 2)]
    assert programs.parse_programs(pages.limit(0)).collect() == []


def test_discovery_and_tiers(spark):
    links = [("p", 0, "x?poid=12&a", " Late\n name "), ("p", 1, "x?poid=3", "Three"), ("a", 5, "x?poid=12", "Twelve"), ("a", 6, "none", "x"), ("a", 7, None, "y")]
    rows = spark.createDataFrame(links, "page string, pos int, href string, text string")
    assert [tuple(r) for r in programs.discover(rows, ["12"]).collect()] == [("3", "Three", "silver"), ("12", "Twelve", "gold")]
    assert [r["poid"] for r in programs.discover(rows, [], most=1).collect()] == ["3"]
    files = spark.createDataFrame([("1", None), ("2", None), ("2", "bronze")], "poid string, tier string")
    assert [r["tier"] for r in programs.tiers(files, ["2"]).collect()] == ["silver", "gold", "bronze"]


def test_rules_text(spark):
    p = degree.Program(
        (), (degree.Group("a", "all_of", members=("W 1", {"one_of": ["W 2", "W 3"]})), degree.Group("b", "units_from", units=6, options=("W 4", "W 5")), degree.Group("c", "units_from_pattern", units=3, pattern={"subject": "W", "level_in": [300, 400], "level_gte": 300})),
        (degree.Conditional("n", "W 2", "W 4", "b", ("W 5",), {"subject": "W"}),), (("W 1", "V 1"),), {"W 5": degree.Prerequisite({"all_of": ["W 1", {"hs": "Art 30"}]}, "W 1 and art.", "W 4", "W 4."), "W 2": degree.Prerequisite()},
    )
    rows = rules_text.lines(spark, p, "Weaving", "2026-27", "12")
    whole = rules_text.text(rows).first()
    lines = whole["rules"].split("\n")
    assert "  [group:a] ALL of: W 1; one of (W 2, W 3)." in lines and "  [group:b] 6.0 units from: W 4, W 5." in lines
    assert "  [group:c] 3.0 units from any W 300-level/400-level >=300-level course." in lines
    assert "  [note:n] when W 2 is taken: W 4 becomes ineligible; group b -> options ['W 5'] plus any W course." in lines
    assert '  [prereq:W 5] W 1 and high-school Art 30; corequisite: W 4  (source: "W 1 and art.")' in lines and "  [prereq:W 2] none" in lines
    assert whole["clauses"] == ["group:a", "group:b", "group:c", "note:n", "prereq:W 2", "prereq:W 5"] and whole["length"] == len(whole["rules"])


def test_reports(spark, tmp_path):
    rows = spark.createDataFrame([("b", 0.5, 2), ("a", 0.25, 3)], "config string, quality double, n int")
    assert [tuple(r) for r in reports.by_config(rows, ["a", "b", "c"], ["quality", "n"]).orderBy("metric").collect()] == [("n", 3.0, 2.0, None), ("quality", 0.25, 0.5, None)]
    assert [r["answer"] for r in reports.row_log(spark.createDataFrame([("x" * 600,), (None,)], "answer string")).collect()] == ["x" * 500, None]
    bad = spark.createDataFrame([("s", f"m{k}") for k in range(7)] + [("r", "m")], "scope string, m string")
    queue = reports.failure_queue(bad, "scope", F.col("m"), 5)
    assert {r["scope"]: (r["total"], len(r["first"])) for r in queue.collect()} == {"s": (7, 5), "r": (1, 1)}
    lines = reports.markdown_lines("Run", spark.createDataFrame([("rows", 8)], "name string, n int"), queue)
    reports.write_markdown(lines, f"{tmp_path}/r.md")
    assert open(f"{tmp_path}/r.md").read().splitlines() == ["# Run", "## Counts", "- rows: 8", "## Failures", "- r (1): m", "- s (7): m0; m1; m2; m3; m4"]
    with pytest.raises(ValueError):
        reports.write_markdown(lines, f"{tmp_path}/r.md", most=3)
    kept = reports.needs_review(spark.createDataFrame([("1", "high"), ("2", "needs_review")], "poid string, parse_confidence string"), spark.createDataFrame([("1", 0, "a"), ("2", 0, "b")], "poid string, pos int, html string"))
    assert [r["html"] for r in kept.collect()] == ["b"]
