"""Course pages of our own, built from data, through rows, snapshot and spans."""

import datetime
import random

import pytest

from plinth.operators import courses
from plinth.plans import pages
from plinth.plans.registry import Tables

SUMMER = "2027-07-05 - 2027-08-13"
#: (heading, [(section, class number, capacity, [(icon, text)])])
TERMS = [
    ("Summer Term 2027", [
        ("TUTORIAL T09", 4410, None, [("", f"{SUMMER} (MW)"), ("", "17:00 - 18:20")]),
        ("READING COURSE 77", 4411, "6", []),
    ]),
    ("Spring Term 2027", [
        ("FIELD SCHOOL Q7", 3902, "12", [("calendar", "2027-05-03 - 2027-05-14 (TR)"), ("clock", "8:30 - 16:05"), ("calendar", "2027-05-17 (W)"), ("clock", "13:00 - 15:20"), ("calendar", "2027-05-17 (W)"), ("clock", "13:00 - 15:20")]),
        ("SEMINAR Z", 3903, "eighteen", [("clock", "10:00 - 11:00")]),
    ]),
]
META = {"course": "GEOL 341", "subject": "GEOL", "catalog": "341", "coursetitle": "River Sediments", "credits": "1.5", "term": "Summer Term 2027,Spring Term 2027", "sections": "7"}


def column(icon, text):
    return f'<div class="col">{icon and f"<span class='far fa-{icon}'></span>"}{text}</div>'


def row(section, number, capacity, times):
    cells = {"Section": f"<div>{section}<br>({number})</div>", "Capacity": "" if capacity is None else f"<b>{capacity}</b>", "Class times": f'<div class="row">{"".join(column(*t) for t in times)}</div>'}
    return "<tr>" + "".join(f'<td data-card-title="{k}">{v}</td>' for k, v in cells.items()) + "</tr>"


def page():
    tables = "".join(f"<h2>{heading}</h2><table><tbody>{''.join(row(*s) for s in some)}</tbody></table>" for heading, some in TERMS)
    meta = "".join(f'<meta name="ua__cat_{k}" content="{v}">' for k, v in META.items())
    words = "How rivers carry and sort what they carry. Prerequisite: GEOL 201 or consent. Corequisite: PHYS 130. Note: boots are needed."
    return f'<html><head>{meta}</head><body><h1>GEOL 341 - River Sediments</h1><h2 class="fs-5">1.5 units</h2><p><a href="/catalogue/faculty/eas">Earth Sciences</a></p><p>{words}</p>{tables}</body></html>'


@pytest.fixture(scope="module")
def rows(spark):
    bare = "<html><body><h1>ART 88B - Clay</h1><p>Clay from the river bank, dug, kneaded, shaped, dried and fired by each student.</p></body></html>"
    return courses.parse_courses(spark.createDataFrame([("river", page()), ("clay", bare), ("nothing", None)], "url string, html string"))


def test_fields(rows):
    got = {r["source_url"]: r for r in rows.collect()}
    river, clay = got["river"], got["clay"]
    assert [river[k] for k in ("course_id", "subject", "catalog_number", "title", "credits", "units_string")] == ["GEOL 341", "GEOL", "341", "River Sediments", 1.5, "1.5 units"]
    assert river["terms_offered"] == ["Summer Term 2027", "Spring Term 2027"]
    assert river["prereq_raw"].startswith("GEOL 201 or consent") and river["coreq_raw"].startswith("PHYS 130") and river["note_raw"] == "Note: boots are needed."
    assert river["flags"] == ["[Spring Term 2027 SEMINAR Z (3903)] unparseable-capacity:'eighteen'", "[Spring Term 2027 SEMINAR Z (3903)] orphan-time-col:'10:00 - 11:00'", "[GEOL 341] section-count-mismatch: parsed=4 meta=7"]
    assert (clay["course_id"], clay["catalog_number"], clay["sections"], clay["flags"]) == ("ART 88B", "88B", [], ["missing-course-meta:clay"])
    assert clay["description_raw"].startswith("Clay from the river bank")
    assert got["nothing"]["course_id"] == "UNKNOWN" and "missing-description:UNKNOWN" in got["nothing"]["flags"] and river["term_notes"] is None


def test_sections(rows):
    got = {s["class_id"]: s for s in rows.where("source_url = 'river'").first()["sections"]}
    assert {k: (s["term"], s["component"], s["section"], s["capacity"]) for k, s in got.items()} == {
        "4410": ("Summer Term 2027", "TUTORIAL", "T09", None), "4411": ("Summer Term 2027", "READING COURSE", "77", 6),
        "3902": ("Spring Term 2027", "FIELD SCHOOL", "Q7", 12), "3903": ("Spring Term 2027", "SEMINAR", "Z", None),
    }
    when = {k: [(m["date_start"], m["date_end"], "".join(m["days"]), m["time_start"], m["time_end"]) for m in s["meetings"]] for k, s in got.items()}
    assert when["4410"] == [("2027-07-05", "2027-08-13", "MW", "17:00", "18:20")]  # no icons: known by their texts
    assert [w[2:] for w in when["3902"]] == [("TR", "08:30", "16:05"), ("W", "13:00", "15:20")]  # a meeting said twice is one
    assert when["4411"] == when["3903"] == []
    assert (got["4411"]["schedule_note"], got["3903"]["schedule_note"], got["3902"]["schedule_note"]) == ("No scheduled meeting times", "10:00 - 11:00", None)


def test_snapshot_and_spans(rows):
    snap = courses.snapshot(rows.where("source_url = 'river'"), "s7")
    r = snap.first()
    assert (r["level"], r["units"], r["terms"]) == (300, 1.5, ["Spring Term 2027", "Summer Term 2027"])
    assert not {"schedule_note", "term_code", "instructor"} & set(r["sections"][0].asDict())
    assert [tuple(t) for t in courses.snapshot_terms(snap).select("term", "ord", "season").orderBy("ord").collect()] == [("Spring Term 2027", 0, "Spring"), ("Summer Term 2027", 1, "Summer")]
    got = {s["id"]: s for s in courses.embed_text(courses.spans(snap)).collect()}
    assert got["GEOL 341::course"]["text"].startswith("[GEOL 341] River Sediments (1.5 units, 300-level). Offered: Spring Term 2027, Summer Term 2027. Prerequisite: GEOL 201")
    spring = got["GEOL 341::Spring Term 2027"]
    assert spring["text"] == "[GEOL 341::Spring Term 2027] GEOL 341 in Spring Term 2027: FIELD SCHOOL Q7 TR 08:30-16:05; W 13:00-15:20 (capacity 12); SEMINAR Z time TBA. Total capacity 12."
    assert got["GEOL 341::Summer Term 2027"]["total_capacity"] == 6 and spring["embed_text"].startswith("GEOL 341 GEOL 341 [")


ODD = [
    ("Winter Term 2028", [
        ("LECTURE", 1, "5", [("calendar", "2028-01-05 (MXQ)"), ("clock", "9:00 - 9:50"), ("calendar", "soon"), ("clock", "10:00 - 11:00"), ("calendar", "2028-01-06"), ("clock", "noon"), ("calendar", "2028-01-07")]),
    ]),
]


def test_flags_and_term_notes(spark):
    top = "How rivers carry and sort what they carry, and how we may know it from what they leave."
    changed = "From Winter 2028 on the course is about lakes, and what they keep of what rivers bring them."
    table = "".join(row(*s) for s in ODD[0][1]) + '<tr><td data-card-title="Section">LAB B2</td><td data-card-title="Capacity">7</td></tr>'
    head = "".join(f'<meta name="ua__cat_{k}" content="{v}">' for k, v in (META | {"sections": "2", "sections_online": "1"}).items())
    body = f"<h1>GEOL 341</h1><p><a href='/catalogue/faculty/eas'>E</a></p><p>{top} Prerequisite or corequisite: GEOL 201.</p><h2>Fall Term 2027</h2><p>short</p><h3>x</h3><p>{changed}</p>"
    body += f"<h2>Winter Term 2028</h2><p>{changed}</p><table><tbody>{table}</tbody></table><h2>Spring Term 2028</h2><p>{top} Prerequisite or corequisite: GEOL 201.</p>"
    html = f"<html><head>{head}</head><body>{body}</body></html>"
    silent = "<html><body><h1>ART 9</h1><div>There is no available\n course description.</div></body></html>"
    pages = spark.createDataFrame([("a", html), ("a", html), (None, html), (None, silent)], "url string, html string").repartition(2)
    got = courses.parse_courses(pages).collect()
    assert sorted((r["source_url"] or "", r["course_id"], len(r["sections"]), r["meta_sections_online"]) for r in got) == [("", "ART 9", 0, None), ("", "GEOL 341", 2, 1), ("a", "GEOL 341", 2, 1), ("a", "GEOL 341", 2, 1)]
    r = next(r for r in got if r["source_url"] == "a")
    at, lab = "[Winter Term 2028 LECTURE  (1)] ", "[Winter Term 2028 LAB B2 (None)] "
    assert r["flags"] == [
        "[GEOL 341] combined-prereq/coreq clause captured into both fields", f"{at}section-cell-no-section-label:'LECTURE (1)'", f"{at}unknown-day-code:'X' in '2028-01-05 (MXQ)'", f"{at}unknown-day-code:'Q' in '2028-01-05 (MXQ)'",
        f"{at}unparseable-date-col:'soon'", f"{at}orphan-time-col:'10:00 - 11:00'", f"{at}unparseable-time-col:'noon'", f"{lab}section-cell-no-classid:'LAB B2'", f"{lab}missing-class-times-cell",
        "[Winter Term 2028] per-term-description differs from top description (course-is-changing block)",
    ]
    assert r["term_notes"] == {"Winter Term 2028": changed} and [x["schedule_note"] for x in r["sections"]] == ["soon | 10:00 - 11:00 | 2028-01-06 | 2028-01-07", "No scheduled meeting times"]
    assert next(r for r in got if r["course_id"] == "ART 9")["flags"] == ["missing-course-meta:"]
    assert courses.parse_courses(pages.limit(0)).collect() == []


def test_pages_are_dealt_once_and_not_shuffled_by_what_they_hold(spark):
    df = courses.parse_courses(spark.createDataFrame([("river", page())], "url string, html string"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Window" not in plan and "Join" not in plan and "MapInArrow" in plan
    plan = courses.parse_courses(spark.createDataFrame([("river", page())], "url string, html string"), deal=False)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


TAGS = ["<tr>", "</tr>", "<TR>", '<td data-card-title="Section">', '<td data-card-title="Class times">', "</td>", '<div class="col">', "</div>", '<i class="fa-clock"></i>', "<br>", "<br/>", "<p>", "</p>", "<h2>", "</h2>", "<table>", "</table>", "<!DOCTYPE html>", '<meta name="ua__cat_x" content="a&quot;b">']
TEXTS = ["text", " a b\n c ", "x &lt; y", "a > b", "There is no available", " course description", "&#84;here is no available course description", "Fall Term 2026", "{0}", "{"]
ODD_MARKUP = ["<script>", "</script>", "<title>", "<!-- x > -->", "<", "<p x=1>", "<a b='>'>", "&", "\x00", '<tr a="b">', "</tr >", "</>"]


def test_plain_markup_is_read_as_the_parser_reads_it():
    rng, plain = random.Random(5), 0
    for k in range(6000):
        some = TAGS + TEXTS + (ODD_MARKUP if k % 3 == 0 else [])
        html = "".join(rng.choice(some) for _ in range(rng.randrange(1, 30)))
        if k % 2:
            cells = [f'<td data-card-title="Section">{rng.choice(some)}<br>{rng.choice(some)}</td><td data-card-title="Class times"><div class="col">{rng.choice(some)}<i class="fa-clock"></i>{rng.choice(some)}</div></td>' for _ in range(3)]
            html = "".join(f"<tr>{c}</tr>{rng.choice(some)}" for c in cells) + html
        want, got = courses._Nodes(), courses._read(html)
        want.feed(html)
        want.close()
        assert (got.rows, got.undescribed) == (want.rows, want.undescribed), html
        plain += courses._plain(html) is not None
    assert 1000 < plain < 5000


def test_of_a_term_named_twice_the_last_note_counts(spark):
    long = "{} what rivers carry, how they sort it, and what lakes and seas keep of it."
    head = "<h2>{}</h2><p>{}</p>"
    html = "".join(head.format(t, long.format(x)) for t, x in (("Winter Term 2028", "First"), ("Fall Term 2027", "Second"), ("Winter Term 2028", "Third"))) + "<h2>Fall Term 2028</h2><table></table>" + f"<p>{long.format('Shut')}</p>"
    r = courses.parse_courses(spark.createDataFrame([("u", f"<a href='#'>x</a><p class='faculty'>f</p><p>{long.format('Top')}</p>{html}")], "url string, html string")).first()
    assert r["description_raw"] == long.format("Top") and r["term_notes"] == {"Winter Term 2028": long.format("Third"), "Fall Term 2027": long.format("Second")}
    assert [f.split("]")[0] for f in r["flags"] if "per-term" in f] == ["[Winter Term 2028", "[Fall Term 2027"]


def test_lines_and_parts_that_are_odd_make_the_same_pages(spark, tmp_path):
    day = datetime.date(1996, 3, 13)
    lines = [(1, 10, 1, 5.0, day), (1, 10, 1, 5.0, day), (1, 11, 2, None, datetime.date(1996, 9, 1)), (1, 12, 6, 7.0, None), (None, 13, 1, 1.0, day), (9, 14, 1, 1.0, day)]
    spark.createDataFrame(lines, "l_partkey long, l_orderkey long, l_linenumber int, l_quantity double, l_shipdate date").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, "iron", 3), (2, "tin", 4)], "p_partkey long, p_name string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    got = {r["url"]: r["html"] for r in pages.course_pages(Tables(spark, str(tmp_path))).collect()}
    assert set(got) == {"p/1", "p/2"} and "<h2>" not in got["p/2"] and 'sections" content="0"' in got["p/2"]
    # a line that no row can be made of is counted, and its term named, as before
    assert got["p/1"].count("<tr>") == 3 and 'sections" content="4"' in got["p/1"] and 'term" content="Fall Term,Fall Term 1996,Winter Term 1996"' in got["p/1"]
    assert [x.split("</h2>")[0] for x in got["p/1"].split("<h2>")[1:]] == ["Fall Term", "Winter Term 1996", "Fall Term 1996"]
    assert got["p/1"].count("<tbody>") == got["p/1"].count("</tbody>") == 3
