"""Queries on course and program pages, which are written from the tables, read as pages, and compared with the tables.

A part is a course, its lines are sections under the terms they ship in, a brand is a program.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.terms import season_of, term_label
from ..operators import courses, programs
from ..sources.batches import dealt
from .registry import Tables, query
from .tables import TERM


def joined(*parts) -> Column:
    return F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))


DAYS = ("MWF", "TR", "MX")


def section_row(at: Column) -> Column:
    """A table row for a line. Line 6 has no times, line 7 no number that says how many it takes, line 5 a time alone."""
    n, day = at["l_linenumber"], F.date_format(at["l_shipdate"], "yyyy-MM-dd")
    col = lambda icon, x: joined(f'<div class="col"><i class="far fa-{icon}"></i>', x, "</div>")
    time = joined((n + 8).cast("string"), ":05 - ", (n + 9).cast("string"), ":20")
    days = F.element_at(F.array(*map(F.lit, DAYS)), n % 3 + 1)
    times = F.when(n == 6, "").when(n == 5, col("clock", time)).otherwise(F.concat(col("calendar", joined(day, " (", days, ")")), col("clock", time)))
    cell = lambda name, x: joined(f'<td data-card-title="{name}">', x, "</td>")
    component = F.when(n % 2 == 0, "LAB").otherwise("READING COURSE")
    seats = F.when(n == 7, "many").otherwise(at["l_quantity"].cast("int").cast("string"))
    return F.concat(F.lit("<tr>"), cell("Section", joined(component, " S", n.cast("string"), "<br>(", at["l_orderkey"].cast("string"), ")")), cell("Capacity", seats), cell("Class times", times), F.lit("</tr>"))


def course_pages(t: Tables) -> DataFrame:
    """(url, html) of all parts. Lines and parts meet in one shuffle of numbers and names, in many parts; markup is made after it."""
    line, part = F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_quantity").alias("at"), F.struct("p_name", "p_size").alias("part")
    lines = t.lineitem.where("l_partkey is not null").select(F.col("l_partkey").alias("p_partkey"), line)
    both = dealt(lines.unionByName(t.part.select("p_partkey", part), allowMissingColumns=True), "p_partkey")
    whole = both.groupBy("p_partkey").agg(F.array_sort(F.collect_list("at")).alias("at"), F.collect_list("part").alias("parts"))
    rows = whole.select("p_partkey", F.explode("parts").alias("part"), "at").select("p_partkey", "part.*", "at", F.transform("at", lambda a: term_label(a["l_shipdate"])).alias("in_terms"))
    # lines are in order of their dates, so those of a term stand together
    begins = lambda i: (i == 0) | (F.get("in_terms", i) != F.get("in_terms", i - 1))
    head = lambda i: F.when(begins(i), joined(F.when(i > 0, "</tbody></table>").otherwise(""), "<h2>", F.get("in_terms", i), "</h2><table><tbody>")).otherwise("")
    table = F.when(F.size("at") > 0, joined(F.array_join(F.transform("at", lambda a, i: F.concat(head(i), F.coalesce(section_row(a), F.lit("")))), ""), "</tbody></table>"))
    rows = rows.select("p_partkey", "p_name", "p_size", table.alias("body"), F.size("at").alias("n"), F.array_join(F.array_sort(F.array_distinct("in_terms")), ",").alias("terms"))
    key, size = F.col("p_partkey").cast("string"), F.col("p_size")
    meta = lambda name, x: joined(f'<meta name="ua__cat_{name}" content="', x, '">')
    head = F.concat(
        meta("course", joined("P ", key)), meta("subject", "P"), F.when(size % 7 > 0, meta("catalog", key)).otherwise(""), meta("coursetitle", F.col("p_name")), meta("credits", (size / 2).cast("string")),
        meta("term", F.coalesce("terms", F.lit(""))), meta("sections", (F.coalesce("n", F.lit(0)) + (size % 5 == 0).cast("long")).cast("string")),
    )
    needs = F.when(size % 3 == 0, joined(" Prerequisite: P ", size.cast("string"), ".")).when(size % 3 == 1, joined(" Prerequisite or corequisite: P ", size.cast("string"), ".")).otherwise("")
    words = joined("A course about the ", F.col("p_name"), " and all that goes with it.", needs)
    html = joined("<html><head>", head, "</head><body><h1>P ", key, " - Course</h1><p>", words, "</p>", F.coalesce("body", F.lit("")), "</body></html>")
    return rows.select(joined("p/", key).alias("url"), html.alias("html"))


N_TERMS = f"(SELECT l_partkey AS k, count(*) AS n, array_to_string(list_sort(list_distinct(list({TERM.format('l_shipdate')}))), ',') AS terms FROM lineitem GROUP BY l_partkey)"
LINE = f"""(SELECT l_partkey, l_orderkey, l_linenumber AS n, l_quantity, l_shipdate, {TERM.format('l_shipdate')} AS term, CASE WHEN l_linenumber % 2 = 0 THEN 'LAB' ELSE 'READING COURSE' END AS component,
    CASE WHEN l_linenumber <> 7 THEN l_quantity::INTEGER END AS capacity, ['MWF', 'TR', 'MX'][l_linenumber % 3 + 1] AS days, strftime(l_shipdate, '%Y-%m-%d') AS day,
    lpad((l_linenumber + 8)::VARCHAR, 2, '0') || ':05' AS begins, lpad((l_linenumber + 9)::VARCHAR, 2, '0') || ':20' AS ends, (l_linenumber + 8) || ':05 - ' || (l_linenumber + 9) || ':20' AS said FROM lineitem)"""


@query(f"""
    SELECT 'P ' || l_partkey AS course_id, term, component, 'S' || n AS section, l_orderkey::VARCHAR AS class_id, capacity,
           CASE WHEN n NOT IN (5, 6) THEN day END AS date_start, CASE WHEN n NOT IN (5, 6) THEN array_to_string(string_split(days, ''), ' ') END AS days,
           CASE WHEN n NOT IN (5, 6) THEN begins END AS time_start, CASE WHEN n NOT IN (5, 6) THEN ends END AS time_end,
           CASE n WHEN 6 THEN 'No scheduled meeting times' WHEN 5 THEN said END AS schedule_note
    FROM {LINE} JOIN part ON p_partkey = l_partkey""")
def course_page_sections(t: Tables) -> DataFrame:
    rows = courses.parse_courses(course_pages(t), deal=False).select("course_id", F.explode_outer("sections").alias("s")).where("s is not null")
    m = F.get(F.col("s.meetings"), F.lit(0))
    return rows.select(
        "course_id", "s.term", "s.component", "s.section", "s.class_id", "s.capacity", m["date_start"].alias("date_start"), F.array_join(m["days"], " ").alias("days"), m["time_start"].alias("time_start"), m["time_end"].alias("time_end"), "s.schedule_note"
    )


@query(f"""
    SELECT 'P ' || p_partkey AS course_id, p_partkey::VARCHAR AS catalog_number, p_name AS title, p_size / 2.0 AS credits, coalesce(terms, '') AS terms,
           CASE WHEN p_size % 3 < 2 THEN 'P ' || p_size || '.' END AS prereq_raw, CASE WHEN p_size % 3 = 1 THEN 'P ' || p_size || '.' END AS coreq_raw, coalesce(n, 0)::INTEGER AS n_sections,
           (p_size % 7 = 0)::INTEGER + (p_size % 3 = 1)::INTEGER + (p_size % 5 = 0)::INTEGER + coalesce(f, 0)::INTEGER AS n_flags
    FROM part LEFT JOIN {N_TERMS} ON k = p_partkey
    LEFT JOIN (SELECT l_partkey, count(*) FILTER (WHERE l_linenumber = 7) + count(*) FILTER (WHERE l_linenumber = 5) + count(*) FILTER (WHERE l_linenumber % 3 = 2 AND l_linenumber NOT IN (5, 6)) AS f FROM lineitem GROUP BY l_partkey) ON l_partkey = p_partkey""")
def course_page_fields(t: Tables) -> DataFrame:
    rows = courses.parse_courses(course_pages(t), deal=False)
    return rows.select("course_id", "catalog_number", "title", "credits", F.array_join(F.array_sort("terms_offered"), ",").alias("terms"), "prereq_raw", "coreq_raw", F.size("sections").alias("n_sections"), F.size("flags").alias("n_flags"))


PART_TEXT = "component || ' S' || n || ' ' || CASE WHEN n IN (5, 6) THEN 'time TBA' ELSE days || ' ' || begins || '-' || ends END || CASE WHEN capacity IS NULL THEN '' ELSE ' (capacity ' || capacity || ')' END"


@query(f"""
    SELECT 'P ' || l_partkey || '::' || term AS id, coalesce(sum(capacity), 0)::BIGINT AS total_capacity,
           '[P ' || l_partkey || '::' || term || '] P ' || l_partkey || ' in ' || term || ': ' || string_agg({PART_TEXT}, '; ' ORDER BY l_shipdate, l_orderkey, n, l_quantity) || '. Total capacity ' || coalesce(sum(capacity), 0)::BIGINT || '.' AS text
    FROM {LINE} JOIN part ON p_partkey = l_partkey GROUP BY l_partkey, term""")
def course_offering_spans(t: Tables) -> DataFrame:
    snap = courses.snapshot(courses.parse_courses(course_pages(t), deal=False), "s")
    return courses.spans(snap).where("kind = 'offering'").select("id", "total_capacity", "text")


@query(f"""
    SELECT 'P ' || p_partkey AS course_id, level, p_size / 2.0 AS units, season, count(*) AS n FROM (
        SELECT p_partkey, p_size, p_partkey // 100 * 100 AS level, unnest(string_split(terms, ',')) AS term FROM part JOIN {N_TERMS} ON k = p_partkey)
    , (VALUES ('Winter'), ('Spring'), ('Summer'), ('Fall')) s(season) WHERE contains(term, season) GROUP BY ALL""")
def course_snapshot_terms(t: Tables) -> DataFrame:
    rows = courses.snapshot(courses.parse_courses(course_pages(t), deal=False), "s").select("course_id", "level", "units", F.explode_outer("terms").alias("term")).where("term is not null")
    return rows.groupBy("course_id", "level", "units", season_of(F.col("term")).alias("season")).agg(F.count("*").alias("n"))


DEGREES = ("Bachelor of Arts in", "Bachelor of Science in Nursing", "Master of", "Certificate in")


def program_pages(t: Tables) -> DataFrame:
    """(poid, html) of brands: a block for each type, ruled by its least size, with its parts as courses; of parts of size 1 in each, a block of their own inside."""
    item = joined('<li class="acalog-course"><a href="#">', "P ", F.col("p_partkey").cast("string"), " - ", F.col("p_name"), "</a></li>")
    in_order = lambda what: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(what, F.struct("p_partkey", item.alias("x"))))), lambda s: s["x"]), "")
    small = F.col("p_size") == 1
    kinds = t.part.groupBy("p_brand", "p_type").agg(in_order(~small).alias("own"), in_order(small).alias("small"), F.min("p_size").alias("least"))
    inner = F.when(F.col("small") != "", joined('<div class="acalog-core"><h3>Small</h3><ul>', F.col("small"), "</ul></div>")).otherwise("")
    block = joined('<div class="acalog-core"><h2>', F.col("p_type"), "</h2><ul><li>", F.col("least").cast("string"), " units from</li>", F.col("own"), "</ul>", inner, "</div>")
    pages = kinds.groupBy("p_brand").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_type", block.alias("x")))), lambda s: s["x"]), "").alias("blocks"))
    number = F.split_part("p_brand", F.lit("#"), F.lit(2)).cast("int")
    name = joined(F.element_at(F.array(*map(F.lit, DEGREES)), number % 4 + 1), " ", F.col("p_brand"))
    return pages.select(F.col("p_brand").alias("poid"), joined("<html><body><div class='block_content'><h1>", name, "</h1>", F.col("blocks"), "</div></body></html>").alias("html"))


DEGREE_SQL = "CASE split_part(p_brand, '#', 2)::INTEGER % 4 WHEN 0 THEN 'BA' WHEN 1 THEN 'BScN' WHEN 2 THEN 'M?' END"


@query(f"""
    SELECT p_brand AS poid, {DEGREE_SQL} AS degree, p_type AS heading, p_type || ' ' || min(p_size) || ' units from' AS rule, coalesce(string_agg('P ' || p_partkey, ',' ORDER BY p_partkey) FILTER (WHERE p_size <> 1), '') AS courses
    FROM part WHERE p_brand IS NOT NULL GROUP BY p_brand, p_type
    UNION ALL
    SELECT p_brand, {DEGREE_SQL}, p_type || ' / Small', NULL, string_agg('P ' || p_partkey, ',' ORDER BY p_partkey) FROM part WHERE p_brand IS NOT NULL AND p_size = 1 GROUP BY p_brand, p_type""")
def program_page_blocks(t: Tables) -> DataFrame:
    rows = programs.parse_programs(program_pages(t)).where("parse_confidence = 'high'").select("poid", "degree", F.explode("requirement_blocks_raw").alias("b"))
    return rows.select("poid", "degree", "b.heading", F.col("b.rule_text_raw").alias("rule"), F.array_join("b.courses", ",").alias("courses"))
