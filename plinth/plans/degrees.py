"""Queries on a whole degree program: an order is a student, its lines are courses already taken."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.terms import term_label
from ..operators import degree, eval_run, evaluation, solve
from ..sources.batches import dealt
from ..sources.scratch import kept
from .program import PROGRAM
from .registry import Tables, query
from .tables import TERM

SCOPE = tuple(sorted(set(PROGRAM.named) | set(PROGRAM.prerequisites)))
CATALOGUE = {c: (c.rsplit(" ", 1)[0], int(c.rsplit(" ", 1)[1]) // 100 * 100, 3.0) for c in SCOPE}
SEASONS = {c: frozenset({"Fall"} if c == "CMPUT 274" else {"Winter"} if c == "CMPUT 275" else {"Fall", "Winter"}) for c in SCOPE}
OPENING = ("CMPUT 174", "CMPUT 175", "CMPUT 272", "CMPUT 274", "CMPUT 275", "MATH 125", "MATH 134", "MATH 136", "STAT 151")


def taken(t: Tables) -> DataFrame:
    """(plan, course): courses of the first terms, by part number; of courses that exclude each other the first, so that none is a failure from the start."""
    course = F.element_at(F.array(*map(F.lit, OPENING)), (F.pmod("l_partkey", F.lit(len(OPENING))) + 1).cast("int"))
    held = t.lineitem.select(F.col("l_orderkey").alias("plan"), course.alias("course")).groupBy("plan").agg(F.collect_set("course").alias("held"))
    kept = F.col("held")
    for first, other in (("CMPUT 174", "CMPUT 274"), ("CMPUT 174", "CMPUT 275"), ("CMPUT 175", "CMPUT 275")):
        kept = F.when(F.array_contains(kept, first), F.array_remove(kept, other)).otherwise(kept)
    return held.select("plan", kept.alias("taken"))


def solved(t: Tables) -> DataFrame:
    return solve.solve_all(taken(t), PROGRAM, CATALOGUE, SEASONS, solve.Policy(scope=frozenset(SCOPE)))


@query()
def solve_shortest(t: Tables) -> DataFrame:
    return solved(t).select("plan", "found", "terms_to_graduate", "n_courses")


@query("SELECT DISTINCT l_orderkey AS plan, CAST(0 AS BIGINT) AS n_failures FROM lineitem")
def solve_round_trip(t: Tables) -> DataFrame:
    """Every plan found is judged like any other plan, with what was taken before: none may fail. Plans of equal sets are equal and are judged once."""
    keyed = taken(t).select("plan", F.array_join(F.array_sort("taken"), "|").alias("key"))
    alike = keyed.select(F.col("key").alias("plan")).distinct()  # at most a row for each set of OPENING
    sets = kept(alike.select("plan", F.filter(F.split("plan", "[|]"), lambda c: c != "").alias("taken")), "sets")
    found = kept(solve.solve_all(sets, PROGRAM, CATALOGUE, SEASONS, solve.Policy(scope=frozenset(SCOPE))), "solved")
    plans = kept(solve.as_plans(found, sets.select("plan", F.explode("taken").alias("course"))), "plans")
    offered = t.spark.createDataFrame([(c, f"{s} Term 2026") for c, seasons in SEASONS.items() for s in sorted(seasons)], "course string, term string")
    failures = degree.validate(plans, PROGRAM, CATALOGUE, offered).groupBy("plan").agg(F.count("*").alias("n"))
    judged = plans.select("plan").distinct().join(failures, "plan", "left").select(F.col("plan").alias("key"), F.coalesce("n", F.lit(0)).alias("n_failures"))
    return keyed.join(F.broadcast(judged), "key").select("plan", "n_failures")


def picked(number, names: tuple[str, ...]):
    """The name whose turn it is."""
    return F.element_at(F.array(*map(F.lit, names)), (F.pmod(number, F.lit(len(names))) + 1).cast("int"))


def picked_sql(number: str, names: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{x}'" for x in names) + f"][{number} % {len(names)} + 1]"


OFFERED_SQL = f"SELECT l_orderkey * 10 + l_linenumber AS n, l_partkey, {picked_sql('l_partkey', SCOPE)} AS course, {TERM.format('l_shipdate')} AS term, l_shipdate, l_orderkey, l_linenumber FROM lineitem"


def scheduled(t: Tables) -> DataFrame:
    """Orders as plans (degree.PLAN and n): lines are courses of PROGRAM in the months they ship, in order of line and part."""
    d = F.col("l_shipdate")
    place = F.struct("l_linenumber", "l_partkey")
    rows = t.lineitem.select(F.col("l_orderkey").cast("string").alias("plan"), ((F.year(d) - 1990) * 12 + F.month(d)).alias("month"), term_label(d).alias("term"), place.alias("place"), picked(F.col("l_partkey"), SCOPE).alias("course"), F.col("l_orderkey").alias("n"))
    months = dealt(rows, "plan").groupBy("plan", "n", F.col("month").alias("term_idx"), "term").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "course"))), lambda s: s["course"]).alias("c"))
    return months.select("plan", "term_idx", "term", F.posexplode("c").alias("pos", "course"), "n")


@query(f"""
    WITH l AS ({OFFERED_SQL}),
    m AS (SELECT l_orderkey, (year(l_shipdate) - 1990) * 12 + month(l_shipdate) AS month, term, string_agg(course, ', ' ORDER BY l_linenumber, l_partkey) AS c FROM l GROUP BY ALL),
    p AS (SELECT l_orderkey, string_agg(term || ': ' || c, ' | ' ORDER BY month) AS text FROM m GROUP BY l_orderkey),
    h AS (SELECT l_orderkey, array_to_string(list_sort(list_distinct(list({picked_sql('l_partkey', OPENING)}))), ', ') AS held FROM lineitem GROUP BY l_orderkey)
    SELECT format('factual_offered_{{:03d}}', n) AS id, 'factual_offered' AS type, 'Is ' || course || ' offered in ' || term || '?' AS text FROM l
    UNION ALL SELECT format('factual_prereq_{{:03d}}', p_partkey), 'factual_prereq', 'What is the prerequisite for ' || {picked_sql('p_partkey', SCOPE)} || '?' FROM part
    UNION ALL SELECT format('plan_validity_{{:03d}}', l_orderkey), 'plan_validity', '{eval_run.VALID}' || text FROM p
    UNION ALL SELECT format('plan_construction_{{:03d}}', l_orderkey), 'plan_construction', '{eval_run.BUILD}' || ' I have already completed: ' || held || '.' || '{eval_run.HOW.replace("'", "''")}' FROM h""")
def query_set_types(t: Tables) -> DataFrame:
    """Questions of all four types, made from the tables."""
    n = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    offered = t.lineitem.select(n.alias("n"), picked(F.col("l_partkey"), SCOPE).alias("course"), term_label(F.col("l_shipdate")).alias("term"))
    prereq = t.part.select(F.col("p_partkey").alias("n"), picked(F.col("p_partkey"), SCOPE).alias("course"))
    had = t.lineitem.groupBy(F.col("l_orderkey").alias("n")).agg(F.array_sort(F.collect_set(picked(F.col("l_partkey"), OPENING))).alias("taken"))
    return eval_run.query_set(offered, prereq, scheduled(t), had).select("id", "type", "text")


def rule_sql(rule, has) -> str:
    """A rule as SQL; has(course): whether it is held."""
    if rule is None or (isinstance(rule, dict) and "hs" in rule):
        return "true"
    if isinstance(rule, str):
        return has(rule)
    if "pattern" in rule:
        some = [c for c in SCOPE if degree.fits(rule["pattern"], *CATALOGUE[c][:2])]
        return "(" + " OR ".join(map(has, some)) + ")" if some else "false"
    key = "one_of" if "one_of" in rule else "all_of"
    return "(" + (" OR " if key == "one_of" else " AND ").join(rule_sql(r, has) for r in rule[key]) + ")"


def failing_sql(same: bool) -> str:
    """Lines whose rule isn't met by what is held before (or by then)."""
    held = lambda c: f"list_contains({'upto' if same else 'before'}, '{c}')" if c in SCOPE else "true"
    cases = [(c, p.coreq if same else p.rule) for c, p in PROGRAM.prerequisites.items()]
    return "NOT (CASE course " + " ".join(f"WHEN '{c}' THEN {rule_sql(r, held)}" for c, r in cases if r is not None) + " ELSE true END)"


CLASH_SQL = " UNION ALL ".join(f"SELECT plan, 'credit_exclusion' AS code FROM h WHERE len(list_filter(held, lambda x: list_contains({list(e)!r}, x))) > 1" for e in PROGRAM.exclusions)
BARRED_SQL = " UNION ALL ".join(f"SELECT plan, 'ineligible_course' FROM h WHERE list_contains(held, '{c.trigger}') AND list_contains(held, '{c.ineligible}')" for c in PROGRAM.conditionals if c.ineligible)


@query(f"""
    WITH l AS (SELECT l_orderkey::VARCHAR AS plan, (year(l_shipdate) - 1990) * 12 + month(l_shipdate) AS month, {TERM.format('l_shipdate')} AS term, {picked_sql('l_partkey', SCOPE)} AS course FROM lineitem),
    s AS (SELECT *, CASE WHEN course = 'CMPUT 274' THEN contains(term, 'Fall') WHEN course = 'CMPUT 275' THEN contains(term, 'Winter') ELSE contains(term, 'Fall') OR contains(term, 'Winter') END AS is_offered FROM l),
    h AS (SELECT plan, list_distinct(list(course)) AS held FROM l GROUP BY plan),
    w AS (SELECT *, list(course) OVER (PARTITION BY plan ORDER BY month RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
                 coalesce(list(course) OVER (PARTITION BY plan ORDER BY month RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), []) AS before FROM l),
    f AS (SELECT plan, 'duplicate_course' AS code FROM (SELECT plan FROM l GROUP BY plan, course HAVING count(*) > 1) GROUP BY plan
          UNION ALL {BARRED_SQL} UNION ALL {CLASH_SQL} UNION ALL SELECT plan, 'not_offered' FROM s WHERE NOT is_offered
          UNION ALL SELECT plan, 'prereq_unsatisfied' FROM w WHERE {failing_sql(False)} UNION ALL SELECT plan, 'coreq_unsatisfied' FROM w WHERE {failing_sql(True)})
    SELECT plan, code, count(*) AS n FROM f GROUP BY plan, code""")
def degree_failures(t: Tables) -> DataFrame:
    """Orders judged as plans for the whole program: how many failures of each code, but for what slots lack (see solve_round_trip and the tests)."""
    offered = t.spark.createDataFrame([(c, f"{s} Term 1990") for c, seasons in SEASONS.items() for s in sorted(seasons)], "course string, term string")
    failures = degree.validate(scheduled(t).drop("n"), PROGRAM, CATALOGUE, offered)
    return failures.where("code <> 'requirement_shortfall'").groupBy("plan", "code").agg(F.count("*").alias("n"))


KNOWN_SQL = f"SELECT DISTINCT course, term FROM ({OFFERED_SQL}) WHERE l_linenumber <= 3"
NAMED_SQL = "CASE course " + " ".join(f"WHEN '{c}' THEN {sorted(set(evaluation.named(p.rule)))!r}" for c, p in PROGRAM.prerequisites.items() if p.rule is not None and evaluation.named(p.rule)) + " ELSE [] END"
SOURCE_SQL = "CASE course " + " ".join(f"WHEN '{c}' THEN '{p.source}'" for c, p in PROGRAM.prerequisites.items() if p.source) + " END"


def known(t: Tables) -> DataFrame:
    """(course, term) that the snapshot has: of an order's first three lines. At most SCOPE times the terms there are, so it is broadcast."""
    return F.broadcast(t.lineitem.where("l_linenumber <= 3").select(picked(F.col("l_partkey"), SCOPE).alias("course"), term_label(F.col("l_shipdate")).alias("term")).distinct())


def asked(t: Tables) -> DataFrame:
    """(id, type, course, term, plan, k): about each line's offering, each part's prerequisite and each order as a plan; k picks an answer."""
    none = F.lit(None).cast("string")
    once = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_shipdate").cast("date").alias("l_shipdate")).distinct()  # numbers are shuffled, not texts
    n = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", F.date_format("l_shipdate", "yyyyMMdd"))
    lines = once.select(F.concat(F.lit("o"), n).alias("id"), F.lit("factual_offered").alias("type"), picked(F.col("l_partkey"), SCOPE).alias("course"), term_label(F.col("l_shipdate")).alias("term"), none.alias("plan"), F.col("l_orderkey").alias("k"))
    parts = t.part.select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"), F.lit("factual_prereq").alias("type"), picked(F.col("p_partkey"), SCOPE).alias("course"), none.alias("term"), none.alias("plan"), F.col("p_size").cast("long").alias("k"))
    plan = F.col("l_orderkey").cast("string")
    orders = t.lineitem.select("l_orderkey").distinct().select(F.concat(F.lit("v"), plan).alias("id"), F.lit("plan_validity").alias("type"), none.alias("course"), none.alias("term"), plan.alias("plan"), F.col("l_orderkey").alias("k"))
    return lines.unionByName(parts).unionByName(orders)


ASKED_SQL = f"""asked AS (
    SELECT DISTINCT 'o' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || strftime(l_shipdate, '%Y%m%d') AS id, 'factual_offered' AS type, course, term, NULL::VARCHAR AS plan, l_orderkey AS k FROM ({OFFERED_SQL})
    UNION ALL SELECT 'p' || p_partkey, 'factual_prereq', {picked_sql('p_partkey', SCOPE)}, NULL, NULL, p_size FROM part
    UNION ALL SELECT DISTINCT 'v' || l_orderkey, 'plan_validity', NULL, NULL, l_orderkey::VARCHAR, l_orderkey FROM lineitem),
    known AS ({KNOWN_SQL}),
    twice AS (SELECT DISTINCT l_orderkey::VARCHAR AS plan FROM ({OFFERED_SQL}) GROUP BY l_orderkey, course HAVING count(*) > 1)"""


def repeated(t: Tables) -> DataFrame:
    """(plan, code) of orders that hold a course twice: the failures that the gold answers of these queries go by."""
    twice = t.lineitem.groupBy("l_orderkey", picked(F.col("l_partkey"), SCOPE).alias("course")).count().where("count > 1")
    return twice.select(F.col("l_orderkey").cast("string").alias("plan"), F.lit("duplicate_course").alias("code"))


@query(f"""
    WITH {ASKED_SQL}
    SELECT id, type, CASE WHEN type = 'factual_offered' THEN (course, term) IN (SELECT (course, term) FROM known) END AS offered, CASE WHEN type = 'factual_prereq' THEN array_to_string({NAMED_SQL}, ',') END AS prereq_courses,
           CASE WHEN type = 'factual_prereq' THEN {SOURCE_SQL} END AS source, CASE WHEN type = 'plan_validity' THEN plan NOT IN (SELECT plan FROM twice) END AS valid,
           CASE WHEN type = 'plan_validity' THEN CASE WHEN plan IN (SELECT plan FROM twice) THEN 'duplicate_course' ELSE '' END END AS failure_codes FROM asked""")
def evaluation_gold(t: Tables) -> DataFrame:
    """What is right, by type of question."""
    rows = evaluation.gold(asked(t), known(t), PROGRAM, repeated(t))
    return rows.withColumns({c: F.when(F.col(c).isNotNull(), F.array_join(c, ",")) for c in ("prereq_courses", "failure_codes")})


def met_sql(course: str, rule) -> str:
    """The share of a rule's clauses that the courses in list codes meet."""
    clauses = rule["all_of"] if isinstance(rule, dict) and "all_of" in rule else [rule]
    has = lambda c: f"list_contains(codes, '{c}')"

    def said(r) -> str:
        if isinstance(r, str):
            return has(r)
        if "hs" in r:
            return "true"
        if "pattern" in r:
            return "len(codes) > 0"
        key = "one_of" if "one_of" in r else "all_of"
        return "(" + (" OR " if key == "one_of" else " AND ").join(map(said, r[key])) + ")"

    return f"WHEN '{course}' THEN (" + " + ".join(f"({said(c)})::INTEGER" for c in clauses) + f") / {len(clauses)}.0"


MET_SQL = "CASE course " + " ".join(met_sql(c, p.rule) for c, p in PROGRAM.prerequisites.items() if p.rule is not None) + " ELSE CASE WHEN len(codes) = 0 THEN 1.0 ELSE 0.5 END END"


@query(f"""
    WITH {ASKED_SQL}, q AS (SELECT *, [{picked_sql('k', SCOPE)}, {picked_sql('(k * 7)', SCOPE)}] AS codes, (course, term) IN (SELECT (course, term) FROM known) AS yes FROM asked)
    SELECT id, type, round(CASE type WHEN 'factual_offered' THEN CASE k % 3 WHEN 0 THEN yes::INTEGER WHEN 1 THEN (NOT yes)::INTEGER ELSE 0 END
                          WHEN 'factual_prereq' THEN {MET_SQL} ELSE ((k % 2 = 0) = (plan NOT IN (SELECT plan FROM twice)))::INTEGER END, 6)::DOUBLE AS quality,
           type <> 'factual_offered' OR k % 3 = 2 OR yes OR course NOT IN (SELECT course FROM known) AS citation_ok FROM q""")
def evaluation_grades(t: Tables) -> DataFrame:
    """Answers to all these questions, some right and some wrong, graded by the grader of their type."""
    k, term = F.col("k"), F.coalesce("term", F.lit(""))
    offered = F.when(k % 3 == 0, F.concat(F.lit("Yes, it is offered in "), term, F.lit("."))).when(k % 3 == 1, F.concat(F.lit("It is not offered in "), term, F.lit("."))).otherwise("I can't say.")
    prereq = F.concat(picked(k, SCOPE), F.lit(" and "), picked(k * 7, SCOPE))
    answer = F.when(F.col("type") == "factual_offered", offered).when(F.col("type") == "factual_prereq", prereq).otherwise(F.when(k % 2 == 0, "The plan is valid.").otherwise("The plan is invalid."))
    none = F.array().cast("array<string>")
    rows = asked(t).select(F.lit("c").alias("config"), "*", answer.alias("answer"), none.alias("clauses"), none.alias("held"))
    facts = known(t).groupBy("course").agg(F.collect_set("term").alias("terms")).withColumn("times", none)
    verdicts = asked(t).where("type = 'plan_validity'").select("plan").join(repeated(t), "plan", "left").groupBy("plan").agg(F.bool_and(F.col("code").isNull()).alias("valid"))
    return evaluation.grade(rows, known(t), facts, PROGRAM, CATALOGUE, verdicts, "held").select("id", "type", F.round("quality", 6).alias("quality"), "citation_ok")
