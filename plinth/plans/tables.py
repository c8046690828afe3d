"""Queries on the star schema: an order is a plan, its lines are courses in the months they ship, a part is a course."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import exclusive_quantiles, ratio
from ..functions.terms import level, season_of, season_rank, term_code, term_label, term_year
from ..operators import closure, drift, matching, rules, validation
from ..sources.batches import dealt
from ..sources.readers import first_per_key, latest
from .registry import Tables, query

QUANTILE = """
    SELECT g.event_type, n, mean_value,
           round(CASE WHEN n = 1 THEN d[1] ELSE (d[j50] * (100 - s50) + d[j50 + 1] * s50) / 100 END, 4) AS p50,
           round(CASE WHEN n = 1 THEN d[1] ELSE (d[j95] * (100 - s95) + d[j95 + 1] * s95) / 100 END, 4) AS p95
    FROM (
        SELECT *, 50 * (n + 1) - j50 * 100 AS s50, 95 * (n + 1) - j95 * 100 AS s95
        FROM (
            SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean_value, list_sort(list(value)) AS d,
                   least(greatest(50 * (count(*) + 1) // 100, 1), greatest(count(*) - 1, 1)) AS j50,
                   least(greatest(95 * (count(*) + 1) // 100, 1), greatest(count(*) - 1, 1)) AS j95
            FROM events WHERE value IS NOT NULL GROUP BY event_type)
    ) g"""


@query(QUANTILE)
def agg_by_type_stats(t: Tables) -> DataFrame:
    rows = t.events.where("value is not null")
    means = rows.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean_value"))
    return means.join(exclusive_quantiles(rows, ["event_type"], "value", [50, 95]), "event_type")


@query("""
    SELECT user_id, round(avg(value) FILTER (WHERE event_type = 'purchase'), 8) AS purchase_mean,
           coalesce(round(sum(value) FILTER (WHERE event_type = 'error') / nullif(sum(value), 0), 4), 0.0) AS error_ratio
    FROM events GROUP BY user_id""")
def agg_conditional_mean_ratio(t: Tables) -> DataFrame:
    kind = F.col("event_type")
    return t.events.groupBy("user_id").agg(
        F.round(F.avg(F.when(kind == "purchase", F.col("value"))), 8).alias("purchase_mean"), ratio(F.sum(F.when(kind == "error", F.col("value"))), F.sum("value")).alias("error_ratio")
    )


@query("""
    SELECT source, lang, count(*) AS n, round(avg(quality), 6) AS quality
    FROM documents JOIN labels USING (doc_id) GROUP BY GROUPING SETS ((source), (source, lang))""")
def agg_grouping_sets_quality(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", "source", "lang").join(t.labels, "doc_id")
    return rows.groupingSets([["source"], ["source", "lang"]], "source", "lang").agg(F.count("*").alias("n"), F.round(F.avg("quality"), 6).alias("quality"))


@query("""
    SELECT event_type, arg_max(event_id, (value, -event_id)) AS most, arg_min(event_id, (value, event_id)) AS least
    FROM (SELECT event_type, event_id, value FROM events WHERE value IS NOT NULL) GROUP BY event_type""")
def argmax_argmin_group(t: Tables) -> DataFrame:
    rows = t.events.where("value is not null")
    return rows.groupBy("event_type").agg(F.max_by("event_id", F.struct("value", -F.col("event_id"))).alias("most"), F.min_by("event_id", F.struct("value", "event_id")).alias("least"))


@query("""
    SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type
    FROM events WHERE event_type <> 'error' GROUP BY user_id""")
def manifest_latest_ok(t: Tables) -> DataFrame:
    rows = t.events.where("event_type <> 'error'").select("user_id", "event_id", "event_type")
    return latest(rows, "user_id", F.col("event_id")).select("user_id", "event_id", "event_type")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_totalprice > 400000)")
def manifest_skip_anti(t: Tables) -> DataFrame:
    done = t.orders.where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return t.customer.select("c_custkey").join(done, "c_custkey", "left_anti")


@query("""
    SELECT coalesce(c.k, o.k) AS custkey, c.k IS NOT NULL AS listed, coalesce(o.n, 0) AS n
    FROM (SELECT c_custkey AS k FROM customer WHERE c_acctbal > 0) c
    FULL JOIN (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY o_custkey) o ON c.k = o.k""")
def listing_full_outer(t: Tables) -> DataFrame:
    c = t.customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("custkey"), F.lit(True).alias("listed"))
    o = t.orders.groupBy(F.col("o_custkey").alias("custkey")).agg(F.count("*").alias("n"))
    return c.join(o, "custkey", "full_outer").select("custkey", F.coalesce("listed", F.lit(False)).alias("listed"), F.coalesce("n", F.lit(0)).alias("n"))


@query("""
    SELECT CASE WHEN p_size // 10 * 10 >= 30 THEN 'upper' ELSE 'lower' END AS band, p_brand, count(*) AS n,
           count(*) FILTER (WHERE p_size // 10 * 10 IN (20, 40)) AS n_level
    FROM part WHERE p_brand IS NOT NULL GROUP BY ALL""")
def level_pattern_match(t: Tables) -> DataFrame:
    tens = level(F.col("p_size") * 10) / 10
    fits = rules.pattern_match(F.col("p_brand"), tens, {"level_in": [20, 40]})
    rows = t.part.where("p_brand is not null").select("p_brand", F.when(rules.pattern_match(F.col("p_brand"), tens, {"level_gte": 30}), "upper").otherwise("lower").alias("band"), fits.alias("fits"))
    return rows.groupBy("band", "p_brand").agg(F.count("*").alias("n"), F.count_if("fits").alias("n_level"))


SEASON = "CASE WHEN month({0}) <= 4 THEN 'Winter' WHEN month({0}) <= 6 THEN 'Spring' WHEN month({0}) <= 8 THEN 'Summer' ELSE 'Fall' END"
RANK = "CASE {0} WHEN 'Winter' THEN 0 WHEN 'Spring' THEN 1 WHEN 'Summer' THEN 2 ELSE 3 END"
TERM = f"{SEASON} || ' Term ' || year({{0}})"


@query(f"""
    SELECT term, season, year, 1940 + (year - 2026) * 40 + 10 * ({RANK.format('season')}) AS code, count(*) AS n
    FROM (SELECT {TERM.format('o_orderdate')} AS term, {SEASON.format('o_orderdate')} AS season, year(o_orderdate) AS year FROM orders) GROUP BY ALL""")
def term_key_season(t: Tables) -> DataFrame:
    rows = t.orders.groupBy(term_label(F.col("o_orderdate")).alias("term")).agg(F.count("*").alias("n"))
    term = F.col("term")
    return rows.select("term", season_of(term).alias("season"), term_year(term).alias("year"), term_code(term).alias("code"), "n")


@query(f"""
    SELECT term, row_number() OVER (ORDER BY year, rank) - 1 AS ord
    FROM (SELECT DISTINCT {TERM.format('o_orderdate')} AS term, year(o_orderdate) AS year, {RANK.format('(' + SEASON.format('o_orderdate') + ')')} AS rank FROM orders)""")
def term_order_index(t: Tables) -> DataFrame:
    term = F.col("term")
    rows = t.orders.select(term_label(F.col("o_orderdate")).alias("term")).distinct()
    order = Window.orderBy(term_year(term), season_rank(season_of(term)))  # one row for each term there is: a few
    return rows.select("term", (F.row_number().over(order) - 1).alias("ord"))


def plan_lines(t: Tables) -> DataFrame:
    """(plan, term_idx, term, course, line): term_idx: months since 1990."""
    d = F.col("l_shipdate")
    return t.lineitem.select(
        F.col("l_orderkey").alias("plan"), ((F.year(d) - 1990) * 12 + F.month(d)).alias("term_idx"), term_label(d).alias("term"), F.col("l_partkey").alias("course"), F.col("l_linenumber").alias("line")
    )


LINES = f"""lines AS (
    SELECT l_orderkey AS plan, (year(l_shipdate) - 1990) * 12 + month(l_shipdate) AS term_idx, {TERM.format('l_shipdate')} AS term,
           {SEASON.format('l_shipdate')} AS season, l_partkey AS course, l_linenumber AS line, l_shipdate FROM lineitem)"""
OFFERED = """offered AS (SELECT DISTINCT course, term, season FROM lines WHERE line <= 3 AND l_shipdate < TIMESTAMP '1999-01-01')"""
AVAILABLE = f"""
    WITH {LINES}, {OFFERED}, judged AS (
        SELECT plan, term, course, line, CASE WHEN term IN (SELECT term FROM offered) THEN (course, term) IN (SELECT (course, term) FROM offered)
               ELSE (course, season) IN (SELECT (course, season) FROM offered) END AS is_offered
        FROM lines WHERE line > 3 AND course IN (SELECT course FROM offered))"""


def judged(t: Tables) -> DataFrame:
    lines = plan_lines(t)
    offered = lines.where("line <= 3 and term_idx <= 108").select("course", "term")
    return validation.availability(lines.where("line > 3"), offered)


@query(AVAILABLE + " SELECT term, count(*) AS n, count(*) FILTER (WHERE is_offered) AS n_offered FROM judged GROUP BY term")
def offered_exact_or_season(t: Tables) -> DataFrame:
    return judged(t).groupBy("term").agg(F.count("*").alias("n"), F.count_if("is_offered").alias("n_offered"))


@query("SELECT l_orderkey AS plan, l_partkey AS course, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def plan_duplicates(t: Tables) -> DataFrame:
    return validation.duplicates(plan_lines(t))


CLASHES = "SELECT l_orderkey AS plan, l_partkey // 2 AS set_id, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY ALL HAVING count(DISTINCT l_partkey) > 1"


@query(CLASHES)
def credit_exclusion_clash(t: Tables) -> DataFrame:
    sets = t.part.select(F.floor(F.col("p_partkey") / 2).alias("set_id"), F.col("p_partkey").alias("course"))
    return validation.exclusion_clashes(plan_lines(t), sets)


def earlier_sql(op: str) -> str:
    return f"""
        WITH {LINES}, k AS (SELECT *, course % 5 AS class FROM lines)
        SELECT a.plan, a.line, a.class = 0 OR EXISTS (SELECT 1 FROM k b WHERE b.plan = a.plan AND b.term_idx {op} a.term_idx AND b.class = (a.class + 4) % 5) AS ok
        FROM k a"""


def earlier(t: Tables, same_term: bool) -> DataFrame:
    """Each course of class k > 0 (its number modulo 5) needs one of class k - 1."""
    cls = F.pmod(F.col("course"), F.lit(5))
    rows = validation.with_earlier(plan_lines(t), cls, same_term)
    return rows.select("plan", "line", ((cls == 0) | F.array_contains("earlier", F.pmod(cls + 4, F.lit(5)))).alias("ok"))


@query(earlier_sql("<"))
def prereq_before_strict(t: Tables) -> DataFrame:
    return earlier(t, False)


@query(earlier_sql("<="))
def coreq_same_or_before(t: Tables) -> DataFrame:
    return earlier(t, True)


#: Classes 0 and 1; or 2 with 3 or 4.
RULE = {"one_of": [{"all_of": ["0", "1"]}, {"all_of": ["2", {"one_of": ["3", "4"]}]}]}
RULE_SQL = """
    SELECT plan, (h0 AND h1) OR (h2 AND (h3 OR h4)) AS ok
    FROM (SELECT l_orderkey AS plan, bool_or(l_partkey % 7 = 0) AS h0, bool_or(l_partkey % 7 = 1) AS h1, bool_or(l_partkey % 7 = 2) AS h2,
                 bool_or(l_partkey % 7 = 3) AS h3, bool_or(l_partkey % 7 = 4) AS h4 FROM lineitem GROUP BY l_orderkey)"""


@query(RULE_SQL)
def bool_expr_nodes(t: Tables) -> DataFrame:
    sets = plan_lines(t).select("plan", F.pmod("course", F.lit(7)).cast("string").alias("course"))
    tree = t.spark.createDataFrame(rules.nodes(RULE), rules.NODE)
    return rules.evaluate_nodes(sets, tree, "plan").select("plan", "ok")


@query(RULE_SQL)
def bool_expr_compiled(t: Tables) -> DataFrame:
    held = plan_lines(t).groupBy("plan").agg(F.collect_set(F.pmod("course", F.lit(7)).cast("string")).alias("held"))
    rule = rules.compile_rule(RULE, lambda c: F.array_contains("held", c), lambda p: F.lit(False), {})
    return held.select("plan", rule.alias("ok"))


@query("""
    WITH o AS (SELECT l_orderkey AS plan, bool_or(l_partkey % 13 = 0) AS hit FROM lineitem GROUP BY l_orderkey)
    SELECT plan, sum(CASE WHEN l_partkey % 11 IN (1, 2) OR (NOT hit AND l_partkey % 11 = 3) OR (hit AND l_partkey % 11 = 4) THEN 1 ELSE 0 END)::BIGINT AS n_eligible
    FROM o JOIN lineitem ON l_orderkey = plan GROUP BY plan""")
def conditional_slot_rewrite(t: Tables) -> DataFrame:
    lines = plan_lines(t).select("plan", F.pmod("course", F.lit(11)).cast("string").alias("course"), (F.col("course") % 13 == 0).alias("hit"))
    slots = t.spark.createDataFrame([("s", "1"), ("s", "2"), ("s", "3")], "slot string, course string")
    triggers = t.spark.createDataFrame([("trigger", "s", c) for c in ("1", "2", "4")], "trigger string, slot string, course string")
    held = lines.select("plan", "course").unionByName(lines.where("hit").select("plan", F.lit("trigger").alias("course")))
    options = validation.overridden(slots, triggers, held)
    found = lines.join(options, ["plan", "course"]).groupBy("plan").agg(F.count("*").alias("n"))
    return lines.select("plan").distinct().join(found, "plan", "left").select("plan", F.coalesce("n", F.lit(0)).alias("n_eligible"))


@query("""
    SELECT plan, slot, greatest(0, 3 - count(l_partkey))::BIGINT AS short
    FROM (SELECT o_orderkey AS plan, slot FROM orders, range(4) r(slot)) LEFT JOIN lineitem ON l_orderkey = plan AND l_partkey % 4 = slot GROUP BY ALL""")
def slot_shortfall_bucket(t: Tables) -> DataFrame:
    every = t.orders.select(F.col("o_orderkey").alias("plan"), F.explode(F.sequence(F.lit(0), F.lit(3)).cast("array<long>")).alias("slot"))
    have = plan_lines(t).groupBy("plan", F.pmod("course", F.lit(4)).alias("slot")).agg(F.count("*").alias("n"))
    return every.join(have, ["plan", "slot"], "left").select("plan", "slot", F.greatest(F.lit(0), 3 - F.coalesce("n", F.lit(0))).alias("short"))


#: Six slots: places, and the classes (number modulo 12) that fit each.
NEED = [1, 1, 2, 1, 2, 1]
FITS = [(0, 1), (1, 2), (2, 3, 4), (4,), (5, 6, 7, 8), (8, 9)]


def masks(t: Tables) -> DataFrame:
    mask = F.lit(0)
    for k, classes in enumerate(FITS):
        mask = mask.bitwiseOR(F.when(F.pmod("course", F.lit(12)).isin(*classes), 1 << k).otherwise(0))
    return dealt(plan_lines(t).select("plan", "course"), "plan").distinct().select("plan", "course", mask.alias("mask"))


MASK_SQL = " | ".join(f"(CASE WHEN l_partkey % 12 IN ({', '.join(map(str, c))}) THEN {1 << k} ELSE 0 END)" for k, c in enumerate(FITS))


@query(f"""
    WITH m AS (SELECT l_orderkey AS plan, {MASK_SQL} AS mask FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)),
    s AS (SELECT s AS slots, {' + '.join(f'{n} * (s >> {k} & 1)' for k, n in enumerate(NEED))} AS need FROM range(64) r(s))
    SELECT plan, max(short)::BIGINT AS shortfall
    FROM (SELECT plan, slots, any_value(need) - count(*) FILTER (WHERE mask & slots <> 0) AS short FROM m, s GROUP BY plan, slots) GROUP BY plan""")
def global_match_deficiency(t: Tables) -> DataFrame:
    return matching.shortfall(masks(t), NEED)


@query()
def match_assignment(t: Tables) -> DataFrame:
    return matching.assignments(masks(t), NEED)


@query("""
    SELECT l_orderkey AS plan, (year(l_shipdate) - 1990) * 12 + month(l_shipdate) AS term_idx, round(sum(l_quantity), 2) AS load, sum(l_quantity) <= 60 AS fits
    FROM lineitem GROUP BY ALL""")
def term_load_cap(t: Tables) -> DataFrame:
    d = F.col("l_shipdate")
    rows = t.lineitem.groupBy(F.col("l_orderkey").alias("plan"), ((F.year(d) - 1990) * 12 + F.month(d)).alias("term_idx"))
    return rows.agg(F.round(F.sum("l_quantity"), 2).alias("load"), (F.sum("l_quantity") <= 60).alias("fits"))


def ineligible(lines: DataFrame) -> DataFrame:
    """(plan, course): courses of class 7 (their number modulo 11) of plans that hold one of class 5."""
    cls = F.pmod("course", F.lit(11))
    held = lines.groupBy("plan").agg(F.bool_or(cls == 5).alias("active"), F.collect_set(F.when(cls == 7, F.col("course"))).alias("some"))
    return held.where("active").select("plan", F.explode("some").alias("course"))


def failures(t: Tables) -> DataFrame:
    lines = plan_lines(t)
    text = lambda template, *cols: F.format_string(template, *cols)
    sets = t.part.select(F.floor(F.col("p_partkey") / 2).alias("set_id"), F.col("p_partkey").alias("course"))
    return validation.report(
        duplicate_course=validation.duplicates(lines).select("plan", text("course %d credited more than once", F.col("course")).alias("detail")),
        ineligible_course=ineligible(lines).select("plan", text("course %d is ineligible", F.col("course")).alias("detail")),
        credit_exclusion=validation.exclusion_clashes(lines, sets).select("plan", text("at most one of set %d may earn credit", F.col("set_id")).alias("detail")),
        not_offered=judged(t).where("not is_offered").select("plan", text("%d is not offered in %s", F.col("course"), F.col("term")).alias("detail")),
        prereq_unsatisfied=earlier(t, False).where("not ok").select("plan", text("line %d prereq not met", F.col("line")).alias("detail")),
        coreq_unsatisfied=earlier(t, True).where("not ok").select("plan", text("line %d coreq not met", F.col("line")).alias("detail")),
        requirement_shortfall=matching.shortfall(masks(t), NEED).where("shortfall > 0").select("plan", text("short %d", F.col("shortfall")).alias("detail")),
    )


@query(AVAILABLE + f""", k AS (SELECT *, course % 5 AS class FROM lines),
    m AS (SELECT l_orderkey AS plan, {MASK_SQL} AS mask FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)),
    s AS (SELECT s AS slots, {' + '.join(f'{n} * (s >> {k} & 1)' for k, n in enumerate(NEED))} AS need FROM range(64) r(s)),
    f AS (
    SELECT l_orderkey AS plan, 0 AS seq, 'duplicate_course' AS code, 'course ' || l_partkey || ' credited more than once' AS detail FROM lineitem GROUP BY l_orderkey, l_partkey HAVING count(*) > 1
    UNION ALL SELECT DISTINCT plan, 1, 'ineligible_course', 'course ' || course || ' is ineligible' FROM lines
        WHERE course % 11 = 7 AND plan IN (SELECT plan FROM lines WHERE course % 11 = 5)
    UNION ALL SELECT plan, 2, 'credit_exclusion', 'at most one of set ' || set_id || ' may earn credit' FROM ({CLASHES})
    UNION ALL SELECT plan, 3, 'not_offered', course || ' is not offered in ' || term FROM judged WHERE NOT is_offered
    UNION ALL SELECT plan, 4, 'prereq_unsatisfied', 'line ' || line || ' prereq not met' FROM k a
        WHERE class <> 0 AND NOT EXISTS (SELECT 1 FROM k b WHERE b.plan = a.plan AND b.term_idx < a.term_idx AND b.class = (a.class + 4) % 5)
    UNION ALL SELECT plan, 5, 'coreq_unsatisfied', 'line ' || line || ' coreq not met' FROM k a
        WHERE class <> 0 AND NOT EXISTS (SELECT 1 FROM k b WHERE b.plan = a.plan AND b.term_idx <= a.term_idx AND b.class = (a.class + 4) % 5)
    UNION ALL SELECT plan, 6, 'requirement_shortfall', 'short ' || max(short) FROM (
        SELECT plan, slots, any_value(need) - count(*) FILTER (WHERE mask & slots <> 0) AS short FROM m, s GROUP BY plan, slots) GROUP BY plan HAVING max(short) > 0)
    SELECT plan, seq, code, detail FROM f""")
def validate_union(t: Tables) -> DataFrame:
    return failures(t)


@query("""
    (SELECT p_partkey FROM part WHERE p_size < 10 UNION SELECT p_partkey FROM part WHERE p_retailprice > 1500)
    INTERSECT SELECT p_partkey FROM part WHERE p_partkey % 2 = 0 EXCEPT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45""")
def program_universe_setops(t: Tables) -> DataFrame:
    either = t.part.where("p_size < 10").select("p_partkey").union(t.part.where("p_retailprice > 1500").select("p_partkey"))
    both = either.intersect(t.part.where("p_partkey % 2 = 0").select("p_partkey"))
    return both.subtract(t.lineitem.where("l_returnflag = 'R' and l_quantity > 45").select(F.col("l_partkey").alias("p_partkey")))


@query("""
    SELECT c_nationkey, o_orderkey FROM (
        SELECT c_nationkey, o_orderkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY o_totalprice DESC, o_orderkey) AS n
        FROM orders JOIN customer ON c_custkey = o_custkey) WHERE n <= 3""")
def limit_per_key(t: Tables) -> DataFrame:
    rows = t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey")).select("c_nationkey", "o_orderkey", F.struct(-F.col("o_totalprice"), "o_orderkey").alias("place"))
    return first_per_key(rows, "c_nationkey", "place", 3).select("c_nationkey", "o_orderkey")


@query(f"""
    SELECT l_partkey AS course, {TERM.format('l_shipdate')} AS term, count(*) AS n, round(sum(l_quantity), 2) AS capacity,
           string_agg(l_returnflag || l_linestatus, ' ' ORDER BY l_orderkey, l_linenumber, l_returnflag || l_linestatus) AS text
    FROM lineitem GROUP BY ALL""")
def span_offering_text(t: Tables) -> DataFrame:
    rows = t.lineitem.groupBy(F.col("l_partkey").alias("course"), term_label(F.col("l_shipdate")).alias("term"))
    item = F.struct("l_orderkey", "l_linenumber", F.concat("l_returnflag", "l_linestatus").alias("x"))
    return rows.agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("capacity"), F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda s: s["x"]), " ").alias("text"))


DRIFT = """
    SELECT coalesce(b.user_id, a.user_id) AS user_id, coalesce(b.event_type, a.event_type) AS event_type, b.n AS before, a.n AS after, b.n IS DISTINCT FROM a.n AS changed
    FROM (SELECT user_id, event_type, count(*) AS n FROM events WHERE event_id % 2 = 0 GROUP BY ALL) b
    FULL JOIN (SELECT user_id, event_type, count(*) AS n FROM events WHERE event_id % 2 = 1 GROUP BY ALL) a USING (user_id, event_type)"""


def halves(t: Tables) -> DataFrame:
    counted = lambda k: t.events.where(F.pmod("event_id", F.lit(2)) == k).groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return drift.diff(counted(0), counted(1), ["user_id", "event_type"], "n")


@query(DRIFT)
def snapshot_drift_diff(t: Tables) -> DataFrame:
    return halves(t)


@query(f"SELECT count(*) FILTER (WHERE changed) AS changed, count(*) AS total FROM ({DRIFT})")
def drift_changed_share(t: Tables) -> DataFrame:
    return drift.changed_share(halves(t))


@query("""
    SELECT user_id, event_id, kind, CASE kind WHEN 'seats_full' THEN 0.0 WHEN 'time_move' THEN value + 2 WHEN 'kept' THEN value END AS new_value
    FROM (SELECT user_id, event_id, value, CASE WHEN r = 1 THEN 'seats_full' WHEN r = n AND n > 2 THEN 'term_drop' WHEN r = 2 THEN 'time_move' ELSE 'kept' END AS kind
          FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM events))""")
def synthetic_drift(t: Tables) -> DataFrame:
    return drift.perturb(t.events.select("user_id", "event_id", "value"), "user_id", "event_id", "value").select("user_id", "event_id", "kind", "new_value")


EDGES = """(SELECT l_partkey AS course, min(l_suppkey) AS needs FROM lineitem GROUP BY l_partkey UNION SELECT l_partkey, max(l_suppkey) FROM lineitem GROUP BY l_partkey)"""


@query(f"WITH RECURSIVE e AS {EDGES}, r AS (SELECT * FROM e UNION SELECT r.course, e.needs FROM r JOIN e ON r.needs = e.course) SELECT course, needs, course = needs AS on_cycle FROM r")
def prerequisite_closure(t: Tables) -> DataFrame:
    """A part needs the least and the largest of its suppliers, whose numbers are parts too."""
    ends = t.lineitem.groupBy(F.col("l_partkey").alias("course")).agg(F.array(F.min("l_suppkey"), F.max("l_suppkey")).alias("n"))
    return closure.reached(ends.select("course", F.explode("n").alias("needs"))).select("course", "needs", (F.col("course") == F.col("needs")).alias("on_cycle"))


@query(f"""
    WITH m AS (SELECT l_orderkey AS plan, {MASK_SQL} AS mask FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)),
    s AS (SELECT s AS slots, {' + '.join(f'{n} * (s >> {k} & 1)' for k, n in enumerate(NEED))} AS need FROM range(64) r(s))
    SELECT plan, {sum(NEED)} - max(short)::BIGINT AS n_placed, CAST(0 AS BIGINT) AS n_over, CAST(0 AS BIGINT) AS n_unfit
    FROM (SELECT plan, slots, any_value(need) - count(*) FILTER (WHERE mask & slots <> 0) AS short FROM m, s GROUP BY plan, slots) GROUP BY plan""")
def match_assignment_judged(t: Tables) -> DataFrame:
    """Assignments are as large as Hall's theorem allows, no slot takes more than it needs, and none a course that doesn't fit."""
    rows = matching.assignments(masks(t), NEED).join(masks(t), ["plan", "course"])
    need = F.element_at(F.array(*map(F.lit, NEED)), F.col("slot") + 1)
    slots = rows.groupBy("plan", "slot").agg(F.count("*").alias("n"), F.count_if(F.shiftright(F.col("mask"), 0).bitwiseAND(F.expr("shiftleft(1, slot)")) == 0).alias("unfit"))
    over = F.when(F.col("slot").isNotNull() & (F.col("n") > need), F.col("n") - need).otherwise(0)
    return slots.groupBy("plan").agg(F.sum(F.when(F.col("slot").isNotNull(), F.col("n")).otherwise(0)).alias("n_placed"), F.sum(over).alias("n_over"), F.sum(F.when(F.col("slot").isNotNull(), F.col("unfit")).otherwise(0)).alias("n_unfit"))
