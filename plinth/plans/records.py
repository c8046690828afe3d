"""Queries on orders, texts and limits of records, lists of programs, reports: the driver tables stand for them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clean, natural_key
from ..operators import programs, reports, rules_text
from ..operators.degree import Program
from ..sources.readers import first_per_key
from .registry import Tables, query
from .tables import TERM, term_label

CODED = "p_size || CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'A' ELSE 'B' END"


@query(f"""
    SELECT p_partkey, number, row_number() OVER (PARTITION BY p_brand ORDER BY CAST(regexp_extract(number, '([0-9]+)', 1) AS INTEGER), regexp_extract(number, '[0-9]+([A-Za-z]*)', 1), p_partkey) AS place
    FROM (SELECT p_partkey, p_brand, {CODED} AS number FROM part)""")
def natural_order(t: Tables) -> DataFrame:
    rows = t.part.select("p_partkey", "p_brand", F.concat(F.col("p_size").cast("string"), F.element_at(F.array(F.lit(""), F.lit("A"), F.lit("B")), (F.col("p_partkey") % 3 + 1).cast("int"))).alias("number"))
    key = natural_key(F.col("number"))
    return rows.select("p_partkey", "number", F.row_number().over(Window.partitionBy("p_brand").orderBy(key["number"], key["suffix"], "p_partkey")).alias("place"))


@query("""
    SELECT poid, coalesce(TRY_CAST(poid AS INTEGER), 0) AS key
    FROM (SELECT CASE WHEN n_nationkey % 2 = 0 THEN CAST(n_nationkey AS VARCHAR) ELSE n_name END AS poid FROM nation)""")
def program_order(t: Tables) -> DataFrame:
    poid = F.when(F.col("n_nationkey") % 2 == 0, F.col("n_nationkey").cast("string")).otherwise(F.col("n_name"))
    key = F.coalesce(poid.try_cast("int"), F.lit(0))
    return t.nation.select(poid.alias("poid"), key.alias("key")).orderBy("key", "poid")


@query("""
    SELECT event_type, event_id FROM (
        SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY (user_id <> 7), (value IS NULL OR value < 10), event_id) AS n FROM events) WHERE n <= 3""")
def samples_preferred(t: Tables) -> DataFrame:
    order = F.struct(F.col("user_id") != 7, F.coalesce(F.col("value") < 10, F.lit(True)), "event_id")
    return first_per_key(t.events.select("event_type", "event_id", order.alias("place")), "event_type", "place", 3).select("event_type", "event_id")


@query("SELECT conv_id, turn, role FROM conversations ORDER BY conv_id, turn, role LIMIT 50")
def query_set_limit(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", "role").orderBy("conv_id", "turn", "role").limit(50)


@query("SELECT event_id, event_type FROM events WHERE CAST(ts AS DATE) = (SELECT max(CAST(ts AS DATE)) FROM events)")
def latest_snapshot(t: Tables) -> DataFrame:
    rows = t.events.select("event_id", "event_type", F.to_date("ts").alias("snapshot_id"))
    last = rows.agg(F.max("snapshot_id").alias("snapshot_id"))
    return rows.join(F.broadcast(last), "snapshot_id").select("event_id", "event_type")


@query("""
    SELECT conv_id, coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS completion, coalesce(sum(CASE WHEN role <> 'assistant' THEN length(text) END), 0) AS prompt
    FROM conversations GROUP BY conv_id""")
def usage_sums(t: Tables) -> DataFrame:
    n, answer = F.length("text"), F.col("role") == "assistant"
    total = lambda c: F.coalesce(F.sum(F.when(c, n)), F.lit(0))
    return t.conversations.groupBy("conv_id").agg(total(answer).alias("completion"), total(~answer).alias("prompt"))


@query("SELECT role AS type, count(*) AS n FROM conversations GROUP BY role")
def counts_by_type(t: Tables) -> DataFrame:
    return t.conversations.groupBy(F.col("role").alias("type")).agg(F.count("*").alias("n"))


NAMES = ["Bachelor of Science in Nursing", "Bachelor of Science in Engineering", "Bachelor of Science", "Bachelor of Arts in", "Bachelor of Law", "Master of", "Doctor of", "Diploma in"]
NAMED = f"list_extract({NAMES!r}, CAST(p_partkey % {len(NAMES)} AS INTEGER) + 1) || ' ' || p_name"


@query(f"""
    SELECT p_partkey, CASE WHEN name LIKE 'Bachelor of Science in Nursing%' THEN 'BScN' WHEN name LIKE 'Bachelor of Science in Engineering%' THEN 'BSc Eng' WHEN name LIKE 'Bachelor of Science%' THEN 'BSc'
        WHEN name LIKE 'Bachelor of Arts%' THEN 'BA' WHEN name LIKE 'Bachelor of%' THEN 'B?' WHEN name LIKE 'Master of%' THEN 'M?' WHEN name LIKE 'Doctor of%' THEN 'D?' END AS degree
    FROM (SELECT p_partkey, {NAMED} AS name FROM part)""")
def degree_codes(t: Tables) -> DataFrame:
    name = F.concat_ws(" ", F.element_at(F.array(*map(F.lit, NAMES)), (F.col("p_partkey") % len(NAMES) + 1).cast("int")), "p_name")
    return t.part.select("p_partkey", programs.degree_of(name).alias("degree"))


@query(r"""
    SELECT p_partkey, CASE WHEN p_partkey % 4 < 3 THEN CASE WHEN p_partkey % 4 = 2 THEN 'E E ' ELSE 'PART ' END || p_size || CASE WHEN p_partkey % 4 = 1 THEN 'B' ELSE '' END END AS code FROM part""")
def course_code_of_text(t: Tables) -> DataFrame:
    kind = F.col("p_partkey") % 4
    text = F.concat(F.when(kind == 2, "E E  ").when(kind == 3, "part ").otherwise("  PART\t"), F.col("p_size").cast("string"), F.when(kind == 1, "B").otherwise(""), F.lit(" - "), F.col("p_name"))
    return t.part.select("p_partkey", programs.code_of(text).alias("code"))


@query(r"SELECT doc_id, regexp_matches(text, '(?i)(\d+\s*units?\b|\bfrom\b|★|\bone of\b|\beach of\b|\bunits? from\b)') AS rule FROM documents")
def rule_text(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", programs.is_rule(F.col("text")).alias("rule"))


@query("""
    SELECT l_orderkey AS plan, round(sum(coalesce(g.units, s.units, 0.0)), 2) AS units
    FROM lineitem LEFT JOIN (SELECT p_partkey, CAST(p_size AS DOUBLE) AS units FROM part WHERE p_size < 10) g ON g.p_partkey = l_partkey
    LEFT JOIN (SELECT p_partkey, 3.0 AS units FROM part WHERE p_partkey % 3 <> 0) s ON s.p_partkey = l_partkey GROUP BY l_orderkey""")
def units_lookup(t: Tables) -> DataFrame:
    gold = t.part.where("p_size < 10").select(F.col("p_partkey").alias("l_partkey"), F.col("p_size").cast("double").alias("stated"))
    snapshot = t.part.where("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("l_partkey"), F.lit(3.0).alias("listed"))
    rows = t.lineitem.select("l_orderkey", "l_partkey").join(gold, "l_partkey", "left").join(snapshot, "l_partkey", "left")
    return rows.groupBy(F.col("l_orderkey").alias("plan")).agg(F.round(F.sum(F.coalesce("stated", "listed", F.lit(0.0))), 2).alias("units"))


@query("SELECT p_brand, count(*) AS n FROM part WHERE p_brand IN ('Brand#11', 'Brand#23', 'Brand#55') GROUP BY p_brand")
def subject_filter(t: Tables) -> DataFrame:
    return t.part.where(F.col("p_brand").isin("Brand#11", "Brand#23", "Brand#55")).groupBy("p_brand").agg(F.count("*").alias("n"))


@query("""
    SELECT poid, arg_min(name, page_id) AS name, CASE WHEN poid IN ('1', '12', '53') THEN 'gold' ELSE 'silver' END AS tier
    FROM (SELECT page_id, regexp_extract(url, '/([0-9]+)', 1) AS poid, regexp_replace(trim(regexp_extract(html, '<title>([^<]*)</title>', 1)), '[ \t\n\r]+', ' ', 'g') AS name FROM pages WHERE url IS NOT NULL)
    WHERE poid <> '' GROUP BY poid""")
def program_discovery(t: Tables) -> DataFrame:
    links = t.pages.where("url is not null").select(F.col("page_id").alias("page"), F.lit(0).alias("pos"), F.col("url").alias("href"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("text"))
    return programs.discover(links, ["1", "12", "53"], "/([0-9]+)")


@query("""
    SELECT p_brand AS id, '[group:' || p_brand || '] ' || CASE WHEN p_brand < 'Brand#3' THEN 'ALL of: ' || string_agg(p_name, '; ' ORDER BY p_partkey) || '.'
        ELSE '6 units from: ' || string_agg(p_name, ', ' ORDER BY p_partkey) || '.' END AS clause FROM part WHERE p_size < 4 GROUP BY p_brand""")
def group_clauses(t: Tables) -> DataFrame:
    some = F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "p_name"))), lambda s: s["p_name"])
    rows = t.part.where("p_size < 4").groupBy(F.col("p_brand").alias("id")).agg(some.alias("members"))
    kind = F.when(F.col("id") < "Brand#3", "all_of").otherwise("units_from")
    return rows.select("id", rules_text.group_clause(F.col("id"), kind, F.col("members"), F.lit("6")).alias("clause"))


MEASURES = """SELECT role, CAST(count(*) AS DOUBLE) AS n, avg(length(text)) AS length, CAST(max(turn) AS DOUBLE) AS turns FROM conversations GROUP BY role"""


@query(f"""
    SELECT metric, round(max(CASE WHEN role = 'user' THEN value END), 6) AS "user", round(max(CASE WHEN role = 'assistant' THEN value END), 6) AS assistant
    FROM (SELECT role, unnest(['n', 'length', 'turns']) AS metric, unnest([n, length, turns]) AS value FROM ({MEASURES})) GROUP BY metric""")
def metrics_by_config(t: Tables) -> DataFrame:
    rows = t.conversations.groupBy("role").agg(F.count("*").cast("double").alias("n"), F.avg(F.length("text")).alias("length"), F.max("turn").alias("turns"))
    out = reports.by_config(rows, ["user", "assistant"], ["n", "length", "turns"], "role")
    return out.select("metric", *(F.round(c, 6).alias(c) for c in ("user", "assistant")))


@query("SELECT conv_id, turn, role, left(text, 500) AS text FROM conversations WHERE role = 'assistant'")
def row_log(t: Tables) -> DataFrame:
    return reports.row_log(t.conversations.where("role = 'assistant'").select("conv_id", "turn", "role", "text"), "text")


@query(f"""
    WITH f AS (SELECT {TERM.format('o_orderdate')} AS scope, 'order ' || o_orderkey AS message FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 300000),
    q AS (SELECT scope, count(*) AS total, array_to_string(list_slice(list_sort(list(message)), 1, 5), '; ') AS firsts FROM f GROUP BY scope)
    SELECT 0 AS part, '0' AS key, '# Orders' AS line UNION ALL SELECT 1, '', '## Counts' UNION ALL SELECT 3, '', '## Failures'
    UNION ALL SELECT 2, o_orderstatus, '- ' || o_orderstatus || ': ' || count(*) FROM orders GROUP BY o_orderstatus
    UNION ALL SELECT 4, scope, '- ' || scope || ' (' || total || '): ' || firsts FROM q""")
def run_report(t: Tables) -> DataFrame:
    bad = t.orders.where("o_orderstatus = 'F' and o_totalprice > 300000").withColumn("scope", term_label(F.col("o_orderdate")))
    queue = reports.failure_queue(bad, "scope", F.concat(F.lit("order "), F.col("o_orderkey").cast("string")), 5)
    return reports.markdown_lines("Orders", t.orders.groupBy(F.col("o_orderstatus").alias("name")).agg(F.count("*").alias("n")), queue)


@query("SELECT count(*) AS pages, count(DISTINCT regexp_extract(url, '://([^/]*)', 1)) AS hosts, sum(length(regexp_replace(trim(coalesce(html, '')), '[ \t\n\r\f\x0b]+', ' ', 'g'))) AS characters FROM pages WHERE url IS NOT NULL")
def page_counts(t: Tables) -> DataFrame:
    squeezed = F.length(F.regexp_replace(F.trim(F.coalesce("html", F.lit(""))), "[ \t\n\r\f\x0b]+", " "))
    return t.pages.where("url is not null").agg(F.count("*").alias("pages"), F.count_distinct(F.regexp_extract("url", "://([^/]*)", 1)).alias("hosts"), F.sum(squeezed).alias("characters"))
