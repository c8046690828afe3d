"""An evaluation from its query set to its report: four types of questions, results by configuration, findings, what moved between snapshots."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import ratio
from ..sources.documents import plan_text
from ..sources.readers import write_csv
from . import grading
from .drift import diff

QUESTION = "id string, type string, text string, course string, term string, plan string, taken array<string>"
# Types of questions, in the order of reports; the columns of the results; wording of questions.
TYPES = ("factual_offered", "factual_prereq", "plan_validity", "plan_construction")
RESULTS = ("config", "quality_overall", *TYPES, "citation_pass_rate", "cost_usd_total", "latency_p50", "latency_p95", "cache_hit_rate")
VALID = "Is the following Computing Science major plan valid? "
BUILD = "Build a course plan that completes the Computing Science major in as few terms as possible."
CONFIGS_MOST = 1000
HOW = (
    " Use alternating Fall and Winter terms (label them 'Fall' / 'Winter'). Only place a course in a term in which it is offered, and respect prerequisites (a prerequisite must be in an earlier term)."
    " Output ONLY YAML with a 'terms' list, each item having a 'term' and a list of 'courses'."
)


def _questions(rows: DataFrame, kind: str, text: Column, number: Column, **given: Column) -> DataFrame:
    fields = dict.fromkeys(("course", "term", "plan"), F.lit(None).cast("string")) | {"taken": F.lit(None).cast("array<string>")} | given
    return rows.select(F.format_string("%s_%03d", F.lit(kind), number.cast("long")).alias("id"), F.lit(kind).alias("type"), text.alias("text"), *(c.alias(n) for n, c in fields.items()))


def query_set(offered: DataFrame, prereq: DataFrame, plans: DataFrame, taken: DataFrame) -> DataFrame:
    """offered (n, course, term), prereq (n, course), plans (degree.PLAN and n, a plan's number), taken (n, taken) -> QUESTION. n: the number in the id."""
    c, t = F.col("course"), F.col("term")
    out = _questions(offered, TYPES[0], F.concat(F.lit("Is "), c, F.lit(" offered in "), t, F.lit("?")), F.col("n"), course=c, term=t)
    out = out.unionByName(_questions(prereq, TYPES[1], F.concat(F.lit("What is the prerequisite for "), c, F.lit("?")), F.col("n"), course=c))
    told = plan_text(plans).join(plans.groupBy("plan").agg(F.min("n").alias("n")), "plan")
    out = out.unionByName(_questions(told, TYPES[2], F.concat(F.lit(VALID), F.col("text")), F.col("n"), plan=F.col("plan").cast("string")))
    had = F.coalesce("taken", F.array().cast("array<string>"))
    done = F.when(F.size(had) > 0, F.concat(F.lit(" I have already completed: "), F.array_join(had, ", "), F.lit("."))).otherwise(" I am starting fresh.")
    return out.unionByName(_questions(taken, TYPES[3], F.concat(F.lit(BUILD), done, F.lit(HOW)), F.col("n"), taken=had))


def results(rows: DataFrame) -> DataFrame:
    """Graded answers (config, type, quality, citation_ok, cost_usd, hit_tokens, prompt_tokens, latency_s) -> RESULTS and n, cost_usd_mean: a row for each configuration.

    A type without questions has no quality; citations count for questions about offerings only.
    """
    of = lambda t: F.round(F.avg(F.when(F.col("type") == t, F.col("quality"))), 4).alias(t)
    sums = rows.groupBy("config").agg(
        F.round(F.avg("quality"), 4).alias("quality_overall"), *map(of, TYPES), F.round(F.avg(F.when(F.col("type") == TYPES[0], F.col("citation_ok").cast("double"))), 4).alias("citation_pass_rate"),
        F.round(F.sum("cost_usd"), 6).alias("cost_usd_total"), ratio(F.sum("hit_tokens"), F.sum("prompt_tokens")).alias("cache_hit_rate"), F.count("*").alias("n"), F.round(F.avg("cost_usd"), 8).alias("cost_usd_mean"),
    )
    waits = grading.latency(rows.where("latency_s is not null")).select("config", F.col("p50").alias("latency_p50"), F.col("p95").alias("latency_p95"))
    return sums.join(waits, "config", "left").select(*RESULTS, "n", "cost_usd_mean")


def write_results(table: DataFrame, folder: str, **meta) -> None:
    """results.csv with the columns of RESULTS, results.json with a field for each configuration and one for meta."""
    rows = table.orderBy("config").limit(CONFIGS_MOST + 1).collect()
    if len(rows) > CONFIGS_MOST:
        raise ValueError(f"more than {CONFIGS_MOST} configurations")
    write_csv(table.sparkSession.createDataFrame(rows, table.schema).select(*RESULTS).orderBy("config"), f"{folder}/results.csv")
    text = json.dumps({r["config"]: {k: v for k, v in r.asDict().items() if k != "config"} for r in rows} | {"meta": meta}, indent=2)
    table.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/results.json")


def findings(table: DataFrame) -> DataFrame:
    """(place, line): which configuration is best over all and by type, and which costs least; ties to the first name. table: a row for each configuration."""
    lines = []
    for k, (what, name) in enumerate((("over all", "quality_overall"), *((f"for {t}", t) for t in TYPES))):
        best = F.min_by("config", F.struct(F.col(name).isNull(), -F.col(name), "config"))
        lines.append(F.when(F.max(name).isNotNull(), F.struct(F.lit(k).alias("place"), F.format_string(f"- Best {what}: %s (%.3f); least: %.3f", best, F.max(name), F.min(name)).alias("line"))))
    cheap = F.min_by("config", F.struct("cost_usd_total", "config"))
    lines.append(F.when(F.count("*") > 0, F.struct(F.lit(len(lines)).alias("place"), F.format_string("- Cheapest: %s ($%.6f in all)", cheap, F.min("cost_usd_total")).alias("line"))))
    return table.agg(F.array_compact(F.array(*lines)).alias("x")).select(F.inline("x"))


def comparison(table: DataFrame) -> DataFrame:
    """(place, line): the results as a Markdown table, a column for each configuration in order of name."""
    shown = [c for c in table.columns if c in RESULTS[1:]]
    shape = lambda c: "%.6f" if "cost" in c else "%.4f"
    said = lambda c: F.when(F.col(c).isNull(), "-").otherwise(F.format_string(shape(c), F.col(c).cast("double")))
    long = table.select("config", F.inline(F.array(*(F.struct(F.lit(k + 2).alias("place"), F.lit(c).alias("name"), said(c).alias("v")) for k, c in enumerate(shown)))))
    cells = F.transform(F.array_sort(F.collect_list(F.struct("config", "v"))), lambda s: s["v"])
    body = long.groupBy("place", "name").agg(F.array_join(cells, " | ").alias("x")).select("place", F.concat(F.lit("| "), "name", F.lit(" | "), "x", F.lit(" |")).alias("line"))
    names = table.agg(F.array_sort(F.collect_list("config")).alias("x"))
    head = names.select(F.lit(0).alias("place"), F.concat(F.lit("| metric | "), F.array_join("x", " | "), F.lit(" |")).alias("line"))
    rule = names.select(F.lit(1).alias("place"), F.concat(F.lit("|---|"), F.repeat(F.lit("---|"), F.size("x"))).alias("line"))
    return head.unionByName(rule).unionByName(body)


def freshness(before: DataFrame, after: DataFrame, rules_before: DataFrame, rules_after: DataFrame) -> DataFrame:
    """Facts (question, value) of two snapshots and of their rules -> (question, kind, before, after, changed): kind 'data' or 'rule'. A fact that one side lacks has changed."""
    one = lambda b, a, kind: diff(b, a, ["question"], "value").select("question", F.lit(kind).alias("kind"), "before", "after", "changed")
    return one(before, after, "data").unionByName(one(rules_before, rules_after, "rule"))


def freshness_lines(rows: DataFrame) -> DataFrame:
    """(place, line): freshness as Markdown, its counts last."""
    head = rows.sparkSession.createDataFrame([(0, "| question | kind | before | after | changed |"), (1, "|---|---|---|---|---|")], "place int, line string")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    body = rows.select(F.when(F.col("kind") == "data", 2).otherwise(3).alias("place"), F.concat_ws(" | ", F.concat(F.lit("| "), "question"), "kind", text("before"), text("after"), F.concat(F.when(F.col("changed"), "yes").otherwise("no"), F.lit(" |"))).alias("line"))
    is_ = lambda k: F.col("kind") == k
    told = F.format_string("%d of %d data facts changed; %d of %d rule facts are stable.", F.count_if(is_("data") & F.col("changed")), F.count_if(is_("data")), F.count_if(is_("rule") & ~F.col("changed")), F.count_if(is_("rule")))
    return head.unionByName(body).unionByName(rows.agg(told.alias("line")).select(F.lit(4).alias("place"), "line"))


def report(table: DataFrame, meta: dict, fresh: DataFrame | None = None, flips: DataFrame | None = None) -> DataFrame:
    """(part, key, line) for reports.write_markdown: what was run, findings, the table, and what moved; flips: paraphrase_flips' rows."""
    spark = table.sparkSession
    part = lambda k, df: df.select(F.lit(k).alias("part"), F.format_string("%06d", F.col("place")).alias("key"), "line")
    fixed = [(0, "000000", "# Evaluation"), (1, "000000", "## Run")] + [(1, f"{i + 1:06d}", f"- {k}: {v}") for i, (k, v) in enumerate(meta.items())] + [(2, "", "## Findings"), (4, "", "## By configuration")]
    if meta.get("stub"):
        fixed.append((0, "000001", "> Answers are a stub's: the figures show that everything runs, and say nothing of a model."))
    out = spark.createDataFrame(fixed, "part int, key string, line string").unionByName(part(3, findings(table))).unionByName(part(5, comparison(table)))
    if fresh is not None:
        out = out.unionByName(spark.createDataFrame([(6, "", "## Freshness")], "part int, key string, line string")).unionByName(part(7, freshness_lines(fresh)))
    if flips is not None:
        told = flips.agg(F.format_string("%d of %d paraphrases change the route (%.2f).", F.count_if("flipped"), F.count("*"), F.coalesce(F.avg(F.col("flipped").cast("double")), F.lit(0.0))).alias("line"))
        out = out.unionByName(spark.createDataFrame([(8, "", "## Routes")], "part int, key string, line string")).unionByName(part(9, told.select(F.lit(0).alias("place"), "line")))
    return out
