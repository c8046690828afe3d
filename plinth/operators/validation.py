"""Plan validation: each check is a DataFrame of failures; a plan's report is their union.

plan_course (plan, term_idx, term, course): term_idx -1 for what was taken before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.terms import season_of

#: Order of checks in a report.
CODES = ("duplicate_course", "ineligible_course", "credit_exclusion", "not_offered", "prereq_unsatisfied", "coreq_unsatisfied", "requirement_shortfall")


def duplicates(plan_course: DataFrame) -> DataFrame:
    """(plan, course, n) of courses that a plan holds more than once."""
    return plan_course.groupBy("plan", "course").agg(F.count("*").alias("n")).where("n > 1")


def exclusion_clashes(plan_course: DataFrame, exclusions: DataFrame) -> DataFrame:
    """exclusions (set_id, course) -> (plan, set_id, n) of sets of which a plan holds several courses."""
    held = plan_course.select("plan", "course").distinct()
    return held.join(exclusions, "course").groupBy("plan", "set_id").agg(F.count("*").alias("n")).where("n > 1")


def availability(plan_course: DataFrame, offered: DataFrame) -> DataFrame:
    """offered (course, term) -> plan_course rows of known courses with is_offered: in that term if the snapshot knows it, else in its season."""
    terms = offered.select("term").distinct().withColumn("term_known", F.lit(True))
    exact = offered.select("course", "term").distinct().withColumn("in_term", F.lit(True))
    seasons = offered.select("course", season_of(F.col("term")).alias("season")).distinct().withColumn("in_season", F.lit(True))
    known = offered.select("course").distinct()
    rows = plan_course.where("term_idx >= 0").join(known, "course", "left_semi").withColumn("season", season_of(F.col("term")))
    rows = rows.join(terms, "term", "left").join(exact, ["course", "term"], "left").join(seasons, ["course", "season"], "left")
    is_offered = F.when(F.coalesce("term_known", F.lit(False)), F.coalesce("in_term", F.lit(False))).otherwise(F.coalesce("in_season", F.lit(False)))
    return rows.withColumn("is_offered", is_offered).drop("term_known", "in_term", "in_season", "season")


def with_earlier(plan_course: DataFrame, value: Column, same_term: bool = False) -> DataFrame:
    """plan_course with ``earlier``: the distinct values in strictly earlier terms of the plan (or in the same one too)."""
    frame = Window.partitionBy("plan").orderBy("term_idx").rangeBetween(Window.unboundedPreceding, 0 if same_term else -1)
    return plan_course.withColumn("earlier", F.collect_set(value).over(frame))


def overridden(slots: DataFrame, triggers: DataFrame, plan_course: DataFrame) -> DataFrame:
    """slots (slot, course), triggers (trigger, slot, course): of each plan the options of its slots, replaced where it holds the trigger."""
    plans = plan_course.select("plan").distinct()
    hits = plan_course.join(F.broadcast(triggers.select(F.col("trigger").alias("course"), "slot").distinct()), "course").select("plan", "slot").distinct()
    base = plans.join(F.broadcast(slots)).join(hits, ["plan", "slot"], "left_anti").select("plan", "slot", "course")
    return base.unionByName(hits.join(F.broadcast(triggers.select("slot", "course").distinct()), "slot").select("plan", "slot", "course"))


def report(**checks: DataFrame) -> DataFrame:
    """Failures (plan, detail) by code -> (plan, seq, code, detail)."""
    out = None
    for k, code in enumerate(CODES):
        if code in checks:
            part = checks[code].select("plan", F.lit(k).alias("seq"), F.lit(code).alias("code"), "detail")
            out = part if out is None else out.unionByName(part)
    return out
