"""Answers: the stub model, its cost, grades and citation audits, and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import exclusive_quantiles, ratio
from ..functions.text import course_codes

# Phrases of denial and assent, checked in this order.
NOT_OFFERED = ["not offered", "isn't offered", "is not offered", "not available", "unavailable", "no longer", "not scheduled", "not being offered", "no, ", "no.", "not run"]
OFFERED = ["is offered", "yes", "offered in", "available", "runs", "is scheduled", "is being offered"]
INVALID = ["invalid", "not valid", "isn't valid", "does not satisfy", "doesn't satisfy", "fails", "not complete", "incomplete", "violat"]
VALID = ["valid", "satisfies", "meets all", "is complete", "fulfills", "fulfil"]
# US dollars for a million tokens of cached input, other input, and output.
PRICE_HIT, PRICE_MISS, PRICE_COMPLETION = 0.014, 0.14, 0.28


def stub_answer(prompt: Column) -> Column:
    """'[stub:<8 digits of sha1>] <first line that begins with a bracket>': what a model would say, from the prompt alone."""
    line = F.get(F.filter(F.split(prompt, "\n"), lambda x: F.startswith(F.ltrim(x), F.lit("["))), F.lit(0))
    return F.concat(F.lit("[stub:"), F.left(F.sha1(prompt), F.lit(8)), F.lit("] "), F.coalesce(F.trim(line), F.lit("")))


def stub_tokens(text: Column) -> Column:
    return F.floor(F.greatest(F.lit(1), F.length(text)) / 4)


def cost(hit: Column, miss: Column, completion: Column, digits: int = 10) -> Column:
    return F.round((hit * PRICE_HIT + miss * PRICE_MISS + completion * PRICE_COMPLETION) / 1_000_000, digits)


def audit(answers: DataFrame, facts: DataFrame) -> DataFrame:
    """answers (id, answer), facts (course, terms array, times array) -> (id, n_courses, bad_terms, bad_times, ok).

    Terms and times that an answer cites must be those of some course that it names and facts know; an answer that names none is ok.
    """
    text = F.col("answer")
    named = answers.select("id", F.explode(course_codes(text)).alias("course")).join(facts, "course")
    backed = named.groupBy("id").agg(F.count("*").alias("n_courses"), F.array_distinct(F.flatten(F.collect_list("terms"))).alias("ok_terms"), F.array_distinct(F.flatten(F.collect_list("times"))).alias("ok_times"))
    terms = F.array_distinct(F.regexp_extract_all(text, F.lit("\\b((?:Fall|Winter|Spring|Summer)\\s+Term\\s+[0-9]{4})\\b"), F.lit(1)))
    clock = F.lit("\\b([01]?[0-9]|2[0-3]):([0-5][0-9])\\b")
    times = F.array_distinct(F.transform(F.regexp_extract_all(text, clock, F.lit(0)), lambda t: F.lpad(t, 5, "0")))
    cited = answers.select("id", terms.alias("terms_cited"), times.alias("times_cited"))
    out = cited.join(backed, "id", "left")
    bad = lambda cited, ok: F.when(F.col("n_courses") > 0, F.size(F.array_except(cited, ok))).otherwise(0)
    out = out.select("id", F.coalesce("n_courses", F.lit(0)).alias("n_courses"), bad("terms_cited", "ok_terms").alias("bad_terms"), bad("times_cited", "ok_times").alias("bad_times"))
    return out.withColumn("ok", (F.col("bad_terms") + F.col("bad_times")) == 0)


def summary(results: DataFrame, config: str = "config", kind: str = "type") -> DataFrame:
    """Rows of graded answers -> by configuration, and by configuration and type (one pass over GROUPING SETS): n, quality, cost, cache rate."""
    return results.groupingSets([[config], [config, kind]], config, kind).agg(
        F.count("*").alias("n"),
        F.round(F.avg("quality"), 4).alias("quality"),
        F.round(F.sum("cost_usd"), 6).alias("cost_total"),
        F.round(F.avg("cost_usd"), 8).alias("cost_mean"),
        ratio(F.sum("hit_tokens"), F.sum("prompt_tokens")).alias("cache_rate"),
        F.round(F.avg(F.when(F.col(kind) == "factual_offered", F.col("citation_ok").cast("double"))), 4).alias("citation_rate"),
    )


def latency(results: DataFrame, config: str = "config") -> DataFrame:
    return exclusive_quantiles(results, [config], "latency_s", [50, 95])
