"""Question routing by phrase scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import phrase_hits, says

# The phrases that score a question as being about offerings, about rules, or as asking for a plan.
OFFERING_PHRASES = [
    "offered", "offering", "when", "what time", "time", "times", "schedule",
    "seat", "seats", "capacity", "full", "section", "lecture time", "room",
    "next term", "this term", "fall", "winter", "spring", "summer", "available",
]
RULES_PHRASES = [
    "prerequisite", "prereq", "require", "required", "requirement", "units",
    "credit", "exclusion", "valid", "invalid", "graduate", "eligible", "plan",
    "need to take", "can i take", "do i need", "satisfy", "count toward", "rule",
]
CONSTRUCTION_PHRASES = [
    "build a plan", "build a course plan", "course plan", "plan that completes",
    "plan to finish", "completes the computing science major", "finish the major",
]


def route_of(offering: Column, rules: Column, construction: Column, margin: Column | int = 1) -> Column:
    margin = F.lit(margin) if isinstance(margin, int) else margin
    return (
        F.when(construction | ((offering > 0) & (rules > 0) & (F.abs(offering - rules) <= margin)), "compound")
        .when(offering > rules, "rag")
        .when(rules > offering, "cag")
        .when(offering == 0, "rag")
        .otherwise("compound")
    )


def classify(
    df: DataFrame, text: str, margin: Column | int = 1, offering: Sequence[str] = OFFERING_PHRASES, rules: Sequence[str] = RULES_PHRASES, construction: Sequence[str] = CONSTRUCTION_PHRASES
) -> DataFrame:
    """df with offering_score, rules_score and route."""
    scored = df.withColumns({"offering_score": phrase_hits(F.col(text), offering), "rules_score": phrase_hits(F.col(text), rules)})
    return scored.withColumn("route", route_of(F.col("offering_score"), F.col("rules_score"), says(F.col(text), construction), margin))


def explanation() -> Column:
    return F.format_string("route=%s (offering=%d, rules=%d)", "route", "offering_score", "rules_score")


def margin_sweep(questions: DataFrame, text: str, margins: Sequence[int] = (0, 1, 2), **phrases) -> DataFrame:
    """Of each margin, the share of questions routed compound."""
    swept = questions.withColumn("margin", F.explode(F.array(*map(F.lit, margins))))
    return classify(swept, text, F.col("margin"), **phrases).groupBy("margin").agg(F.round(F.avg((F.col("route") == "compound").cast("double")), 3).alias("compound_share"))


def paraphrase_flips(pairs: DataFrame, base: str = "base", text: str = "text", **phrases) -> DataFrame:
    """pairs with base_route, route and flipped."""
    b = classify(pairs, base, **phrases).withColumnRenamed("route", "base_route").drop("offering_score", "rules_score")
    return classify(b, text, **phrases).withColumn("flipped", F.col("route") != F.col("base_route")).drop("offering_score", "rules_score")
