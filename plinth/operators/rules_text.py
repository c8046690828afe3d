"""A program's rules as one text, a clause a line, each with the id that answers may cite. Wording and order are fixed values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .degree import Program

LINE = "line int, clause string, text string"
TITLES = {
    "groups": "REQUIREMENT GROUPS (each course credits to at most one group):",
    "conditionals": "CONDITIONALS:",
    "exclusions": "CREDIT EXCLUSIONS (at most one course per set earns credit):",
    "prerequisites": "PREREQUISITES (course: structured prereq — verbatim calendar source):",
}


def pattern_words(p: dict) -> str:
    levels = "/".join(f"{x}-level" for x in p.get("level_in", []))
    return " ".join(["any", *filter(None, [p.get("subject"), levels, f">={p['level_gte']}-level" if "level_gte" in p else None]), "course"])


#: How the kinds of rules are said; a rule is a course, null or a mapping of one of these.
SAID = {
    "one_of": lambda x: "one of (" + ", ".join(map(words, x)) + ")",
    "all_of": lambda x: " and ".join(map(words, x)),
    "hs": lambda x: f"high-school {x}",
    "pattern": pattern_words,
}


def words(rule) -> str:
    """A rule in words."""
    kind = next((k for k in SAID if isinstance(rule, dict) and k in rule), None)
    return "none" if rule is None else SAID[kind](rule[kind]) if kind else str(rule)


def group_clause(group: Column, kind: Column, members: Column, units: Column) -> Column:
    """The clause of a group: what its members or its options are, ready as texts; units as text."""
    begin = F.concat(F.lit("[group:"), group, F.lit("] "))
    return F.when(kind == "all_of", F.concat(begin, F.lit("ALL of: "), F.array_join(members, "; "), F.lit("."))).otherwise(F.concat(begin, units, F.lit(" units from: "), F.array_join(members, ", "), F.lit(".")))


def lines(spark: SparkSession, program: Program, name: str = "", year: str = "", units: str = "") -> DataFrame:
    """(line, clause, text) of a program's rules; clause: the id that may be cited, null for headings and exclusions."""
    section = {
        "groups": [(f"group:{g.id}", _group(g)) for g in program.groups],
        "conditionals": [(f"note:{c.id}", f"when {c.trigger} is taken: {c.ineligible} becomes ineligible; group {c.group} -> options {list(c.options)}" + (f" plus {pattern_words(c.pattern)}" if c.pattern else "") + ".") for c in program.conditionals],
        "exclusions": [(None, f"[exclusion] {', '.join(e)}") for e in program.exclusions],
        "prerequisites": [(f"prereq:{c}", words(p.rule) + (f"; corequisite: {words(p.coreq)}" if p.coreq is not None else "") + (f'  (source: "{p.source}")' if p.source else "")) for c, p in sorted(program.prerequisites.items())],
    }
    out = [(None, f"PROGRAM: {name} (catalog year {year}), {units} units of major requirements."), (None, "Scope: major requirements + prerequisite feasibility (not the full BSc).")]
    for key, some in section.items():
        out += [(None, ""), (None, TITLES[key]), *((i, f"  [{i}] {t}" if i else f"  {t}") for i, t in some)]
    return spark.createDataFrame([(k, i, t) for k, (i, t) in enumerate(out)], LINE)


def _group(g) -> str:
    if g.type == "all_of":
        return "ALL of: " + "; ".join(map(words, g.members)) + "."
    if g.type == "units_from_pattern":
        return f"{float(g.units)} units from {pattern_words(g.pattern)}."
    return f"{float(g.units)} units from: {', '.join(g.options)}."


def text(rows: DataFrame) -> DataFrame:
    """One row: the whole text, its length, and the ids that may be cited, in order."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda s: s["text"]), "\n")
    return rows.agg(joined.alias("rules"), F.array_sort(F.collect_set("clause")).alias("clauses")).withColumn("length", F.length("rules"))
