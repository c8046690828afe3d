"""Validation of degree plans against a program's rules and a snapshot of offerings.

Rules are small and known when the plan is built: they become columns and literal arrays. Plans are rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .matching import assign_units
from .rules import compile_rule
from .validation import availability, with_earlier

PLAN = "plan string, term_idx int, term string, pos int, course string"


@dataclass(frozen=True)
class Group:
    id: str
    type: str  # all_of, units_from or units_from_pattern
    members: tuple = ()
    units: int = 0
    options: tuple[str, ...] = ()
    pattern: dict | None = None


@dataclass(frozen=True)
class Conditional:
    """Holding ``trigger`` makes ``ineligible`` earn nothing and replaces the options of a group of one slot."""

    id: str
    trigger: str
    ineligible: str | None
    group: str | None
    options: tuple[str, ...]
    pattern: dict | None = None


@dataclass(frozen=True)
class Prerequisite:
    rule: object = None
    source: str | None = None
    coreq: object = None
    coreq_source: str | None = None


@dataclass(frozen=True)
class Program:
    named: tuple[str, ...]
    groups: tuple[Group, ...]
    conditionals: tuple[Conditional, ...] = ()
    exclusions: tuple[tuple[str, ...], ...] = ()
    prerequisites: dict[str, Prerequisite] = field(default_factory=dict)
    units: dict[str, float] = field(default_factory=dict)  # of courses whose units the program itself states


@dataclass(frozen=True)
class Slot:
    """What may fill it: options, or courses that fit the pattern. units: None if one course fills it."""

    group: str
    label: str
    options: frozenset[str]
    pattern: dict | None = None
    units: float | None = None


#: Of a catalogue's entries: (subject, level) or (subject, level, units).
Catalogue = dict[str, tuple]


def units_of(program: Program, catalogue: Catalogue, course: str) -> float:
    """What the program says, else the catalogue, else 0."""
    return float(program.units.get(course, (*catalogue.get(course, ()), None, None, None)[2] or 0.0))


def fits(pattern: dict | None, subject: str | None, level: int | None) -> bool:
    """Subject and level fit; an unknown level never does."""
    return pattern is not None and level is not None and pattern.get("subject", subject) == subject and (level in pattern["level_in"] if "level_in" in pattern else True) and level >= pattern.get("level_gte", level)


#: What each type of group asks for: (options, pattern, units; None: one course) of each of its slots.
CHOICES = {
    "all_of": lambda g: [((m,) if isinstance(m, str) else tuple(m["one_of"]), None, None) for m in g.members],
    "units_from": lambda g: [(g.options, None, float(g.units))],
    "units_from_pattern": lambda g: [((), g.pattern, float(g.units))],
}


def _label(options, pattern, units: float | None, rewritten: bool = False) -> str:  # fixed wording
    if units is None:
        return options[0] if len(options) == 1 else "one of " + ", ".join(sorted(options))
    if rewritten:
        return f"{units}u from {sorted(options)} or {pattern}"
    return f"{units}u from {', '.join(options)}" if options else f"{units}u matching {pattern}"


def slots_of(group: Group) -> list[Slot]:
    """A group's slots, by the table of types."""
    if group.type not in CHOICES or not all(isinstance(m, str) or "one_of" in m for m in group.members):
        raise ValueError(f"group {group.id} has a type or a member that is not known")
    return [Slot(group.id, _label(*choice), frozenset(choice[0]), *choice[1:]) for choice in CHOICES[group.type](group)]


def requirements(program: Program, held: set[str]) -> tuple[list[Slot], set[str], list[str]]:
    """Slots, ineligible courses and applied conditionals of one who holds these courses."""
    active = [c for c in program.conditionals if c.trigger in held]
    changed = {c.group: c for c in active if c.group}
    slots = [s for g in program.groups for s in slots_of(g)]
    if wrong := [g for g in changed if sum(s.group == g for s in slots) != 1]:
        raise ValueError(f"conditionals change groups of several slots: {wrong}")
    slots = [Slot(s.group, _label(c.options, c.pattern, s.units, True), frozenset(c.options), c.pattern, s.units) if (c := changed.get(s.group)) else s for s in slots]
    return slots, {c.ineligible for c in active if c.ineligible}, [c.id for c in active]


def program_courses(program: Program, catalogue: Catalogue) -> set[str]:
    """Courses that the program names, or that fit a pattern of it."""
    slots = [s for g in program.groups for s in slots_of(g)]
    return set(program.named).union(*(s.options for s in slots)) | {c for c, x in catalogue.items() if any(fits(s.pattern, *x[:2]) for s in slots)}


def rule_column(rule, available: Column, program: set[str], catalogue: Catalogue, assume_external: bool = True) -> Column:
    """A rule over an array of courses. High-school courses are held by all; courses outside the program too, if assumed."""

    def has(course: str) -> Column:
        return F.lit(True) if assume_external and course not in program else F.array_contains(available, course)

    def matches(pattern: dict) -> Column:
        some = [c for c, x in catalogue.items() if fits(pattern, *x[:2])]
        return F.arrays_overlap(available, F.array(*map(F.lit, some))) if some else F.lit(False)

    class Held(dict):
        def get(self, key, default=None):
            return True

    return F.coalesce(compile_rule(rule, has, matches, Held()), F.lit(False))


def _failure(rows: DataFrame, seq: int, code: str, detail: Column, courses: Column, place: Column | None = None) -> DataFrame:
    """seq and place: the order of a plan's failures."""
    at = F.lit(0).cast("long") if place is None else place.cast("long")
    return rows.select("plan", F.lit(seq).alias("seq"), at.alias("place"), F.lit(code).alias("code"), detail.alias("detail"), courses.alias("courses"))


UNMET = "plan string, place int, group_id string, label string, exactly_one boolean, earned double, short double, assigned array<string>"


def unmet(held: DataFrame, program: Program, catalogue: Catalogue) -> DataFrame:
    """held (plan, course), distinct -> (plan, place, group_id, label, exactly_one, earned, short, assigned) of slots that stay short, in units (exactly_one: in courses).

    Plans that hold the same courses are matched once.
    """
    kind = held.schema["plan"].dataType.simpleString()
    sets = held.groupBy("plan").agg(F.array_sort(F.collect_set("course")).alias("courses")).withColumn("key", F.to_json("courses"))

    def one(batches):
        for pdf in batches:
            rows = []
            for key, courses in zip(pdf["key"], pdf["courses"], strict=True):
                slots, ineligible, _ = requirements(program, set(courses))
                own = [c for c in courses if c not in ineligible]
                masks = [sum((c in s.options or fits(s.pattern, *catalogue.get(c, (None, None))[:2])) << k for k, s in enumerate(slots)) for c in own]
                units = [units_of(program, catalogue, c) for c in own]
                place = assign_units(units, [s.units for s in slots], masks)
                for k, s in enumerate(slots):
                    there = [i for i, p in enumerate(place) if p == k]
                    earned = sum(units[i] for i in there)
                    short = float(not there) if s.units is None else max(0.0, s.units - earned)
                    if short > 1e-9:
                        rows.append((key, k, s.group, s.label, s.units is None, earned, short, [own[i] for i in there]))
            yield pd.DataFrame(rows, columns=["key", *(x.split()[0] for x in UNMET.split(", ")[1:])])

    tasks = held.sparkSession.sparkContext.defaultParallelism
    short = sets.select("key", "courses").distinct().repartition(tasks, "key").mapInPandas(one, UNMET.replace("plan string", "key string"))
    return sets.select("plan", "key").join(short, "key").select(F.col("plan").cast(kind).alias("plan"), *(x.split()[0] for x in UNMET.split(", ")[1:]))


def _number(x: Column) -> Column:
    """Without a fraction where there is none."""
    return F.when(x == F.floor(x), F.floor(x).cast("string")).otherwise(F.regexp_replace(F.format_string("%.4f", x), "0+$", ""))


def validate(plans: DataFrame, program: Program, catalogue: Catalogue, offered: DataFrame, assume_external: bool = True) -> DataFrame:
    """plans (PLAN), catalogue course -> (subject, level, units), offered (course, term) -> failures (plan, seq, place, code, detail, courses).

    A plan without a row is valid. Terms count by their place in the plan, not by their labels.
    """
    ours = program_courses(program, catalogue)
    held = plans.select("plan", "course").distinct()
    twice = plans.groupBy("plan", "course").count().where("count > 1").groupBy("plan").agg(F.array_sort(F.collect_list("course")).alias("courses"))
    out = _failure(twice, 0, "duplicate_course", F.lit("course credited more than once"), F.col("courses"))
    by_plan = held.groupBy("plan").agg(F.array_sort(F.collect_list("course")).alias("held"))
    for c in (c for c in program.conditionals if c.ineligible):
        bad = by_plan.where(F.array_contains("held", c.trigger) & F.array_contains("held", c.ineligible))
        out = out.unionByName(_failure(bad, 1, "ineligible_course", F.lit("course is ineligible under an active conditional and earns no credit"), F.array(F.lit(c.ineligible))))
    for e in program.exclusions:
        clash = F.array_intersect("held", F.array(*map(F.lit, e)))
        names = "[" + ", ".join(f"'{c}'" for c in e) + "]"
        out = out.unionByName(_failure(by_plan.where(F.size(clash) > 1), 2, "credit_exclusion", F.lit(f"at most one of {names} may earn credit"), clash))
    terms = offered.groupBy("course").agg(F.array_join(F.array_sort(F.collect_set("term")), ", ").alias("terms"))
    missed = availability(plans, offered).where("not is_offered").join(terms, "course", "left")
    detail = F.format_string("%s is not offered in %s; offered: %s", "course", "term", F.coalesce("terms", F.lit("(no terms in snapshot)")))
    where = F.col("term_idx") * F.lit(1 << 20) + F.col("pos")  # prerequisites and corequisites of one course stand together
    out = out.unionByName(_failure(missed, 3, "not_offered", detail, F.array("course"), where))
    for same, code, seq, words in ((False, "prereq_unsatisfied", 4, "prereq not met before"), (True, "coreq_unsatisfied", 4, "coreq not met by")):
        rows = with_earlier(plans, F.col("course"), same)
        ok, source = F.lit(True), F.lit(None).cast("string")
        for course, p in program.prerequisites.items():
            rule, text = (p.coreq, p.coreq_source) if same else (p.rule, p.source)
            if rule is not None:
                ok = F.when(F.col("course") == course, rule_column(rule, F.col("earlier"), ours, catalogue, assume_external)).otherwise(ok)
                source = F.when(F.col("course") == course, F.lit(text)).otherwise(source)
        bad = rows.where("term_idx >= 0").where(~ok).withColumn("source", source)
        out = out.unionByName(_failure(bad, seq, code, F.format_string(f'%s {words} %s: "%s"', "course", "term", "source"), F.array("course"), where * 2 + int(same)))
    short = unmet(held, program, catalogue)
    units = F.format_string("unmet requirement '%s' (%s): have %su, short %su", "group_id", "label", _number(F.col("earned")), _number(F.col("short")))  # fixed wording, as that of all failures
    one = F.format_string("unmet requirement '%s': need %s", "group_id", "label")
    return out.unionByName(_failure(short, 6, "requirement_shortfall", F.when(F.col("exactly_one"), one).otherwise(units), F.col("assigned"), F.col("place")))


def unverified(plans: DataFrame, program: Program, catalogue: Catalogue) -> DataFrame:
    """(plan, note) of scheduled program courses that no verified prerequisite stands for."""
    some = sorted(program_courses(program, catalogue) - set(program.named) - set(program.prerequisites))
    return plans.where(F.col("term_idx") >= 0).where(F.col("course").isin(some)).select("plan", F.concat("course", F.lit(": prereq unverified")).alias("note"))


def verdicts(plans: DataFrame, failures: DataFrame) -> DataFrame:
    """(plan, valid) of all plans."""
    return plans.select("plan").distinct().join(failures.select("plan").distinct().withColumn("bad", F.lit(True)), "plan", "left").select("plan", F.col("bad").isNull().alias("valid"))


def rendered() -> Column:
    """'code: detail [courses]'."""
    return F.concat("code", F.lit(": "), "detail", F.when(F.size("courses") > 0, F.concat(F.lit(" ["), F.array_join("courses", ", "), F.lit("]"))).otherwise(""))
