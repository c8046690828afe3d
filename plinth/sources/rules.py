"""Rules files (YAML) as programs, snapshots (one JSON document) as rows, and search indexes that are kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.terms import season_of
from ..operators.degree import Conditional, Group, Prerequisite, Program

SNAPSHOT = "snapshot_date string, source string, term_order array<string>, courses map<string, struct<units:double,subject:string,level:int,title:string,terms:array<string>,prereq_raw:string,coreq_raw:string,credit_exclusion_raw:string>>"


def program_of(rules: dict) -> Program:
    """A program from a rules document: courses, groups, conditionals, credit_exclusions, prerequisites, each of which may be missing or null."""
    part = lambda name, empty: rules.get(name) or empty
    either = lambda effects, name: next((e[name] for e in effects if name in e), {})
    conditionals = []
    for c in part("conditionals", []):
        changed = either(c.get("effects") or [], "modify_group")
        conditionals.append(Conditional(c["id"], (c.get("when") or {}).get("taken"), either(c.get("effects") or [], "ineligible") or None, changed.get("id"), tuple(changed.get("set_options") or ()), changed.get("add_pattern")))
    courses = part("courses", {})
    return Program(
        named=tuple(courses),
        groups=tuple(Group(g["id"], g["type"], tuple(g.get("members") or ()), g.get("units_required") or 0, tuple(g.get("options") or ()), g.get("pattern")) for g in part("groups", [])),
        conditionals=tuple(conditionals),
        exclusions=tuple(tuple(x["set"]) for x in part("credit_exclusions", [])),
        prerequisites={c: Prerequisite(*((e or {}).get(k) for k in ("prereq", "source", "coreq", "coreq_source"))) for c, e in part("prerequisites", {}).items()},
        units={c: float(x["units"]) for c, x in courses.items() if x and x.get("units") is not None},
    )


def read_program(path: str) -> Program:
    """A rules file, on the driver: rules are small."""
    import yaml

    with open(path, encoding="utf-8") as f:
        return program_of(yaml.safe_load(f) or {})


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """(snapshot_id, course_id, units, subject, level, title, terms, ...) of snapshot documents, a row for each course; unknown units are 0."""
    rows = spark.read.schema(SNAPSHOT).option("multiLine", "true").json(path)
    entries = rows.select(F.col("snapshot_date").alias("snapshot_id"), F.explode(F.map_entries("courses")).alias("e")).select("snapshot_id", F.col("e.key").alias("course_id"), "e.value.*")
    return entries.withColumns({"units": F.coalesce("units", F.lit(0.0)), "terms": F.coalesce("terms", F.array().cast("array<string>"))})


def read_terms(spark: SparkSession, path: str) -> DataFrame:
    """(snapshot_id, term, ord, season) in the order that the documents state."""
    rows = spark.read.schema(SNAPSHOT).option("multiLine", "true").json(path)
    return rows.select(F.col("snapshot_date").alias("snapshot_id"), F.posexplode("term_order").alias("ord", "term")).select("snapshot_id", "term", "ord", season_of(F.col("term")).alias("season"))


def save_index(path: str, spans: DataFrame, weights: DataFrame, idf: DataFrame, **meta: str) -> None:
    """Spans, their weights by bucket, the frequencies they were made with, and a row of facts about the index."""
    for name, df in (("spans", spans), ("weights", weights), ("idf", idf), ("meta", spans.sparkSession.createDataFrame([(k, str(v)) for k, v in sorted(meta.items())], "name string, value string"))):
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def load_index(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a kept index; a query is encoded with its own frequencies."""
    return {name: spark.read.parquet(f"{path}/{name}") for name in ("spans", "weights", "idf", "meta")}
