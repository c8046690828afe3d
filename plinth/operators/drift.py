"""Snapshots that differ: a diff by key, and synthetic drift for tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def diff(before: DataFrame, after: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, before, after, changed) of all keys of either snapshot; a missing side is null, and differs from any value."""
    b = before.select(*keys, F.col(value).alias("before"))
    a = after.select(*keys, F.col(value).alias("after"))
    return b.join(a, keys, "full_outer").withColumn("changed", ~F.col("before").eqNullSafe(F.col("after")))


def changed_share(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count_if("changed").alias("changed"), F.count("*").alias("total"))


def perturb(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """rows with ``kind`` and ``new_value``: the first row of each key is emptied (seats_full), the second moved (time_move), the last dropped (term_drop), the rest kept."""
    up = Window.partitionBy(key).orderBy(order)
    n = F.count("*").over(Window.partitionBy(key))
    r = F.row_number().over(up)
    kind = F.when(r == 1, "seats_full").when((r == n) & (n > 2), "term_drop").when(r == 2, "time_move").otherwise("kept")
    new = F.when(F.col("kind") == "seats_full", 0.0).when(F.col("kind") == "time_move", F.col(value) + 2).when(F.col("kind") == "kept", F.col(value))
    return rows.withColumn("kind", kind).withColumn("new_value", new)


def decay(rows: DataFrame, key: str, capacity: str, percent: int = 40, seed: int = 0) -> DataFrame:
    """Of non-zero capacities about ``percent`` % lose 1 to a third, by a hash of the key: the same in every run."""
    h = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(100))
    most = F.greatest(F.floor(F.col(capacity) / 3), F.lit(1))
    loss = F.pmod(F.xxhash64(F.col(key), F.lit(seed + 1)), most) + 1
    return rows.withColumn("decayed", F.when((F.col(capacity) > 0) & (h < percent), F.greatest(F.col(capacity) - loss, F.lit(0))).otherwise(F.col(capacity)))


CHANGE = "course string, kind string, term string, component string, new_capacity int, new_time_start string, new_time_end string"


def apply(snapshot: DataFrame, changes: DataFrame) -> DataFrame:
    """A snapshot (course_id, terms, sections, ...) after changes (CHANGE, and place: their order), each on one course.

    seats_full: the first section of the term (and component, if one is named) has new_capacity seats, 0 by default. time_move: the first meeting of that section
    begins and ends at the new times. term_drop: the term and its sections go. term_add: the term is appended, if it isn't there. A change without such a
    section, and one of a course that the snapshot doesn't hold, changes nothing; other kinds are passed over.
    """
    listed = changes.groupBy(F.col("course").alias("course_id")).agg(F.array_sort(F.collect_list(F.struct("place", "kind", "term", "component", "new_capacity", "new_time_start", "new_time_end"))).alias("__changes"))
    out = snapshot.join(listed, "course_id", "left")
    sections_type, terms_type = (snapshot.schema[c].dataType.simpleString() for c in ("sections", "terms"))

    def step(s: Column, c: Column) -> Column:
        fits = lambda x: F.coalesce((x["term"] == c["term"]) & (c["component"].isNull() | (x["component"] == c["component"])), F.lit(False))
        first = F.array_position(F.transform(s["sections"], fits), True)
        moved = lambda x: x.withField("meetings", F.transform(x["meetings"], lambda m, j: F.when(j == 0, m.withField("time_start", c["new_time_start"]).withField("time_end", c["new_time_end"])).otherwise(m)))
        changed = F.transform(s["sections"], lambda x, i: F.when((i + 1 == first) & (c["kind"] == "seats_full"), x.withField("capacity", F.coalesce(c["new_capacity"], F.lit(0)))).when((i + 1 == first) & (c["kind"] == "time_move"), moved(x)).otherwise(x))
        sections = F.when(c["kind"] == "term_drop", F.filter(s["sections"], lambda x: ~x["term"].eqNullSafe(c["term"]))).otherwise(changed)
        terms = F.when(c["kind"] == "term_drop", F.filter(s["terms"], lambda t: ~t.eqNullSafe(c["term"]))).when((c["kind"] == "term_add") & ~F.array_contains(s["terms"], c["term"]), F.array_append(s["terms"], c["term"])).otherwise(s["terms"])
        return F.struct(terms.cast(terms_type).alias("terms"), sections.cast(sections_type).alias("sections"))

    start = F.struct(F.coalesce("terms", F.array().cast(terms_type)).alias("terms"), F.coalesce("sections", F.array().cast(sections_type)).alias("sections"))
    folded = F.when(F.col("__changes").isNull(), start).otherwise(F.aggregate("__changes", start, step))
    return out.withColumn("__after", folded).withColumns({"terms": F.col("__after.terms"), "sections": F.col("__after.sections")}).select(snapshot.columns)
