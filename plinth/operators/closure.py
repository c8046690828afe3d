"""What a course needs in the end: the transitive closure of a graph of courses, and the cycles in it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.batches import WAVES, dealt, parts
from ..sources.scratch import kept
from .degree import Program
from .rules import leaves

#: Courses of a group that stand in a list.
MEMBERS = 4096


def program_edges(spark: SparkSession, program: Program) -> DataFrame:
    """(course, needs): the courses that rules name, prerequisites and corequisites alike."""
    rows = sorted({(c, x) for c, p in program.prerequisites.items() for rule in (p.rule, p.coreq) for x in leaves(rule)})
    return spark.createDataFrame(rows, "course string, needs string")


def closure(edges: DataFrame, most: int = 10_000) -> DataFrame:
    """edges (course, needs) -> (course, needs, steps): all that a course leads to, by the least number of steps; (x, x) where x is on a cycle.

    Rounds go over courses that something needs, the only ones that can stand within a path; those that nothing needs are one step before them, and are added
    by one join at the end. Null ends lead nowhere and are dropped; no edges, no rows. More than ``most`` rounds are an error.
    """
    edges = kept(edges.select("course", "needs").where("course is not null and needs is not null").distinct(), "edges")
    needed = edges.select(F.col("needs").alias("course")).distinct()
    within = _rounds(kept(edges.join(needed, "course", "left_semi"), "within"), most)
    first = edges.join(needed, "course", "left_anti")
    on = within.select(F.col("course").alias("needs"), F.col("needs").alias("next"), "steps")
    reached = dealt(first, "needs").join(on, "needs").select("course", F.col("next").alias("needs"), (F.col("steps") + 1).alias("steps"))
    return within.unionByName(first.withColumn("steps", F.lit(1)).unionByName(reached).groupBy("course", "needs").agg(F.min("steps").alias("steps")))


def _rounds(edges: DataFrame, most: int) -> DataFrame:
    """The closure of a kept table of edges. Semi-naive: each round follows only the pairs that the round before was the first to find, so it ends with or without cycles; a round's pairs are written, which cuts lineage."""
    found = last = edges.withColumn("steps", F.lit(1))
    step = edges.select(F.col("course").alias("needs"), F.col("needs").alias("next"))
    for k in range(2, most + 2):
        reached = last.select("course", "needs").join(step, "needs").select("course", F.col("next").alias("needs")).distinct()
        last = kept(reached.join(found, ["course", "needs"], "left_anti").withColumn("steps", F.lit(k)), "reached")
        if last.isEmpty():
            return found
        found = found.unionByName(last)
    raise RuntimeError(f"the closure did not end in {most} rounds")


def reached(edges: DataFrame, most: int = 10_000) -> DataFrame:
    """edges (course, needs) -> (course, needs): all that a course leads to, as closure says it, without steps.

    Courses that need each other lead to the same, so they are followed as one; what is followed and kept are groups, which each pair spreads out to courses at
    the end. The result may be far larger than all that is shuffled.
    """
    edges = kept(edges.select("course", "needs").where("course is not null and needs is not null").distinct(), "edges")
    needed = edges.select(F.col("needs").alias("course")).distinct()
    within = kept(edges.join(needed, "course", "left_semi"), "within")
    group = kept(groups(within, most), "groups")

    def folded(df: DataFrame, *ends: str) -> DataFrame:
        for end in ends:
            df = df.join(group.select(F.col("course").alias(end), "at"), end, "left").withColumn(end, F.coalesce("at", end)).drop("at")
        return df.select("course", "needs").distinct()

    on = _rounds(kept(folded(within, "course", "needs"), "folded"), most).select(F.col("course").alias("at"), F.col("needs").alias("next"))
    on = kept(on, "on")
    first = kept(folded(edges.join(needed, "course", "left_anti"), "needs"), "first")
    before = first.unionByName(dealt(first, "needs").join(on, F.col("needs") == F.col("at")).select("course", F.col("next").alias("needs"))).distinct()
    inside = within.select("course").distinct().join(group, "course", "left").withColumn("at", F.coalesce("at", "course")).join(on, "at").select("course", F.col("next").alias("needs"))
    return _spread(kept(before.unionByName(inside), "pairs"), group)


def _spread(pairs: DataFrame, group: DataFrame) -> DataFrame:
    """pairs (course, needs) with groups among needs -> all pairs of courses. A group's courses are listed MEMBERS at a time, and pairs of one group are dealt to many tasks."""
    size = group.groupBy("at").agg(F.ceil(F.count("*") / MEMBERS).alias("n"))
    lists = group.join(size, "at").groupBy("at", F.pmod(F.xxhash64("course"), "n").alias("part")).agg(F.collect_list("course").alias("all")).select("at", "all")
    lists = kept(lists, "lists")
    of = pairs.join(lists.select(F.col("at").alias("needs")).distinct(), "needs", "left_semi")
    deals = WAVES * parts(pairs.sparkSession)
    one = dealt(of.withColumn("deal", F.pmod(F.xxhash64("course"), F.lit(deals))), "needs", "deal")
    each = lists.withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(deals - 1)))).withColumn("deal", F.col("deal").cast("long")).withColumnRenamed("at", "needs")
    spread = one.join(each, ["needs", "deal"]).select("course", F.explode("all").alias("needs"))
    return pairs.join(lists.select(F.col("at").alias("needs")).distinct(), "needs", "left_anti").select("course", "needs").unionByName(spread)


def groups(edges: DataFrame, most: int = 10_000) -> DataFrame:
    """edges (course, needs) -> (course, at): the courses that are on a cycle with others, with the largest of those that they share cycles with.

    In turns: courses that nothing left leads to, or that lead to nothing left, are on no cycle; the others take the largest course that leads to them, and those
    that lead back to it, through courses that took it too, are its group. A turn settles all these groups at once.
    """
    rest = kept(edges.where("course <> needs").select("course", "needs").distinct(), "rest")
    found = edges.select("course", F.col("course").alias("at")).limit(0)
    n = rest.count()
    for _ in range(most):
        while n:
            both = rest.select("course").intersect(rest.select("needs")).withColumnRenamed("course", "x")
            both = kept(both, "both")
            rest = kept(rest.join(both, F.col("course") == F.col("x"), "left_semi").join(both, F.col("needs") == F.col("x"), "left_semi"), "rest")
            before, n = n, rest.count()
            if n == before:
                break
        if not n:
            return found
        taken = last = kept(rest.select("course", F.col("course").alias("at")).distinct(), "taken")
        while not last.isEmpty():
            told = rest.join(last, "course").groupBy(F.col("needs").alias("course")).agg(F.max("at").alias("told"))
            last = kept(told.join(taken, "course").where("told > at").select("course", F.col("told").alias("at")), "told")
            taken = kept(taken.unionByName(last).groupBy("course").agg(F.max("at").alias("at")), "taken")
        alike = rest.join(taken, "course").join(taken.select(F.col("course").alias("needs"), F.col("at").alias("also")), "needs").where("at = also")
        alike = kept(alike.select("course", "needs"), "alike")
        back = last = kept(taken.where("course = at"), "back")
        while not last.isEmpty():
            more = alike.join(last.select(F.col("course").alias("needs"), "at"), "needs").select("course", "at").distinct()
            last = kept(more.join(back, "course", "left_anti"), "back")
            back = back.unionByName(last)
        back = kept(back, "back")
        shared = back.groupBy("at").agg(F.count("*").alias("n")).where("n > 1").select("at")
        found = found.unionByName(back.join(shared, "at", "left_semi").select("course", "at"))
        rest = kept(rest.join(back, "course", "left_anti").join(back.select(F.col("course").alias("needs")), "needs", "left_anti").select("course", "needs"), "rest")
        n = rest.count()
    raise RuntimeError(f"the groups did not end in {most} turns")


def cycles(closed: DataFrame) -> DataFrame:
    """(course, steps) of the courses that need themselves in the end, with the length of their shortest cycle."""
    return closed.where("course = needs").select("course", "steps")
