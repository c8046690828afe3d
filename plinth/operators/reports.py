"""Tables that reports are made of, and reports as lines of Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ANSWER_MOST = 500


def by_config(results: DataFrame, configs: list[str], metrics: list[str], config: str = "config") -> DataFrame:
    """results, a row for each config -> (metric, a column for each config, in the order given), a row for each metric."""
    long = results.select(config, F.explode(F.array(*(F.struct(F.lit(k).alias("place"), F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for k, m in enumerate(metrics)))).alias("x")).select(config, "x.*")
    return long.groupBy("place", "metric").agg(*(F.max(F.when(F.col(config) == c, F.col("value"))).alias(c) for c in configs)).select("metric", *configs)


def row_log(rows: DataFrame, answer: str = "answer", most: int = ANSWER_MOST) -> DataFrame:
    """Rows with their answers cut for the log; the answers themselves stay where they are."""
    return rows.withColumn(answer, F.left(F.col(answer), F.lit(most)))


def failure_queue(failures: DataFrame, scope: str, message: Column, most: int) -> DataFrame:
    """(scope, total, first): of each scope the number of failures and the first ``most`` messages, in order; a null message counts, but isn't listed.

    Places are limited within each task before they are shuffled, so a scope of any size is a few messages where they meet.
    """
    rows = failures.select(scope, message.alias("message"))
    totals = rows.groupBy(scope).agg(F.count("*").alias("total"))
    order = Window.partitionBy(scope).orderBy("message")
    few = rows.where("message is not null").withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)
    first = few.groupBy(scope).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "message"))), lambda s: s["message"]).alias("first"))
    both = totals.alias("t").join(first.withColumnRenamed(scope, "scope_"), F.col(f"t.{scope}").eqNullSafe(F.col("scope_")), "left")
    kind = failures.select(message.alias("m")).schema["m"].dataType.simpleString()
    return both.select(F.col(f"t.{scope}").alias(scope), "total", F.coalesce("first", F.array().cast(f"array<{kind}>")).alias("first"))


def markdown_lines(title: str, counts: DataFrame, queue: DataFrame) -> DataFrame:
    """counts (name, n) and queue (scope, total, first) -> (part, key, line): the lines of a run report in order of part and key."""
    spark = counts.sparkSession
    head = spark.createDataFrame([(0, "0", f"# {title}"), (1, "", "## Counts"), (3, "", "## Failures")], "part int, key string, line string")
    n = counts.select(F.lit(2).alias("part"), F.col("name").alias("key"), F.concat(F.lit("- "), "name", F.lit(": "), F.col("n").cast("string")).alias("line"))
    scopes = queue.select(F.lit(4).alias("part"), F.col("scope").alias("key"), F.concat(F.lit("- "), "scope", F.lit(" ("), F.col("total").cast("string"), F.lit("): "), F.array_join("first", "; ")).alias("line"))
    return head.unionByName(n).unionByName(scopes)


def write_markdown(lines: DataFrame, path: str, most: int = 100_000) -> None:
    """Lines in order as one text file; a report of more than ``most`` lines is an error, not cut."""
    rows = lines.orderBy("part", "key").limit(most + 1).select("line").collect()
    if len(rows) > most:
        raise ValueError(f"the report has more than {most} lines")
    with open(path, "w", encoding="utf-8") as f:
        f.write("\n".join(r["line"] for r in rows) + "\n")


def needs_review(programs: DataFrame, blocks: DataFrame) -> DataFrame:
    """(poid, pos, html) of the blocks of programs whose parse isn't sure, to be looked at by hand."""
    return blocks.join(programs.where("parse_confidence <> 'high'").select("poid"), "poid", "left_semi").select("poid", "pos", "html")


def run_lines(courses: DataFrame, most: int = 100, samples: int = 3) -> DataFrame:
    """Courses of parse_courses -> (part, key, line) of a run report: counts, sections that don't match what pages state, samples, and failures by kind.

    All mismatches are listed; of each kind of failure the number and the first ``most``. Samples are the first courses by id, those with sections before others.
    """
    spark, n = courses.sparkSession, F.size("sections")
    fixed = spark.createDataFrame([(0, "", "# Run report"), (1, "", "## Counts"), (3, "", "## Section counts that differ from the page's"), (5, "", "## Samples"), (7, "", "## Failures")], "part int, key string, line string")
    sums = courses.agg(
        F.count("*").alias("Courses"), F.count_if(F.col("career") == "UGRD").alias("of these UGRD"), F.count_if(F.col("career").isNotNull() & (F.col("career") != "UGRD")).alias("of other careers"),
        F.count_distinct("subject").alias("Subjects"), F.coalesce(F.sum(n), F.lit(0)).alias("Sections"), F.count_if(F.size("flags") > 0).alias("Courses with flags"),
    )
    rows = sums.select(F.inline(F.array(*(F.struct(F.lit(f"{k}").alias("key"), F.lit(c).alias("name"), F.col(f"`{c}`").alias("n")) for k, c in enumerate(sums.columns)))))
    out = fixed.unionByName(rows.select(F.lit(2).alias("part"), "key", F.format_string("- %s: %d", "name", "n").alias("line")))
    differ = courses.where(F.col("meta_sections").isNotNull() & (F.col("meta_sections") != n))
    out = out.unionByName(differ.select(F.lit(4).alias("part"), F.col("course_id").alias("key"), F.format_string("- %s: parsed %d, stated %d", "course_id", n, "meta_sections").alias("line")))
    first = courses.select("course_id", (n == 0).alias("bare"), F.to_json(F.struct(*courses.columns)).alias("x")).orderBy("bare", "course_id", "x").limit(samples)
    out = out.unionByName(first.select(F.lit(6).alias("part"), F.concat(F.col("bare").cast("string"), "course_id").alias("key"), F.col("x").alias("line")))
    kind = F.regexp_extract(F.regexp_replace("flag", "^\\[[^\\]]*\\] ", ""), "^[^:]*", 0)
    flags = courses.select("course_id", F.explode("flags").alias("flag")).withColumn("scope", kind)
    queue = failure_queue(flags, "scope", F.concat("course_id", F.lit(": "), "flag"), most)
    return out.unionByName(queue.select(F.lit(8).alias("part"), F.col("scope").alias("key"), F.concat(F.lit("- "), "scope", F.lit(" ("), F.col("total").cast("string"), F.lit("): "), F.array_join("first", "; ")).alias("line")))


def write_run_report(courses: DataFrame, path: str, most: int = 100) -> None:
    write_markdown(run_lines(courses, most), path)
