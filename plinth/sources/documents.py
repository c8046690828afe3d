"""Whole-file documents: YAML plans and question sets, read on the executors."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.degree import PLAN


def plan_files(spark: SparkSession, path: str) -> DataFrame:
    """Plans (degree.PLAN) of YAML files (plan_id, terms, taken), a file each; unknown keys are ignored, a file without terms gives no rows."""

    def read(batches):
        import yaml

        for pdf in batches:
            rows = []
            for name, text in zip(pdf["path"], pdf["text"], strict=True):
                data = yaml.safe_load(text) or {}
                plan = str(data.get("plan_id") or name.rsplit("/", 1)[-1].split(".")[0])
                rows += [(plan, -1, None, p, c) for p, c in enumerate(data.get("taken") or [])]
                rows += [(plan, k, t.get("term"), p, c) for k, t in enumerate(data.get("terms") or []) for p, c in enumerate(t.get("courses") or [])]
            yield pd.DataFrame(rows, columns=["plan", "term_idx", "term", "pos", "course"])

    files = spark.read.format("binaryFile").load(path).select("path", F.decode("content", "UTF-8").alias("text"))
    return files.mapInPandas(read, PLAN)


def questions(spark: SparkSession, offered: list[tuple[str, str]], prereq: list[str]) -> DataFrame:
    """(id, type, text, course, term) of questions about offerings and prerequisites, by template."""
    rows = [(f"factual_offered_{i:03d}", "factual_offered", f"Is {c} offered in {t}?", c, t) for i, (c, t) in enumerate(offered)]
    rows += [(f"factual_prereq_{i:03d}", "factual_prereq", f"What is the prerequisite for {c}?", c, None) for i, c in enumerate(prereq)]
    return spark.createDataFrame(rows, "id string, type string, text string, course string, term string")


def plan_text(plans: DataFrame) -> DataFrame:
    """(plan, text): 'term: course, course | term: ...', what was taken before it in front."""
    terms = plans.where("term_idx >= 0").groupBy("plan", "term_idx", "term").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "course"))), lambda s: s["course"]), ", ").alias("c"))
    line = terms.groupBy("plan").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("term_idx", F.concat_ws(": ", "term", "c").alias("x")))), lambda s: s["x"]), " | ").alias("text"))
    before = plans.where("term_idx < 0").groupBy("plan").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "course"))), lambda s: s["course"]), ", ").alias("before"))
    full = line.join(before, "plan", "left")
    return full.select("plan", F.concat(F.coalesce(F.concat(F.lit("Already completed: "), "before", F.lit(". ")), F.lit("")), "text").alias("text"))
