"""A corpus pipeline: stages over the documents table, each written as Parquet and read again by the next.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and but for the last returns
the columns of documents. Null and empty texts pass the quality stage with a weight of 0 and are rejected by language ID.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plinth.llm import language_id, resampling
from plinth.llm.decontamination import decontaminate
from plinth.llm.jaccard_join import jaccard_join, row_hash
from plinth.llm.packing import pack_documents
from plinth.llm.shared import prepare, slices, stage, unused
from plinth.llm.tokens import default_path

#: Documents whose language is less likely than this are rejected.
LEAST_LANGUAGE = 0.5


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the sample that importance resampling draws towards documents labelled good."""
    good = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1")
    return resampling.select_rows(docs, good)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a language that is recognised; learns from the languages they state.

    Rejected: texts without a letter, null texts, those whose likeliest language has a probability under LEAST_LANGUAGE, and those whose n-grams are
    less likely in it than in a language where all are alike. Where no document states a language nothing is learnt and nothing is rejected.
    """
    prepare(spark)
    trained = language_id.train(docs)
    if not trained.langs:
        return docs
    model = spark.sparkContext.broadcast(trained)

    def known(batches):
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                langs, score, gain = model.value.judge(part.column("text"))
                yield part.filter(pa.array((np.array(langs, object) != "und") & (score >= LEAST_LANGUAGE) & (gain >= 0)))

    return docs.mapInArrow(known, docs.schema)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of texts with five-word shingle sets of a Jaccard similarity of 0.8 or more: the one with the least doc_id.

    Rows are told apart by doc_id and text: rows with one doc_id and different texts stand for themselves, and a row without a doc_id
    stays only if its class has none with one. Texts without a word are in no class and stay. Of rows with equal doc_id and text one stays.
    """
    classes = jaccard_join(docs, n=5, percent=80)
    first = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("row"))
    heads = classes.where("class_id is not null").groupBy("class_id").agg(F.min(first).alias("first")).select(F.col("first.row").alias("head"))
    heads = heads.unionByName(classes.where("class_id is null").select(F.col("row").alias("head")))
    row, number, head = (unused(docs.columns, x) for x in ("row", "number", "head"))
    kept = docs.withColumn(row, row_hash(docs)).join(heads.distinct().withColumnRenamed("head", head), F.col(row) == F.col(head), "left_semi")
    return kept.withColumn(number, F.row_number().over(Window.partitionBy(row).orderBy(row))).where(F.col(number) == 1).drop(number, row)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of the benchmark, copied or edited."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sequences, as pieces of documents with their ids."""
    return pack_documents(docs, default_path())


STAGES = [("quality", quality), ("language", language), ("near_duplicates", near_duplicates), ("benchmark", benchmark), ("packing", packing)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, f in STAGES[:-1]:
        docs = stage(f(spark, docs, sf_dir), name)
    return stage(STAGES[-1][1](spark, docs, sf_dir), STAGES[-1][0])
