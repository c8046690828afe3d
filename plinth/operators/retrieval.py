"""Lexical retrieval: hashed TF-IDF, exact top-k by inner product, and dense top-k."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import token_bucket
from ..sources.batches import bounded_batches

TOKEN = re.compile("[a-z]+|[0-9]{3}")
REMEMBERED = 200_000
#: Queries of a block, whose weights are broadcast as a matrix, and texts that are scored at a time.
QUERIES, TEXTS = 1000, 256


class Counter:
    """Counts tokens of texts, glued ones too, by hash bucket; remembers the buckets of at most REMEMBERED tokens."""

    def __init__(self, size: int):
        self.place, self.known = token_bucket(size), {}

    def __call__(self, low: str) -> tuple[np.ndarray, np.ndarray]:
        found = TOKEN.findall(low)
        found += [a + b for a, b in zip(found, found[1:]) if a[0] > "9" >= b[0]]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        for t in set(found).difference(self.known):
            self.known[t] = self.place(t)
        return np.unique(np.fromiter(map(self.known.__getitem__, found), np.int32, len(found)), return_counts=True)


def term_frequencies(docs: DataFrame, key: str, text: str, size: int = 1024) -> DataFrame:
    """(key, bucket, tf): tokens of whole texts, with glued ones, counted by hash bucket. One pass in Arrow batches keeps words out of the shuffle."""

    def count(batches):
        counter = Counter(size)
        for pdf in batches:
            for at in range(0, len(pdf), TEXTS):
                some = [counter(low) for low in pdf["x"].iloc[at : at + TEXTS]]
                yield pd.DataFrame({"k": np.repeat(pdf["k"].to_numpy()[at : at + TEXTS], [len(b) for b, _ in some]), "bucket": np.concatenate([b for b, _ in some]), "tf": np.concatenate([n for _, n in some])})

    bounded_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("k"), F.lower(F.coalesce(text, F.lit(""))).alias("x")).mapInPandas(count, f"k {kind}, bucket int, tf long")
    return rows.groupBy(F.col("k").alias(key), "bucket").agg(F.sum("tf").alias("tf"))


def inverse_frequencies(tf: DataFrame, key: str, n_docs: int, size: int = 1024) -> DataFrame:
    """tf: a row for each text and bucket -> (bucket, df, idf) of all buckets: ``ln((1 + n) / (1 + df)) + 1``, also of those that no text has."""
    n = max(1, n_docs)
    df = tf.groupBy("bucket").agg(F.count(key).alias("df"))
    every = tf.sparkSession.range(size).select(F.col("id").cast("int").alias("bucket"))
    full = every.join(df, "bucket", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    return full.withColumn("idf", F.log((F.lit(1.0) + n) / (F.lit(1.0) + F.col("df"))) + 1.0)


def weights(tf: DataFrame, idf: DataFrame, key: str) -> DataFrame:
    """(key, bucket, w): tf-idf of length 1. idf has one row for each bucket, so it is broadcast."""
    raw = tf.join(F.broadcast(idf.select("bucket", "idf")), "bucket").withColumn("w", F.col("tf") * F.col("idf"))
    norm = raw.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norm, key).select(key, "bucket", (F.col("w") / F.when(F.col("norm") == 0, 1.0).otherwise(F.col("norm"))).alias("w"))


def top_k(scores: DataFrame, query: str, item: str, k: int, score: str = "score") -> DataFrame:
    """The k best items of each query, ties to the smaller item; WindowGroupLimit prunes before the shuffle."""
    order = Window.partitionBy(query).orderBy(F.desc(score), item)
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(docs: DataFrame, queries: DataFrame, key: str, qkey: str, text: str = "text", k: int = 5, size: int = 1024, digits: int = 6) -> DataFrame:
    """(qkey, key, score, rank): the k likest texts of each query, with idf of the docs; texts that share no bucket with it are not listed.

    Weights of queries are broadcast, at most QUERIES at a time, as a matrix of ``size`` columns; each block goes over the texts once, and each task keeps
    the best k of its batches, so what is shuffled doesn't grow with the buckets that texts share. Keys are told apart by row: of repeated keys each row is scored.
    """
    idf = inverse_frequencies(term_frequencies(docs, key, text, size), key, docs.count(), size)
    weight = np.zeros(size)
    for r in idf.select("bucket", "idf").collect():
        weight[r["bucket"]] = r["idf"]
    asked = weights(term_frequencies(queries, qkey, text, size), idf, qkey)
    kind, qkind = (df.schema[c].dataType.simpleString() for df, c in ((docs, key), (queries, qkey)))
    rows = docs.select(F.col(key).alias("k"), F.lower(F.coalesce(text, F.lit(""))).alias("x"))
    cut, out = max(1, -(-queries.select(qkey).distinct().count() // QUERIES)), None
    for b in range(cut):
        some = asked.where(F.pmod(F.xxhash64(qkey), F.lit(cut)) == b).toPandas()
        names, row = np.unique(some[qkey].to_numpy(), return_inverse=True)
        matrix = np.zeros((len(names), size))
        matrix[row, some["bucket"]] = some["w"]
        best = rows.mapInPandas(_best(docs.sparkSession.sparkContext.broadcast((weight, names, matrix)), k, size, digits), f"q {qkind}, k {kind}, score double")
        out = best if out is None else out.unionByName(best)
    return top_k(out.select(F.col("q").alias(qkey), F.col("k").alias(key), "score"), qkey, key, k)


def _best(shared, k: int, size: int, digits: int):
    def run(batches):
        weight, names, matrix = shared.value
        counter = Counter(size)
        for pdf in batches:
            for at in range(0, len(pdf), TEXTS):
                keys = pdf["k"].to_numpy()[at : at + TEXTS]
                w = np.zeros((len(keys), size))
                for i, low in enumerate(pdf["x"].iloc[at : at + TEXTS]):
                    bucket, n = counter(low)
                    w[i, bucket] = n
                shares = (matrix > 0).astype(np.float32) @ (w > 0).astype(np.float32).T > 0
                w *= weight
                w /= np.maximum(np.sqrt((w * w).sum(axis=1, keepdims=True)), 1e-300)
                scores = np.where(shares, np.round(matrix @ w.T, digits), -1)
                order = np.lexsort((np.broadcast_to(keys, scores.shape), -scores), axis=1)[:, :k] if len(names) else np.zeros((0, 0), np.int64)
                q = np.repeat(np.arange(len(order)), order.shape[1])
                i = order.ravel()
                ok = scores[q, i] >= 0 if len(q) else np.zeros(0, bool)
                yield pd.DataFrame({"q": names[q[ok]], "k": keys[i[ok]], "score": scores[q[ok], i[ok]]})

    return run


class Best:
    """The k best of each query so far, ties to the smaller key."""

    def __init__(self, queries: int, k: int):
        self.k, self.scores, self.keys = k, [np.zeros(0)] * queries, [None] * queries
        self.least = np.full(queries, -np.inf)

    def add(self, q: int, scores: np.ndarray, keys: np.ndarray) -> None:
        if self.keys[q] is not None:
            scores, keys = np.concatenate([self.scores[q], scores]), np.concatenate([self.keys[q], keys])
        order = np.lexsort((keys, -scores))[: self.k]
        self.scores[q], self.keys[q] = scores[order], keys[order]
        if len(order) == self.k:
            self.least[q] = self.scores[q][-1]


def dense_top_k(queries: DataFrame, vectors: DataFrame, k: int = 5, digits: int = 5, block: int = 32 << 20) -> DataFrame:
    """queries (query_id, q), vectors (vec_id, v) -> (query_id, vec_id, score, rank) of the k best other vectors of each query, by inner products in double.

    Queries are broadcast as matrices of at most about ``block`` bytes; each is multiplied with the vectors an Arrow batch at a time, and a task keeps
    the best k of its batches. Vectors of another length than a query's, null ones and such with null components take no part.
    """
    spark = queries.sparkSession
    bounded_batches(spark)
    whole = lambda c: F.col(c).isNotNull() & ~F.exists(c, lambda x: x.isNull())
    asked = queries.where(whole("q")).select("query_id", F.col("q").cast("array<double>").alias("q"))
    kinds = {c: df.schema[c].dataType.simpleString() for df, c in ((queries, "query_id"), (vectors, "vec_id"))}
    rows, out = vectors.where(whole("v")).select("vec_id", "v"), None
    for r in asked.groupBy(F.size("q").alias("size")).agg(F.count("*").alias("n")).orderBy("size").collect():  # a row for each length of vector
        cut = -(-r["n"] * 8 * max(1, r["size"]) // block)
        for b in range(cut):
            some = asked.where((F.size("q") == r["size"]) & (F.pmod(F.xxhash64("query_id"), F.lit(cut)) == b)).toPandas()
            shared = spark.sparkContext.broadcast((some["query_id"].to_numpy(), np.array(some["q"].tolist(), float).reshape(len(some), r["size"])))
            best = rows.where(F.size("v") == r["size"]).mapInArrow(_nearest(shared, k, digits), f"query_id {kinds['query_id']}, vec_id {kinds['vec_id']}, score double")
            out = best if out is None else out.unionByName(best)
    if out is None:
        return spark.createDataFrame([], f"query_id {kinds['query_id']}, vec_id {kinds['vec_id']}, score double, rank int")
    return top_k(out, "query_id", "vec_id", k)


def _nearest(shared, k: int, digits: int):
    def run(batches):
        names, matrix = shared.value
        best = Best(len(names), k)
        for batch in batches:
            keys, v = batch.column("vec_id").to_numpy(zero_copy_only=False), batch.column("v")
            for at in range(0, len(keys), TEXTS):
                some = v.slice(at, TEXTS)
                own = keys[at : at + TEXTS]
                scores = np.round(matrix @ some.flatten().to_numpy().astype(float).reshape(len(some), matrix.shape[1]).T, digits)
                scores[names[:, None] == own[None, :]] = np.nan
                for q in np.flatnonzero((scores >= best.least[:, None]).any(axis=1)):
                    hit = np.flatnonzero(scores[q] >= best.least[q])
                    best.add(q, scores[q, hit], own[hit])
        full = [q for q in range(len(names)) if best.keys[q] is not None]
        if full:
            n = [len(best.keys[q]) for q in full]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names[full], n)), pa.array(np.concatenate([best.keys[q] for q in full])), pa.array(np.concatenate([best.scores[q] for q in full]))], ["query_id", "vec_id", "score"])

    return run
