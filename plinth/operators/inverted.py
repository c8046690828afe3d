"""A kept inverted index of hashed TF-IDF weights, searched block by block with the largest weight of each bucket as a bound.

Texts are read once, when the index is built. A row of the index is a block of documents: its postings by bucket (places of documents and their
weights) and, of each bucket, the block's largest weight. A search multiplies these bounds with its queries, skips a block for the queries that have
k better documents already, and for the others adds up the postings of their own buckets only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .retrieval import QUERIES, Best, Counter, bounded_batches, term_frequencies, top_k, weights

BLOCK = 512


def _lists(values: list[np.ndarray], kind) -> pa.Array:
    offsets = np.append(0, np.cumsum([len(v) for v in values])).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(values) if values else np.zeros(0), kind))


def _count(size: int, block: int):
    def run(batches):
        counter = Counter(size)
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                part = batch.slice(at, block)
                found = [counter(low) for low in part.column("x").to_pylist()]
                bucket = np.concatenate([b for b, _ in found]).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                place = np.repeat(np.arange(len(found)), [len(b) for b, _ in found])[order]
                tf = np.concatenate([n for _, n in found])[order]
                ends = np.searchsorted(bucket[order], np.arange(size + 1))
                keys = part.column("k")
                yield pa.RecordBatch.from_arrays(
                    [pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys), *(_lists([x], pa.int32()) for x in (ends.astype(np.int32), place.astype(np.int32), tf.astype(np.int32)))], ["keys", "ends", "place", "tf"]
                )

    return run


def _weigh(shared):
    def run(batches):
        idf = shared.value
        for batch in batches:
            out, tops = [], []
            for r in range(batch.num_rows):
                ends, place, tf = (batch.column(c)[r].values.to_numpy() for c in ("ends", "place", "tf"))
                w = tf * np.repeat(idf, np.diff(ends))
                norm = np.sqrt(np.bincount(place, w * w, len(batch.column("keys")[r].values)))
                w /= np.maximum(norm[place], 1e-300)
                top = np.zeros(len(idf))
                has = np.flatnonzero(np.diff(ends))
                if len(has):
                    top[has] = np.maximum.reduceat(w, ends[has])
                out.append(w)
                tops.append(top)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("keys", "ends", "place")), _lists(out, pa.float64()), _lists(tops, pa.float64())], ["keys", "ends", "place", "w", "top"])

    return run


def build(docs: DataFrame, key: str, text: str, path: str, size: int = 1024, block: int = BLOCK) -> None:
    """Writes the index of docs below path: counts, idf (bucket, df, idf), blocks and meta. Texts are read once; null texts have no bucket.

    An index that is there is replaced. Repeated keys: each row counts for itself.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("k"), F.lower(F.coalesce(F.col(text), F.lit(""))).alias("x"))
    rows.mapInArrow(_count(size, block), f"keys array<{kind}>, ends array<int>, place array<int>, tf array<int>").write.mode("overwrite").parquet(f"{path}/counts")
    counts = spark.read.parquet(f"{path}/counts")
    n = counts.agg(F.coalesce(F.sum(F.size("keys")), F.lit(0))).first()[0]
    gaps = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda b: F.get(F.col("ends"), b + 1) - F.get(F.col("ends"), b))
    df = counts.select(F.posexplode(gaps).alias("bucket", "n")).groupBy("bucket").agg(F.sum("n").alias("df"))
    every = spark.range(size).select(F.col("id").cast("int").alias("bucket")).join(df, "bucket", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    every.withColumn("idf", F.log((F.lit(1.0) + max(1, n)) / (F.lit(1.0) + F.col("df"))) + 1.0).write.mode("overwrite").parquet(f"{path}/idf")
    shared = spark.sparkContext.broadcast(_idf(spark, path, size))
    counts.mapInArrow(_weigh(shared), f"keys array<{kind}>, ends array<int>, place array<int>, w array<double>, top array<double>").write.mode("overwrite").parquet(f"{path}/blocks")
    spark.createDataFrame([(size, block, n, kind)], "size int, block int, n_docs long, kind string").write.mode("overwrite").parquet(f"{path}/meta")


def _idf(spark: SparkSession, path: str, size: int) -> np.ndarray:
    out = np.zeros(size)
    for r in spark.read.parquet(f"{path}/idf").collect():
        out[r["bucket"]] = r["idf"]
    return out


def _find(shared, k: int, digits: int):
    def run(batches):
        names, matrix = shared.value
        best, step = Best(len(names), k), 10.0**-digits
        own = [np.flatnonzero(row) for row in matrix]
        for batch in batches:
            tops = batch.column("top").values.to_numpy()
            size = matrix.shape[1]
            for r in range(batch.num_rows):
                first = batch.column("top").offsets[r].as_py()
                bound = matrix @ tops[first : first + size]
                asked = np.flatnonzero((bound > 0) & (bound + step >= best.least))
                if not len(asked):
                    continue
                ends, place, w = (batch.column(c)[r].values.to_numpy() for c in ("ends", "place", "w"))
                keys = batch.column("keys")[r].values.to_numpy(zero_copy_only=False)
                n = np.diff(ends)
                for q in asked:
                    b = own[q]
                    some = n[b]
                    to = np.cumsum(some)
                    if not len(to) or not to[-1]:
                        continue
                    at = np.repeat(ends[b] - (to - some), some) + np.arange(to[-1])
                    sums = np.bincount(place[at], w[at] * np.repeat(matrix[q, b], some), len(keys))
                    there = np.zeros(len(keys), bool)
                    there[place[at]] = True
                    sums = np.round(sums, digits)
                    hit = np.flatnonzero(there & (sums >= best.least[q]))
                    if len(hit):
                        best.add(q, sums[hit], keys[hit])
        full = [q for q in range(len(names)) if best.keys[q] is not None]
        if full:
            keys = np.concatenate([best.keys[q] for q in full])
            kind = batch.column("keys").type.value_type
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names[full], [len(best.keys[q]) for q in full])), pa.array(keys, kind), pa.array(np.concatenate([best.scores[q] for q in full]))], ["q", "k", "score"])

    return run


def search(spark: SparkSession, path: str, queries: DataFrame, qkey: str, key: str = "key", text: str = "text", k: int = 5, digits: int = 6) -> DataFrame:
    """queries (qkey, text) -> (qkey, key, score, rank): the k likest documents of the index at path, by its own frequencies; reads no text of documents.

    Rows are those of retrieval.search. Queries are broadcast as a matrix, at most QUERIES at a time; a task keeps the best k of its blocks. Null keys of
    documents aren't found.
    """
    bounded_batches(spark)
    meta = spark.read.parquet(f"{path}/meta").first()
    asked = weights(term_frequencies(queries, qkey, text, meta["size"]), spark.read.parquet(f"{path}/idf"), qkey)
    blocks = spark.read.parquet(f"{path}/blocks")
    qkind = queries.schema[qkey].dataType.simpleString()
    cut, out = max(1, -(-queries.select(qkey).distinct().count() // QUERIES)), None
    for b in range(cut):
        some = asked.where(F.pmod(F.xxhash64(qkey), F.lit(cut)) == b).toPandas()
        names, row = np.unique(some[qkey].to_numpy(), return_inverse=True)
        matrix = np.zeros((len(names), meta["size"]))
        matrix[row, some["bucket"]] = some["w"]
        best = blocks.mapInArrow(_find(spark.sparkContext.broadcast((names, matrix)), k, digits), f"q {qkind}, k {meta['kind']}, score double")
        out = best if out is None else out.unionByName(best)
    return top_k(out.select(F.col("q").alias(qkey), F.col("k").alias(key), "score").where(F.col(key).isNotNull()), qkey, key, k)
