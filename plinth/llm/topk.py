"""Exact top-k by inner product: norm-bucketed retrieval.

Vectors are dealt by length, longest first, and cut into buckets. For a query q with k-th best score t so far, a bucket whose
longest vector has length L asks for a cosine of at least ``t / (|q| L)``. Over 1: the bucket is skipped. Steep: the
coordinate in which q is largest bounds what a candidate's coordinate may be, and the rest is skipped. Else only
vectors of length ``t / |q|`` or more are tried. What is left is verified by exact products of integers.

Queries are taken a block at a time, each of at most ``block_bytes``, broadcast; a block meets every bucket.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import prepare, stage

BUCKET = 2048
STEEP = 0.7


def quantised(values: np.ndarray) -> np.ndarray:
    """floor(256 * x), in doubles that hold integers."""
    return np.floor(256.0 * values)


def products(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Integer inner products of rows. Doubles are exact below 2**53, which lengths bound; beyond, Python's integers, held to 64 bits."""
    if np.sqrt((q * q).sum(axis=1).max(initial=0) * (p * p).sum(axis=1).max(initial=0)) < 1 << 52:
        return (q @ p.T).astype(np.int64)
    a, b = [[int(x) for x in row] for row in q], [[int(x) for x in row] for row in p]
    top = (1 << 63) - 1
    return np.array([[max(-top, min(top, sum(x * y for x, y in zip(r, s, strict=True)))) for s in b] for r in a], np.int64).reshape(len(q), len(p))


class Best:
    """The k best (score, id) of each query: larger scores, then smaller ids; null ids last."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.scores, self.ids = np.full((n, k), np.iinfo(np.int64).min), np.full((n, k), np.iinfo(np.int64).max)
        self.full = np.zeros((n, k), bool)

    def add(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray, allowed: np.ndarray) -> None:
        """scores (rows x candidates), ids of candidates, allowed as scores."""
        s = np.concatenate([self.scores[rows], scores], axis=1)
        i = np.concatenate([self.ids[rows], np.broadcast_to(ids, scores.shape)], axis=1)
        f = np.concatenate([self.full[rows], allowed], axis=1)
        order = np.lexsort((i, -np.where(f, s, np.iinfo(np.int64).min + 1), ~f), axis=1)[:, : self.k]
        self.scores[rows], self.ids[rows], self.full[rows] = (np.take_along_axis(x, order, axis=1) for x in (s, i, f))

    def least(self) -> np.ndarray:
        """The k-th score of each query, -inf while there are fewer."""
        return np.where(self.full[:, -1], self.scores[:, -1].astype(float), -np.inf)


def search_bucket(best: Best, floor: np.ndarray, qid: np.ndarray, q: np.ndarray, ids: np.ndarray, p: np.ndarray) -> None:
    """p: the bucket's vectors, longest first. floor: of each query, a score that k candidates are known to reach."""
    qn, pn = np.sqrt((q * q).sum(axis=1)), np.sqrt((p * p).sum(axis=1))
    need = np.maximum(floor, best.least())
    longest = pn[0]
    reach = np.maximum(qn * longest, 0.5)
    cosine = need / reach - 1e-9
    alive = cosine <= 1
    steep = alive & (cosine > STEEP) & (qn > 0)
    for at in np.array_split(np.flatnonzero(alive & ~steep), max(1, int((alive & ~steep).sum()) // 256)):
        if not len(at):
            continue
        shortest = np.where(qn[at] > 0, need[at] / np.maximum(qn[at], 1e-300), -1.0).min() - 1e-6
        n = int(np.searchsorted(-pn, -shortest, side="right")) if shortest > 0 else len(p)
        if n:
            s = products(q[at], p[:n])
            keep(best, at, s, ids[:n], qid, need)
    if steep.any():
        unit = p / np.maximum(pn, 1e-300)[:, None]
        for k in np.flatnonzero(steep):
            f = int(np.abs(q[k]).argmax())
            x, t = q[k, f] / qn[k], cosine[k]  # cos >= t allows angles up to acos(t) on either side of q's own
            angle, turn = np.arccos(np.clip(x, -1, 1)), np.arccos(np.clip(t, -1, 1))
            low, high = np.cos(min(np.pi, angle + turn)) - 1e-6, np.cos(max(0.0, angle - turn)) + 1e-6
            some = np.flatnonzero((unit[:, f] >= low) & (unit[:, f] <= high))
            if len(some):
                keep(best, np.array([k]), products(q[k : k + 1], p[some]), ids[some], qid, need)


def keep(best: Best, at: np.ndarray, s: np.ndarray, ids: np.ndarray, qid: np.ndarray, need: np.ndarray) -> None:
    ok = (s >= need[at][:, None]) & (ids[None, :] != qid[at][:, None])
    some = np.flatnonzero(ok.any(axis=0))
    if len(some):
        best.add(at, s[:, some], ids[some], ok[:, some])


NONE = np.iinfo(np.int64).max


def _vectors(batch: pa.RecordBatch):
    """By dimension: (ids, quantised vectors); a null id is NONE."""
    ids = np.array([NONE if x is None else x for x in batch.column("vec_id").to_pylist()], np.int64)
    col = batch.column("vec")
    size = np.diff(col.offsets.to_numpy())
    flat = quantised(col.flatten().to_numpy(zero_copy_only=False).astype(float))
    ends = np.cumsum(size)
    for d in np.unique(size):
        rows = np.flatnonzero(size == d)
        yield int(d), ids[rows], flat[(ends[rows] - d)[:, None] + np.arange(d)]


def _search(queries, k: int):
    def run(batches):
        blocks = queries.value  # dimension -> (ids, vectors, floors)
        best = {d: Best(len(ids), k) for d, (ids, _, _) in blocks.items()}
        for batch in batches:
            for d, ids, p in _vectors(batch):
                if d in blocks:
                    order = np.argsort(-(p * p).sum(axis=1), kind="stable")
                    qid, q, floor = blocks[d]
                    for at in range(0, len(order), BUCKET):
                        some = order[at : at + BUCKET]
                        search_bucket(best[d], floor, qid, q, ids[some], p[some])
        for d, b in best.items():
            at, j = np.nonzero(b.full)
            ids = b.ids[at, j]
            yield pa.RecordBatch.from_arrays([pa.array(blocks[d][0][at]), pa.array(ids, mask=ids == NONE), pa.array(b.scores[at, j])], ["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, block_bytes: int = 32 << 20, seeds: int = 1024) -> DataFrame:
    """vectors, queries (vec_id, embedding, ...) -> (query_id, rank, vec_id, score): the k largest inner products of floor(256 x).

    Candidates of a query: all vectors with another vec_id and as many components. Equal scores: smaller vec_id first, null last.
    Vectors that are null or hold a null or non-finite component take no part, nor do queries with a null vec_id. Repeated
    rows of vectors are candidates each; of queries with one vec_id the least vector counts. Fewer than k candidates: all.
    Scores beyond 64 bits are held to them. Other columns are ignored; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    prepare(spark)

    def sound(df: DataFrame) -> DataFrame:
        vec = F.col("embedding").cast("array<double>")
        bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        return df.select(F.col("vec_id").cast("long").alias("vec_id"), vec.alias("vec")).where(F.col("vec").isNotNull() & ~F.coalesce(bad, F.lit(False)))

    all_vectors = sound(vectors).withColumn("square", F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x))
    asked = stage(sound(queries).where("vec_id is not null").groupBy("vec_id").agg(F.min("vec").alias("vec")), "queries")
    top = [(r["vec_id"], r["vec"]) for r in all_vectors.orderBy(F.desc("square")).limit(seeds).collect()]
    by_length = F.desc("square"), F.col("vec_id")  # vec_id parts equal lengths, as of unit vectors
    dealt = all_vectors.repartitionByRange(*by_length).sortWithinPartitions(*by_length).select("vec_id", "vec")
    rows, size = asked.agg(F.count("*"), F.sum(8 * F.size("vec") + 64)).first()
    cut = max(1, -(-(size or 0) // block_bytes))
    out = spark.createDataFrame([], "query_id long, vec_id long, score long")
    for b in range(cut if rows else 0):
        by_size: dict[int, tuple[list, list]] = {}
        for r in asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(cut)) == b).collect():
            ids, vs = by_size.setdefault(len(r["vec"]), ([], []))
            ids.append(r["vec_id"])
            vs.append(r["vec"])
        block = {}
        for d, (ids, vs) in by_size.items():
            qid, q = np.array(ids, np.int64), quantised(np.array(vs, float).reshape(len(vs), d))
            near = [(NONE if i is None else i, v) for i, v in top if len(v) == d]
            first = Best(len(qid), k)
            if near:
                pid, p = np.array([i for i, _ in near], np.int64), quantised(np.array([v for _, v in near], float).reshape(len(near), d))
                for at in range(0, len(qid), 256):
                    rows_ = np.arange(at, min(len(qid), at + 256))
                    first.add(rows_, products(q[rows_], p), pid, pid[None, :] != qid[rows_][:, None])
            block[d] = qid, q, first.least()
        if block:
            out = out.unionByName(dealt.mapInArrow(_search(spark.sparkContext.broadcast(block), k), "query_id long, vec_id long, score long"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
