"""Quality classification by importance resampling over hashed n-grams.

Texts are bags of hashed unigrams and bigrams of tokens (runs of letters and digits, runs of other signs). A
generative model of the target (texts labelled good) and one of the raw corpus (all texts) are smoothed bucket
frequencies; the log importance weight of a text is the sum of its buckets' log ratios. What speaks against a text is
lessened by its sampling error, ERRORS standard errors of a frequency among the target's texts for each n-gram, so
that a small target rejects little. Gumbel noise, fixed by a hash of the row, added to the weight makes the k
largest a sample without replacement in proportion to the weights.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import prepare, slices, stage, text_offsets, unused
from .words import LOWER, ODD, SPACE, U, grams, mix, powers

BITS = 14
ERRORS = 3.0
KIND = np.ones(256, np.uint8)
KIND[[k for k in range(128) if not chr(k).isalnum()]] = 2
KIND[SPACE] = 0


def token_hashes(raw: np.ndarray, offs: np.ndarray, words_only: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of letters and digits, and of runs of other signs unless words_only; the number of them before each text."""
    n = len(raw)
    if not n:
        return np.zeros(0, U), np.zeros(len(offs), np.int64)
    kind = KIND[raw]
    cut = np.zeros(n + 1, bool)
    cut[1:-1] = kind[1:] != kind[:-1]
    cut[offs] = True
    starts = np.flatnonzero(cut[:-1])
    ends = np.append(starts[1:], n)
    own = kind[starts] == 1 if words_only else kind[starts] > 0
    starts, ends = starts[own], ends[own]
    up, down = powers(n + 1)
    sums = np.zeros(n + 1, U)
    low = LOWER[raw]
    latin = np.flatnonzero(raw[:-1] == 0xC3) + 1  # the capitals of Latin-1
    latin = latin[(raw[latin] >= 0x80) & (raw[latin] <= 0x9E) & (raw[latin] != 0x97)]
    low[latin] += 32
    np.cumsum((low.astype(U) + U(1)) * up[:n], out=sums[1:])
    h = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U) * ODD[2])
    return h, np.searchsorted(starts, offs)


def buckets(h: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text) of all unigrams and bigrams."""
    if not len(h):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    own = np.repeat(np.arange(len(before) - 1), np.diff(before))
    two = grams(h, 2)
    two[h[1:] == h[:-1]] = ODD[3]  # a token said twice, whichever it is
    same = own[1:] == own[:-1]
    at = np.concatenate([h, two[same]]) >> U(64 - BITS)
    return at.astype(np.int64), np.concatenate([own, own[:-1][same]])


def _counts(batches):
    total = np.zeros((2, 1 << BITS), np.int64)
    for batch in batches:
        for part in slices(batch, "text"):
            at, own = buckets(*token_hashes(*text_offsets(part.column("text"))))
            good = part.column("good").to_numpy(zero_copy_only=False).astype(bool)
            total[0] += np.bincount(at, minlength=1 << BITS)
            total[1] += np.bincount(at[good[own]], minlength=1 << BITS)
    for k in range(2):
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([total[k].astype("<i8").tobytes()], pa.binary())], ["model", "counts"])


def _add(batches):
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            total[k] = total.get(k, 0) + np.frombuffer(x.as_py(), "<i8")
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["model", "counts"])


def fit(docs: DataFrame, good: DataFrame, most: int = 50_000, smooth: float = 1.0) -> tuple[np.ndarray, float]:
    """log(P target / P raw) by bucket, and its sampling error for each n-gram. docs (doc_id, text); good (doc_id): the target's documents.

    The raw model counts all texts; the target's at most about ``most`` of its documents, those with the
    least hashes of doc_id. Null doc_ids are in no target. An empty target or corpus: all ratios are 0.
    """
    spark = docs.sparkSession
    prepare(spark)
    ids = good.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    share = min(1.0, most / max(1, ids.count()))
    picked = np.sort(np.array([r[0] for r in ids.where(F.pmod(F.xxhash64("doc_id", F.lit("target")), F.lit(1 << 20)) < share * (1 << 20)).collect()], np.int64))
    known = spark.sparkContext.broadcast(picked)

    def mark(batches):
        def marked():
            for batch in batches:
                i = batch.column("doc_id").to_numpy(zero_copy_only=False)
                real = np.array(batch.column("doc_id").is_valid())
                own = np.isin(np.where(real, i, 0).astype(np.int64), known.value) & real
                yield pa.RecordBatch.from_arrays([batch.column("text"), pa.array(own)], ["text", "good"])

        yield from _counts(marked())

    kind = "model int, counts binary"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(mark, kind).repartition("model").mapInArrow(_add, kind).collect()
    total = np.zeros((2, 1 << BITS))
    for r in rows:
        total[r["model"]] += np.frombuffer(r["counts"], "<i8")
    if not total.sum(axis=1).all():
        return np.zeros(1 << BITS), 0.0
    p = (total + smooth) / (total.sum(axis=1, keepdims=True) + smooth * (1 << BITS))
    return np.log(p[1]) - np.log(p[0]), ERRORS / max(1, len(picked)) ** 0.5


def log_weights(part: pa.RecordBatch, model: tuple[np.ndarray, float]) -> np.ndarray:
    at, own = buckets(*token_hashes(*text_offsets(part.column("text"))))
    ratio, error = model
    w = np.bincount(own, ratio[at], minlength=part.num_rows)
    return np.where(w < 0, np.minimum(0, w + error * np.bincount(own, minlength=part.num_rows)), w)


def _weights(model):
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column("rid"), part.column("doc_id"), pa.array(log_weights(part, model.value))], ["rid", "doc_id", "log_weight"])

    return run


def _noise(rid: Column, seed: int) -> Column:
    """Gumbel noise fixed by a hash."""
    uniform = (F.pmod(F.xxhash64(rid, F.lit(seed)), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
    return -F.log(-F.log(uniform))


def weigh(docs: DataFrame, model: tuple[np.ndarray, float], seed: int = 11) -> DataFrame:
    """(rid, doc_id, log_weight, gumbel_key) of all rows; rid: the row's hash. No token, or null text: weight 0."""
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select(F.xxhash64("doc_id", "text").alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = rows.mapInArrow(_weights(spark.sparkContext.broadcast(model)), "rid long, doc_id long, log_weight double")
    return out.withColumn("gumbel_key", F.col("log_weight") + _noise(F.col("rid"), seed))


def kth_largest(rows: DataFrame, column: str, k: int, bits: int = 13) -> tuple[float, int]:
    """(value, rank among equals): the k-th largest of a finite double column, by radix rounds over a histogram of 2**bits. Nothing is gathered."""
    if k <= 0:
        return float("inf"), 0
    low, high, left = *rows.agg(F.min(column), F.max(column)).first(), k
    while low is not None and low < high:
        step = (high - low) / (1 << bits)
        if step <= 0 or low + step == low or high - step == high:
            values = sorted(((r[0], r[1]) for r in rows.where(F.col(column).between(low, high)).groupBy(column).count().collect()), reverse=True)
            for value, n in values:
                if left <= n:
                    return value, left
                left -= n
        near = rows.where(F.col(column).between(low, high))
        at = F.least(F.floor((F.col(column) - low) / step), F.lit((1 << bits) - 1))
        for r in sorted(near.groupBy(at.alias("at")).agg(F.count("*").alias("n"), F.min(column).alias("low"), F.max(column).alias("high")).collect(), key=lambda r: -r["at"]):
            if left <= r["n"]:
                low, high = r["low"], r["high"]
                break
            left -= r["n"]
    return low, left


def _least(rows: DataFrame, share: float | None, slack: float) -> float:
    """The k-th largest key."""
    n, alike = rows.agg(F.count("*"), F.count_if(F.col("log_weight") >= -slack)).first()
    return float(kth_largest(rows, "gumbel_key", alike if share is None else round(share * n))[0] or 0.0)


def select_rows(docs: DataFrame, good: DataFrame, share: float | None = None, slack: float = 8.0, most: int = 50_000, seed: int = 11) -> DataFrame:
    """The rows of docs, with all their columns, that resample() selects; their weights are worked out once more, which moves no text."""
    spark = docs.sparkSession
    model = fit(docs, good, most)
    least = _least(stage(weigh(docs, model, seed), "weights"), share, slack)
    shared = spark.sparkContext.broadcast(model)

    def chosen(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                yield part.filter(pa.array(log_weights(part, shared.value) + part.column(noise).to_numpy() >= least))

    noise = unused(docs.columns, "noise")
    noisy = docs.withColumn(noise, _noise(F.xxhash64("doc_id", "text"), seed))
    return noisy.mapInArrow(chosen, noisy.schema).drop(noise)


def resample(docs: DataFrame, good: DataFrame, share: float | None = None, slack: float = 8.0, most: int = 50_000, seed: int = 11) -> DataFrame:
    """docs (doc_id, text, ...), good (doc_id of the target) -> (rid, doc_id, log_weight, gumbel_key, selected), a row for each of docs.

    selected: the k largest keys, k = ``share`` of the rows, rounded; no share: as many as have a log
    weight of at least -slack, so that noise alone drops no text like the target. Equal keys, as of repeated rows, are selected together if the k-th is among them. Null or empty text: weight 0. Other columns
    are ignored; an empty table gives no rows.
    """
    rows = stage(weigh(docs, fit(docs, good, most), seed), "weights")
    return rows.withColumn("selected", F.col("gumbel_key") >= F.lit(_least(rows, share, slack)))
