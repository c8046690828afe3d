"""Language identification: multinomial naive Bayes over hashed character n-grams.

Characters: letters as they are, with ASCII and Latin-1 capitals lower-cased; any other ASCII counts as a space.
n-grams of 1 to ``n`` characters fall into ``buckets`` by hash; log P(bucket | language) is one matrix, of a size set by
its parameters, that is broadcast. A batch is scored by gathering the rows of its n-grams and adding them text by text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import prepare, slices, text_offsets
from .words import ODD, U

BITS = 15
PLAIN = np.arange(0x250, dtype=np.uint32)
PLAIN[:128] = 32
PLAIN[97:123] = np.arange(97, 123)
PLAIN[65:91] = np.arange(97, 123)
PLAIN[0xC0:0xDF] += 32
PLAIN[0xD7] = PLAIN[0xF7] = 32


def characters(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, plainly spelt; the number of them before each text."""
    begins = (raw & 0xC0) != 0x80
    before = np.concatenate([[0], np.cumsum(begins)])[offs]
    points = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), "<u4")
    if len(points) != before[-1]:  # not UTF-8; each byte that begins something counts as a character
        points = raw[begins].astype(np.uint32)
    small = points < len(PLAIN)
    return np.where(small, PLAIN[np.where(small, points, 0)], points), before


def features(points: np.ndarray, before: np.ndarray, n: int):
    """For each length of n-gram: buckets at each character, and whether the n-gram lies within one text and isn't white space."""
    own = np.repeat(np.arange(len(before) - 1), np.diff(before))
    h = np.zeros(len(points), U)
    for k in range(n):
        m = len(points) - k
        if m <= 0:
            return
        h = h[:m] * ODD[0] + (points[k:].astype(U) + U(1)) * ODD[1]
        at = h ^ (h >> U(32))
        at = ((at * ODD[2]) >> U(64 - BITS)).astype(np.int64)
        ok = own[:m] == own[k:]
        ok &= (points[:m] != 32) | (points[k:] != 32)
        yield at, ok, own[:m]


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def _counts(langs: list[str], n: int):
    number = {x: k for k, x in enumerate(langs)}

    def run(batches):
        total = np.zeros((len(langs), 1 << BITS), np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                points, before = characters(*text_offsets(part.column("text")))
                lang = np.array([number[x] for x in part.column("lang").to_pylist()], np.int64)
                for at, ok, own in features(points, before, n):
                    flat = (lang[own] << BITS | at)[ok]
                    total += np.bincount(flat, minlength=total.size).reshape(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array([x.tobytes() for x in total], pa.binary())], ["lang", "counts"])

    return run


class Model:
    """langs; log priors; log P(bucket | language) with a last row of zeros, for n-grams that don't count."""

    def __init__(self, langs: list[str], texts: np.ndarray, counts: np.ndarray, n: int, smooth: float):
        self.langs, self.n = langs, n
        self.prior = np.log((texts + 1) / (texts.sum() + len(langs))) if langs else np.zeros(0)
        table = np.log((counts + smooth) / (counts.sum(axis=1, keepdims=True) + smooth * counts.shape[1]))
        self.table = np.vstack([table.T, np.zeros(len(langs))]).astype(np.float32)

    def predict(self, col: pa.Array) -> tuple[list[str], np.ndarray]:
        """The likeliest language of each text and its posterior probability."""
        return self.judge(col)[:2]

    def judge(self, col: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The same, and what the likeliest language gives an n-gram in the mean, in log probability, over a language where all buckets are alike."""
        if not self.langs:
            return ["und"] * len(col), np.zeros(len(col)), np.zeros(len(col))
        raw, offs = text_offsets(col)
        points, before = characters(raw, offs)
        score, n = np.zeros((len(col), len(self.langs))) + self.prior, np.zeros(len(col))
        for at, ok, own in features(points, before, self.n):
            rows = self.table[np.where(ok, at, len(self.table) - 1)]
            n += np.bincount(own[ok], minlength=len(col))
            start = np.searchsorted(own, np.arange(len(col)))
            full = np.flatnonzero(np.diff(np.append(start, len(own))) > 0)
            if len(full):
                score[full] += np.add.reduceat(rows, start[full], axis=0, dtype=np.float64)
        ascii_letter = np.concatenate([[0], np.cumsum((points >= 97) & (points <= 122))])
        letters = np.diff(ascii_letter[before]) > 0
        for k in np.flatnonzero(~letters):
            letters[k] = has_letter(col[k].as_py())
        best = score.argmax(axis=1)
        p = 1 / np.exp(score - score.max(axis=1, keepdims=True)).sum(axis=1)
        gain = (score.max(axis=1) - self.prior[best]) / np.maximum(n, 1) + np.log(len(self.table) - 1)
        return [self.langs[b] if x else "und" for b, x in zip(best, letters, strict=True)], np.where(letters, p, 0.0), gain


def train(labelled: DataFrame, n: int = 3, per_lang: int = 5000, smooth: float = 0.1) -> Model:
    """labelled (doc_id, text, lang). At most about ``per_lang`` texts of each language teach its n-grams, those with the least hashes of doc_id; priors are of all texts.

    Rows with a null text, lang or doc_id teach nothing.
    """
    spark = labelled.sparkSession
    prepare(spark)
    rows = labelled.where("text is not null and lang is not null and doc_id is not null").select("doc_id", "text", "lang")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    langs = sorted(sizes)
    if not langs:
        return Model([], np.zeros(0), np.zeros((0, 1 << BITS)), n, smooth)
    most = F.create_map(*[F.lit(x) for k in langs for x in (k, min(1.0, per_lang / sizes[k]))])
    share = F.pmod(F.xxhash64("doc_id", F.lit("lang")), F.lit(1 << 20)) / float(1 << 20)
    some = rows.where(share < most[F.col("lang")]).select("text", "lang").repartition(8)
    texts, counts = np.array([sizes[k] for k in langs], float), np.zeros((len(langs), 1 << BITS))  # priors are of all texts
    for r in some.mapInArrow(_counts(langs, n), "lang string, counts binary").collect():
        k = langs.index(r["lang"])
        counts[k] += np.frombuffer(r["counts"], np.int64)
    return Model(langs, texts, counts, n, smooth)


def _predict(model):
    def run(batches):
        for batch in batches:
            rest = [k for k in range(batch.num_columns) if batch.schema.names[k] not in ("lang_pred", "score")]
            for part in slices(batch, "text", 1 << 20):
                langs, score = model.value.predict(part.column("text"))
                keep = [k for k in rest if part.schema.names[k] != "text"]
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), pa.array(langs, pa.string()), pa.array(score, pa.float64())], [*(part.schema.names[k] for k in keep), "lang_pred", "score"])

    return run


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """docs (doc_id, text, ...) -> (doc_id, lang_pred, score), from whole texts.

    score: the posterior probability. Null text, or one without a letter: ``und``, 0. Null doc_ids and
    repeated rows: each row has its result. Other columns are ignored; a model that has learnt nothing says ``und``.
    """
    spark = docs.sparkSession
    prepare(spark)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_predict(spark.sparkContext.broadcast(model)), "doc_id long, lang_pred string, score double")
