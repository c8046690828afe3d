"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment of passages with test items.

Words are runs of letters and digits, with A-Z lower-cased. Corpus counts of all n-grams of the items choose the
seeds: in each window of ``window`` consecutive n-grams of an item the rarest, and all that are rarer than one in
``rare`` texts (of an item of fewer than SHORT words, one in ``rare / 10``); so any run of ``window + n - 1`` words shared with an item holds a seed. Each seed found in a text joins the
passage around it to the item; overlapping passages of one item are one. A local alignment (match 1, mismatch and
gap -1) scores each passage, relative to the item's length; the best passage of a text and item counts.

Items are taken a block of at most ``block_words`` words at a time, which bounds what is broadcast; long items
are aligned in overlapping segments of ``segment`` words.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .resampling import token_hashes
from .shared import prepare, slices, text_offsets
from .words import U, grams

FILTER = 20
#: Items of fewer words than this have ten times as frequent n-grams as seeds too.
SHORT = 40
KIND = "doc_id long, rid long, item_id long, score double, start_word long, end_word long"


class Items:
    """A block of items: (item_id, segment's first word, word hashes) and their n-grams."""

    def __init__(self, rows: list[tuple[int | None, np.ndarray]], n: int, segment: int):
        self.n = n
        self.parts = [(i, at, h[at : at + segment]) for i, h in rows for at in range(0, max(1, len(h) - segment // 2), segment // 2 if len(h) > segment else len(h) + 1)]
        self.places = defaultdict(list)
        for k, (_, _, h) in enumerate(self.parts):
            for at, g in enumerate(grams(h, n).tolist()):
                self.places[g].append((k, at))
        self.grams = np.sort(np.array(list(self.places), U))
        self.seeds = self.grams

    def flags(self, which: np.ndarray) -> np.ndarray:
        out = np.zeros(1 << FILTER, bool)
        out[(which >> U(64 - FILTER)).astype(np.int64)] = True
        return out

    def choose(self, counts: np.ndarray, few: int, window: int) -> None:
        """counts: of each of self.grams in the corpus."""
        count = dict(zip(self.grams.tolist(), counts.tolist(), strict=True))
        chosen = {g for g, c in count.items() if c <= few}
        for _, _, h in self.parts:
            gs = grams(h, self.n).tolist()
            if len(h) < SHORT:
                chosen.update(g for g in gs if count[g] <= 10 * few)
            for at in range(max(1, len(gs) - window + 1)):
                if some := gs[at : at + window]:
                    chosen.add(min(some, key=lambda g: (count[g], g)))
        self.seeds = np.sort(np.array(list(chosen), U))


def blocks(benchmark: DataFrame, n: int, block_words: int, segment: int):
    """Items of the benchmark, a bounded block at a time."""
    rows, words = [], 0
    for r in benchmark.select(F.col("item_id").cast("long"), "text").where("text is not null").toLocalIterator():
        h, _ = token_hashes(*text_offsets(pa.array([r[1]], pa.string())), words_only=True)
        if len(h) < n:
            continue
        rows.append((r[0], h))
        words += len(h)
        if words >= block_words:
            yield Items(rows, n, segment)
            rows, words = [], 0
    if rows:
        yield Items(rows, n, segment)


def found(h: np.ndarray, n: int, wanted: np.ndarray, flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word, index in wanted) of all n-grams among the sorted wanted ones."""
    g = grams(h, n)
    at = np.flatnonzero(flags[(g >> U(64 - FILTER)).astype(np.int64)])
    k = np.minimum(np.searchsorted(wanted, g[at]), len(wanted) - 1)
    ok = wanted[k] == g[at]
    return at[ok], k[ok]


def _count(items):
    def run(batches):
        x = items.value
        flags, total, texts = x.flags(x.grams), np.zeros(len(x.grams), np.int64), 0
        for batch in batches:
            for part in slices(batch, "text"):
                h, before = token_hashes(*text_offsets(part.column("text")), words_only=True)
                at, k = found(h, x.n, x.grams, flags)
                total += np.bincount(k, minlength=len(total))
                texts += part.num_rows
        on = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(on, -1)), pa.array(np.append(total[on], texts))], ["gram", "n"])

    return run


def align(texts: list[np.ndarray], items: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Smith-Waterman of each pair: its score, and the first and last word + 1 in the text (the first is that of the best path)."""
    p, m, w = len(texts), max(map(len, items)), max(map(len, texts))
    x, y = np.zeros((p, w), U), np.full((p, m), U(1), U)  # no hash of a word is likely to be 0 or 1
    for k in range(p):
        x[k, : len(texts[k])] = texts[k]
        y[k, : len(items[k])] = items[k]
    down = np.arange(m, dtype=np.int32)
    h, begin = np.zeros((p, m), np.int32), np.zeros((p, m), np.int32)
    best, first, last = np.zeros(p, np.int32), np.zeros(p, np.int32), np.zeros(p, np.int32)
    rows = np.arange(p)
    for i in range(w):
        diagonal = np.where(x[:, i : i + 1] == y, 1, -1).astype(np.int32)
        diagonal[:, 1:] += h[:, :-1]
        from_diagonal = np.full((p, m), i, np.int32)
        from_diagonal[:, 1:] = np.where(h[:, :-1] > 0, begin[:, :-1], i)
        step = h - 1
        new = np.maximum(diagonal, step)
        start = np.where(diagonal >= step, from_diagonal, begin)
        start[new <= 0] = i + 1
        new = np.maximum(new, 0)
        key = ((new + down).astype(np.int64) << 32) - start  # a gap in the text: the best of what stands to the left, less its distance
        key = np.maximum.accumulate(key, axis=1)
        value = ((key + (1 << 31)) >> 32).astype(np.int32)
        begin = ((value.astype(np.int64) << 32) - key).astype(np.int32)
        h = value - down
        at = h.argmax(axis=1)
        top = h[rows, at]
        more = top > best
        best[more], first[more], last[more] = top[more], begin[rows, at][more], i + 1
    return best, first, last


def best_matches(x: Items, flags: np.ndarray, h: np.ndarray, before: np.ndarray, least: float) -> dict[tuple[int, int | None], tuple[float, int, int]]:
    """Of a batch of texts, given by word hashes: (text, item_id) -> (score, first word, last word + 1)."""
    at, k = found(h, x.n, x.seeds, flags)
    own = np.searchsorted(before, at, side="right") - 1
    inside = at + x.n <= before[own + 1] if len(at) else np.zeros(0, bool)
    spans: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
    for a, g, d in zip(at[inside].tolist(), x.seeds[k[inside]].tolist(), own[inside].tolist(), strict=True):
        for item, place in x.places[g]:
            size = len(x.parts[item][2])
            spare = 8 + size // 4
            spans[d, item].append((max(int(before[d]), a - place - spare), min(int(before[d + 1]), a - place + size + spare)))
    todo = []
    for (d, item), some in spans.items():
        some.sort()
        a, b = some[0]
        for c, e in [*some[1:], (1 << 62, 0)]:
            if c > b:
                todo += [(d, item, f, min(b, f + 4096)) for f in range(a, max(a + 1, b - 2048), 2048 if b - a > 4096 else b - a + 1)]
                a, b = c, e
            b = max(b, e)
    todo.sort(key=lambda t: (t[3] - t[2], len(x.parts[t[1]][2])))
    best: dict = {}
    while todo:
        many = max(8, 60_000 // max(1, todo[-1][3] - todo[-1][2]))
        some, todo = todo[-many:], todo[:-many]
        for (d, item, a, _), s, c, e in zip(some, *align([h[t[2] : t[3]] for t in some], [x.parts[t[1]][2] for t in some]), strict=True):
            score = s / len(x.parts[item][2])
            key = d, x.parts[item][0]
            if score >= least and score > best.get(key, (0,))[0]:
                best[key] = float(score), int(a + c - before[d]), int(a + e - before[d])
    return best


def _texts(items, least: float, batches):
    x = items.value
    flags = x.flags(x.seeds)
    for batch in batches:
        for part in slices(batch, "text"):
            yield part, best_matches(x, flags, *token_hashes(*text_offsets(part.column("text")), words_only=True), least)


def _matches(items, least: float):
    def run(batches):
        for part, best in _texts(items, least, batches):
            keys = sorted(best, key=lambda q: (q[0], q[1] is None, q[1] or 0))
            rows = pa.array([q[0] for q in keys], pa.int64())
            columns = [part.column("doc_id").take(rows), part.column("rid").take(rows), pa.array([q[1] for q in keys], pa.int64())]
            columns += [pa.array([best[q][k] for q in keys], t) for k, t in enumerate((pa.float64(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "rid", "item_id", "score", "start_word", "end_word"])

    return run


def _clean(items, least: float):
    def run(batches):
        for part, best in _texts(items, least, batches):
            keep = np.ones(part.num_rows, bool)
            keep[[d for d, _ in best]] = False
            yield part.filter(pa.array(keep))

    return run


def _chosen(rows: DataFrame, benchmark: DataFrame, n: int, window: int, rare: int, block_words: int, segment: int):
    """Broadcast blocks of items with their seeds."""
    sc = rows.sparkSession.sparkContext
    for items in blocks(benchmark, n, block_words, segment):
        known = sc.broadcast(items)
        counts = {r["gram"]: r["n"] for r in rows.select("text").mapInArrow(_count(known), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()}
        items.choose(np.array([counts.get(k, 0) for k in range(len(items.grams))]), max(1, counts.get(-1, 0) // rare), window)
        yield sc.broadcast(items)


def contaminated(docs: DataFrame, benchmark: DataFrame, n: int = 3, window: int = 4, least: float = 0.4, rare: int = 10_000, block_words: int = 200_000, segment: int = 256) -> DataFrame:
    """docs (doc_id, text, ...), benchmark (item_id, text) -> (doc_id, rid, item_id, score, start_word, end_word).

    A row for each row of docs and item whose best passage scores ``least`` or more of the item's (or a segment's) length; rid: hash of doc_id and text.
    The passage is given in words of the text. Null or empty texts and items match nothing, nor do items of fewer than n words.
    Null doc_ids and item_ids are kept as they are; of items with the same item_id the best match counts. Repeated rows of docs each have
    their rows. Other columns are ignored; empty tables give no rows.
    """
    spark: SparkSession = docs.sparkSession
    prepare(spark)
    rows = docs.select(F.xxhash64("doc_id", "text").alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = spark.createDataFrame([], KIND)
    for items in _chosen(rows, benchmark, n, window, rare, block_words, segment):
        out = out.unionByName(rows.mapInArrow(_matches(items, least), KIND))
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 3, window: int = 4, least: float = 0.4, rare: int = 10_000, block_words: int = 200_000, segment: int = 256) -> DataFrame:
    """The rows of docs, with all their columns, that contaminated() would not return."""
    prepare(docs.sparkSession)
    out = docs
    for items in _chosen(docs, benchmark, n, window, rare, block_words, segment):
        out = out.mapInArrow(_clean(items, least), docs.schema)
    return out
