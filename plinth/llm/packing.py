"""Packing by first-fit decreasing, over a tournament tree of bin capacities, in randomised groups.

Rows are dealt at random to groups of about ``group_docs`` documents; each group is packed on its own, by one
task that holds one group at a time. A document is cut into full sequences and a tail; tails go, longest
first, each to the first open bin with room, found by descending the tree of largest capacities. Then the
contents of the emptiest bins are cut to fill the gaps of the fullest, and what remains in the last bin is cut
into powers of two, so that a group ends without padding.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import prepare
from .tokens import encoder, load

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
NAMES = [x.split()[0] for x in SCHEMA.split(", ")]
GROUP_TOKENS = 4 << 20


class CapacityTree:
    """Bins that all begin empty; first(n) is the leftmost bin with room for n, in as many steps as the tree is high."""

    def __init__(self, bins: int, size: int):
        self.leaves = 1 << max(0, (bins - 1).bit_length())
        self.room = [size] * (2 * self.leaves)

    def first(self, n: int) -> int:
        room, at = self.room, 1
        while at < self.leaves:
            at *= 2
            if room[at] < n:
                at += 1
        return at - self.leaves

    def take(self, bin_: int, n: int) -> None:
        room, at = self.room, bin_ + self.leaves
        room[at] -= n
        while at > 1:
            at //= 2
            most = max(room[2 * at], room[2 * at + 1])
            if room[at] == most:
                break
            room[at] = most


def first_fit_decreasing(lengths: list[int], size: int) -> list[list[int]]:
    """Indexes of lengths (1 to size each), by bin."""
    tree, bins = CapacityTree(len(lengths), size), []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        b = tree.first(lengths[i])
        tree.take(b, lengths[i])
        if b == len(bins):
            bins.append([])
        bins[b].append(i)
    return bins


def fill(bins: list[list[tuple[int, int, int]]], size: int) -> list[list[tuple[int, int, int]]]:
    """Bins of pieces (item, start, length), without padding: each is full or holds a power of two of tokens."""
    used = [sum(p[2] for p in b) for b in bins]
    whole = [n == size or n & (n - 1) == 0 for n in used]
    done = [b for b, w in zip(bins, whole, strict=True) if w]
    rest = [list(b) for n, b in sorted(((n, b) for n, b, w in zip(used, bins, whole, strict=True) if not w), key=lambda x: -x[0])]
    at, to = 0, len(rest) - 1
    n = sum(p[2] for p in rest[0]) if rest else 0
    while at < to:
        if n < size and rest[to]:
            n += _move(rest[to], rest[at], size - n)
        if not rest[to]:
            to -= 1
        if n == size:
            done.append(rest[at])
            at += 1
            n = sum(p[2] for p in rest[at]) if at <= to else 0
    left = rest[at] if at == to else []
    total = sum(p[2] for p in left)
    while total:
        done.append([])
        n = 1 << (total.bit_length() - 1)
        total -= n
        while n:
            n -= _move(left, done[-1], n)
    return done


def _move(giver: list[tuple[int, int, int]], taker: list[tuple[int, int, int]], most: int) -> int:
    """Moves the giver's last piece, or as much of it as fits."""
    item, start, length = giver.pop()
    cut = min(length, most)
    taker.append((item, start, cut))
    if cut < length:
        giver.append((item, start + cut, length - cut))
    return cut


def pack(lengths: list[int], size: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (document, start, length) that together hold each token of each document once."""
    full = [[(i, at, size)] for i, n in enumerate(lengths) for at in range(0, n - size + 1, size)]
    tails = [(i, n - n % size, n % size) for i, n in enumerate(lengths) if n % size]
    bins = [[tails[k] for k in b] for b in first_fit_decreasing([t[2] for t in tails], size)] if tails else []
    return full + fill(bins, size)


def _packed(definition, end_id: int, size: int):
    def group(number, first, docs):
        lengths = [len(ids) for _, ids in docs]
        out: list[list] = [[] for _ in NAMES]
        for k, pieces in enumerate(pack(lengths, size)):
            offset = 0
            for i, start, length in pieces:
                for column, x in zip(out, (docs[i][0], start, length, docs[i][1][start : start + length].tobytes(), lengths[i], (number << 32) + first + k, offset), strict=True):
                    column.append(x)
                offset += length
        last = 1 + max((x - (number << 32) for x in out[5]), default=first - 1)
        return last, pa.RecordBatch.from_arrays([pa.array(x, pa.binary() if n == "ids" else pa.int64()) for n, x in zip(NAMES, out, strict=True)], NAMES)

    def run(batches):
        enc = encoder(definition.value)
        number, first, docs, tokens = None, 0, [], 0
        end = np.array([end_id], "<u4")
        for batch in batches:
            for part, texts in enc.batch(batch):
                for g, doc_id, ids in zip(part.column("grp").to_pylist(), part.column("doc_id").to_pylist(), texts, strict=True):
                    if docs and (g != number or tokens > GROUP_TOKENS):
                        first, made = group(number, first, docs)
                        yield made
                        docs, tokens = [], 0
                    if g != number:
                        number, first = g, 0
                    docs.append((doc_id, np.concatenate([ids, end], dtype="<u4")))
                    tokens += len(ids) + 1
        if docs:
            yield group(number, first, docs)[1]

    return run


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 0, size: int = 1024, group_docs: int = 1024, seed: int = 7) -> DataFrame:
    """docs (doc_id, text, ...) -> pieces (doc_id, start, length, ids, doc_tokens, sequence_id, offset).

    A document is its ids and then end_id. ids: the piece's, little-endian unsigned 32-bit. Null or empty text: the
    end id alone. Null doc_id and repeated rows: packed like others, each row once. Other columns are ignored; an
    empty table gives no rows. Rows are dealt by position, so docs should be a table, whose retried tasks
    read the same rows.
    """
    spark = docs.sparkSession
    prepare(spark)
    definition = spark.sparkContext.broadcast(load(tokenizer_path))
    groups = max(1, -(-docs.count() // group_docs))
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64(F.monotonically_increasing_id(), F.lit(seed)).alias("at"))
    dealt = dealt.select("doc_id", "text", "at", F.pmod("at", F.lit(groups)).alias("grp"))
    return dealt.repartition("grp").sortWithinPartitions("grp", "at").mapInArrow(_packed(definition, end_id, size), SCHEMA)
