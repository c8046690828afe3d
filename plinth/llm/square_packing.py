"""Sum-of-squares packing: each document goes where the squared counts of open bins per residual gap become smallest.

Only numbers are packed: texts are encoded once, into a staged table of pieces, and the rest of each document's length (its first piece,
if shorter than a sequence) is dealt at random to groups of about ``group_docs``. A task packs one group at a time, longest first; what it holds of
a group is two numbers a document. A bin is opened only where no open one has room, so that few sequences are needed.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import prepare, stage
from .tokens import encoder, load

PIECES = "doc_id long, piece int, start long, length long, ids array<int>, ids_crc32 long"
FAR = np.iinfo(np.int64).max


class SquareBins:
    """Open bins by the room they have left. count[g]: bins with room g."""

    def __init__(self, size: int):
        self.size, self.made = size, 0
        self.count = np.zeros(size + 1, np.int64)
        self.bins: list[list[int]] = [[] for _ in range(size + 1)]

    def place(self, n: int) -> tuple[int, int]:
        """(bin, place in it) of a document of n tokens.

        From room g to g - n the sum of squares changes by 2 (count[g - n] - count[g] + 1), by 1 - 2 count[g] if the bin is full then (it is no longer
        open). Of equally good rooms the smallest.
        """
        there = self.count[n:]
        then = self.count[: len(there)]
        change = 2 * (then - there + 1)
        change[0] = 1 - 2 * there[0]
        change[there == 0] = FAR
        g = n + int(np.argmin(change))
        if self.count[g]:
            bin_ = self.bins[g].pop()
            self.count[g] -= 1
        else:
            bin_, g, self.made = self.made, self.size, self.made + 1
        if g > n:
            self.count[g - n] += 1
            self.bins[g - n].append(bin_)
        return bin_, self.size - g


def square_pack(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each length (1 to size) its bin and its place there; longest first, equal ones in the order given."""
    bins, places = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    open_ = SquareBins(size)
    for i in np.argsort(-lengths, kind="stable"):
        bins[i], places[i] = open_.place(int(lengths[i]))
    return bins, places


def cut(tokens: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Documents of so many tokens -> (document, piece, start, length) of their pieces: all have ``size`` tokens, the first of a document may have fewer."""
    pieces = -(-tokens // size)
    doc = np.repeat(np.arange(len(tokens)), pieces)
    piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    first = (tokens - (pieces - 1) * size)[doc]
    return doc, piece, np.where(piece == 0, 0, first + (piece - 1) * size), np.where(piece == 0, first, size)


def _encoded(definition, end_id: int, size: int):
    def run(batches):
        enc = encoder(definition.value)
        end = np.array([end_id], "<u4")
        for batch in batches:
            for part, texts in enc.batch(batch):
                docs = [np.concatenate([ids, end], dtype="<u4") for ids in texts]
                tokens = np.array([len(ids) for ids in docs], np.int64)
                doc, piece, start, length = cut(tokens, size)
                sums = [zlib.crc32(docs[d][a : a + n]) for d, a, n in zip(doc.tolist(), start.tolist(), length.tolist(), strict=True)]
                offsets = np.append(0, np.cumsum(length)).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(docs).view("<i4") if docs else np.zeros(0, np.int32)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), ids, pa.array(sums, pa.int64())], [x.split()[0] for x in PIECES.split(", ")])

    return run


def _packed(size: int):
    def group(number: int, rows: list[pa.RecordBatch]):
        at = np.concatenate([b.column("at").to_numpy() for b in rows])
        length = np.concatenate([b.column("length").to_numpy() for b in rows])
        order = np.argsort(at)  # whatever the order of arrival
        bins, places = square_pack(length[order], size)
        return pa.RecordBatch.from_arrays([pa.array(at[order]), pa.array((number << 32) + bins), pa.array(places)], ["at", "sequence_id", "offset"])

    def run(batches):
        number, rows = None, []
        for batch in batches:
            grp = batch.column("grp").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(grp)) + 1).tolist(), len(grp)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if rows and grp[a] != number:
                    yield group(number, rows)
                    rows = []
                number = int(grp[a])
                rows.append(batch.slice(a, b - a))
        if rows:
            yield group(number, rows)

    return run


def encode_pieces(docs: DataFrame, tokenizer_path: str, end_id: int = 2, size: int = 1024) -> DataFrame:
    """docs (doc_id, text, ...) -> PIECES: a document is its ids and then end_id, cut into pieces of ``size`` ids; only its first piece may be shorter."""
    spark = docs.sparkSession
    prepare(spark)
    definition = spark.sparkContext.broadcast(load(tokenizer_path))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_encoded(definition, end_id, size), PIECES)


def square_pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 2, size: int = 1024, group_docs: int = 8192, seed: int = 7) -> DataFrame:
    """docs (doc_id, text, ...) -> pieces (PIECES, sequence_id, offset).

    Documents of over ``size`` tokens are cut, as encode_pieces says; others are whole. A piece of ``size`` tokens is a sequence of its own, with a
    negative number; the others are packed by group. Null or empty text: the end id alone. Null doc_id and repeated rows: packed like others,
    each row once. Other columns are ignored; an empty table gives no rows. Equal lengths of a group are placed in the order of the staged table.
    """
    pieces = stage(encode_pieces(docs, tokenizer_path, end_id, size).withColumn("at", F.monotonically_increasing_id()), "pieces")
    short = pieces.where(F.col("length") < size).select("at", "length")
    groups = max(1, -(-short.count() // group_docs))
    dealt = short.withColumn("grp", F.pmod(F.xxhash64("at", F.lit(seed)), F.lit(groups)))
    placed = dealt.repartition("grp").sortWithinPartitions("grp").mapInArrow(_packed(size), "at long, sequence_id long, offset long")
    full = pieces.where(F.col("length") == size).withColumns({"sequence_id": -1 - F.col("at"), "offset": F.lit(0).cast("long")})
    names = [x.split()[0] for x in PIECES.split(", ")] + ["sequence_id", "offset"]
    return pieces.where(F.col("length") < size).join(placed, "at").select(names).unionByName(full.select(names))
