"""Length-delimited binary records of token ids, with a separate offset index.

A shard is a run of records. Record: length (u64), masked CRC-32C of these 8 bytes (u32), payload, masked CRC-32C
of the payload (u32). Payload: doc_id (i64), 1 if it is null (u8), bytes for each id (u8), the ids. All little-endian.
Beside a shard stands its index, an array of (offset u64, payload length u64, ids u64) for each record, by which a
reader can fetch any record on its own, in any order. Shards hold ascending doc_ids, one after the other.
"""

from __future__ import annotations

import struct
import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .crc32c import masked
from .shared import file_system, fresh_dir, prepare, stage
from .tokens import encoder, load

ENTRY = np.dtype([("offset", "<u8"), ("length", "<u8"), ("tokens", "<u8")])
HEAD = struct.Struct("<qBB")
FLUSH = 4 << 20


def frames(payloads: list[bytes]) -> list[bytes]:
    """Each payload with its lengths and checksums around it."""
    sizes = [struct.pack("<Q", len(p)) for p in payloads]
    heads, bodies = masked(sizes), masked(payloads)
    return [b"".join((n, int(h).to_bytes(4, "little"), p, int(b).to_bytes(4, "little"))) for n, h, p, b in zip(sizes, heads, payloads, bodies, strict=True)]


def unframe(raw: bytes, entries: np.ndarray, at: int) -> list[bytes]:
    """The payloads of consecutive index entries; raw begins at offset ``at`` of the shard. Raises on any wrong checksum."""
    sizes, payloads, sums = [], [], []
    for offset, length, _ in entries.tolist():
        o = offset - at
        sizes.append(raw[o : o + 8])
        payloads.append(raw[o + 12 : o + 12 + length])
        sums.append((struct.unpack_from("<QI", raw, o), struct.unpack_from("<I", raw, o + 12 + length)[0], length))
    for ((n, h), b, length), h2, b2 in zip(sums, masked(sizes).tolist(), masked(payloads).tolist(), strict=True):
        if n != length or h != h2 or b != b2:
            raise ValueError("a record's length or checksum is wrong")
    return payloads


class ShardWriter:
    def __init__(self, path: str):
        self.path, self.offset, self.waiting, self.size, self.index = path, 0, [], 0, []
        self.fs, self.local = file_system(path)
        self.out = self.fs.open_output_stream(self.local, compression=None)

    def add(self, doc_id, ids: bytes, itemsize: int) -> None:
        self.waiting.append((HEAD.pack(doc_id or 0, doc_id is None, itemsize) + ids, len(ids) // itemsize))
        self.size += len(ids)
        if self.size >= FLUSH:
            self.flush()

    def flush(self) -> None:
        for (payload, tokens), frame in zip(self.waiting, frames([p for p, _ in self.waiting]), strict=True):
            self.index.append((self.offset, len(payload), tokens))
            self.offset += len(frame)
            self.out.write(frame)
        self.waiting, self.size = [], 0

    def close(self) -> tuple[str, int, int]:
        self.flush()
        self.out.close()
        entries = np.array(self.index, ENTRY)
        with self.fs.open_output_stream(self.local + ".idx") as f:
            f.write(entries.tobytes())
        return self.path, len(entries), int(entries["tokens"].sum())


def _write(definition, end_id: int, folder: str, shard_bytes: int):
    def run(batches):
        enc = encoder(definition.value)
        end = np.array([end_id], enc.dtype).tobytes()
        part, shards, writer = TaskContext.get().partitionId(), [], None
        for batch in batches:
            for piece, texts in enc.batch(batch):
                for doc_id, ids in zip(piece.column("doc_id").to_pylist(), texts, strict=True):
                    if writer and writer.offset >= shard_bytes:
                        shards.append(writer.close())
                        writer = None
                    if not writer:
                        writer = ShardWriter(f"{folder}/part-{part:07d}-{len(shards):05d}-{uuid.uuid4().hex}.rec")
                    writer.add(doc_id, ids.tobytes() + end, enc.dtype.itemsize)
        if writer:
            shards.append(writer.close())
        columns = [[part] * len(shards), range(len(shards)), *([s[k] for s in shards] for k in range(3))]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["part", "shard", "path", "records", "tokens"])

    return run


def write_records(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int = 2, shard_bytes: int = 128 << 20) -> list[tuple[str, int]]:
    """Writes docs (doc_id, text, ...) in ascending doc_id order -> [(path of a shard, ids in the shards before it)].

    Null text: empty, so the end id alone. Null doc_ids come first; equal ones stand in the order of their texts' hashes.
    An empty table makes no shard. The list has one entry for each shard of about shard_bytes bytes. Shards of
    attempts that failed are in no list.
    """
    spark = docs.sparkSession
    prepare(spark)
    fs, local = file_system(folder)
    fs.create_dir(local, recursive=True)
    definition = spark.sparkContext.broadcast(load(tokenizer_path))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text", F.monotonically_increasing_id()).alias("tie"))
    rows = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    made = stage(rows.mapInArrow(_write(definition, end_id, folder, shard_bytes), "part int, shard int, path string, records long, tokens long"), "shards")
    out, start = [], 0
    for r in made.orderBy("part", "shard").collect():
        out.append((r["path"], start))
        start += r["tokens"]
    return out


def _read(batches):
    for batch in batches:
        for path, start in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist(), strict=True):
            fs, local = file_system(path)
            with fs.open_input_stream(local + ".idx") as f:
                entries = np.frombuffer(f.read(), ENTRY)
            with fs.open_input_file(local) as f:
                at = 0
                while at < len(entries):
                    to = max(at + 1, int(np.searchsorted(entries["offset"], entries["offset"][at] + np.uint64(FLUSH))))
                    some = entries[at:to]
                    first = int(some["offset"][0])
                    raw = f.read_at(int(some["offset"][-1] + some["length"][-1]) + 16 - first, first)
                    ids, doc_ids = [], []
                    for payload in unframe(raw, some, first):
                        doc_id, null, itemsize = HEAD.unpack_from(payload)
                        doc_ids.append(None if null else doc_id)
                        ids.append(np.frombuffer(payload, f"<u{itemsize}", offset=HEAD.size).astype("<u4").tobytes())
                    tokens = some["tokens"].astype(np.int64)
                    starts = start + np.cumsum(tokens) - tokens
                    start += int(tokens.sum())
                    yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(starts), pa.array(tokens), pa.array(ids, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])
                    at = to


def read_records(spark: SparkSession, shards: list[tuple[str, int]]) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of all records; ids: little-endian unsigned 32-bit. Checks all lengths and checksums."""
    prepare(spark)
    files = spark.createDataFrame(shards, "path string, base long").repartition(max(1, len(shards)))
    return files.mapInArrow(_read, "doc_id long, start long, n_tokens long, ids binary")


def token_records(docs: DataFrame, tokenizer_path: str, end_id: int = 2, shard_bytes: int = 128 << 20) -> DataFrame:
    """Writes docs below the shared folder and reads them back; see write_records and read_records."""
    spark = docs.sparkSession
    return read_records(spark, write_records(docs, tokenizer_path, fresh_dir(spark, "records"), end_id, shard_bytes))
