"""WARC archives of pages, and one capture index merged from sorted runs.

Writing: each task writes archive files of bounded size, a gzip member for each record. Of records with equal payloads the
one with the largest page_id is a response, the others revisit it and hold no payload. Beside each archive stands its
run: index entries sorted by URL key, time, page_id and place.

Merging: a bounded sample of the entries cuts the key space into ranges; each run is cut at the same keys, and the
pieces of a range meet in one task, which merges them by a loser tree. Ranges in order, and entries in order
within each, give the captures of every URL through time. Places are unique, so even one URL with a third of all
captures is cut evenly.

Reading: records are fetched by the merged index, archive by archive in order of offset.
"""

from __future__ import annotations

import base64
import bisect
import datetime
import hashlib
import pickle
import re
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import file_system, fresh_dir, prepare, stage

EPOCH = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)
RUN_ENTRIES = 2000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def url_key(url: str | None) -> str:
    """Host labels from the right, then path and query, in lower case: ``com,example)/a?b``."""
    m = re.match(r"[a-z][a-z0-9+.-]*://([^/?#]*)([^#]*)", (url or "").lower(), re.S)
    if not m:
        return (url or "").lower()
    host = m[1].rpartition("@")[2]
    host = host.removeprefix("www.")
    return ",".join(reversed(host.split("."))) + ")" + (m[2] or "/")


def capture_time(page_id: int | None) -> str:
    """Pages tell no time: a second for each page_id after the start of 2024, within a hundred years."""
    return (EPOCH + datetime.timedelta(seconds=(page_id or 0) % 3_000_000_000)).strftime("%Y-%m-%dT%H:%M:%SZ")


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """A WARC/1.1 record. A revisit keeps the response's head, whose Content-Length is the payload's, and no payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:x-page:{'' if page_id is None else page_id}>", f"WARC-Date: {capture_time(page_id)}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    lines += [f"WARC-Payload-Digest: sha1:{digest32(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:x-page:{refers_to}>"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Fields, HTTP head and payload of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if len(block) != int(fields["Content-Length"]) or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a record is cut short")
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, http, payload


def packed(data: bytes) -> bytes:
    z = zlib.compressobj(4, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


class Archive:
    def __init__(self, path: str):
        self.path, self.offset, self.entries = path, 0, []
        self.fs, self.local = file_system(path)
        self.out = self.fs.open_output_stream(self.local, compression=None)

    def add(self, page_id, url, payload: bytes, refers_to, revisit: bool) -> None:
        data = packed(record(page_id, url, payload, refers_to, revisit))
        self.out.write(data)
        self.entries.append((url_key(url), capture_time(page_id), -1 if page_id is None else page_id, self.path, self.offset, len(data)))
        self.offset += len(data)

    def close(self) -> list[list[tuple]]:
        """The sorted run, in pieces of RUN_ENTRIES entries."""
        self.out.close()
        self.entries.sort()
        return [self.entries[k : k + RUN_ENTRIES] for k in range(0, len(self.entries), RUN_ENTRIES)]


def _write(folder: str, archive_bytes: int):
    def run(batches):
        part, archive, n = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            for page_id, url, html, last in zip(*(batch.column(c) for c in ("page_id", "url", "html", "last")), strict=True):
                page_id, last = page_id.as_py(), last.as_py()
                if not archive:
                    archive = Archive(f"{folder}/part-{part:07d}-{n:05d}-{uuid.uuid4().hex}.warc.gz")
                archive.add(page_id, url.as_py(), html.as_py() or b"", last, last is not None and last != page_id)
                if archive.offset >= archive_bytes:
                    yield pieces(archive)
                    archive, n = None, n + 1
        if archive:
            yield pieces(archive)

    def pieces(archive):
        runs = archive.close()
        return pa.RecordBatch.from_arrays(
            [pa.array([archive.path] * len(runs), pa.string()), pa.array(range(len(runs)), pa.int64()), pa.array(map(len, runs), pa.int64()), pa.array([pickle.dumps(r[0]) for r in runs], pa.binary()), pa.array([pickle.dumps(r) for r in runs], pa.binary())],
            ["run", "piece", "entries", "first", "body"],
        )

    return run


class LoserTree:
    """Merges sorted lists: inner nodes hold the losers of matches between heads, so each step replays one path."""

    def __init__(self, lists: list[list]):
        self.lists, self.at = lists, [0] * len(lists)
        self.leaves = 1 << max(0, (len(lists) - 1).bit_length())
        self.loser = [-1] * self.leaves
        winners = [k if k < len(lists) and lists[k] else -1 for k in range(self.leaves)]
        level = self.leaves
        while level > 1:
            level //= 2
            nxt = []
            for k in range(level):
                a, b = winners[2 * k], winners[2 * k + 1]
                if self.before(b, a):
                    a, b = b, a
                self.loser[level + k] = b
                nxt.append(a)
            winners = nxt
        self.winner = winners[0] if winners else -1

    def before(self, a: int, b: int) -> bool:
        if a < 0 or b < 0:
            return b < 0 <= a
        return (self.lists[a][self.at[a]], a) < (self.lists[b][self.at[b]], b)

    def __iter__(self):
        while (k := self.winner) >= 0:
            yield self.lists[k][self.at[k]]
            self.at[k] += 1
            best = k if self.at[k] < len(self.lists[k]) else -1
            node = (k + self.leaves) // 2
            while node:
                if self.before(self.loser[node], best):
                    best, self.loser[node] = self.loser[node], best
                node //= 2
            self.winner = best


def _cut(cuts):
    """Pieces of runs, cut at the ranges' first entries."""

    def run(batches):
        starts = cuts.value
        for batch in batches:
            rows = []
            for name, piece, body in zip(*(batch.column(c) for c in ("run", "piece", "body")), strict=True):
                entries = pickle.loads(body.as_py())
                at = 0
                while at < len(entries):
                    r = bisect.bisect_right(starts, entries[at])
                    to = bisect.bisect_left(entries, starts[r], at) if r < len(starts) else len(entries)
                    rows.append((r, name.as_py(), piece.as_py(), pickle.dumps(entries[at:to])))
                    at = to
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], t) for k, t in enumerate((pa.int64(), pa.string(), pa.int64(), pa.binary()))], ["range", "run", "piece", "body"])

    return run


ENTRY = "range long, position long, url_key string, captured string, page_id long, path string, offset long, length long"


def _merge(batches):
    """Rows sorted by range, run and piece -> entries in order; one range at a time is held."""
    number, runs = None, {}

    def merged():
        columns = [[] for _ in range(6)]
        for e in LoserTree(list(runs.values())):
            for c, x in zip(columns, e, strict=True):
                c.append(x)
        n = len(columns[0])
        arrays = [pa.array([number] * n, pa.int64()), pa.array(range(n), pa.int64())]
        arrays += [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)]
        return pa.RecordBatch.from_arrays(arrays, [x.split()[0] for x in ENTRY.split(", ")])

    for batch in batches:
        for r, name, body in zip(*(batch.column(c).to_pylist() for c in ("range", "run", "body")), strict=True):
            if r != number and runs:
                yield merged()
                runs = {}
            number = r
            runs.setdefault(name, []).extend(pickle.loads(body))
    if runs:
        yield merged()


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = 64 << 20) -> DataFrame:
    """Writes pages (page_id, url, html, ...) below folder -> pieces of sorted runs (run, piece, entries, first, body)."""
    spark = pages.sparkSession
    prepare(spark)
    fs, local = file_system(folder)
    fs.create_dir(local, recursive=True)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("html"))
    rows = rows.withColumn("sha", F.unhex(F.sha1("html")))
    last = rows.groupBy("sha").agg(F.max("page_id").alias("last"))
    return stage(rows.join(last, "sha").select("page_id", "url", "html", "last").mapInArrow(_write(folder, archive_bytes), "run string, piece long, entries long, first binary, body binary"), "runs")


def _some(share: float):
    """A share of all entries, each as likely as any other; the same ones whenever a piece is read."""

    def run(batches):
        for batch in batches:
            out = []
            for name, piece, body in zip(*(batch.column(c) for c in ("run", "piece", "body")), strict=True):
                entries = pickle.loads(body.as_py())
                picked = np.random.default_rng([zlib.crc32(name.as_py().encode()), piece.as_py()]).random(len(entries)) < share
                out += [pickle.dumps(entries[k]) for k in np.flatnonzero(picked)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["entry"])

    return run


def merge_runs(runs: DataFrame, range_entries: int = 100_000, sample: int = 32) -> DataFrame:
    """The capture index: (range, position, url_key, captured, page_id, path, offset, length), ordered by range and position. A null page_id is -1 here.

    Ranges of about ``range_entries`` entries are cut at entries drawn evenly from all runs, about ``sample`` for each range; these are what the driver gets.
    """
    spark = runs.sparkSession
    prepare(spark)
    n = runs.agg(F.sum("entries")).first()[0] or 0
    ranges = max(1, -(-n // range_entries))
    drawn = runs.select("run", "piece", "body").mapInArrow(_some(min(1.0, sample / range_entries)), "entry binary") if ranges > 1 else None
    keys = sorted(pickle.loads(r["entry"]) for r in drawn.collect()) if drawn is not None else []
    cuts = sorted({keys[len(keys) * k // ranges] for k in range(1, ranges)} if keys else ())
    cut = runs.select("run", "piece", "body").mapInArrow(_cut(spark.sparkContext.broadcast(cuts)), "range long, run string, piece long, body binary")
    return stage(cut.repartition("range").sortWithinPartitions("range", "run", "piece").mapInArrow(_merge, ENTRY), "index")


PAGE = "page_id long, url_key string, captured string, payload_bytes long, payload_digest string, record_type string, refers_to long, range long, position long"


def _read(batches):
    """Index entries sorted by path and offset: files are read on, a span at a time."""
    path, file, raw, first = None, None, b"", 0
    for batch in batches:
        out = []
        columns = (batch.column(c).to_pylist() for c in ("path", "offset", "length", "url_key", "captured", "range", "position"))
        for p, offset, length, key, captured, r, position in zip(*columns, strict=True):
            if p != path:
                fs, local = file_system(p)
                path, file, raw, first = p, fs.open_input_file(local), b"", 0
            if not first <= offset <= offset + length <= first + len(raw):
                raw, first = file.read_at(max(length, 1 << 20), offset), offset
            fields, http, payload = parse(zlib.decompress(raw[offset - first : offset - first + length], 31))
            size = int(re.search(rb"Content-Length: (\d+)", http)[1])
            digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
            kind = fields["WARC-Type"]
            if kind == "response" and (len(payload) != size or digest32(payload) != digest):
                raise ValueError("a payload differs from its digest or length")
            number = [re.fullmatch(r"<urn:x-page:(-?\d*)>", fields.get(f, "<urn:x-page:>"))[1] for f in ("WARC-Record-ID", "WARC-Refers-To")]
            out.append((int(number[0]) if number[0] else None, key, captured, size, digest, kind, int(number[1]) if number[1] else None, r, position))
        types = [{"long": pa.int64(), "string": pa.string()}[x.split()[1]] for x in PAGE.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(types)], [x.split()[0] for x in PAGE.split(", ")])


def read_archives(index: DataFrame) -> DataFrame:
    """The records that index entries point to, checked against their digests; see PAGE."""
    prepare(index.sparkSession)
    places = index.select("path", "offset", "length", "url_key", "captured", "range", "position")
    return places.repartition("path").sortWithinPartitions("path", "offset").mapInArrow(_read, PAGE)


def archive_pages(pages: DataFrame, archive_bytes: int = 64 << 20) -> DataFrame:
    """pages (page_id, url, html, ...) -> what their archives hold, read back by the merged index; a row for each row of pages.

    payload: html in UTF-8, empty if null. Null url: its key is empty. Null page_id: a revisit if another record with a page_id has the
    same payload, else a response; none refers to it. Repeated rows whose page_id is the largest are responses each.
    Other columns are ignored; an empty table gives no rows.
    """
    spark: SparkSession = pages.sparkSession
    return read_archives(merge_runs(write_archives(pages, fresh_dir(spark, "warc"), archive_bytes)))
