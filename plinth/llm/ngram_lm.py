"""N-gram language model in an Elias-Fano trie, cut by context into parts that are built and asked one at a time.

Tokens are words (see ``words``) and one end for each text. Level 1 holds all words of the training texts, in order of their
64-bit hashes (an Elias-Fano sequence), with exact counts; frequent words have small numbers. Level k > 1 holds
the n-grams of k words seen at least ``least`` times: contexts of k - 1 words, an increasing sequence; under each a range of
children, found by monotone pointers (Elias-Fano again); a child is stored as ``context's place * 2**b + word number``, numbers of
b bits being spread by a bijection, one increasing sequence for a part, so a query is a successor search relative to its context. An n-gram seen c times below
a context seen C times has the discounted probability ``(c - d) / C``, a context the weight g of what is left; their log10s
are 8-bit codes of a codebook for each file, fitted on all its values when it is written. An n-gram's probability is ``(c - d) / C +
g * p(shorter context)``, that of single words ``(c + 0.1) / (N + 0.1 (V + 1))``.

How it is spread: texts become *pieces* of about ``PIECE`` tokens, written to the shared folder as numbers into a dictionary of
the piece; a long text goes on in the next piece, which begins with the words before. Pieces send their distinct n-grams, summed, to
*parts* chosen by the context's hash. A context of over a part's share of all tokens is *hot*: its n-grams are dealt by
their own hash, and what they sum to is added up and broadcast (at most one hot context a part). A part is a file. To be
asked, it is sent its path and the pieces' distinct n-grams, is mapped into memory once (first copied to an unlinked temporary file
where the path isn't local), and sends back codes. ``train_and_score`` asks a part as soon as its file is written, for all that was
sent to be counted. So no task opens more than one part at a time, and none looks up an n-gram of a piece
twice. Levels above 1 are built in ``ROUNDS`` and asked in ``ASKING`` rounds over the parts, so that shuffles on disk stay small.
Each piece sends a block to nearly every part, so blocks grow with the square of the input, though what is in them doesn't.
"""

from __future__ import annotations

import json
import mmap
import tempfile
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .elias_fano import EliasFano
from .shared import drop_dir, file_system, free, fresh_dir, prepare, slices, stage, text_offsets
from .words import ODD, SPACE, U, mix, word_hashes

END = 0x5851F42D4C957F2D
ORDER_MOST = 3
#: Tokens of a piece (the last text's segment may add SEGMENT / 2), of a part of a level above 1, and of a part of level 1.
PIECE, PART, WORDS_PART = 1_000_000, 1_000_000, 8_000_000
#: Words or n-grams that a part is asked for at a time.
ASKED = 200_000
#: Bytes of text hashed at a time.
SEGMENT = 1 << 20
#: Rounds over the parts of each level, when it is built and when it is asked.
ROUNDS, ASKING = {2: 1, 3: 2}, {2: 1, 3: 3}
#: More parts than this share tasks.
TASKS_MOST = 20_000


# ---- files and blocks of named arrays


def save(path: str, arrays: dict[str, np.ndarray], numbers: dict) -> None:
    """Arrays as they are, to be mapped into memory."""
    fs, local = file_system(path)
    at, parts = 0, {}
    for k, a in arrays.items():
        parts[k] = (at, a.dtype.str, len(a))
        at += -(-a.nbytes // 64) * 64
    head = json.dumps({"arrays": parts, "numbers": numbers}).encode().ljust(4096)
    with fs.open_output_stream(local, compression=None) as f:
        f.write(head)
        for a in arrays.values():
            f.write(a.tobytes().ljust(-(-a.nbytes // 64) * 64, b"\0"))


def load(path: str) -> dict:
    """Arrays mapped into memory, and numbers."""
    fs, local = file_system(path)
    if fs.type_name == "local":
        with open(local, "rb") as f:
            raw = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
    else:
        with tempfile.TemporaryFile() as f, fs.open_input_file(local) as g:
            while part := g.read(16 << 20):
                f.write(part)
            f.flush()
            raw = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
    head = json.loads(raw[:4096])
    return {k: np.frombuffer(raw, t, n, 4096 + at) for k, (at, t, n) in head["arrays"].items()} | head["numbers"]


def _put(name: str, e: EliasFano) -> tuple[dict, dict]:
    return {f"{name}.low": e.low, f"{name}.high": e.high, f"{name}.ones": e.ones}, {f"{name}.n": e.n, f"{name}.bits": e.low_bits}


def _get(name: str, x: dict) -> EliasFano:
    return EliasFano(x[f"{name}.n"], x[f"{name}.bits"], x[f"{name}.low"], x[f"{name}.high"], x[f"{name}.ones"])


_zstd: list = []


def _codec() -> tuple[zstandard.ZstdCompressor, zstandard.ZstdDecompressor]:
    """One for each process."""
    if not _zstd:
        _zstd.extend((zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()))
    return tuple(_zstd)


def dump(**arrays: np.ndarray) -> bytes:
    """Arrays as one compressed block: all lowest bytes of an array, then all next ones, as far as any is set."""
    head, planes = [], []
    for name, a in arrays.items():
        used = (int(a.view(f"u{a.itemsize}").max()).bit_length() + 7) // 8 if len(a) else 0
        head.append(f"{name} {a.dtype.str} {len(a)} {used}")
        planes.append(a.view(np.uint8).reshape(len(a), a.itemsize)[:, :used].T.tobytes())
    first = "\n".join(head).encode()
    return _codec()[0].compress(b"".join([len(first).to_bytes(4, "little"), first, *planes]))


def undump(body: bytes) -> dict[str, np.ndarray]:
    raw = _codec()[1].decompress(body)
    at = 4 + int.from_bytes(raw[:4], "little")
    out = {}
    for line in raw[4:at].decode().split("\n"):
        name, kind, n, used = line.split(" ")
        kind, n, used = np.dtype(kind), int(n), int(used)
        bits = np.zeros((n, kind.itemsize), np.uint8)
        bits[:, :used] = np.frombuffer(raw, np.uint8, n * used, at).reshape(used, n).T
        at += n * used
        out[name] = bits.reshape(-1).view(kind)
    return out


def _small(x: np.ndarray) -> np.ndarray:
    """Counts in as many bytes as the largest needs."""
    return x.astype(np.min_scalar_type(int(x.max())) if len(x) else np.uint8)


def _unique(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values, none negative, and the place of each of x among them: as np.unique, by a sort of values with their places in the low bits."""
    place, most = max(1, (len(x) - 1).bit_length()), int(x.max()).bit_length() if len(x) else 0
    keys = x.astype(U)
    if most + place > 64:  # high bits first; then what they are numbered by with the low ones
        low = 64 - 2 * place
        if low < 1:
            return np.unique(x, return_inverse=True)
        high, which = _unique(keys >> U(low))
        keys, which = _unique(which.astype(U) << U(low) | keys & U((1 << low) - 1))
        return (high[(keys >> U(low)).astype(np.int64)] << U(low) | keys & U((1 << low) - 1)).astype(x.dtype), which
    mask = U((1 << place) - 1)
    keys = keys << U(place) | np.arange(len(x), dtype=U)
    keys.sort()
    order = (keys & mask).astype(np.int64)
    keys >>= U(place)
    fresh = np.append(np.ones(min(1, len(x)), bool), keys[1:] != keys[:-1])
    which = np.empty(len(x), np.int64)
    which[order] = np.cumsum(fresh) - 1
    return keys[fresh].astype(x.dtype), which


def _spread(x: np.ndarray, values: int) -> np.ndarray:
    """A bijection of the numbers below a power of two of at least ``values``: spreads what lies close together, so that an Elias-Fano sequence is even."""
    return (x.astype(U) * ODD[0]) & U(_universe(values) - 1)


def _unspread(x: np.ndarray, values: int) -> np.ndarray:
    return ((x.astype(U) * U(pow(int(ODD[0]), -1, 1 << 64))) & U(_universe(values) - 1)).astype(np.int64)


def _universe(values: int) -> int:
    return 1 << max(1, (values - 1).bit_length())


def _gaps(x: np.ndarray) -> np.ndarray:
    return np.diff(x.astype(U), prepend=U(0))


def _rows(batches, *names: str):
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in names), strict=True)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "double": pa.float64()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[t]) for k, (_, t) in enumerate(fields)], [n for n, _ in fields])


# ---- pieces


PIECES = "piece long, path string, tokens long, learned long"


def _segments(batches, most: int):
    """(rows, raw, offsets, whether the last text ends here): texts of about ``most`` bytes; longer ones are cut after white space."""
    for batch in batches:
        for part in slices(batch, "text", most):
            raw, offs = text_offsets(part.column("text"))
            at = 0
            while part.num_rows == 1 and len(raw) - at > most:
                space = np.flatnonzero(SPACE[raw[at : at + most]])
                if len(space):
                    to = at + int(space[-1]) + 1
                else:  # a word of more than a segment
                    space = np.flatnonzero(SPACE[raw[at + most :]])
                    to = at + most + int(space[0]) + 1 if len(space) else len(raw)
                if to >= len(raw):
                    break
                yield part, raw[at:to], np.array([0, to - at]), False
                at = to
            yield (part, raw[at:], offs - at if part.num_rows > 1 else np.array([0, len(raw) - at]), True)


def _pieces(folder: str):
    """Writes pieces: of each text or part of one its row, doc_id, tokens and whether it is learned from; the tokens, as numbers into sorted hashes."""

    def run(batches):
        task = TaskContext.get()
        held, row, number, size, lead = [], task.partitionId() << 32, task.partitionId() << 20, 0, 0
        before = np.zeros(0, U)  # the last words of a text that goes on

        def write():
            h = np.concatenate([x[0] for x in held])
            words, local = _unique(h)
            row_, tokens, ids = (np.concatenate([x[k] for x in held]) for k in (1, 2, 3))
            path = f"{folder}/{number:012d}-{task.taskAttemptId()}.piece"
            fs, at = file_system(path)
            with fs.open_output_stream(f"{at}.dictionary", compression=None) as f:
                f.write(dump(words=_gaps(words)))
            with fs.open_output_stream(at, compression=None) as f:
                f.write(dump(size=np.array([len(words)]), local=local.astype(np.uint32), row=row_, tokens=tokens, doc_id=ids["id"].copy(), null=ids["null"].copy(), learned=ids["learned"].copy(), lead=np.array([lead])))
            learned = int(tokens[ids["learned"] > 0].sum()) - (lead if ids["learned"][0] else 0)
            return _batch([(number, path, len(h) - lead, learned)], PIECES)

        for part, raw, offs, ends in _segments(batches, SEGMENT):
            h, word_offs = word_hashes(raw, offs)
            n = len(offs) - 1
            own = np.repeat(np.arange(n), np.diff(word_offs))
            if ends:
                out = np.full(len(h) + n, END, U)
                out[np.arange(len(h)) + own] = h
                h = out
            ids, learned = part.column("doc_id"), part.column("learned")
            keys = np.zeros(n, [("id", np.int64), ("null", np.uint8), ("learned", np.uint8)])
            keys["id"], keys["null"], keys["learned"] = ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), learned.to_numpy(zero_copy_only=False)
            tokens = np.diff(word_offs) + int(ends)
            tail = np.zeros(0, U) if ends else np.concatenate([before, h])[-(ORDER_MOST - 1) :]
            if not held:
                lead = len(before)
                h = np.concatenate([before, h])
                tokens[0] += lead
            before = tail
            held.append((h, row + np.arange(n), tokens, keys))
            size += len(h)
            row += n if ends else 0
            if size >= PIECE:
                yield write()
                held, size, number = [], 0, number + 1
        if held:
            yield write()

    return run


class _Piece:
    """A piece; once its words are numbered (``_number``), its local numbers are in order of the words' numbers, those of unknown words last."""

    def __init__(self, path: str):
        x = self.read(path)
        self.size, self.local, self.tokens = int(x["size"][0]), x["local"].astype(np.int64), x["tokens"]
        self.lead = int(x["lead"][0])
        first = np.append(np.ones(min(1, len(x["row"])), bool), x["row"][1:] != x["row"][:-1])  # a long text has several entries
        self.own = np.repeat(np.cumsum(first) - 1, self.tokens)
        self.row, self.doc_id, self.null, self.learned = x["row"][first], x["doc_id"][first], x["null"][first].astype(bool), x["learned"][first].astype(bool)
        if "number" in x:
            self.number, self.count = x["number"].astype(np.int64) - 1, x["count"].astype(np.int64)
            self.known = int((self.number >= 0).sum())

    @staticmethod
    def read(path: str) -> dict[str, np.ndarray]:
        fs, at = file_system(path)
        with fs.open_input_file(at) as f:
            return undump(f.read())

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The n-grams of k words whose context is known, as keys; the tokens that end them."""
        bits, begin, n = self.size.bit_length(), max(self.lead, k - 1), len(self.local)
        if n <= begin:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        ok = self.own[begin:] == self.own[begin - k + 1 : n - k + 1]
        key = np.minimum(self.local[begin:], self.known)  # all unknown words are one
        for j in range(1, k):
            word = self.local[begin - j : n - j]
            key += word << j * bits
            if self.known < self.size:
                ok &= word < self.known
        at = np.flatnonzero(ok)
        return key[at], at + begin

    def dealt(self, k: int, distinct: np.ndarray, trie: Trie):
        """Of increasing keys: contexts and last words by their numbers, and parts."""
        bits = self.size.bit_length()
        low = (1 << bits) - 1
        number = np.append(self.number[: self.known], trie.words)
        last, rest = number[distinct & low], distinct >> bits
        ctx = number[rest] if k == 2 else number[rest >> bits] * (trie.words + 1) + number[rest & low]
        spread = mix(ctx.astype(U) * ODD[k])
        if len(trie.hot[k - 1][0]):
            is_hot = trie.heat(k, ctx)[0]
            spread[is_hot] = mix(spread[is_hot] + last[is_hot].astype(U) * ODD[0])
        return ctx, last, _word_part(spread, trie.parts[k - 1])


def make_pieces(docs: DataFrame, name: str, learned: Column | None = None) -> tuple[DataFrame, str]:
    """The pieces of docs (doc_id, text), and the folder that holds them. learned: of which texts n-grams are counted (all)."""
    spark = docs.sparkSession
    folder = fresh_dir(spark, name)
    fs, local = file_system(folder)
    fs.create_dir(local, recursive=True)
    learned = F.lit(True) if learned is None else F.coalesce(learned, F.lit(False))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), learned.alias("learned"))
    return stage(texts.mapInArrow(_pieces(folder), PIECES), "pieces"), folder


# ---- the trie


class Trie:
    """What is small: numbers of words and tokens, the parts' first word numbers, and for each level hot contexts (keys, counts, weights). files: of each level a table (part, path)."""

    def __init__(self, order: int, discount: float):
        self.order, self.discount, self.total, self.words = order, discount, 0, 0
        self.parts: list[int] = []
        self.firsts = np.zeros((64, 1), np.int64)  # the first number of each class of words and part
        none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        self.hot = [none] * order
        self.files: list[DataFrame] = []

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "files"}

    def base(self, counts: np.ndarray) -> np.ndarray:
        return (counts + 0.1) / (self.total + 0.1 * (self.words + 1))

    def heat(self, k: int, ctx: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which contexts of level k are hot, and the places of those in the table of hot ones."""
        hot = self.hot[k - 1][0]
        if not len(hot):
            return np.zeros(len(ctx), bool), np.zeros(0, np.int64)
        place = np.minimum(np.searchsorted(hot, ctx), len(hot) - 1)
        is_hot = hot[place] == ctx
        return is_hot, place[is_hot]


BLOCK = "part long, piece long, body binary"
BUILT = "kind long, part long, path string, entries long, total long, key long, value double"
ANSWERED = BUILT + ", piece long, body binary"
#: The kind of rows that are answers.
ANSWER = 3


def _tasks(n: int) -> int:
    return max(1, min(n, TASKS_MOST))


def _by(rows: DataFrame, n: int, *keys: str) -> DataFrame:
    """Rows of a first key together, in order of all."""
    return rows.repartition(_tasks(n), keys[0]).sortWithinPartitions(*keys)


def _word_part(h: np.ndarray, parts: int) -> np.ndarray:
    """Even ranges of hashes."""
    return ((h >> U(32)) * U(parts) >> U(32)).astype(np.int64)


def _send_words(parts: int, counted: bool):
    def run(batches):
        for number, path in _rows(batches, "piece", "path"):
            words = np.cumsum(_Piece.read(f"{path}.dictionary")["words"], dtype=U)
            if counted:
                p = _Piece(path)
                counts = np.bincount(p.local[p.lead :][p.learned[p.own[p.lead :]]], minlength=len(words))
                words, counts = words[counts > 0], counts[counts > 0]
            part = _word_part(words, parts)
            cuts = np.searchsorted(part, np.arange(parts + 1))
            out = []
            for s in np.flatnonzero(np.diff(cuts)):
                own = slice(cuts[s], cuts[s + 1])
                more = {"counts": _small(counts[own])} if counted else {}
                out.append((int(s), number, dump(words=_gaps(words[own]), **more)))
            yield _batch(out, BLOCK)

    return run


def _class(counts: np.ndarray) -> np.ndarray:
    """0 to 63, most frequent first."""
    return 63 - np.log2(np.maximum(counts, 1)).astype(np.int64)


def _ranks(counts: np.ndarray) -> np.ndarray:
    """Each word's place among those of its class."""
    kind = _class(counts)
    order = np.argsort(kind, kind="stable")
    out = np.empty(len(counts), np.int64)
    out[order] = np.arange(len(counts)) - np.searchsorted(kind[order], kind[order])
    return out


def _build_words(folder: str, hot: float):
    """Level 1, part by part; sizes of its classes; words of more than ``hot`` tokens by their ranks in their class."""

    def run(batches):
        for part, rows in groupby(_rows(batches, "part", "body"), lambda r: r[0]):
            held = [undump(r[1]) for r in rows]
            words, which = np.unique(np.concatenate([np.cumsum(x["words"], dtype=U) for x in held]), return_inverse=True)
            counts = np.bincount(which, np.concatenate([x["counts"] for x in held]), len(words)).astype(np.int64)
            first = int(words[0]) if len(words) else 0
            arrays, numbers = _put("words", EliasFano.build(words - U(first), max(1, int(words[-1]) - first + 1)))
            path = f"{folder}/words-{part:08d}-{TaskContext.get().taskAttemptId()}.lvl"
            save(path, arrays | {"counts": _small(counts), "ranks": _small(_ranks(counts))}, numbers | {"first": first})
            out = [(0, part, path, len(words), int(counts.sum()), None, None)]
            out += [(1, part, None, int(n), None, int(c), None) for c, n in enumerate(np.bincount(_class(counts))) if n]
            ranks = _ranks(counts)
            yield _batch(out + [(2, part, None, None, None, int(ranks[i]), float(counts[i])) for i in np.flatnonzero(counts > hot)], BUILT)

    return run


def _answered(batches, answer):
    """Rows sorted by part and piece, the part's path as piece -1 -> (part, piece, answer): answer(file, blocks) for some blocks of a part, one file open at a time."""
    for part, rows in groupby(_rows(batches, "part", "piece", "body"), lambda r: r[0]):
        x, held, size = None, [], 0
        for _, piece, body in rows:
            if piece < 0:
                x = load(body.decode())
                continue
            held.append((piece, undump(body)))
            size += len(next(iter(held[-1][1].values())))
            if size >= ASKED:
                yield _batch([(part, p, a) for (p, _), a in zip(held, answer(x, [b for _, b in held]), strict=True)], BLOCK)
                held, size = [], 0
        if held:
            yield _batch([(part, p, a) for (p, _), a in zip(held, answer(x, [b for _, b in held]), strict=True)], BLOCK)


def _answer_words(batches):
    """Of each word 1 + its rank in its class (0: unknown) and its count."""

    def one(x, block):
        h = np.cumsum(block["words"], dtype=U)
        if x is None or not x["words.n"]:
            return dump(rank=np.zeros(len(h), np.uint8), count=np.zeros(len(h), np.uint8))
        first = U(x["first"])
        place = np.where(h >= first, _get("words", x).find(np.where(h >= first, h - first, U(0))), -1)
        return dump(rank=_small(np.where(place >= 0, x["ranks"][place].astype(np.int64) + 1, 0)), count=_small(np.where(place >= 0, x["counts"][place], 0)))

    def answer(x, blocks):
        return [one(x, b) for b in blocks]

    return _answered(batches, answer)


def _number(folder: str, trie):
    """Rows sorted by piece and part, the piece's path as part -1 -> the piece written again with its words' numbers (+ 1; 0: unknown) and counts, its local numbers in their order."""

    def run(batches):
        for piece, rows in groupby(_rows(batches, "piece", "part", "body"), lambda r: r[0]):
            path, numbers, counts = None, [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for _, part, body in rows:
                if part < 0:
                    path = body.decode()
                    continue
                x = undump(body)
                rank, count = x["rank"].astype(np.int64), x["count"].astype(np.int64)
                numbers.append(np.where(rank > 0, rank + trie.value.firsts[_class(count), part], 0))
                counts.append(count)
            number, count = np.concatenate(numbers), np.concatenate(counts)
            order = np.argsort(number.astype(U) - U(1))
            back = np.empty(len(order), np.uint32)
            back[order] = np.arange(len(order))
            x = _Piece.read(path)
            x |= {"local": back[x["local"]], "number": _small(number[order]), "count": _small(count[order])}
            at = f"{folder}/{piece:012d}-{TaskContext.get().taskAttemptId()}.numbered"
            fs, local = file_system(at)
            with fs.open_output_stream(local, compression=None) as f:
                f.write(dump(**x))
            yield _batch([(piece, at)], "piece long, path string")

    return run


def _with_files(requests: DataFrame, files: DataFrame) -> DataFrame:
    return requests.unionByName(files.select("part", F.lit(-1).cast("long").alias("piece"), F.col("path").cast("binary").alias("body")))


def numbered(pieces: DataFrame, folder: str, trie: Trie, n: int) -> DataFrame:
    """(piece, path): pieces with the numbers of their words."""
    shared = pieces.sparkSession.sparkContext.broadcast(trie)
    asked = pieces.repartition(_tasks(n)).mapInArrow(_send_words(trie.parts[0], False), BLOCK)
    answers = _by(_with_files(asked, trie.files[0]), trie.parts[0], "part", "piece").mapInArrow(_answer_words, BLOCK)
    paths = pieces.select(F.lit(-1).cast("long").alias("part"), "piece", F.col("path").cast("binary").alias("body"))
    out = stage(_by(answers.unionByName(paths), n, "piece", "part").mapInArrow(_number(folder, shared), "piece long, path string"), "numbered")
    pieces.mapInArrow(_drop_first, "piece long").agg(F.count("piece")).first()
    return out


def _drop_first(batches):
    """Pieces with numbers stand for the first ones and their dictionaries from here on."""
    for number, path in _rows(batches, "piece", "path"):
        for first in (path, f"{path}.dictionary"):
            fs, at = file_system(first)
            if fs.get_file_info(at).type == pafs.FileType.File:
                fs.delete_file(at)
        yield _batch([(number,)], "piece long")


def _by_part(part: np.ndarray) -> np.ndarray:
    """The order of parts; within one as they are."""
    return np.argsort(part.astype(np.uint16) if len(part) and part.max() < 1 << 16 else part, kind="stable")


def _send_grams(k: int, trie, counted: bool, of_round: int, rounds: int):
    """Distinct n-grams of each piece to their parts; counted: with their counts in texts learned from, which may be 0."""

    def run(batches):
        for number, path in _rows(batches, "piece", "path"):
            p, t = _Piece(path), trie.value
            keys, at = p.grams(k)
            keys = np.sort(keys.astype(U) << U(1) | p.learned[p.own[at]])
            distinct = (keys >> U(1)).astype(np.int64)
            first = np.flatnonzero(np.append(np.ones(min(1, len(keys)), bool), distinct[1:] != distinct[:-1]))
            distinct = distinct[first]
            ctx, last, part = p.dealt(k, distinct, t)
            if counted:
                counts = np.diff(np.append(0, np.cumsum(keys & U(1), dtype=np.int64)[np.append(first, len(keys))[1:] - 1]))
            mine = np.flatnonzero(part % rounds == of_round) if rounds > 1 else np.arange(len(part))
            order = mine[_by_part(part[mine])]
            ctx, last, part = ctx[order], last[order], part[order]
            cuts = np.append(np.flatnonzero(np.diff(part, prepend=-1)), len(order))
            out = []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                more = {"counts": _small(counts[order[a:b]])} if counted else {}
                out.append((int(part[a]), number, dump(ctx=_gaps(ctx[a:b]), last=_small(last[a:b]), **more)))
            yield _batch(out, BLOCK)

    return run


def codebook(x: np.ndarray, codes: int = 256) -> np.ndarray:
    """All values of x if there are at most ``codes``; else their least, their greatest, and those at even ranks of x, then of what is left."""
    x = np.sort(x)
    distinct = x[np.append(True, x[1:] != x[:-1])] if len(x) else x
    if len(distinct) <= codes:
        return distinct
    book = np.unique(x[np.linspace(0, len(x) - 1, codes).astype(np.int64)])
    rest = np.setdiff1d(distinct, book, assume_unique=True)
    return np.union1d(book, rest[np.linspace(0, len(rest) - 1, min(len(rest), codes - len(book))).astype(np.int64)])


def _encode(book: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.searchsorted((book[1:] + book[:-1]) / 2, x).astype(np.uint8)


class _Grams:
    """The n-grams of some blocks of a part, together: contexts, spread and increasing; distinct keys, place of the context * wide + last word spread; which[j]: the key of the j-th."""

    def __init__(self, k: int, t: Trie, blocks: list[dict[str, np.ndarray]]):
        self.wide, self.all = _universe(t.words + 1), (t.words + 1) ** (k - 1)
        ctx = np.concatenate([np.zeros(0, U), *(np.cumsum(x["ctx"], dtype=U) for x in blocks)])
        self.ends = np.cumsum([len(x["ctx"]) for x in blocks], dtype=np.int64)
        fresh = np.append(np.ones(min(1, len(ctx)), bool), ctx[1:] != ctx[:-1])
        fresh[self.ends[:-1]] = True  # each block says what it has of its contexts
        self.fresh = np.flatnonzero(fresh)
        self.contexts, self.context = _unique(_spread(ctx[self.fresh], self.all))
        last = np.concatenate([np.zeros(0, np.int64), *(x["last"] for x in blocks)])
        above = np.repeat(self.context, np.diff(np.append(self.fresh, len(ctx))))
        self.keys, self.which = _unique(above * self.wide + _spread(last, t.words + 1).astype(np.int64))

    def answers(self, x: dict | None) -> list[bytes]:
        """For each block the codes of what a part's file has: of each n-gram 0 or 1 + that of its probability; of each run of a context 0 or 1 + that of its weight; and the values they stand for."""
        place, found = np.full(len(self.keys), -1, np.int64), np.full(len(self.contexts), -1, np.int64)
        if x is not None and len(self.keys):
            found = _get("contexts", x).find(self.contexts)
            there = np.maximum(found, 0)
            ends = [np.where(found >= 0, _get("pointers", x).get(there + j).astype(np.int64), 0) for j in (0, 1)] if x["contexts.n"] else [np.zeros(len(found), np.int64)] * 2
            above, last = self.keys // self.wide, self.keys % self.wide
            place = _get("children", x).find(there[above] * self.wide + last, ends[0][above], ends[1][above])
        out = [{} for _ in self.ends]
        for name, got, which, cuts in (("probs", place, self.which, self.ends[:-1]), ("backs", found, self.context, np.searchsorted(self.fresh, self.ends[:-1]))):
            codes, book = np.zeros(len(got), np.uint16), np.zeros(0)
            if x is not None and len(x[name]):
                codes, book = np.where(got >= 0, x[name][got].astype(np.uint16) + np.uint16(1), np.uint16(0)), x[f"{name}.book"]
            for o, own in zip(out, np.split(codes[which], cuts), strict=True):
                used = np.flatnonzero(np.bincount(own, minlength=1)[1:])  # 0 stands for none
                number = np.zeros(len(book) + 1, np.uint16)
                number[used + 1] = np.arange(1, len(used) + 1)
                o[name], o[f"{name}.book"] = _small(number[own]), book[used]
        return [dump(**o) for o in out]


def _build(k: int, trie, least: int, folder: str, next_hot: float, answered: bool):
    """Level k, part by part. Of a part's n-grams with hot contexts: what they take of each; and which n-grams of over next_hot tokens are hot contexts themselves. answered: each part's file is then asked for all that was sent to it."""

    def run(batches):
        t = trie.value
        for part, rows in groupby(_rows(batches, "part", "piece", "body"), lambda r: r[0]):
            pieces, held = [], []
            for _, piece, body in rows:
                pieces.append(piece)
                held.append(undump(body))
            g = _Grams(k, t, held)
            wide, contexts = g.wide, _unspread(g.contexts, g.all)
            counts = np.bincount(g.which, np.concatenate([x["counts"] for x in held]), len(g.keys)).astype(np.int64)
            del held
            above, last = g.keys // wide, g.keys % wide
            size = np.bincount(above, counts, len(contexts))
            is_hot, place = t.heat(k, contexts)
            size[is_hot] = t.hot[k - 1][1][place]
            out = []
            if k < t.order:
                out += [(2, part, None, None, None, int(contexts[above[i]] * (t.words + 1) + _unspread(last[i : i + 1], t.words + 1)[0]), float(counts[i])) for i in np.flatnonzero(counts > next_hot)]
            listed = counts >= least
            above, last, counts = above[listed], last[listed], counts[listed]
            p = (counts - t.discount) / size[above]
            used = np.bincount(above, p, len(contexts))
            out += [(1, part, None, None, None, int(contexts[i]), float(used[i])) for i in np.flatnonzero(is_hot & (used > 0))]
            live = np.flatnonzero(np.bincount(above, minlength=len(contexts)))
            above = np.cumsum(np.diff(above, prepend=-1) > 0) - 1
            logs, backs = np.log10(p), np.log10(np.maximum(1 - used[live], 1e-9))
            backs[is_hot[live]] = 0.0  # in the table of hot contexts
            arrays, numbers = {}, {}
            values = (g.contexts[live], _universe(g.all)), (np.searchsorted(above, np.arange(len(live) + 1)), len(above) + 1), (above * wide + last, max(1, len(live) * wide))
            for name, (v, universe) in zip(("contexts", "pointers", "children"), values, strict=True):
                a, b = _put(name, EliasFano.build(v, universe))
                arrays |= a
                numbers |= b
            for name, v in (("probs", logs), ("backs", backs)):
                book = codebook(v)
                arrays |= {f"{name}.book": book, name: _encode(book, v)}
            path = f"{folder}/order{k}-{part:08d}-{TaskContext.get().taskAttemptId()}.lvl"
            save(path, arrays, numbers)
            out.insert(0, (0, part, path, len(above), int(counts.sum()), None, None))
            yield _batch([(*r, None, None) for r in out], ANSWERED)
            if answered:
                del arrays, values, p, logs, above, last, counts
                yield _batch([(ANSWER, part, None, None, None, None, None, piece, body) for piece, body in zip(pieces, g.answers(load(path)), strict=True)], ANSWERED)

    return run


def _answer_grams(k: int, trie):
    """What the parts' files say of the n-grams asked for."""

    def run(batches):
        yield from _answered(batches, lambda x, blocks: _Grams(k, trie.value, blocks).answers(x))

    return run


def _collect_hot(built: DataFrame, kind: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys and summed values, in order of keys; at most one for each part's share of all tokens."""
    got = built.where(F.col("kind") == kind).groupBy("key").agg(F.sum("value").alias("value")).toPandas().sort_values("key")
    return got["key"].to_numpy(np.int64), got["value"].to_numpy(float)


def _learn(pieces: DataFrame, piece_folder: str, order: int, least: int, discount: float, answered: bool) -> tuple[Trie, DataFrame, DataFrame | None]:
    """A trie of what pieces have to be learned; the pieces with their words' numbers; answered: the answers to all their n-grams (level, part, piece, body), and no files of levels above 1 are left."""
    spark = pieces.sparkSession
    trie = Trie(order, discount)
    folder = fresh_dir(spark, "ngrams")
    fs, local = file_system(folder)
    fs.create_dir(local, recursive=True)
    n, tokens, learned = pieces.agg(F.count("*"), F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("learned"), F.lit(0))).first()
    trie.parts = [-(-max(1, tokens) // WORDS_PART), *[-(-max(1, tokens) // PART)] * (order - 1)]
    share = max(learned / trie.parts[-1], 1) if trie.parts[-1] > 1 else float("inf")
    sent = pieces.repartition(_tasks(n)).mapInArrow(_send_words(trie.parts[0], True), BLOCK)
    built = stage(_by(sent, trie.parts[0], "part", "piece").mapInArrow(_build_words(folder, share), BUILT), "words")
    trie.words, trie.total = built.where("kind = 0").agg(F.coalesce(F.sum("entries"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
    sizes = np.zeros((64, trie.parts[0]), np.int64)
    for r in built.where("kind = 1").select("key", "part", "entries").collect():  # at most 64 a part
        sizes[r["key"], r["part"]] = r["entries"]
    trie.firsts = (np.cumsum(sizes) - sizes.ravel()).reshape(sizes.shape)
    if trie.words >= 1 << 31:
        raise ValueError("more than 2**31 distinct words")
    trie.files.append(built.where("kind = 0").select("part", "path"))
    hot = sorted((int(trie.firsts[_class(np.array([r["value"]]))[0], r["part"]]) + r["key"], r["value"]) for r in built.where("kind = 2").select("part", "key", "value").collect())
    keys, counts = np.array([r[0] for r in hot], np.int64), np.array([r[1] for r in hot], float)
    free(spark)
    known, answers = numbered(pieces, piece_folder, trie, n), None
    for k in range(2, order + 1):
        trie.hot[k - 1] = (keys, counts, np.zeros(len(keys)))
        shared = spark.sparkContext.broadcast(trie)
        built = None
        for r in range(ROUNDS[k]):
            free(spark)
            sent = known.repartition(_tasks(n)).mapInArrow(_send_grams(k, shared, True, r, ROUNDS[k]), BLOCK)
            files = f"{folder}/order{k}-{r}"
            file_system(files)[0].create_dir(file_system(files)[1], recursive=True)
            made = stage(_by(sent, trie.parts[k - 1], "part", "piece").mapInArrow(_build(k, shared, least, files, share, answered), ANSWERED), "level")
            if answered:  # nothing more is asked of them
                drop_dir(files)
            built = made if built is None else built.unionByName(made)
        used_keys, used = _collect_hot(built, 1)
        back = np.zeros(len(keys))
        back[np.searchsorted(keys, used_keys)] = np.log10(np.maximum(1 - used, 1e-9))
        trie.hot[k - 1] = (keys, counts, back)
        if not answered:
            trie.files.append(built.where("kind = 0").select("part", "path"))
        keys, counts = _collect_hot(built, 2)
        if answered:
            more = built.where(F.col("kind") == ANSWER).select(F.lit(k).alias("level"), "part", "piece", "body")
            answers = more if answers is None else answers.unionByName(more)
    return trie, known, answers


def _order(order: int) -> int:
    if not 2 <= order <= ORDER_MOST:
        raise ValueError(f"order must be 2 to {ORDER_MOST}")
    return order


def train(docs: DataFrame, order: int = 3, least: int = 2, discount: float = 0.75) -> Trie:
    """A trie of the n-grams of docs (text, ...); null texts are empty ones, which have an end. order: 2 or 3. At most 2**31 distinct words."""
    order = _order(order)
    spark = docs.sparkSession
    prepare(spark)
    pieces, folder = make_pieces(docs.select(F.lit(0).alias("doc_id"), "text"), "train")
    trie = _learn(pieces, folder, order, least, discount, False)[0]
    drop_dir(folder)
    free(spark)
    return trie


# ---- scores


SCORES = "row long, doc_id long, n_tokens long, n_known long, base_score double, score double"


def _score(trie):
    """Rows sorted by piece, level and part, the piece's own file as level 0 -> sums of each text in a piece."""

    def one(p: _Piece, answers: dict[int, list[dict[str, np.ndarray]]]):
        t = trie.value
        base = t.base(p.count)
        prob = base[p.local]
        for k in range(2, t.order + 1):
            keys, at = p.grams(k)
            distinct, which = _unique(keys)
            ctx, _, part = p.dealt(k, distinct, t)
            order = _by_part(part)
            ctx, part, got = ctx[order], part[order], answers.pop(k, [])
            probs, backs = (np.concatenate([np.zeros(0), *(np.append(none, 10.0 ** x[f"{name}.book"])[x[name]] for x in got)]) for name, none in (("probs", 0.0), ("backs", 1.0)))
            fresh = np.append(np.ones(min(1, len(ctx)), bool), (ctx[1:] != ctx[:-1]) | (part[1:] != part[:-1]))
            is_hot, place = t.heat(k, ctx[fresh])
            backs[is_hot] = 10.0 ** t.hot[k - 1][2][place]
            own, back = np.empty(len(order)), np.empty(len(order))
            own[order], back[order] = probs, backs[np.cumsum(fresh) - 1]
            prob[at] = own[which] + back[which] * prob[at]
        scored = slice(p.lead, None)
        own, n = p.own[scored], len(p.row)
        sums = [np.bincount(own, x, minlength=n) for x in (np.ones(len(own)), p.local[scored] < p.known, np.log10(base)[p.local[scored]], np.log10(prob[scored]))]
        columns = [pa.array(p.row), pa.array(p.doc_id, mask=p.null), *(pa.array(x.astype(np.int64)) for x in sums[:2]), *map(pa.array, sums[2:])]
        return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in SCORES.split(", ")])

    def run(batches):
        for _, rows in groupby(_rows(batches, "piece", "level", "body"), lambda r: r[0]):
            p, answers = None, {}
            for _, level, body in rows:
                if level == 0:
                    p = _Piece(body.decode())
                else:
                    answers.setdefault(level, []).append(undump(body))
            yield one(p, answers)

    return run


def _scores(known: DataFrame, answers: DataFrame, trie: Trie) -> DataFrame:
    """The scores of texts by the answers to their pieces."""
    spark = known.sparkSession
    free(spark)
    shared = spark.sparkContext.broadcast(trie)
    paths = known.select(F.lit(0).alias("level"), F.lit(-1).cast("long").alias("part"), "piece", F.col("path").cast("binary").alias("body"))
    sums = _by(answers.unionByName(paths), known.count(), "piece", "level", "part").mapInArrow(_score(shared), SCORES)
    whole = sums.groupBy("row", "doc_id").agg(*(F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")))
    return whole.select("doc_id", "n_tokens", "n_known", F.lit(trie.total).cast("long").alias("train_tokens"), "base_score", "score")


def score(docs: DataFrame, trie: Trie) -> DataFrame:
    """docs (doc_id, text, ...) -> (doc_id, n_tokens, n_known, train_tokens, base_score, score), a row for each of docs.

    score: log10 probability of the whole text and its end; base_score: that by single words. Null text: empty. Null doc_ids and
    repeated rows: each row has its result. Other columns are ignored. A trie of no texts knows no word: N and V are 0.
    """
    spark = docs.sparkSession
    prepare(spark)
    pieces, folder = make_pieces(docs, "scored")
    n = pieces.count()
    known = numbered(pieces, folder, trie, n)
    shared, answers = spark.sparkContext.broadcast(trie), None
    for k in range(2, trie.order + 1):
        for r in range(ASKING[k]):
            free(spark)
            asked = known.repartition(_tasks(n)).mapInArrow(_send_grams(k, shared, False, r, ASKING[k]), BLOCK)
            files = trie.files[k - 1].where(F.col("part") % ASKING[k] == r)
            got = stage(_by(_with_files(asked, files), trie.parts[k - 1], "part", "piece").mapInArrow(_answer_grams(k, shared), BLOCK), "answers")
            got = got.select(F.lit(k).alias("level"), "part", "piece", "body")
            answers = got if answers is None else answers.unionByName(got)
    return _scores(known, answers, trie)


def train_and_score(docs: DataFrame, learned: Column, order: int = 3, least: int = 2, discount: float = 0.75) -> DataFrame:
    """As ``score(docs, train(docs.where(learned), ...))``, in one pass: texts are cut into pieces once, a piece's distinct n-grams are sent once, with
    their counts in texts learned from, and each part's file is asked for them as soon as it is written. For docs most of which are learned from: what
    is asked of a part is in memory with what is counted there."""
    order = _order(order)
    prepare(docs.sparkSession)
    pieces, folder = make_pieces(docs, "scored", learned)
    trie, known, answers = _learn(pieces, folder, order, least, discount, True)
    return _scores(known, answers, trie)
