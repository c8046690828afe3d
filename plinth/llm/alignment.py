"""Alignment of two tokenizers' tokens over the same bytes.

Tokens of A and B that share a byte are joined in a graph; its connected components, found by union-find, are exactly the smallest groups of tokens
that cover the same bytes. Members of a component are expanded to links: pairs whose byte ranges end together. How often each pair of ids is linked
is counted over the whole corpus, and each document's links are judged by these counts.

A space after a character that isn't white space begins a token of either tokenizer: byte-level BPE cuts there by its pattern, and the other one joins
nothing across it, as no entry of its vocabulary has a space after another character (else texts are encoded whole). So a text is cut there, and a
distinct piece is encoded and aligned once while a worker remembers it.
"""

from __future__ import annotations

import hashlib
import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import prepare, slices, stage
from .tokens import load

#: Pieces that a worker remembers, and bytes of their groups; characters of a text that are cut at a time.
REMEMBERED, REMEMBERED_BYTES, LONG = 400_000, 64 << 20, 4 << 20
#: Pieces that are encoded as one text.
RUN = 64
#: Pairs that each worker holds: the most frequent ones. All others are joined.
HOT = 1 << 18
PIECE = re.compile(r" \s*\S*(?:[^\S ]\s*\S*)*")
ODD = re.compile(r"\s ")
CUT = re.compile(r"(?<=\S) ")
ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, link_a array<int>, link_b array<int>, link_n array<int>"
NAMES = [x.split()[0] for x in ALIGNED.split(", ")]
KEPT = ["at", *NAMES[:6]]
_aligners: dict[tuple, Aligner] = {}


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def byte_alphabet() -> dict[str, int]:
    """The characters that byte-level vocabularies write bytes with: printable ones stand for themselves, the others follow from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def components(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte ends of tokens that cover the same bytes, none empty -> of each token of A and B the root of its component: the first token of A in it.

    Union-find on arrays: an edge for each two tokens that overlap; the larger root of an edge's ends is hung below the smaller one, then paths
    are halved until every token points at its root, until no edge has two.
    """
    n = len(ends_a)
    first = np.searchsorted(ends_b, np.append(0, ends_a[:-1])[:n], side="right")  # the tokens of B that each one of A overlaps
    last = np.searchsorted(ends_b, ends_a, side="left")
    size = last - first + 1
    a = np.repeat(np.arange(n), size)
    b = n + np.repeat(first - (np.cumsum(size) - size), size) + np.arange(len(a))
    root = np.arange(n + len(ends_b))
    while True:
        x, y = root[a], root[b]
        if (x == y).all():
            return root[:n], root[n:]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root != (up := root[root])).any():
            root = up


def expand_links(roots_a: np.ndarray, roots_b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(tokens of A, tokens of B): the pairs of members of one component whose ranges end together. No token is empty, so an end has one token of each."""
    at = np.minimum(np.searchsorted(ends_b, ends_a), max(0, len(ends_b) - 1))
    i = np.flatnonzero((ends_b[at] == ends_a) & (roots_b[at] == roots_a)) if len(ends_b) else np.zeros(0, np.int64)
    return i, at[i]


class Aligner:
    """Pieces that are remembered have a number each: their counts of tokens and groups, their groups as text, and their links as a << 32 | b."""

    def __init__(self, definition_a: str, model_b: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(definition_a)
        self.a.encode_special_tokens = True
        alphabet, entries = byte_alphabet(), self.a.get_vocab()
        self.bytes_a = [b""] * (1 + max(entries.values()))
        for t, i in entries.items():
            self.bytes_a[i] = bytes(alphabet[c] for c in t) if all(c in alphabet for c in t) else t.encode()
        self.b = SentencePieceProcessor(model_proto=model_b)
        vocabulary = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("\u2581", " ").encode() for i, p in enumerate(vocabulary)]
        self.space = self.b.piece_to_id("\u2581")
        self.separable = not any("\u2581" in p.lstrip("\u2581") for p in vocabulary)
        self.len_a, self.len_b = (np.array(list(map(len, x)), np.int64) for x in (self.bytes_a, self.bytes_b))
        ended = lambda n, mark: np.array([f"{i}{mark}" for i in range(n)], object)
        self.text_a, self.text_b = [ended(len(self.bytes_a), m) for m in ",|"], [ended(len(vocabulary), m) for m in ",;\n"]
        self.forget()

    def forget(self) -> None:
        self.at: dict[str, int] = {}
        self.ok, self.groups, self.size = [], [], 0
        self.sums, self.link_at, self.links = np.zeros((0, 3), np.int64), np.zeros(1, np.int64), np.zeros(0, np.int64)

    def encode(self, runs: list[list[str]]):
        """(run, bytes of its text, ids by A, ids by B) of runs of pieces, each encoded as one text; ids are None where they don't give the bytes back."""
        texts = [" ".join(r) for r in runs]
        ids_a = self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)
        for r, t, x, y in zip(runs, texts, ids_a, self.b.encode(texts, num_threads=1), strict=True):
            x, y, want = x.ids, y if t else [self.space], (" " + t).encode()
            same = b"".join(map(self.bytes_a.__getitem__, x)) == want == b"".join(map(self.bytes_b.__getitem__, y))
            yield (r, want, x, y) if same else (r, want, None, None)

    def align(self, pieces: list[str]) -> list[str]:
        """Numbers the pieces, each given without the space that it begins with, from len(self.ok) on; returns them in the order of their numbers.

        Pieces that don't end with white space are encoded RUN at a time as one text; where that text isn't given back, they are encoded alone.
        """
        solid = [p for p in pieces if p and not p[-1].isspace()]
        alone = [[p] for p in pieces if not p or p[-1].isspace()]
        good, bad = [], []
        for r, want, x, y in self.encode([solid[k : k + RUN] for k in range(0, len(solid), RUN)]):
            if x is not None:
                good.append((r, want, x, y))
            else:
                alone += [[p] for p in r]
        for r, want, x, y in self.encode(alone):
            if x is None:
                bad += r
            else:
                good.append((r, want, x, y))
        done = [p for r, *_ in good for p in r]
        sizes = np.array([len(p.encode()) + 1 for p in done], np.int64)
        self._add(sizes, np.array([i for _, _, x, _ in good for i in x], np.int64), np.array([i for *_, y in good for i in y], np.int64))
        self.ok += [True] * len(done) + [False] * len(bad)
        self.groups += [b""] * len(bad)
        self.sums = np.concatenate([self.sums, np.zeros((len(bad), 3), np.int64)])
        self.link_at = np.concatenate([self.link_at, np.full(len(bad), self.link_at[-1])])
        return done + bad

    def _add(self, sizes: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
        """Pieces of so many bytes, and the ids of all of them together."""
        n, to = len(sizes), np.cumsum(sizes)
        ends_a, ends_b = np.cumsum(self.len_a[a]), np.cumsum(self.len_b[b])
        roots_a, roots_b = components(ends_a, ends_b)
        of_a, of_b = np.searchsorted(to, ends_a), np.searchsorted(to, ends_b)  # the piece of each token
        opens = np.append(True, np.diff(roots_a) > 0)[: len(a)]
        group_a = np.cumsum(opens) - 1
        group_b = np.searchsorted(roots_a[opens], roots_b)
        last_a, last_b = np.append(np.diff(group_a) > 0, True)[: len(a)], np.append(np.diff(group_b) > 0, True)[: len(b)]
        some_a, some_b = np.bincount(group_a), np.bincount(group_b)
        parts = np.empty(len(a) + len(b), object)
        parts[np.arange(len(a)) + (np.cumsum(some_b) - some_b)[group_a]] = np.where(last_a, self.text_a[1][a], self.text_a[0][a])
        ends_piece = np.append(np.diff(of_b) > 0, True)[: len(b)]
        parts[np.arange(len(b)) + np.cumsum(some_a)[group_b]] = np.where(ends_piece, self.text_b[2][b], np.where(last_b, self.text_b[1][b], self.text_b[0][b]))
        texts = "".join(parts.tolist()).encode().split(b"\n")[:-1]
        i, j = expand_links(roots_a, roots_b, ends_a, ends_b)
        self.groups += texts
        self.size += sum(map(len, texts))
        self.sums = np.concatenate([self.sums, np.stack([np.bincount(x, minlength=n) for x in (of_a, of_b, of_a[opens])], axis=1)])
        self.link_at = np.concatenate([self.link_at, self.link_at[-1] + np.cumsum(np.bincount(of_a[i], minlength=n))])
        self.links = np.concatenate([self.links, a[i] << 32 | b[j]])

    def numbers(self, pieces: list[str]) -> np.ndarray:
        new = list(dict.fromkeys(p for p in pieces if p not in self.at))
        if new:
            first = len(self.ok)
            self.at |= {p: first + k for k, p in enumerate(self.align(new))}
        return np.fromiter(map(self.at.__getitem__, pieces), np.int64, len(pieces))

    def documents(self, texts: list[str | None]) -> list[np.ndarray]:
        """Numbers of the pieces of each text in order; none for a text without tokens."""
        if self.separable:
            cut = [pieces(t) if t and len(t) <= LONG else [] for t in texts]
            out = np.split(self.numbers([p for x in cut for p in x]), np.cumsum([len(x) for x in cut])[:-1])
            for k, t in enumerate(texts):
                if t and len(t) > LONG:
                    out[k] = np.concatenate([self.numbers(pieces(c)) for c in chunks(t)])
        else:
            out = [np.zeros(0, np.int64)] * len(texts)
        ok = np.array(self.ok, bool)
        for k, t in enumerate(texts):
            if t and not (self.separable and ok[out[k]].all()):
                self.align([t])  # as the whole may make up for what a piece lacks
                out[k] = np.array([len(self.ok) - 1]) if self.ok[-1] else np.zeros(0, np.int64)
        return out

    def batch(self, part: pa.RecordBatch, with_groups: bool) -> pa.RecordBatch:
        """A slice of doc_id and text -> ALIGNED."""
        if len(self.ok) > REMEMBERED or self.size > REMEMBERED_BYTES:
            self.forget()
        docs = self.documents(part.column("text").to_pylist())
        which, offs = np.concatenate([*docs, np.zeros(0, np.int64)]), np.append(0, np.cumsum([len(d) for d in docs], dtype=np.int64))
        totals = np.concatenate([np.zeros((1, 3), np.int64), np.cumsum(self.sums[which], axis=0)])
        totals = totals[offs[1:]] - totals[offs[:-1]]
        n = self.link_at[which + 1] - self.link_at[which]
        to = np.cumsum(n)
        links = self.links[np.repeat(self.link_at[which] - (to - n), n) + np.arange(to[-1] if len(to) else 0)]
        of = np.repeat(np.repeat(np.arange(len(docs)), np.diff(offs)), n)
        pairs, links = np.unique(links, return_inverse=True)
        key, times = np.unique(of * max(1, len(pairs)) + links, return_counts=True)
        of, links = np.divmod(key, max(1, len(pairs)))
        pairs = pairs[links]
        cuts = pa.array(np.searchsorted(of, np.arange(len(docs) + 1)).astype(np.int32))
        n_links = np.bincount(of, times, len(docs)).astype(np.int64)
        sums, texts = [], []
        for d in docs:
            digest = hashlib.sha256()
            for at in range(0, len(d), 100_000):
                digest.update((b";" if at else b"") + b";".join(map(self.groups.__getitem__, d[at : at + 100_000].tolist())))
            sums.append(digest.hexdigest() if len(d) else "")
            if with_groups:
                texts.append(b";".join(map(self.groups.__getitem__, d.tolist())).decode())
        lists = [pa.ListArray.from_arrays(cuts, pa.array(x.astype(np.int32))) for x in (pairs >> 32, pairs & 0xFFFFFFFF, times)]
        columns = [part.column("doc_id"), *map(pa.array, totals.T.copy()), pa.array(n_links), pa.array(sums, pa.string()), *lists]
        return pa.RecordBatch.from_arrays(columns + [pa.array(texts, pa.string())] * with_groups, NAMES + ["groups"] * with_groups)


def chunks(text: str):
    """Consecutive parts of a long text, cut at spaces that a piece begins with, which are left out."""
    at = 0
    while len(text) - at > LONG and (cut := CUT.search(text, at + LONG)):
        yield text[at : cut.start()]
        at = cut.end()
    yield text[at:]


def pieces(text: str) -> list[str]:
    """What stands between cuts of space + text, each without the space that it begins with."""
    return [p[1:] for p in PIECE.findall(" " + text)] if text[:1].isspace() or ODD.search(text) else text.split(" ")


def aligner(definition_a: str, model_b: bytes) -> Aligner:
    """One for each worker process and pair of tokenizers."""
    key = (hash(definition_a), hash(model_b))
    if key not in _aligners:
        _aligners.clear()
        _aligners[key] = Aligner(definition_a, model_b)
    return _aligners[key]


def align_documents(docs: DataFrame, path_a: str, path_b: str, with_groups: bool = False) -> DataFrame:
    """docs (doc_id, text, ...) -> ALIGNED, and groups, as text, where asked for: a row for each row of docs.

    Of space + text by A (a byte-level definition) and of text by B (a model that puts a space before it). Strings of special tokens are ordinary text.
    A text that is null or empty, or that either tokenizer doesn't give back byte for byte, has zeros, no links and an empty sum. link_n: how often a
    pair of ids is linked in the text. Other columns are ignored; null doc_ids and repeated rows stand for themselves.
    """
    spark = docs.sparkSession
    prepare(spark)
    with open(path_b, "rb") as f:
        shared = spark.sparkContext.broadcast((load(path_a), f.read()))

    def run(batches):
        own = aligner(*shared.value)
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                yield own.batch(part, with_groups)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, ALIGNED + ", groups string" * with_groups)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(a, b, n, best) of all pairs of ids that are linked: n times in the corpus; best: no other id of A is linked to b more often."""
    pairs = aligned.select(F.inline(F.arrays_zip("link_a", "link_b", "link_n"))).groupBy(F.col("link_a").alias("a"), F.col("link_b").alias("b")).agg(F.sum("link_n").alias("n"))
    return pairs.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy("b")))


def _judge(shared):
    def run(batches):
        key, count, best = shared.value
        for batch in batches:
            a, b, n = (batch.column(x) for x in ("link_a", "link_b", "link_n"))
            offs = np.asarray(a.offsets).astype(np.int64)
            a, b, n = (np.asarray(x.values)[offs[0] : offs[-1]].astype(np.int64) for x in (a, b, n))
            offs -= offs[0]
            asked = a << 32 | b
            at = np.minimum(np.searchsorted(key, asked), max(0, len(key) - 1))
            hit = key[at] == asked if len(key) else np.zeros(len(asked), bool)
            out = []
            for x in (np.where(hit & best[at], n, 0), np.where(hit, n * count[at], 0)) if len(key) else (np.zeros(len(n), np.int64),) * 2:
                sums = np.append(0, np.cumsum(x))
                out.append(pa.array(sums[offs[1:]] - sums[offs[:-1]]))
            left = pa.array(np.append(0, np.cumsum(~hit))[offs].astype(np.int32))
            lists = [pa.ListArray.from_arrays(left, pa.array(x[~hit].astype(np.int32))) for x in (a, b, n)]
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in KEPT), *out, *lists], [*KEPT, "n_best", "count_sum", "cold_a", "cold_b", "cold_n"])

    return run


def judge_links(aligned: DataFrame, pairs: DataFrame, hot: int = HOT) -> DataFrame:
    """aligned (a stable table of ALIGNED and at, which tells rows apart), pairs -> (KEPT, n_best, count_sum).

    n_best: links whose count is the highest of their b; count_sum: the sum of counts over links. The ``hot`` most frequent pairs are broadcast; links
    of all others, each at most one in ``hot`` of all links, are joined with their pairs.
    """
    spark = aligned.sparkSession
    top = pairs.orderBy(F.desc("n"), "a", "b").limit(hot).toPandas()
    key = top["a"].to_numpy(np.int64) << 32 | top["b"].to_numpy(np.int64)
    order = np.argsort(key)
    shared = spark.sparkContext.broadcast((key[order], top["n"].to_numpy(np.int64)[order], top["best"].to_numpy(bool)[order]))
    kinds = ", ".join(f"{c} {aligned.schema[c].dataType.simpleString()}" for c in KEPT)
    judged = stage(aligned.select(*KEPT, "link_a", "link_b", "link_n").mapInArrow(_judge(shared), f"{kinds}, n_best long, count_sum long, cold_a array<int>, cold_b array<int>, cold_n array<int>"), "judged")
    cold = judged.where(F.size("cold_a") > 0).select("at", F.inline(F.arrays_zip(F.col("cold_a").alias("a"), F.col("cold_b").alias("b"), F.col("cold_n").alias("k"))))
    more = cold.join(pairs, ["a", "b"]).groupBy("at").agg(F.sum(F.when(F.col("best"), F.col("k")).otherwise(0)).alias("more_best"), F.sum(F.col("k") * F.col("n")).alias("more_sum"))
    both = judged.join(more, "at", "left")
    return both.select(*KEPT, *((F.col(x) + F.coalesce(y, F.lit(0))).alias(x) for x, y in (("n_best", "more_best"), ("count_sum", "more_sum"))))


def aligned_documents(docs: DataFrame, path_a: str, path_b: str, hot: int = HOT) -> DataFrame:
    """docs (doc_id, text, ...) -> (doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum), a row for each row of docs; see align_documents and judge_links. An empty table gives no rows."""
    aligned = stage(align_documents(docs, path_a, path_b).withColumn("at", F.monotonically_increasing_id()), "aligned")
    pairs = stage(pair_counts(aligned), "pairs")
    return judge_links(aligned, pairs, hot).drop("at")
