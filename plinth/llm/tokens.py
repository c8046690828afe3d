"""Token ids of whole texts by a public tokenizer file, each distinct piece of text encoded once while it is remembered.

A byte-level pre-tokenizer always cuts before a word's space, within white space as below, and between a letter and the
punctuation that ends a word. Pieces between such cuts can be encoded alone: together they give the ids of the whole.
Texts with white space beyond ASCII, and tokenizers of other kinds, are encoded whole.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa

from .shared import slices, text_offsets
from .words import ODD, U, mix, powers, word_bounds

REMEMBERED = 1_000_000
LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123)]] = True
MARK = np.zeros(256, bool)
MARK[list(b".,;:!?|#$%&*)")] = True
_encoders: dict[int, Encoder] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def load(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def piece_starts(raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Where pieces begin, for texts whose white space is space and 0x09-0x0D only."""
    starts, ends, _ = word_bounds(raw, offs)
    cut = np.zeros(len(raw) + 1, bool)
    cut[offs] = True
    cut[ends] = True
    cut[starts] = True
    own = ~np.isin(starts, offs, assume_unique=False) if len(starts) else np.zeros(0, bool)
    before = starts[own] - 1  # a white space of the same text: the last of its run stands alone or, if a space, with the word
    cut[before] = True
    cut[starts[own][raw[before] == 32]] = False
    if len(ends):
        at = np.arange(len(raw), dtype=np.int32)
        tail = np.maximum.accumulate(np.where(MARK[raw], -1, at))[ends - 1] + 1  # where the marks that end a word begin
        tail, first = tail[tail < ends], starts[tail < ends]
        ok = tail > first
        tail, last = tail[ok], raw[tail[ok] - 1]
        latin = (tail - 2 >= first[ok]) & (raw[np.maximum(tail - 2, 0)] == 0xC3) & (last >= 0x80) & (last != 0x97) & (last != 0xB7)
        cut[tail[LETTER[last] | latin]] = True
    return np.flatnonzero(cut[:-1])


def unsure(raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Of each text: whether it holds what Unicode or Python take for white space, beyond ASCII's."""
    a = raw
    b = np.append(raw[1:], np.uint8(0)) if len(raw) else raw
    hit = (a >= 0x1C) & (a <= 0x1F)
    at = np.flatnonzero((a == 0xC2) & ((b == 0x85) | (b == 0xA0)) | (a == 0xE1) & (b == 0x9A) | (a == 0xE2) & ((b == 0x80) | (b == 0x81)) | (a == 0xE3) & (b == 0x80))
    if len(at):
        third = raw[np.minimum(at + 2, len(raw) - 1)]
        plain = (a[at] == 0xE2) & (b[at] == 0x80) & (third > 0x8A) & ~np.isin(third, (0xA8, 0xA9, 0xAF)) | (a[at] == 0xE2) & (b[at] == 0x81) & (third != 0x9F) | (a[at] == 0xE3) & (third != 0x80)
        hit[at[~plain]] = True
    return np.diff(np.searchsorted(np.flatnonzero(hit), offs)) > 0


class Encoder:
    """Strings of special tokens are ordinary text."""

    def __init__(self, definition: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.encode_special_tokens = True
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        kind = json.loads(definition)
        pre = kind.get("pre_tokenizer") or {}
        self.by_pieces = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not kind.get("normalizer") and all(t["special"] for t in kind.get("added_tokens", []))
        self.forget()

    def forget(self) -> None:
        self.known, self.at, self.size, self.pool = np.zeros(0, U), np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, self.dtype)

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.dtype) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, hashes: np.ndarray, pieces: list[bytes]) -> None:
        if len(self.known) + len(hashes) > REMEMBERED:
            self.forget()
        got = self.whole([p.decode() for p in pieces])
        size = np.array([len(g) for g in got], np.int32)
        at = (len(self.pool) + np.cumsum(size, dtype=np.int64) - size).astype(np.int32)
        self.pool = np.concatenate([self.pool, *got])
        known = np.concatenate([self.known, hashes])
        order = np.argsort(known, kind="stable")
        self.known, self.at, self.size = known[order], np.concatenate([self.at, at])[order], np.concatenate([self.size, size])[order]

    def encode(self, raw: np.ndarray, offs: np.ndarray) -> list[np.ndarray]:
        """The ids of each text."""
        if not len(raw):
            return [np.zeros(0, self.dtype)] * (len(offs) - 1)
        odd = unsure(raw, offs) if self.by_pieces else np.ones(len(offs) - 1, bool)
        if odd.all():
            return self.whole([raw[a:b].tobytes().decode() for a, b in zip(offs[:-1], offs[1:], strict=True)])
        starts = piece_starts(raw, offs)
        ends = np.append(starts[1:], len(raw))
        up, down = powers(len(raw) + 1)
        sums = np.zeros(len(raw) + 1, U)
        np.cumsum((raw.astype(U) + U(1)) * up[: len(raw)], out=sums[1:])
        h = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U) * ODD[1])
        distinct, first, which = np.unique(h, return_index=True, return_inverse=True)
        for _ in range(2):
            place = np.minimum(np.searchsorted(self.known, distinct), max(0, len(self.known) - 1))
            new = self.known[place] != distinct if len(self.known) else np.ones(len(distinct), bool)
            if not new.any():
                break
            if len(self.known) + int(new.sum()) > REMEMBERED:
                new[:] = True  # what is remembered goes, so all are learnt anew
            self.learn(distinct[new], [raw[starts[i] : ends[i]].tobytes() for i in first[new]])
        place = place[which]
        size = self.size[place]
        stop = np.cumsum(size, dtype=np.int64)
        ids = self.pool[np.repeat(self.at[place] - (stop - size), size) + np.arange(stop[-1])]
        cuts = np.concatenate([[0], stop])[np.searchsorted(starts, offs)]
        out = [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        for k in np.flatnonzero(odd):
            out[k] = self.whole([raw[offs[k] : offs[k + 1]].tobytes().decode()])[0]
        return out

    def batch(self, batch: pa.RecordBatch, column: str = "text"):
        """(slice of the batch, ids of each of its texts), null texts as empty ones."""
        for part in slices(batch, column, 1 << 20):
            yield part, self.encode(*text_offsets(part.column(column)))


def encoder(definition: str) -> Encoder:
    """One for each worker process and definition."""
    key = hash(definition)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(definition)
    return _encoders[key]
