"""CRC-32C of many byte strings at a time in numpy, and its masked form."""

from __future__ import annotations

import numpy as np

BLOCK = 256
POLY = 0x82F63B78


def _tables() -> np.ndarray:
    t = np.zeros((8, 256), np.uint32)
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(POLY), c >> 1)
    t[0] = c
    for k in range(1, 8):
        t[k] = t[0][t[k - 1] & 255] ^ (t[k - 1] >> 8)
    return t


T = _tables()


def _apply(m: np.ndarray, x: np.ndarray) -> np.ndarray:
    """A linear map of 32 bits, given as four tables."""
    return m[0][x & 255] ^ m[1][(x >> 8) & 255] ^ m[2][(x >> 16) & 255] ^ m[3][x >> 24]


def _shifts() -> list[np.ndarray]:
    """_shifts()[k] appends 2**k zero bytes."""
    x = np.arange(256, dtype=np.uint32)[None, :] << np.array([0, 8, 16, 24], np.uint32)[:, None]
    out = [(T[0][x & 255] ^ (x >> 8)).astype(np.uint32)]
    for _ in range(39):
        out.append(_apply(out[-1], out[-1]))
    return out


SHIFT = _shifts()


def crc32c(items: list[bytes]) -> np.ndarray:
    sizes = np.array([len(x) for x in items], np.int64)
    blocks = -(-sizes // BLOCK)
    ends = np.cumsum(blocks)
    raw = np.zeros(int(ends[-1]) * BLOCK if len(items) else 0, np.uint8)
    for x, end in zip(items, ends * BLOCK, strict=True):  # zero bytes in front don't change a remainder that begins at 0
        raw[end - len(x) : end] = np.frombuffer(x, np.uint8)
    words = raw.view("<u8").reshape(-1, BLOCK // 8)
    state = np.zeros(len(words), np.uint64)
    for j in range(BLOCK // 8):
        x = words[:, j] ^ state
        state = np.zeros(len(words), np.uint32)
        for k in range(8):
            state ^= T[7 - k][(x >> np.uint64(8 * k)) & np.uint64(255)]
        state = state.astype(np.uint64)
    part = state.astype(np.uint32)
    out = np.zeros(len(items), np.uint32)
    order = np.argsort(-blocks, kind="stable")
    first = (ends - blocks)[order]
    for k in range(int(blocks.max(initial=0))):
        n = int(np.searchsorted(-blocks[order], -k, side="left"))  # those with more than k blocks
        out[order[:n]] = _apply(SHIFT[8], out[order[:n]]) ^ part[first[:n] + k]
    seed = np.full(len(items), 0xFFFFFFFF, np.uint32)
    for k in range(int(sizes.max(initial=0)).bit_length()):
        on = (sizes >> k) & 1 == 1
        seed[on] = _apply(SHIFT[k], seed[on])
    return out ^ seed ^ np.uint32(0xFFFFFFFF)


def masked(items: list[bytes]) -> np.ndarray:
    """Rotated and offset, so that a checksum of data that holds checksums stays sound."""
    c = crc32c(items)
    return ((c >> 15) | (c << 17)) + np.uint32(0xA282EAD8)
