"""Parts without Spark, against plain versions."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from plinth.llm import crc32c, decontamination, elias_fano, jaccard_join, packing, tokens, topk, urls, warc, words
from plinth.llm.shared import text_offsets

TEXTS = [None, "", " ", "a", "A b\tc\n d", "é ß — Ünï", "x" * 50_000, "one two three four five", " lead", "trail ", "a b"]
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_words_equal_the_pattern():
    h, before = words.word_hashes(*text_offsets(pa.array(TEXTS, pa.string())))
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    seen = {}
    for k, t in enumerate(TEXTS):
        own = WORD.findall((t or "").translate(low))
        assert before[k + 1] - before[k] == len(own)
        for w, x in zip(own, h[before[k] : before[k + 1]].tolist(), strict=True):
            assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)


def test_shingles_of_short_texts():
    sets = words.shingle_sets(*words.word_hashes(*text_offsets(pa.array(["", "a b", "b a", "a b c d a b c d", None], pa.string()))), 4)
    assert [len(s) for s in sets] == [0, 1, 1, 4, 0]
    assert sets[1][0] != sets[2][0]


def test_crc32c():
    def plain(data):
        c = 0xFFFFFFFF
        for x in data:
            c ^= x
            for _ in range(8):
                c = (c >> 1) ^ crc32c.POLY if c & 1 else c >> 1
        return c ^ 0xFFFFFFFF

    items = [random.Random(n).randbytes(n) for n in (0, 1, 8, 255, 256, 257, 700)]
    assert crc32c.crc32c(items).tolist() == list(map(plain, items))
    assert crc32c.crc32c([b"123456789"])[0] == 0xE3069283
    assert crc32c.crc32c([]).tolist() == []


def test_tokens_by_pieces_equal_the_whole():
    enc = tokens.Encoder(tokens.load(tokens.default_path()))
    assert enc.by_pieces
    rng = random.Random(3)
    odd = ["don't, it's. x² é. ×. 12, 3.", "a b  c", "<|endoftext|> x", "“q” ‘z’. …", "\n\na  b\t\nc \n", "é́ \x1c a"]
    texts = [t or "" for t in TEXTS] + odd + ["".join(rng.choice(" \n\ta1'.é,#　\x1c") for _ in range(rng.randint(1, 30))) for _ in range(300)]
    for _ in range(2):  # learnt, then remembered
        got = enc.encode(*text_offsets(pa.array(texts, pa.string())))
        assert [g.tolist() for g in got] == [enc.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_first_fit_decreasing_and_filling():
    rng = random.Random(5)
    for _ in range(100):
        lengths = [rng.randint(1, 100) for _ in range(rng.randint(0, 40))]
        bins = []
        for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
            for b in bins:
                if sum(lengths[j] for j in b) + lengths[i] <= 100:
                    b.append(i)
                    break
            else:
                bins.append([i])
        assert (packing.first_fit_decreasing(lengths, 100) if lengths else []) == bins
    for size in (8, 16):
        for _ in range(300):
            lengths = [rng.randint(1, 3 * size) for _ in range(rng.randint(0, 30))]
            packed = packing.pack(lengths, size)
            assert sorted((i, a + k) for b in packed for i, a, n in b for k in range(n)) == [(i, k) for i, n in enumerate(lengths) for k in range(n)]
            assert all(n == size or n & (n - 1) == 0 for n in (sum(p[2] for p in b) for b in packed))


def test_elias_fano():
    rng = np.random.default_rng(1)
    for _ in range(60):
        universe = int(rng.choice([300, 10**6, 1 << 40, 1 << 64]))
        v = np.sort(rng.integers(0, universe - 1, int(rng.integers(0, 200)), dtype=np.uint64, endpoint=True))
        e = elias_fano.EliasFano.build(v, universe)
        assert (e.get(np.arange(len(v))) == v).all() if len(v) else True
        x = np.concatenate([v, rng.integers(0, universe - 1, 50, dtype=np.uint64, endpoint=True)])
        assert (e.successor(x) == np.searchsorted(v, x)).all()
        b = rng.integers(0, len(v) + 1, len(x))
        c = np.minimum(len(v), b + rng.integers(0, 9, len(x)))
        assert (e.successor(x, b, c) == [i + np.searchsorted(v[i:j], k) for k, i, j in zip(x, b, c, strict=True)]).all()


def test_elias_fano_finds_all_of_a_full_word():
    """Over 63 values with the same high part, the first at the begin of a word of the high bits."""
    v = 64 * 1024 + np.arange(300)
    e = elias_fano.EliasFano.build(v, 300 << 10)
    assert e.low_bits == 10
    for some in (v, v[100:110]):  # by the whole directory, and by a search for each
        assert (e.find(some) == some - v[0]).all() and (e.get(some - v[0]) == some.astype(np.uint64)).all()


def test_alignment_equals_the_textbook():
    def plain(x, y):
        h, best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)], 0
        for i in range(1, len(x) + 1):
            for j in range(1, len(y) + 1):
                h[i][j] = max(0, h[i - 1][j - 1] + (1 if x[i - 1] == y[j - 1] else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
                best = max(best, h[i][j])
        return best

    rng = random.Random(2)
    x, y = ([np.array([rng.randint(5, 9) for _ in range(rng.randint(1, n))], np.uint64) for _ in range(200)] for n in (20, 12))
    best, first, last = decontamination.align(x, y)
    assert best.tolist() == [plain(a, b) for a, b in zip(x, y, strict=True)]
    assert all(plain(a[f:t], b) == s for a, b, s, f, t in zip(x, y, best, first, last, strict=True) if s)


def test_tiles_find_all_components():
    rng = np.random.default_rng(4)
    base = [np.unique(rng.integers(0, 1 << 63, 60).astype(np.uint64)) for _ in range(6)]
    sets = [np.unique(np.where(rng.random(len(b)) < 0.05, rng.integers(0, 1 << 63, len(b)).astype(np.uint64), b)) for b in base * 12]
    label = list(range(len(sets)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    want = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            c = len(np.intersect1d(sets[i], sets[j]))
            if 100 * c >= 80 * (len(sets[i]) + len(sets[j]) - c):
                a, b = root(i), root(j)
                label[max(a, b)] = min(a, b)
    want = [root(i) for i in range(len(sets))]
    label = list(range(len(sets)))
    for i, j in jaccard_join.tile_links(sets, 80):
        a, b = root(i), root(j)
        label[max(a, b)] = min(a, b)
    assert [root(i) for i in range(len(sets))] == want
    shares = [(s[s % np.uint64(8) == 0] >> np.uint64(32)) for s in sets]
    stays = jaccard_join.may_link([len(s) for s in sets], shares, 80)
    assert all(stays[i] for i in range(len(sets)) if want.count(want[i]) > 1)


def test_loser_tree():
    rng = random.Random(6)
    for _ in range(200):
        lists = [sorted(rng.randint(0, 30) for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(0, 9))]
        assert list(warc.LoserTree(lists)) == sorted(x for one in lists for x in one)


def test_records_of_archives():
    fields, _, payload = warc.parse(warc.record(5, "http://a b\r\n/", "é".encode(), None, False))
    assert payload.decode() == "é" and fields["WARC-Target-URI"] == "http://a%20b%0D%0A/"
    fields, http, payload = warc.parse(warc.record(None, None, b"abc", 7, True))
    assert payload == b"" and fields["WARC-Refers-To"] == "<urn:x-page:7>" and b"Content-Length: 3" in http
    assert warc.url_key("https://www.Example.com/A?b#c") == "com,example)/a?b"
    with pytest.raises(ValueError):
        warc.parse(warc.record(1, "u", b"abc", None, False)[:-5])


def test_products_beyond_doubles():
    q = np.array([[2.0**40, 1.0]])
    assert topk.products(q, np.array([[2.0**20, 3.0]])).tolist() == [[2**60 + 3]]


def test_url_parts():
    assert urls.split_url("HTTP://Ex.COM/En/7?x#y") == ("ex.com", "/En/7")
    assert urls.split_url(None) == urls.split_url("nothing") == ("", "")
    weights = urls.train(urls.default_table())
    parts = [urls.split_url(u) for u, _ in urls.default_table()]
    p = urls.scores(weights, [a for a, _ in parts], [b for _, b in parts])
    assert ((p >= 0.5) == [y for _, y in urls.default_table()]).mean() > 0.97
    assert (urls.train([]) == 0).all()
