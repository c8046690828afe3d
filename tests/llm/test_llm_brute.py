"""Whole operators and registered queries against plain reimplementations."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from plinth.llm import decontamination, language_id, ngram_lm, queries, resampling, urls
from plinth.llm.jaccard_join import jaccard_join
from plinth.llm.tokens import default_path
from plinth.llm.words import ODD

MASK = (1 << 64) - 1
ODDS = [int(x) for x in ODD]
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def prose(rng, n):
    return " ".join(rng.choice(["the", "of", "and"]) if rng.random() < 0.3 else "".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 7))) for _ in range(n))


# ---- op1, op8: the registered queries, over a whole table


def ids_of(text):
    from tokenizers import Tokenizer

    return np.array(Tokenizer.from_file(default_path()).encode(text or "", add_special_tokens=False).ids, "<u4")


@pytest.fixture(scope="module")
def ids(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    return {r["doc_id"]: ids_of(r["text"]) for r in rows}


def test_op1_query(spark, sf_dir, ids):
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in queries.op1_ffd_packing(spark, sf_dir).collect():
        own = np.append(ids[r["doc_id"]], np.uint32(0)).astype("<u4")
        assert r["doc_tokens"] == len(own) and r["ids_crc32"] == zlib.crc32(own[r["start"] : r["start"] + r["length"]].tobytes())
        pieces[r["doc_id"]].append((r["start"], r["length"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(pieces) == set(ids)
    for some, total in [(pieces[k], len(v) + 1) for k, v in ids.items()] + [(s, None) for s in sequences.values()]:
        at = 0
        for start, length in sorted(some):
            assert start == at
            at += length
        assert at == total if total else at <= 1024
    total = sum(len(v) + 1 for v in ids.values())
    padded = sum(n if n & (n - 1) == 0 else 1024 for n in (sum(x[1] for x in s) for s in sequences.values()))
    assert padded <= 1.02 * total


def test_op8_query(spark, sf_dir, ids):
    got = {r["doc_id"]: r for r in queries.op8_token_records(spark, sf_dir).collect()}
    at = 0
    for k in sorted(ids):
        own = np.append(ids[k], np.uint32(2)).astype("<u4")
        assert (got[k]["start"], got[k]["n_tokens"], got[k]["ids_crc32"]) == (at, len(own), zlib.crc32(own.tobytes()))
        at += len(own)
    assert len(got) == len(ids)


# ---- op7: blocks and sorts


def test_blocks_come_back():
    rng = np.random.default_rng(3)
    arrays = {"a": rng.integers(0, 1 << 63, 50).astype(np.uint64), "b": np.array([-5, 0, 7]), "c": np.zeros(0, np.uint32), "d": rng.normal(size=9), "e": np.zeros(4, np.uint8), "f": np.array([255, 3], np.uint16)}
    got = ngram_lm.undump(ngram_lm.dump(**arrays))
    assert got.keys() == arrays.keys() and all((got[k] == v).all() and got[k].dtype == v.dtype for k, v in arrays.items())


def test_unique_values_and_places():
    rng = np.random.default_rng(4)
    close = np.array([(5 << 40) + k for k in (3, 1, 2, 3, 1)] * 30, np.uint64) << np.uint64(18)
    for x in (np.zeros(0, np.int64), np.array([7]), rng.integers(0, 9, 100), rng.integers(0, 1 << 62, 999), (rng.integers(0, 1 << 62, 300).astype(np.uint64) << np.uint64(2))[rng.integers(0, 300, 2000)], close, close + np.arange(150, dtype=np.uint64) % np.uint64(2)):
        want, got = np.unique(x, return_inverse=True), ngram_lm._unique(x)
        assert (want[0] == got[0]).all() and (want[1] == got[1]).all() and got[0].dtype == x.dtype


# ---- op2


def passage_score(text, item):
    """The best local alignment of words: match 1, mismatch and gap -1."""
    above, best = [0] * (len(item) + 1), 0
    for w in text:
        now = [0]
        for j, v in enumerate(item):
            now.append(max(0, above[j] + (1 if v == w else -1), above[j + 1] - 1, now[j] - 1))
        best, above = max(best, *now), now
    return best


def test_op2_equals_alignment_of_all_pairs(spark):
    rng = random.Random(21)
    items = [prose(rng, n) for n in (12, 20, 30, 45, 60)]
    texts = [prose(rng, 120) for _ in range(6)] + ["", None]
    for item in items:
        for share in (0, 0.05, 0.1, 0.15, 0.3, 0.6):
            words = [prose(rng, 1) if rng.random() < share else w for w in item.split() if rng.random() >= share / 4]
            texts.append(" ".join([prose(rng, rng.randint(0, 40)), *words, prose(rng, rng.randint(0, 40))]))
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    want = {}
    for d, text in enumerate(texts):
        for i, item in enumerate(items):
            score = passage_score(re.findall("[a-z]+", text or ""), item.split()) / len(item.split())
            run = 3 if len(item.split()) < decontamination.SHORT else 6  # what shares no seed is no candidate
            words = item.split()
            shared = any(f" {' '.join(words[k : k + run])} " in f" {text or ''} " for k in range(len(words) - run + 1))
            if score >= 0.4 and shared:
                want[d, i] = score
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in decontamination.contaminated(docs, spark.createDataFrame([*enumerate(items)], "item_id long, text string")).collect()}
    assert len(want) > 15 and got.keys() == want.keys()
    assert all(math.isclose(got[k], want[k]) for k in want)


# ---- op3


def plain_buckets(text, n):
    points = []
    for c in map(ord, text):
        if 0xC0 <= c < 0xDF and c != 0xD7:
            c += 32
        elif 65 <= c <= 90:
            c += 32
        elif c < 128 and not 97 <= c <= 122 or c in (0xD7, 0xF7):
            c = 32
        points.append(c)
    out = []
    for k in range(1, n + 1):
        for i in range(len(points) - k + 1):
            some = points[i : i + k]
            if some[0] == some[-1] == 32:
                continue
            h = 0
            for c in some:
                h = (h * ODDS[0] + (c + 1) * ODDS[1]) & MASK
            out.append(((h ^ (h >> 32)) * ODDS[2] & MASK) >> (64 - language_id.BITS))
    return out


def test_op3_equals_plain_naive_bayes(spark):
    rng = random.Random(5)
    letters = {"aa": "abcdeé ", "bb": "bcdefü ", "cc": "efghij "}
    rows = [(k, "".join(rng.choice(letters[lang]) for _ in range(rng.randint(3, 60))), lang) for k, lang in enumerate(["aa"] * 12 + ["bb"] * 8 + ["cc"] * 3)]
    asked = [(100 + k, "".join(rng.choice(letters[rng.choice([*letters])]) for _ in range(rng.randint(1, 9)))) for k in range(30)] + [(200, "12 3"), (201, None), (202, "Ж")]
    model = language_id.train(spark.createDataFrame([*rows, (None, "x", "aa"), (50, None, "aa"), (51, "zzz", None)], "doc_id long, text string, lang string"))
    got = {r["doc_id"]: r for r in language_id.predict(spark.createDataFrame(asked, "doc_id long, text string"), model).collect()}
    counts = {lang: collections.Counter(b for _, t, x in rows if x == lang for b in plain_buckets(t, 3)) for lang in letters}
    prior = {lang: math.log((sum(x == lang for _, _, x in rows) + 1) / (len(rows) + 3)) for lang in letters}
    for key, text in asked:
        if text is None or not any(map(str.isalpha, text)):
            assert (got[key]["lang_pred"], got[key]["score"]) == ("und", 0.0)
            continue
        log = {x: prior[x] + sum(math.log((counts[x][b] + 0.1) / (counts[x].total() + 0.1 * (1 << language_id.BITS))) for b in plain_buckets(text, 3)) for x in letters}
        top = max(log.values())
        assert got[key]["lang_pred"] == max(log, key=log.get)
        assert math.isclose(got[key]["score"], 1 / sum(math.exp(v - top) for v in log.values()), rel_tol=1e-4)


# ---- op4


def test_op4_equals_plain_ratios(spark):
    rng = random.Random(6)
    texts = [prose(rng, rng.randint(1, 60)) for _ in range(60)] + [" ".join(w + " ##" for w in prose(rng, 20).split()) for _ in range(12)] + ["", None, "A a  a b"]
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    good = list(range(0, 60, 2))
    got = {r["doc_id"]: r["log_weight"] for r in resampling.resample(docs, spark.createDataFrame([(k,) for k in good], "doc_id long")).collect()}

    def bag(text):
        h, before = resampling.token_hashes(np.frombuffer((text or "").encode(), np.uint8), np.array([0, len((text or "").encode())]))
        assert len(h) == len(re.findall(r"[a-z0-9]+|[^a-z0-9\s]+", (text or "").lower()))
        return collections.Counter(resampling.buckets(h, before)[0].tolist())

    bags = [bag(t) for t in texts]
    raw, target = sum(bags, collections.Counter()), sum((bags[k] for k in good), collections.Counter())
    size = 1 << resampling.BITS
    for k, b in enumerate(bags):
        w = sum(n * (math.log((target[x] + 1) / (target.total() + size)) - math.log((raw[x] + 1) / (raw.total() + size))) for x, n in b.items())
        want = min(0, w + resampling.ERRORS / len(good) ** 0.5 * b.total()) if w < 0 else w
        assert math.isclose(got[k], want, abs_tol=1e-9)


def test_op4_on_labels_held_out(spark, sf_dir):
    """A model of the good half of labels tells the other half's good and bad apart."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    half = "crc32(cast(doc_id as string)) % 2 = {}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = resampling.fit(docs, labels.where("quality = 1").where(half.format(0)))
    rest = labels.where(half.format(1)).join(resampling.weigh(docs, model), "doc_id").select("quality", "log_weight").collect()
    good, bad = ([r["log_weight"] for r in rest if r["quality"] == q] for q in (1, 0))
    assert good and bad
    above = sum((g > b) + (g == b) / 2 for g in good for b in bad) / len(good) / len(bad)
    assert above >= 0.95, above


# ---- op9, near duplicates


def plain_classes(texts, n, percent):
    sets = [{tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set() for w in (WORD.findall((t or "").translate(LOW)) for t in texts)]
    label = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            c = len(sets[a] & sets[b])
            if c and 100 * c >= percent * len(sets[a] | sets[b]) and label[a] != label[b]:
                label = [label[b] if x == label[a] else x for x in label]
    return [x if s else None for x, s in zip(label, sets, strict=True)]


def odd_rows():
    rng = random.Random(31)
    base = prose(rng, 100)
    near = [" ".join(f"new{v}" if k == 10 * v else w for k, w in enumerate(base.split())) for v in range(4)]
    other = prose(rng, 50)
    rows = [(5, base), (3, near[0]), (9, near[1]), (None, near[2]), (None, base), (3, near[3]), (3, other), (3, other), (7, other), (None, prose(rng, 40))]
    lone = prose(rng, 30)
    return [*rows, (None, lone), (None, lone + " x"), (None, ""), (None, None), (1, ""), (2, None), (2, None), (4, "  "), (8, prose(rng, 3)), (8, prose(rng, 3))]


def test_near_duplicates_of_null_and_repeated_ids(spark, sf_dir):
    rows = odd_rows()
    docs = spark.createDataFrame([(i, t, k, "x") for k, (i, t) in enumerate(rows)], "doc_id long, text string, number int, row string")
    label = plain_classes([t for _, t in rows], 5, 80)
    kept = [tuple(r) for r in corpus_pipeline.near_duplicates(spark, docs, sf_dir).select("doc_id", "text").collect()]
    groups = collections.defaultdict(set)
    for k, (i, t) in enumerate(rows):
        groups[label[k] if label[k] is not None else ("none", i, t)].add((i, t))
    left = collections.Counter(kept)
    assert sum(left.values()) == len(groups)
    for members in groups.values():
        named = [m for m in members if m[0] is not None]
        least = min((m[0] for m in named), default=None)
        mine = [m for m in members if left[m]]
        assert len(mine) == 1 and mine[0][0] == least
    classes = collections.defaultdict(set)
    for r in jaccard_join(docs, n=5, percent=80).where("class_id is not null").collect():
        classes[r["class_id"]].add(r["doc_id"])
    assert sorted(map(str, classes.values())) == sorted(str({rows[k][0] for k, x in enumerate(label) if x == y}) for y in {x for x in label if x is not None})


def test_frequent_sets_by_broadcast(spark):
    texts = ["a b c d e f"] * 30 + ["a b c d e f g"] * 3 + [f"{k} u v w x" for k in range(4)] + ["", None]
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: (r["component_id"], r["n_links"]) for r in jaccard_join(docs, n=5, percent=60).collect()}
    assert got == {k: (0, 32) if k < 33 else (k, 0) for k in range(len(texts))}


def test_language_stage_without_languages(spark, sf_dir):
    docs = spark.createDataFrame([(1, "some words here", None), (2, None, None), (3, "12", None)], "doc_id long, text string, lang string")
    assert corpus_pipeline.language(spark, docs, sf_dir).count() == 3


# ---- op10


def plain_score(weights, host, path):
    hit = []
    for text in (f"\x01{host}\x02", f"\x03{path}\x04"):
        raw = [c + 32 if 65 <= c <= 90 else c for c in text.encode()]
        for i in range(len(raw)):
            h = 0
            for k in range(min(5, len(raw) - i)):
                h = (h + raw[i + k] + 1) * ODDS[3] & MASK
                h ^= h >> 29
                if k >= 2:
                    hit.append((h * ODDS[4] & MASK) >> (64 - urls.BITS))
    return 1 / (1 + math.exp(-weights[-1] - sum(weights[x] for x in hit) / math.sqrt(max(1, len(hit)))))


def test_op10_equals_plain_regression():
    table = urls.default_table()[::9]
    y = [label for _, label in table]
    parts = [urls.split_url(u) for u, _ in table]
    weights = urls.train(table, steps=3)
    for w in (np.zeros(len(weights)), weights):
        assert np.allclose(urls.scores(w, [p[0] for p in parts], [p[1] for p in parts]), [plain_score(w, *p) for p in parts])

    def loss(w):
        return sum(-math.log(p if label else 1 - p) for p, label in zip((plain_score(w, *p) for p in parts), y, strict=True)) / len(y)

    first, last = loss(np.zeros(len(weights))), loss(urls.train(table, steps=60))
    assert loss(weights) < first and last < loss(weights)


def test_op10_on_words_held_out():
    table, folds = urls.default_table(), urls.word_folds()
    assert len(table) == len(folds) and set(folds) == set(range(urls.FOLDS))
    got = urls.held_out(table, folds)
    assert got["auc"] >= 0.9 and got["recall_at_5"] >= 0.8 and got["false_alarms"] <= 0.05, got
    names = "casino win free bets adult ads track cheap pills spam farm".split()
    assert not [w for w in urls.BAD + urls.GOOD if any(n in w for n in names)]  # words of sites that the tables have


def test_op10_on_odd_urls(spark):
    rows = [(1, "http://" + "a" * 300_000 + ".com/x", "h", 1), (2, "http://casino-poker.com/" + "p/" * 100_000, "h", 1), (3, None, None, None), (None, "://", "h", 1), (3, "", "h", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, verdict int").selectExpr("*", "1 AS path", "2 AS rule", "3 AS p_block")
    got = sorted(((r["page_id"] or 0, len(r["host"]), len(r["path"]), r["rule"]) for r in urls.filter_urls(pages, queries.URL_RULES).collect()))
    assert got == [(0, 0, 0, None), (1, 300_004, 2, None), (2, 16, 200_001, None), (3, 0, 0, None), (3, 0, 0, None)]
    assert urls.filter_urls(pages.limit(0), queries.URL_RULES).count() == 0
