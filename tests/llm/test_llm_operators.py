"""Operators on small tables with nulls, ties, repeated rows, clashing columns; against brute force."""

import collections
import glob
import math
import random
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from conftest import same_rows
from plinth.llm import components, decontamination, language_id, ngram_lm, queries, resampling, warc
from plinth.llm.jaccard_join import jaccard_join
from plinth.llm.packing import pack_documents
from plinth.llm.records import token_records, write_records
from plinth.llm.shared import file_system, fresh_dir, shared_dir
from plinth.llm.tokens import default_path
from plinth.llm.topk import top_k
from plinth.llm.urls import filter_urls

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, rid string, number int, noise int, sequence_id int"


def prose(rng, n):
    return " ".join(rng.choice(["the", "of", "and"]) if rng.random() < 0.3 else "".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 7))) for _ in range(n))


def rows():
    rng = random.Random(8)
    base = prose(rng, 120)
    words = base.split()
    near = " ".join("CHANGED" if k == 60 else w for k, w in enumerate(words))
    texts = [base, base.upper(), near, base, prose(rng, 80), prose(rng, 200), "a b", "a  B", "a b c", "", None, "   ", "123 456", "é " * 3, prose(rng, 6000), base + " tail"]
    out = [(k, t, ("en", None, "de")[k % 3], "s", len(t or ""), 0.5, "x", 1, 2, 3) for k, t in enumerate(texts)]
    return [*out, out[4], out[4], (None, base, None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def ids_of(text):
    from tokenizers import Tokenizer

    return np.array(Tokenizer.from_file(default_path()).encode(text or "", add_special_tokens=False).ids, "<u4")


def test_packing(docs, empty):
    got = collections.defaultdict(list)
    for r in pack_documents(docs, default_path(), group_docs=4).collect():
        got[r["sequence_id"]].append(r)
    for s in got.values():
        s.sort(key=lambda r: r["offset"])
        n = 0
        for r in s:
            assert r["offset"] == n
            n += r["length"]
        assert n <= 1024 and (n == 1024 or n & (n - 1) == 0)
    pieces = collections.defaultdict(list)
    for r in (r for s in got.values() for r in s):
        pieces[r["doc_id"]].append((r["start"], r["ids"]))
    for key, text, *_ in rows():
        if key not in (4, None):
            assert b"".join(x for _, x in sorted(pieces[key])) == ids_of(text).tobytes() + b"\0\0\0\0"
    assert sum(len(x) for _, x in pieces[4]) == 3 * 4 * (len(ids_of(rows()[4][1])) + 1)
    assert pack_documents(empty, default_path()).count() == 0


def test_records(spark, docs, empty):
    got = token_records(docs, default_path(), shard_bytes=2000).orderBy("start").collect()
    assert len(got) == len(rows())
    keys = [r["doc_id"] for r in got]
    assert keys == sorted(keys, key=lambda k: (k is not None, k or 0))
    at = 0
    text = {r[0]: r[1] for r in rows()}
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
        if r["doc_id"] is not None:
            assert r["ids"] == ids_of(text[r["doc_id"]]).tobytes() + b"\2\0\0\0"
    assert token_records(empty, default_path()).count() == 0
    folder = fresh_dir(spark, "broken")
    path, _ = write_records(docs, default_path(), folder)[0]
    fs, local = file_system(path)
    with open(local, "r+b") as f:
        f.seek(20)
        f.write(b"\xff\xfe")
    from plinth.llm.records import read_records

    with pytest.raises(Exception, match="checksum"):
        read_records(spark, [(path, 0)]).count()


def brute_components(n, percent):
    sets, least = {}, {}
    for k, (key, text, *_) in enumerate(rows()):
        w = WORD.findall((text or "").translate(LOW))
        sets[k] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
        least[k] = key
    label = {k: k for k in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                c = len(sets[a] & sets[b])
                if c and 100 * c >= percent * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    out = []
    for k, (key, *_) in enumerate(rows()):
        own = [least[j] for j in sets if label[j] == label[k] and least[j] is not None]
        out.append((key, len(sets[k]), min(own) if own and sets[k] else key))
    return collections.Counter(out)


@pytest.mark.parametrize("rows_in_tile", [1500, 2])
def test_jaccard_join(docs, empty, rows_in_tile):
    got = jaccard_join(docs, n=4, percent=85, tile_rows=rows_in_tile)
    assert collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()) == brute_components(4, 85)
    assert jaccard_join(empty).count() == 0


@pytest.mark.parametrize("rows_in_tile", [1500, 2])
def test_jaccard_join_counts_all_links(spark, rows_in_tile):
    rng = random.Random(5)
    texts = []
    for _ in range(3):
        words = prose(rng, 120).split()
        texts += [" ".join(f"x{v}" if v and k == v * 6 else w for k, w in enumerate(words)) for v in range(8)]
    texts += [texts[0], texts[0], texts[9], "a b", None, prose(rng, 60)]
    sets = [{tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) > 3 else {tuple(w)} if w else set() for w in ((t or "").split() for t in texts)]
    want = {k: sum(j != k and 0 < len(a | b) * 85 <= 100 * len(a & b) for j, b in enumerate(sets)) for k, a in enumerate(sets)}
    assert sorted(want.values())[len(want) // 2] >= 7
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"]: r["n_links"] for r in jaccard_join(docs, n=4, percent=85, tile_rows=rows_in_tile).collect()} == want


def test_components(spark):
    rng = random.Random(1)
    links = [(k, k + 1) for k in range(40)] + [(100 + rng.randint(0, 30), 100 + rng.randint(0, 30)) for _ in range(25)] + [(7, 7), (None, 3)]
    label = {}
    for a, b in links:
        if a is not None and a != b:
            label.setdefault(a, a)
            label.setdefault(b, b)
    for _ in label:
        for a, b in links:
            if a is not None and a != b:
                label[a] = label[b] = min(label[a], label[b])
    got = components.components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r["node"]: r["root"] for r in got} == label and len(got) == len(label)


def test_decontamination(spark, docs, empty):
    rng = random.Random(12)
    items = [prose(rng, 40) for _ in range(8)]
    edited = " ".join("new" if k % 9 == 4 else w for k, w in enumerate(items[1].split()))
    texts = [prose(rng, 50) + " " + items[0] + " " + prose(rng, 50), "x " + edited.upper() + " y", prose(rng, 300), None, "", items[2].replace(" ", " , "), " ".join(items[3].split()[:25])]
    d = spark.createDataFrame([(k, t, "a", 1) for k, t in enumerate(texts)] + [(None, items[4], "a", 1)], "doc_id long, text string, item_id string, score int")
    b = spark.createDataFrame([*enumerate(items), (50, None), (51, "two words"), (None, prose(rng, 30))], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(d, b).collect()}
    assert got == {(0, 0), (1, 1), (5, 2), (6, 3), (None, 4)}
    assert {(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(d, b, block_words=60).collect()} == got
    left = decontamination.decontaminate(d, b)
    assert left.columns == d.columns and sorted(r["doc_id"] for r in left.collect()) == [2, 3, 4]
    assert decontamination.contaminated(d, b.limit(0)).count() == 0 and decontamination.decontaminate(empty, b).count() == 0
    long = decontamination.contaminated(d, spark.createDataFrame([(1, " ".join([items[0], *(prose(rng, 40) for _ in range(30))]))], "item_id long, text string"), segment=64)
    assert {r["doc_id"] for r in long.collect()} == {0}


def test_language_id(spark, sf_dir, docs, empty):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r["doc_id"]: r for r in queries.op3_language_id(spark, sf_dir).collect()}
    assert len(got) == table.count()
    held = [(r["lang"], got[r["doc_id"]]["lang_pred"]) for r in table.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert all(got[k]["held_out"] == (zlib.crc32(str(k).encode()) % 4 == 2) for k in got)
    assert sum(a == b for a, b in held) >= 0.9 * len(held)
    model = language_id.train(table)
    out = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.predict(docs, model).collect()}
    assert out[9] == out[10] == out[11] == out[12] == ("und", 0.0) and out[13][0] != "und"
    assert all(0 <= s <= 1 for _, s in out.values())
    assert {r["lang_pred"] for r in language_id.predict(docs, language_id.train(empty)).collect()} == {"und"}
    assert language_id.predict(empty, model).count() == 0


def test_resampling(spark, docs, empty):
    rng = random.Random(9)
    texts = [prose(rng, rng.randint(30, 200)) for _ in range(150)]
    bad = [" ".join(w + "###" for w in prose(rng, rng.randint(30, 100)).split()) for _ in range(50)]
    d = spark.createDataFrame([(k, t) for k, t in enumerate(texts + bad)], "doc_id long, text string")
    good = spark.createDataFrame([(k,) for k in range(0, 150, 2)], "doc_id long")
    got = {r["doc_id"]: r for r in resampling.resample(d, good).collect()}
    assert all(got[k]["selected"] for k in range(150)) and not any(got[k]["selected"] for k in range(150, 200))
    some = [r for r in resampling.resample(d, good, share=0.25).collect() if r["selected"]]
    assert len(some) == 50
    every = sorted((r["gumbel_key"] for r in got.values()), reverse=True)
    rows_ = spark.createDataFrame([(x,) for x in every + every[:3]], "x double")
    for k in (1, 2, 5, 50, 203):
        assert resampling.kth_largest(rows_, "x", k, bits=3)[0] == sorted(every + every[:3], reverse=True)[k - 1]
    assert resampling.resample(docs, good).count() == len(rows()) and resampling.resample(empty, good).count() == 0
    assert resampling.select_rows(docs, good).columns == docs.columns
    assert {r["log_weight"] for r in resampling.resample(docs, good.limit(0)).collect()} == {0.0}


def test_top_k(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 8)) * rng.lognormal(0, 1.5, (200, 1))
    data = [(i, [float(v) for v in x[i]]) for i in range(200)]
    data += [(None, data[3][1]), (1000, None), (1001, [None] * 8), (1002, [float("nan")] * 8), (1003, [float("inf")] + [0.0] * 7), (1004, []), (1006, []), (5, data[5][1]), (7, data[5][1]), (2000, [0.0] * 8)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    asked = {i for i, _ in data if i is not None and (i % 10 == 0 or i == 5)}
    sound = [(i, [math.floor(256 * v) for v in e]) for i, e in data if e is not None and all(v is not None and math.isfinite(v) for v in e)]
    want = set()
    for i, v in {i: v for i, v in sound if i in asked}.items():
        best = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j is None, j or 0) for j, w in sound if j != i and len(w) == len(v))[:5]
        want |= {(i, r + 1, None if null else j, -s) for r, (s, null, j) in enumerate(best)}
    q = df.where("vec_id % 10 = 0 or vec_id = 5")
    assert {tuple(r) for r in top_k(df, q, 5, seeds=32).collect()} == want
    assert {tuple(r) for r in top_k(df, q, 5, block_bytes=1000).collect()} == want
    assert top_k(df.limit(0), q.limit(0)).count() == 0


def test_archives(spark):
    data = [(1, "http://A.com/x", "a"), (2, None, None), (3, "u", ""), (None, "http://a.com/x", "a"), (5, "http://a.com/x\n y", "é"), (5, "http://a.com/x\n y", "é"), (7, "http://b.org", "zz"), (None, "q", "only")]
    pages = spark.createDataFrame(data, "page_id long, url string, html string")
    got = {(r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.archive_pages(pages, archive_bytes=300).collect()}
    assert got == {(1, 1, "response", None), (2, 0, "revisit", 3), (3, 0, "response", None), (None, 1, "revisit", 1), (5, 2, "response", None), (7, 2, "response", None), (None, 4, "response", None)}
    assert warc.archive_pages(pages.limit(0)).count() == 0
    many = pages.crossJoin(spark.range(40)).selectExpr("page_id * 100 + id AS page_id", "url", "html")
    index = warc.merge_runs(warc.write_archives(many, fresh_dir(spark, "w"), 2000), range_entries=40).orderBy("range", "position").collect()
    keys = [(r["url_key"], r["captured"], r["page_id"], r["path"], r["offset"]) for r in index]
    assert keys == sorted(keys) and len(keys) == many.count() and len({r["range"] for r in index}) > 1


def test_url_filter(spark):
    data = [(1, "http://a.example.com/en/71"), (2, "http://a.example.com/en/81"), (3, "http://x.net/de/8"), (4, "http://example.net/de/81?q"), (5, "HTTP://ORG/es/"), (6, "http://xcom/en/"), (7, None), (None, "casino"), (1, "http://a.example.com/en/71")]
    got = [(r["page_id"], r["rule"], r["verdict"]) for r in filter_urls(spark.createDataFrame(data, "page_id long, url string"), queries.URL_RULES).collect()]
    assert [g[1] for g in got] == ["example.com/en/7", "com/en/", "net/de/", "example.net/de/8", "org/es/", None, None, None, "example.com/en/7"]
    assert [g[2] for g in got[:5]] == ["allow", "block", "allow", "block", "block"]


def test_language_model(spark, docs, empty):
    trie = ngram_lm.train(docs, order=3)
    c = [collections.Counter() for _ in range(4)]
    texts = {k: WORD.findall((t or "").translate(LOW)) + ["\n"] for k, (_, t, *_) in enumerate(rows())}
    for w in texts.values():
        for k in (1, 2, 3):
            c[k].update(zip(*(w[j:] for j in range(k)), strict=False))
    total, distinct, d = sum(c[1].values()), len(c[1]), 0.75
    listed = {k: {g: n for g, n in c[k].items() if n >= 2} for k in (2, 3)}
    used = collections.Counter()
    for k in (2, 3):
        for g, n in listed[k].items():
            used[g[:-1]] += (n - d) / c[k - 1][g[:-1]]

    def p(g):
        if len(g) == 1:
            return (c[1][g] + 0.1) / (total + 0.1 * (distinct + 1))
        if len(g) == 3 and g[:2] not in listed[2]:
            return p(g[1:])
        back = 1 - used[g[:-1]] if used[g[:-1]] else 1
        return max(back, 1e-9) * p(g[1:]) + ((listed[len(g)][g] - d) / c[len(g) - 1][g[:-1]] if g in listed[len(g)] else 0)

    got = collections.defaultdict(list)
    for r in ngram_lm.score(docs, trie).collect():
        got[r["doc_id"]].append(r)
        assert r["train_tokens"] == total
    for k, (key, *_) in enumerate(rows()):
        if key is None:
            continue
        w = texts[k]
        r = got[key][0]
        assert r["n_tokens"] == r["n_known"] == len(w)
        assert math.isclose(r["base_score"], sum(math.log10(p((x,))) for x in w), rel_tol=1e-9)
        want = sum(math.log10(p(tuple(w[max(0, j - 2) : j + 1]))) for j in range(len(w)))
        assert abs(r["score"] - want) < 0.05 * len(w)
    assert ngram_lm.score(empty, trie).count() == 0
    none = ngram_lm.score(docs, ngram_lm.train(empty)).collect()
    assert {(r["n_known"], r["train_tokens"]) for r in none} == {(0, 0)}


def small_texts():
    rng = random.Random(3)
    return [(k, " ".join(rng.choice("a b b c c c d e f".split()) for _ in range(12))) for k in range(24)]


def brute_scores(train, texts, least, d=0.75):
    """log10 probabilities of texts by a trigram model of train; n-grams seen ``least`` times are listed."""
    c = [collections.Counter() for _ in range(4)]
    for t in train:
        w = [*t.split(), "END"]
        for k in (1, 2, 3):
            c[k].update(zip(*(w[j:] for j in range(k)), strict=False))
    listed = {k: {g: n for g, n in c[k].items() if n >= least} for k in (2, 3)}
    used = collections.Counter()
    for k in (2, 3):
        for g, n in listed[k].items():
            used[g[:-1]] += (n - d) / c[k - 1][g[:-1]]

    def p(g):
        if len(g) == 1:
            return (c[1][g] + 0.1) / (sum(c[1].values()) + 0.1 * (len(c[1]) + 1))
        own = (listed[len(g)][g] - d) / c[len(g) - 1][g[:-1]] if g in listed[len(g)] else 0
        return own + (1 - used[g[:-1]]) * p(g[1:])

    return [sum(math.log10(p(tuple(w[max(0, j - 2) : j + 1]))) for j in range(len(w))) for w in ([*t.split(), "END"] for t in texts)]


def test_codebooks_are_of_all_values(spark, monkeypatch):
    monkeypatch.setattr(ngram_lm, "CODEBOOK_ROWS", 1, raising=False)
    docs = spark.createDataFrame(small_texts(), "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in ngram_lm.score(docs, ngram_lm.train(docs, least=2)).collect()}
    texts = [t for _, t in small_texts()]
    for k, want in enumerate(brute_scores(texts, texts, 2)):
        assert math.isclose(got[k], want, rel_tol=1e-9)  # few values: each has a code
    x = np.append(np.zeros(5000), np.random.default_rng(1).normal(size=5000))
    book = ngram_lm.codebook(x)
    assert len(book) == 256 and book[0] == x.min() and book[-1] == x.max()


def test_texts_that_go_on_in_the_next_piece(spark, monkeypatch):
    """Segments and pieces of a few words, hot contexts, a word longer than a segment: as by brute force."""
    monkeypatch.setattr(ngram_lm, "SEGMENT", 16)
    monkeypatch.setattr(ngram_lm, "PIECE", 20)
    monkeypatch.setattr(ngram_lm, "PART", 20)
    monkeypatch.setattr(ngram_lm, "WORDS_PART", 100)
    texts = [t for _, t in small_texts()[:8]] + ["b " + "x" * 50 + " c b c", " ".join(t for _, t in small_texts()[8:])]
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").coalesce(2)
    trie = ngram_lm.train(docs, least=1)
    assert len(trie.hot[1][0]) and len(trie.hot[2][0]) and trie.parts[1] > 3
    got = {r["doc_id"]: r for r in ngram_lm.score(docs, trie).collect()}
    assert len(got) == len(texts) and ngram_lm.score(docs, trie).count() == len(texts)
    for k, want in enumerate(brute_scores(texts, texts, 1)):
        assert got[k]["n_tokens"] == len(texts[k].split()) + 1
        assert math.isclose(got[k]["score"], want, rel_tol=1e-6), k


def test_query_scores_by_ngrams_seen_once_too(spark, tmp_path):
    spark.createDataFrame(small_texts(), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    train = [t for k, t in small_texts() if zlib.crc32(str(k).encode()) % 10]
    got = {r["doc_id"]: r["score"] for r in queries.op7_ngram_lm(spark, str(tmp_path)).collect()}
    for k, want in enumerate(brute_scores(train, [t for _, t in small_texts()], 1)):
        assert abs(got[k] - want) < 0.01  # a few more values than codes


def test_learned_and_scored_in_one_pass(spark, tmp_path, monkeypatch):
    """op7 cuts its table into pieces once and sends each level's n-grams once; scores are as by brute force for texts learned from and others."""
    made, sent, make, send = [], [], ngram_lm.make_pieces, ngram_lm._send_grams
    monkeypatch.setattr(ngram_lm, "make_pieces", lambda *x: made.append(1) or make(*x))
    monkeypatch.setattr(ngram_lm, "_send_grams", lambda k, *x: sent.append(k) or send(k, *x))
    monkeypatch.setattr(ngram_lm, "PIECE", 20)
    monkeypatch.setattr(ngram_lm, "PART", 40)
    texts = [t for _, t in small_texts()] + [" ".join(f"w{k}" for k in range(30)), "w1 w2 w3 a b", "", None]
    spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    train = [t or "" for k, t in enumerate(texts) if zlib.crc32(str(k).encode()) % 10]
    assert 0 < len(train) < len(texts)
    def left():
        return set(glob.glob(f"{file_system(shared_dir(spark))[1]}/plinth/ngrams-*/**/order*.lvl", recursive=True))

    before = left()
    got = {r["doc_id"]: r for r in queries.op7_ngram_lm(spark, str(tmp_path)).collect()}
    assert len(made) == 1 and len(sent) == sum(ngram_lm.ROUNDS.values())
    assert not left() - before  # files of levels that were asked are gone
    known = {w for t in train for w in t.split()}
    for k, want in enumerate(brute_scores(train, [t or "" for t in texts], 1)):
        words = (texts[k] or "").split()
        assert (got[k]["n_tokens"], got[k]["n_known"]) == (len(words) + 1, sum(w in known for w in words) + 1)
        assert got[k]["held_out"] == (zlib.crc32(str(k).encode()) % 10 == 0) and math.isclose(got[k]["score"], want, rel_tol=1e-6), k


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql_says_the_same(spark, sf_dir, duck, name):
    same_rows(queries.QUERIES[name](spark, sf_dir), duck, queries.ORACLE_SQL[name])


def test_pipeline(spark, sf_dir):
    from plinth.llm.shared import stage

    first = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept, sizes = first, []
    for name, f in corpus_pipeline.STAGES:
        out = stage(f(spark, kept, sf_dir), name)
        if name != "packing":
            assert out.columns == first.columns
            assert out.join(kept, "doc_id", "left_anti").count() == 0
            sizes.append(out.count())
            kept = out
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0
    assert {r["doc_id"] for r in out.collect()} == {r["doc_id"] for r in kept.collect()}
    assert kept.count() == kept.select("doc_id").distinct().count()


def test_pipeline_stages_on_odd_rows(spark, sf_dir, docs, empty):
    for name, f in corpus_pipeline.STAGES:
        assert f(spark, empty, sf_dir).count() == 0, name
        out = f(spark, docs, sf_dir)
        if name != "packing":
            assert out.columns == docs.columns, name
        out.count()
    left = corpus_pipeline.near_duplicates(spark, docs, sf_dir).collect()
    assert sorted((r["doc_id"] for r in left if r["doc_id"] is not None)) == [0, 4, 5, 6, 8, 9, 10, 11, 12, 13, 14]


def test_ranges_of_many_short_runs(spark):
    """No range is much larger than the others, however short the runs are."""
    pages = spark.range(2400).selectExpr("id AS page_id", "concat('http://h', id % 7, '.org/', id) AS url", "cast(id % 50 as string) AS html").repartition(8)
    runs = warc.write_archives(pages, fresh_dir(spark, "short"), 300)
    assert runs.count() > 300
    sizes = [r["count"] for r in warc.merge_runs(runs, range_entries=200).groupBy("range").count().collect()]
    assert sum(sizes) == 2400 and len(sizes) >= 11 and max(sizes) < 2 * 200
