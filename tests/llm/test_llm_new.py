"""Divergence of sources, alignment of tokenizers, sum-of-squares packing: against plain reimplementations, and odd input."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest
from conftest import same_rows

from plinth.llm import alignment, divergence, queries, square_packing
from plinth.llm.tokens import default_path

DOCS = "doc_id long, text string, lang string, source string"
ODD = ["", " ", "  a", "a ", "a  b", "\ta\n b", "x  y", "ﬁ Å é", "a▁b", "x\x00y", "<s> </s> <|endoftext|> <0x41>", "日本語 テキスト", "🙂 ok🙂", "it's 12 34th  \n\n end", "\x1c a\x1f b", "é ́x", "a\r\n b\x0b c"]


@pytest.fixture(scope="module")
def tokenizers():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(alignment.default_paths()[0])
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=alignment.default_paths()[1])


def plain_alignment(tokenizers, texts):
    """Of each text (groups as text, [(a, b)] of links, n_a, n_b), by offsets alone."""
    a, b = tokenizers
    chars = {}
    rest = 256
    for x in range(256):
        if 33 <= x <= 126 or 161 <= x <= 172 or x >= 174:
            chars[chr(x)] = x
        else:
            chars[chr(rest)] = x
            rest += 1
    out = []
    for t in texts:
        if not t:
            out.append(("", [], 0, 0))
            continue
        want = (" " + t).encode()
        e = a.encode(" " + t, add_special_tokens=False)
        x = [(i, bytes(chars[c] for c in token)) for i, token in zip(e.ids, e.tokens, strict=True)]
        y = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(t)]
        if b"".join(v for _, v in x) != want or b"".join(v for _, v in y) != want:
            out.append(("", [], 0, 0))
            continue
        ends = []
        for side in (x, y):
            at, own = 0, {}
            for i, v in side:
                at += len(v)
                own[at] = i
            ends.append(own)
        common = sorted(set(ends[0]) & set(ends[1]))
        groups, low = [], 0
        for to in common:
            groups.append("|".join(",".join(str(i) for at, i in own.items() if low < at <= to) for own in ends))
            low = to
        out.append((";".join(groups), [(ends[0][c], ends[1][c]) for c in common], len(x), len(y)))
    return out


def check_alignment(rows, texts, plain):
    count = collections.Counter(p for _, links, _, _ in plain for p in links)
    best = collections.defaultdict(int)
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    assert len(rows) == len(texts)
    for k, (groups, links, n_a, n_b) in enumerate(plain):
        r = rows[k]
        assert (r["n_a"], r["n_b"], r["n_groups"], r["n_links"]) == (n_a, n_b, len(links), len(links)), texts[k]
        assert r["groups_sha256"] == (hashlib.sha256(groups.encode()).hexdigest() if groups else "")
        assert r["n_best"] == sum(count[p] == best[p[1]] for p in links) and r["count_sum"] == sum(count[p] for p in links)


def test_op12_query(spark, sf_dir, tokenizers):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    texts = {r["doc_id"]: r["text"] for r in docs}
    plain = plain_alignment(tokenizers, texts.values())
    rows = {r["doc_id"]: r for r in queries.op12_token_alignment(spark, sf_dir).collect()}
    check_alignment([rows[k] for k in texts], list(texts.values()), plain)


def test_alignment_of_odd_texts_and_rare_pairs(spark, tokenizers, monkeypatch):
    rng = random.Random(5)
    texts = [None, *ODD, "word " * 3000, "x" * 5000] + ["".join(rng.choice(["a", "the ", "  ", "\n", "é", "9", ".", " ", " ", "▂"]) for _ in range(60)) for _ in range(60)] + ["the same", "the same"]
    docs = spark.createDataFrame([(k, t, 1, 2) for k, t in enumerate(texts)], "doc_id long, text string, n_a long, at long").repartition(3)
    plain = plain_alignment(tokenizers, texts)
    for hot in (alignment.HOT, 7, 0):
        rows = alignment.aligned_documents(docs, *alignment.default_paths(), hot=hot).orderBy("doc_id").collect()
        check_alignment(rows, texts, plain)
    groups = alignment.align_documents(docs, *alignment.default_paths(), with_groups=True).orderBy("doc_id").collect()
    assert [r["groups"] for r in groups] == [p[0] for p in plain]
    assert alignment.aligned_documents(docs.limit(0), *alignment.default_paths()).collect() == []
    monkeypatch.setattr(alignment, "LONG", 40)
    own = alignment.Aligner(*(f(p) for f, p in zip((lambda p: open(p).read(), lambda p: open(p, "rb").read()), alignment.default_paths(), strict=True)))
    got = [b";".join(own.groups[k] for k in d).decode() for d in own.documents(texts)]
    assert got == [p[0] for p in plain]
    for t in texts[1:]:
        assert [p for c in alignment.chunks(t) for p in alignment.pieces(c)] == alignment.pieces(t)


def test_components_are_the_smallest_groups():
    rng = random.Random(2)
    for _ in range(200):
        n = rng.randint(1, 30)
        a, b = (np.array(sorted({*rng.sample(range(1, n + 1), rng.randint(0, n)), n})) for _ in range(2))
        roots_a, roots_b = alignment.components(a, b)
        common = sorted(set(a) & set(b))
        which = [np.searchsorted(common, x) for x in (a, b)]  # the group of a token: the first common end that isn't before its own
        first = [int(np.flatnonzero(which[0] == g)[0]) for g in range(len(common))]
        assert roots_a.tolist() == [first[g] for g in which[0]] and roots_b.tolist() == [first[g] for g in which[1]]
        i, j = alignment.expand_links(roots_a, roots_b, a, b)
        assert a[i].tolist() == b[j].tolist() == common
    assert [x.tolist() for x in alignment.components(np.zeros(0, int), np.zeros(0, int))] == [[], []]


# ---- packing


def test_op13_query(spark, sf_dir):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_path())
    t.encode_special_tokens = True
    ids = {r["doc_id"]: np.array([*t.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in queries.op13_square_packing(spark, sf_dir).collect():
        own = ids[r["doc_id"]]
        assert r["ids_crc32"] == zlib.crc32(own[r["start"] : r["start"] + r["length"]].tobytes())
        pieces[r["doc_id"]].append((r["piece"], r["start"], r["length"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert pieces.keys() == ids.keys()
    for k, own in pieces.items():
        own.sort()
        assert [p for p, _, _ in own] == list(range(len(own))) and all(n == 1024 for _, _, n in own[1:]) and sum(n for _, _, n in own) == len(ids[k])
        assert [s for _, s, _ in own] == [sum(n for _, _, n in own[:i]) for i in range(len(own))]
    for own in sequences.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= 1024
    assert len(sequences) <= 1.02 * sum(map(len, ids.values())) / 1024 + 1


def test_each_document_goes_where_the_squares_are_least():
    rng = np.random.default_rng(4)
    lengths, size = rng.integers(1, 33, 400), 32
    bins, places = square_packing.square_pack(lengths, size)
    room = {}
    for i in np.argsort(-lengths, kind="stable"):
        n, fits = int(lengths[i]), {}
        for g in {g for g in room.values() if g >= n}:
            count = collections.Counter(g for g in room.values() if g)
            count[g] -= 1
            count[g - n] += g > n
            fits[g] = sum(v * v for v in count.values())
        if fits:
            assert room[bins[i]] in fits and (fits[room[bins[i]]], room[bins[i]]) == min((v, g) for g, v in fits.items())
        else:
            assert bins[i] not in room
        assert places[i] == size - room.get(bins[i], size)
        room[bins[i]] = room.get(bins[i], size) - n
    assert min(room.values()) >= 0


def test_few_sequences():
    rng = np.random.default_rng(1)
    for n in (300, 3000):
        lengths = np.minimum(1024, rng.lognormal(5.5, 1, n).astype(int) + 1)
        assert len(set(square_packing.square_pack(lengths, 1024)[0])) <= 1.01 * lengths.sum() / 1024 + 1


def test_packing_of_odd_rows(spark):
    texts = [None, "", "a b c", "a b c", "word " * 5000, "x"]
    rows = [(k if k != 5 else None, t, 7, 8, 9) for k, t in enumerate(texts)] + [(2, "a b c", 7, 8, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, at long, ids long, grp long").repartition(2)
    got = square_packing.square_pack_documents(docs, default_path(), group_docs=2).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["piece"], r["start"]) for r in got if r["doc_id"] != 4) == [(False, 0, 0, 0), (False, 1, 0, 0), (False, 2, 0, 0), (False, 2, 0, 0), (False, 3, 0, 0), (True, 0, 0, 0)]
    long = sorted((r["piece"], r["start"], r["length"], r["sequence_id"] < 0) for r in got if r["doc_id"] == 4)
    assert [x[2] for x in long[1:]] == [1024] * (len(long) - 1) and all(x[3] == (x[2] == 1024) for x in long)
    assert all(len(r["ids"]) == r["length"] and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) for r in got)
    assert square_packing.square_pack_documents(docs.limit(0), default_path()).collect() == []


# ---- divergence


def test_divergence_query(spark, sf_dir, duck):
    same_rows(queries.op11_source_divergence(spark, sf_dir), duck, queries.ORACLE_SQL["op11_source_divergence"])


def plain_divergence(rows, least, top):
    rows = [((lang or ""), (source or ""), [w for c in divergence.terms((text or "").encode()) for w in c]) for text, lang, source in rows]
    out = set()
    for lang in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == lang]
        have = collections.Counter(w for _, _, ws in own for w in set(ws))
        kept = sorted(w for w in have if have[w] >= least)
        counts = {s: collections.Counter(w for _, t, ws in own if t == s for w in ws if have[w] >= least) for s in {r[1] for r in own}}

        def prices(c):
            n = sum(c.values())
            return {w: 1 + 10**9 * (c[w] + 5) // (n + 5 * len(kept)) for w in kept}

        p, q = {s: prices(c) for s, c in counts.items()}, prices(sum(counts.values(), collections.Counter()))
        for s in p:
            pairs = sorted((-sum(abs(p[s][w] - p[o][w]) for w in kept), o) for o in p if o != s)
            words = sorted((q[w] - p[s][w], w.decode()) for w in kept if counts[s][w] and p[s][w] > q[w])[:top]
            out |= {(lang, s, part, item, -v, k + 1) for part, some in (("pair", pairs), ("term", words)) for k, (v, item) in enumerate(some)}
    return out


def test_divergence_of_odd_rows(spark, monkeypatch):
    rng = random.Random(3)
    words = ["Aa", "aa", "é", "É", "日本", "z9z", "İ", "b-c", "K"]
    rows = [(" ".join(rng.choice(words[: 3 + k % 7]) for _ in range(rng.randint(0, 12))), rng.choice(["x", "y", None]), rng.choice(["s", "t", "", None, "u"])) for k in range(150)]
    rows += [(None, "x", "alone"), ("", "empty", "s"), ("one", "empty", "t"), ("aa " * 900, "x", "s"), ("1 2 3", None, None)]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "text string, lang string, source string, n long, term long").repartition(3)
    for least, top in ((3, 2), (1, 50), (1000, 5)):
        got = divergence.divergences(docs, least, top).collect()
        assert {tuple(r) for r in got} == plain_divergence(rows, least, top) and len(got) == len({tuple(r) for r in got})
    assert divergence.divergences(docs.limit(0)).collect() == []
    monkeypatch.setattr(divergence, "BYTES", 3)
    text = "Ab cde é fghijkl. M日本語n o".encode()
    assert [w for c in divergence.terms(text) for w in c] == text.translate(divergence.LETTERS).split()


# ---- the pipeline


def test_near_duplicates_with_its_own_names_as_columns(spark, sf_dir):
    import corpus_pipeline

    text = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(k, t, 1, 2, 3, 4) for k, t in enumerate([text, text, text + " eleven", "quite another text of its own"])], "doc_id long, text string, head int, row int, number int, class_id int")
    left = corpus_pipeline.near_duplicates(spark, docs, sf_dir)
    assert left.columns == docs.columns and sorted(r["doc_id"] for r in left.collect()) == [0, 3]
