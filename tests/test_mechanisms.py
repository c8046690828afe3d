"""Closure, trees, kept index, versioned snapshots, the manifest as a stream, YAML as a source, models plugged into SQL."""

import json
import random
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from plinth.functions import seams
from plinth.operators import closure, inverted, reports, retrieval, tree
from plinth.plans.program import PROGRAM
from plinth.sources import snapshots, yaml_source
from plinth.sources.scratch import scratch
from plinth.streaming import ingest, manifest


# ---- closure


def test_closure_and_cycles(spark):
    rng = random.Random(1)
    edges = {(rng.randrange(14), rng.randrange(14)) for _ in range(16)} | {(20, 21), (21, 22), (22, 20), (30, 30)}
    want = {e: 1 for e in edges}
    last, k = set(edges), 1
    while last:
        k += 1
        last = {(a, d) for a, b in last for c, d in edges if b == c} - want.keys()
        want |= dict.fromkeys(last, k)
    rows = [*edges, (None, 3), (4, None), (20, 21)]
    closed = closure.closure(spark.createDataFrame(rows, "course int, needs int"))
    assert {(r["course"], r["needs"]): r["steps"] for r in closed.collect()} == want
    found = {r["course"]: r["steps"] for r in closure.cycles(closed).collect()}
    assert found == {a: n for (a, b), n in want.items() if a == b} and found[30] == 1 and found[20] == 3
    assert closure.closure(spark.createDataFrame([], "course int, needs int")).collect() == []
    with pytest.raises(RuntimeError):
        closure.closure(spark.createDataFrame(rows, "course int, needs int"), most=1)


def test_rounds_of_the_closure_go_over_needed_courses_only(spark, monkeypatch):
    written, keep = [], closure.kept

    def count(df, name):
        out = keep(df, name)
        written.append((name, out.count()))
        return out

    monkeypatch.setattr(closure, "kept", count)
    rows = [(0, 1), (1, 2), (2, 3), *((100 + k, 0) for k in range(50))]
    closed = {(r["course"], r["needs"]): r["steps"] for r in closure.closure(spark.createDataFrame(rows, "course int, needs int")).collect()}
    assert closed == {(a, b): b - a for a in range(3) for b in range(a + 1, 4)} | {(100 + k, b): b + 1 for k in range(50) for b in range(4)}
    assert sum(n for name, n in written if name == "reached") <= 3


@pytest.mark.parametrize("kind", ["int", "string"])
def test_reached_is_the_closure_without_steps(spark, monkeypatch, kind):
    monkeypatch.setattr(closure, "MEMBERS", 3)
    rng = random.Random(3)
    cycle = lambda *x: {*zip(x, (*x[1:], x[0]), strict=True)}
    edges = cycle(*range(40, 47)) | cycle(60, 61, 62) | cycle(63, 64) | {(45, 63), (63, 30), (62, 41), (61, 70), (70, 71), (71, 40), (99, 42), (99, 71), (98, 98), (97, 98), (96, 97)}
    edges |= {(rng.randrange(14), rng.randrange(14)) for _ in range(16)}
    edges = {(str(a), str(b)) for a, b in edges} if kind == "string" else edges
    want = set(edges)
    while more := {(a, d) for a, b in want for c, d in edges if b == c} - want:
        want |= more
    rows = [*edges, (None, next(iter(edges))[0]), next(iter(edges))]
    got = [tuple(r) for r in closure.reached(spark.createDataFrame(rows, f"course {kind}, needs {kind}")).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert closure.reached(spark.createDataFrame([], "course int, needs int")).collect() == []


def test_courses_that_need_each_other_are_followed_as_one(spark, monkeypatch):
    written, keep = [], closure.kept

    def count(df, name):
        out = keep(df, name)
        written.append(out.count())
        return out

    monkeypatch.setattr(closure, "kept", count)
    edges, n = [(k, (k + 1) % 30) for k in range(30)] + [(k, k * 7 % 30) for k in range(30)] + [(100 + k, k) for k in range(30)], 60 * 30
    assert closure.reached(spark.createDataFrame(edges, "course int, needs int")).count() == n
    assert max(written) <= len(edges)


def test_closure_of_the_program(spark):
    closed = closure.closure(closure.program_edges(spark, PROGRAM))
    needs = {r["needs"] for r in closed.where("course = 'CMPUT 401'").collect()}
    assert {"CMPUT 301", "CMPUT 201", "CMPUT 275", "CMPUT 175", "CMPUT 174", "CMPUT 274"} <= needs and "CMPUT 204" not in needs
    assert closure.cycles(closed).collect() == []


# ---- trees


def test_nodes_and_ancestors(spark):
    html = "<html><body><h1>T</h1><div id=a><p>one<b>two<br>three<p>four</div></i><p>five"
    pages = spark.createDataFrame([(1, html), (1, html), (2, None), (3, ""), (4, "<li><img><script>'</li><p>'</script>x")], "page_id int, html string")
    every = tree.nodes(pages).cache()
    rows = {(r["page_id"], r["pre"]): r for r in every.collect()}
    assert [rows[1, n]["tag"] for n in range(9)] == ["html", "body", "h1", "div", "p", "b", "br", "p", "p"]
    assert (rows[1, 3]["post"], rows[1, 4]["post"], rows[1, 6]["post"], rows[1, 8]["post"], rows[1, 0]["post"]) == (7, 7, 6, 8, 8)
    assert (rows[1, 5]["text"], rows[1, 7]["text"], rows[1, 7]["depth"], rows[1, 8]["depth"]) == ("twothree", "four", 5, 2)
    assert every.count() == 2 * 9 + 3 and rows[4, 2]["tag"] == "script" and rows[4, 2]["text"] == "'</li><p>'"
    paths = every.join(tree.paths(every, every), ["row", "pre"]).where("page_id = 1 and pre = 7").collect()
    assert [r["path"] for r in paths] == ["html>body>div>p>b"] * 2
    inside = tree.ancestors(every.where("tag = 'p'"), every.where("tag = 'div'"))
    assert inside.count() == 2 * 2


# ---- the kept index


def test_kept_index_gives_the_same_rows(spark):
    rng = random.Random(3)
    word = lambda: rng.choice(["red", "blue", "loom", "wheel", "a", "the"]) if rng.random() < 0.5 else "".join(rng.choice("abc") for _ in range(4))
    texts = [" ".join(word() for _ in range(rng.randint(0, 30))) for _ in range(90)] + [None, "", "red loom 123", "red loom 123"]
    docs = spark.createDataFrame([(f"d{k}", t, 1, 2) for k, t in enumerate(texts)], "id string, text string, keys int, k int").repartition(3)
    asked = spark.createDataFrame([(k, " ".join(word() for _ in range(6))) for k in range(12)] + [(12, ""), (13, None), (14, "zzz"), (15, "loom 123")], "q int, text string")
    path = scratch(spark, "test")
    for block in (7, 512):
        inverted.build(docs, "id", "text", path, size=64, block=block)
        for k in (1, 4):
            want = sorted(tuple(r) for r in retrieval.search(docs, asked, "id", "q", k=k, size=64).select("q", "id", "score", "rank").collect())
            assert sorted(tuple(r) for r in inverted.search(spark, path, asked, "q", "id", k=k).select("q", "id", "score", "rank").collect()) == want and len(want) > 12 * k
    inverted.build(docs.limit(0), "id", "text", path, size=64)
    assert inverted.search(spark, path, asked, "q", "id").collect() == []


def test_blocks_without_hope_are_not_opened():
    best = retrieval.Best(1, 2)
    best.add(0, np.array([0.5, 0.9]), np.array([3, 1]))
    best.add(0, np.array([0.5, 0.1]), np.array([2, 9]))
    assert best.keys[0].tolist() == [1, 2] and best.least[0] == 0.5


def test_dense_top_k(spark):
    rng = np.random.default_rng(2)
    v = rng.integers(-3, 4, (60, 4)).astype(float)
    rows = [(k, x.tolist()) for k, x in enumerate(v)] + [(100, None), (101, [1.0, None, 2.0, 3.0]), (102, [1.0, 2.0])]
    vectors = spark.createDataFrame(rows, "vec_id int, v array<double>").repartition(3)
    queries = vectors.where("vec_id % 7 = 0 or vec_id > 99").selectExpr("vec_id AS query_id", "v AS q")
    want = set()
    for q in range(0, 60, 7):
        others = sorted((-round(float(v[q] @ v[k]), 5), k) for k in range(60) if k != q)[:5]
        want |= {(q, k, -s, r + 1) for r, (s, k) in enumerate(others)}
    for block in (160, 32 << 20):
        assert {tuple(r) for r in retrieval.dense_top_k(queries, vectors, 5, block=block).select("query_id", "vec_id", "score", "rank").collect()} == want
    assert retrieval.dense_top_k(queries.limit(0), vectors).collect() == []


# ---- reports


def test_failure_queue(spark):
    rows = spark.createDataFrame([("a", f"m{k:03d}") for k in range(300)] + [("b", None), (None, "x"), (None, "y"), ("a", "m000")], "scope string, message string")
    got = {r["scope"]: (r["total"], r["first"]) for r in reports.failure_queue(rows, "scope", F.col("message"), 3).collect()}
    assert got == {"a": (301, ["m000", "m000", "m001"]), "b": (1, []), None: (2, ["x", "y"])}
    assert reports.failure_queue(rows.limit(0), "scope", F.col("message"), 3).collect() == []


# ---- versioned snapshots


def test_snapshots(spark, tmp_path):
    store = snapshots.Store(spark, f"{tmp_path}/s")
    rows = lambda *x: spark.createDataFrame([*x], "k string, v int")
    assert store.commits() == []
    with pytest.raises(KeyError):
        store.read("a")
    assert store.write(rows(("x", 1), ("y", 2)), "a", "b1") == 1
    assert store.write(rows(("x", 9)), "a", "b1") == 1  # a batch tried again
    assert store.write(rows(("x", 1), ("z", 3)), "a", "b2") == 2 and store.write(rows(("q", 0)), "b") == 3
    assert sorted(map(tuple, store.read("a").collect())) == [("x", 1), ("z", 3)] and sorted(map(tuple, store.read("a", 1).collect())) == [("x", 1), ("y", 2)]
    assert {r["k"]: r["changed"] for r in store.drift(("a", 1), ("a", 2), ["k"], "v").collect()} == {"x": False, "y": True, "z": True}
    rows(("lost", 1)).write.parquet(f"{tmp_path}/s/data/stopped")  # a writer that stopped before its commit
    assert store.read("a").count() == 2 and store.sweep() == 1 and store.sweep() == 0 and store.read("a").count() == 2
    with pytest.raises(KeyError):
        store.read("b", 2)


def test_two_writers(spark, tmp_path):
    """Each has its own number, none is lost; of one batch written by both, one counts."""
    stores = [snapshots.Store(spark, f"{tmp_path}/s") for _ in range(2)]
    got: list = []

    def write(k):
        for i in range(3):
            got.append(stores[k].write(spark.range(i + 1).toDF("k"), f"w{k}", f"{k}-{i}"))

    threads = [threading.Thread(target=write, args=(k,)) for k in range(2)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(got) == [1, 2, 3, 4, 5, 6] == [c["version"] for c in stores[0].commits()]
    assert stores[1].read("w0").count() == stores[1].read("w1").count() == 3
    taken = stores[0]._put(7, {"snapshot_id": "x", "folder": "data/none", "batch": None}), stores[1]._put(7, {"snapshot_id": "y", "folder": "data/none", "batch": None})
    assert taken == (True, False) and stores[0].commits()[-1]["snapshot_id"] == "x"


# ---- streams


def line(url, at, path, ok=True):
    return json.dumps({"url": url, "ok": ok, "fetched_at": at, "path": path, "status": 200, "bytes": 5})


def test_manifest_over_restarts(spark, tmp_path):
    source, sink, checkpoint = (f"{tmp_path}/{x}" for x in ("in", "out", "check"))
    (tmp_path / "in").mkdir()
    put = lambda name, *lines: (tmp_path / "in" / name).write_text("\n".join(lines) + "\n")
    go = lambda: manifest.keep_manifest(spark, source, sink, checkpoint).awaitTermination()
    held = lambda: {r["url"]: (r["path"], r["n"]) for r in manifest.current(spark, sink).collect()}
    put("1.jsonl", line("a", "2026-01-02", "a2"), line("b", "2026-01-01", "b1"), line("c", "2026-01-01", "c1", ok=False), "{broken", "", '{"ok": true}')
    go()
    assert held() == {"a": ("a2", 1), "b": ("b1", 1)}
    put("2.jsonl", line("a", "2026-01-01", "late"), line("b", "2026-01-03", "b3"), line("b", "2026-01-02", "b2"), line("c", "2026-01-02", "c2"))
    go()  # another query, the same checkpoint
    assert held() == {"a": ("a2", 1), "b": ("b3", 3), "c": ("c2", 1)}
    go()
    put("3.jsonl", line("a", "2026-01-04", "a4"), line("a", "2026-01-04", "fail", ok=False))
    go()
    assert held() == {"a": ("a4", 3), "b": ("b3", 3), "c": ("c2", 1)}  # the late success was counted, though it changed nothing


def test_windowed_counts(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [("2026-01-01T00:10:00", "a"), ("2026-01-01T00:50:00", "a"), ("2026-01-01T01:10:00", "b"), ("2026-01-01T09:00:00", "a")]
    (tmp_path / "in" / "1.json").write_text("\n".join(json.dumps({"at": t, "k": k}) for t, k in rows))
    stream = spark.readStream.schema("at timestamp, k string").json(f"{tmp_path}/in")
    run = lambda: ingest.windowed_counts(stream, "at", "k").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    run()
    (tmp_path / "in" / "2.json").write_text(json.dumps({"at": "2026-01-01T00:20:00", "k": "a"}) + "\n" + json.dumps({"at": "2026-01-01T12:00:00", "k": "b"}))
    run()
    got = {(str(r["start"])[11:16], r["k"]): r["n"] for r in spark.read.parquet(f"{tmp_path}/out").select("window.start", "k", "n").collect()}
    assert got[("00:00", "a")] == 2 and got[("01:00", "b")] == 1  # the late row came behind the watermark


# ---- YAML


def test_yaml_source(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    files = {
        "a.plan.yaml": "plan_id: x\nextra: {1: 2026-01-01}\ntaken: [T 1]\nterms:\n- term: Fall\n  courses: [A 1, B 2]\n", "b.plan.yaml": "expected: valid\n", "broken.yaml": "terms: [\n", "date.yml": "terms: 2026-13-45\n",
        "empty.yaml": "", "sub/q.yaml": "- {id: 1, type: factual_offered, text: 'Is A 1 offered?', course: A 1, term: Fall}\n- {id: 2, type: plan_validity, plan_id: x}\n", "note.txt": "no yaml",
    }
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    rows = yaml_source.yaml_files(spark, str(tmp_path))
    got = {r["file"].removeprefix(f"{tmp_path}/"): r for r in rows.collect()}
    assert got.keys() == files.keys() - {"note.txt"}
    assert {k for k, r in got.items() if r["error"]} == {"broken.yaml", "date.yml"} and got["broken.yaml"]["data"] is None
    assert json.loads(got["a.plan.yaml"]["data"])["extra"] == {"1": "2026-01-01"} and got["empty.yaml"]["data"] == "null"
    plans = [tuple(r) for r in yaml_source.plans_of(rows).orderBy("term_idx", "pos").collect()]
    assert plans == [("x", -1, None, 0, "T 1"), ("x", 0, "Fall", 0, "A 1"), ("x", 0, "Fall", 1, "B 2")]
    asked = [tuple(r)[1:] for r in yaml_source.questions_of(yaml_source.yaml_files(spark, str(tmp_path), "q*")).orderBy("id").collect()]
    assert asked == [("1", "factual_offered", "Is A 1 offered?", "A 1", "Fall", None), ("2", "plan_validity", None, None, None, "x")]
    assert yaml_source.yaml_files(spark, f"{tmp_path}/b.plan.yaml").count() == 1
    with pytest.raises(Exception, match="FileNotFound"):
        yaml_source.yaml_files(spark, f"{tmp_path}/none").count()


def test_filters_on_files_are_judged_before_reading(tmp_path):
    from pyspark.sql.datasource import EqualTo, GreaterThan, In, StringEndsWith

    for name in ("a.yaml", "b.yaml", "c.yml"):
        (tmp_path / name).write_text("x: 1")
    names = lambda *filters: ([*(r := yaml_source.YamlReader(str(tmp_path), None)).pushFilters(list(filters))], [p.value.rsplit("/", 1)[1] for p in r.partitions()])
    assert names(StringEndsWith(("file",), "b.yaml")) == ([], ["b.yaml"])
    assert names(In(("file",), (f"{tmp_path}/a.yaml", f"{tmp_path}/c.yml")), EqualTo(("file",), f"{tmp_path}/c.yml")) == ([], ["c.yml"])
    left, kept = names(GreaterThan(("file",), "x"))
    assert len(left) == 1 and len(kept) == 3


# ---- models


def test_models_of_ones_own(spark):
    def sizes(width: int = 2):
        return lambda texts: np.array([[len(t)] * width for t in texts], float)

    def shy():
        def answer(prompt):
            if "secret" in prompt:
                raise PermissionError(prompt)
            return prompt.upper(), 1, 2, 3

        return answer

    seams.EMBEDDERS["sizes"], seams.PROVIDERS["shy"] = sizes, shy
    seams.register(spark, "sizes", "shy", "own_embed", "own_answer", width=3)
    rows = spark.createDataFrame([(1, "ab"), (2, None), (3, "a secret")], "id long, prompt string")
    got = {r["id"]: r["v"] for r in spark.sql("SELECT id, own_embed(prompt) AS v FROM {rows}", rows=rows).collect()}
    assert got == {1: [2.0] * 3, 2: [0.0] * 3, 3: [8.0] * 3}
    said = sorted(tuple(r) for r in spark.sql("SELECT * FROM own_answer(TABLE({rows}))", rows=rows).collect())
    assert said == [(1, "AB", 1, 2, 3, None), (2, "", 1, 2, 3, None), (3, None, 0, 0, 0, "PermissionError")]
    seams.register(spark)
    v = spark.sql("SELECT plinth_embed('Red loom red') AS v, plinth_embed('') AS none").first()
    assert abs(sum(x * x for x in v["v"]) - 1) < 1e-12 and len(v["v"]) == 1024 and not any(v["none"])
