"""Column libraries and operators on literal rows."""

import itertools
import random
import statistics

import pytest
from pyspark.sql import functions as F

from plinth.functions import stats, terms, text
from plinth.operators import extract, matching, routing, rules
from plinth.plans import texts  # noqa: F401
from plinth.sources import readers


def value(spark, column, **given):
    names = list(given)
    return spark.createDataFrame([tuple(given.values())], ", ".join(f"{n} string" for n in names)).select(column).first()[0]


def test_hash_equals_the_64_bit_one(spark):
    tokens = ["cmput", "174", "a", "thntblere"]
    df = spark.createDataFrame([(t,) for t in tokens], "t string").select("t", text.bucket(F.col("t")).alias("b"), text.bucket(F.col("t"), 256, 5).alias("c"))
    for r in df.collect():
        assert r["b"] == text.token_bucket()(r["t"])
        for seed, size, got in ((0, 1024, r["b"]), (5, 256, r["c"])):
            h = text.HASH_START ^ seed
            for ch in r["t"].encode():
                h = (h ^ ch) * text.HASH_FACTOR & 0xFFFFFFFFFFFFFFFF
            assert got == h % size


@pytest.mark.parametrize(("given", "want"), [("CMPUT 174!", "cmput cmput174 174"), ("a 123 456 b", "a a123 123 456 b"), ("1745", "174"), ("", "")])
def test_glued_tokens(spark, given, want):
    assert " ".join(value(spark, text.glued(text.tokens(F.col("x"))), x=given)) == want


def test_clean(spark):
    assert value(spark, text.clean(F.col("x")), x="  a  b\n c ") == "a b c"
    assert value(spark, text.clean(F.lit(None).cast("string")), x="") == ""


@pytest.mark.parametrize(("label", "code"), [("Spring Term 2026", 1950), ("Fall Term 2026", 1970), ("Winter Term 2027", 1980), ("Whenever", None)])
def test_term_codes(spark, label, code):
    assert value(spark, terms.term_code(F.col("x")), x=label) == code


def test_levels(spark):
    assert [value(spark, terms.level(F.col("x")), x=x) for x in ("174", "403A", "99", "A1")] == [100, 400, 0, None]


@pytest.mark.parametrize("n", [1, 2, 3, 4, 99, 100, 250])
def test_exclusive_quantiles(spark, n):
    xs = [random.Random(n).random() * 100 for _ in range(n)]
    got = stats.exclusive_quantiles(spark.createDataFrame([("k", x) for x in xs], "k string, x double"), ["k"], "x", [50, 95]).first()
    want = statistics.quantiles(xs, n=100) if n > 1 else [xs[0]] * 99
    assert (got["p50"], got["p95"]) == (round(want[49], 4), round(want[94], 4))


def test_routes(spark):
    asked = {"When is it offered?": "rag", "Which prerequisite rule applies?": "cag", "hello": "rag", "Build a plan for me": "compound", "When is the prereq offered": "compound"}
    got = routing.classify(spark.createDataFrame([(q,) for q in asked], "q string"), "q").collect()
    assert {r["q"]: r["route"] for r in got} == asked


def test_sweep_and_flips(spark):
    from plinth.operators import routing
    from plinth.plans.texts import PARAPHRASES, QUESTIONS

    questions = spark.createDataFrame([(q,) for q in QUESTIONS], "question string")
    assert {r["margin"]: r["compound_share"] for r in routing.margin_sweep(questions, "question").collect()} == {0: 0.182, 1: 0.273, 2: 0.273}
    assert not any(r["flipped"] for r in routing.paraphrase_flips(spark.createDataFrame(PARAPHRASES, "base string, text string")).collect())


def test_clauses(spark):
    from plinth.plans.texts import CLAUSES

    rows = spark.createDataFrame(list(enumerate(CLAUSES, 1)), "id int, description string")
    got = {r["id"]: r for r in extract.clauses(rows, "id", "description").collect()}
    assert got[1]["prereq_raw"] == "CMPUT 174." and got[1]["coreq_raw"] == "MATH 125." and got[1]["credit_exclusion_raw"] == "Credit cannot be obtained for both CMPUT 174 and 274."
    assert got[2]["prereq_raw"] == got[2]["coreq_raw"] == "STAT 151 or 235." and got[2]["combined"]
    assert got[3]["prereq_raw"] == "CMPUT 204;" and got[3]["coreq_raw"] is None
    assert got[4]["prereq_raw"] is None and got[5]["prereq_raw"] is None and not got[5]["combined"]


def test_section_cells(spark):
    cell = lambda x: tuple(value(spark, extract.section_cell(F.col("x")), x=x))
    assert cell("LEC A1 (12345)") == ("LEC", "A1", "12345")
    assert cell("Online Lab  B02 (9z)") == ("Online Lab", "B02", "9z")
    assert cell("SEM X1") == ("SEM", "X1", None)
    assert cell("LEC") == ("LEC", None, None)


def test_meetings(spark):
    cells = [(1, 0, "date", "2026-09-01 - 2026-12-08 (MWF)"), (1, 1, "time", "9:00 - 9:50"), (1, 2, "date", "2026-09-03"), (2, 0, "time", "8:00 - 9:00")]
    got = extract.meetings(spark.createDataFrame(cells, "k int, pos int, kind string, text string"), "k").orderBy("pos").collect()
    assert [(tuple(r["date"]), tuple(r["time"])) for r in got] == [(("2026-09-01", "2026-12-08", "MWF"), ("09:00", "09:50")), (("2026-09-03", "2026-09-03", None), (None, None))]
    assert tuple(map(list, value(spark, extract.expand_days(F.col("x")), x="MW, S"))) == (["M", "W", "S"], ["S"])


def test_outline_and_headings(spark):
    html = '<h1>A</h1><script>var t="</p>"</script><p>one <b>two</b></p><h2>B</h2><ul><li>x</li></ul>'
    got = extract.outline(spark.createDataFrame([(1, html), (2, None)], "page_id long, html string"))
    assert [(r["tag"], r["text"], r["heading"]) for r in got.orderBy("pos").collect()] == [("h1", "A", "A"), ("p", "one two", "A"), ("h2", "B", "A / B"), ("li", "x", "A / B")]
    carried = extract.carried_headings(got.select("page_id", "pos", "tag", "text"), "page_id").orderBy("pos").collect()
    assert [r["term"] for r in carried] == [None, None, "B", "B"]


def test_rules(spark):
    rule = {"one_of": [{"all_of": ["a", {"hs": "m"}]}, {"pattern": {"level_in": [300]}}]}
    ok = lambda held, flags: value(spark, rules.compile_rule(rule, lambda c: F.lit(c in held), lambda p: F.lit("p" in held), flags), x="")
    assert [ok("a", {}), ok("a", {"m": True}), ok("p", {}), ok("", {"m": True})] == [False, True, True, False]
    assert value(spark, rules.compile_rule({"one_of": []}, None, None, {}), x="") is False
    assert value(spark, rules.compile_rule({"all_of": []}, None, None, {}), x="") is True
    assert rules.leaves(rule) == ["a"] and rules.describe(rule) == "one of (a and high-school m, any 300-level course)"
    with pytest.raises(ValueError):
        rules.compile_rule({"some": []}, None, None, {})
    with pytest.raises(TypeError):
        rules.compile_rule(3, None, None, {})


def test_matching_against_all_assignments(spark):
    rng = random.Random(3)
    need = [1, 2, 1]
    cases = [[rng.randint(0, 7) for _ in range(rng.randint(1, 5))] for _ in range(25)]
    rows = [(p, c, m) for p, masks in enumerate(cases) for c, m in enumerate(masks)]
    df = spark.createDataFrame(rows, "plan long, course long, mask int")
    least = {}
    for p, masks in enumerate(cases):
        best = 99
        for slots in itertools.product(range(-1, 3), repeat=len(masks)):
            if all(s < 0 or m >> s & 1 for s, m in zip(slots, masks, strict=True)):
                best = min(best, sum(max(0, n - slots.count(k)) for k, n in enumerate(need)))
        least[p] = best
    assert {r["plan"]: r["shortfall"] for r in matching.shortfall(df, need).collect()} == least
    filled = {p: 0 for p in least}
    for r in matching.assignments(df, need).collect():
        filled[r["plan"]] += r["slot"] is not None
    assert {p: sum(need) - n for p, n in filled.items()} == least


def test_manifest_and_listing(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text('{"url": "u", "ok": true, "path": "x/cmput__174.html", "status": 1}\n\nbroken\n{"url": "u", "ok": true, "path": "x/cmput__174.html", "status": 2}\n{"url": "v", "ok": false}\n')
    got = readers.manifest(spark, str(tmp_path / "m.jsonl"))
    assert [(r["url"], r["status"]) for r in got.collect()] == [("u", 2)]
    files = spark.createDataFrame([("x/cmput__174.html",), ("x/math__125.html",)], "path string")
    listed = {r["path"]: (r["subject"], r["number"], r["status"]) for r in readers.with_listing(got, files).collect()}
    assert listed == {"x/cmput__174.html": ("cmput", "174", 2), "x/math__125.html": ("math", "125", None)}
    assert value(spark, readers.allowed(F.col("x"), ["/admin"]), x="http://a/admin/x") is False


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("s1", 1, None), ("s2", 2, "b")], "snapshot_id string, n int, x string")
    readers.write_json(df, str(tmp_path / "j"))
    assert '"x":null' in "".join(p.read_text() for p in (tmp_path / "j").glob("part*"))
    readers.write_snapshot(df, str(tmp_path / "p"))
    readers.write_snapshot(df.where("n = 2").withColumn("n", F.lit(3)), str(tmp_path / "p"))
    assert {(r["snapshot_id"], r["n"]) for r in spark.read.parquet(str(tmp_path / "p")).collect()} == {("s1", 1), ("s2", 3)}
    readers.write_csv(df, str(tmp_path / "c"))
    assert readers.markdown(df.orderBy("n")).splitlines()[2] == "| s1 | 1 |  |"


def test_incremental_ingestion(spark, tmp_path):
    from plinth.streaming.ingest import ingest

    source = tmp_path / "in"
    source.mkdir()
    run = lambda: ingest(spark, str(source), "k int, v string", str(tmp_path / "out"), str(tmp_path / "ck"), "k").awaitTermination()
    (source / "a.json").write_text('{"k": 1, "v": "a"}\n{"k": 1, "v": "a"}\n')
    run()
    (source / "b.json").write_text('{"k": 1, "v": "z"}\n{"k": 2, "v": "b"}\n')
    run()
    run()
    assert sorted((r["k"], r["v"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(1, "a"), (2, "b")]


def test_markdown_cuts_nothing(spark):
    assert len(readers.markdown(spark.range(5), most=5).splitlines()) == 7
    with pytest.raises(ValueError, match="more than 4 rows"):
        readers.markdown(spark.range(5), most=4)


def test_exclusive_quantiles_of_ties_and_slices(spark):
    import random
    import statistics

    from plinth.functions.stats import exclusive_quantiles

    rng = random.Random(2)
    groups = {"many": [rng.gauss(0, 5) for _ in range(900)], "ties": [1.0] * 500 + [2.0] * 3 + [-1.0], "two": [3.0, 8.0], "one": [4.0], "three": [1.0, 5.0, 5.0]}
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [("none", None), ("two", None)]
    got = {r["k"]: (r["p50"], r["p95"]) for r in exclusive_quantiles(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", [50, 95]).collect()}
    want = {k: tuple(round(statistics.quantiles(vs, n=100)[p - 1], 4) if len(vs) > 1 else vs[0] for p in (50, 95)) for k, vs in groups.items()}
    assert got.keys() == want.keys() and all(abs(a - b) < 2e-4 for k in want for a, b in zip(got[k], want[k], strict=True))
