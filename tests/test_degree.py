"""Whole plans with known verdicts, on a snapshot made for them."""

import pytest
from pyspark.sql import functions as F

from plinth.operators import degree, solve
from plinth.plans.program import PROGRAM

F26, W27, F27, W28, F28 = "Fall Term 2026", "Winter Term 2027", "Fall Term 2027", "Winter Term 2028", "Fall Term 2028"
C = lambda *n: [f"CMPUT {k}" for k in n]
START = [(F26, C(174) + ["MATH 125", "MATH 154", "STAT 151"]), (W27, C(175, 272) + ["MATH 136"])]
MIDDLE = [(F27, C(201, 204, 200, 291)), (W28, C(301, 333, 355))]
END = [(F28, C(303, 331, 401, 402))]
PLANS = {
    "valid_174": (START + MIDDLE + END, []),
    "valid_275": ([(F26, C(274) + ["MATH 125", "MATH 154", "STAT 151"]), (W27, C(275, 272) + ["MATH 136"]), (F27, C(204, 229, 200, 291)), MIDDLE[1], *END], []),
    "six_400": ([*START, (F27, C(201, 204, 200, 291, 415, 466)), (W28, C(414, 428, 429, 463))], ["requirement_shortfall", "senior_cmput_300_400"]),
    "exclusion": ([(F26, C(174, 274) + ["MATH 125", "MATH 154", "STAT 151"]), START[1], *MIDDLE, *END], ["credit_exclusion", "CMPUT 174", "CMPUT 274"]),
    "prereq_order": ([(F26, C(204, 174) + ["MATH 125", "MATH 154", "STAT 151"]), START[1], (F27, C(201, 200, 291)), MIDDLE[1], *END], ["prereq_unsatisfied", "CMPUT 204"]),
    "coreq": ([*START, (F27, C(291, 204, 200)), (W28, C(201, 229, 301, 333, 355)), *END], ["coreq_unsatisfied", "CMPUT 291"]),
    "units_short": ([*START, *MIDDLE, (F28, C(303, 401, 402))], ["requirement_shortfall", "short 3u"]),
    "twice": (START + MIDDLE + END + [("Winter Term 2029", C(174))], ["duplicate_course", "CMPUT 174"]),
    "ineligible": ([(F26, C(274) + ["MATH 125", "MATH 154", "STAT 151"]), (W27, C(275, 272) + ["MATH 136"]), (F27, C(204, 229, 200, 291, 201)), MIDDLE[1], *END], ["ineligible_course", "CMPUT 201"]),
    "not_offered": ([(F26, START[0][1]), (W27, C(175, 272, 274) + ["MATH 136"]), *MIDDLE, *END], ["CMPUT 274 is not offered in Winter Term 2027; offered: Fall Term 2026"]),
}


@pytest.fixture(scope="module")
def plans(spark):
    rows = [(name, k, term, pos, c) for name, (terms, _) in PLANS.items() for k, (term, courses) in enumerate(terms) for pos, c in enumerate(courses)]
    return spark.createDataFrame(rows, degree.PLAN)


@pytest.fixture(scope="module")
def failures(spark, plans):
    names = sorted({c for terms, _ in PLANS.values() for _, courses in terms for c in courses} | set(PROGRAM.named) | set(PROGRAM.prerequisites))
    catalogue = {c: (c.rsplit(" ", 1)[0], int(c.rsplit(" ", 1)[1]) // 100 * 100, 3.0) for c in names}
    offered = [(c, t) for c in names for t in ((F26,) if c == "CMPUT 274" else (F26, W27))]
    return degree.validate(plans, PROGRAM, catalogue, spark.createDataFrame(offered, "course string, term string"))


def test_verdicts_and_reasons(plans, failures):
    got = {}
    for r in failures.select("plan", degree.rendered().alias("x")).collect():
        got.setdefault(r["plan"], []).append(r["x"])
    for name, (_, reasons) in PLANS.items():
        text = " | ".join(got.get(name, []))
        assert bool(text) == bool(reasons), (name, text)
        assert all(r in text for r in reasons), (name, text)
    assert len(got["six_400"]) == len(got["prereq_order"]) == len(got["units_short"]) == 1
    valid = {r["plan"]: r["valid"] for r in degree.verdicts(plans, failures).collect()}
    assert valid == {name: not reasons for name, (_, reasons) in PLANS.items()}


def test_unverified_notes(plans):
    catalogue = {"CMPUT 415": ("CMPUT", 400), "CMPUT 301": ("CMPUT", 300)}
    notes = degree.unverified(plans, PROGRAM, catalogue).where(F.col("plan") == "six_400").collect()
    assert [r["note"] for r in notes] == ["CMPUT 415: prereq unverified"]


def test_program_totals():
    slots = [s for g in PROGRAM.groups for s in degree.slots_of(g)]
    assert sum(s.units or 3 for s in slots) == 54 and len(slots) == 12
    assert len(set(PROGRAM.named) | set(PROGRAM.prerequisites)) == 31
    assert not degree.fits({"subject": "CMPUT"}, "CMPUT", None)


def test_units_of_courses():
    import itertools
    import random

    from plinth.operators.matching import assign_units

    rng = random.Random(4)

    def short(units, need, place):
        got = [sum(10 * u for u, p in zip(units, place, strict=True) if p == s) for s in range(len(need))]
        return sum((s not in place) if n is None else max(0, 10 * n - g) for s, (n, g) in enumerate(zip(need, got, strict=True)))

    for _ in range(200):
        units = [rng.choice(rng.choice([[3.0], [1.5], [1.5, 3.0, 4.5, 6.0, 0.0]])) for _ in range(rng.randint(0, 5))]
        need = [rng.choice([None, 3.0, 4.5, 9.0]) for _ in range(rng.randint(1, 3))]
        fits = [rng.randrange(1 << len(need)) for _ in units]
        ways = itertools.product(*([None, *(s for s in range(len(need)) if f >> s & 1)] for f in fits))
        place = assign_units(units, need, fits)
        assert all(p is None or f >> p & 1 for p, f in zip(place, fits, strict=True))
        assert all(place.count(s) < 2 for s, n in enumerate(need) if n is None)
        best = min(short(units, need, w) for w in ways if all(w.count(s) < 2 for s, n in enumerate(need) if n is None))
        assert short(units, need, place) == best
    program = degree.Program((), (degree.Group("g", "units_from", units=6, options=("A 1", "B 2")),), units={"A 1": 1.5})
    assert degree.units_of(program, {"A 1": ("A", 100, 6.0), "B 2": ("B", 200, 4.5)}, "A 1") == 1.5
    assert degree.units_of(program, {"B 2": ("B", 200, 4.5)}, "B 2") == 4.5 and degree.units_of(program, {}, "C 3") == 0


def test_units_in_failures(spark):
    program = degree.Program((), (degree.Group("g", "units_from", units=6, options=("A 1", "B 2")),))
    plans = spark.createDataFrame([("p", 0, F26, 0, "A 1"), ("q", 0, F26, 0, "A 1"), ("q", 0, F26, 1, "B 2")], degree.PLAN)
    offered = spark.createDataFrame([("A 1", F26), ("B 2", F26)], "course string, term string")
    got = degree.validate(plans, program, {"A 1": ("A", 100, 1.5), "B 2": ("B", 200, 4.5)}, offered).collect()
    assert [(r["plan"], r["detail"]) for r in got] == [("p", "unmet requirement 'g' (6.0u from A 1, B 2): have 1.5u, short 4.5u")]


def by_states(program, catalogue, seasons, start, policy):
    """The fewest terms, by all sets that can be reached; units of all courses are equal."""
    import itertools

    from plinth.operators.matching import assign

    ours = degree.program_courses(program, catalogue)

    def holds(rule, has):
        if rule is None or (isinstance(rule, dict) and "hs" in rule):
            return True
        if isinstance(rule, str):
            return rule in has or (policy.assume_external and rule not in ours)
        if "pattern" in rule:
            return any(degree.fits(rule["pattern"], *catalogue[c][:2]) for c in has)
        return (any if "one_of" in rule else all)(holds(r, has) for r in rule.get("one_of", rule.get("all_of", [])))

    def done(has):
        slots, bad, _ = degree.requirements(program, has)
        own = sorted(has - bad)
        fits = [sum((c in s.options or degree.fits(s.pattern, *catalogue[c][:2])) << k for k, s in enumerate(slots)) for c in own]
        need = [1 if s.units is None else int(s.units // 3) for s in slots]
        return not (has & bad) and sum(x is not None for x in assign(own, need, fits)) == sum(need)

    level = {frozenset(start)}
    for k in range(policy.horizon + 1):
        if any(done(set(has)) for has in level):
            return max(k, 1)
        season, then = policy.seasons[k % len(policy.seasons)], set()
        for has in level:
            open_ = [c for c in catalogue if c not in has and season in seasons[c] and holds((program.prerequisites.get(c) or degree.Prerequisite()).rule, has)]
            for size in range(int(policy.load // 3) + 1):
                for some in itertools.combinations(open_, size):
                    now = has | set(some)
                    if all(holds((program.prerequisites.get(c) or degree.Prerequisite()).coreq, now) for c in some) and not any(len(now & set(e)) > 1 and set(some) & set(e) for e in program.exclusions):
                        then.add(frozenset(now))
        level = then
    return None


def random_program(rng):
    names = [f"A {100 * rng.randint(1, 4) + k}" for k in range(6)]
    catalogue = {c: ("A", int(c[2:]) // 100 * 100, 3.0) for c in names}
    some = lambda n: tuple(rng.sample(names, n))
    groups = [degree.Group("g", "units_from", units=3 * rng.randint(1, 2), options=some(3)), degree.Group("h", "all_of", members=(some(1)[0], {"one_of": list(some(2))}))]
    if rng.random() < 0.5:
        groups.append(degree.Group("p", "units_from_pattern", units=3, pattern={"subject": "A", "level_gte": rng.choice([200, 300])}))
    rules = [None, None, {"hs": "x"}, "B 1", *names, {"one_of": list(some(2))}, {"all_of": [some(1)[0], {"one_of": list(some(2))}]}, {"pattern": {"level_in": [100, 200]}}]
    prerequisites = {c: degree.Prerequisite(rng.choice(rules), None, rng.choice(rules) if rng.random() < 0.3 else None) for c in names if rng.random() < 0.7}
    exclusions = (some(2),) if rng.random() < 0.5 else ()
    conditionals = (degree.Conditional("n", some(1)[0], rng.choice([None, *names]), "g", some(2)),) if rng.random() < 0.4 else ()
    seasons = {c: frozenset(rng.choice([("Fall",), ("Winter",), ("Fall", "Winter")])) for c in names}
    return degree.Program(tuple(names), tuple(groups), conditionals, exclusions, prerequisites), catalogue, seasons


def test_shortest_plans_of_small_programs():
    import random

    rng, found = random.Random(11), 0
    for _ in range(150):
        program, catalogue, seasons = random_program(rng)
        start = set(rng.sample(sorted(catalogue), rng.choice([0, 0, 1, 2])))
        if any(len(start & set(e)) > 1 for e in program.exclusions) or any(c.ineligible in start for c in program.conditionals):
            continue
        policy = solve.Policy(load=rng.choice([3.0, 6.0]), horizon=7, assume_external=rng.random() < 0.8)
        plan = solve.solve(program, catalogue, seasons, start, policy)
        assert (plan and len(plan)) == by_states(program, catalogue, seasons, start, policy), (program, seasons, start, policy, plan)
        found += plan is not None
        assert plan is None or all(sum(catalogue[c][2] for c in t) <= policy.load for t in plan)
    assert found > 40


def test_units_of_plans():
    program = degree.Program((), (degree.Group("g", "units_from", units=6, options=("A 1", "B 2", "C 3")),))
    catalogue = {"A 1": ("A", 100, 1.5), "B 2": ("B", 200, 4.5), "C 3": ("C", 100, 3.0)}
    seasons = dict.fromkeys(catalogue, frozenset({"Fall", "Winter"}))
    assert solve.solve(program, catalogue, seasons, set()) == [["A 1", "B 2"]]
    assert solve.solve(program, catalogue, seasons, set(), solve.Policy(load=4.5)) == [["A 1"], ["B 2"]]
    assert solve.solve(program, catalogue, seasons, {"A 1", "B 2"}) == [[]]
    assert solve.solve(program, catalogue, seasons, set(), solve.Policy(horizon=0)) is None
    assert solve.solve(program, catalogue, dict.fromkeys(catalogue, frozenset({"Spring"})), set()) is None


def test_round_trips(spark):
    """150 sets of courses taken: every plan is valid, holds nothing twice, keeps the load and begins after what was taken."""
    import random

    from plinth.plans.degrees import CATALOGUE, SCOPE, SEASONS

    rng, sets = random.Random(20260628), {}
    for i in range(150):
        held = set(rng.sample(SCOPE, rng.randint(0, 10)))
        for e in PROGRAM.exclusions:
            held -= set([c for c in e if c in held][1:])
        sets[str(i)] = sorted(held - {"CMPUT 201"} if "CMPUT 275" in held else held)
    policy = solve.Policy(scope=frozenset(SCOPE))
    solved = solve.solve_all(spark.createDataFrame(list(sets.items()), "plan string, taken array<string>"), PROGRAM, CATALOGUE, SEASONS, policy).cache()
    rows = {r["plan"]: r for r in solved.collect()}
    assert len(rows) == 150 and all(r["found"] and len(r["courses"]) == r["terms_to_graduate"] for r in rows.values())
    for plan, r in rows.items():
        new = [c for t in r["courses"] for c in t]
        assert len(new) == len(set(new)) == r["n_courses"] and not set(new) & set(sets[plan]) and all(sum(CATALOGUE[c][2] for c in t) <= 15 for t in r["courses"])
    taken = spark.createDataFrame([(p, c) for p, held in sets.items() for c in held], "plan string, course string")
    offered = spark.createDataFrame([(c, f"{s} Term 2026") for c in SCOPE for s in SEASONS[c]], "course string, term string")
    failures = degree.validate(solve.as_plans(solved, taken), PROGRAM, CATALOGUE, offered)
    assert failures.select("plan", degree.rendered()).collect() == []


def test_flow_and_sets_of_slots_agree(spark):
    import itertools
    import random

    from plinth.operators import matching

    rng = random.Random(6)
    for _ in range(300):
        need = [rng.randint(0, 5) for _ in range(rng.randint(1, 5))]
        supply = {rng.randrange(1 << len(need)): rng.randint(0, 6) for _ in range(rng.randint(0, 6))}
        sets = itertools.product((0, 1), repeat=len(need))
        hall = max(sum(n for n, x in zip(need, s, strict=True) if x) - sum(u for m, u in supply.items() if any(x and m >> k & 1 for k, x in enumerate(s))) for s in sets)
        assert matching.least_shortfall(need, supply) == hall
    need = [rng.randint(1, 3) for _ in range(17)]
    rows = [(p, rng.choice([0, 1 << rng.randrange(17), rng.randrange(1 << 17)])) for p in range(12) for _ in range(rng.randint(1, 30))]
    masks = spark.createDataFrame(rows, "plan long, mask int")
    got = {r["plan"]: r["shortfall"] for r in matching.shortfall(masks, need).collect()}
    assert got.keys() == {p for p, _ in rows}
    for p in got:
        own = [m for q, m in rows if q == p]
        assert got[p] == sum(need) - sum(x is not None for x in matching.assign(own, need, own))
    few = need[:6]
    low = spark.createDataFrame([(p, m & 63) for p, m in rows], "plan long, mask int")
    want = {r["plan"]: r["shortfall"] for r in matching.shortfall(low, few).collect()}
    assert want == {p: matching.least_shortfall(few, {m: [x & 63 for q, x in rows if q == p].count(m) for m in range(64)}) for p in want}
