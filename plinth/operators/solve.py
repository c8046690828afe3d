"""Shortest plans for a whole program: branch and bound over sets of courses, one term at a time, for the fewest terms.

Held courses are bits of one number. For a number of terms, a search goes term by term through the sets that can be taken, and turns back where what
is short, in units, can't be made up: for each later term, what even all courses that rules and seasons let one hold by then leave short must fit into
the load of the terms after it. States found dead are not entered again. Courses that rules, slots, seasons and units don't tell apart are taken in
one order only; a term is filled up unless what is left could exclude something later.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .degree import Catalogue, Program, Slot, fits, program_courses, requirements, units_of
from .matching import HALL_SLOTS, assign_units, least_shortfall


@dataclass(frozen=True)
class Policy:
    """assume_external: courses outside the program are held by all. scope: what may be planned, else all courses of the program."""

    seasons: tuple[str, ...] = ("Fall", "Winter")
    load: float = 15.0
    horizon: int = 12
    assume_external: bool = True
    scope: frozenset[str] | None = None


def term_names(n: int, seasons: tuple[str, ...] = ("Fall", "Winter")) -> list[str]:
    return [f"Term {k + 1} ({seasons[k % len(seasons)]})" for k in range(n)]


class Case:
    """A search with the slots of one choice of conditionals: courses of ``must`` are in the plan, those of ``barred`` aren't."""

    def __init__(self, program: Program, catalogue: Catalogue, seasons: dict[str, frozenset[str]], taken: frozenset[str], policy: Policy, must: frozenset[str], barred: frozenset[str]):
        self.policy, self.catalogue, self.ours = policy, catalogue, program_courses(program, catalogue)
        self.slots, ineligible, _ = requirements(program, set(taken | must))
        gone = {c for e in program.exclusions if taken & set(e) for c in e} | ineligible | barred
        new = sorted(c for c in (policy.scope or self.ours) - taken - gone if seasons.get(c, frozenset()) & set(policy.seasons))
        self.names = new + sorted(taken)
        self.bit = {c: 1 << k for k, c in enumerate(self.names)}
        self.held = sum(self.bit[c] for c in taken)
        self.fit = [0 if c in ineligible else self._mask(self.slots, c) for c in self.names]
        self.units = [round(10 * units_of(program, catalogue, c)) for c in self.names]
        self.load = round(10 * policy.load)
        self.uses: list[set] = [set() for _ in self.names]  # where rules name a course
        rule = {c: program.prerequisites.get(c) for c in new}
        self.before = [self._compile(x and x.rule, (k, 0)) for k, x in enumerate(rule.values())]
        self.along = [self._compile(x and x.coreq, (k, 1)) for k, x in enumerate(rule.values())]
        self.open_in = [sum(self.bit[c] for c in new if s in seasons[c]) for s in policy.seasons]
        self.clash = [sum({self.bit.get(o, 0) for e in program.exclusions if c in e for o in set(e) - {c}}) for c in self.names]
        self.must = sum(self.bit.get(c, 0) for c in must)
        self.possible = all(c in self.bit for c in must)
        needs = [min((u for u, f in zip(self.units, self.fit, strict=True) if f >> k & 1), default=1) if s.units is None else round(10 * s.units) for k, s in enumerate(self.slots)]
        self.uniform = len({u for u, f in zip(self.units, self.fit, strict=True) if f}) == 1 and all(n % max(self.units) == 0 for n in needs)
        self.hall = len(self.slots) <= HALL_SLOTS
        sets = np.arange(1 << len(self.slots) if self.hall else 1)
        self.needs = needs
        self.need = sum((n * (sets >> k & 1) for k, n in enumerate(needs)), np.zeros(len(sets), np.int64))
        self.cover = [np.where(sets & f, u, 0) for f, u in zip(self.fit, self.units, strict=True)]
        useful, more = 0, sum(1 << k for k in range(len(new)) if self.fit[k]) | self.must
        while more & ~useful:
            useful |= more
            more = sum(1 << k for k in range(len(new)) if any(useful >> at[0] & 1 for at in self.uses[k]))
        self.useful = useful & ((1 << len(new)) - 1)
        self.height = [0] * len(self.names)
        for _ in range(len(new)):
            height = [1 + max((self.height[at[0]] for at in u if at[0] != k), default=-1) for k, u in enumerate(self.uses)]
            if height == self.height or max(height, default=0) > policy.horizon:
                break
            self.height = height
        kind = lambda k: (self.fit[k], self.units[k], tuple(o >> k & 1 for o in self.open_in), repr(self.before[k]), repr(self.along[k]), tuple(sorted(self.uses[k], key=repr)), self.clash[k], k if self.clash[k] or self.must >> k & 1 or any(at[2] is None for at in self.uses[k]) else -1)
        order = sorted((k for k in range(len(new)) if self.useful >> k & 1), key=lambda k: (-self.height[k], not self.fit[k], bin(self.fit[k]).count("1"), k))
        last: dict = {}
        self.order, self.twin = order, [-1] * len(self.names)  # twin: the equal course that goes before
        for k in order:
            self.twin[k] = last.get(kind(k), -1)
            last[kind(k)] = k

    def _mask(self, slots: list[Slot], c: str) -> int:
        return sum((c in s.options or fits(s.pattern, *self.catalogue.get(c, (None, None))[:2])) << k for k, s in enumerate(slots))

    def _compile(self, rule, owner, node=()):
        """True, False or (how many of its parts hold, bits, rules): any one or all of them."""
        if rule is None or (isinstance(rule, dict) and "hs" in rule):
            return True
        if isinstance(rule, str):
            if rule not in self.bit:
                return self.policy.assume_external and rule not in self.ours
            self.uses[self.names.index(rule)].add((*owner, None))
            return (any, self.bit[rule], ())
        if "pattern" in rule:
            some = [k for k, c in enumerate(self.names) if fits(rule["pattern"], *self.catalogue.get(c, (None, None))[:2])]
            for k in some:
                self.uses[k].add((*owner, node))
            return (any, sum(1 << k for k in some), ()) if some else False
        how = any if "one_of" in rule else all
        bits, rules = 0, []
        for i, r in enumerate(rule["one_of" if how is any else "all_of"]):
            if how is any and isinstance(r, str) and r in self.bit:
                self.uses[self.names.index(r)].add((*owner, node))
                bits |= self.bit[r]
            else:
                rules.append(self._compile(r, owner, (*node, i)))
        if (how is any) in rules:
            return how is any
        rules = tuple(r for r in rules if not isinstance(r, bool))
        return (how, bits, rules) if bits or rules else how is all

    def holds(self, rule, has: int) -> bool:
        if isinstance(rule, bool):
            return rule
        how, bits, rules = rule
        return bool(bits & has) or any(self.holds(r, has) for r in rules) if how is any else all(self.holds(r, has) for r in rules)

    def open(self, k: int, has: int, exclusive: bool = True) -> int:
        """What can be taken in term k by one who has these, if all of it is taken together; with or without regard to exclusions."""
        some = 0
        for c in _bits(self.open_in[k % len(self.open_in)] & self.useful & ~has):
            if not (exclusive and self.clash[c] & has) and self.holds(self.before[c], has):
                some |= 1 << c
        while True:
            kept = sum(1 << c for c in _bits(some) if self.holds(self.along[c], has | some))
            if kept == some:
                return some
            some = kept

    def short(self, has: int) -> int:
        """Tenths of units that stay short at least, were courses divisible."""
        if self.hall:
            return int((self.need - sum((self.cover[c] for c in _bits(has)), np.zeros(len(self.need), np.int64))).max(initial=0))
        supply: dict[int, int] = {}
        for c in _bits(has):
            supply[self.fit[c]] = supply.get(self.fit[c], 0) + self.units[c]
        return least_shortfall(self.needs, supply)

    def done(self, has: int) -> bool:
        if self.must & ~has or self.shortage(has):
            return False
        if self.uniform:
            return True
        some = [c for c in _bits(has) if self.fit[c]]
        place = assign_units([self.units[c] / 10 for c in some], [s.units for s in self.slots], [self.fit[c] for c in some])
        earned = [sum(self.units[c] for c, p in zip(some, place, strict=True) if p == k) for k in range(len(self.slots))]
        return all(k in place if s.units is None else earned[k] >= round(10 * s.units) for k, s in enumerate(self.slots))

    def hopeless(self, k: int, n: int, has: int) -> bool:
        """By what stays short of all that could be held after each of the terms k to n - 1."""
        reach = has
        for j in range(k, n + 1):
            if self.shortage(reach) > (n - j) * self.load or (j == n and self.must & ~reach):
                return True
            if j < n:
                reach |= self.open(j, reach, False)
        return False

    def choices(self, k: int, has: int):
        """Sets that can be taken in term k, likely ones first."""
        some = self.open(k, has)
        order = [c for c in self.order if some >> c & 1]

        def pick(i: int, taken: int, room: int):
            if i == len(order):
                if all(self.holds(self.along[c], has | taken) for c in _bits(taken)) and not any(self._spare(c, has, taken, room) for c in _bits(some & ~taken)):
                    yield taken
                return
            c = order[i]
            if self.units[c] <= room and not self.clash[c] & taken and (self.twin[c] < 0 or (has | taken) >> self.twin[c] & 1 or not some >> self.twin[c] & 1):
                yield from pick(i + 1, taken | 1 << c, room - self.units[c])
            yield from pick(i + 1, taken, room)

        yield from pick(0, 0, self.load)

    def _spare(self, c: int, has: int, taken: int, room: int) -> bool:
        """Could be taken as well, without harm later."""
        return self.units[c] <= room and not self.clash[c] & ~has and self.holds(self.along[c], has | taken | 1 << c)

    def search(self, n: int) -> list[int] | None:
        """Sets of n terms that fill all slots."""
        self.shortage = lru_cache(1 << 14)(self.short)
        dead: set[tuple[int, int]] = set()

        def down(k: int, has: int) -> list[int] | None:
            if self.done(has):
                return []
            if k == n or (k, has) in dead or self.hopeless(k, n, has):
                return None
            for some in self.choices(k, has):
                tail = down(k + 1, has | some)
                if tail is not None:
                    return [some, *tail]
            dead.add((k, has))
            return None

        return down(0, self.held) if self.possible else None

    def sound(self, terms: list[int]) -> bool:
        """Rules hold in every term, and all is filled."""
        has = self.held
        for some in terms:
            if not all(self.holds(self.before[c], has) and self.holds(self.along[c], has | some) for c in _bits(some)):
                return False
            has |= some
        return self.done(has)

    def spared(self, terms: list[int]) -> list[list[str]]:
        """Without courses that can be left out, the latest first."""
        for k in reversed(range(len(terms))):
            for c in sorted(_bits(terms[k]), key=lambda c: (self.height[c], bool(self.fit[c]), -c)):
                less = [*terms[:k], terms[k] & ~(1 << c), *terms[k + 1 :]]
                if self.sound(less):
                    terms = less
        return [sorted(self.names[c] for c in _bits(t)) for t in terms]


def _bits(x: int):
    while x:
        low = x & -x
        yield low.bit_length() - 1
        x ^= low


def solve(program: Program, catalogue: Catalogue, seasons: dict[str, frozenset[str]], taken: set[str], policy: Policy = Policy()) -> list[list[str]] | None:  # noqa: B008
    """The courses of each term of a plan with the fewest terms, none of which can be left out; None if there is no plan within the horizon.

    seasons: when courses are offered. Nothing missing: one empty term. Conditionals that what is taken doesn't decide are tried both ways:
    their trigger is planned, or isn't.
    """
    taken = frozenset(taken)
    free = [c for c in program.conditionals if c.trigger not in taken]
    cases = []
    for way in product((False, True), repeat=len(free)):
        must, barred = (frozenset(c.trigger for c, w in zip(free, way, strict=True) if w == x) for x in (True, False))
        if not any(c.ineligible in must for c, w in zip(free, way, strict=True) if w):
            cases.append(Case(program, catalogue, seasons, taken, policy, must, barred - must))
    for n in range(policy.horizon + 1):
        for case in cases:
            terms = case.search(n)
            if terms is not None:
                return case.spared(terms) or [[]]
    return None


SOLVED = "key string, found boolean, terms_to_graduate int, n_courses int, courses array<array<string>>"


def solve_all(sets: DataFrame, program: Program, catalogue: Catalogue, seasons: dict[str, frozenset[str]], policy: Policy = Policy()) -> DataFrame:  # noqa: B008
    """sets (plan, taken array<string>) -> (plan, found, terms_to_graduate, n_courses, courses by term). Equal sets are solved once, wherever they are."""
    keyed = sets.select("plan", F.array_join(F.array_sort(F.array_distinct(F.coalesce("taken", F.array().cast("array<string>")))), "|").alias("key"))

    def one(batches):
        for pdf in batches:
            rows = []
            for key in pdf["key"]:
                terms = solve(program, catalogue, seasons, set(key.split("|")) - {""}, policy)
                rows.append((key, terms is not None, len(terms) if terms is not None else None, sum(map(len, terms or [])), terms))
            yield pd.DataFrame(rows, columns=["key", "found", "terms_to_graduate", "n_courses", "courses"]).astype({"terms_to_graduate": "Int32", "n_courses": "int32"})

    tasks = sets.sparkSession.sparkContext.defaultParallelism  # a set takes long for a row: so few rows aren't gathered in one task
    solved = keyed.select("key").distinct().repartition(tasks, "key").mapInPandas(one, SOLVED)
    return keyed.join(solved, "key").select("plan", "found", "terms_to_graduate", "n_courses", "courses")


def as_plans(solved: DataFrame, taken: DataFrame, seasons: tuple[str, ...] = ("Fall", "Winter")) -> DataFrame:
    """solved of solve_all, taken (plan, course) -> plans as rows that degree.validate takes: what was taken before has the term -1."""
    rows = solved.select("plan", F.posexplode("courses").alias("term_idx", "c")).select("plan", "term_idx", F.posexplode("c").alias("pos", "course"))
    season = F.element_at(F.array(*map(F.lit, seasons)), F.pmod("term_idx", F.lit(len(seasons))) + 1)
    rows = rows.select("plan", "term_idx", F.concat(F.lit("Term "), (F.col("term_idx") + 1).cast("string"), F.lit(" ("), season, F.lit(")")).alias("term"), "pos", "course")
    before = taken.select("plan", F.lit(-1).alias("term_idx"), F.lit("taken").alias("term"), F.lit(0).alias("pos"), "course")
    return rows.unionByName(before.join(solved.where("found").select("plan"), "plan", "left_semi"))
