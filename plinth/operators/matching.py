"""Global requirement matching: each course fills at most one slot; the least total shortfall, and an assignment that has it."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Up to so many slots the shortfall is read off a table of all sets of slots; beyond, it is found by flow.
HALL_SLOTS = 14


def least_shortfall(need: list[int], supply: dict[int, int]) -> int:
    """What stays unfilled of need when supply (mask of the slots it fits -> amount) is dealt out as well as can be.

    The largest flow from masks to slots, by shortest augmenting paths in phases (Dinic): paths end at slots with room and may move what was
    dealt before.
    """
    masks = [m for m in supply if m]
    left, room = [supply[m] for m in masks], list(need)
    dealt = [[0] * len(need) for _ in masks]
    slots = [[k for k in range(len(need)) if m >> k & 1] for m in masks]
    while True:
        level: dict[tuple[bool, int], int] = {(True, i): 0 for i, x in enumerate(left) if x}
        queue = list(level)
        for node in queue:
            is_mask, i = node
            for j in slots[i] if is_mask else [j for j in range(len(masks)) if dealt[j][i]]:
                if (not is_mask, j) not in level:
                    level[not is_mask, j] = level[node] + 1
                    queue.append((not is_mask, j))
        if not any(room[k] for is_mask, k in level if not is_mask):
            return sum(room)
        spent: set[tuple[bool, int]] = set()

        def push(is_mask: bool, i: int, most: int) -> int:
            """Pushes up to ``most`` from a node on towards slots with room."""
            if not is_mask and room[i]:
                got = min(most, room[i])
                room[i] -= got
                return got
            for j in slots[i] if is_mask else range(len(masks)):
                limit = most if is_mask else min(most, dealt[j][i])
                if limit and (not is_mask, j) not in spent and level.get((not is_mask, j)) == level[is_mask, i] + 1:
                    got = push(not is_mask, j, limit)
                    if got:
                        dealt[i if is_mask else j][j if is_mask else i] += got if is_mask else -got
                        return got
            spent.add((is_mask, i))
            return 0

        for i in [i for i, x in enumerate(left) if x]:
            while left[i] and (got := push(True, i, left[i])):
                left[i] -= got


def shortfall(masks: DataFrame, need: list[int], plan: str = "plan", mask: str = "mask") -> DataFrame:
    """masks (plan, mask), a row for each course: bit i says that slot i may take it -> (plan, shortfall) in courses.

    Courses are counted by mask, so that a plan has at most as many counts as there are masks; plans with equal counts are solved once. By Hall's
    theorem the least total shortfall is the largest of need(S) - |courses that fit a slot of S| over sets S of slots: up to HALL_SLOTS slots, a table of
    2**slots rows is joined. Beyond, each distinct list of counts is solved by flow.
    """
    counted = masks.groupBy(plan, F.col(mask).alias("mask")).agg(F.count("*").alias("n"))
    by_plan = counted.groupBy(plan).agg(F.array_sort(F.collect_list(F.struct("mask", "n"))).alias("counts"))
    kinds = by_plan.select("counts").distinct()
    if len(need) > HALL_SLOTS:

        def flows(batches):
            for pdf in batches:
                short = [least_shortfall(need, {c["mask"]: c["n"] for c in counts}) for counts in pdf["counts"]]
                yield pd.DataFrame({"key": pdf["key"], "shortfall": pd.Series(short, dtype="int64")})

        keyed = kinds.select(F.to_json("counts").alias("key"), "counts")
        short = keyed.mapInPandas(flows, "key string, shortfall long")
        return by_plan.withColumn("key", F.to_json("counts")).join(short, "key").select(plan, "shortfall")
    sets = [(s, sum(n for i, n in enumerate(need) if s >> i & 1)) for s in range(1 << len(need))]
    table = F.broadcast(masks.sparkSession.createDataFrame(sets, "slots int, need int"))
    cells = kinds.select("counts", F.explode("counts").alias("c")).join(table)
    covered = F.sum(F.when(F.col("c.mask").bitwiseAND(F.col("slots")) != 0, F.col("c.n")).otherwise(0))
    short = cells.groupBy("counts", "slots", "need").agg((F.col("need") - covered).alias("short")).groupBy("counts").agg(F.max("short").alias("shortfall"))
    return by_plan.join(short, "counts").select(plan, "shortfall")


def assign(courses: list[tuple], need: list[int], fits: list[int], later: set[int] = frozenset()) -> list[int | None]:
    """Of each course (given by its mask in fits) the slot that takes it, by augmenting paths; slots of ``later`` are filled after others, narrow ones first."""
    taken: list[list[int]] = [[] for _ in need]
    place: list[int | None] = [None] * len(courses)
    wide = [sum(f >> s & 1 for f in fits) for s in range(len(need))]

    def free(slot: int, seen: set[int]) -> bool:
        """A course for the slot: a free one, or one whose own slot can find another."""
        for c, f in enumerate(fits):
            if f >> slot & 1 and c not in seen:
                seen.add(c)
                if place[c] is None or free(place[c], seen):
                    if place[c] is not None:
                        taken[place[c]].remove(c)
                    place[c] = slot
                    taken[slot].append(c)
                    return True
        return False

    for slot in sorted(range(len(need)), key=lambda s: (s in later, wide[s], need[s], s)):
        while len(taken[slot]) < need[slot] and free(slot, set()):
            pass
    return place


def assign_units(units: list[float], need: list[float | None], fits: list[int]) -> list[int | None]:
    """Of each course, given by its units and its mask in fits, the slot that takes it, so that what stays short is least.

    need: a slot's units, short by tenths of a unit; None: any one course, short by 1 of these tenths without it. Exact. Where all courses have the same
    units and all slots need whole courses, paths of ``assign`` give it: places that paths can fill form a matroid, so dearer ones are filled first.
    Else states are what the slots still need, courses are dealt one by one, and of equal states the first is kept.
    """
    same = {round(10 * u) for u, f in zip(units, fits, strict=True) if f}
    if len(same) == 1 and (one := same.pop()) > 0 and all(n is None or round(10 * n) % one == 0 for n in need):
        return assign(list(units), [1 if n is None else round(10 * n) // one for n in need], fits, {k for k, n in enumerate(need) if n is None})
    start = tuple(1 if n is None else round(10 * n) for n in need)
    states: dict[tuple[int, ...], tuple] = {start: ()}
    order = sorted(range(len(units)), key=lambda i: (bin(fits[i]).count("1"), i))
    for i in order:
        now: dict[tuple[int, ...], tuple] = {}
        weight = round(10 * units[i])
        for state, chosen in states.items():
            some = [s for s in range(len(need)) if fits[i] >> s & 1 and state[s] > 0 and (need[s] is None or weight > 0)]
            for s in [*some, None]:
                left = state if s is None else (*state[:s], 0 if need[s] is None else max(0, state[s] - weight), *state[s + 1 :])
                now.setdefault(left, (chosen, i, s))
        states = now
    narrow = sorted(range(len(need)), key=lambda k: (sum(f >> k & 1 for f in fits), need[k] or 0, k))  # of equally good ways, one that fills narrow slots
    chosen = states[min(states, key=lambda x: (sum(x), [x[k] for k in narrow]))]
    place: list[int | None] = [None] * len(units)
    while chosen:
        chosen, i, s = chosen
        place[i] = s
    return place


def assignments(masks: DataFrame, need: list[int]) -> DataFrame:
    """masks (plan long, course long, mask int) -> (plan, course, slot): slot null if the course is left over. A plan is a row with its courses in order."""
    plans = masks.groupBy("plan").agg(F.array_sort(F.collect_list(F.struct("course", "mask"))).alias("c")).select("plan", F.col("c.course").alias("courses"), F.col("c.mask").alias("fits"))

    def deal(batches):
        for pdf in batches:
            slots = [assign(list(c), need, list(f)) for c, f in zip(pdf["courses"], pdf["fits"], strict=True)]
            yield pd.DataFrame({"plan": pdf["plan"], "courses": pdf["courses"], "slots": slots})

    dealt = plans.mapInPandas(deal, "plan long, courses array<long>, slots array<int>")
    return dealt.select("plan", F.inline(F.arrays_zip(F.col("courses").alias("course"), F.col("slots").alias("slot"))))
