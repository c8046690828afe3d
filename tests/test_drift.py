"""Changes of a snapshot."""

from plinth.operators import drift

SECTION = "struct<term:string,component:string,capacity:int,meetings:array<struct<time_start:string,time_end:string>>>"


def test_changes_in_order(spark):
    s = [("F", "LAB", 9, [("08:00", "09:00")]), ("F", "LEC", 30, [("10:00", "11:00"), ("12:00", "13:00")]), ("W", "LEC", 40, []), ("F", "LEC", 31, [])]
    snap = spark.createDataFrame([("a", ["F", "W"], s, 1), ("b", ["W"], [], 2), ("c", None, None, 3)], f"course_id string, terms array<string>, sections array<{SECTION}>, more int")
    rows = [
        (0, "a", "seats_full", "F", "LEC", None, None, None), (1, "a", "time_move", "F", "LEC", None, "14:00", "15:00"), (2, "a", "term_drop", "W", None, None, None, None), (3, "a", "term_add", "S", None, None, None, None),
        (4, "a", "term_add", "F", None, None, None, None), (5, "b", "seats_full", "F", None, 5, None, None), (6, "a", "seats_full", "F", None, 2, None, None), (7, "z", "term_add", "F", None, None, None, None), (8, "c", "term_add", "F", None, None, None, None), (9, "a", "other", "F", None, 1, None, None),
    ]
    got = {r["course_id"]: r for r in drift.apply(snap, spark.createDataFrame(rows, "place int, " + drift.CHANGE)).collect()}
    assert got["a"]["terms"] == ["F", "S"] and got["a"]["more"] == 1
    assert [(x["component"], x["capacity"], [tuple(m) for m in x["meetings"]]) for x in got["a"]["sections"]] == [("LAB", 2, [("08:00", "09:00")]), ("LEC", 0, [("14:00", "15:00"), ("12:00", "13:00")]), ("LEC", 31, [])]
    assert (got["b"]["terms"], got["b"]["sections"]) == (["W"], []) and got["c"]["terms"] == ["F"] and len(got) == 3
