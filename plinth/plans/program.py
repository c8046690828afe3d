"""A degree program and plans for it, as data."""

from __future__ import annotations

from ..operators.degree import Conditional, Group, Prerequisite, Program

MATH30 = {"hs": "Mathematics 30-1"}
# The calendar's courses (3 units each), groups, conditional, exclusions and prerequisites with their wording.
NAMED = (
    "CMPUT 174", "CMPUT 175", "CMPUT 274", "CMPUT 275", "CMPUT 200", "CMPUT 201", "CMPUT 204", "CMPUT 229", "CMPUT 272", "CMPUT 291", "CMPUT 300",
    "MATH 125", "MATH 134", "MATH 136", "MATH 144", "MATH 146", "MATH 154", "MATH 156", "STAT 151", "STAT 235", "STAT 265",
)
GROUPS = (
    Group("foundation_core", "all_of", members=({"one_of": ["CMPUT 174", "CMPUT 274"]}, {"one_of": ["CMPUT 175", "CMPUT 275"]}, "MATH 125")),
    Group("foundation_calc_1", "units_from", units=3, options=("MATH 134", "MATH 144", "MATH 154")),
    Group("foundation_calc_2", "units_from", units=3, options=("MATH 136", "MATH 146", "MATH 156")),
    Group("foundation_stat", "units_from", units=3, options=("STAT 151", "STAT 235", "STAT 265")),
    Group("senior_required", "all_of", members=("CMPUT 204", "CMPUT 272")),
    Group("senior_choice", "units_from", units=6, options=("CMPUT 201", "CMPUT 229", "CMPUT 291")),
    Group("senior_ethics", "units_from", units=3, options=("CMPUT 200", "CMPUT 300")),
    Group("senior_cmput_300_400", "units_from_pattern", units=15, pattern={"subject": "CMPUT", "level_in": [300, 400]}),
    Group("senior_cmput_400", "units_from_pattern", units=6, pattern={"subject": "CMPUT", "level_in": [400]}),
)
CONDITIONALS = (Conditional("note1_275_blocks_201", "CMPUT 275", "CMPUT 201", "senior_choice", ("CMPUT 229", "CMPUT 291"), {"subject": "CMPUT", "level_gte": 200}),)
EXCLUSIONS = (
    ("CMPUT 174", "CMPUT 274"), ("CMPUT 174", "CMPUT 275"), ("CMPUT 174", "ENCMP 100"), ("CMPUT 175", "CMPUT 275"), ("CMPUT 201", "CMPUT 275"), ("CMPUT 229", "E E 380", "ECE 212"),
    ("CMPUT 291", "BTM 415", "MIS 415"), ("CMPUT 301", "BTM 419", "MIS 419"), ("CMPUT 401", "BTM 419", "MIS 419"),
)
CALCULUS = {"one_of": ["MATH 100", "MATH 113", "MATH 114", "MATH 117", "MATH 134", "MATH 144", "MATH 154"]}
C201_275 = {"one_of": ["CMPUT 201", "CMPUT 275"]}
PREREQUISITES = {
    "CMPUT 174": Prerequisite({"one_of": [{"hs": "Mathematics 30"}, {"hs": "Mathematics 30-1"}, {"hs": "Mathematics 30-2"}]}, "Math 30, 30-1, or 30-2."),
    "CMPUT 175": Prerequisite({"one_of": ["CMPUT 174", "SCI 100"]}, "CMPUT 174 or SCI 100."),
    "CMPUT 274": Prerequisite(MATH30, "Math 30-1."),
    "CMPUT 275": Prerequisite("CMPUT 274", "CMPUT 274."),
    "CMPUT 200": Prerequisite(
        {"one_of": [{"one_of": ["CMPUT 191", "CMPUT 195"]}, {"all_of": [{"one_of": ["CMPUT 174", "CMPUT 274", "ENCMP 100"]}, {"one_of": ["STAT 151", "STAT 161", "STAT 181", "STAT 235", "STAT 265", "SCI 151", "MATH 181"]}]}]},
        "one of CMPUT 191 or 195; or one of CMPUT 174 or 274 or ENCMP 100, and one of STAT 151, 161, 181, 235, 265, SCI 151, or MATH 181.",
    ),
    "CMPUT 201": Prerequisite("CMPUT 175", "CMPUT 175."),
    "CMPUT 204": Prerequisite(
        {"all_of": [{"one_of": ["CMPUT 175", "CMPUT 275"]}, "CMPUT 272", {"one_of": ["MATH 100", "MATH 114", "MATH 117", "MATH 134", "MATH 144", "MATH 154"]}]},
        "CMPUT 175 or 275, and CMPUT 272; and one of MATH 100, 114, 117, 134, 144, or 154.",
    ),
    "CMPUT 229": Prerequisite(C201_275, "CMPUT 201 or 275. Credit may be obtained in only one of CMPUT 229, E E 380 or ECE 212."),
    "CMPUT 272": Prerequisite({"one_of": ["CMPUT 101", "CMPUT 174", "CMPUT 175", "CMPUT 274", "SCI 100", "ENCMP 100"]}, "CMPUT 101, 174, 175, 274, SCI 100, or ENCMP 100."),
    "CMPUT 291": Prerequisite(
        {"all_of": [{"one_of": ["CMPUT 175", "CMPUT 274"]}, "CMPUT 272"]}, "CMPUT 175 or 274, and 272.", C201_275,
        "one of CMPUT 201 or 275. Credit may be obtained in only one of CMPUT 291, BTM 415, or MIS 415.",
    ),
    "CMPUT 300": Prerequisite(
        {"all_of": [{"one_of": [{"pattern": {"subject": "CMPUT", "level_in": [100]}}, "SCI 100"]}, {"pattern": {"level_in": [200]}}]},
        "Any introductory-level Computing Science course or SCI 100, and any 200-level course.",
    ),
    "MATH 125": Prerequisite(MATH30, "Mathematics 30-1."),
    "MATH 134": Prerequisite(MATH30, "Mathematics 30-1."),
    "MATH 136": Prerequisite(CALCULUS, "One of MATH 100, 113, 114, 117, 134, 144 or 154."),
    "MATH 144": Prerequisite(MATH30, "Mathematics 30-1."),
    "MATH 146": Prerequisite(CALCULUS, "One of MATH 100, 113, 114, 117, 134, 144 or 154."),
    "MATH 154": Prerequisite(MATH30, "Mathematics 30-1."),
    "MATH 156": Prerequisite(CALCULUS, "One of MATH 100, 113, 114, 117, 134, 144 or 154."),
    "STAT 151": Prerequisite({"one_of": [MATH30, {"hs": "Mathematics 30-2"}]}, "Mathematics 30-1 or 30-2."),
    "STAT 235": Prerequisite("MATH 100", "MATH 100.", "MATH 101", "MATH 101."),
    "STAT 265": Prerequisite(None, None, {"one_of": ["MATH 209", "MATH 214", "MATH 217"]}, "One of MATH 209, 214 or 217."),
    "CMPUT 301": Prerequisite(C201_275, "CMPUT 201 or CMPUT 275. Credit may be obtained in only one of CMPUT 301, BTM 419, or MIS 419."),
    "CMPUT 303": Prerequisite({"all_of": [C201_275, "CMPUT 204"]}, "CMPUT 201 or 275, and 204."),
    "CMPUT 331": Prerequisite({"all_of": [C201_275, "CMPUT 272"]}, "CMPUT 201 or 275, and CMPUT 272."),
    "CMPUT 333": Prerequisite(C201_275, "CMPUT 201 or 275."),
    "CMPUT 350": Prerequisite({"all_of": [C201_275, "CMPUT 204"]}, "CMPUT 201 or CMPUT 275, and CMPUT 204."),
    "CMPUT 355": Prerequisite({"pattern": {"subject": "CMPUT", "level_in": [200]}}, "any 200-level Computing Science course."),
    "CMPUT 401": Prerequisite("CMPUT 301", "CMPUT 301. Credit may be obtained in only one of CMPUT 401, BTM 419, or MIS 419."),
    "CMPUT 402": Prerequisite("CMPUT 301", "CMPUT 301."),
    "CMPUT 455": Prerequisite({"pattern": {"subject": "CMPUT", "level_in": [300]}}, "any 300-level Computing Science course."),
    "CMPUT 461": Prerequisite({"all_of": [C201_275, {"pattern": {"subject": "CMPUT", "level_in": [300]}}]}, "201 or 275, and any 300-level Computing Science course."),
}
PROGRAM = Program(NAMED, GROUPS, CONDITIONALS, EXCLUSIONS, PREREQUISITES, dict.fromkeys(NAMED, 3.0))
