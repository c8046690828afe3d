"""Academic terms: seasons, codes, order; course levels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The order of seasons within a year, and the numeric code's origin, year and steps.
SEASONS = ("Winter", "Spring", "Summer", "Fall")
CODE_ORIGIN, CODE_YEAR, YEAR_STEP, SEASON_STEP = 1940, 2026, 40, 10


def season_of_month(month: Column) -> Column:
    return F.when(month <= 4, "Winter").when(month <= 6, "Spring").when(month <= 8, "Summer").otherwise("Fall")


def season_of(label: Column) -> Column:
    """The season that a label names, looked for as Fall, Winter, Spring, Summer; else the trimmed label."""
    out = F.trim(label)
    for s in reversed(("Fall", "Winter", "Spring", "Summer")):
        out = F.when(F.contains(label, F.lit(s)), s).otherwise(out)
    return out


def season_rank(season: Column) -> Column:
    out = F.lit(9)
    for k, s in enumerate(SEASONS):
        out = F.when(season == s, k).otherwise(out)
    return out


def term_label(date: Column) -> Column:
    """'Fall Term 2026' of a date."""
    return F.concat_ws(" ", season_of_month(F.month(date)), F.lit("Term"), F.year(date).cast("string"))


def term_year(label: Column) -> Column:
    """The label's year, 9999 if it has none."""
    return F.coalesce(F.regexp_extract(label, "([0-9]{4})", 1).try_cast("int"), F.lit(9999))


def term_code(label: Column) -> Column:
    """The numeric code of a term; null for labels that name no term."""
    rank, year = season_rank(season_of(label)), F.regexp_extract(label, "([0-9]{4})", 1).try_cast("int")
    return F.when(rank < 9, F.lit(CODE_ORIGIN) + (year - CODE_YEAR) * YEAR_STEP + rank * SEASON_STEP)


def level(number: Column) -> Column:
    """Hundreds of a catalogue number's leading digits."""
    return F.floor(F.regexp_extract(number.cast("string"), "^([0-9]+)", 1).try_cast("int") / 100) * 100
