"""Extraction from pages and descriptions: requirement clauses, meetings, section cells, page structure."""

from __future__ import annotations

from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clean
from ..sources.batches import bounded_batches, frames

# Lead-ins of requirement clauses, without regard to case; of those that begin together the longest counts.
LEAD_INS = [
    ("combined", r"Prerequisites?\s+or\s+co-?\s?requisites?\s*:?"),
    ("combined", r"Pre-?\s*(?:and|/|or)\s*co-?\s?requisites?\s*:?"),
    ("coreq", r"Co-?\s?requisites?\s*:?"),
    ("prereq", r"Prerequisites?\s*:?"),
    ("antireq", r"Antirequisites?\s*:?"),
    ("credit", r"Credit (?:cannot|may not|will not) be (?:obtained|granted)"),
    ("note", r"See Note|Notes?\s*:?"),
]
# Degree codes by the beginning of a program's name are given by the caller, as an ordered list.
DAYS = "MTWRF"


def let(x: Column, f) -> Column:
    """f(x), where x is computed once however often f names it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def clause_column(description: Column) -> Column:
    """struct(prereq_raw, coreq_raw, credit_exclusion_raw, combined) of a description.

    Marks are put before all lead-ins by one alternation, longest kinds first, and the text is split there; the first clause of a kind
    counts. A clause of both kinds fills what is empty of either. A credit clause keeps its lead-in.
    """
    mark, end = "\u0001", "\u0002"
    one = "|".join(f"({p})" for _, p in LEAD_INS)
    marked = F.regexp_replace(clean(description), f"(?i){one}", f"{mark}$0{end}")

    def kind_of(piece: Column) -> Column:
        lead, kind = F.split_part(piece, F.lit(end), F.lit(1)), F.lit(None).cast("string")
        for name, p in reversed(LEAD_INS):
            kind = F.when(lead.rlike(f"(?i)^(?:{p})$"), name).otherwise(kind)
        return F.struct(kind.alias("kind"), lead.alias("lead"), clean(F.split_part(piece, F.lit(end), F.lit(2))).alias("body"))

    value = lambda x: F.when(x["kind"] == "credit", clean(F.concat(x["lead"], F.lit(" "), x["body"]))).otherwise(x["body"])
    pieces = let(F.split(marked, mark), lambda x: F.slice(x, 2, F.size(x)))
    rows = F.filter(F.transform(F.transform(pieces, kind_of), lambda x: F.struct(x["kind"].alias("kind"), value(x).alias("value"))), lambda x: x["value"] != "")
    first = lambda x, *kinds: F.get(F.filter(x, lambda r: r["kind"].isin(*kinds)), F.lit(0))["value"]
    return let(rows, lambda x: F.struct(
        first(x, "prereq", "combined").alias("prereq_raw"), first(x, "coreq", "combined").alias("coreq_raw"), first(x, "credit").alias("credit_exclusion_raw"), F.exists(x, lambda r: r["kind"].eqNullSafe("combined")).alias("combined")
    ))


def clauses(df: DataFrame, key: str, description: str) -> DataFrame:
    """(key, prereq_raw, coreq_raw, credit_exclusion_raw, combined) of each description."""
    return df.select(key, clause_column(F.col(description)).alias("c")).select(key, "c.*")


def section_cell(cell: Column) -> Column:
    """'<component words> <section> (<class id>)' -> struct(component, section, class_id); parts that are not there are null."""
    pattern = r"^(.+?)\s*\(([0-9A-Za-z]+)\)\s*$"

    def parts(x: Column) -> Column:
        inside, words, n = x["inside"], x["words"], F.size(x["words"])
        return F.struct(
            F.when(x["text"] != "", F.when(n > 1, F.array_join(F.slice(words, 1, F.greatest(n - 1, F.lit(1))), " ")).otherwise(F.get(words, F.lit(0)))).alias("component"),
            F.when(n > 1, F.element_at(words, -1)).alias("section"),
            F.when(inside != "", inside).alias("class_id"),
        )

    def cut(x: Column) -> Column:
        words = F.split(F.when(x["inside"] != "", F.regexp_extract(x["text"], pattern, 1)).otherwise(x["text"]), " ")
        return F.struct(x["text"].alias("text"), x["inside"].alias("inside"), words.alias("words"))

    inside = lambda text: F.struct(text.alias("text"), F.regexp_extract(text, pattern, 2).alias("inside"))
    return let(clean(cell), lambda text: let(let(inside(text), cut), parts))


def expand_days(text: Column) -> Column:
    """struct(days, unknown): a letter each; unknown: those outside Monday to Friday."""
    days = F.filter(F.split(F.coalesce(text, F.lit("")), ""), lambda c: c.rlike(r"\S") & (c != ","))
    return F.struct(days.alias("days"), F.filter(days, lambda c: ~F.contains(F.lit(DAYS), c)).alias("unknown"))


def date_column(text: Column) -> Column:
    """'2026-01-05 - 2026-04-10 (MWF)' -> struct(date_start, date_end, days); one date is its own end."""
    pattern = r"([0-9]{4}-[0-9]{2}-[0-9]{2})(?:\s*-\s*([0-9]{4}-[0-9]{2}-[0-9]{2}))?(?:\s*\(([^)]*)\))?"
    some = F.struct(*(F.regexp_extract(text, pattern, k).alias(x) for k, x in ((1, "a"), (2, "b"), (3, "c"))))
    given = lambda x: F.when(x != "", x)
    return let(some, lambda x: F.struct(given(x["a"]).alias("date_start"), F.coalesce(given(x["b"]), given(x["a"])).alias("date_end"), given(x["c"]).alias("days")))


def time_column(text: Column) -> Column:
    """'9:00 - 9:50' -> struct(time_start, time_end), hours of two digits."""
    pattern = r"([0-9]{1,2}):([0-9]{2})\s*-\s*([0-9]{1,2}):([0-9]{2})"
    some = F.struct(*(F.regexp_extract(text, pattern, k).alias(x) for k, x in ((1, "a"), (2, "b"), (3, "c"), (4, "d"))))
    part = lambda h, m: F.when(m != "", F.concat(F.lpad(h, 2, "0"), F.lit(":"), m))
    return let(some, lambda x: F.struct(part(x["a"], x["b"]).alias("time_start"), part(x["c"], x["d"]).alias("time_end")))


def meetings(cells: DataFrame, key: str) -> DataFrame:
    """cells (key, pos, kind date|time, text) -> (key, pos, date, time) of each date cell; a time belongs to the date just before it."""
    order = Window.partitionBy(key).orderBy("pos")
    rows = cells.withColumns({"next_kind": F.lead("kind").over(order), "next_text": F.lead("text").over(order)}).where("kind = 'date'")
    d, t = date_column(F.col("text")), time_column(F.when(F.col("next_kind") == "time", F.col("next_text")))
    return rows.select(key, "pos", d.alias("date"), t.alias("time"))


def carried_headings(nodes: DataFrame, key: str) -> DataFrame:
    """nodes (key, pos, tag, text) with ``term``: the last heading's text at or before each node."""
    order = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return nodes.withColumn("term", F.last(F.when(F.col("tag").isin("h2", "h3"), F.col("text")), ignorenulls=True).over(order))


class _Outline(HTMLParser):
    """Headings, paragraphs and list items with their headings' path; scripts and styles say nothing."""

    BLOCKS = {"h1", "h2", "h3", "p", "li", "td"}

    def __init__(self):
        super().__init__()
        self.rows: list[tuple[int, str, str, str]] = []
        self.open: list[tuple[str, list[str]]] = []
        self.path: dict[str, str] = {}
        self.mute = 0

    def handle_starttag(self, tag, attrs):
        self.mute += tag in ("script", "style")
        if tag in self.BLOCKS:
            self.open.append((tag, []))

    def handle_endtag(self, tag):
        self.mute -= tag in ("script", "style") and self.mute > 0
        if tag in self.BLOCKS and any(t == tag for t, _ in self.open):
            while self.open:
                t, parts = self.open.pop()
                self.end(t, " ".join("".join(parts).split()))
                if t == tag:
                    break

    def handle_data(self, data):
        if self.open and not self.mute:
            self.open[-1][1].append(data)

    def end(self, tag, text):
        if not text:
            return
        if tag in ("h1", "h2", "h3"):
            self.path = {t: x for t, x in self.path.items() if t < tag} | {tag: text}
        self.rows.append((len(self.rows), tag, text, " / ".join(x for _, x in sorted(self.path.items()))))


def outline(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, pos, tag, text, heading) of headings, paragraphs, items and cells, in document order, by a DOM walk on the executors."""

    bounded_batches(pages.sparkSession)

    def rows(batches):
        for pdf in batches:
            for k, text in zip(pdf["k"], pdf["html"], strict=True):
                parser = _Outline()
                parser.feed(text or "")
                parser.close()
                for r in parser.rows:
                    yield k, *r

    def walk(batches):
        yield from frames(rows(batches), ["k", "pos", "tag", "text", "heading"])

    out = pages.select(F.col(key).cast("long").alias("k"), F.col(html).alias("html")).mapInPandas(walk, "k long, pos int, tag string, text string, heading string")
    return out.withColumnRenamed("k", key)
