"""Program pages and lists of programs: degrees by name, course codes in text, rules in text, discovery of links, blocks of requirements."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean
from ..sources.scratch import kept

# Beginnings of program names and their degrees, in this order.
DEGREES = [
    ("Bachelor of Science in Nursing", "BScN"),
    ("Bachelor of Science in Engineering", "BSc Eng"),
    ("Bachelor of Science", "BSc"),
    ("Bachelor of Arts", "BA"),
    ("Bachelor of Education", "BEd"),
    ("Bachelor of Commerce", "BCom"),
    ("Bachelor of Kinesiology", "BKin"),
    ("Bachelor of Music", "BMus"),
    ("Bachelor of Design", "BDes"),
    ("Bachelor of", "B?"),
    ("Master of", "M?"),
    ("Doctor of", "D?"),
]
# The patterns of course codes that begin a text, and of text that states a rule.
CODE = r"^([A-Z][A-Z&/]*(?:\s[A-Z&/]+)*)\s+(\d+[A-Z]*)\b"
RULE = r"(?i)(\d+\s*units?\b|\bfrom\b|★|\bone of\b|\beach of\b|\bunits? from\b)"
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
VOID = {"br", "img", "meta", "link", "input", "hr", "area", "base", "col", "embed", "source", "track", "wbr"}
CORE = "page long, poid string, pos int, path array<string>, heading string, kind string, text string, content boolean, title string"


def degree_of(name: Column) -> Column:
    """The degree of the first beginning that fits; null if none does."""
    out = F.lit(None).cast("string")
    for prefix, code in reversed(DEGREES):
        out = F.when(F.startswith(name, F.lit(prefix)), code).otherwise(out)
    return out


def code_of(text: Column) -> Column:
    """The course code that begins a text, null if none does."""
    code = F.regexp_extract(clean(text), CODE, 0)
    return F.when(code != "", F.concat_ws(" ", clean(F.regexp_extract(code, CODE, 1)), F.regexp_extract(code, CODE, 2)))


def is_rule(text: Column) -> Column:
    return text.rlike(RULE)


def discover(links: DataFrame, gold: list[str], pattern: str = r"poid=(\d+)", most: int | None = None) -> DataFrame:
    """links (page, pos, href, text) -> (poid, name, tier): each id once, with its first text, in order of numbers; at most ``most``, if given."""
    found = links.withColumn("poid", F.regexp_extract("href", pattern, 1)).where("poid <> ''")
    named = found.groupBy("poid").agg(F.min_by(clean(F.col("text")), F.struct("page", "pos")).alias("name"))
    out = named.select("poid", "name", F.when(F.col("poid").isin(gold), "gold").otherwise("silver").alias("tier")).orderBy(F.col("poid").cast("decimal(38)"), "poid")
    return out if most is None else out.limit(most)


def tiers(files: DataFrame, gold: list[str]) -> DataFrame:
    """files (poid, tier, ...): the tier where it is stated, else gold for the ids listed, else silver."""
    return files.withColumn("tier", F.coalesce("tier", F.when(F.col("poid").isin(gold), "gold").otherwise("silver")))


class _Cores(HTMLParser):
    """Flat rows of a page: (block, path of headings, own heading, kind, text) of its headings and list items."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[dict] = []  # elements: tag, block begun here or None, texts being gathered
        self.blocks: list[dict] = []
        self.items: list[dict] = []
        self.content, self.title, self.name = False, [], None

    def block(self):
        return next((e["block"] for e in reversed(self.open) if e["block"] is not None), None)

    def handle_starttag(self, tag, attrs):
        classes = (dict(attrs).get("class") or "").split()
        self.content |= "block_content" in classes
        mine = None
        if "acalog-core" in classes:
            mine = {"path": [b["heading"] for e in self.open if (b := e["block"])], "heading": None, "items": []}
            self.blocks.append(mine)
        e = {"tag": tag, "block": mine, "text": None, "done": None}
        parent = self.open[-1]["block"] if self.open else None
        if tag in HEADINGS and parent is not None and parent["heading"] is None:
            e["text"], e["done"] = [], lambda t, b=parent: b.update(heading=t)
        elif tag == "h1" and self.content and self.name is None:
            e["text"], e["done"] = [], lambda t: setattr(self, "name", t)
        elif tag == "title":
            e["text"], e["done"] = self.title, lambda t: None
        elif tag == "li" and (b := self.block()) is not None:
            item = {"course": "acalog-course" in classes, "text": "", "link": None}
            b["items"].append(item)
            e["text"], e["done"] = [], lambda t, i=item: i.update(text=t)
            e["item"] = item
        elif tag == "a" and (item := next((x["item"] for x in reversed(self.open) if "item" in x), None)) and item["link"] is None:
            e["text"], e["done"] = [], lambda t, i=item: i.update(link=t)
        if tag not in VOID:
            self.open.append(e)

    def handle_endtag(self, tag):
        if any(e["tag"] == tag for e in self.open):
            while self.open:
                e = self.open.pop()
                if e["done"]:
                    e["done"]("".join(e["text"]))
                if e["tag"] == tag:
                    break

    def handle_data(self, data):
        for e in self.open:
            if e["text"] is not None:
                e["text"].append(data)

    def rows(self):
        title = self.name if self.name is not None else "".join(self.title) or None
        yield -1, [], None, "page", None, self.content, title
        for k, b in enumerate(self.blocks):
            yield k, [h for h in b["path"] if h], b["heading"], "block", None, self.content, title
            for i in b["items"]:
                yield k, [], None, "course" if i["course"] else "prose", i["link"] if i["course"] and i["link"] is not None else i["text"], self.content, title


def cores(pages: DataFrame) -> DataFrame:
    """pages (poid, html) -> flat rows of their requirement blocks, in document order within pos. page: a number of each row of pages."""

    def walk(batches):
        for pdf in batches:
            rows = []
            for page, poid, html in zip(pdf["page"], pdf["poid"], pdf["html"], strict=True):
                p = _Cores()
                p.feed(html or "")
                p.close()
                rows += [(page, poid, *r, n) for n, r in enumerate(p.rows())]
            yield pd.DataFrame(rows, columns=[*(x.split()[0] for x in CORE.split(", ")), "n"])

    return pages.select(F.monotonically_increasing_id().alias("page"), F.col("poid").cast("string").alias("poid"), "html").mapInPandas(walk, CORE + ", n int")


def parse_programs(pages: DataFrame) -> DataFrame:
    """pages (poid, html) -> (poid, program_name, degree, requirement_blocks_raw, parse_confidence, flags).

    A block has its path of headings, its rule (its heading, if that states one, and the prose of its own items) and the courses of
    its own items. A row for each row of pages: repeated and null poids stand for themselves; pages are walked once. needs_review: no container, no block, a code that can't be read, or a rule without anything below it. Null html: an empty page.
    """
    rows = kept(cores(pages), "cores")
    heads = rows.where("kind = 'block'").select("page", "pos", clean(F.col("heading")).alias("own"), F.transform("path", lambda h: clean(h)).alias("above"))
    items = rows.where("kind in ('course', 'prose')").withColumn("text", clean(F.col("text"))).withColumn("code", F.when(F.col("kind") == "course", code_of(F.col("text"))))
    listed = F.array_sort(F.collect_list(F.when(F.col("kind") == "course", F.struct("n", F.coalesce("code", "text").alias("x")))))
    prose = F.array_sort(F.collect_list(F.when((F.col("kind") == "prose") & (F.col("text") != ""), F.struct("n", F.col("text").alias("x")))))
    inside = items.groupBy("page", "pos").agg(listed.alias("c"), prose.alias("p"), F.count_if((F.col("kind") == "course") & F.col("code").isNull()).alias("bad"))
    below = heads.where(F.size("above") > 0).select("page", F.concat_ws(" / ", "above").alias("parent")).distinct().withColumn("nested", F.lit(True))
    full = F.concat_ws(" / ", F.concat("above", F.when(F.coalesce("own", F.lit("")) != "", F.array("own")).otherwise(F.array().cast("array<string>"))))
    b = heads.join(inside, ["page", "pos"], "left").withColumn("heading", full)
    b = b.join(below.withColumnRenamed("parent", "heading"), ["page", "heading"], "left")
    xs = lambda c: F.transform(F.coalesce(c, F.array().cast("array<struct<n:int,x:string>>")), lambda s: s["x"])
    b = b.withColumns({"courses": xs(F.col("c")), "prose": xs(F.col("p")), "own": F.coalesce("own", F.lit("")), "bad": F.coalesce("bad", F.lit(0))}).withColumn("ruled", (F.col("own") != "") & is_rule(F.col("own")))
    said = F.array_join("prose", "; ")
    rule = F.when(F.size("prose") > 0, F.when(F.col("own") != "", clean(F.concat_ws(" ", "own", said))).otherwise(said)).otherwise(F.when(F.col("ruled"), F.col("own")))
    empty = F.col("ruled") & (F.size("courses") == 0) & (F.size("prose") == 0) & F.col("nested").isNull()
    flags = F.array_compact(F.array(F.when(empty, F.concat(F.lit("rule-block-empty: "), "heading")), F.when(F.col("bad") > 0, F.concat(F.col("bad").cast("string"), F.lit(" unparseable course code(s) in "), "heading"))))
    b = b.withColumns({"rule_text_raw": rule, "flags": flags})
    block = F.struct("pos", "heading", "rule_text_raw", "courses")
    keep = (F.col("own") != "") | (F.size("courses") > 0)
    by_page = b.groupBy("page").agg(F.array_sort(F.collect_list(F.when(keep, block))).alias("b"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", "flags"))), lambda s: s["flags"])).alias("some"))
    name = clean(F.regexp_replace(F.regexp_replace("title", " - University of Alberta.*$", ""), "Program: ", ""))
    out = rows.where("kind = 'page'").select("page", "poid", "content", name.alias("program_name")).join(by_page, "page", "left")
    flags = F.concat(F.array_compact(F.array(F.when(~F.col("content"), "no-block_content-container"), F.when(F.col("content") & F.col("some").isNull(), "no-acalog-core-blocks"))), F.coalesce("some", F.array().cast("array<string>")))
    blocks = F.when(F.col("content"), F.transform("b", lambda s: s.dropFields("pos")))
    out = out.withColumns({"flags": flags, "requirement_blocks_raw": F.coalesce(blocks, F.array().cast("array<struct<heading:string,rule_text_raw:string,courses:array<string>>>"))})
    return out.select("poid", "program_name", degree_of(F.col("program_name")).alias("degree"), "requirement_blocks_raw", F.when(F.size("flags") > 0, "needs_review").otherwise("high").alias("parse_confidence"), "flags")
