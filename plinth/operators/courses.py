"""Course pages to course rows, snapshots of them, and text spans of a snapshot.

A DOM walk on the executors turns a page into a row of what it holds, in order; everything after that is columns, so pages aren't shuffled.
"""

from __future__ import annotations

import re
from functools import lru_cache
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.terms import level, season_of, season_rank, term_code, term_year
from ..functions.text import clean
from ..sources.batches import ROWS, bounded_batches, dealt, frames
from .extract import clause_column, date_column, expand_days, let, section_cell, time_column

NODE = "page long, url string, pos int, tag string, text string, name string, times array<struct<kind:string,text:string>>, capacity string"
NODE_NAMES = ["page", "url", "pos", "tag", "text", "name", "times", "capacity"]
PAGE = (
    "url string, undescribed boolean, h1 string, units_string string, metas array<struct<name:string,text:string>>, paragraphs array<struct<text:string,name:string,stage:string,note_of:string>>, "
    "lines array<struct<text:string,name:string,capacity:string,term:string,times:array<struct<kind:string,text:string>>>>"
)
TERM = re.compile("(?:Winter|Spring|Summer|Fall) Term [0-9]{4}")
#: Markup that has one reading: tags with quoted attributes, a doctype, text. Elements whose content is read otherwise. Rows and tags remembered.
TOKEN = re.compile(r'<(?:/[a-zA-Z][a-zA-Z0-9]*|[a-zA-Z][a-zA-Z0-9]*(?:[ \t\n]+[a-zA-Z_][-a-zA-Z0-9_:.]*="[^"<>]*")*[ \t\n]*/?|!DOCTYPE [^<>]*)>|[^<]+')
RAW = {"script", "style", "title", "textarea", "xmp", "iframe", "noembed", "noframes", "noscript", "plaintext"}
TEXT = re.compile(">([^<]+)")
REMEMBERED = 4096
NO_DESCRIPTION = "There is no available course description"


class _Nodes(HTMLParser):
    """Rows in document order: meta, h1, h2 (name: class), h3, p (name: 'faculty' or class), div, table, row."""

    def __init__(self):
        super().__init__()
        self.rows: list[list] = []
        self.text: list[tuple[str, int, list[str]]] = []  # open text blocks: tag, index of their row, parts
        self.mute = 0
        self.row: dict | None = None
        self.column: list | None = None
        self.depth = 0
        self.undescribed = False  # the page says that it has no description

    def add(self, tag, text="", name=""):
        self.rows.append([len(self.rows), tag, text, name, [], None])
        return len(self.rows) - 1

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag in ("script", "style"):
            self.mute += 1
        elif tag == "meta" and a.get("name"):
            self.add("meta", a.get("content") or "", a["name"])
        elif tag == "tr":
            self.row = {"at": self.add("row"), "cell": None, "parts": {}}
        elif self.row is not None and tag == "td":
            self.row["cell"] = a.get("data-card-title") or "other"
            self.row["parts"].setdefault(self.row["cell"], [])
        elif self.row is not None:
            if tag == "div":
                self.depth += 1
                if "col" in (a.get("class") or "").split() and self.row["cell"] == "Class times":
                    self.column = [self.depth, "", []]
            if self.column and "fa-calendar" in (a.get("class") or ""):
                self.column[1] = "date"
            if self.column and "fa-clock" in (a.get("class") or ""):
                self.column[1] = "time"
            if tag == "br" and self.row["cell"]:
                self.row["parts"][self.row["cell"]].append(" ")
        elif tag in ("h1", "h2", "h3", "p"):
            self.text.append((tag, self.add(tag, "", a.get("class") or ""), []))
        elif tag in ("div", "table"):
            self.add(tag)
        elif tag == "a" and self.text and self.text[-1][0] == "p" and "/catalogue/faculty/" in (a.get("href") or ""):
            self.rows[self.text[-1][1]][3] = "faculty"

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.mute = max(0, self.mute - 1)
        elif self.row is not None and tag == "div":
            if self.column and self.column[0] == self.depth:
                text = " ".join("".join(self.column[2]).split())
                if text:
                    self.rows[self.row["at"]][4].append((self.column[1], text))
                self.column = None
            self.depth -= 1
        elif tag == "tr" and self.row is not None:
            parts = {k: " ".join("".join(v).split()) for k, v in self.row["parts"].items()}
            at = self.rows[self.row["at"]]
            at[2], at[3], at[5] = parts.get("Section"), parts.get("Class times"), parts.get("Capacity")
            self.row, self.column, self.depth = None, None, 0
        elif self.text and any(t == tag for t, _, _ in self.text):
            while self.text:
                t, at, parts = self.text.pop()
                self.rows[at][2] = " ".join("".join(parts).split())
                if t == tag:
                    break

    def handle_data(self, data):
        if self.mute:
            return
        self.undescribed |= NO_DESCRIPTION in " ".join(data.split())
        if self.row is not None:
            if self.row["cell"]:
                self.row["parts"][self.row["cell"]].append(data)
            if self.column:
                self.column[2].append(data)
        elif self.text:
            self.text[-1][2].append(data)


class _Tags(HTMLParser):
    """What a text of one tag says: (whether it begins, tag, attributes) of each."""

    def __init__(self, text: str):
        super().__init__()
        self.said: list[tuple] = []
        self.feed(text)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.said.append((True, tag, attrs))

    def handle_endtag(self, tag):
        self.said.append((False, tag, None))


def _tokens(text: str) -> list | None:
    """Markup as texts (str) and lists of what tags say; None: not of the plain kind."""
    found = TOKEN.findall(text)
    if sum(map(len, found)) < len(text):
        return None
    out = [(unescape(t) if "&" in t else t) if t[0] != "<" else _said(t) if len(t) < 100 else _Tags(t).said for t in found]
    return None if any(tag in RAW for said in out if said.__class__ is list for _, tag, _ in said) else out


@lru_cache(REMEMBERED)
def _said(tag: str) -> list[tuple]:
    return _Tags(tag).said


_short_tokens = lru_cache(REMEMBERED)(_tokens)


def _take(p: _Nodes, text: str) -> bool:
    """Feeds p; False: not of the plain kind."""
    tokens = _short_tokens(text) if len(text) < 100 else _tokens(text)
    for t in tokens or ():
        if t.__class__ is str:
            p.handle_data(t)
        else:
            for begins, tag, attrs in t:
                if begins:
                    p.handle_starttag(tag, attrs)
                else:
                    p.handle_endtag(tag)
    return tokens is not None


@lru_cache(REMEMBERED)
def _form(tags: tuple) -> list | None:
    """What a table row says of whose markup the texts were cut out, with the > before each, as formats of these texts: (text, name, times, capacity). None: it says more than a row, or isn't plain."""
    p, texts = _Nodes(), [chr(0xE000 + k) for k in range(len(tags) - 1)]
    row = "<tr>" + "".join(t + ">" + x for t, x in zip(tags, texts, strict=False)) + tags[-1] + "</tr>"
    if len(texts) > 6000 or [t for t in TOKEN.findall(row) if t[0] != "<"] != texts or not _take(p, row):
        return None
    if len(p.rows) != 1 or p.row is not None or p.text or p.mute or p.column or p.depth:
        return None
    as_format = lambda x: None if x is None else "".join("{%d}" % (ord(c) - 0xE000) if c != " " else c for c in x)
    _, _, text, name, times, capacity = p.rows[0]
    return [as_format(text), as_format(name), [(kind, as_format(x)) for kind, x in times], as_format(capacity)]


def _plain(html: str) -> _Nodes | None:
    """The nodes of a page of plain markup, each form of tag and of table row read once; None: it isn't plain."""
    p = _Nodes()
    escaped, there = "&" in html, "&" in html or "There" in html
    first, *rows = html.split("<tr>")
    if not _take(p, first):
        return None
    for text in rows:
        at = text.find("</tr>")
        form = None
        if at >= 0 and p.row is None and not p.text and not p.mute:
            cut = TEXT.split(text[:at])
            form = _form(tuple(cut[::2])) if len(cut) < 1000 else None
        if not form:
            if not _take(p, "<tr>" + text):
                return None
            continue
        said = [unescape(x) for x in cut[1::2]] if escaped else cut[1::2]
        if there and not p.undescribed:
            p.undescribed = any(NO_DESCRIPTION in " ".join(x.split()) for x in said)
        cell, name, times, capacity = form
        columns = [(kind, " ".join(x.format(*said).split())) for kind, x in times]
        p.rows.append([
            len(p.rows), "row", cell if cell is None else " ".join(cell.format(*said).split()), name if name is None else " ".join(name.format(*said).split()),
            [x for x in columns if x[1]], capacity if capacity is None else " ".join(capacity.format(*said).split()),
        ])
        rest = text[at + 5 :]
        if rest and not _take(p, rest):
            return None
    return p


def _read(html: str) -> _Nodes:
    """The nodes of a page: by its tokens if its markup is plain, else by the parser, which says the same."""
    p = _plain(html)
    if p is None:
        p = _Nodes()
        p.feed(html)
    p.close()
    return p


def _page(p: _Nodes) -> tuple:
    """(undescribed, h1, units, metas, paragraphs, lines) of a page's nodes.

    A paragraph's stage: 'open' after the faculty's, 'shut' after a block of another kind. note_of: the term below whose heading it is the first long one, before a table or smaller
    heading. A line's term: the last heading of a term before it.
    """
    h1 = units = stage = term = below = None
    metas, paragraphs, lines = [], [], []
    for _, tag, text, name, times, capacity in p.rows:
        if tag == "row":
            if text is not None:
                lines.append((text, name, capacity, term or "Unknown", times))
        elif tag == "meta":
            if name.startswith("ua__cat"):
                metas.append((name, text))
        elif tag == "p":
            long = len(text) > 60
            if text:
                paragraphs.append((text, name, stage, below if long else None))
            if long:
                below = None
            if name == "faculty":
                stage = "open"
        elif tag == "h1":
            h1 = text if h1 is None else h1
        else:
            stage = "shut"
            if tag == "h2":
                units = text if units is None and "fs-5" in name else units
                if TERM.fullmatch(text):
                    term = below = text
            elif tag in ("h3", "table"):
                below = None
    return p.undescribed, h1, units, metas, paragraphs, lines


def _lists(rows: list[list], columns: list[str], nested: dict[str, list[str]] = {}) -> pa.Array:  # noqa: B006
    """Lists of structs of texts, or of lists of such structs, as an array."""
    flat = [x for some in rows for x in some]
    of = list(zip(*flat, strict=True)) or [()] * len(columns)
    fields = [_lists(list(x), nested[c]) if c in nested else pa.array(x, pa.string()) for c, x in zip(columns, of, strict=True)]
    offsets = [0]
    for some in rows:
        offsets.append(offsets[-1] + len(some))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(fields, columns))


def _batch(urls: list, pages: list[tuple]) -> pa.RecordBatch:
    undescribed, h1, units, metas, paragraphs, lines = (list(x) for x in zip(*pages, strict=True))
    arrays = [
        pa.array(urls, pa.string()), pa.array(undescribed, pa.bool_()), pa.array(h1, pa.string()), pa.array(units, pa.string()), _lists(metas, ["name", "text"]),
        _lists(paragraphs, ["text", "name", "stage", "note_of"]), _lists(lines, ["text", "name", "capacity", "term", "times"], {"times": ["kind", "text"]}),
    ]
    return pa.RecordBatch.from_arrays(arrays, [x.split()[0] for x in PAGE.split(", ")])


def walked(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """A row (PAGE) for each row of pages, given away as soon as ROWS nodes are there: a task holds these and one page more."""
    bounded_batches(pages.sparkSession)

    def walk(batches):
        urls, read, n = [], [], 0
        for batch in batches:
            for u, text in zip(batch.column(0), batch.column(1), strict=True):
                p = _read(text.as_py() or "")
                urls.append(u.as_py())
                read.append(_page(p))
                n += len(p.rows) + 1
                if n >= ROWS:
                    yield _batch(urls, read)
                    urls, read, n = [], [], 0
        if urls:
            yield _batch(urls, read)

    return pages.select(F.col(url).alias("url"), F.col(html).alias("html")).mapInArrow(walk, PAGE)


def nodes(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Node rows of pages. page: a number of each row of pages, so that repeated or null urls don't mix; its first node, 'page', has what the page says of itself."""

    bounded_batches(pages.sparkSession)

    def rows(batches):
        for pdf in batches:
            for page, u, text in zip(pdf["page"], pdf["url"], pdf["html"], strict=True):
                p = _read(text or "")
                yield page, u, -1, "page", NO_DESCRIPTION if p.undescribed else "", "", [], None
                for pos, tag, x, name, times, cap in p.rows:
                    yield page, u, pos, tag, x, name, [{"kind": k, "text": t} for k, t in times], cap

    def walk(batches):
        yield from frames(rows(batches), NODE_NAMES)

    some = dealt(pages.select(F.col(url).alias("url"), F.col(html).alias("html")), F.xxhash64("url", "html"))
    return some.select(F.monotonically_increasing_id().alias("page"), "url", "html").mapInPandas(walk, NODE)


def quoted(x: Column) -> Column:
    """A text within the quotes that it doesn't hold itself: single ones, if it can be."""
    q = F.when(F.contains(x, F.lit("'")) & ~F.contains(x, F.lit('"')), '"').otherwise("'")
    return F.concat(q, x, q)


def _kinds(times: Column) -> Column:
    """Icons tell dates from times; without one the text does, and a date is the default."""
    guess = lambda t: F.when(t.rlike("[0-9]{4}-[0-9]{2}-[0-9]{2}"), "date").when(t.rlike("[0-9]{1,2}:[0-9]{2}"), "time").otherwise("date")
    return F.transform(times, lambda c: F.struct(F.when(c["kind"] != "", c["kind"]).otherwise(guess(c["text"])).alias("kind"), c["text"].alias("text")))


def sections(lines: Column) -> Column:
    """Lines of a page -> [(section, flags)]: a struct for each table row, under the term heading that stands before it; flags: what of the row could not be read."""
    none = F.array().cast("array<string>")

    def column(c: Column) -> Column:
        """A column with what a date or a time says, each looked for once."""
        return F.struct(c["kind"].alias("kind"), c["text"].alias("text"), F.when(c["kind"] == "date", date_column(c["text"])).alias("d"), F.when(c["kind"] == "time", time_column(c["text"])).alias("t"))

    def with_days(c: Column) -> Column:
        return F.struct(c["kind"].alias("kind"), c["text"].alias("text"), c["d"].alias("d"), c["t"].alias("t"), expand_days(c["d"]["days"]).alias("days"))

    def seen(line: Column) -> Column:
        cols = F.transform(F.transform(_kinds(line["times"]), column), with_days)
        return F.struct(line["term"].alias("term"), section_cell(line["text"]).alias("cell"), clean(line["text"]).alias("text"), line["name"].alias("name"), clean(line["capacity"]).alias("seats"), cols.alias("cols"))

    def paired(line: Column, i: Column) -> Column:
        return F.coalesce(F.get(line["cols"], i + 1)["kind"] == "time", F.lit(False))

    def one(line: Column, c: Column, i: Column) -> Column:
        """The meeting that begins at column i, null if none does."""
        d, t = c["d"], F.get(line["cols"], i + 1)["t"]
        ok = (c["kind"] == "date") & d["date_start"].isNotNull() & paired(line, i) & t["time_start"].isNotNull()
        fields = F.struct(d["date_start"].alias("date_start"), d["date_end"].alias("date_end"), c["days"]["days"].alias("days"), t["time_start"].alias("time_start"), t["time_end"].alias("time_end"))
        return F.when(F.coalesce(ok, F.lit(False)), fields)

    def used(line: Column, c: Column, i: Column) -> Column:
        """A time that belongs to the date before it."""
        before = F.when(i > 0, F.get(line["cols"], i - 1))
        return F.coalesce((c["kind"] == "time") & (before["kind"] == "date") & before["d"]["date_start"].isNotNull(), F.lit(False))

    def wrong(line: Column, c: Column, i: Column) -> Column:
        """What of a column can't be read (fixed wording)."""
        days = F.transform(c["days"]["unknown"], lambda u: F.concat(F.lit("unknown-day-code:"), quoted(u), F.lit(" in "), quoted(c["text"])))
        after = F.get(line["cols"], i + 1)
        time = F.when(paired(line, i) & after["t"]["time_start"].isNull(), F.array(F.concat(F.lit("unparseable-time-col:"), quoted(after["text"])))).otherwise(none)
        date = F.when(c["d"]["date_start"].isNull(), F.array(F.concat(F.lit("unparseable-date-col:"), quoted(c["text"])))).otherwise(F.concat(F.coalesce(days, none), time))
        return F.when(c["kind"] == "date", date).when(~used(line, c, i), F.array(F.concat(F.lit("orphan-time-col:"), quoted(c["text"])))).otherwise(none)

    def found(line: Column) -> Column:
        return F.struct(line.alias("line"), F.transform(line["cols"], lambda c, i: one(line, c, i)).alias("found"))

    def met(x: Column) -> Column:
        return F.struct(x["line"].alias("line"), x["found"].alias("found"), F.array_distinct(F.array_compact(x["found"])).alias("meetings"))

    def told(x: Column) -> Column:
        line, cell, seats = x["line"], x["line"]["cell"], x["line"]["seats"]
        left = lambda c, i: F.when(~used(line, c, i) & F.get(x["found"], i).isNull(), c["text"])  # noqa: E731  the text of a column that is in no meeting
        empty = F.when(F.size(x["meetings"]) == 0, F.coalesce(F.nullif(clean(line["name"]), F.lit("")), F.lit("No scheduled meeting times")))
        note = let(F.array_join(F.array_compact(F.transform(line["cols"], left)), " | "), lambda rest: F.when(rest != "", rest).otherwise(empty))
        section = F.struct(
            line["term"].alias("term"), term_code(line["term"]).cast("string").alias("term_code"), cell["component"].alias("component"), cell["section"].alias("section"), cell["class_id"].alias("class_id"),
            seats.try_cast("int").alias("capacity"), x["meetings"].alias("meetings"), note.alias("schedule_note"), F.lit(None).cast("string").alias("instructor"), F.lit(None).cast("string").alias("location"),
        )
        some = F.array_compact(F.array(
            F.when(cell["class_id"].isNull(), F.concat(F.lit("section-cell-no-classid:"), quoted(line["text"]))).when(cell["section"].isNull(), F.concat(F.lit("section-cell-no-section-label:"), quoted(line["text"]))),
            F.when((seats != "") & seats.try_cast("int").isNull(), F.concat(F.lit("unparseable-capacity:"), quoted(seats))),
            F.when(line["name"].isNull(), F.lit("missing-class-times-cell")),
        ))
        all_ = F.concat(some, F.flatten(F.transform(line["cols"], lambda c, i: wrong(line, c, i))))
        where = F.trim(F.concat(F.coalesce(cell["component"], F.lit("")), F.lit(" "), F.coalesce(cell["section"], F.lit("")), F.lit(" ("), F.coalesce(cell["class_id"], F.lit("None")), F.lit(")")))
        named = F.transform(all_, lambda w: F.concat(F.lit("["), line["term"], F.lit(" "), where, F.lit("] "), w))
        return F.struct(section.alias("section"), named.alias("flags"))

    some = F.filter(F.transform(F.transform(F.transform(lines, seen), found), met), lambda x: x["line"]["cell"]["component"].isNotNull() | (F.size(x["meetings"]) > 0))
    return F.transform(some, told)


def term_notes(paragraphs: Column, description: Column) -> Column:
    """[(at, term, note)] in order of terms' headings: of each term the first paragraph of over 60 characters below its heading, before a table or a smaller heading, where it isn't the course's description.

    Of a term that is named twice the last note counts, and the place of the first.
    """
    told = F.filter(F.transform(paragraphs, lambda p, i: F.struct(p["note_of"].alias("term"), i.alias("at"), p["text"].alias("note"))), lambda n: n["term"].isNotNull() & ~n["note"].eqNullSafe(clean(description)))
    near = lambda x, i: F.when(i >= 0, F.get(x, i)["term"])
    by_term = lambda x: F.zip_with(
        F.filter(x, lambda n, i: ~n["term"].eqNullSafe(near(x, i - 1))), F.filter(x, lambda n, i: ~n["term"].eqNullSafe(near(x, i + 1))), lambda a, b: F.struct(a["at"].alias("at"), a["term"].alias("term"), b["note"].alias("note"))
    )
    return let(F.array_sort(told), lambda x: F.array_sort(by_term(x)))


def description(paragraphs: Column) -> Column:
    """The first paragraph after the faculty's, before any block of another kind; else the longest of over 40 characters."""
    own = F.filter(F.transform(paragraphs, lambda p, i: F.struct(p["text"].alias("text"), p["name"].alias("name"), p["stage"].alias("stage"), i.alias("at"))), lambda p: p["name"] != "faculty")
    near = lambda x: F.get(F.filter(x, lambda p: p["stage"] == "open"), F.lit(0))["text"]
    free = lambda x: F.filter(x, lambda p: ~F.contains(p["name"], F.lit("breadcrumb")) & (F.length(p["text"]) > 40))
    longest = lambda x: F.array_max(F.transform(free(x), lambda p: F.struct(F.length(p["text"]).alias("n"), (-p["at"]).alias("at"), p["text"].alias("text"))))["text"]
    return let(own, lambda x: F.coalesce(near(x), longest(x)))


def last_of_each(metas: Column) -> Column:
    """[(name, text)] as a map; of a name that stands twice the last."""
    at = F.array_sort(F.transform(metas, lambda e, i: F.struct(e["name"].alias("name"), i.alias("at"), e["text"].alias("text"))))
    last = let(at, lambda x: F.filter(x, lambda e, i: ~e["name"].eqNullSafe(F.get(x, i + 1)["name"])))
    return F.map_from_entries(F.transform(last, lambda e: F.struct(e["name"], e["text"])))


def parse_courses(pages: DataFrame, url: str = "url", html: str = "html", deal: bool = True) -> DataFrame:
    """Course rows of course pages, a row for each row of pages, with ``flags``: what could not be read. Meta tags come first, the first heading stands in.

    Repeated and null urls stand for themselves; null html is an empty page. deal=False: pages that are in many parts already are read where they are.
    """
    some = pages.select(F.col(url).alias("url"), F.col(html).alias("html"))
    rows = walked(dealt(some, F.xxhash64("url", "html")) if deal else some)
    rows = rows.select("url", "undescribed", "h1", "units_string", last_of_each(F.col("metas")).alias("meta"), "paragraphs", description(F.col("paragraphs")).alias("description_raw"), sections(F.col("lines")).alias("s"))
    rows = rows.withColumns({"c": clause_column(F.col("description_raw")), "notes": term_notes(F.col("paragraphs"), F.col("description_raw"))})
    changed = F.transform("notes", lambda s: F.concat(F.lit("["), s["term"], F.lit("] per-term-description differs from top description (course-is-changing block)")))
    notes = F.when(F.size("notes") > 0, F.map_from_entries(F.transform("notes", lambda s: F.struct(s["term"], s["note"]))))
    df = rows.select(
        "url", "undescribed", "h1", "units_string", "meta", "description_raw", "c.*", F.transform("s", lambda x: x["section"]).alias("sections"), F.flatten(F.transform("s", lambda x: x["flags"])).alias("section_flags"),
        notes.alias("term_notes"), changed.alias("term_flags"),
    )
    m = lambda k: F.try_element_at("meta", F.lit(f"ua__cat_{k}"))
    h = lambda k: F.nullif(F.regexp_extract("h1", "^\\s*([A-Z][A-Z &]*?)\\s+([0-9][0-9A-Za-z]*)\\b", k), F.lit(""))
    subject, number = F.coalesce(m("subject"), h(1), F.lit("")), F.coalesce(m("catalog"), h(2), F.lit(""))
    course = F.coalesce(m("course"), F.when(h(1).isNotNull(), F.concat_ws(" ", h(1), h(2))), F.lit("UNKNOWN"))
    terms = F.filter(F.transform(F.split(F.coalesce(m("term"), F.lit("")), ","), lambda t: F.trim(t)), lambda t: t != "")
    n = F.coalesce(F.size("sections"), F.lit(0))
    listed = m("sections").try_cast("int")
    at = F.concat(F.lit("["), course, F.lit("] "))
    none = F.array().cast("array<string>")
    before = F.array_compact(F.array(  # fixed wording
        F.when(m("course").isNull() | m("subject").isNull() | m("catalog").isNull(), F.concat(F.lit("missing-course-meta:"), F.coalesce("url", F.lit("")))),
        F.when(F.col("description_raw").isNull() & ~F.col("undescribed"), F.concat(F.lit("missing-description:"), course)),
        F.when(F.col("combined"), F.concat(at, F.lit("combined-prereq/coreq clause captured into both fields"))),
        F.when(F.contains("description_raw", F.lit("Prerequisite")) & F.col("prereq_raw").isNull(), F.concat(at, F.lit("prereq-leadin-present-but-unparsed"))),
    ))
    after = F.array_compact(F.array(F.when(listed.isNotNull() & (listed != n), F.concat(at, F.format_string("section-count-mismatch: parsed=%d meta=%d", n, listed)))))
    flags = F.concat(before, F.coalesce("section_flags", none), F.coalesce("term_flags", none), after)
    return df.select(
        course.alias("course_id"), subject.alias("subject"), number.alias("catalog_number"), m("coursetitle").alias("title"), m("credits").try_cast("double").alias("credits"), m("faculty").alias("faculty"),
        m("career").alias("career"), "units_string", "description_raw", "prereq_raw", "coreq_raw", "credit_exclusion_raw", terms.alias("terms_offered"), F.col("url").alias("source_url"),
        "sections",
        F.nullif(clean(F.regexp_extract("description_raw", "(?s)(See Note.*|Note:.*)", 1)), F.lit("")).alias("note_raw"), "term_notes", listed.alias("meta_sections"), m("sections_online").try_cast("int").alias("meta_sections_online"), flags.alias("flags"),
    )


def term_key(term: Column) -> Column:
    return F.struct(term_year(term), season_rank(season_of(term)), term)


def snapshot(courses: DataFrame, snapshot_id: str) -> DataFrame:
    """A frozen row for each course: units, level, terms in order, clauses, sections without notes, people and places."""
    ordered = F.transform(F.array_sort(F.transform("terms_offered", lambda t: F.struct(term_year(t).alias("y"), season_rank(season_of(t)).alias("r"), t.alias("t")))), lambda s: s["t"])
    compact = F.transform("sections", lambda s: s.dropFields("term_code", "schedule_note", "instructor", "location"))
    return courses.select(F.lit(snapshot_id).alias("snapshot_id"), "course_id", F.col("credits").alias("units"), "subject", level(F.col("catalog_number")).alias("level"), "title", ordered.alias("terms"), "prereq_raw", "coreq_raw", "credit_exclusion_raw", compact.alias("sections"))


def snapshot_terms(snapshots: DataFrame) -> DataFrame:
    """(snapshot_id, term, ord, season) of all terms of each snapshot, in order."""
    rows = snapshots.select("snapshot_id", F.explode("terms").alias("term")).distinct()
    order = Window.partitionBy("snapshot_id").orderBy(term_key(F.col("term")))
    return rows.select("snapshot_id", "term", (F.row_number().over(order) - 1).alias("ord"), season_of(F.col("term")).alias("season"))


def number(x: Column) -> Column:
    """3.0 as 3, 1.5 as 1.5."""
    return F.regexp_replace(x.cast("double").cast("string"), "\\.0$", "")


def spans(snapshots: DataFrame) -> DataFrame:
    """(id, kind, course, term, text, total_capacity): one for each course, and one for each course and term that has sections."""
    terms = F.when(F.size("terms") > 0, F.array_join("terms", ", ")).otherwise("not offered in this snapshot")
    about = F.concat(
        F.lit("["), "course_id", F.lit("] "), F.coalesce("title", "course_id"), F.lit(" ("), number(F.coalesce("units", F.lit(0.0))), F.lit(" units, "), F.coalesce(F.col("level").cast("string"), F.lit("None")),
        F.lit("-level). Offered: "), terms, F.lit(". Prerequisite: "), F.coalesce("prereq_raw", F.lit("none listed")), F.lit("."),
    )
    none = F.lit(None).cast("string")
    one = snapshots.select(F.concat("course_id", F.lit("::course")).alias("id"), F.lit("course").alias("kind"), F.col("course_id").alias("course"), none.alias("term"), about.alias("text"), F.lit(None).cast("long").alias("total_capacity"))
    meeting = lambda m: F.concat_ws(" ", F.nullif(F.array_join(m["days"], ""), F.lit("")), F.when(m["time_start"].isNotNull(), F.concat_ws("-", m["time_start"], m["time_end"])).otherwise(F.when(F.size(m["days"]) > 0, "(time TBA)").otherwise("time TBA")))
    rows = snapshots.select(F.col("course_id").alias("course"), F.posexplode_outer("sections").alias("pos", "s")).where("pos is not null")  # outer: a plain one's sections are computed twice, to see whether there are any
    when = F.coalesce(F.nullif(F.array_join(F.transform("s.meetings", meeting), "; "), F.lit("")), F.lit("time TBA"))
    part = F.concat(F.concat_ws(" ", "s.component", F.coalesce("s.section", F.lit("")), when), F.when(F.col("s.capacity").isNotNull(), F.format_string(" (capacity %d)", "s.capacity")).otherwise(""))
    grouped = rows.groupBy("course", F.col("s.term").alias("term")).agg(F.array_sort(F.collect_list(F.struct("pos", part.alias("x")))).alias("parts"), F.coalesce(F.sum("s.capacity"), F.lit(0)).alias("total_capacity"))
    key = F.concat_ws("::", "course", "term")
    text = F.concat(F.lit("["), key, F.lit("] "), "course", F.lit(" in "), "term", F.lit(": "), F.array_join(F.transform("parts", lambda p: p["x"]), "; "), F.lit(". Total capacity "), F.col("total_capacity").cast("string"), F.lit("."))
    return one.unionByName(grouped.select(key.alias("id"), F.lit("offering").alias("kind"), "course", "term", text.alias("text"), "total_capacity"))


def embed_text(span: DataFrame) -> DataFrame:
    """The text to index: the course's code twice before it."""
    return span.withColumn("embed_text", F.concat_ws(" ", "course", "course", "text"))
