"""Pages as rows of nodes, numbered so that ancestry is a comparison of intervals."""

from __future__ import annotations

from html.parser import HTMLParser

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.batches import bounded_batches, frames
from .programs import VOID

NODE = "pre int, post int, depth int, tag string, text string"


class _Nodes(HTMLParser):
    """An element is closed by its end, by the end of one that holds it, or by the end of the page; ends of elements that aren't open say nothing."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[list] = []
        self.open: list[int] = []

    def handle_starttag(self, tag, attrs):
        n = len(self.rows)
        self.rows.append([n, n, len(self.open), tag, []])
        if tag not in VOID:
            self.open.append(n)

    def handle_endtag(self, tag):
        if any(self.rows[n][3] == tag for n in self.open):
            while self._close() != tag:
                pass

    def _close(self) -> str:
        row = self.rows[self.open.pop()]
        row[1] = len(self.rows) - 1
        return row[3]

    def handle_data(self, data):
        if self.open:
            self.rows[self.open[-1]][4].append(data)

    def finish(self) -> list[list]:
        self.close()
        while self.open:
            self._close()
        return self.rows


def nodes(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """pages -> (key, row, pre, post, depth, tag, text) of all elements: those inside one have numbers after its ``pre`` and up to its ``post``.

    row tells pages with equal keys apart. text: an element's own, without that of elements in it. Null html: no nodes.
    """
    kind = pages.schema[key].dataType.simpleString()

    bounded_batches(pages.sparkSession)

    def rows(batches):
        for pdf in batches:
            for k, row, page in zip(pdf["k"], pdf["row"], pdf["html"], strict=True):
                p = _Nodes()
                p.feed(page or "")
                for r in p.finish():
                    yield (k, row, *r[:4], "".join(r[4]))

    def walk(batches):
        yield from frames(rows(batches), ["k", "row", *(x.split()[0] for x in NODE.split(", "))])

    out = pages.select(F.col(key).alias("k"), F.monotonically_increasing_id().alias("row"), F.col(html).alias("html")).mapInPandas(walk, f"k {kind}, row long, {NODE}")
    return out.withColumnRenamed("k", key)


def ancestors(below: DataFrame, above: DataFrame) -> DataFrame:
    """below, above (row, pre, post, depth, tag, text) -> (row, pre, at, depth, tag, text) of each node of below and each of above that holds it."""
    b = below.select("row", "pre")
    a = above.select("row", F.col("pre").alias("at"), "post", "depth", "tag", "text")
    return b.join(a, "row").where((F.col("pre") > F.col("at")) & (F.col("pre") <= F.col("post"))).drop("post")


def paths(some: DataFrame, every: DataFrame) -> DataFrame:
    """(row, pre, path): the tags of all that holds a node, outermost first, joined by '>'; empty at the top."""
    inside = ancestors(some, every).groupBy("row", "pre").agg(F.array_sort(F.collect_list(F.struct("depth", "tag"))).alias("x"))
    return some.select("row", "pre").join(inside, ["row", "pre"], "left").select("row", "pre", F.coalesce(F.array_join(F.transform("x", lambda s: s["tag"]), ">"), F.lit("")).alias("path"))
