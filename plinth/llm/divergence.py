"""How the sources of a language differ in their terms, by inclusion and exclusion over the terms that each source has.

A term's price in a group is p = 1 + floor(SCALE (n + EXTRA) / (N + EXTRA V)), in whole numbers. The sum of |p - p'| of two groups over all V terms
of their language is
  what the terms of either cost against the other's price of no occurrence (from a histogram of each group's counts: running sums, no term is touched),
  corrected for terms that both have (a join of postings by term),
  and a constant for each term that neither has.
Work follows postings and pairs of sources, never V times the pairs.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import prepare, stage, text_offsets

SCALE, EXTRA = 1_000_000_000, 5
#: Entries that a task counts before it hands them on, and bytes of a text that are split at a time.
ENTRIES, BYTES = 400_000, 4 << 20
COUNTS = "lang string, source string, term string, n long, docs long"
#: A term is a run of ASCII letters and of all that isn't ASCII; only A-Z are lower-cased.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: bytes):
    """Lists of a text's terms, a piece of about BYTES bytes at a time; pieces end between terms."""
    at = 0
    while at < len(text):
        to = min(at + BYTES, len(text))
        low = text[at:to].translate(LETTERS)
        if to < len(text) and low[-1] != 32:
            rest = memoryview(text)[to:]
            step = 0
            while step < len(rest) and LETTERS[rest[step]] != 32:
                step += 1
            low, to = low + text[to : to + step].translate(LETTERS), to + step
        yield low.split()
        at = to


def _flush(groups: dict):
    for (lang, source), (n, docs) in groups.items():
        words = list(n)
        for at in range(0, len(words), 50_000):
            some = words[at : at + 50_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(some)), pa.array([source] * len(some)), pa.array(some, pa.binary()).cast(pa.string()), pa.array([n[w] for w in some], pa.int64()), pa.array([docs[w] for w in some], pa.int64())],
                ["lang", "source", "term", "n", "docs"],
            )


def _count(batches):
    """Counts of a task's terms by group, handed on whenever there are ENTRIES of them."""
    groups: dict = {}
    size = 0
    for batch in batches:
        raw, offs = text_offsets(batch.column("text"))
        for lang, source, a, b in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), offs[:-1].tolist(), offs[1:].tolist(), strict=True):
            n, docs = groups.setdefault((lang, source), (Counter(), Counter()))
            before = len(n)
            seen: set = set()
            for some in terms(raw[a:b].tobytes()):
                n.update(some)
                seen.update(some)
            docs.update(seen)
            size += len(n) - before
            if size >= ENTRIES:
                yield from _flush(groups)
                groups, size = {}, 0
    yield from _flush(groups)


def postings(docs: DataFrame, least: int = 30) -> DataFrame:
    """docs (text, lang, source, ...) -> (lang, source, term, n): occurrences of terms that at least ``least`` rows of the language have.

    Null text, lang or source: the empty string. Other columns are ignored.
    """
    prepare(docs.sparkSession)
    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    counted = rows.mapInArrow(_count, COUNTS).repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    common = counted.withColumn("docs", F.sum("docs").over(Window.partitionBy("lang", "term"))).where(F.col("docs") >= least)
    return common.select("lang", "source", "term", "n")


def _price(n: Column, base: Column) -> Column:
    """In decimals of 38 digits: a count may be above 2**63 / SCALE. Without a term in the language: 0."""
    top = F.lit(SCALE).cast("decimal(10,0)") * (n + EXTRA).cast("decimal(20,0)")
    floor = F.call_function("div", top, F.nullif(base, F.lit(0)).cast("decimal(20,0)"))
    return F.coalesce(floor + 1, F.lit(0)).cast("long")


def group_totals(docs: DataFrame, posted: DataFrame) -> DataFrame:
    """(lang, source, base, own, v, zero, lang_base) of every group that occurs. base: N + EXTRA V; own: terms it has; v: kept terms of the language; zero: the price of no occurrence."""
    groups = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    totals = posted.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("own"))
    kept = posted.select("lang", "term").distinct().groupBy("lang").agg(F.count("*").alias("v"))
    out = groups.join(totals, ["lang", "source"], "left").join(kept, "lang", "left").na.fill(0, ["total", "own", "v"])
    out = out.withColumn("base", F.col("total") + EXTRA * F.col("v"))
    whole = F.sum("total").over(Window.partitionBy("lang")) + EXTRA * F.col("v")
    return out.select("lang", "source", "base", "own", "v", _price(F.lit(0), F.col("base")).alias("zero"), whole.alias("lang_base"))


def _one_sided(priced: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, other, sided, own, v, apart) of all ordered pairs of sources: sided is the sum of |p - the other's zero| over the terms of source.

    A group's histogram and the others' zeros stand in one order of price: running counts and sums give each zero its sum.
    """
    other = groups.select("lang", F.col("source").alias("other"), F.col("zero").alias("price"))
    own = groups.select("lang", "source", "own", "v", F.col("zero").alias("mine"))
    probes = own.join(other, "lang").where("source <> other")
    bars = priced.groupBy("lang", "source", F.col("p").alias("price")).agg(F.count("*").alias("h"))
    rows = bars.unionByName(probes.withColumn("h", F.lit(0).cast("long")), allowMissingColumns=True)
    below = Window.partitionBy("lang", "source").orderBy("price").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    every = Window.partitionBy("lang", "source")
    n, s = F.sum("h").over(below), F.sum(F.col("h") * F.col("price")).over(below)
    all_n, all_s = F.sum("h").over(every), F.sum(F.col("h") * F.col("price")).over(every)
    sided = F.col("price") * n - s + (all_s - s) - F.col("price") * (all_n - n)
    return rows.withColumn("sided", sided).where("other is not null").select("lang", "source", "other", "sided", "own", "v", F.abs(F.col("mine") - F.col("price")).alias("apart"))


def _overlaps(priced: DataFrame) -> DataFrame:
    """(lang, lo, hi, fix, both) of pairs of sources with terms in common: what these terms cost, less what the two sides counted for them; their number."""
    a = priced.select("lang", "term", F.col("source").alias("lo"), F.col("p").alias("p1"), F.col("zero").alias("z1"))
    b = priced.select("lang", "term", F.col("source").alias("hi"), F.col("p").alias("p2"), F.col("zero").alias("z2"))
    fix = F.abs(F.col("p1") - F.col("p2")) - F.abs(F.col("p1") - F.col("z2")) - F.abs(F.col("z1") - F.col("p2"))
    return a.join(b, ["lang", "term"]).where("lo < hi").groupBy("lang", "lo", "hi").agg(F.sum(fix).alias("fix"), F.count("*").alias("both"))


def divergences(docs: DataFrame, least: int = 30, top: int = 50) -> DataFrame:
    """docs (text, lang, source, ...) -> (lang, source, part, item, value, rank).

    Part 'pair': every other source of the language with the sum of |p - p'| over all kept terms, 0 if there is none. Part 'term': the ``top`` terms
    that the source has and prices above its language. Ranks go by value, largest first, then by item. Repeated rows count each for itself; an empty
    table gives no rows; a text of any length counts whole.
    """
    posted = stage(postings(docs, least), "postings")
    groups = stage(group_totals(docs, posted), "groups")
    common = posted.withColumn("lang_n", F.sum("n").over(Window.partitionBy("lang", "term"))).join(groups, ["lang", "source"])
    priced = stage(common.select("lang", "source", "term", "zero", _price(F.col("n"), F.col("base")).alias("p"), _price(F.col("lang_n"), F.col("lang_base")).alias("q")), "priced")
    low, high = F.least("source", "other").alias("lo"), F.greatest("source", "other").alias("hi")
    sides = _one_sided(priced, groups).select("lang", low, high, "sided", "own", "v", "apart")
    parts = sides.unionByName(_overlaps(priced), allowMissingColumns=True)
    neither = F.max("v") - F.sum("own") + F.coalesce(F.sum("both"), F.lit(0))
    value = F.sum("sided") + F.coalesce(F.sum("fix"), F.lit(0)) + neither * F.max("apart")
    sums = parts.groupBy("lang", "lo", "hi").agg(value.alias("value"))
    ends = F.explode(F.array(F.struct(F.col("lo").alias("source"), F.col("hi").alias("item")), F.struct(F.col("hi").alias("source"), F.col("lo").alias("item"))))
    pairs = sums.select("lang", "value", ends.alias("e")).select("lang", "e.source", F.lit("pair").alias("part"), "e.item", "value")
    words = priced.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = pairs.withColumn("rank", F.row_number().over(order)).unionByName(words.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top))
    return ranked.select("lang", "source", "part", "item", "value", "rank")
