"""Text columns: white space, tokens, hashed buckets, phrase scores, codes and citations. JVM-side but for token_bucket."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The hash's start, multiplier and size, each taken modulo the size.
HASH_START = 1469598103934665603
HASH_FACTOR = 1099511628211


def clean(text: Column) -> Column:
    """No-break and other white space to single spaces, trimmed; null to ''."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), "(?U)[\\s\\u00a0]+", " "))


def natural_key(number: Column) -> Column:
    """(number, suffix) of a catalogue number; one without digits: 0 and the whole of it."""
    digits = F.regexp_extract(number, "^([0-9]+)", 1)
    return F.struct(F.when(digits != "", digits.cast("int")).otherwise(0).alias("number"), F.when(digits != "", F.regexp_extract(number, "^[0-9]+([A-Za-z]*)", 1)).otherwise(F.coalesce(number, F.lit(""))).alias("suffix"))


def tokens(text: Column) -> Column:
    """Runs of a-z, and groups of three digits, of the lower-cased text."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z]+|[0-9]{3}"), F.lit(0))


def glued(words: Column) -> Column:
    """Tokens, and after each word that a number follows also both in one."""
    whole = F.concat_ws(" ", words)
    # word positions are found on the joined text, so that no look-up by index is needed
    return F.split(F.regexp_replace(whole, "([a-z]+) ([0-9]{3})(?= |$)", "$1 $1$2 $2"), " ")


def bucket(token: Column, size: int = 1024, seed: int = 0) -> Column:
    """FNV-like hash of an ASCII token into a power of two of buckets: each step is exact modulo the size."""
    if size & (size - 1):
        raise ValueError("size must be a power of two")
    start, factor = (HASH_START ^ seed) % size, HASH_FACTOR % size
    chars = F.transform(F.sequence(F.lit(1), F.length(token)), lambda i: F.ascii(F.substr(token, i, F.lit(1))))
    return F.aggregate(chars, F.lit(start), lambda h, c: (h.bitwiseXOR(c) * factor).bitwiseAND(size - 1))


def token_bucket(size: int = 1024, seed: int = 0):
    """The same for one token in Python."""
    start, factor, most = (HASH_START ^ seed) % size, HASH_FACTOR % size, size - 1

    def place(token: str) -> int:
        h = start
        for c in token.encode():
            h = (h ^ c) * factor & most
        return h

    return place


def phrase_hits(text: Column, phrases: Sequence[str]) -> Column:
    """How many of the phrases occur in the lower-cased text, each counted once."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return sum((F.contains(low, F.lit(p)).cast("int") for p in phrases), F.lit(0))


def says(text: Column, phrases: Sequence[str]) -> Column:
    """Whether any phrase occurs in the lower-cased text."""
    return phrase_hits(text, phrases) > 0


def polarity(text: Column, negative: Sequence[str], positive: Sequence[str]) -> Column:
    """false on a negative phrase, else true on a positive one, else null."""
    return F.when(says(text, negative), False).when(says(text, positive), True)


def course_codes(text: Column) -> Column:
    """Codes of two to five capitals and three digits, written 'SUBJ NNN', first occurrences in order."""
    pattern = F.lit("\\b([A-Z]{2,5})\\s?([0-9]{3})\\b")
    text = F.coalesce(text, F.lit(""))
    return F.array_distinct(F.zip_with(F.regexp_extract_all(text, pattern, F.lit(1)), F.regexp_extract_all(text, pattern, F.lit(2)), lambda a, b: F.concat_ws(" ", a, b)))


def clause_citations(text: Column) -> Column:
    """'kind:body' of each [kind:body], kind one of group, note, prereq, exclusion; without a body the kind alone. First occurrences in order."""
    pattern = F.lit("\\[(group|note|prereq|exclusion):?([^\\]]*)\\]")
    text = F.coalesce(text, F.lit(""))
    pairs = F.zip_with(F.regexp_extract_all(text, pattern, F.lit(1)), F.regexp_extract_all(text, pattern, F.lit(2)), lambda a, b: F.concat_ws(":", a, b))
    return F.array_distinct(F.transform(pairs, lambda p: F.regexp_replace(p, ":+$", "")))


def links(html: Column) -> Column:
    """Targets of anchors, lower-cased, in order."""
    return F.transform(F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit('(?i)<a\\s[^>]*href="([^"]*)"'), F.lit(1)), F.lower)


def title(html: Column) -> Column:
    return clean(F.regexp_extract(html, "(?is)<title[^>]*>(.*?)</title>", 1))
