"""URL filters: rules on host and path, and logistic regression on hashed character n-grams where no rule fits.

The regression is trained on the driver from a small labelled URL table, by full gradient steps from zero, so it
is the same every time; its weights (2**BITS numbers) are broadcast.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import prepare, text_offsets
from .words import LOWER, ODD, U

BITS = 14
UPPER, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words that sites of unwanted kinds (gambling, medicines, sex, loans, prizes, copies of programs, advertising) are named by, and words of others. No word of
#: a site's name in the tables at hand is in either list, nor one that holds such a word.
BAD = (
    "poker roulette jackpot slots wager lottery bingo blackjack gamble viagra cialis pharmacy steroids slimming diet detox tramadol porn xxx cams escort sexy nude milf hentai webcam singles hookup dating payday loans "
    "cashback forex bitcoin profit earn rich millionaire giveaway prize discount replica rolex outlet warez crack keygen torrent serial cheats malware phishing popunder clicks traffic backlinks followers bulkmail viral clickbait"
).split()
GOOD = (
    "news library school garden museum history science health travel recipes weather forum research music theatre sport city council journal river mountain village bakery summer nation station internal "
    "reading mother kitchen bridge forest harbour market theory physics chemistry biology geology poetry novel painting sculpture architecture cycling running swimming football chess orchestra choir hospital clinic nursing "
    "teacher student university college academy institute archive gallery parish church railway airport energy water climate ocean wildlife birds gardeners carpenter pottery weaving software compiler database network "
    "robotics astronomy engineering statistics economics law parliament ministry embassy charity volunteer refuge shelter insurance accounting translation dictionary grammar language broadcast spelling crackers slotted"
).split()
FOLDS = 5
#: How hosts and paths of either kind are commonly made up, of two words and a number.
SHAPES = {
    1: (("{0}-{1}{n}", "{n}{0}{1}", "{0}{1}-{n}", "best-{0}-{1}", "{0}-{1}", "{0}{n}"), ("top", "xyz", "click", "info", "biz", "com"), ("/go/{n}", "/{0}-{1}-{n}.php", "/aff/{n}/{0}", "/promo/{1}", "", "/{0}{n}")),
    0: (("{0}{1}", "www.{0}", "{0}", "www.{0}{1}", "{1}.{0}", "m.{0}{1}", "{0}-{1}"), ("org", "com", "net", "de", "fr", "es", "co.uk"), ("/", "/about", "/en/{n}.html", "/{0}/{1}/", "/index.html", "/articles/{n}", "/de/{n}", "")),
}


def word_fold(word: str) -> int:
    return zlib.crc32(word.encode()) % FOLDS


def default_table() -> list[tuple[str, int]]:
    """(url, 1 for unwanted): four urls for each word of BAD and GOOD, with another word of its list and fold, in SHAPES by turns."""
    out = []
    for label, words in ((1, BAD), (0, GOOD)):
        hosts, tops, paths = SHAPES[label]
        for k, w in enumerate(words):
            own = [x for x in words if x != w and word_fold(x) == word_fold(w)]
            for j in range(4):
                fill = {"n": (7919 * k + 31 * j) % 997 + 3}
                pair = w, own[(k + 3 * j + 1) % len(own)]
                host, top, path = hosts[(k + j) % len(hosts)], tops[(k // 2 + j) % len(tops)], paths[(k // 3 + 2 * j) % len(paths)]
                out.append((f"https://{host.format(*pair, **fill)}.{top}{path.format(*pair, **fill)}", label))
    return out


def held_out(table: list[tuple[str, int]], fold: list[int], threshold: float = 0.5) -> dict[str, float]:
    """Area under the curve, recall and share of false alarms of urls judged by a model of the other folds; recall_at_5: where 5 % of others are false alarms."""
    of, y, p = np.array(fold), np.array([label for _, label in table]), np.zeros(len(table))
    for f in sorted(set(fold)):
        weights = train([x for x, g in zip(table, fold, strict=True) if g != f])
        some = np.flatnonzero(of == f)
        p[some] = scores(weights, *map(list, zip(*(split_url(table[i][0]) for i in some), strict=True)))
    above = (p[y == 1][:, None] > p[y == 0]).mean() + (p[y == 1][:, None] == p[y == 0]).mean() / 2
    return {"auc": float(above), "recall": float((p[y == 1] >= threshold).mean()), "false_alarms": float((p[y == 0] >= threshold).mean()), "recall_at_5": float((p[y == 1] > np.quantile(p[y == 0], 0.95)).mean())}


def word_folds() -> list[int]:
    """The fold of each url of default_table: no word of a fold is in another."""
    return [word_fold(w) for words in (BAD, GOOD) for w in words for _ in range(4)]


def split_url(url: str | None) -> tuple[str, str]:
    """host and path: null or no ``://``: both empty."""
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "")
    return (m[1].translate(str.maketrans(UPPER, SMALL)), m[2]) if m else ("", "")


def url_parts(url: Column) -> tuple[Column, Column]:
    """The same as columns."""
    after = F.when(F.contains(url, F.lit("://")), F.substr(url, F.instr(url, "://") + 3))
    raw = F.coalesce(F.regexp_extract(after, "^[^/?#]*", 0), F.lit(""))
    rest = F.substr(after, F.length(raw) + 1)
    return F.translate(raw, UPPER, SMALL), F.coalesce(F.regexp_extract(rest, "^[^?#]*", 0), F.lit(""))


def features(hosts: list[str], paths: list[str], low: int = 3, high: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, url) of all n-grams of low to high bytes; hosts and paths stand between marks of their own."""
    texts = [x for h, p in zip(hosts, paths, strict=True) for x in (f"\x01{h}\x02", f"\x03{p}\x04")]
    raw, offs = text_offsets(pa.array(texts, pa.string()))
    raw = LOWER[raw].astype(U)
    own = np.repeat(np.arange(len(texts)), np.diff(offs))
    at, url = [], []
    h = np.zeros(len(raw), U)
    for k in range(high):
        m = len(raw) - k
        if m <= 0:
            break
        h = (h[:m] + raw[k:] + U(1)) * ODD[3]
        h = h ^ (h >> U(29))
        if k + 1 >= low:
            same = own[:m] == own[k:]
            at.append(((h * ODD[4]) >> U(64 - BITS)).astype(np.int64)[same])
            url.append(own[:m][same] // 2)
    return (np.concatenate(at), np.concatenate(url)) if at else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def scores(weights: np.ndarray, hosts: list[str], paths: list[str]) -> np.ndarray:
    """P(bad) of each url; weights' last entry is the bias. A url's n-grams weigh 1 / sqrt(their number) each."""
    at, url = features(hosts, paths)
    n = np.maximum(np.bincount(url, minlength=len(hosts)), 1)
    return 1 / (1 + np.exp(-weights[-1] - np.bincount(url, weights[at], minlength=len(hosts)) / np.sqrt(n)))


def train(table: list[tuple[str, int]], steps: int = 600, rate: float = 2.0, decay: float = 2e-4) -> np.ndarray:
    """Weights of a logistic regression; an empty table, or one of one class, gives a constant."""
    w = np.zeros((1 << BITS) + 1)
    if not table:
        return w
    y = np.array([label for _, label in table], float)
    parts = [split_url(u) for u, _ in table]
    hosts, paths = [p[0] for p in parts], [p[1] for p in parts]
    at, url = features(hosts, paths)
    n = np.sqrt(np.maximum(np.bincount(url, minlength=len(y)), 1))
    for _ in range(steps):
        error = scores(w, hosts, paths) - y
        grad = np.bincount(at, (error / n)[url], minlength=len(w))
        grad[-1] = error.sum() / 8  # the bias meets every url: smaller steps
        w -= rate * (grad / len(y) * 8 + decay * w)
    return w


def _score(weights):
    def run(batches):
        for batch in batches:
            p = scores(weights.value, batch.column("host").to_pylist(), batch.column("path").to_pylist()) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p, pa.float64())], [*batch.schema.names, "p_block"])

    return run


def rule_column(host: Column, path: Column, rules: list[tuple[str, str, str]], what) -> Column:
    """what(rule) of the longest rule (host, path prefix, verdict) that fits, else null; of equally long ones the first."""
    out = F.lit(None).cast("string")
    for r in sorted(reversed(rules), key=lambda r: len(r[0]) + len(r[1])):
        fits = ((host == r[0]) | host.endswith("." + r[0])) & path.startswith(r[1])
        out = F.when(fits, F.lit(what(r))).otherwise(out)
    return out


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]], table: list[tuple[str, int]] | None = None, threshold: float = 0.5) -> DataFrame:
    """pages (page_id, url, ...) -> (page_id, host, path, rule, verdict, p_block), a row for each of pages.

    Null url or one without ``://``: empty host and path, judged by the regression alone. Null page_ids and repeated
    rows: each row has its result. Other columns are ignored.
    """
    spark = pages.sparkSession
    prepare(spark)
    host, path = url_parts(F.col("url"))
    weights = spark.sparkContext.broadcast(train(default_table() if table is None else table))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    rows = rows.mapInArrow(_score(weights), "page_id long, host string, path string, p_block double")
    rule = rule_column(F.col("host"), F.col("path"), rules, lambda r: r[0] + r[1])
    verdict = rule_column(F.col("host"), F.col("path"), rules, lambda r: r[2])
    method = F.when(F.col("p_block") >= threshold, "block").otherwise("allow")
    return rows.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"), "p_block")
