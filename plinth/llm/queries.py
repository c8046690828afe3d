"""The registered queries of these operators, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, language_id, ngram_lm
from .decontamination import contaminated
from .divergence import divergences
from .jaccard_join import jaccard_join
from .packing import pack_documents
from .records import token_records
from .resampling import resample
from .square_packing import square_pack_documents
from .tokens import default_path
from .topk import top_k
from .urls import filter_urls
from .warc import archive_pages

#: (host, path prefix, verdict); a rule holds for subdomains too.
URL_RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ffd_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack_documents(_table(spark, sf_dir, "documents"), default_path(), end_id=0, size=1024)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).select("doc_id", "item_id", "score", "start_word", "end_word")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    remainder = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4, F.lit(0))
    model = language_id.train(docs.where(remainder != 2))
    return language_id.predict(docs, model).select("doc_id", (remainder == 2).alias("held_out"), "lang_pred", "score")


def op4_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = _table(spark, sf_dir, "labels").where("quality = 1")
    return resample(_table(spark, sf_dir, "documents"), good).select("doc_id", "log_weight", "gumbel_key", "selected")


def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where("vec_id % 50 = 0"), k=5)


def op6_warc_index_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    remainder = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10, F.lit(1))
    return ngram_lm.train_and_score(docs, remainder != 0, order=3, least=1).select("doc_id", (remainder == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = token_records(_table(spark, sf_dir, "documents"), default_path(), end_id=2)
    return records.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(_table(spark, sf_dir, "documents"), n=4, percent=85).select("doc_id", "n_shingles", "component_id")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(_table(spark, sf_dir, "pages"), URL_RULES)


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergences(_table(spark, sf_dir, "documents"), least=30, top=50)


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = alignment.aligned_documents(_table(spark, sf_dir, "documents"), *alignment.default_paths())
    return rows.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op13_square_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = square_pack_documents(_table(spark, sf_dir, "documents"), default_path(), end_id=2, size=1024)
    return pieces.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_ffd_packing, op2_decontamination, op3_language_id, op4_importance_resampling, op5_exact_topk, op6_warc_index_merge, op7_ngram_lm, op8_token_records, op9_ngram_jaccard_join, op10_url_filter, op11_source_divergence, op12_token_alignment, op13_square_packing)}
ORACLE_SQL: dict[str, str] = {
    "op5_exact_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
            FROM embeddings
            WHERE embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT q.vec_id AS query_id, p.vec_id AS vec_id,
                   CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * p.e[i])) AS BIGINT) AS score
            FROM v q JOIN v p ON q.vec_id % 50 = 0 AND p.vec_id <> q.vec_id AND len(p.e) = len(q.e)
        ), ranked AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
        )
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5""",
    "op6_warc_index_merge": """
        WITH p AS (
            SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages
        ), l AS (SELECT *, max(page_id) OVER (PARTITION BY hex) AS last FROM p)
        SELECT page_id, payload_bytes,
               array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(
                   (('0x' || substr(hex || '00', CAST(i * 5 // 4 + 1 AS INTEGER), 3))::BIGINT >> (7 - (i * 5) % 4)) & 31 AS INTEGER) + 1, 1)), '') AS payload_digest,
               CASE WHEN page_id = last OR last IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> last THEN last END AS refers_to
        FROM l""",
    "op9_ngram_jaccard_join": """
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
        ), s AS (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])
                                                WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w
        ), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
        l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
        e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
        reach(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT x, b FROM reach JOIN e ON y = a)
        SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x) LEFT JOIN n USING (doc_id)""",
    "op11_source_divergence": """
        WITH d AS (
            SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                   regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents
        ), t AS (SELECT row, lang, source, unnest(w) AS term FROM d),
        k AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT row) >= 30),
        c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY lang, source, term),
        g AS (SELECT DISTINCT lang, source FROM d),
        v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
        b AS (SELECT lang, source, coalesce(sum(n), 0) + 5 * coalesce(any_value(v), 0) AS base FROM g LEFT JOIN c USING (lang, source) LEFT JOIN v USING (lang) GROUP BY lang, source),
        p AS (SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(n, 0) + 5)) // base::HUGEINT AS p
              FROM g JOIN k USING (lang) JOIN b USING (lang, source) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
        q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (m + 5)) // (sum(m) OVER (PARTITION BY lang) + 5 * v)::HUGEINT AS q
              FROM (SELECT lang, term, sum(n)::HUGEINT AS m FROM c GROUP BY lang, term) JOIN v USING (lang)),
        pairs AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(sum(abs(f.p - h.p)), 0) AS value
                  FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN p f ON f.lang = x.lang AND f.source = x.source
                  LEFT JOIN p h ON h.lang = y.lang AND h.source = y.source AND h.term = f.term GROUP BY x.lang, x.source, y.source),
        words AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
        every AS (SELECT * FROM pairs UNION ALL SELECT * FROM words)
        SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
        FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM every) WHERE part = 'pair' OR rank <= 50""",
}
