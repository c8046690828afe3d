"""Queries on texts, pages, conversations, vectors and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import seams
from ..functions import text as tx
from ..operators import eval_run, extract, grading, inverted, retrieval, routing, tree
from ..operators.programs import VOID
from ..sources.scratch import scratch
from .registry import Tables, query


@query("""
    SELECT count(*) AS n, count(DISTINCT source) AS sources, sum(n_chars)::BIGINT AS chars,
           count(*) FILTER (WHERE lang = 'en') AS english, count(*) FILTER (WHERE lang <> 'en') AS other FROM documents""")
def corpus_counts(t: Tables) -> DataFrame:
    return t.documents.agg(
        F.count("*").alias("n"), F.count_distinct("source").alias("sources"), F.sum("n_chars").alias("chars"), F.count_if(F.col("lang") == "en").alias("english"), F.count_if(F.col("lang") != "en").alias("other")
    )


FLAGS = """
    SELECT doc_id, 'size' AS scope FROM documents WHERE n_chars <> octet_length(encode(text))
    UNION ALL SELECT doc_id, 'short' FROM documents WHERE n_chars < 200
    UNION ALL SELECT doc_id, 'digits' FROM documents WHERE regexp_matches(text, '[0-9]{3}')"""


def flags(t: Tables) -> DataFrame:
    text = F.col("text")
    scopes = F.array_compact(F.array(F.when(F.col("n_chars") != F.octet_length(text), "size"), F.when(F.col("n_chars") < 200, "short"), F.when(text.rlike("[0-9]{3}"), "digits")))
    return t.documents.select("doc_id", F.explode(scopes).alias("scope"))


@query(f"SELECT doc_id FROM ({FLAGS}) WHERE scope = 'size'")
def count_mismatch_flags(t: Tables) -> DataFrame:
    return flags(t).where("scope = 'size'").select("doc_id")


@query(f"""
    SELECT scope, any_value(n) AS n, string_agg(doc_id, ',' ORDER BY doc_id) AS first_ids
    FROM (SELECT *, count(*) OVER (PARTITION BY scope) AS n, row_number() OVER (PARTITION BY scope ORDER BY doc_id) AS r FROM ({FLAGS})) WHERE r <= 5 GROUP BY scope""")
def failure_queue_by_scope(t: Tables) -> DataFrame:
    rows = flags(t)
    counts = rows.groupBy("scope").agg(F.count("*").alias("n"))
    first = retrieval.top_k(rows.withColumn("score", F.lit(0)), "scope", "doc_id", 5)
    ids = first.groupBy("scope").agg(F.array_join(F.array_sort(F.collect_list("doc_id")).cast("array<string>"), ",").alias("first_ids"))
    return counts.join(ids, "scope")


SPACES = "'[\\s\\x{00a0}\\x{0085}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+'"


@query(f"SELECT doc_id, md5(c) AS digest, length(c) AS n FROM (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), {SPACES}, ' ', 'g')) AS c FROM documents)")
def clean_ws(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", tx.clean(F.col("text")).alias("c"))
    return rows.select("doc_id", F.md5("c").alias("digest"), F.length("c").alias("n"))


TOKENS = "regexp_extract_all(lower(coalesce(text, '')), '[a-z]+|[0-9]{3}')"


@query(f"""
    SELECT doc_id, len(tok) AS n_tokens, md5(array_to_string(flatten(list_transform(range(1, len(tok) + 1), lambda i:
        CASE WHEN regexp_matches(tok[i], '^[a-z]') AND regexp_matches(coalesce(tok[i + 1], ''), '^[0-9]') THEN [tok[i], tok[i] || tok[i + 1]] ELSE [tok[i]] END)), ' ')) AS digest
    FROM (SELECT doc_id, {TOKENS} AS tok FROM documents)""")
def tokenize_glued(t: Tables) -> DataFrame:
    words = tx.tokens(F.col("text"))
    return t.documents.select("doc_id", F.size(words).alias("n_tokens"), F.md5(F.concat_ws(" ", tx.glued(words))).alias("digest"))


def tf_sql(table: str, key: str) -> str:
    return f"""(
        SELECT {key}, bucket, sum(n)::BIGINT AS tf FROM (
            SELECT {key}, token, count(*) AS n FROM (
                SELECT {key}, unnest(flatten(list_transform(range(1, len(tok) + 1), lambda i:
                    CASE WHEN regexp_matches(tok[i], '^[a-z]') AND regexp_matches(coalesce(tok[i + 1], ''), '^[0-9]') THEN [tok[i], tok[i] || tok[i + 1]] ELSE [tok[i]] END))) AS token
                FROM (SELECT {key}, {TOKENS} AS tok FROM {table})) GROUP BY ALL)
        JOIN hashed USING (token) GROUP BY {key}, bucket)"""


HASHED = f"""hashed AS (
    SELECT token, list_reduce(list_prepend(899, list_transform(range(1, length(token) + 1), lambda i: ascii(substr(token, i, 1)))), lambda h, b: (xor(h, b) * 435) & 1023)::INTEGER AS bucket
    FROM (SELECT DISTINCT unnest(flatten(list_transform(range(1, len(tok) + 1), lambda i: [tok[i], tok[i] || coalesce(tok[i + 1], '')]))) AS token
          FROM (SELECT {TOKENS} AS tok FROM documents UNION ALL SELECT {TOKENS} FROM benchmark)))"""


@query(f"WITH {HASHED} SELECT doc_id, count(*) AS n_buckets, sum(tf)::BIGINT AS n_tokens, sum(tf * bucket)::BIGINT AS weighed FROM {tf_sql('documents', 'doc_id')} GROUP BY doc_id")
def hash_tf(t: Tables) -> DataFrame:
    tf = retrieval.term_frequencies(t.documents, "doc_id", "text")
    return tf.groupBy("doc_id").agg(F.count("*").alias("n_buckets"), F.sum("tf").alias("n_tokens"), F.sum(F.col("tf") * F.col("bucket")).alias("weighed"))


IDF = f"""idf AS (
    SELECT b AS bucket, coalesce(df, 0) AS df, ln((1.0 + (SELECT greatest(1, count(*)) FROM documents)) / (1.0 + coalesce(df, 0))) + 1.0 AS idf
    FROM range(1024) r(b) LEFT JOIN (SELECT bucket, count(DISTINCT doc_id) AS df FROM {tf_sql('documents', 'doc_id')} GROUP BY bucket) ON bucket = b)"""


@query(f"WITH {HASHED}, {IDF} SELECT bucket::INTEGER AS bucket, df, round(idf, 6) AS idf FROM idf")
def hash_df_idf(t: Tables) -> DataFrame:
    docs = t.documents
    idf = retrieval.inverse_frequencies(retrieval.term_frequencies(docs, "doc_id", "text"), "doc_id", docs.count())
    return idf.select("bucket", "df", F.round("idf", 6).alias("idf"))


LIKEST = f"""
    WITH {HASHED}, {IDF},
    d AS (SELECT doc_id, bucket, tf * idf AS w FROM {tf_sql('documents', 'doc_id')} JOIN idf USING (bucket)),
    q AS (SELECT item_id, bucket, tf * idf AS w FROM {tf_sql('benchmark', 'item_id')} JOIN idf USING (bucket)),
    dn AS (SELECT doc_id, sqrt(sum(w * w)) AS n FROM d GROUP BY doc_id), qn AS (SELECT item_id, sqrt(sum(w * w)) AS n FROM q GROUP BY item_id),
    s AS (SELECT item_id, doc_id, round(sum((d.w / dn.n) * (q.w / qn.n)), 5) AS score FROM q JOIN d USING (bucket) JOIN dn USING (doc_id) JOIN qn USING (item_id) GROUP BY ALL)
    SELECT item_id, doc_id, score, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 3"""


@query(LIKEST)
def tfidf_topk_lexical(t: Tables) -> DataFrame:
    return retrieval.search(t.documents, t.benchmark, "doc_id", "item_id", k=3, digits=5).select("item_id", "doc_id", "score", "rank")


@query(LIKEST)
def tfidf_topk_kept_index(t: Tables) -> DataFrame:
    """As tfidf_topk_lexical, from an index that is built once and then searched without a look at the texts."""
    path = scratch(t.spark, "index")
    inverted.build(t.documents, "doc_id", "text", path)
    return inverted.search(t.spark, path, t.benchmark, "item_id", "doc_id", k=3, digits=5).select("item_id", "doc_id", "score", "rank")


@query("""
    SELECT query_id, vec_id, score, rank::INTEGER AS rank FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (
            SELECT q.vec_id AS query_id, v.vec_id, round(list_inner_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 5) AS score
            FROM embeddings q JOIN embeddings v ON q.vec_id % 100 = 0 AND v.vec_id <> q.vec_id)) WHERE rank <= 5""")
def topk_dense_ip(t: Tables) -> DataFrame:
    queries = t.embeddings.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return retrieval.dense_top_k(queries, t.embeddings.select("vec_id", F.col("embedding").alias("v")), 5).select("query_id", "vec_id", "score", "rank")


@query(f"""
    SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), {SPACES}, ' ', 'g')) AS title,
           regexp_extract(html, '(?i)<html[^>]*\\slang="([^"]*)"', 1) AS lang, len(regexp_extract_all(html, '(?i)<a\\s[^>]*href="([^"]*)"', 1)) AS n_links FROM pages""")
def html_attrs_title(t: Tables) -> DataFrame:
    html = F.col("html")
    return t.pages.select("page_id", tx.title(html).alias("title"), F.regexp_extract(html, '(?i)<html[^>]*\\slang="([^"]*)"', 1).alias("lang"), F.size(tx.links(html)).alias("n_links"))


@query("""SELECT DISTINCT page_id, lower(unnest(regexp_extract_all(html, '(?i)<a\\s[^>]*href="([^"]*)"', 1))) AS href FROM pages""")
def link_extract_explode(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.explode(tx.links(F.col("html"))).alias("href")).distinct()


@query()
def dom_outline(t: Tables) -> DataFrame:
    return extract.outline(t.pages)


VOIDS = ", ".join(f"'{v}'" for v in sorted(VOID))
TAG = """'<(/?)([a-zA-Z][a-zA-Z0-9]*)(?:[^>"'']|"[^"]*"|''[^'']*'')*>'"""


@query(f"""
    WITH RECURSIVE p AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?s)<!--.*?-->', '', 'g'), '(?is)(<script[^>]*>).*?</script>', '\\1</script>', 'g'), '(?is)(<style[^>]*>).*?</style>', '\\1</style>', 'g') AS h FROM pages),
    k AS (SELECT page_id, regexp_extract_all(h, {TAG}, 1) AS ends, list_transform(regexp_extract_all(h, {TAG}, 2), lambda x: lower(x)) AS tags FROM p),
    r(page_id, i, stack, pre, tag, path) AS (
        SELECT page_id, 0, []::VARCHAR[], -1, NULL::VARCHAR, NULL::VARCHAR FROM k
        UNION ALL
        SELECT r.page_id, i + 1,
               CASE WHEN ends[i + 1] = '/' AND list_contains(stack, tags[i + 1]) THEN stack[1:len(stack) - list_position(list_reverse(stack), tags[i + 1])]
                    WHEN ends[i + 1] = '/' OR tags[i + 1] IN ({VOIDS}) THEN stack ELSE list_append(stack, tags[i + 1]) END,
               pre + (ends[i + 1] = '')::INTEGER, CASE WHEN ends[i + 1] = '' THEN tags[i + 1] END, CASE WHEN ends[i + 1] = '' THEN array_to_string(stack, '>') END
        FROM r JOIN k ON k.page_id = r.page_id WHERE i < len(tags))
    SELECT page_id, pre, tag, path FROM r WHERE tag IS NOT NULL""")
def dom_paths(t: Tables) -> DataFrame:
    """Every element of every page with the tags above it, by intervals."""
    every = tree.nodes(t.pages)
    return every.select("row", "page_id", "pre", "tag").join(tree.paths(every, every), ["row", "pre"]).select("page_id", "pre", "tag", "path")


#: Frequent words of the invented languages, in the place of a lexicon.
OFFER_WORDS, RULE_WORDS, BUILD_WORDS = ["the", "tion", "ing ", "der", "les "], ["and", "with", "ent", "ung", "que "], ["thent", "enschung"]


def hits_sql(text: str, words: list[str]) -> str:
    return "(" + " + ".join(f"(contains(lower({text}), '{w.replace(chr(39), chr(39) * 2)}'))::INTEGER" for w in words) + ")"


def route_sql(text: str, source: str, keys: str, margin: str = "1", offer=OFFER_WORDS, rule=RULE_WORDS, build=BUILD_WORDS) -> str:
    return f"""
        SELECT {keys}, o AS offering_score, r AS rules_score,
               CASE WHEN c > 0 OR (o > 0 AND r > 0 AND abs(o - r) <= {margin}) THEN 'compound' WHEN o > r THEN 'rag' WHEN r > o THEN 'cag' WHEN o = 0 THEN 'rag' ELSE 'compound' END AS route
        FROM (SELECT *, {hits_sql(text, offer)} AS o, {hits_sql(text, rule)} AS r, {hits_sql(text, build)} AS c FROM {source})"""


@query(route_sql("coalesce(text, '')", "conversations", "conv_id, turn"))
def keyword_route(t: Tables) -> DataFrame:
    routed = routing.classify(t.conversations, "text", 1, OFFER_WORDS, RULE_WORDS, BUILD_WORDS)
    return routed.select("conv_id", "turn", "offering_score", "rules_score", "route")


# Questions and their paraphrases.
PARAPHRASES = [
    ("When is CMPUT 174 offered?", "Which terms does CMPUT 174 run in?"),
    ("When is CMPUT 174 offered?", "Is CMPUT 174 available next term?"),
    ("When is CMPUT 174 offered?", "What's the schedule for CMPUT 174?"),
    ("What is the prerequisite for CMPUT 204?", "What do I need before taking CMPUT 204?"),
    ("What is the prerequisite for CMPUT 204?", "Which courses are required to enrol in CMPUT 204?"),
    ("What is the prerequisite for CMPUT 204?", "CMPUT 204 prereqs?"),
    ("Is CMPUT 415 offered in winter and what is its prerequisite?", "Does CMPUT 415 run in the winter term, and what are its prerequisites?"),
    ("Is CMPUT 415 offered in winter and what is its prerequisite?", "Winter availability and prereqs for CMPUT 415?"),
]
QUESTIONS = list(dict.fromkeys(x for pair in PARAPHRASES for x in pair))
quoted = lambda x: "'" + x.replace("'", "''") + "'"
LEXICON = {"offer": routing.OFFERING_PHRASES, "rule": routing.RULES_PHRASES, "build": routing.CONSTRUCTION_PHRASES}


def after_sql(*lists: list, where: str = "true") -> str:
    """conversations as (id, a, b, ...): each text with a value of each list behind it, the one whose turn it is; a null value gives null."""
    pick = ["coalesce(text, '') || ' ' || [" + ", ".join("NULL" if x is None else quoted(x) for x in values) + f"][(conv_id + turn) % {len(values)} + 1] AS {name}" for name, values in zip("ab", lists, strict=False)]
    return f"(SELECT conv_id * 1000 + turn AS id, {', '.join(pick)} FROM conversations WHERE {where})"


def after(t: Tables, *lists: list) -> DataFrame:
    """As after_sql."""
    turn = F.pmod(F.col("conv_id") + F.col("turn"), F.lit(len(lists[0]))).cast("int") + 1
    pick = [F.concat(F.coalesce("text", F.lit("")), F.lit(" "), F.element_at(F.array(*map(F.lit, values)), turn)).alias(name) for name, values in zip("ab", lists, strict=False)]
    return t.conversations.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), *pick)


@query(route_sql("a", after_sql(QUESTIONS), "id", **LEXICON))
def keyword_route_literal(t: Tables) -> DataFrame:
    return routing.classify(after(t, QUESTIONS), "a").drop("a")


@query(f"""
    SELECT margin, round(avg((route = 'compound')::INTEGER), 3) AS compound_share
    FROM ({route_sql('a', f'(SELECT * FROM {after_sql(QUESTIONS)} q, (VALUES (0), (1), (2)) m(margin))', 'margin, id', 'margin', **LEXICON)}) GROUP BY margin""")
def route_margin_sweep(t: Tables) -> DataFrame:
    return routing.margin_sweep(after(t, QUESTIONS), "a")


BASES, OTHERS = ([p[k] for p in PARAPHRASES] for k in (0, 1))


@query(f"""
    SELECT id, b.route AS base_route, r.route AS route, b.route <> r.route AS flipped
    FROM ({route_sql('a', after_sql(BASES, OTHERS), 'id', **LEXICON)}) b JOIN ({route_sql('b', after_sql(BASES, OTHERS), 'id', **LEXICON)}) r USING (id)""")
def paraphrase_flips(t: Tables) -> DataFrame:
    return routing.paraphrase_flips(after(t, BASES, OTHERS), "a", "b").drop("a", "b")


NEGATIVE, POSITIVE = ["thh", "enst", "no. "], ["and", "ter"]


@query(f"""
    SELECT conv_id, turn, CASE WHEN {hits_sql('text', NEGATIVE)} > 0 THEN false WHEN {hits_sql('text', POSITIVE)} > 0 THEN true END AS says
    FROM conversations WHERE role = 'assistant'""")
def polarity_grade(t: Tables) -> DataFrame:
    return t.conversations.where("role = 'assistant'").select("conv_id", "turn", tx.polarity(F.col("text"), NEGATIVE, POSITIVE).alias("says"))


ANSWERS = [
    "CMPUT 174 runs in Fall Term 2026 at 9:00 and CMPUT174 again at 14:00.", "CMPUT 174 runs in Winter Term 2031.", "It starts at 23:15, says CMPUT 291 [group:core] [note:] [group:core].",
    "No course is named here, Fall Term 2040 at 7:00.", "MATH 125 and CMPUT 291: Winter Term 2027, 11:00 [prereq:CMPUT 204][exclusion].", None,
]
FACTS = [("CMPUT 174", ["Fall Term 2026", "Winter Term 2027"], ["09:00", "14:00"]), ("CMPUT 291", ["Winter Term 2027"], ["11:00"])]
ANSWER_VALUES = after_sql(ANSWERS)


def answers(t: Tables) -> DataFrame:
    return after(t, ANSWERS).withColumnRenamed("a", "answer")


CODES_SQL = """list_transform(range(1, len(regexp_extract_all(a, '\\b([A-Z]{2,5})\\s?([0-9]{3})\\b', 1)) + 1), lambda i:
    regexp_extract_all(a, '\\b([A-Z]{2,5})\\s?([0-9]{3})\\b', 1)[i] || ' ' || regexp_extract_all(a, '\\b([A-Z]{2,5})\\s?([0-9]{3})\\b', 2)[i])"""


@query(f"SELECT id, coalesce(array_to_string(list_sort(list_distinct({CODES_SQL})), '|'), '') AS codes FROM {ANSWER_VALUES}")
def course_codes_literal(t: Tables) -> DataFrame:
    return answers(t).select("id", F.array_join(F.array_sort(tx.course_codes(F.col("answer"))), "|").alias("codes"))


@query(f"""
    SELECT id, coalesce(array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(a, '\\[((?:group|note|prereq|exclusion):?[^\\]]*)\\]', 1),
        lambda x: regexp_replace(x, ':+$', '')))), '|'), '') AS citations FROM {ANSWER_VALUES}""")
def clause_citations_literal(t: Tables) -> DataFrame:
    return answers(t).select("id", F.array_join(F.array_sort(tx.clause_citations(F.col("answer"))), "|").alias("citations"))


@query(f"""
    WITH a AS (SELECT * FROM {ANSWER_VALUES} x), f AS (SELECT * FROM (VALUES {', '.join(f"({quoted(c)}, {terms}, {times})" for c, terms, times in FACTS)}) f(course, terms, times)),
    c AS (SELECT DISTINCT id, unnest({CODES_SQL}) AS course FROM a),
    b AS (SELECT id, count(*) AS n_courses, flatten(list(terms)) AS ok_terms, flatten(list(times)) AS ok_times FROM c JOIN f USING (course) GROUP BY id),
    x AS (SELECT a.id, coalesce(n_courses, 0) AS n_courses, ok_terms, ok_times,
                 list_distinct(regexp_extract_all(coalesce(a, ''), '\\b((?:Fall|Winter|Spring|Summer)\\s+Term\\s+[0-9]{{4}})\\b', 1)) AS t,
                 list_distinct(list_transform(regexp_extract_all(coalesce(a, ''), '\\b(?:[01]?[0-9]|2[0-3]):[0-5][0-9]\\b'), lambda s: lpad(s, 5, '0'))) AS m FROM a LEFT JOIN b USING (id)),
    y AS (SELECT id, n_courses, CASE WHEN n_courses > 0 THEN len(list_filter(t, lambda s: NOT list_contains(ok_terms, s))) ELSE 0 END AS bad_terms,
                 CASE WHEN n_courses > 0 THEN len(list_filter(m, lambda s: NOT list_contains(ok_times, s))) ELSE 0 END AS bad_times FROM x)
    SELECT *, bad_terms + bad_times = 0 AS ok FROM y""")
def citation_audit(t: Tables) -> DataFrame:
    facts = t.spark.createDataFrame(FACTS, "course string, terms array<string>, times array<string>")
    return grading.audit(answers(t).withColumn("answer", F.coalesce("answer", F.lit(""))), facts)


@query("""
    SELECT conv_id, turn, '[stub:' || left(sha1(text), 8) || '] ' || coalesce(trim(list_filter(string_split(text, chr(10)), lambda x: starts_with(ltrim(x), '['))[1]), '') AS answer,
           greatest(1, length(text)) // 4 AS prompt_tokens, round((greatest(1, length(text)) // 4) * 0.14 / 1000000, 10) AS cost_usd
    FROM conversations WHERE role = 'user'""")
def stub_model_usage_cost(t: Tables) -> DataFrame:
    text = F.col("text")
    n = grading.stub_tokens(text)
    return t.conversations.where("role = 'user'").select("conv_id", "turn", grading.stub_answer(text).alias("answer"), n.alias("prompt_tokens"), grading.cost(F.lit(0), n, F.lit(0)).alias("cost_usd"))


@query("""
    SELECT conv_id * 1000 + turn AS id, '[stub:' || left(sha1(text), 8) || '] ' || coalesce(trim(list_filter(string_split(text, chr(10)), lambda x: starts_with(ltrim(x), '['))[1]), '') AS answer,
           greatest(1, length(text)) // 4 AS prompt_tokens
    FROM conversations WHERE role = 'user'""")
def provider_answers(t: Tables) -> DataFrame:
    """Prompts answered through the table function that providers are plugged into."""
    seams.register(t.spark)
    asked = t.conversations.where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("prompt"))
    return t.spark.sql("SELECT id, answer, prompt_tokens FROM plinth_answer(TABLE({asked}))", asked=asked)


@query(f"""
    WITH {HASHED}, f AS (SELECT item_id, bucket, tf FROM {tf_sql('benchmark', 'item_id')}), n AS (SELECT item_id, sqrt(sum(tf * tf)) AS n FROM f GROUP BY item_id)
    SELECT item_id, coalesce(count(bucket), 0) AS n_buckets, coalesce(round(sum(tf / n * bucket), 5), 0.0) AS weighed FROM benchmark LEFT JOIN f USING (item_id) LEFT JOIN n USING (item_id) GROUP BY item_id""")
def embedder_vectors(t: Tables) -> DataFrame:
    """Vectors of the embedder that is plugged in, asked for from SQL."""
    seams.register(t.spark)
    vectors = t.spark.sql("SELECT item_id, plinth_embed(text) AS v FROM {items}", items=t.benchmark)
    return vectors.select("item_id", F.size(F.filter("v", lambda x: x > 0)).cast("long").alias("n_buckets"), F.round(F.aggregate(F.transform("v", lambda x, i: x * i), F.lit(0.0), lambda s, x: s + x), 5).alias("weighed"))


RESULTS = """(
    SELECT CASE user_id % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS config, CASE event_type WHEN 'click' THEN 'factual_offered' WHEN 'view' THEN 'factual_prereq' ELSE 'plan_validity' END AS type,
           (event_id % 5) / 4.0 AS quality, event_id % 7 > 0 AS citation_ok, event_id % 97 / 1000000.0 AS cost_usd, event_id % 11 AS hit_tokens, 11 + event_id % 13 AS prompt_tokens, value AS latency_s FROM events)"""


def results(t: Tables) -> DataFrame:
    e, u, kind = F.col("event_id"), F.col("user_id"), F.col("event_type")
    return t.events.select(
        F.when(u % 3 == 0, "a").when(u % 3 == 1, "b").otherwise("c").alias("config"),
        F.when(kind == "click", "factual_offered").when(kind == "view", "factual_prereq").otherwise("plan_validity").alias("type"),
        ((e % 5) / 4.0).alias("quality"), (e % 7 > 0).alias("citation_ok"), (e % 97 / 1000000.0).alias("cost_usd"), (e % 11).alias("hit_tokens"), (e % 13 + 11).alias("prompt_tokens"), F.col("value").alias("latency_s"),
    )


@query(f"""
    SELECT config, type, count(*) AS n, round(avg(quality), 4) AS quality, round(sum(cost_usd), 6) AS cost_total, round(avg(cost_usd), 8) AS cost_mean,
           coalesce(round(sum(hit_tokens)::DOUBLE / nullif(sum(prompt_tokens), 0), 4), 0.0) AS cache_rate,
           round(avg(CASE WHEN type = 'factual_offered' THEN citation_ok::INTEGER END), 4) AS citation_rate
    FROM {RESULTS} GROUP BY GROUPING SETS ((config), (config, type))""")
def evaluation_summary(t: Tables) -> DataFrame:
    return grading.summary(results(t))


@query(
    f"""
    SELECT config, round(CASE WHEN n = 1 THEN d[1] ELSE (d[j50] * (100 - s50) + d[j50 + 1] * s50) / 100 END, 4) AS p50,
           round(CASE WHEN n = 1 THEN d[1] ELSE (d[j95] * (100 - s95) + d[j95 + 1] * s95) / 100 END, 4) AS p95
    FROM (SELECT *, 50 * (n + 1) - j50 * 100 AS s50, 95 * (n + 1) - j95 * 100 AS s95 FROM (
        SELECT config, count(*) AS n, list_sort(list(latency_s)) AS d, least(greatest(50 * (count(*) + 1) // 100, 1), greatest(count(*) - 1, 1)) AS j50,
               least(greatest(95 * (count(*) + 1) // 100, 1), greatest(count(*) - 1, 1)) AS j95
        FROM {RESULTS} WHERE latency_s IS NOT NULL GROUP BY config))"""
)
def evaluation_latency(t: Tables) -> DataFrame:
    return grading.latency(results(t))


CLAUSES = [
    "An introduction. Prerequisite: CMPUT 174. Corequisite: MATH 125. Credit cannot be obtained for both CMPUT 174 and 274.",
    "Prerequisite or corequisite: STAT 151 or 235. See Note.", "Prerequisites CMPUT 204; Antirequisite: CMPUT 304. Notes: closed.", "Nothing at all.", None,
]
LEADS = [(kind, p.replace("'", "''")) for kind, p in extract.LEAD_INS]


@query(f"""
    WITH m AS (SELECT id, string_split(regexp_replace(trim(regexp_replace(a, {SPACES}, ' ', 'g')), '(?i){'|'.join(f'({p})' for _, p in LEADS)}', chr(1) || '\\0' || chr(2), 'g'), chr(1)) AS x FROM {after_sql(CLAUSES)}),
    p AS (SELECT id, pos, split_part(x[pos], chr(2), 1) AS lead, trim(split_part(x[pos], chr(2), 2)) AS body FROM (SELECT id, x, unnest(range(2, len(x) + 1)) AS pos FROM m)),
    k AS (SELECT *, CASE {' '.join(f"WHEN regexp_full_match(lead, '(?i){p}') THEN '{kind}'" for kind, p in LEADS)} END AS kind FROM p),
    v AS (SELECT id, pos, kind, CASE WHEN kind = 'credit' THEN trim(lead || ' ' || body) ELSE body END AS value FROM k),
    f AS (SELECT id, arg_min(value, pos) FILTER (WHERE kind IN ('prereq', 'combined')) AS prereq_raw, arg_min(value, pos) FILTER (WHERE kind IN ('coreq', 'combined')) AS coreq_raw,
                 arg_min(value, pos) FILTER (WHERE kind = 'credit') AS credit_exclusion_raw, bool_or(kind = 'combined') AS combined FROM v WHERE value <> '' GROUP BY id)
    SELECT id, prereq_raw, coreq_raw, credit_exclusion_raw, coalesce(combined, false) AS combined FROM m LEFT JOIN f USING (id)""")
def clause_split(t: Tables) -> DataFrame:
    return extract.clauses(after(t, CLAUSES), "id", "a")


WAITS = f"""
    SELECT config, round(CASE WHEN n = 1 THEN d[1] ELSE (d[j50] * (100 - s50) + d[j50 + 1] * s50) / 100 END, 4) AS p50,
           round(CASE WHEN n = 1 THEN d[1] ELSE (d[j95] * (100 - s95) + d[j95 + 1] * s95) / 100 END, 4) AS p95
    FROM (SELECT *, 50 * (n + 1) - j50 * 100 AS s50, 95 * (n + 1) - j95 * 100 AS s95 FROM (
        SELECT config, count(*) AS n, list_sort(list(latency_s)) AS d, least(greatest(50 * (count(*) + 1) // 100, 1), greatest(count(*) - 1, 1)) AS j50,
               least(greatest(95 * (count(*) + 1) // 100, 1), greatest(count(*) - 1, 1)) AS j95
        FROM {RESULTS} WHERE latency_s IS NOT NULL GROUP BY config))"""


@query(f"""
    SELECT config, quality_overall, factual_offered, factual_prereq, plan_validity, plan_construction, citation_pass_rate, cost_usd_total, p50 AS latency_p50, p95 AS latency_p95, cache_hit_rate, n FROM (
        SELECT config, round(avg(quality), 4) AS quality_overall, round(avg(quality) FILTER (WHERE type = 'factual_offered'), 4) AS factual_offered, round(avg(quality) FILTER (WHERE type = 'factual_prereq'), 4) AS factual_prereq,
               round(avg(quality) FILTER (WHERE type = 'plan_validity'), 4) AS plan_validity, round(avg(quality) FILTER (WHERE type = 'plan_construction'), 4) AS plan_construction,
               round(avg(citation_ok::INTEGER) FILTER (WHERE type = 'factual_offered'), 4) AS citation_pass_rate, round(sum(cost_usd), 6) AS cost_usd_total,
               coalesce(round(sum(hit_tokens)::DOUBLE / nullif(sum(prompt_tokens), 0), 4), 0.0) AS cache_hit_rate, count(*) AS n FROM {RESULTS} GROUP BY config)
    LEFT JOIN ({WAITS}) USING (config)""")
def evaluation_results(t: Tables) -> DataFrame:
    """The table that results.csv holds."""
    return eval_run.results(results(t)).drop("cost_usd_mean")
