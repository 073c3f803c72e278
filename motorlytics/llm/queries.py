"""Registered queries of the operators, at production parameters over whole
tables, and their DuckDB twins where SQL can express the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motorlytics.llm import (bpe_automaton, chat_format, decontaminate, line_runs, ngram_join, nn_descent, phrase_mining,
                             quality_fm, secret_scan, suffix_dedup, token_rollup, url_filter, whitening)
from motorlytics.llm.common import shuffle_partitions, stored
from motorlytics.sources.io import shared_path
from motorlytics.sources.tables import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents")


# 3 --------------------------------------------------------------------------
LINE_SQL = r"""
WITH l AS (SELECT doc_id, i, lines[i] AS line,
                  translate(trim(lines[i], chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)),
                            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
           FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i
                 FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents))),
     k AS (SELECT key, max(doc_id) AS keeper FROM l WHERE length(key) >= 40
           GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
     m AS (SELECT l.doc_id, l.i, l.line, coalesce(l.doc_id <> k.keeper, FALSE) AS lost FROM l LEFT JOIN k ON l.key = k.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (lost)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT lost), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""


@register("op3_line_dedup", LINE_SQL)
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_runs.dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return done.select("doc_id", "line_dedup.n_lines", "line_dedup.n_dropped",
                       F.sha2(F.col("line_dedup.kept").cast("binary"), 256).alias("kept_sha256"))


# 9 --------------------------------------------------------------------------
#: (verdict, host, path prefix), as the contract of the query states them.
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
#: Host labels of the sites whose URLs make up the list of the query.
LISTED_SITES = ["ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm"]
_SITE = r"://(?:[a-z]+\.)?(?:" + "|".join(LISTED_SITES) + r")\."

URL_SQL = r"""
WITH p AS (SELECT page_id, url,
                  translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 1),
                            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                  regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
     c AS (SELECT *, regexp_replace(host, '^www\.', '') || regexp_replace(path, '/+$', '') AS canon,
                  regexp_matches(coalesce(url, ''), '%s') AS spam FROM p),
     listed AS (SELECT DISTINCT canon FROM c WHERE spam AND host <> ''),
     r AS (SELECT page_id, host, path, canon,
                  CASE WHEN (host = 'example.net' OR host LIKE '%%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
                       WHEN (host = 'example.com' OR host LIKE '%%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
                       WHEN (host = 'org' OR host LIKE '%%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
                       WHEN (host = 'net' OR host LIKE '%%.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM c)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
            WHEN host <> '' AND canon IN (SELECT canon FROM listed) THEN 'block' ELSE 'allow' END AS verdict
FROM r
""" % _SITE


@register("op9_url_filters", URL_SQL)
def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages", ["page_id", "url"])
    listed = pages.where(F.col("url").rlike(_SITE)).select("url")
    return url_filter.filter_urls(pages, listed, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


# 10 -------------------------------------------------------------------------
TOKEN_SQL = r"""
WITH w AS (SELECT doc_id, source, lang, CASE WHEN doc_id IS NULL THEN count(*) ELSE 1 END AS copies,
                  len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n1,
                  len(regexp_extract_all(coalesce(text, ''), '\p{L}+|\p{N}+|[^\x20\x09-\x0D\p{L}\p{N}]')) AS n2 FROM documents
           GROUP BY doc_id, source, lang, n1, n2),
     g AS (SELECT doc_id, max(toxic) AS toxic, min(quality) AS quality FROM labels GROUP BY doc_id),
     d AS (SELECT source, lang, CASE WHEN g.quality = 0 THEN 'wordpunct-2' ELSE 'words-1' END AS tokenizer,
                  CASE WHEN g.quality = 0 THEN n2 ELSE n1 END AS n, copies FROM w LEFT JOIN g USING (doc_id)
           WHERE coalesce(g.toxic, 0) <> 1)
SELECT source, lang, tokenizer, sum(copies)::BIGINT AS n_docs, sum(n * copies)::BIGINT AS n_tokens FROM d GROUP BY ALL
"""


@register("op10_token_counts", TOKEN_SQL)
def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches: all documents counted by the first tokenizer version; documents of
    low quality revised to the second; toxic documents deleted. The second batch is
    sent twice, the third follows a compaction."""
    first, second = token_rollup.TOKEN_PATTERNS
    counts = documents(spark, sf_dir).select("doc_id", "source", "lang", token_rollup.token_count(first).alias("n1"),
                                             token_rollup.token_count(second).alias("n2"))
    counts = stored(counts, "token-counts")
    labels = read_table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    marked = stored(counts.join(labels, "doc_id"), "marked-counts")

    def changes(rows: DataFrame, change: str, version, n, old: bool = False) -> DataFrame:
        none = F.lit(None)
        return rows.select(F.lit(change).alias("change"), "doc_id", "source", "lang", F.lit(version).alias("tokenizer") if isinstance(version, str)
                           else version.alias("tokenizer"), n.cast("long").alias("n_tokens"),
                           (F.col("source") if old else none.cast("string")).alias("old_source"),
                           (F.col("lang") if old else none.cast("string")).alias("old_lang"),
                           (F.lit(first) if old else none.cast("string")).alias("old_tokenizer"),
                           (F.col("n1") if old else none).cast("long").alias("old_n_tokens"))

    low = F.col("quality") == 0
    rollup = token_rollup.TokenRollup(spark, shared_path(spark, "token-rollup"))
    rollup.commit("insert-1", changes(counts, "insert", first, F.col("n1")))
    revised = changes(marked.where(low), "revise", second, F.col("n2"), old=True)
    rollup.commit("revise-2", revised)
    rollup.commit("revise-2", revised)
    rollup.compact("compact-2")
    rollup.commit("delete-3", changes(marked.where(F.col("toxic") == 1), "delete",
                                      F.when(low, F.lit(second)).otherwise(F.lit(first)), F.when(low, F.col("n2")).otherwise(F.col("n1"))))
    return rollup.totals()


# 7 --------------------------------------------------------------------------
@register("op7_quality_classifier")
def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "n_chars")
    model = quality_fm.fit(docs, read_table(spark, sf_dir, "labels"))
    scored = quality_fm.scores(docs, model, ["doc_id"])
    return scored.select("doc_id", quality_fm.held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= quality_fm.THRESHOLD).cast("int").alias("predicted"))


# 8 --------------------------------------------------------------------------
@register("op8_bpe_encoding")
def op8_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    vocabulary = bpe_automaton.read_vocabulary(public_tokenizers.path("byte_bpe_50k.json"))
    coded = bpe_automaton.encode_documents(documents(spark, sf_dir).select("doc_id", "text"), vocabulary).drop("text")
    back = bpe_automaton.decode_documents(coded, vocabulary)
    return back.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                       F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


# 5 --------------------------------------------------------------------------
@register("op5_ngram_jaccard_join")
def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(documents(spark, sf_dir).select("doc_id", "text"))


# 2 --------------------------------------------------------------------------
@register("op2_benchmark_decontamination")
def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return decontaminate.find_leaks(docs, read_table(spark, sf_dir, "benchmark")).drop("k1", "k2")


# 6 --------------------------------------------------------------------------
@register("op6_suffix_array_dedup")
def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = suffix_dedup.remove_repeats(documents(spark, sf_dir).select("doc_id", "text"))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


# 4 --------------------------------------------------------------------------
@register("op4_approximate_nearest_neighbours")
def op4_approximate_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nn_descent.nearest(read_table(spark, sf_dir, "embeddings"), lambda i: i % 100 == 0)


# 1 --------------------------------------------------------------------------
#: Parameters of the tool that the query reads user turns as calls of.
TOOL_SCHEMA = [("ask", "n_chars", "integer", True, 40.0, None), ("ask", "text", "string", True, 40.0, 4000.0), ("ask", "topic", "string", False, None, None)]

CHAT_SQL = r"""
WITH RECURSIVE u AS (SELECT DISTINCT conv_id, turn, coalesce(text, '') AS text FROM conversations WHERE role = 'user'),
     a AS (SELECT DISTINCT conv_id, turn, coalesce(text, '') AS text FROM conversations WHERE role = 'assistant'),
     e AS (SELECT u.*, turn // 2 AS k, turn % 2 AS odd FROM u),
     d AS (SELECT e.*, CASE WHEN k > 0 THEN 2 * (k & (k - 1)) + odd END AS used FROM e),
     lv AS (SELECT d.conv_id, d.turn, 0 AS level FROM d LEFT JOIN u p ON p.conv_id = d.conv_id AND p.turn = d.used
            WHERE p.turn IS NULL
            UNION ALL
            SELECT d.conv_id, d.turn, lv.level + 1 FROM lv JOIN d ON d.conv_id = lv.conv_id AND d.used = lv.turn),
     c AS (SELECT d.conv_id, lv.level, d.turn, d.text, a.turn IS NOT NULL AS answered,
                  d.used IS NOT NULL AND p.turn IS NULL AS lost, a.text AS answer
           FROM d JOIN lv USING (conv_id, turn) LEFT JOIN a ON a.conv_id = d.conv_id AND a.turn = d.turn + 1
           LEFT JOIN u p ON p.conv_id = d.conv_id AND p.turn = d.used),
     m AS (SELECT *, concat_ws('; ', CASE WHEN length(text) < 40 THEN 'n_chars: too small' END,
                                     CASE WHEN length(text) < 40 THEN 'text: too small' WHEN length(text) > 4000 THEN 'text: too large' END,
                                     CASE WHEN lost THEN 'uses: unknown call' END) AS errors FROM c)
SELECT conv_id, level::INTEGER AS level, turn, 0 AS part, 'c' || turn AS call_id, CASE WHEN answered THEN 'linked' ELSE 'unanswered' END AS status, errors,
       '{"arguments":{"n_chars":' || length(text) || ',"text":' || to_json(text)::VARCHAR || '},"call_id":"c' || turn || '","name":"ask","role":"assistant","valid":'
       || CASE WHEN errors = '' THEN 'true' ELSE 'false' END || '}' AS json FROM m
UNION ALL
SELECT a.conv_id, c.level::INTEGER, CASE WHEN c.turn IS NULL THEN a.turn ELSE c.turn END, 1, 'c' || (a.turn - 1),
       CASE WHEN c.turn IS NULL THEN 'orphan' ELSE 'linked' END, '',
       '{"call_id":"c' || (a.turn - 1) || '","content":' || to_json(a.text)::VARCHAR || ',"role":"tool"}'
FROM a LEFT JOIN c ON c.conv_id = a.conv_id AND c.turn = a.turn - 1
UNION ALL
SELECT DISTINCT conv_id, 0, turn, 2, NULL, 'message', '',
       '{"content":' || to_json(coalesce(text, ''))::VARCHAR || CASE WHEN role IS NULL THEN '' ELSE ',"role":' || to_json(role)::VARCHAR END || '}'
FROM conversations WHERE role IS NULL OR role NOT IN ('user', 'assistant')
"""


@register("op1_chat_formatting", CHAT_SQL)
def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table has no tool columns, so each user turn is read as a call of the tool
    ``ask`` and the assistant turn after it as its result; turns of other roles are
    messages. A call uses an earlier one:
    that of the exchange whose number lacks the lowest set bit."""
    turns = read_table(spark, sf_dir, "conversations", ["conv_id", "turn", "role", "text"])
    text = F.coalesce("text", F.lit(""))
    k, odd = F.expr("turn div 2"), F.expr("turn % 2")
    used = F.when(k > 0, F.concat(F.lit("c"), (2 * k.bitwiseAND(k - 1) + odd).cast("string")))
    asked = F.to_json(F.struct(text.alias("text"), F.length(text).alias("n_chars")))
    calls = turns.where("role = 'user'").select("conv_id", "turn", F.concat(F.lit("c"), F.col("turn").cast("string")).alias("call_id"),
                                                F.lit("ask").alias("name"), asked.alias("arguments"), F.filter(F.array(used), lambda x: x.isNotNull()).alias("uses"))
    results = turns.where("role = 'assistant'").select("conv_id", "turn", F.concat(F.lit("c"), (F.col("turn") - 1).cast("string")).alias("call_id"), text.alias("content"))
    schemas = spark.createDataFrame(TOOL_SCHEMA, "name string, param string, type string, required boolean, min_size double, max_size double")
    others = turns.where("role is null or role not in ('user', 'assistant')").withColumnRenamed("text", "content")
    done = chat_format.format_chat(calls, results, schemas, others)
    return done.select("conv_id", "level", "turn", "part", "call_id", "status", F.concat_ws("; ", "errors").alias("errors"), "json")


# 11 -------------------------------------------------------------------------
@register("op11_embedding_whitening")
def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read_table(spark, sf_dir, "embeddings"), "embedding", ["vec_id"])


# 12 -------------------------------------------------------------------------
PHRASE_SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
     p AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
     w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
     s AS (SELECT lang, sum(len(w)) AS n FROM w GROUP BY lang),
     g AS (SELECT lang, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS phrase
           FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE len(w) >= k)),
     f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 100),
     c AS (SELECT * FROM f WHERE k >= 2),
     h AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM c b WHERE b.lang = c.lang AND b.k > c.k AND 100 * b.f >= 100 * c.f
                                             AND contains(' ' || b.phrase || ' ', ' ' || c.phrase || ' '))),
     u AS (SELECT h.*, cut, array_to_string(list_slice(string_split(phrase, ' '), 1, cut), ' ') AS head,
                  array_to_string(list_slice(string_split(phrase, ' '), cut + 1, k), ' ') AS tail
           FROM (SELECT *, unnest(range(1, k)) AS cut FROM h) h),
     x AS (SELECT u.lang, u.phrase, u.f AS a, cut, l.f AS l, r.f AS r, s.n AS n,
                  (1000::HUGEINT * u.f::HUGEINT * s.n::HUGEINT) // (l.f::HUGEINT * r.f::HUGEINT) AS score
           FROM u JOIN f l ON l.lang = u.lang AND l.phrase = u.head JOIN f r ON r.lang = u.lang AND r.phrase = u.tail JOIN s ON s.lang = u.lang),
     y AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
     z AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM y)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM z WHERE rank <= 2000
"""


@register("op12_phrase_collocations", PHRASE_SQL)
def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_mining.mine(documents(spark, sf_dir).select("text", "lang"))


# 13 -------------------------------------------------------------------------
@register("op13_secret_scans")
def op13_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(documents(spark, sf_dir).select("doc_id", "text")).drop("text")
    number = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *(number(k) for k in secret_scan.BASE_KINDS),
                        F.sha2(secret_scan.span_list("secrets", secret_scan.BASE_KINDS).cast("binary"), 256).alias("base_sha256"),
                        secret_scan.span_list("secrets").alias("spans"))
