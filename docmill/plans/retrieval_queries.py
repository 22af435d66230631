"""Passage retrieval, and the SQL it is checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.functions import text as T
from docmill.operators import fusion, retrieval
from docmill.session import table

QUESTION = ["tenant", "possession", "sale", "deed", "boundary", "wall", "possession"]
_TERMS = list(dict.fromkeys(QUESTION))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.score(table(spark, sf_dir, "passages"), "passage_id", "text", QUESTION)


def bm25_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("passage_id", F.round("score", 6).alias("score"))


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.top(_scored(spark, sf_dir).select("passage_id", F.round("score", 6).alias("score")), "passage_id", 20)


def bm25_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    n = d.agg(F.count("*").alias("n"))
    df = retrieval.postings(d, "doc_id", "text").groupBy("token").agg(F.count("*").alias("df"))
    return df.crossJoin(F.broadcast(n)).select("token", "df", F.round(F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5), 6).alias("idf"))


def bm25_postings_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "passages")
    post = retrieval.postings(p, "passage_id", "text").agg(F.count("*").alias("postings"), F.sum("tf").alias("tokens"), F.count_distinct("token").alias("vocabulary"))
    return post.crossJoin(retrieval.lengths(p, "passage_id", "text").agg(F.count("*").alias("passages"), F.round(F.avg("dl"), 6).alias("avgdl")))


def passage_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "passages")
    lines = retrieval.relevant_lines(F.col("text"), _TERMS)
    return p.where(F.size(retrieval.matched_terms(F.col("text"), _TERMS)) > 0).select("passage_id", F.array_join(retrieval.matched_terms(F.col("text"), _TERMS), ",").alias("matched"), F.array_join(lines, " / ").alias("lines"))


def passage_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = F.when(~F.isnan(F.col("page_number").cast("double")), F.col("page_number").cast("int"))
    return table(spark, sf_dir, "passages").select("passage_id", retrieval.citation(page, F.col("section_title"), F.col("source_pdf")).alias("citation"))


def passages_by_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "passages").where("page_number = 3")
    return p.groupBy("case_id", "source_pdf").agg(F.min("passage_id").alias("passage_id"))


def name_token_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "eval_items").select("item_id", F.array_join(F.array_sort(T.name_tokens(F.col("question"))), " ").alias("tokens"))


def classify_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = fusion.question_class(F.col("question"))
    return table(spark, sf_dir, "eval_items").select("item_id", kind.alias("query_type"), fusion.route(kind).alias("route"))


QUERIES = {f.__name__: f for f in (bm25_topk, bm25_scores, bm25_idf, bm25_postings_stats, passage_snippets, passage_citations, passages_by_page, name_token_sets, classify_route)}


def _tokens(c: str) -> str:
    return f"list_filter(regexp_extract_all(lower({c}), '{T.TOKEN}'), lambda t: length(t) > 1)"


_LIST = ", ".join(f"'{t}'" for t in _TERMS)
_HITS = " + ".join(f"CAST(contains(lower(x), '{t}') AS INT)" for t in _TERMS)
_TRIM = lambda c: f"regexp_replace({c}, '^[{T.SPACE}]+|[{T.SPACE}]+$', '', 'g')"
_STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)


def bm25(question: list[str]) -> str:
    asked = ", ".join(f"('{t}', {question.count(t)})" for t in dict.fromkeys(question))
    return f"""
    WITH t AS (SELECT passage_id, {_tokens("coalesce(text, '')")} AS ts FROM passages), p AS (SELECT passage_id, token, count(*) AS tf FROM (SELECT passage_id, unnest(ts) AS token FROM t) GROUP BY 1, 2),
    s AS (SELECT count(*) AS n, avg(len(ts)) AS avgdl FROM t), r AS (SELECT token, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS idf0 FROM p, s GROUP BY token, n), f AS (SELECT 0.25 * avg(idf0) AS floor FROM r),
    q(token, times) AS (VALUES {asked})
    SELECT p.passage_id, round(sum(times * CASE WHEN idf0 < 0 THEN floor ELSE idf0 END * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(ts) / avgdl))), 6) AS score
    FROM p JOIN q ON p.token = q.token JOIN r ON r.token = q.token JOIN t ON t.passage_id = p.passage_id, f, s GROUP BY p.passage_id"""


def lines(question: list[str]) -> str:
    """The lines of a passage that hold most tokens of a question, as a list."""
    hits = " + ".join(f"CAST(contains(lower(x), '{t}') AS INT)" for t in question)
    return f"list_transform(list_filter(list_reverse_sort(list_transform(list_filter(list_transform(string_split(text, chr(10)), lambda l: {_TRIM('l')}), lambda x: x <> ''), lambda x: {{'hits': {hits}, 'line': x}}))[1:5], lambda s: s.hits > 0), lambda s: s.line)"


BM25 = bm25(QUESTION)
_COMPLEX = " OR ".join(f"contains(l, '{w}')" for w in fusion.COMPLEX_WORDS)
_CLASS = f"""CASE WHEN regexp_matches(l, '\\b(relat|connect|link|between|stand to each other)') THEN 'RELATIONSHIP' WHEN regexp_matches(l, '^(why|how|explain|analy|compare)') THEN 'COMPLEX' WHEN {_COMPLEX} THEN 'COMPLEX' ELSE 'FACT' END"""

SQL = {
    "bm25_scores": BM25,
    "bm25_topk": f"SELECT * FROM ({BM25}) WHERE score > 0 ORDER BY score DESC, passage_id LIMIT 20",
    "bm25_idf": f"""WITH p AS (SELECT DISTINCT doc_id, unnest({_tokens('text')}) AS token FROM documents), n AS (SELECT count(*) AS n FROM documents)
        SELECT token, count(*) AS df, round(ln(n - count(*) + 0.5) - ln(count(*) + 0.5), 6) AS idf FROM p, n GROUP BY token, n""",
    "bm25_postings_stats": f"""WITH t AS (SELECT passage_id, {_tokens("coalesce(text, '')")} AS ts FROM passages), p AS (SELECT passage_id, token, count(*) AS tf FROM (SELECT passage_id, unnest(ts) AS token FROM t) GROUP BY 1, 2)
        SELECT (SELECT count(*) FROM p) AS postings, (SELECT sum(tf)::BIGINT FROM p) AS tokens, (SELECT count(DISTINCT token) FROM p) AS vocabulary, count(*) AS passages, round(avg(len(ts)), 6) AS avgdl FROM t""",
    "passage_snippets": f"""SELECT passage_id, array_to_string(list_filter([{_LIST}], lambda t: contains(lower(text), t)), ',') AS matched,
        coalesce(array_to_string(list_transform(list_filter(list_reverse_sort(list_transform(list_filter(list_transform(string_split(text, chr(10)), lambda l: {_TRIM('l')}), lambda x: x <> ''), lambda x: {{'hits': {_HITS}, 'line': x}}))[1:5], lambda s: s.hits > 0), lambda s: s.line), ' / '), '') AS lines
        FROM passages WHERE len(list_filter([{_LIST}], lambda t: contains(lower(text), t))) > 0""",
    "passage_citations": "SELECT passage_id, concat_ws(', ', CASE WHEN page_number IS NOT NULL AND NOT isnan(CAST(page_number AS DOUBLE)) THEN 'Page ' || CAST(CAST(page_number AS INT) AS VARCHAR) END, CASE WHEN section_title <> '' THEN 'Section: ' || section_title END, source_pdf) AS citation FROM passages",
    "passages_by_page": "SELECT case_id, source_pdf, min(passage_id) AS passage_id FROM passages WHERE page_number = 3 GROUP BY case_id, source_pdf",
    "name_token_sets": f"""SELECT item_id, coalesce(array_to_string(list_sort(list_distinct(list_transform(list_filter(regexp_extract_all(replace(lower(question), '_', ' '), '[^{T.SPACE}]+'), lambda t: length(t) > 2 AND t NOT IN ({_STOP})), lambda t: regexp_replace(t, '^[.,;:"''()-]+|[.,;:"''()-]+$', '', 'g')))), ' '), '') AS tokens FROM eval_items""",
    "classify_route": f"SELECT item_id, c AS query_type, CASE c WHEN 'RELATIONSHIP' THEN 'graph' WHEN 'FACT' THEN 'tree' ELSE 'both' END AS route FROM (SELECT item_id, {_CLASS} AS c FROM (SELECT item_id, lower(question) AS l FROM eval_items))",
}
