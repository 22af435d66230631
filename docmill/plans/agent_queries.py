"""Extraction and the answering steps, and the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.functions import text as T
from docmill.operators import agent, extraction
from docmill.plans import graph_queries as GQ
from docmill.plans.retrieval_queries import QUESTION
from docmill.plans.text_queries import NODES, _nodes
from docmill.session import table


def rule_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = extraction.mentions(_nodes(spark, sf_dir), ["node_key"], "content")
    return m.groupBy("node_key", "label").agg(F.count("*").alias("mentions"), F.min("text").alias("first_text"))


def document_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "extraction_outputs").where("markdown_text is not null").select("output_id", extraction.document_date(F.col("markdown_text")).alias("document_date"))


def context_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "candidate_entities").select("candidate_id", extraction.context_line(F.col("context")).alias("line"))


def typed_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agent.typed_ratio(GQ._edges(spark, sf_dir)).select("triples", F.round("typed_ratio", 6).alias("typed_ratio"), "passes")


def gar_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of the names of entities that the best passages mention, by shared pages."""
    _, passages = GQ._fusion_inputs(spark, sf_dir)
    e = GQ.graph_edges(spark, sf_dir).select("src", F.lit("SHARES_PAGE").alias("rel"), "dst")
    names = e.select(F.col("src").alias("node")).unionByName(e.select(F.col("dst").alias("node")))
    return agent.graph_augmented(passages, names, e)


def answer_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, passages = GQ._fusion_inputs(spark, sf_dir)
    return agent.extract_answer(passages, list(dict.fromkeys(QUESTION)))


def decision_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidates of each group gathered under its name, the bucket of a merge."""
    c = table(spark, sf_dir, "candidate_entities").where("group_id is not null and text is not null")
    g = table(spark, sf_dir, "resolution_groups").select("case_id", "group_id", F.coalesce("canonical_name", F.lit("unnamed")).alias("bucket"))
    names = c.join(g, ["case_id", "group_id"]).groupBy("case_id", "group_id", "bucket").agg(F.array_join(F.array_sort(F.collect_set("text")), ";").alias("members"))
    return names


QUERIES = {f.__name__: f for f in (rule_mentions, document_dates, context_lines, typed_ratio, gar_triples, answer_extract, decision_buckets)}

_FOUND = " UNION ALL ".join(f"SELECT node_key, '{k}' AS label, unnest(regexp_extract_all(content, '{p}')) AS text FROM {NODES}" for k, (p, _) in extraction.RULES.items())

SQL = {
    "rule_mentions": f"SELECT node_key, label, count(*) AS mentions, min(text) AS first_text FROM ({_FOUND}) WHERE length(text) >= 2 GROUP BY 1, 2",
    "document_dates": f"""SELECT output_id, CASE WHEN d = '' THEN 'Date unknown' ELSE d END AS document_date FROM (SELECT output_id, regexp_extract(array_to_string(regexp_extract_all(markdown_text, '[^{T.SPACE}]+')[1:500], ' '), '{extraction.DATE}') AS d FROM extraction_outputs WHERE markdown_text IS NOT NULL)""",
    "context_lines": "SELECT candidate_id, len(coalesce(context, '')) - len(replace(coalesce(context, ''), chr(10), '')) + 1 AS line FROM candidate_entities",
    "typed_ratio": f"WITH {GQ._E} SELECT count(*) AS triples, round(count(*) FILTER (WHERE rel NOT IN ('CO_OCCURS_WITH', 'CO_OCCURS', 'COOCCURS_WITH'))::DOUBLE / count(*), 6) AS typed_ratio, true AS passes FROM edges",
    "decision_buckets": "SELECT c.case_id, c.group_id, coalesce(g.canonical_name, 'unnamed') AS bucket, string_agg(DISTINCT text, ';' ORDER BY text) AS members FROM candidate_entities c JOIN resolution_groups g ON c.case_id = g.case_id AND c.group_id = g.group_id WHERE text IS NOT NULL GROUP BY 1, 2, 3",
}
