"""Text, trees and chunks over the document tables, and the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.functions import text as T
from docmill.operators import trees
from docmill.operators.entities import latest
from docmill.session import table

S = T.SPACE


def _strip(c: str) -> str:
    return f"regexp_replace({c}, '^[{S}]+|[{S}]+$', '', 'g')"


def _words(c: str) -> str:
    return f"len(regexp_extract_all({c}, '[^{S}]+'))"


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest(table(spark, sf_dir, "tree_nodes"), "node_key", "loaded_at")


NODES = "(SELECT * FROM tree_nodes QUALIFY row_number() OVER (PARTITION BY node_key ORDER BY loaded_at DESC) = 1)"


def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = T.clean_text(F.col("content"))
    return _nodes(spark, sf_dir).select("node_key", F.coalesce(F.length(c), F.lit(0)).alias("n_chars"), F.md5(c).alias("text_hash"))


def heading_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "passages").select(F.explode(T.lines(F.col("text"))).alias("line"))
    return rows.select(T.heading_level(F.col("line")).alias("level")).groupBy("level").agg(F.count("*").alias("n_lines"))


def heading_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "passages").select("passage_id", F.md5(T.to_markdown(F.col("text"))).alias("markdown_hash"))


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.heading_tree(table(spark, sf_dir, "extraction_outputs"), "output_id", "markdown_text")


def heading_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _tree(spark, sf_dir)
    return t.select("output_id", "seq", "level", F.coalesce("parent_seq", F.lit(-1)).alias("parent_seq"), "page_num", "title", F.md5("content").alias("content_hash"))


def tree_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nodes(spark, sf_dir).groupBy("case_id", "doc_id").agg(F.count("*").alias("node_count"), (F.max(F.size("path")) - 1).alias("max_depth"), F.count_if(F.length(T.strip(F.col("content"))) > 10).alias("with_content"))


def tree_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = trees.pages(_nodes(spark, sf_dir), ["case_id", "doc_id"], "ordinal", "page_num", "title", "content")
    return p.select("case_id", "doc_id", "page_num", "word_count", F.md5("text").alias("text_hash"))


def chunk_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat_ws("\n\n", "title", "content")
    rows = _nodes(spark, sf_dir).select("node_key", F.explode(T.chunks(text)).alias("c"))
    return rows.select("node_key", F.col("c.chunk_no").alias("chunk_no"), F.size("c.words").alias("n_words"), F.md5(F.array_join("c.words", " ")).alias("chunk_hash"))


def section_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "passages").where("page_number is not null and not isnan(page_number) and source_pdf is not null")
    pages = p.groupBy("case_id", "source_pdf", F.col("page_number").cast("int").alias("page")).agg(F.min_by("text", "passage_id").alias("text"))
    return trees.sections(pages, ["case_id", "source_pdf"], "page", "text")


def page_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "extraction_outputs").where("markdown_text is not null").select("output_id", trees.page_count(F.col("markdown_text")).alias("pages"))


def scan_diagnostic(spark: SparkSession, sf_dir: str) -> DataFrame:
    short = F.count_if(F.size(T.words(F.col("text"))) < 10)
    return table(spark, sf_dir, "passages").groupBy("source_pdf").agg(F.count("*").alias("pages"), short.alias("short_pages"), (short * 2 > F.count("*")).alias("mostly_scanned"))


def tree_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries of the nodes from the deepest level up, by the offline provider."""
    s = trees.summarize(_nodes(spark, sf_dir))
    return s.select("case_id", "doc_id", "node_id", F.md5("summary").alias("summary_hash"))


QUERIES = {f.__name__: f for f in (clean_text, heading_lines, heading_markdown, heading_tree, tree_stats, tree_pages, chunk_windows, section_spans, page_counts, scan_diagnostic, tree_summaries)}


def _re(p: str) -> str:
    return p.replace("'", "''")


_LINE = _strip("line")
_LEVEL = f"""CASE WHEN regexp_matches(s, '{_re(T.TITLE)}') THEN 1 WHEN regexp_matches(s, '{_re(T.SECTION)}') THEN 2
    WHEN upper(s) = s AND lower(s) <> s AND {_words('s')} BETWEEN 2 AND 8 AND NOT regexp_matches(substring(s, 1, 3), '\\p{{N}}') THEN 2
    WHEN regexp_matches(s, '{_re(T.SUBSECTION)}') THEN 3 WHEN regexp_matches(s, '{_re(T.ITEM)}') THEN 4 ELSE 0 END"""
_LOWER = ", ".join(f"CASE WHEN level > {k} THEN coalesce(max(CASE WHEN level = {k} THEN seq END) OVER (PARTITION BY output_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) ELSE 0 END" for k in (1, 2, 3))

def _level(level: int) -> str:
    below = " UNION ALL ".join(f"SELECT * FROM s{k}" for k in range(level + 1, 5)) or "SELECT case_id, doc_id, node_id, parent_id, ordinal, content AS summary FROM n WHERE false"
    return f"""s{level} AS (SELECT n.case_id, n.doc_id, n.node_id, n.parent_id, n.ordinal, CASE WHEN length({_strip("coalesce(content, '')")}) > {trees.SILENT} OR b.t IS NOT NULL THEN substring(concat_ws(chr(10), substring(content, 1, {trees.SUMMARY_TEXT}), b.t), 1, 80) END AS summary
        FROM n LEFT JOIN (SELECT case_id, doc_id, parent_id, string_agg(summary, chr(10) ORDER BY ordinal, summary) AS t FROM ({below}) WHERE summary IS NOT NULL GROUP BY 1, 2, 3) b ON b.case_id = n.case_id AND b.doc_id = n.doc_id AND b.parent_id = n.node_id WHERE n.level = {level})"""


SQL = {
    "tree_summaries": f"WITH n AS {NODES}, {', '.join(_level(k) for k in range(4, -1, -1))} {' UNION ALL '.join(f'SELECT case_id, doc_id, node_id, md5(summary) AS summary_hash FROM s{k}' for k in range(5))}",
    "clean_text": f"""
        WITH a AS (SELECT node_key, regexp_replace(regexp_replace(regexp_replace(content, '\\r\\n', chr(10), 'g'), '-\\n([\\p{{L}}\\p{{N}}_])', '\\1', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g') AS c FROM {NODES}),
        b AS (SELECT node_key, {_strip("array_to_string(list_transform(string_split(c, chr(10)), lambda l: " + _strip('l') + "), chr(10))")} AS c FROM a)
        SELECT node_key, coalesce(length(c), 0) AS n_chars, md5(c) AS text_hash FROM b""",
    "heading_lines": f"""
        WITH l AS (SELECT unnest(string_split(text, chr(10))) AS line FROM passages), t AS (SELECT {_LINE} AS s FROM l)
        SELECT {_LEVEL} AS level, count(*) AS n_lines FROM t GROUP BY 1""",
    "heading_markdown": f"""
        WITH l AS (SELECT passage_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM passages),
        t AS (SELECT passage_id, n, {_LINE} AS s FROM l), m AS (SELECT passage_id, n, s, {_LEVEL} AS level FROM t)
        SELECT p.passage_id, CASE WHEN p.text IS NULL THEN NULL ELSE md5(g.md) END AS markdown_hash FROM passages p
        LEFT JOIN (SELECT passage_id, string_agg(CASE WHEN level > 0 THEN repeat('#', level) || ' ' || s ELSE s END, chr(10) ORDER BY n) AS md FROM m GROUP BY 1) g ON p.passage_id = g.passage_id""",
    "heading_tree": f"""
        WITH l AS (SELECT output_id, unnest(string_split(markdown_text, chr(10))) AS line, generate_subscripts(string_split(markdown_text, chr(10)), 1) AS line_no FROM extraction_outputs),
        m AS (SELECT *, TRY_CAST(nullif(regexp_extract({_LINE}, '{trees.MARKER}', 1), '') AS INT) AS marker FROM l),
        p AS (SELECT *, coalesce(last_value(marker IGNORE NULLS) OVER (PARTITION BY output_id ORDER BY line_no ROWS UNBOUNDED PRECEDING), 1) AS page FROM m),
        h AS (SELECT *, nullif(length(regexp_extract(line, '{trees.HEADING}', 1)), 0) AS level FROM p WHERE marker IS NULL),
        q AS (SELECT *, count(level) OVER (PARTITION BY output_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS seq FROM h),
        r AS (SELECT *, CASE WHEN level IS NOT NULL THEN greatest({_LOWER}) END AS parent FROM q),
        n AS (SELECT output_id, seq, coalesce(max(level), 0) AS level, max(parent) AS parent_seq, coalesce(max(CASE WHEN level IS NOT NULL THEN page END), 0) AS page_num,
                coalesce(max(CASE WHEN level IS NOT NULL THEN regexp_extract(line, '{trees.HEADING}', 2) END), 'Document') AS title, coalesce(string_agg(CASE WHEN level IS NULL THEN line END, chr(10) ORDER BY line_no), '') AS content
              FROM r GROUP BY output_id, seq)
        SELECT output_id, seq, level, coalesce(parent_seq, -1) AS parent_seq, page_num, {_strip('title')} AS title, md5({_strip('content')}) AS content_hash FROM n
        UNION ALL SELECT output_id, 0, 0, -1, 0, 'Document', md5('') FROM extraction_outputs e WHERE markdown_text IS NOT NULL AND NOT EXISTS (SELECT 1 FROM n WHERE n.output_id = e.output_id AND n.seq = 0)""",
    "tree_stats": f"SELECT case_id, doc_id, count(*) AS node_count, max(len(path)) - 1 AS max_depth, count(*) FILTER (WHERE length({_strip('content')}) > 10) AS with_content FROM {NODES} GROUP BY case_id, doc_id",
    "tree_pages": f"""
        WITH p AS (SELECT case_id, doc_id, page_num, string_agg(concat_ws(chr(10) || chr(10), title, content), chr(10) || chr(10) ORDER BY ordinal) AS text FROM {NODES} WHERE length({_strip('content')}) > 10 GROUP BY 1, 2, 3)
        SELECT case_id, doc_id, page_num, {_words('text')} AS word_count, md5(text) AS text_hash FROM p""",
    "chunk_windows": f"""
        WITH w AS (SELECT node_key, regexp_extract_all(concat_ws(chr(10) || chr(10), title, content), '[^{S}]+') AS w FROM {NODES}),
        c AS (SELECT node_key, w, unnest(range(0, greatest(1, CAST(ceil((len(w) - 30) / 270.0) AS INT)))) AS chunk_no FROM w)
        SELECT node_key, chunk_no, len(w[chunk_no * 270 + 1 : chunk_no * 270 + 300]) AS n_words, md5(array_to_string(w[chunk_no * 270 + 1 : chunk_no * 270 + 300], ' ')) AS chunk_hash FROM c""",
    "section_spans": f"""
        WITH p AS (SELECT case_id, source_pdf, CAST(page_number AS INT) AS page, arg_min(text, passage_id) AS text FROM passages WHERE page_number IS NOT NULL AND NOT isnan(CAST(page_number AS DOUBLE)) AND source_pdf IS NOT NULL GROUP BY 1, 2, 3),
        o AS (SELECT case_id, source_pdf, page, list_filter(list_transform(string_split(text, chr(10))[1:5], lambda l: {_strip('l')}), lambda x: length(x) > 3 AND regexp_matches(x, '{_re(T.PAGE_SECTION)}'))[1] AS title FROM p),
        z AS (SELECT case_id, source_pdf, max(page) AS last_page FROM o GROUP BY 1, 2),
        t AS (SELECT *, lead(page) OVER (PARTITION BY case_id, source_pdf ORDER BY page) AS nxt FROM o WHERE title IS NOT NULL)
        SELECT t.case_id, t.source_pdf, title, page AS start_page, coalesce(nxt - 1, last_page) AS end_page FROM t JOIN z ON t.case_id = z.case_id AND t.source_pdf = z.source_pdf""",
    "page_counts": f"SELECT output_id, CASE WHEN len(regexp_extract_all(markdown_text, '<!-- page')) > 0 THEN len(regexp_extract_all(markdown_text, '<!-- page')) ELSE greatest(1, {_words('markdown_text')} // 300) END AS pages FROM extraction_outputs WHERE markdown_text IS NOT NULL",
    "scan_diagnostic": f"SELECT source_pdf, count(*) AS pages, count(*) FILTER (WHERE {_words('text')} < 10) AS short_pages, count(*) FILTER (WHERE {_words('text')} < 10) * 2 > count(*) AS mostly_scanned FROM (SELECT source_pdf, coalesce(text, '') AS text FROM passages) GROUP BY source_pdf",
}
