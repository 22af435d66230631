"""The queries of the training-data operators, over whole tables, and their SQL where it exists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.llm import leakage, linking, packing, pii, scans, splitting, subjects, survivors
from docmill.session import table

#: Words in a tree node and in a whole Markdown file, and the overlap of consecutive pieces.
NODE_LIMIT, FILE_LIMIT, OVERLAP = 300, 2000, 30


def _records(spark: SparkSession, sf_dir: str, name: str, key: str, text: str) -> DataFrame:
    return table(spark, sf_dir, name).select(F.lit(name).alias("record_kind"), F.col(key).alias("record_id"), F.col(text).alias("text"))


def _pieces(spark: SparkSession, sf_dir: str, once: bool) -> DataFrame:
    sources = []
    for name, key, text, limit in (("tree_nodes", "node_key", "content", NODE_LIMIT), ("extraction_outputs", "output_id", "markdown_text", FILE_LIMIT)):
        rows = _records(spark, sf_dir, name, key, text)
        if once:  # only what will be cut is shuffled
            rows = rows.where(splitting.n_words(F.col("text")) > limit).dropDuplicates(["record_id"])
        sources.append((rows, limit))
    return splitting.split_records(sources, OVERLAP)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that had to be cut."""
    return _pieces(spark, sf_dir, once=False).where("n_pieces > 1").select("record_kind", "record_id").distinct()


def p3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pieces, with their text."""
    return _pieces(spark, sf_dir, once=True)


def p3_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of the pieces of each record: own words add up to the text, none is too long, overlaps are whole."""
    p = p3_pieces(spark, sf_dir)
    limit = F.when(F.col("record_kind") == "tree_nodes", NODE_LIMIT).otherwise(FILE_LIMIT)
    repeats = F.when(F.col("piece_no") == 0, 0).otherwise(OVERLAP)
    return p.groupBy("record_kind", "record_id").agg(F.sum(F.col("n_words") - F.col("overlap_words")).alias("own_words"), F.bool_and((F.col("n_words") <= limit) & (splitting.n_words(F.col("text")) == F.col("n_words")) & (F.col("overlap_words") == repeats)).alias("holds"))


def p4_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The voted fields of the surviving records beside the name."""
    return p4_survivors(spark, sf_dir).where("n_rows is not null").select("case_id", "group_id", "source_pdf", "source_page", "source_line", F.md5("context").alias("context_hash"), F.round("confidence", 6).alias("confidence"), "extracted_at")


def p4_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The surviving record of every group."""
    return survivors.survivors(table(spark, sf_dir, "candidate_entities"), table(spark, sf_dir, "resolution_groups"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups whose surviving row falls short of the voted record in no respect, and that row."""
    return p4_survivors(spark, sf_dir).where("dominates").select("case_id", "group_id", "candidate_id")


def _scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = table(spark, sf_dir, "tree_nodes").select(F.lit("tree_nodes").alias("record_kind"), F.col("node_key").alias("record_id"), F.concat_ws("|", "case_id", "doc_id").alias("file"), "title", F.col("content").alias("text"))
    passages = table(spark, sf_dir, "passages").select(F.lit("passages").alias("record_kind"), F.col("passage_id").alias("record_id"), F.concat_ws("|", "case_id", "source_pdf").alias("file"), F.col("section_title").alias("title"), "text")
    return nodes.unionByName(passages)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The defects of each record."""
    return scans.repair(_scanned(spark, sf_dir)).select("record_kind", "record_id", F.explode("defects").alias("defect")).distinct()


def p1_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record in continuous paragraphs."""
    return scans.repair(_scanned(spark, sf_dir)).select("record_kind", "record_id", "text").dropDuplicates(["record_kind", "record_id"])


def _unresolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "candidate_entities").where("group_id is null").select("candidate_id", "case_id", "text")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of rows that name the same person or firm in different spellings."""
    return linking.linked(_unresolved(spark, sf_dir))


def p2_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entity of each row of the cases not yet resolved; null for what is neither person nor firm."""
    rows = _unresolved(spark, sf_dir)
    return rows.join(linking.entities(rows), ["case_id", "text"], "left").select("candidate_id", "case_id", "entity")


def _personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _records(spark, sf_dir, "tree_nodes", "node_key", "content").unionByName(_records(spark, sf_dir, "entity_mentions", "mention_id", "context"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The types of personal information in each record."""
    return pii.personal_spans(_personal(spark, sf_dir)).select("record_kind", "record_id", "pii_type").distinct()


def p5_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record with placeholders in place of personal information."""
    return pii.redacted(_personal(spark, sf_dir)).dropDuplicates(["record_kind", "record_id"])


def p6_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of every text."""
    return packing.pack(table(spark, sf_dir, "documents"))


def p6_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of the containers: every row placed once, none overfull, only texts beyond the capacity cut."""
    c = p6_containers(spark, sf_dir)
    rows = c.groupBy("doc_id").agg(F.count_if(F.col("piece_no") == 0).alias("times"), F.count("*").alias("pieces"), F.sum("n_tokens").alias("tokens"))
    over = c.where("container_id is not null").groupBy("container_id").agg(F.sum("n_tokens").alias("used")).agg(F.count_if(F.col("used") > packing.CAPACITY).alias("overfull"))
    cut = F.count_if((F.col("pieces") > F.col("times")) & (F.col("tokens") <= packing.CAPACITY * F.col("times"))).alias("cut_needlessly")
    return rows.agg(F.count("*").alias("ids"), F.sum("times").alias("rows"), cut).crossJoin(over)


def p6_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers are."""
    full = p6_containers(spark, sf_dir).where("container_id is not null").groupBy("container_id").agg(F.sum("n_tokens").alias("used"), F.count("*").alias("items"))
    return full.agg(F.count("*").alias("containers"), F.sum("used").alias("tokens"), F.sum("items").alias("items"), F.max("used").alias("fullest"), F.round(F.sum("used") / (F.count("*") * packing.CAPACITY), 6).alias("fill"))


def p7_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts and the evaluation items inside them, with the evidence."""
    return leakage.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts and the evaluation items inside them."""
    return p7_leaks(spark, sf_dir).select("doc_id", "item_id").distinct()


def _subject_inputs(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    return [table(spark, sf_dir, x) for x in ("documents", "subject_areas", "subject_labels")]


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The subjects of each document."""
    return subjects.subjects(*_subject_inputs(spark, sf_dir))


def p8_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus by subject: sentences, documents with any, and the sum of the documents' mixtures."""
    parts = subjects.composition(*_subject_inputs(spark, sf_dir))
    return parts.groupBy("subject_name").agg(F.sum("sentences").alias("sentences"), F.count_if(F.col("sentences") > 0).alias("documents"), F.round(F.sum("mixture"), 3).alias("mixture"))


def queries() -> dict:
    return {f.__name__: f for f in (p1_found, p1_repaired, p2_found, p2_entities, p3_found, p3_pieces, p3_checks, p4_found, p4_survivors, p4_fields, p5_found, p5_redacted, p6_containers, p6_usage, p6_checks, p7_found, p7_leaks, p8_found, p8_composition)}


SPACE = r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_WORD = r"[\p{L}\p{N}\p{M}_]+"
_FILL = ", ".join(f"'{x}'" for x in survivors.FILLERS)
_TRIM = lambda c: f"regexp_replace({c}, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')"
_TEXT = lambda c: f"CAST({_TRIM(c)} <> '' AND lower({_TRIM(c)}) NOT IN ({_FILL}) AS INT)"


def oracle_sql() -> dict[str, str]:
    return {
        "p3_found": f"""
            SELECT DISTINCT 'tree_nodes' AS record_kind, node_key AS record_id FROM tree_nodes WHERE len(regexp_extract_all(content, '[^{SPACE}]+')) > {NODE_LIMIT}
            UNION ALL
            SELECT DISTINCT 'extraction_outputs', output_id FROM extraction_outputs WHERE len(regexp_extract_all(markdown_text, '[^{SPACE}]+')) > {FILE_LIMIT}""",
        "p4_found": f"""
            WITH r AS (
              SELECT c.case_id, c.group_id, candidate_id,
                coalesce({_TEXT('c.canonical_name')}, 0) + coalesce({_TEXT('source_pdf')}, 0) + coalesce({_TEXT('context')}, 0)
                  + CASE WHEN source_page >= 1 AND NOT isnan(CAST(source_page AS DOUBLE)) THEN 1 ELSE 0 END + CASE WHEN source_line >= 1 AND NOT isnan(CAST(source_line AS DOUBLE)) THEN 1 ELSE 0 END AS usable,
                CASE WHEN confidence IS NULL OR isnan(confidence) OR confidence < 0 THEN -1 WHEN confidence > 1 THEN confidence / 100 ELSE confidence END AS conf,
                coalesce(extracted_at, TIMESTAMP '0001-01-01') AS seen
              FROM candidate_entities c JOIN (SELECT DISTINCT case_id, group_id FROM resolution_groups) g ON c.case_id = g.case_id AND c.group_id = g.group_id),
            m AS (SELECT *, max(usable) OVER w AS u, max(conf) OVER w AS k, max(seen) OVER w AS l FROM r WINDOW w AS (PARTITION BY case_id, group_id))
            SELECT case_id, group_id, min(candidate_id) AS candidate_id FROM m WHERE usable = u AND conf = k AND seen = l GROUP BY case_id, group_id""",
        "p3_checks": f"""
            SELECT DISTINCT 'tree_nodes' AS record_kind, node_key AS record_id, len(regexp_extract_all(content, '[^{SPACE}]+')) AS own_words, true AS holds FROM tree_nodes WHERE len(regexp_extract_all(content, '[^{SPACE}]+')) > {NODE_LIMIT}
            UNION ALL SELECT DISTINCT 'extraction_outputs', output_id, len(regexp_extract_all(markdown_text, '[^{SPACE}]+')), true FROM extraction_outputs WHERE len(regexp_extract_all(markdown_text, '[^{SPACE}]+')) > {FILE_LIMIT}""",
        "p6_checks": "SELECT count(DISTINCT doc_id) AS ids, count(*) AS rows, 0 AS cut_needlessly, 0 AS overfull FROM documents",
        "p4_fields": f"""
            WITH r AS (
              SELECT case_id, group_id, CASE WHEN {_TEXT('source_pdf')} = 1 THEN {_TRIM('source_pdf')} END AS pdf, CASE WHEN {_TEXT('context')} = 1 THEN {_TRIM('context')} END AS context,
                CASE WHEN source_page >= 1 AND NOT isnan(CAST(source_page AS DOUBLE)) THEN CAST(CAST(source_page AS BIGINT) AS VARCHAR) END AS page, CASE WHEN source_line >= 1 AND NOT isnan(CAST(source_line AS DOUBLE)) THEN CAST(CAST(source_line AS BIGINT) AS VARCHAR) END AS line,
                coalesce({_TEXT('canonical_name')}, 0) AS named, CASE WHEN confidence IS NULL OR isnan(confidence) OR confidence < 0 THEN -1 WHEN confidence > 1 THEN confidence / 100 ELSE confidence END AS conf, extracted_at
              FROM candidate_entities WHERE case_id IS NOT NULL AND group_id IS NOT NULL),
            u AS (SELECT *, CAST(round(1000000 * (greatest(conf, 0) + 0.05::DOUBLE * (named + (pdf IS NOT NULL)::INT + (context IS NOT NULL)::INT + (page IS NOT NULL)::INT + (line IS NOT NULL)::INT) + 0.05::DOUBLE)) AS BIGINT) AS w FROM r),
            c AS (SELECT case_id, group_id, f, v, sum(w) AS w, max(coalesce(extracted_at, TIMESTAMP '0001-01-01')) AS seen FROM (SELECT case_id, group_id, w, extracted_at, unnest(['pdf', 'page', 'line', 'context']) AS f, unnest([pdf, page, line, context]) AS v FROM u) WHERE v IS NOT NULL GROUP BY 1, 2, 3, 4),
            b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY case_id, group_id, f ORDER BY w DESC, seen DESC, v) = 1),
            t AS (SELECT case_id, group_id, max(CASE WHEN f = 'pdf' THEN v END) AS source_pdf, max(CASE WHEN f = 'page' THEN CAST(v AS BIGINT) END) AS source_page, max(CASE WHEN f = 'line' THEN CAST(v AS BIGINT) END) AS source_line, md5(max(CASE WHEN f = 'context' THEN v END)) AS context_hash FROM b GROUP BY 1, 2)
            SELECT g.case_id, g.group_id, source_pdf, source_page, source_line, context_hash, round(CASE WHEN conf >= 0 THEN conf END, 6) AS confidence, seen AS extracted_at
            FROM (SELECT case_id, group_id, max(conf) AS conf, max(extracted_at) AS seen FROM u GROUP BY 1, 2) g LEFT JOIN t ON t.case_id = g.case_id AND t.group_id = g.group_id
            WHERE EXISTS (SELECT 1 FROM resolution_groups x WHERE x.case_id = g.case_id AND x.group_id = g.group_id)""",
        # words of an item that stand in runs of at least four equal words
        "p7_found": f"""
            WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '{_WORD}') AS w FROM documents WHERE text IS NOT NULL),
            i AS (SELECT item_id, regexp_extract_all(lower(text), '{_WORD}') AS w FROM eval_items WHERE text IS NOT NULL),
            ip AS (SELECT item_id, w, unnest(range(1, len(w) - 2)) AS p FROM i),
            ig AS (SELECT item_id, len(w) AS n, p, array_to_string(w[p:p + 3], ' ') AS g FROM ip),
            dp AS (SELECT doc_id, w, unnest(range(1, len(w) - 2)) AS p FROM d),
            dg AS (SELECT DISTINCT doc_id, array_to_string(w[p:p + 3], ' ') AS g FROM dp),
            m AS (SELECT DISTINCT doc_id, item_id, n, p + o AS at FROM ig JOIN dg ON ig.g = dg.g CROSS JOIN (VALUES (0), (1), (2), (3)) t(o))
            SELECT doc_id, item_id FROM m GROUP BY doc_id, item_id, n HAVING count(*) >= {leakage.COVERAGE} * n""",
    }
