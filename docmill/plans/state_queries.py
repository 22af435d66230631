"""Documents, reviews, users and sessions as tables, pages and domains, and the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.functions import text as T
from docmill.operators import config, pages, state
from docmill.plans.entity_queries import MENTIONS, _list, _mentions
from docmill.plans.text_queries import NODES, _nodes, _strip, _words
from docmill.session import table
from docmill.sources import files

NOW, PURPOSE = "1998-06-01 00:00:00", "1-URGENT"


def _registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "document_registry")
    return r.groupBy("case_id", "doc_id").agg(F.max_by(F.struct("filename", "status", "page_count", "uploaded_at"), "uploaded_at").alias("r")).select("case_id", "doc_id", "r.filename", "r.status", F.col("r.page_count").cast("double").cast("int").alias("page_count"), "r.uploaded_at")


def registry_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files still to be processed registered as new ones behind the others of their case."""
    r = _registry(spark, sf_dir)
    old = F.col("status") == "processed"
    return state.add_documents(r.where(old), r.where(~old)).select("case_id", "doc_id", "filename", "file_type", "status")


def registry_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registry after the extractions: processed, with the pages that were read."""
    done = table(spark, sf_dir, "extraction_outputs").groupBy("case_id", "doc_id").agg(F.max(F.col("page_count").cast("double").cast("int")).alias("page_count"))
    return state.set_status(_registry(spark, sf_dir), done.withColumn("status", F.lit("processed"))).select("case_id", "doc_id", "status", "page_count")


def registry_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.retry(_registry(spark, sf_dir)).groupBy("case_id", "status").agg(F.count("*").alias("files"), F.count("page_count").alias("with_pages"))


def case_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest cases that a user other than an administrator sees: their own."""
    c = table(spark, sf_dir, "cases")
    me = c.agg(F.min("created_by").alias("created_by"))
    return c.join(F.broadcast(me), "created_by").select("case_id", "case_name", "created_at").orderBy(F.desc("created_at"), "case_id").limit(50)


def provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each mention with the file it comes from; without one it belongs to the first of its case."""
    m = _mentions(spark, sf_dir).select("mention_id", "case_id", F.coalesce("source_doc_id", F.lit("doc_001")).alias("doc_id"), "source_filename")
    r = _registry(spark, sf_dir).select("case_id", "doc_id", "filename", "uploaded_at")
    return m.join(r, ["case_id", "doc_id"], "left").select("mention_id", "doc_id", F.coalesce("source_filename", "filename").alias("filename"), "uploaded_at")


def extraction_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fields of a mention that are exported."""
    m = _mentions(spark, sf_dir)
    return m.select("mention_id", "text", "canonical_name", "schema_type", "gliner_label", F.round("confidence", 4).alias("confidence"), "source_pdf", F.col("source_page").cast("double").cast("int").alias("source_page"), "context")


def _groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "resolution_groups").select("case_id", "group_id", "schema_type", "canonical_name", "resolution", "human_decision", "human_selected", "decided_at")


def review_confirmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a review commits: decision, name from the first bucket, disagreement with the votes, log."""
    g = _groups(spark, sf_dir)
    staged = g.where("human_decision is not null").select("case_id", "group_id", F.col("human_decision").alias("decision"), F.col("human_selected").alias("buckets"), F.col("decided_at").alias("staged_at"))
    votes = table(spark, sf_dir, "candidate_entities").where("group_id is not null").select("case_id", "group_id", "llm_vote")
    return state.confirm_all(g.select("case_id", "group_id", "canonical_name"), votes, staged)


def decisions_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The aliases of merged groups, and the groups kept apart."""
    names = table(spark, sf_dir, "candidate_entities").where("group_id is not null").select("case_id", "group_id", F.col("canonical_name").alias("name"))
    return state.apply_decisions(_groups(spark, sf_dir), names).select("case_id", "group_id", "action", "old", "canonical")


def group_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of the groups of a case in order of type and first candidate."""
    from pyspark.sql.window import Window

    c = table(spark, sf_dir, "candidate_entities").where("group_id is not null")
    first = c.groupBy("case_id", "group_id").agg(F.min("candidate_id").alias("first"), F.min("schema_type").alias("kind"))
    number = F.row_number().over(Window.partitionBy("case_id").orderBy(F.coalesce("kind", F.lit("")), "first"))
    return first.select("case_id", "group_id", F.concat(F.lit("group_"), F.lpad(number.cast("string"), 4, "0")).alias("number"))


def confirmed_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The size of the registry of each case; 0 where nothing is confirmed."""
    g = _groups(spark, sf_dir)
    key = F.regexp_replace(F.lower("canonical_name"), " ", "_")
    named = g.where("decided_at is not null and trim(canonical_name) <> ''").groupBy("case_id").agg(F.count_distinct(key).alias("confirmed"))
    return table(spark, sf_dir, "cases").select("case_id").join(named, "case_id", "left").select("case_id", F.coalesce("confirmed", F.lit(0)).alias("confirmed"))


def review_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Progress of a review where deleted candidates count: selected candidates of merged groups stay, the others are deleted."""
    c = table(spark, sf_dir, "candidate_entities").where("group_id is not null and text is not null").select("case_id", "group_id", "text")
    g = _groups(spark, sf_dir)
    kept = ~F.coalesce(F.col("human_decision") == "MERGE", F.lit(False)) | F.col("human_selected").isNull() | F.array_contains(F.coalesce("human_selected", F.array().cast("array<string>")), F.col("text"))
    per = c.join(g, ["case_id", "group_id"]).groupBy("case_id", "group_id").agg(F.count_if(kept).alias("kept"), F.count_if(~kept).alias("deleted"), F.max("human_decision").alias("decision"))
    done = F.col("decision").isin("MERGE", "KEEP") | (F.col("deleted") > 0)
    return per.groupBy("case_id").agg(F.sum("kept").alias("kept"), F.sum("deleted").alias("deleted"), F.round(F.count_if(done) * 100.0 / F.count("*")).cast("int").alias("percent"))


def annotations_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes of each file in order of page after those without a text are deleted; sections stand in for notes."""
    from pyspark.sql.window import Window

    p = table(spark, sf_dir, "passages").where("source_pdf is not null and page_number is not null and not isnan(page_number)").select("passage_id", "source_pdf", F.col("page_number").cast("int").alias("page"), "section_title")
    left = state.without(p, p.where("section_title is null or section_title = ''"), ["passage_id"])
    return left.withColumn("place", F.row_number().over(Window.partitionBy("source_pdf").orderBy("page", "passage_id"))).select("passage_id", "source_pdf", "page", "place")


def tokens_consumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens that may be used now; orders stand in for tokens, customers for users."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("token"), F.col("o_custkey").alias("user_id"), F.col("o_orderpriority").alias("purpose"), (F.col("o_orderstatus") == "F").alias("used"), (F.col("o_orderdate") + F.expr("interval 48 hours")).alias("expires_at"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), (F.col("c_acctbal") > 0).alias("active"))
    return state.consume_tokens(o, c, PURPOSE, F.lit(NOW).cast("timestamp"))


def users_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users by name whatever its case; event users stand in for the names typed."""
    typed = table(spark, sf_dir, "events").select(F.concat(F.lit("CUSTOMER#"), F.lpad(F.col("user_id").cast("string"), 9, "0")).alias("typed")).distinct()
    c = table(spark, sf_dir, "customer").select("c_custkey", F.lower("c_name").alias("low"))
    return typed.join(c, F.lower("typed") == F.col("low")).select("c_custkey", "typed")


def users_migrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old users inserted where they are absent: nations by name behind regions by name."""
    r = table(spark, sf_dir, "region").select(F.col("r_name").alias("name"), F.lit("region").alias("origin"))
    n = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.lit("nation").alias("origin"))
    return state.insert_absent(r, n.unionByName(r.withColumn("origin", F.lit("again"))), "name")


def research_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions with their last messages; a user's events of one type stand in for a session."""
    s = state.sessions(table(spark, sf_dir, "events"), ["user_id", "event_type"], "ts", "props", "event_id")
    return s.select("user_id", "event_type", "name", "updated_at", "n_messages", F.array_join(F.transform("window", lambda x: x.cast("string")), ",").alias("window"))


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "passages").where("source_pdf is not null and page_number is not null and not isnan(page_number) and text is not null")
    part = F.array_sort(F.collect_list(F.struct("passage_id", "text")))
    return p.groupBy("case_id", "source_pdf", F.col("page_number").cast("int").alias("page")).agg(F.array_join(F.transform(part, lambda s: s["text"]), "\n").alias("text"))


def page_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short pages of the passages take the other reading of the tree where it has more words."""
    n = _nodes(spark, sf_dir).where("content is not null and page_num is not null")
    part = F.array_sort(F.collect_list(F.struct("ordinal", "node_key", "content")))
    read = n.groupBy("case_id", "doc_id", F.col("page_num").alias("page")).agg(F.array_join(F.transform(part, lambda s: s["content"]), "\n").alias("read"))
    named = read.join(_registry(spark, sf_dir).select("case_id", "doc_id", F.col("filename").alias("source_pdf")), ["case_id", "doc_id"]).select("case_id", "source_pdf", "page", "read")
    j = _pages(spark, sf_dir).join(named, ["case_id", "source_pdf", "page"], "left")
    chosen = pages.choose(F.col("text"), F.col("read"))
    return j.select("case_id", "source_pdf", "page", (~chosen.eqNullSafe(F.col("text"))).alias("read_again"), F.size(T.words(chosen)).alias("n_words"))


def page_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pages.join_pages(_pages(spark, sf_dir), ["case_id", "source_pdf"], "page", "text")
    return out.select("case_id", "source_pdf", F.col("pages").alias("n_pages"), F.md5("markdown").alias("markdown_hash"))


def page_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines marked in a passage as a table under its text, unless they begin in it already."""
    t = pages.with_table(F.col("text"), F.col("relevant_lines"))
    return table(spark, sf_dir, "passages").select("passage_id", F.md5(t).alias("text_hash"), pages.table_row(F.array("source_pdf", "section_title")).alias("row"))


def page_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages of the index; where none was read, the contexts of the page's mentions."""
    m = _mentions(spark, sf_dir).where("case_id is not null and source_pdf is not null and source_page > 0").select("case_id", "source_pdf", F.col("source_page").cast("int").alias("page"), "context")
    t = pages.page_texts(_pages(spark, sf_dir), m, ["case_id", "source_pdf", "page"])
    return t.select("case_id", "source_pdf", "page", "from_mentions", F.md5("text").alias("text_hash"))


def text_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every Markdown as a text file, read by its extension; a type without a reader gives an error."""
    e = table(spark, sf_dir, "extraction_outputs").where("markdown_text is not null")
    kind = F.when(F.col("output_id") % 2 == 0, ".txt").otherwise(".msg")
    f = files.extract(e.select(F.concat(F.lit("/in/"), F.col("output_id").cast("string"), kind).alias("path"), F.encode("markdown_text", "utf-8").alias("content")))
    return f.select("filename", "file_type", "page_count", F.md5("markdown_text").alias("text_hash"), F.col("error").isNotNull().alias("failed"))


def mail_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions as mails: their head, then their body."""
    i = table(spark, sf_dir, "eval_items").where("question is not null")
    body = F.concat(F.lit("From: a@example.com\nTo: b@example.org\nSubject: Item "), F.col("item_id").cast("string"), F.lit("\nContent-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: 8bit\n\n"), "question")
    f = files.extract(i.select(F.concat(F.lit("/in/"), F.col("item_id").cast("string"), F.lit(".eml")).alias("path"), F.encode(body, "utf-8").alias("content")))
    return f.select("filename", "page_count", F.md5("markdown_text").alias("text_hash"))


def scanned_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages as pages of a file for each case: the bytes parsed into pages, short pages read again by a supplied reader, joined under markers."""
    p = _pages(spark, sf_dir).where("case_id is not null").groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("source_pdf", "page", "text"))).alias("x"))
    made = p.select(F.col("case_id").alias("path"), F.encode(F.array_join(F.transform("x", lambda r: r["text"]), "\f"), "utf-8").alias("content"))
    rows = files.page_rows(made, lambda data: [(t, [], t.encode()) for t in data.decode().split("\f")], lambda image: image.decode() + " read again")
    text = pages.choose(F.col("text"), F.col("read"))
    out = pages.join_pages(rows.select("path", "page", text.alias("text")), ["path"], "page", "text")
    return out.select(F.col("path").alias("case_id"), F.col("pages").alias("n_pages"), F.md5("markdown").alias("markdown_hash"))


def _domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A configuration from the tables: the types that mentions of a domain's cases have."""
    c = table(spark, sf_dir, "cases").select("case_id", F.coalesce("domain", F.lit(config.COMMON)).alias("domain_id"))
    m = _mentions(spark, sf_dir).where("schema_type is not null").select("case_id", "schema_type", "gliner_label")
    lists = m.join(F.broadcast(c), "case_id").groupBy("domain_id").agg(F.array_sort(F.collect_set("schema_type")).alias("labels"), F.array_sort(F.collect_set("gliner_label")).alias("vocabulary"))
    names = table(spark, sf_dir, "subject_areas").select(F.col("subject_name").alias("domain_id"), F.col("description").alias("name"))
    empty = F.array().cast("array<string>")
    return names.join(lists, "domain_id", "left").select("domain_id", "name", F.coalesce("labels", empty).alias("labels"), F.coalesce("vocabulary", empty).alias("vocabulary"), empty.alias("headings"), F.array("name").alias("examples"))


def domain_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lists of each case: the common ones, then those of its domain."""
    d = config.domain_of(table(spark, sf_dir, "cases"), _domains(spark, sf_dir))
    return d.select("case_id", "domain_id", "known", *[F.array_join(c, ";").alias(c) for c in ("labels", "vocabulary", "examples")])


QUERIES = {
    f.__name__: f
    for f in (
        registry_append, registry_status, registry_retry, case_newest, provenance, extraction_rows, review_confirmed, decisions_applied, group_numbers, confirmed_entities, review_kept, annotations_listed,
        tokens_consumed, users_found, users_migrated, research_sessions, page_choice, page_markdown, page_tables, page_fallback, domain_config, text_files, mail_files, scanned_files,
    )
}

_REG = "reg AS (SELECT case_id, doc_id, filename, status, CASE WHEN page_count IS NULL OR isnan(CAST(page_count AS DOUBLE)) THEN NULL ELSE CAST(page_count AS INT) END AS page_count, uploaded_at FROM document_registry QUALIFY row_number() OVER (PARTITION BY case_id, doc_id ORDER BY uploaded_at DESC) = 1)"
_EXT = "lower(regexp_extract(filename, '\\.([^./]+)$', 1))"
_PAGE = "page_number IS NOT NULL AND NOT isnan(CAST(page_number AS DOUBLE))"
_PAGES = f"pg AS (SELECT case_id, source_pdf, CAST(page_number AS INT) AS page, string_agg(text, chr(10) ORDER BY passage_id) AS text FROM passages WHERE source_pdf IS NOT NULL AND {_PAGE} AND text IS NOT NULL GROUP BY 1, 2, 3)"
_DOM = f"""c AS (SELECT case_id, coalesce(domain, 'universal') AS domain_id FROM cases), m AS (SELECT case_id, schema_type, gliner_label FROM {MENTIONS} WHERE schema_type IS NOT NULL),
    l AS (SELECT domain_id, list_sort(list(DISTINCT schema_type)) AS labels, list_sort(list(DISTINCT gliner_label) FILTER (WHERE gliner_label IS NOT NULL)) AS vocabulary FROM m JOIN c ON m.case_id = c.case_id GROUP BY 1),
    dom AS (SELECT subject_name AS domain_id, description, coalesce(labels, []) AS labels, coalesce(vocabulary, []) AS vocabulary FROM subject_areas LEFT JOIN l ON l.domain_id = subject_name)"""
_UNIQUE = lambda c: f"array_to_string(list_concat(u.{c}, list_filter(coalesce(o.{c}, []), lambda x: NOT list_contains(u.{c}, x))), ';')"

SQL = {
    "text_files": f"""SELECT output_id || CASE WHEN output_id % 2 = 0 THEN '.txt' ELSE '.msg' END AS filename, CASE WHEN output_id % 2 = 0 THEN '.txt' ELSE '.msg' END AS file_type, CASE WHEN output_id % 2 = 0 THEN CAST(greatest(1, {_words('markdown_text')} // 300) AS INT) END AS page_count,
        CASE WHEN output_id % 2 = 0 THEN md5('# ' || output_id || chr(10) || chr(10) || markdown_text) END AS text_hash, output_id % 2 <> 0 AS failed FROM extraction_outputs WHERE markdown_text IS NOT NULL""",
    "mail_files": f"""SELECT item_id || '.eml' AS filename, 1::INT AS page_count, md5('# Item ' || item_id || chr(10) || chr(10) || '**From:** a@example.com' || chr(10) || '**To:** b@example.org' || chr(10) || '**Subject:** Item ' || item_id || chr(10) || chr(10) || '## Email Body' || chr(10) || chr(10) || {_strip('question')}) AS text_hash FROM eval_items WHERE question IS NOT NULL""",
    "scanned_files": f"""WITH {_PAGES}, o AS (SELECT case_id, row_number() OVER (PARTITION BY case_id ORDER BY source_pdf, page, text) AS k, CASE WHEN {_words('text')} < 20 THEN text || ' read again' ELSE text END AS t FROM pg WHERE case_id IS NOT NULL)
        SELECT case_id, CAST(count(*) AS INT) AS n_pages, md5(string_agg('<!-- page:' || k || ' -->' || chr(10) || t, chr(10) || chr(10) ORDER BY k)) AS markdown_hash FROM o WHERE {_strip('t')} <> '' GROUP BY case_id""",
    "registry_append": f"""WITH {_REG}, n AS (SELECT case_id, count(*) AS had FROM reg WHERE status = 'processed' GROUP BY 1)
        SELECT r.case_id, 'doc_' || lpad(CAST(coalesce(had, 0) + row_number() OVER (PARTITION BY r.case_id ORDER BY uploaded_at, filename) AS VARCHAR), 3, '0') AS doc_id, filename, CASE WHEN {_EXT} IN ({_list(state.FILE_TYPES)}) THEN {_EXT} ELSE 'unknown' END AS file_type, 'pending' AS status
        FROM reg r LEFT JOIN n ON n.case_id = r.case_id WHERE status <> 'processed'""",
    "registry_status": f"""WITH {_REG}, d AS (SELECT case_id, doc_id, max(CASE WHEN isnan(CAST(page_count AS DOUBLE)) THEN NULL ELSE CAST(page_count AS INT) END) AS n FROM extraction_outputs GROUP BY 1, 2)
        SELECT r.case_id, r.doc_id, CASE WHEN d.doc_id IS NULL THEN status ELSE 'processed' END AS status, coalesce(n, page_count) AS page_count FROM reg r LEFT JOIN d ON d.case_id = r.case_id AND d.doc_id = r.doc_id""",
    "registry_retry": f"WITH {_REG} SELECT case_id, CASE WHEN status = 'failed' THEN 'pending' ELSE status END AS status, count(*) AS files, count(CASE WHEN coalesce(status, '') <> 'failed' THEN page_count END) AS with_pages FROM reg GROUP BY 1, 2",
    "case_newest": "SELECT case_id, case_name, created_at FROM cases WHERE created_by = (SELECT min(created_by) FROM cases) ORDER BY created_at DESC, case_id LIMIT 50",
    "provenance": f"WITH {_REG}, m AS (SELECT mention_id, case_id, coalesce(source_doc_id, 'doc_001') AS doc_id, source_filename FROM {MENTIONS}) SELECT mention_id, m.doc_id, coalesce(source_filename, filename) AS filename, uploaded_at FROM m LEFT JOIN reg ON reg.case_id = m.case_id AND reg.doc_id = m.doc_id",
    "extraction_rows": f"SELECT mention_id, text, canonical_name, schema_type, gliner_label, round(confidence, 4) AS confidence, source_pdf, CASE WHEN isnan(CAST(source_page AS DOUBLE)) THEN NULL ELSE CAST(source_page AS INT) END AS source_page, context FROM {MENTIONS}",
    "review_confirmed": """WITH v AS (SELECT case_id, group_id, count(*) FILTER (WHERE llm_vote = 'YES') * 2 > count(*) AS merge FROM candidate_entities WHERE group_id IS NOT NULL GROUP BY 1, 2),
        g AS (SELECT g.*, coalesce(merge, false) <> (human_decision = 'MERGE') AS d FROM resolution_groups g LEFT JOIN v ON v.case_id = g.case_id AND v.group_id = g.group_id WHERE human_decision IS NOT NULL)
        SELECT case_id, group_id, human_decision AS decision, coalesce(human_selected[1], canonical_name) AS canonical_name, d AS disagreement, decided_at,
          'Group ' || group_id || ' | Decision: ' || human_decision || ' | Buckets: ' || coalesce(array_to_string(human_selected, ','), '') || ' | Disagreement: ' || CAST(d AS VARCHAR) AS log FROM g""",
    "decisions_applied": """WITH g AS (SELECT case_id, group_id, canonical_name AS canonical, CASE WHEN resolution = 'AUTO_MERGE' OR resolution = 'NEEDS_REVIEW' AND human_decision = 'MERGE' THEN 'MERGED' WHEN resolution = 'NEEDS_REVIEW' AND human_decision = 'KEEP' THEN 'KEPT' END AS action FROM resolution_groups)
        SELECT DISTINCT g.case_id, g.group_id, action, c.canonical_name AS old, canonical FROM g JOIN candidate_entities c ON c.case_id = g.case_id AND c.group_id = g.group_id WHERE action = 'MERGED' AND c.canonical_name <> canonical
        UNION ALL SELECT case_id, group_id, action, NULL, canonical FROM g WHERE action = 'KEPT'""",
    "group_numbers": """WITH f AS (SELECT case_id, group_id, min(candidate_id) AS first, coalesce(min(schema_type), '') AS kind FROM candidate_entities WHERE group_id IS NOT NULL GROUP BY 1, 2)
        SELECT case_id, group_id, 'group_' || lpad(CAST(row_number() OVER (PARTITION BY case_id ORDER BY kind, first) AS VARCHAR), 4, '0') AS number FROM f""",
    "confirmed_entities": "SELECT c.case_id, count(DISTINCT replace(lower(canonical_name), ' ', '_')) AS confirmed FROM (SELECT DISTINCT case_id FROM cases) c LEFT JOIN resolution_groups g ON g.case_id = c.case_id AND decided_at IS NOT NULL AND trim(canonical_name) <> '' GROUP BY c.case_id",
    "review_kept": """WITH r AS (SELECT c.case_id, c.group_id, human_decision, NOT coalesce(human_decision = 'MERGE', false) OR human_selected IS NULL OR list_contains(human_selected, text) AS keep FROM candidate_entities c JOIN resolution_groups g ON g.case_id = c.case_id AND g.group_id = c.group_id WHERE text IS NOT NULL),
        p AS (SELECT case_id, group_id, count(*) FILTER (WHERE keep) AS kept, count(*) FILTER (WHERE NOT keep) AS deleted, max(human_decision) AS decision FROM r GROUP BY 1, 2)
        SELECT case_id, CAST(sum(kept) AS BIGINT) AS kept, CAST(sum(deleted) AS BIGINT) AS deleted, CAST(round(count(*) FILTER (WHERE decision IN ('MERGE', 'KEEP') OR deleted > 0) * 100.0 / count(*)) AS INT) AS percent FROM p GROUP BY case_id""",
    "annotations_listed": f"SELECT passage_id, source_pdf, CAST(page_number AS INT) AS page, row_number() OVER (PARTITION BY source_pdf ORDER BY CAST(page_number AS INT), passage_id) AS place FROM passages WHERE source_pdf IS NOT NULL AND {_PAGE} AND section_title <> ''",
    "tokens_consumed": f"SELECT o_orderkey AS token, o_custkey AS user_id FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderpriority = '{PURPOSE}' AND o_orderstatus <> 'F' AND o_orderdate + INTERVAL 48 HOURS > TIMESTAMP '{NOW}' AND c_acctbal > 0",
    "users_found": "SELECT c_custkey, typed FROM (SELECT DISTINCT 'CUSTOMER#' || lpad(CAST(user_id AS VARCHAR), 9, '0') AS typed FROM events) JOIN customer ON lower(typed) = lower(c_name)",
    "users_migrated": "SELECT r_name AS name, 'region' AS origin FROM region UNION ALL SELECT n_name, 'nation' FROM nation WHERE n_name NOT IN (SELECT r_name FROM region)",
    "research_sessions": """WITH n AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events)
        SELECT user_id, event_type, substring(first(props ORDER BY ts, event_id), 1, 40) AS name, max(ts) AS updated_at, count(*) AS n_messages, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY ts, event_id) FILTER (WHERE k <= 20) AS window FROM n GROUP BY 1, 2""",
    "page_choice": f"""WITH {_REG}, {_PAGES}, t AS (SELECT case_id, doc_id, page_num AS page, string_agg(content, chr(10) ORDER BY ordinal, node_key) AS read FROM {NODES} WHERE content IS NOT NULL AND page_num IS NOT NULL GROUP BY 1, 2, 3),
        j AS (SELECT pg.*, read, {_words('text')} AS a, {_words("coalesce(read, '')")} AS b FROM pg LEFT JOIN (SELECT t.case_id, filename, page, read FROM t JOIN reg ON reg.case_id = t.case_id AND reg.doc_id = t.doc_id) t ON t.case_id = pg.case_id AND t.filename = pg.source_pdf AND t.page = pg.page)
        SELECT case_id, source_pdf, page, a < 20 AND b > a AND read <> text AS read_again, CASE WHEN a < 20 AND b > a THEN b ELSE a END AS n_words FROM j""",
    "page_markdown": f"WITH {_PAGES} SELECT case_id, source_pdf, CAST(count(*) AS INT) AS n_pages, md5(string_agg('<!-- page:' || page || ' -->' || chr(10) || text, chr(10) || chr(10) ORDER BY page)) AS markdown_hash FROM pg WHERE {_strip('text')} <> '' GROUP BY 1, 2",
    "page_tables": f"""WITH p AS (SELECT *, array_to_string(relevant_lines, chr(10)) AS t FROM passages)
        SELECT passage_id, md5(CASE WHEN coalesce(len(relevant_lines), 0) < 1 OR contains(coalesce(text, ''), substring(t, 1, 30)) THEN text ELSE concat_ws(chr(10) || chr(10), text, t) END) AS text_hash, {_strip("coalesce(source_pdf, '')")} || ' | ' || {_strip("coalesce(section_title, '')")} AS row FROM p""",
    "page_fallback": f"""WITH {_PAGES}, m AS (SELECT case_id, source_pdf, CAST(source_page AS INT) AS page, string_agg(DISTINCT context, ' ... ' ORDER BY context) AS contexts FROM {MENTIONS} WHERE case_id IS NOT NULL AND source_pdf IS NOT NULL AND source_page > 0 AND context IS NOT NULL GROUP BY 1, 2, 3)
        SELECT coalesce(pg.case_id, m.case_id) AS case_id, coalesce(pg.source_pdf, m.source_pdf) AS source_pdf, coalesce(pg.page, m.page) AS page, text IS NULL AS from_mentions, md5(coalesce(text, contexts)) AS text_hash FROM pg FULL JOIN m ON m.case_id = pg.case_id AND m.source_pdf = pg.source_pdf AND m.page = pg.page""",
    "domain_config": f"""WITH {_DOM} SELECT x.case_id, CASE WHEN o.domain_id IS NULL THEN 'universal' ELSE o.domain_id END AS domain_id, o.domain_id IS NOT NULL OR coalesce(x.domain = 'universal', false) AS known, {_UNIQUE('labels')} AS labels, {_UNIQUE('vocabulary')} AS vocabulary, concat_ws(';', u.description, o.description) AS examples
        FROM cases x LEFT JOIN dom o ON o.domain_id = x.domain AND o.domain_id <> 'universal' CROSS JOIN (SELECT * FROM dom WHERE domain_id = 'universal') u""",
}
