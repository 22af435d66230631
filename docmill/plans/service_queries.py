"""State of the service as tables, and the SQL it is checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docmill.operators import resolution as R
from docmill.operators.retrieval import best_per
from docmill.session import table

#: Cases a plan allows; null is without limit.
PLAN_LIMITS = {"free": 2, "pro": 10, "max": 50, "firm_small": 50, "firm_mid": 100, "firm_large": None}
PLANS = {"AUTOMOBILE": "free", "BUILDING": "pro", "FURNITURE": "max", "HOUSEHOLD": "firm_small", "MACHINERY": "firm_large"}


def case_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "cases").where("created_by is not null")
    return c.select("case_id", "status", "domain", F.row_number().over(Window.partitionBy("created_by").orderBy(F.desc("created_at"), "case_id")).alias("position"))


def registry_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files registered twice count once, by the later upload."""
    return best_per(table(spark, sf_dir, "document_registry"), ["case_id", "doc_id"], [F.desc("uploaded_at")]).select("case_id", "doc_id", "filename", "status")


def registry_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = registry_latest(spark, sf_dir)
    done = F.bool_and(F.coalesce(F.col("status").isin("processed", "failed"), F.lit(False)))
    return r.groupBy("case_id").agg(F.count("*").alias("files"), F.count_if(F.col("status") == "pending").alias("pending"), done.alias("all_processed"))


def file_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docmill.sources.files import extension, is_supported

    return table(spark, sf_dir, "document_registry").groupBy(extension(F.col("filename")).alias("ext"), is_supported(F.col("filename")).alias("supported")).agg(F.count("*").alias("files"))


def staged_last_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last decision staged for each position; events stand in for decisions."""
    e = table(spark, sf_dir, "events").where("event_type in ('click', 'view', 'purchase')")
    return e.groupBy(F.col("user_id").alias("idx")).agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("decision"), F.max("ts").alias("staged_at"))


def confirm_disagreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the majority of votes and the human decision differ."""
    c = table(spark, sf_dir, "candidate_entities").where("group_id is not null").groupBy("case_id", "group_id").agg(F.count_if(F.col("llm_vote") == "YES").alias("yes"), F.count("llm_vote").alias("votes"))
    g = table(spark, sf_dir, "resolution_groups").where("human_decision is not null").select("case_id", "group_id", "human_decision")
    return g.join(c, ["case_id", "group_id"]).select("case_id", "group_id", "human_decision", (R.llm_merge(F.col("yes"), F.col("votes")) != (F.col("human_decision") == "MERGE")).alias("disagreement"))


def review_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "resolution_groups")
    return g.groupBy("case_id").agg(
        F.count("*").alias("groups"), F.count_if(F.col("human_decision").isNotNull()).alias("reviewed"), F.count_if(F.col("resolution") == "AUTO_MERGE").alias("auto_merged"),
        F.round(F.count_if(F.col("human_decision").isNotNull()) * 100.0 / F.count("*")).cast("int").alias("percent"),
    )


def plan_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders stand in for cases, market segments for plans."""
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    rows = [(k, v, PLAN_LIMITS[v]) for k, v in PLANS.items()]
    plans = F.broadcast(spark.createDataFrame(rows, "c_mktsegment string, plan string, allowed int"))
    used = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("used"))
    joined = c.join(plans, "c_mktsegment", "left").join(used, "c_custkey", "left")
    plan, used = F.coalesce("plan", F.lit("free")), F.coalesce("used", F.lit(0))
    allowed = F.when(F.col("plan").isNull(), 2).otherwise(F.col("allowed"))
    return joined.select("c_custkey", plan.alias("plan"), used.alias("used"), (allowed.isNotNull() & (used >= allowed)).alias("at_limit"))


def history_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last twenty entries of each history."""
    e = table(spark, sf_dir, "events")
    return best_per(e, ["user_id"], [F.desc("ts"), F.desc("event_id")], 20).groupBy("user_id").agg(F.count("*").alias("kept"), F.min("event_id").alias("least"), F.max("event_id").alias("greatest"))


def history_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each history row as a question and an answer."""
    i = table(spark, sf_dir, "eval_items")
    both = F.array(F.struct(F.lit("user").alias("role"), F.col("question").alias("content")), F.struct(F.lit("assistant").alias("role"), F.col("text").alias("content")))
    return i.select("item_id", F.inline(both)).select("item_id", "role", F.length("content").alias("n_chars"))


def citation_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One citation for each page of a file, the last one."""
    p = table(spark, sf_dir, "passages").where("page_number is not null and not isnan(page_number)")
    return p.groupBy("case_id", "source_pdf", F.col("page_number").cast("int").alias("page")).agg(F.max("passage_id").alias("passage_id"))


def domain_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The domain of each case, universal where it is missing or unknown."""
    a = table(spark, sf_dir, "subject_areas").select(F.col("subject_name").alias("domain"), "description")
    c = table(spark, sf_dir, "cases").select("case_id", "domain")
    return c.join(F.broadcast(a), "domain", "left").select("case_id", F.when(F.col("description").isNull(), "universal").otherwise(F.col("domain")).alias("domain"))


def domain_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "subject_areas").where("subject_name <> 'universal'").select("subject_name", "description").orderBy("subject_name")


def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch form of the windowed stream: events of each type by day."""
    return table(spark, sf_dir, "events").groupBy(F.date_trunc("day", "ts").alias("day"), "event_type").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (case_listing, registry_latest, registry_progress, file_support, staged_last_write, confirm_disagreement, review_progress, plan_limits, history_window, history_messages, citation_dedupe, domain_defaults, domain_listing, event_windows)}

_LATEST = "(SELECT case_id, doc_id, filename, status FROM document_registry QUALIFY row_number() OVER (PARTITION BY case_id, doc_id ORDER BY uploaded_at DESC) = 1)"
_KNOWN = "'.txt', '.md', '.eml', '.msg', '.docx', '.html', '.htm', '.pdf', '.doc', '.png', '.jpg', '.jpeg', '.tif', '.tiff', '.bmp', '.webp'"
_PLAN = "CASE c_mktsegment " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in PLANS.items()) + " ELSE 'free' END"
_ALLOWED = "CASE plan " + " ".join(f"WHEN '{k}' THEN {'NULL' if v is None else v}" for k, v in PLAN_LIMITS.items()) + " END"

SQL = {
    "case_listing": "SELECT case_id, status, domain, row_number() OVER (PARTITION BY created_by ORDER BY created_at DESC, case_id) AS position FROM cases WHERE created_by IS NOT NULL",
    "registry_latest": f"SELECT * FROM {_LATEST}",
    "registry_progress": f"SELECT case_id, count(*) AS files, count(*) FILTER (WHERE status = 'pending') AS pending, bool_and(coalesce(status IN ('processed', 'failed'), false)) AS all_processed FROM {_LATEST} GROUP BY case_id",
    "file_support": f"SELECT ext, ext IN ({_KNOWN}) AS supported, count(*) AS files FROM (SELECT lower(regexp_extract(filename, '(\\.[^./]+)$', 1)) AS ext FROM document_registry) GROUP BY 1, 2",
    "staged_last_write": "SELECT user_id AS idx, last(event_type ORDER BY ts, event_id) AS decision, max(ts) AS staged_at FROM events WHERE event_type IN ('click', 'view', 'purchase') GROUP BY user_id",
    "confirm_disagreement": """WITH c AS (SELECT case_id, group_id, count(*) FILTER (WHERE llm_vote = 'YES') AS yes, count(llm_vote) AS votes FROM candidate_entities WHERE group_id IS NOT NULL GROUP BY 1, 2)
        SELECT g.case_id, g.group_id, human_decision, (yes * 2 > votes) <> (human_decision = 'MERGE') AS disagreement FROM resolution_groups g JOIN c ON c.case_id = g.case_id AND c.group_id = g.group_id WHERE human_decision IS NOT NULL""",
    "review_progress": "SELECT case_id, count(*) AS groups, count(human_decision) AS reviewed, count(*) FILTER (WHERE resolution = 'AUTO_MERGE') AS auto_merged, CAST(round(count(human_decision) * 100.0 / count(*)) AS INT) AS percent FROM resolution_groups GROUP BY case_id",
    "plan_limits": f"""WITH u AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1), c AS (SELECT c_custkey, {_PLAN} AS plan, coalesce(n, 0) AS used FROM customer LEFT JOIN u ON o_custkey = c_custkey)
        SELECT c_custkey, plan, used, {_ALLOWED} IS NOT NULL AND used >= {_ALLOWED} AS at_limit FROM c""",
    "history_window": "WITH k AS (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 20) SELECT user_id, count(*) AS kept, min(event_id) AS least, max(event_id) AS greatest FROM k GROUP BY user_id",
    "history_messages": "SELECT item_id, 'user' AS role, length(question) AS n_chars FROM eval_items UNION ALL SELECT item_id, 'assistant', length(text) FROM eval_items",
    "citation_dedupe": "SELECT case_id, source_pdf, CAST(page_number AS INT) AS page, max(passage_id) AS passage_id FROM passages WHERE page_number IS NOT NULL AND NOT isnan(CAST(page_number AS DOUBLE)) GROUP BY 1, 2, 3",
    "domain_defaults": "SELECT case_id, CASE WHEN description IS NULL THEN 'universal' ELSE domain END AS domain FROM cases LEFT JOIN subject_areas ON subject_name = domain",
    "domain_listing": "SELECT subject_name, description FROM subject_areas WHERE subject_name <> 'universal' ORDER BY subject_name",
    "event_windows": "SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2",
}
