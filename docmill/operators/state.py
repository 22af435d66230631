"""State of cases, documents, reviews, users and sessions as operations on tables.

Every change gives the whole new table, so that a writer replaces a table or a partition at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Extensions that have a name of their own in the registry.
FILE_TYPES = ["pdf", "docx", "doc", "eml", "msg", "txt", "jpg", "jpeg", "png"]
KEPT = 20


def file_type(filename: Column) -> Column:
    kind = F.lower(F.regexp_extract(filename, r"\.([^./]+)$", 1))
    return F.when(kind.isin(FILE_TYPES), kind).otherwise("unknown")


def add_documents(existing: DataFrame, new: DataFrame) -> DataFrame:
    """existing(case_id), new(case_id, filename, uploaded_at) -> the new files with the next numbers of their case.

    A case has few files; its numbers are given in one partition of the case.
    """
    had = existing.groupBy("case_id").agg(F.count("*").alias("had"))
    place = F.row_number().over(Window.partitionBy("case_id").orderBy("uploaded_at", "filename"))
    number = F.coalesce("had", F.lit(0)) + F.col("place")
    return new.withColumn("place", place).join(had, "case_id", "left").select("case_id", F.concat(F.lit("doc_"), F.lpad(number.cast("string"), 3, "0")).alias("doc_id"), "filename", file_type(F.col("filename")).alias("file_type"), F.lit("pending").alias("status"), F.lit(None).cast("int").alias("page_count"))


def set_status(documents: DataFrame, updates: DataFrame) -> DataFrame:
    """documents(case_id, doc_id, status, page_count), updates(the same) -> the table with the updates; a null page count keeps the old one."""
    u = updates.select("case_id", "doc_id", F.col("status").alias("new_status"), F.col("page_count").alias("new_count"))
    return documents.join(u, ["case_id", "doc_id"], "left").withColumns({"status": F.coalesce("new_status", "status"), "page_count": F.coalesce("new_count", "page_count")}).drop("new_status", "new_count")


def retry(documents: DataFrame) -> DataFrame:
    """Failed documents wait again, without a page count."""
    failed = F.coalesce(F.col("status") == "failed", F.lit(False))
    return documents.withColumns({"page_count": F.when(~failed, F.col("page_count")), "status": F.when(failed, "pending").otherwise(F.col("status"))})


def without(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """What is left of a table when some keys are deleted; rows with a null key stay."""
    return rows.join(gone.select(*keys).distinct(), keys, "left_anti")


def confirm_all(groups: DataFrame, votes: DataFrame, staged: DataFrame) -> DataFrame:
    """The staged decisions of a review made final.

    groups(case_id, group_id, canonical_name), votes(case_id, group_id, llm_vote), staged(case_id,
    group_id, decision, buckets array<string>, staged_at).  The models would merge where more than
    half of the votes say yes; a first bucket gives the group its name.
    """
    keys = ["case_id", "group_id"]
    said = votes.groupBy(*keys).agg(F.count_if(F.col("llm_vote") == "YES").alias("yes"), F.count("*").alias("votes"))
    merge = F.coalesce(F.col("yes") * 2 > F.col("votes"), F.lit(False))
    disagreement = merge != (F.col("decision") == "MERGE")
    name = F.coalesce(F.try_element_at("buckets", F.lit(1)), F.col("canonical_name"))
    log = F.format_string("Group %s | Decision: %s | Buckets: %s | Disagreement: %s", "group_id", "decision", F.coalesce(F.array_join("buckets", ","), F.lit("")), disagreement.cast("string"))
    return groups.join(staged, keys).join(said, keys, "left").select(*keys, "decision", name.alias("canonical_name"), disagreement.alias("disagreement"), F.col("staged_at").alias("decided_at"), log.alias("log"))


def apply_decisions(groups: DataFrame, members: DataFrame) -> DataFrame:
    """groups(case_id, group_id, canonical_name, resolution, human_decision), members(case_id, group_id, name) -> (case_id, group_id, action, old, canonical).

    Automatic merges and human merges give an alias for each other name of the group; KEEP is
    logged without an alias, anything else does nothing.
    """
    action = F.when(F.col("resolution") == "AUTO_MERGE", "MERGED").when((F.col("resolution") == "NEEDS_REVIEW") & (F.col("human_decision") == "MERGE"), "MERGED").when((F.col("resolution") == "NEEDS_REVIEW") & (F.col("human_decision") == "KEEP"), "KEPT")
    told = groups.select("case_id", "group_id", F.col("canonical_name").alias("canonical"), action.alias("action")).where("action is not null")
    names = members.where("name is not null").select("case_id", "group_id", F.col("name").alias("old")).distinct()
    merged = told.where("action = 'MERGED' and canonical is not null").join(names, ["case_id", "group_id"]).where("old <> canonical")
    kept = told.where("action = 'KEPT'").select("case_id", "group_id", "canonical", "action", F.lit(None).cast("string").alias("old"))
    return merged.select(*kept.columns).unionByName(kept)


def consume_tokens(tokens: DataFrame, users: DataFrame, purpose: str, now: Column) -> DataFrame:
    """tokens(token, user_id, purpose, used, expires_at), users(user_id, active) -> (token, user_id) of those that may be used."""
    fresh = tokens.where((F.col("purpose") == purpose) & ~F.col("used") & (F.col("expires_at") > now))
    return fresh.join(users.where("active").select("user_id"), "user_id").select("token", "user_id")


def insert_absent(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """The table with the rows whose key it does not have yet, each once."""
    once = rows.groupBy(key).agg(*[F.min_by(c, F.struct(*rows.columns)).alias(c) for c in rows.columns if c != key])
    return table.select(*rows.columns).unionByName(once.join(table.select(key), key, "left_anti").select(*rows.columns))


def sessions(messages: DataFrame, keys: list[str], time: str, text: str, order: str) -> DataFrame:
    """(keys, name, updated_at, messages): each session with its last KEPT messages, named after its first.

    Only the last messages of each part are gathered: the rank is taken inside the session.
    """
    w = Window.partitionBy(*keys).orderBy(F.desc(time), F.desc(order))
    ends = messages.groupBy(*keys).agg(F.max(time).alias("updated_at"), F.count("*").alias("n_messages"), F.substring(F.min_by(text, F.struct(time, order)), 1, 40).alias("name"))
    last = messages.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= KEPT).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(time, order)))[order].alias("window"))
    return ends.join(last, keys)
