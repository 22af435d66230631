"""Heading trees, pages and sections of Markdown, as windows over the lines of a document."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docmill.functions import text as T

MARKER = r"^<!-- page:(\d+) -->$"
HEADING = r"^(#{1,4})\s+(.+)$"


def heading_tree(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, seq, level, parent_seq, page_num, title, content), a row for each node; seq 0 is the root.

    A document is one window partition; its lines are sorted once and every running value comes
    from that order.  The parent is the last heading before of a lower level, found as the
    greatest of the last headings of each lower level.
    """
    rows = docs.select(key, F.posexplode(T.lines(F.col(text))).alias("line_no", "line"))
    order = Window.partitionBy(key).orderBy("line_no")
    marker = F.regexp_extract(T.strip(F.col("line")), MARKER, 1)
    rows = rows.withColumn("marker", F.when(marker != "", marker.cast("int"))).withColumn("page", F.coalesce(F.last("marker", True).over(order), F.lit(1))).where("marker is null")
    hashes = F.regexp_extract("line", HEADING, 1)
    rows = rows.withColumn("level", F.when(hashes != "", F.length(hashes))).withColumn("seq", F.count("level").over(order))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    lower = [F.when(F.col("level") > k, F.coalesce(F.max(F.when(F.col("level") == k, F.col("seq"))).over(before), F.lit(0))).otherwise(0) for k in (1, 2, 3)]
    rows = rows.withColumn("parent", F.when(F.col("level").isNotNull(), F.greatest(*lower)))
    body = F.transform(F.array_sort(F.collect_list(F.when(F.col("level").isNull(), F.struct("line_no", "line")))), lambda s: s["line"])
    nodes = rows.groupBy(key, "seq").agg(
        F.max("level").alias("level"), F.max("parent").alias("parent_seq"), F.max(F.when(F.col("level").isNotNull(), F.col("page"))).alias("page_num"),
        F.max(F.when(F.col("level").isNotNull(), F.regexp_extract("line", HEADING, 2))).alias("title"), F.array_join(body, "\n").alias("content"),
    )
    made = nodes.select(key, "seq", F.coalesce("level", F.lit(0)).alias("level"), "parent_seq", F.coalesce("page_num", F.lit(0)).alias("page_num"), T.strip(F.coalesce("title", F.lit("Document"))).alias("title"), T.strip(F.col("content")).alias("content"))
    roots = docs.where(F.col(text).isNotNull()).select(key).join(made.where("seq = 0").select(key), key, "left_anti")
    empty = roots.select(key, F.lit(0).cast("long").alias("seq"), F.lit(0).alias("level"), F.lit(None).cast("long").alias("parent_seq"), F.lit(0).alias("page_num"), F.lit("Document").alias("title"), F.lit("").alias("content"))
    return made.unionByName(empty)


def pages(nodes: DataFrame, key: list[str], order: str, page: str, title: str, content: str, least: int = 10) -> DataFrame:
    """Nodes with content gathered by page in reading order."""
    kept = nodes.where(F.length(T.strip(F.col(content))) > least)
    part = F.concat_ws("\n\n", title, content)
    listed = kept.groupBy(*key, page).agg(F.array_sort(F.collect_list(F.struct(F.col(order), part.alias("part")))).alias("parts"))
    text = F.array_join(F.transform("parts", lambda p: p["part"]), "\n\n")
    return listed.select(*key, page, text.alias("text")).withColumn("word_count", F.size(T.words(F.col("text"))))


def sections(page_rows: DataFrame, key: list[str], page: str, text: str) -> DataFrame:
    """Sections by the first heading among the first five lines of a page; each ends before the next."""
    first = F.filter(F.transform(F.slice(T.lines(F.col(text)), 1, 5), T.strip), lambda x: (F.length(x) > 3) & x.rlike(T.PAGE_SECTION))
    opened = page_rows.select(*key, page, F.get(first, 0).alias("title"))
    last = opened.groupBy(*key).agg(F.max(page).alias("last_page"))
    w = Window.partitionBy(*key).orderBy(page)
    started = opened.where("title is not null").withColumn("next_start", F.lead(page).over(w))
    return started.join(last, key).select(*key, "title", F.col(page).alias("start_page"), F.coalesce(F.col("next_start") - 1, F.col("last_page")).alias("end_page"))


def page_count(markdown: Column) -> Column:
    """Page markers, or a page for each 300 words where there are none."""
    n = F.regexp_count(markdown, F.lit("<!-- page"))
    return F.when(n > 0, n).otherwise(F.greatest(F.lit(1), F.floor(F.size(T.words(markdown)) / 300).cast("int")))


#: Characters of a node that are summarised at most, and up to which a node without summaries below has nothing to say.
SUMMARY_TEXT, SILENT = 5000, 20


def opening(text: Column) -> Column:
    """The offline provider of summaries: how a text begins."""
    return F.substring(text, 1, 80)


def summarize(nodes: DataFrame, provider: Callable[[Column], Column] = opening, deepest: int = 4) -> DataFrame:
    """nodes(case_id, doc_id, node_id, parent_id, level, ordinal, content) -> (case_id, doc_id, node_id, summary).

    From the deepest level up, each node is summarised from its text and the summaries below it;
    the number of joins is the number of levels.  Short nodes with nothing below them have none.
    """
    key = ["case_id", "doc_id"]
    done = None
    for level in range(deepest, -1, -1):
        rows = nodes.where(F.col("level") == level).select(*key, "node_id", "parent_id", "ordinal", "content")
        if done is None:
            rows = rows.withColumn("below", F.lit(None).cast("string"))
        else:
            part = F.array_sort(F.collect_list(F.struct("ordinal", "summary")))
            below = done.where("summary is not null").groupBy(*key, F.col("parent_id").alias("node_id")).agg(F.array_join(F.transform(part, lambda s: s["summary"]), "\n").alias("below"))
            rows = rows.join(below, [*key, "node_id"], "left")
        said = (F.length(T.strip(F.coalesce("content", F.lit("")))) > SILENT) | F.col("below").isNotNull()
        text = F.concat_ws("\n", F.substring("content", 1, SUMMARY_TEXT), "below")
        made = rows.select(*key, "node_id", "parent_id", "ordinal", F.when(said, provider(text)).alias("summary"))
        done = made if done is None else done.unionByName(made)
    return done.select(*key, "node_id", "summary")
