"""Pages of scanned and digital files: which reading is kept, tables, joining, page texts for the index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.functions import text as T

#: A page with fewer words is read again by character recognition.
DIGITAL_WORDS = 20


def needs_reading(text: Column) -> Column:
    return F.size(T.words(F.coalesce(text, F.lit("")))) < DIGITAL_WORDS


def choose(text: Column, read: Column) -> Column:
    """The digital text; of short pages what was read from the image, if that has more words."""
    words = lambda c: F.size(T.words(F.coalesce(c, F.lit(""))))
    return F.when(needs_reading(text) & (words(read) > words(text)), read).otherwise(text)


def with_table(text: Column, rows: Column) -> Column:
    """The text with a table's rows under it, unless the table's first 30 characters stand in it already."""
    table = F.array_join(rows, "\n")
    known = F.contains(F.coalesce(text, F.lit("")), F.substring(table, 1, 30))
    return F.when((F.coalesce(F.size(rows), F.lit(0)) < 1) | known, text).otherwise(F.concat_ws("\n\n", text, table))


def table_row(cells: Column) -> Column:
    return F.array_join(F.transform(cells, lambda c: T.strip(F.coalesce(c, F.lit("")))), " | ")


def join_pages(pages: DataFrame, keys: list[str], page: str, text: str) -> DataFrame:
    """(keys, markdown, pages): the pages that are not blank in order, each under its marker."""
    kept = pages.where(T.strip(F.col(text)) != "")
    part = F.struct(F.col(page).alias("page"), F.concat(F.lit("<!-- page:"), F.col(page).cast("string"), F.lit(" -->\n"), F.col(text)).alias("text"))
    out = kept.groupBy(*keys).agg(F.array_sort(F.collect_list(part)).alias("parts"))
    return out.select(*keys, F.array_join("parts.text", "\n\n").alias("markdown"), F.size("parts").alias("pages"))


def page_texts(pages: DataFrame, mentions: DataFrame, keys: list[str]) -> DataFrame:
    """pages(keys, text), mentions(keys, context) -> (keys, text): the pages, and where a page has none its distinct contexts."""
    spoken = mentions.where("context is not null").groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_set("context")), " ... ").alias("contexts"))
    return pages.join(spoken, keys, "full").select(*keys, F.coalesce("text", "contexts").alias("text"), F.col("text").isNull().alias("from_mentions"))
