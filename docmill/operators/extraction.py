"""Extraction: the offline recogniser, parsed replies of a relation model, dates and lines.

A recogniser gives (text, label, score); the offline default finds what a pattern can tell and
marks its rows with its name.  Another one is any function from a text column to such an array.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.functions import text as T

PROVIDER = "rules"
THRESHOLD, RELATION_THRESHOLD = 0.5, 0.70
DATE = r"\d{1,2} (?:January|February|March|April|May|June|July|August|September|October|November|December) \d{4}|(?:January|February|March|April|May|June|July|August|September|October|November|December) \d{1,2}, \d{4}|\d{1,2}[./]\d{1,2}[./]\d{4}"
#: What the offline recogniser looks for, by label, and its score.
RULES = {
    "Date": (DATE, 0.9),
    "Amount": (r"(?:Rs\. ?|INR ?|EUR ?|₹ ?)\d[\d,]*(?:\.\d+)?(?: (?:lakh|crore))?", 0.9),
    "Case Number": (r"(?:WP|O\.A\. No\.) ?/?\d+/\d{4}|Civil Appeal No\. \d+ of \d{4}|Diary No\. \d+", 0.85),
    "Organization": (r"(?:[A-Z][a-z]+ )+(?:Private Limited|Limited|LLP|Brothers|& Sons)", 0.8),
    "Court": (r"High Court of [A-Z][a-z]+|(?:[A-Z][a-z]+ )+(?:Tribunal|Court|Bench), [A-Z][a-z]+", 0.8),
}


def recognise(text: Column) -> Column:
    """array<struct<text, label, score>> by rule, in order of the rules."""

    def by(label: str, pattern: str, score: float) -> Column:
        found = F.coalesce(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.array().cast("array<string>"))
        return F.transform(found, lambda t: F.struct(t.alias("text"), F.lit(label).alias("label"), F.lit(score).alias("score")))

    return F.concat(*[by(label, pattern, score) for label, (pattern, score) in RULES.items()])


def mentions(chunks: DataFrame, key: list[str], text: str, recogniser: Callable[[Column], Column] = recognise, threshold: float = THRESHOLD) -> DataFrame:
    """(key, text, label, score, context, provider) of each mention above the threshold."""
    rows = chunks.select(*key, F.col(text).alias("_chunk"), F.explode(recogniser(F.col(text))).alias("m"))
    rows = rows.select(*key, "_chunk", "m.*").where((F.col("score") >= threshold) & (F.length("text") >= 2))
    return rows.select(*key, "text", "label", F.round("score", 4).alias("score"), T.snippet(F.col("_chunk"), F.instr("_chunk", F.col("text")), F.length("text")).alias("context"), F.lit(PROVIDER).alias("provider"))


REPLY = "array<struct<pair_id:int,relationship:string,direction:string,confidence:double,evidence:string>>"


#: Names of relations that a model may give, by category.
RELATIONS = {
    "Legal proceedings": ["PETITIONS_AGAINST", "FILED_BY", "CHALLENGED_BY", "ORDERED_BY", "GOVERNED_BY", "REPRESENTED_BY", "APPOINTED_BY", "PARTY_TO"],
    "Ownership and transfer": ["LEASED_TO", "TRANSFERRED_TO", "ALLOTTED_TO", "SUBLET_TO", "OWNED_BY", "MORTGAGED_WITH", "AUCTIONED_BY", "SOLD_TO"],
    "Financial": ["DEMANDED_FROM", "ISSUED_TO", "PAID_BY", "LOANED_TO", "ISSUED_LOAN_TO", "GUARANTEED_BY", "SECURED_BY"],
    "Corporate": ["SUBSIDIARY_OF", "DIRECTOR_OF", "PARTNER_OF", "MEMBER_OF", "MANAGED_BY"],
    "General": ["LOCATED_AT", "REFERENCED_IN", "RELATED_TO"],
}


def relation_prompt(pairs: Column) -> Column:
    """The request for one batch: what may be answered, then array<struct<pair_id, name_a, name_b, ...>> as numbered pairs."""
    known = "\n".join(f"{k}: {', '.join(v)}" for k, v in RELATIONS.items())
    listed = F.array_join(F.transform(pairs, lambda p: F.concat(p["pair_id"].cast("string"), F.lit(". "), p["name_a"], F.lit(" | "), p["name_b"])), "\n")
    return F.concat(F.lit(f"Relations:\n{known}\n\nPairs:\n"), listed)


def rule_replies(pairs: Column) -> Column:
    """The offline provider of relations: what the types of two names allow, as the JSON of a reply.

    pairs is array<struct<pair_id, name_a, name_b, kind_a, kind_b, confidence>>.  A court orders, a
    person is a member, organizations are partners; other pairs have no relation.
    """

    def one(p: Column) -> Column:
        court_a, court_b = p["kind_a"] == "Court", p["kind_b"] == "Court"
        member = (p["kind_a"] == "Person") & (p["kind_b"] == "Organization")
        firms = (p["kind_a"] == "Organization") & (p["kind_b"] == "Organization")
        rel = F.when(court_a != court_b, "ORDERED_BY").when(member, "MEMBER_OF").when(firms, "PARTNER_OF")
        return F.struct(p["pair_id"].alias("pair_id"), rel.alias("relationship"), F.when(court_a, "B_TO_A").otherwise("A_TO_B").alias("direction"), p["confidence"].alias("confidence"), F.lit("").alias("evidence"))

    return F.to_json(F.transform(pairs, one))


def ask(pairs: DataFrame, batch: list[str], provider: Callable[[Column], Column] = rule_replies) -> DataFrame:
    """pairs(batch, pair_id, name_a, name_b, ...) -> (batch, prompt, reply), one row for each batch.

    Batches are answered independently where they are; a provider that fails gives a null reply.
    """
    rest = [c for c in pairs.columns if c not in (*batch, "pair_id")]
    rows = pairs.groupBy(*batch).agg(F.array_sort(F.collect_list(F.struct("pair_id", *rest))).alias("pairs"))  # as many as a batch holds
    return rows.select(*batch, relation_prompt(F.col("pairs")).alias("prompt"), provider(F.col("pairs")).alias("reply"))


def parse_relations(replies: DataFrame, pairs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """replies(batch_no, reply json), pairs(batch_no, pair_id, name_a, name_b) -> relations.

    Replies that are no JSON, pairs that were not asked, nulls and low confidences drop out;
    B_TO_A turns the pair round.
    """
    said = replies.select("batch_no", F.inline(F.from_json("reply", REPLY))).where(f"relationship is not null and confidence >= {RELATION_THRESHOLD}")
    back = F.col("direction") == "B_TO_A"
    return said.join(pairs, ["batch_no", "pair_id"]).select(
        *keep,
        F.when(back, F.col("name_b")).otherwise(F.col("name_a")).alias("src"), T.relation_type(F.col("relationship")).alias("rel"), F.when(back, F.col("name_a")).otherwise(F.col("name_b")).alias("dst"), F.round("confidence", 4).alias("confidence"), F.substring("evidence", 1, 200).alias("evidence"),
    )


def document_date(text: Column, words: int = 500) -> Column:
    """The first date among the first words, or 'Date unknown'."""
    found = F.regexp_extract(F.array_join(F.slice(T.words(text), 1, words), " "), DATE, 0)
    return F.when(found != "", found).otherwise("Date unknown")


def context_line(context: Column) -> Column:
    """Line of the end of a context: its line breaks plus one."""
    return F.regexp_count(F.coalesce(context, F.lit("")), F.lit("\n")) + 1
