"""Entity resolution: groups of similar names, votes, decisions and the registry."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.operators.components import connected_components

SIMILAR, AUTO_MERGE, AUTO_KEEP, COMPLEX = 0.65, 0.85, 0.35, 3
REGISTRY_AUTO, REGISTRY_REVIEW = 0.85, 0.60


def clusters(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component) of the vertices that are linked to another; singletons drop out."""
    return connected_components(edges.select("a", "b")).join(vertices.select("id"), "id", "left_semi")


def pick_canonical(rows: DataFrame, keys: list[str], name: str, confidence: str, order: str) -> DataFrame:
    """The shortest name of a group, then the most confident, then the first; groups above COMPLEX are complex."""
    rank = F.struct(F.length(name).alias("a"), (-F.coalesce(F.col(confidence), F.lit(0.0))).alias("b"), F.col(order).alias("c"))
    return rows.groupBy(*keys).agg(F.min_by(name, rank).alias("canonical"), F.count("*").alias("size")).withColumn("is_complex", F.col("size") > COMPLEX)


def decide(votes: DataFrame, keys: list[str]) -> DataFrame:
    """votes(keys, vote, confidence) -> AUTO_MERGE, AUTO_KEEP or NEEDS_REVIEW for each group."""
    yes, conf = F.coalesce(F.col("vote") == "YES", F.lit(False)), F.coalesce(F.col("confidence"), F.lit(0.0))
    no = F.coalesce(F.col("vote") == "NO", F.lit(False))
    out = votes.groupBy(*keys).agg(F.bool_and(yes & (conf >= AUTO_MERGE)).alias("merge"), F.bool_and(no & (conf < AUTO_KEEP)).alias("keep"))
    return out.select(*keys, F.when(F.col("merge"), "AUTO_MERGE").when(F.col("keep"), "AUTO_KEEP").otherwise("NEEDS_REVIEW").alias("resolution"))


def registry(rows: DataFrame) -> DataFrame:
    """rows(case_id, canonical_name, alias, file, decided_at, seq) -> the registry, the last decision wins."""
    key = F.regexp_replace(F.lower("canonical_name"), " ", "_")
    named = rows.where("canonical_name is not null and trim(canonical_name) <> ''").withColumn("key", key)
    return named.groupBy("case_id", "key").agg(
        F.max_by("canonical_name", F.struct("decided_at", "seq")).alias("canonical_name"), F.array_sort(F.collect_set("alias")).alias("aliases"), F.array_sort(F.collect_set("file")).alias("source_docs"), F.max("decided_at").alias("confirmed_at"),
    )


def _ratio(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        scores, last, matcher = [], None, SequenceMatcher(autojunk=True)
        for name, entry in zip(batch["name"], batch["entry"], strict=True):
            if entry != last:
                matcher.set_seq2(entry)
                last = entry
            matcher.set_seq1(name)
            near = matcher.quick_ratio() >= REGISTRY_REVIEW
            scores.append(round(matcher.ratio(), 4) if near else 0.0)
        yield batch.assign(score=scores)


def match_registry(mentions: DataFrame, entries: DataFrame) -> DataFrame:
    """mentions(name, block), entries(block, seq, entry) -> (name, block, best, score, status).

    Exact hits are an equi-join; each other distinct name is compared by the sequence ratio with
    the entries of its own block (a case) whose length and characters allow a ratio worth a
    review, one pair a row, the best of a name by a combining aggregate.  Below that a name has no
    best entry and the score 0.  Of equal scores the entry with the smaller seq is taken.
    """
    names = mentions.where("trim(name) <> ''").select("name", "block").distinct()
    exact = names.join(entries.select("block", F.col("entry").alias("name")).distinct(), ["block", "name"], "left_semi").select("name", "block", F.col("name").alias("best"), F.lit(1.0).alias("score"))
    rest = names.join(exact.select("name", "block"), ["name", "block"], "left_anti")
    known = entries.where("entry <> ''").groupBy("block", "entry").agg(F.min("seq").alias("seq"))
    n, m = F.length("name"), F.length("entry")
    letters = lambda c: F.array_distinct(F.split(c, ""))
    common = F.size(F.array_intersect(letters("name"), letters("entry")))
    pairs = rest.join(known, "block").where((2 * F.least(n, m) >= REGISTRY_REVIEW * (n + m)) & (common > 0)).select("name", "block", "entry", "seq")
    kind = dict(pairs.dtypes)
    scored = pairs.mapInPandas(_ratio, f"name string, block {kind['block']}, entry string, seq {kind['seq']}, score double").where(F.col("score") >= REGISTRY_REVIEW)
    found = scored.groupBy("name", "block").agg(F.min(F.struct((-F.col("score")).alias("lower"), "seq", "entry")).alias("r")).select("name", "block", F.col("r.entry").alias("best"), (-F.col("r.lower")).alias("score"))
    rated = rest.join(found, ["name", "block"], "left").select("name", "block", "best", F.coalesce("score", F.lit(0.0)).alias("score"))
    status = F.when(F.col("score") >= REGISTRY_AUTO, "AUTO").when(F.col("score") >= REGISTRY_REVIEW, "REVIEW").otherwise("NEW")
    return exact.unionByName(rated).withColumn("status", status)


def unmatched(mentions: DataFrame, entries: DataFrame) -> DataFrame:
    """The mentions whose name the registry does not settle by itself."""
    sure = match_registry(mentions, entries).where("status = 'AUTO'").select("name", "block")
    return mentions.join(sure, ["name", "block"], "left_anti")


def llm_merge(yes: Column, total: Column) -> Column:
    """More than half of the votes; without votes no merge."""
    return yes * 2 > total
