"""Problem 4: one surviving record for each group of duplicates.

Method: token-level consensus.  The distinct names of a group are aligned one after the other to
the columns of its heaviest name (the guide of the progressive alignment); every column votes
with the weights of its tokens; the name that the group already has and that is closest to the
voted sequence survives.  File, page, line and context are columns of one token each and are
voted the same way.  Completeness, confidence and recency are ordinal columns: who has more
outvotes who has less.  The surviving row is the existing one closest to the whole voted record:
fewest ordinal columns in which it falls short, then fewest fields that differ, then the least
edit distance to the consensus name.

Skew: the guide is fixed before the alignment, so each value finds its columns without any other
and votes are sums, combined before the shuffle.  A group of any size is spread over all tasks,
and its result depends neither on other groups nor on how its rows are spread; weights are whole
numbers, so sums do not depend on their order.

Defined cases: null, blank and filler texts count as missing, and so do numbers below 1 and
confidences that are null, NaN or negative; confidences above 1 are percentages.  Rows without
group or case id belong to no group.  Groups whose values are all missing survive with null
fields.  Ties go to the later supporter, then the smaller value, and among rows to the smallest
candidate_id.  Empty input gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.session import materialize

#: How a missing text is written out.
FILLERS = ["-", "--", "---", "?", "n/a", "na", "n.a.", "nil", "null", "none", "nan", "unknown", "not stated", "not known", "not available", "not recorded", "(illegible)", "illegible", "tbd", "tba", "."]

#: Votes are counted in parts of this.
UNIT = 1_000_000
#: What the alignment pays for a pair of unlike tokens that begin alike, any pair, and a gap.
ALIKE, PAIR, GAP = 0.4, -0.1, -0.25

#: Tokens of a value; canonical names join theirs with an underscore.
SEPARATOR = re.compile(r"[\s_]+")


def squeezed(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def usable_text(text: Column) -> Column:
    """The text trimmed, or null where it says nothing."""
    t = squeezed(text)
    return F.when((t != "") & ~F.lower(t).isin(FILLERS), t)


def usable_number(number: Column) -> Column:
    """Double columns arrive where a table holds nulls; NaN is missing too."""
    n = number.cast("double")
    return F.when(~F.isnan(n) & (n >= 1), n.cast("long"))


def scaled_confidence(confidence: Column) -> Column:
    c = confidence.cast("double")
    return F.when(F.isnan(c) | (c < 0), None).when(c > 1, c / 100).otherwise(c)


def columns(guide: list[str], tokens: list[str]) -> list[tuple[int, int]]:
    """The column of each token: (column of the guide, 0), or (column before it, k) where it stands between two."""
    n, m = len(guide), len(tokens)
    score = [[GAP * (i + j) if not i or not j else 0.0 for j in range(m + 1)] for i in range(n + 1)]
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            a, b = guide[i - 1], tokens[j - 1]
            pair = score[i - 1][j - 1] + (1.0 if a == b else ALIKE if a[:1] == b[:1] else 0.0) + PAIR
            score[i][j] = max(pair, score[i - 1][j] + GAP, score[i][j - 1] + GAP)
    out, i, j = [], n, m
    while j:
        a, b = guide[i - 1] if i else "", tokens[j - 1]
        if i and score[i][j] == score[i - 1][j - 1] + (1.0 if a == b else ALIKE if a[:1] == b[:1] else 0.0) + PAIR:
            i, j = i - 1, j - 1
            out.append((i, 0))
        elif i and score[i][j] == score[i - 1][j] + GAP:
            i -= 1
        else:
            j -= 1
            out.append((i - 1, 1))
    made: list[tuple[int, int]] = []
    for column, between in out[::-1]:
        made.append((column, made[-1][1] + 1 if between and made and made[-1][0] == column else between))
    return made


def _to_columns(keys: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, at = [], []
            for k, (guide, value, w) in enumerate(zip(batch["guide"], batch["value"], batch["w"], strict=True)):
                tokens = SEPARATOR.split(value)
                for (column, between), token in zip(columns(SEPARATOR.split(guide), tokens), tokens, strict=True):
                    at.append(k)
                    rows.append((column, between, token, w))
            votes = pd.DataFrame(rows, columns=["column", "between", "token", "w"])
            yield pd.concat([batch[keys].iloc[at].reset_index(drop=True), votes], axis=1)

    return run


def consensus(values: DataFrame, keys: list[str]) -> DataFrame:
    """values(keys, value, w) -> (keys, consensus, survivor, survivor_weight), one row per group.

    survivor is the group's own value with the least edit distance to the consensus; ties go to
    the heavier, then the smaller value.  Null and blank values carry no vote; w is a whole number.
    """
    value = F.regexp_replace(squeezed(F.col("value")), r"(?U)\s+", " ")
    distinct = materialize(values.select(*keys, value.alias("value"), F.col("w").cast("long").alias("w")).where("value <> ''").groupBy(*keys, "value").agg(F.sum("w").alias("w")))
    guides = distinct.groupBy(*keys).agg(F.min(F.struct((-F.col("w")).alias("lighter"), "value"))["value"].alias("guide"), F.sum("w").alias("all"))
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in distinct.schema.fields if f.name in keys)
    voted = distinct.join(guides.drop("all"), keys).mapInPandas(_to_columns(keys), f"{kind}, column int, between int, token string, w long")
    slot = [*keys, "column", "between"]
    tokens = voted.groupBy(*slot, "token").agg(F.sum("w").alias("w"))
    best = tokens.groupBy(*slot).agg(F.sum("w").alias("some"), F.max(F.struct("w", "token")).alias("best"))
    won = best.join(guides.drop("guide"), keys).where(F.col("best.w") > F.col("all") - F.col("some"))  # else most leave the column out
    lines = won.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("column", "between", F.col("best.token").alias("token")))).alias("line"))
    agreed = lines.select(*keys, F.array_join("line.token", " ").alias("consensus"))
    far = F.levenshtein(F.translate("value", "_", " "), F.coalesce("consensus", F.lit("")))
    rank = F.struct(far.alias("far"), (-F.col("w")).alias("lighter"), F.col("value").alias("value"))
    out = distinct.join(agreed, keys, "left").groupBy(*keys).agg(F.max("consensus").alias("consensus"), F.min(rank).alias("best"))
    return out.select(*keys, "consensus", F.col("best.value").alias("survivor"), (-F.col("best.lighter")).alias("survivor_weight"))


FIELDS = ["pdf", "page", "line", "context"]


def survivors(candidates: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """One row per group of candidates with the surviving record.

    canonical_name is the group's own name closest to the consensus of its usable names;
    source_pdf, source_page, source_line and context are the values with the most votes;
    confidence and extracted_at are the greatest.  candidate_id is the existing row closest to
    this record and dominates says whether it falls short of it in none of the ordinal columns:
    number of usable values, confidence, extracted_at.  Rows that fall short in none are equals
    and stand as one under their smallest candidate_id.  Groups listed without any candidate
    keep their row with null fields.
    """
    keys = ["case_id", "group_id"]
    rows = candidates.where("case_id is not null and group_id is not null").select(
        *keys, "candidate_id",
        usable_text(F.col("canonical_name")).alias("name"), usable_text(F.col("source_pdf")).alias("pdf"), usable_text(F.col("context")).alias("context"),
        usable_number(F.col("source_page")).cast("string").alias("page"), usable_number(F.col("source_line")).cast("string").alias("line"),
        F.coalesce(scaled_confidence(F.col("confidence")), F.lit(-1.0)).alias("conf"), F.coalesce(F.col("extracted_at"), F.lit("0001-01-01").cast("timestamp")).alias("at"),
    )
    usable = sum(F.col(c).isNotNull().cast("int") for c in ("name", *FIELDS))
    rows = rows.withColumn("usable", usable)
    rows = materialize(rows.withColumn("w", F.round(UNIT * (F.greatest(F.col("conf"), F.lit(0.0)) + 0.05 * F.col("usable") + 0.05)).cast("long")))
    cells = rows.select(*keys, "w", "at", F.inline(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in FIELDS]))).where("value is not null")
    votes = cells.groupBy(*keys, "field", "value").agg(F.sum("w").alias("w"), F.max("at").alias("at"))
    order = F.struct((-F.col("w")).alias("lighter"), (-F.unix_micros("at")).alias("older"), "value")
    fields = votes.groupBy(*keys).agg(*[F.min(F.when(F.col("field") == c, order))["value"].alias(f"voted_{c}") for c in FIELDS])
    levels = rows.groupBy(*keys).agg(F.count("*").alias("n_rows"), F.count("name").alias("n_names"), *[F.max(c).alias(f"most_{c}") for c in ("usable", "conf", "at")])
    agreed = consensus(rows.select(*keys, F.col("name").alias("value"), "w").where("value is not null"), keys)
    record = levels.join(fields, keys, "left").join(agreed, keys, "left")
    short = sum((F.col(c) < F.col(f"most_{c}")).cast("int") for c in ("usable", "conf", "at"))
    unlike = sum((~F.col(c).eqNullSafe(F.col(f"voted_{c}"))).cast("int") for c in FIELDS)
    far = F.levenshtein(F.translate(F.coalesce("name", F.lit("")), "_", " "), F.coalesce("consensus", F.lit("")))
    near = F.when(short > 0, F.struct(unlike.alias("unlike"), far.alias("far")))  # rows short in nothing are equals
    nearest = rows.join(record.select(*keys, *[f"most_{c}" for c in ("usable", "conf", "at")], *[f"voted_{c}" for c in FIELDS], "consensus"), keys)
    nearest = nearest.groupBy(*keys).agg(F.min(F.struct(short.alias("short"), near.alias("near"), "candidate_id")).alias("best"))
    floor = F.lit("0001-01-01").cast("timestamp")
    out = record.join(nearest, keys).select(
        *keys, "n_rows", "n_names", F.col("best.candidate_id").alias("candidate_id"), F.col("survivor").alias("canonical_name"), "consensus",
        F.col("voted_pdf").alias("source_pdf"), F.col("voted_page").cast("long").alias("source_page"), F.col("voted_line").cast("long").alias("source_line"), F.col("voted_context").alias("context"),
        F.when(F.col("most_conf") >= 0, F.col("most_conf")).alias("confidence"), F.when(F.col("most_at") > floor, F.col("most_at")).alias("extracted_at"),
        (F.col("best.short") == 0).alias("dominates"),
    )
    if groups is not None:
        out = groups.where("case_id is not null and group_id is not null").select(*keys).distinct().join(out, keys, "left")
    return out
