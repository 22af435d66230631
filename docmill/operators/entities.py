"""Mentions of entities: de-duplication, validation and pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docmill.functions import text as T

#: Names that are noise.
NOISE = ["the", "and", "or", "of", "in", "at", "to", "for", "by", "with", "vs", "v", "re", "ex", "per", "viz", "etc", "ibid", "id", "hon", "honble", "ld", "sr", "jr", "dr", "mr", "mrs", "ms", "iii", "ii", "iv", "vi", "vii", "viii", "i", "a", "an"]
#: Types between which relations are sought.
MEANINGFUL = ["Person", "Organization", "Court", "StatutoryBody", "FinancialInstitution", "Asset", "LegalProceeding", "Demand", "Agreement", "Transaction", "Government", "Regulation", "Event"]
#: Labels of the graph.
LABELS = [*MEANINGFUL, "Date", "Amount", "Identifier", "Location", "Entity"]
#: Recognised labels and their types; others are Entity.
LABEL_TYPES = {
    "Person": "Person", "Organization": "Organization", "Government Body": "Government", "Court": "Court", "Statutory Authority": "StatutoryBody", "Financial Institution": "FinancialInstitution", "Asset": "Asset", "Property": "Asset", "Agreement": "Agreement", "Contract": "Agreement", "Demand Notice": "Demand",
    "Legal Proceeding": "LegalProceeding", "Writ Petition": "LegalProceeding", "Appeal": "LegalProceeding", "Court Order": "LegalProceeding", "Transaction": "Transaction", "Loan": "Transaction", "Mortgage": "Transaction", "Auction": "Event", "Payment": "Transaction", "Financial Charge": "Demand", "Regulation": "Regulation",
    "Act": "Regulation", "Legal Section": "Regulation", "Government Resolution": "Regulation", "Policy": "Regulation", "Date": "Date", "Amount": "Amount", "Case Number": "Identifier", "Document Reference": "Identifier", "Location": "Location", "Address": "Location",
}


def schema_type(label: Column) -> Column:
    out = F.lit("Entity")
    for name, kind in LABEL_TYPES.items():
        out = F.when(label == name, kind).otherwise(out)
    return out


def graph_label(kind: Column) -> Column:
    return F.when(kind.isin(LABELS), kind).otherwise("Entity")


def latest(df: DataFrame, key: str, order: str) -> DataFrame:
    """Rows delivered again count once: the latest of each key, as one combining aggregate."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("r")).select(key, "r.*")


def first_best(df: DataFrame, keys: list[str], confidence: str, order: str) -> DataFrame:
    """The most confident row of each key, the earliest among equals."""
    rank = F.struct((-F.coalesce(F.col(confidence), F.lit(0.0))).alias("a"), F.col(order).alias("b"))
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), rank).alias("r")).select(*keys, "r.*")


#: What the shapes ask of each type; counts are at least one, numbers between the limits.
SHAPES = {
    "Person": (["canonical_name", "source_pdf", "source_page", "confidence"], (0.0, 1.0)), "Organization": (["canonical_name", "source_pdf", "source_page", "confidence"], (0.0, 1.0)), "Court": (["canonical_name", "source_pdf"], None),
    "LegalProceeding": (["canonical_name", "source_pdf", "source_page"], None), "Demand": (["canonical_name", "source_pdf", "source_page"], None), "Transaction": (["canonical_name", "source_pdf"], None), "Asset": (["canonical_name", "source_pdf"], None),
}


def violations(kind: Column, values: dict[str, Column]) -> Column:
    """array<string>: the constraints of its type's shape that a mention violates, in order; types without a shape violate none."""
    out = F.array().cast("array<string>")
    for name, (needed, limits) in SHAPES.items():
        broken = [F.when(values[c].isNull(), f"{c} missing") for c in needed]
        if limits:
            broken.append(F.when((values["confidence"] < limits[0]) | (values["confidence"] > limits[1]), "confidence out of range"))
        out = F.when(kind == name, F.array_compact(F.array(*broken))).otherwise(out)
    return out


def validate_batch(mentions: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected with their reason)."""
    rows = mentions.withColumn("reason", reason)
    return rows.where("reason is null").drop("reason"), rows.where("reason is not null")


def rejection(name: Column, confidence: Column, page: Column, file: Column, kind: Column | None = None) -> Column:
    """Why a mention is rejected: the first rule that fails, else null.

    The last rule is what the shapes add: of a type with limits, where the type is given.
    """
    limited = F.lit(True) if kind is None else F.coalesce(kind.isin([k for k, (_, limits) in SHAPES.items() if limits]), F.lit(False))
    n = T.strip(F.coalesce(name, F.lit("")))
    return (
        F.when(F.length(n) < 3, "name too short")
        .when(F.regexp_replace(n, "[., ]", "").rlike(r"^\p{N}+$"), "purely numeric")
        .when(F.lower(n).isin(NOISE), "noise word")
        .when(F.coalesce(confidence, F.lit(0.0)) < 0.5, "low confidence")
        .when(F.coalesce(page, F.lit(0)) == 0, "missing page")
        .when(F.coalesce(file, F.lit("")) == "", "missing file")
        .when(limited & (confidence > 1.0), "confidence above 1")
    )


def pairs(mentions: DataFrame, chunk: list[str], name: str, kind: str, order: str) -> DataFrame:
    """Unordered pairs of different names of one chunk, each once, in order of first mention.

    Names are reduced to their first mention of a chunk before the join, so that repeats of a
    name, however many, never multiply.
    """
    first = mentions.where(F.col(kind).isin(MEANINGFUL) & F.col(name).isNotNull()).groupBy(*chunk, name).agg(F.min(order).alias("seq"))
    a = first.select(*chunk, F.col(name).alias("name_a"), F.col("seq").alias("seq_a"))
    b = first.select(*chunk, F.col(name).alias("name_b"), F.col("seq").alias("seq_b"))
    return a.join(b, chunk).where((F.col("seq_a") < F.col("seq_b")) & (F.col("name_a") != F.col("name_b")))


def batches(pair_rows: DataFrame, chunk: list[str], size: int = 10) -> DataFrame:
    w = Window.partitionBy(*chunk).orderBy("seq_a", "seq_b")
    place = F.row_number().over(w) - 1
    return pair_rows.withColumn("batch_no", F.floor(place / size)).withColumn("pair_id", (place % size).cast("int"))


def shared_sentences(text: Column, a: Column, b: Column, k: int = 4) -> Column:
    """Sentences that hold either name up to the first with both, that one with its neighbours, k at most."""
    s = F.split(text, r"(?<=[.!?])\s+")
    low_a, low_b = F.lower(a), F.lower(b)
    told = F.transform(s, lambda x: F.struct(x.alias("x"), F.contains(F.lower(x), low_a).alias("a"), F.contains(F.lower(x), low_b).alias("b")))
    both = F.array_position(F.transform(told, lambda h: h["a"] & h["b"]), F.lit(True)).cast("int")
    before = F.transform(F.filter(F.slice(told, 1, F.when(both > 0, both - 1).otherwise(F.size(s))), lambda h: h["a"] | h["b"]), lambda h: h["x"])
    around = F.when(both > 0, F.slice(s, F.greatest(F.lit(1), both - 1), F.when(both > 1, 3).otherwise(2))).otherwise(F.array().cast("array<string>"))
    found = F.slice(F.concat(before, around), 1, k)
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.substring(text, 1, 300)))
