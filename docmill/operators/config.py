"""Configuration of domains: a table of lists by domain, the common domain first.

The lists themselves are data: JSON files of a folder, one for each domain, or any table with
the same columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

COMMON = "universal"
LISTS = ["labels", "vocabulary", "headings", "examples"]
SCHEMA = "domain_id string, name string, " + ", ".join(f"{c} array<string>" for c in LISTS)


def read_domains(spark: SparkSession, folder: str) -> DataFrame:
    """One JSON object a file; unreadable files drop out."""
    return spark.read.schema(SCHEMA).option("multiLine", "true").option("mode", "DROPMALFORMED").json(folder).where("domain_id is not null")


def merge_unique(first: Column, second: Column) -> Column:
    """Both lists in order, each value at its first place."""
    empty = F.array().cast("array<string>")
    return F.array_distinct(F.concat(F.coalesce(first, empty), F.coalesce(second, empty)))


def domain_of(cases: DataFrame, domains: DataFrame) -> DataFrame:
    """cases(case_id, domain), domains(SCHEMA) -> (case_id, domain_id, known, lists): the common lists and those of the domain.

    A missing or unknown domain is the common one; examples keep their repeats.  The domains are
    a handful of rows.
    """
    common = domains.where(F.col("domain_id") == COMMON).select(*[F.col(c).alias(f"common_{c}") for c in LISTS])
    own = domains.where(F.col("domain_id") != COMMON).select(F.col("domain_id").alias("domain"), *LISTS)
    joined = cases.select("case_id", "domain").join(F.broadcast(own.withColumn("hit", F.lit(True))), "domain", "left").crossJoin(F.broadcast(common))
    known = F.coalesce("hit", F.lit(False)) | F.coalesce(F.col("domain") == COMMON, F.lit(False))
    lists = [merge_unique(F.col(f"common_{c}"), F.col(c)).alias(c) for c in LISTS if c != "examples"]
    examples = F.concat(F.coalesce("common_examples", F.array().cast("array<string>")), F.coalesce("examples", F.array().cast("array<string>"))).alias("examples")
    return joined.select("case_id", F.when(F.col("hit"), F.col("domain")).otherwise(COMMON).alias("domain_id"), known.alias("known"), *lists, examples)


def list_domains(domains: DataFrame) -> DataFrame:
    return domains.where(F.col("domain_id") != COMMON).select("domain_id", "name").orderBy("name")
