"""Passage retrieval: postings, BM25 and the evidence shown with a passage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docmill.functions import text as T

K1, B, EPSILON = 1.5, 0.75, 0.25


def postings(passages: DataFrame, key: str, text: str) -> DataFrame:
    """(key, token, tf): counts combine before the shuffle."""
    return passages.select(key, F.explode(T.search_tokens(F.col(text))).alias("token")).groupBy(key, "token").agg(F.count("*").alias("tf"))


def lengths(passages: DataFrame, key: str, text: str) -> DataFrame:
    """(key, dl); passages without a token count with 0."""
    return passages.select(key, F.size(T.search_tokens(F.col(text))).alias("dl"))


def score(passages: DataFrame, key: str, text: str, question: list[str]) -> DataFrame:
    """(key, score) of passages that hold a token of the question; repeats in it count again.

    Weights below zero become EPSILON times the mean weight of the vocabulary.  The question is a
    handful of rows; the statistics are one row.
    """
    spark = passages.sparkSession
    post = postings(passages, key, text)
    stats = lengths(passages, key, text).agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    df = post.groupBy("token").agg(F.count("*").alias("df")).crossJoin(F.broadcast(stats.select("n")))
    raw = df.select("token", (F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("idf0"))
    floor = raw.agg((EPSILON * F.avg("idf0")).alias("floor"))
    asked = spark.createDataFrame([(t, question.count(t)) for t in dict.fromkeys(question)] or [("", 0)], "token string, times int")
    wanted = F.broadcast(raw.join(F.broadcast(asked), "token").crossJoin(F.broadcast(floor)).select("token", "times", F.when(F.col("idf0") < 0, F.col("floor")).otherwise(F.col("idf0")).alias("idf")))
    hit = post.join(wanted, "token").join(lengths(passages, key, text), key).crossJoin(F.broadcast(stats))
    part = F.col("times") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return hit.groupBy(key).agg(F.sum(part).alias("score"))


def top(scored: DataFrame, key: str, k: int) -> DataFrame:
    return scored.where("score > 0").orderBy(F.desc("score"), key).limit(k)


def matched_terms(text: Column, question: list[str]) -> Column:
    low = F.lower(text)
    return F.filter(F.array(*[F.lit(t) for t in question]), lambda t: F.contains(low, t))


def relevant_lines(text: Column, question: list[str], k: int = 5) -> Column:
    """The k lines that hold most tokens of the question, ties by text from the last."""
    rows = F.filter(F.transform(T.lines(text), T.strip), lambda x: x != "")
    scored = F.transform(rows, lambda x: F.struct(sum(F.contains(F.lower(x), F.lit(t)).cast("int") for t in question).alias("hits"), x.alias("line")))
    return F.transform(F.filter(F.slice(F.reverse(F.array_sort(scored)), 1, k), lambda s: s["hits"] > 0), lambda s: s["line"])


def citation(page: Column, section: Column, file: Column) -> Column:
    return F.concat_ws(", ", F.concat(F.lit("Page "), page.cast("string")), F.when(section != "", F.concat(F.lit("Section: "), section)), file)


def best_per(df: DataFrame, keys: list[str], order: list[Column], k: int = 1) -> DataFrame:
    """The first k rows of each key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= k).drop("_n")
