"""What is kept between runs: JSON exports of trees and extractions, and the postings of the passage index."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.operators import retrieval

TREE = "case_id string, doc_id string, nodes array<struct<node_id:string,parent_id:string,level:int,page_num:int,title:string,content:string>>"
EXTRACTION = "source_pdf string, total_entities long, entities array<struct<text:string,canonical_name:string,schema_type:string,confidence:double,source_page:int>>"


def write_json(rows: DataFrame, path: str, by: list[str] | None = None) -> None:
    """JSON lines; with by a folder for each value."""
    writer = rows.write.mode("overwrite").option("ignoreNullFields", "false")
    (writer.partitionBy(*by) if by else writer).json(path)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """With a schema nothing is read to infer one; broken records drop out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def trees(nodes: DataFrame) -> DataFrame:
    """nodes -> TREE: the nodes of each document in order."""
    part = F.struct("ordinal", "node_id", "parent_id", "level", "page_num", "title", "content")
    names = ("node_id", "parent_id", "level", "page_num", "title", "content")
    return nodes.groupBy("case_id", "doc_id").agg(F.transform(F.array_sort(F.collect_list(part)), lambda s: F.struct(*[s[c].alias(c) for c in names])).alias("nodes"))


def node_map(trees_: DataFrame) -> DataFrame:
    """TREE -> a row for each node, found by case, document and node id."""
    return trees_.select("case_id", "doc_id", F.inline("nodes"))


def write_index(passages: DataFrame, key: str, text: str, path: str) -> None:
    """Postings by token in files of their own hash range, lengths and statistics beside them.

    The text is tokenised once; a search reads the files of its tokens.
    """
    words = passages.select(key, F.posexplode_outer(retrieval.T.search_tokens(F.col(text))).alias("at", "token"))
    counted = words.groupBy(key, "token").agg(F.count("token").alias("tf"))
    counted.write.mode("overwrite").parquet(f"{path}/counts")
    counts = passages.sparkSession.read.parquet(f"{path}/counts")
    counts.groupBy(key).agg(F.sum("tf").alias("dl")).write.mode("overwrite").parquet(f"{path}/lengths")
    counts.where("token is not null").repartitionByRange("token").sortWithinPartitions("token").write.mode("overwrite").parquet(f"{path}/postings")
    df = counts.where("token is not null").groupBy("token").agg(F.count("*").alias("df"))
    df.write.mode("overwrite").parquet(f"{path}/vocabulary")


def search_index(spark: SparkSession, path: str, key: str, question: list[str]) -> DataFrame:
    """(key, score) by BM25 from the stored index; only the question's tokens are read from the postings."""
    postings, lengths, vocabulary = (spark.read.parquet(f"{path}/{x}") for x in ("postings", "lengths", "vocabulary"))
    stats = lengths.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    raw = vocabulary.crossJoin(F.broadcast(stats.select("n"))).select("token", (F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("idf0"))
    floor = raw.agg((retrieval.EPSILON * F.avg("idf0")).alias("floor"))
    times = reduce(lambda c, t: c.when(F.col("token") == t, question.count(t)), dict.fromkeys(question), F.when(F.lit(False), 0))
    asked = F.col("token").isin(list(dict.fromkeys(question)))
    wanted = F.broadcast(raw.where(asked).crossJoin(F.broadcast(floor)).select("token", times.alias("times"), F.when(F.col("idf0") < 0, F.col("floor")).otherwise(F.col("idf0")).alias("idf")))
    hit = postings.where(asked).join(wanted, "token").join(lengths, key).crossJoin(F.broadcast(stats))
    k1, b = retrieval.K1, retrieval.B
    part = F.col("times") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return hit.groupBy(key).agg(F.sum(part).alias("score"))
