"""The flagship query: a question answered from graph nodes and passages, fused, ranked and cited."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.operators import fusion, retrieval
from docmill.plans import graph_queries
from docmill.session import table


def hybrid_search(spark: SparkSession, sf_dir: str, k: int = 20) -> DataFrame:
    """(name, confidence_level, passages, final_score, citation) of the k best results."""
    nodes, passages, _ = graph_queries._answer_inputs(spark, sf_dir)
    fused = fusion.fuse(nodes, passages).orderBy(*fusion.order_by_level()).limit(k)
    page = F.when(~F.isnan(F.col("page_number").cast("double")), F.col("page_number").cast("int"))
    cited = table(spark, sf_dir, "passages").select(F.concat(F.lit("passage_"), F.col("passage_id").cast("string")).alias("name"), retrieval.citation(page, F.col("section_title"), F.col("source_pdf")).alias("citation"))
    return fused.join(cited, "name", "left").select("name", "confidence_level", "passages", F.round("final_score", 4).alias("final_score"), "citation")
