"""Fusing graph nodes with passages into ranked, cited results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.functions import text as T

GRAPH, TREE = 0.6, 0.4
PART = 3


def name_parts(name: Column) -> Column:
    """Words of a name long enough to be looked for in a passage."""
    return F.filter(T.words(F.translate(F.lower(name), "_", " ")), lambda w: F.length(w) > PART)


def level(graph: Column, passages: Column) -> Column:
    return F.when(graph & passages, "HIGH").when(graph | passages, "MEDIUM").otherwise("LOW")


def fuse(nodes: DataFrame, passages: DataFrame) -> DataFrame:
    """nodes(name, graph_score), passages(key, page, score, text) -> one row for each node and unmatched passage.

    Both sides are top-k results, so their nested loop is bounded by the two limits; the smaller
    one is broadcast for that reason.  A name matches where any of its parts stands in the text.
    """
    low = passages.withColumn("low", F.lower("text"))
    parts = nodes.withColumn("parts", name_parts(F.col("name")))
    hit = parts.join(F.broadcast(low), F.exists("parts", lambda p: F.contains(F.col("low"), p)), "left")
    named = hit.groupBy("name", "graph_score").agg(F.coalesce(F.max("score"), F.lit(0.0)).alias("tree_score"), F.count("key").alias("passages"))
    used = hit.where("key is not null").select("key").distinct()
    alone = low.join(used, "key", "left_anti").select(F.concat(F.lit("passage_"), F.col("key").cast("string")).alias("name"), F.lit(0.0).alias("graph_score"), F.col("score").alias("tree_score"), F.lit(1).cast("long").alias("passages"))
    rows = named.withColumn("graph", F.lit(True)).unionByName(alone.withColumn("graph", F.lit(False)))
    return rows.withColumn("confidence_level", level(F.col("graph"), F.col("passages") > 0)).withColumn("final_score", GRAPH * F.col("graph_score") + TREE * F.col("tree_score")).drop("graph")


def order_by_level() -> list[Column]:
    rank = F.when(F.col("confidence_level") == "HIGH", 0).when(F.col("confidence_level") == "MEDIUM", 1).otherwise(2)
    return [rank, F.desc("final_score"), F.col("name")]


def fuse_pages(nodes: DataFrame, passages: DataFrame) -> DataFrame:
    """Like fuse, with page numbers: one row for each node and each page without a name, with its passages and citations.

    nodes(name, schema_type, graph_score), passages(key, page, score, text, citation, lines) are
    top-k results.  Passages of one page without a name share a row, of which the last one
    (lowest score, then greatest key) stays.
    """
    low = passages.withColumn("low", F.lower("text"))
    parts = nodes.withColumn("parts", name_parts(F.col("name")))
    hit = parts.join(F.broadcast(low), F.exists("parts", lambda p: F.contains(F.col("low"), p)), "left")
    part = F.struct((-F.col("score")).alias("lower"), "key", "score", "page", "citation", "lines", "text")
    found = F.array_sort(F.collect_list(F.when(F.col("key").isNotNull(), part)))
    named = hit.groupBy("name", "schema_type", "graph_score").agg(F.coalesce(F.max("score"), F.lit(0.0)).alias("tree_score"), found.alias("passages")).withColumn("graph", F.lit(True))
    alone = low.join(hit.where("key is not null").select("key").distinct(), "key", "left_anti")
    last = alone.groupBy("page").agg(F.max(part).alias("p"))
    pages = last.select(F.concat(F.lit("passage_p"), F.coalesce(F.col("page").cast("string"), F.lit("None"))).alias("name"), F.lit(None).cast("string").alias("schema_type"), F.lit(0.0).alias("graph_score"), F.col("p.score").alias("tree_score"), F.array("p").alias("passages"), F.lit(False).alias("graph"))
    return relevel(named.unionByName(pages))


def relevel(rows: DataFrame) -> DataFrame:
    rows = rows.withColumn("confidence_level", level(F.col("graph"), F.size("passages") > 0)).withColumn("final_score", GRAPH * F.col("graph_score") + TREE * F.col("tree_score"))
    return rows.withColumn("citations", F.array_distinct(F.transform("passages", lambda p: p["citation"])))


def merge_pages(old: DataFrame, new: DataFrame) -> DataFrame:
    """Two results of fuse_pages as one: the node of either, the higher scores, all passages (each once), citations, levels and scores anew."""
    rows = old.withColumn("o", F.lit(0)).unionByName(new.withColumn("o", F.lit(1)))
    out = rows.groupBy("name").agg(
        F.max("schema_type").alias("schema_type"), F.max("graph_score").alias("graph_score"), F.max("tree_score").alias("tree_score"), F.array_sort(F.flatten(F.collect_list("passages"))).alias("passages"), F.bool_or("graph").alias("graph"),
    )
    first = F.filter("passages", lambda p, i: ~F.exists(F.slice("passages", F.lit(1), i), lambda q: q["key"] == p["key"]))  # a passage of both questions under its better score
    return relevel(out.withColumn("passages", first))


def merge_triples(old: DataFrame, new: DataFrame) -> DataFrame:
    """Triples of both, each once; of equal ones the older keeps its other columns."""
    rest = [c for c in old.columns if c not in ("src", "rel", "dst")]
    rows = old.withColumn("o", F.lit(0)).unionByName(new.withColumn("o", F.lit(1)))
    return rows.groupBy("src", "rel", "dst").agg(*[F.min_by(c, F.struct("o", *rest)).alias(c) for c in rest]) if rest else rows.select("src", "rel", "dst").distinct()


def merge(old: DataFrame, new: DataFrame) -> DataFrame:
    """Two results of fuse as one: the higher scores, the greater number of passages, levels and scores anew.

    A row comes from the graph where either side is a name and no passage of its own.
    """
    rows = old.unionByName(new).groupBy("name").agg(F.max("graph_score").alias("graph_score"), F.max("tree_score").alias("tree_score"), F.max("passages").alias("passages"))
    return rows.withColumn("confidence_level", level(~F.startswith("name", F.lit("passage_")), F.col("passages") > 0)).withColumn("final_score", GRAPH * F.col("graph_score") + TREE * F.col("tree_score"))


def prompt_context(fused: DataFrame, triples: DataFrame, k: int = 20) -> DataFrame:
    """One row: the ranked results and triples as text."""
    top = fused.orderBy(*order_by_level()).limit(k)
    line = F.format_string("%s | %s | %.4f", "confidence_level", "name", "final_score")
    rank = F.when(F.col("confidence_level") == "HIGH", 0).when(F.col("confidence_level") == "MEDIUM", 1).otherwise(2)
    a = top.select(F.struct(rank.alias("r"), (-F.col("final_score")).alias("s"), line.alias("line")).alias("x")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n").alias("results"))
    t = triples.orderBy("src", "rel", "dst").limit(30).agg(F.array_join(F.array_sort(F.collect_list(F.format_string("(%s) -[%s]-> (%s)", "src", "rel", "dst"))), "\n").alias("triples"))
    return a.crossJoin(t).select(F.concat(F.lit("RESULTS\n"), "results", F.lit("\n\nTRIPLES\n"), "triples").alias("context"))


def strength(rel: Column) -> Column:
    from docmill.operators.graph import WEAK

    return F.when(rel.isin(WEAK), "weak / co-occurrence only").otherwise("typed")


def prompt_text(question: str, fused: DataFrame, triples: DataFrame, grounded: DataFrame, width: int | None = None) -> DataFrame:
    """One row (context): question, counts, at most 30 triples with their strength, the ranked results with three passages each, and what the passages ground.

    fused comes from fuse_pages, triples(src, rel, dst), grounded(src, rel, dst, citation) are
    bounded results; width cuts the text.
    """
    rank = F.when(F.col("confidence_level") == "HIGH", 0).when(F.col("confidence_level") == "MEDIUM", 1).otherwise(2)
    quoted = lambda p: F.array_join(F.transform(F.slice(F.coalesce(p["lines"], F.array().cast("array<string>")), 1, 5), lambda x: F.concat(F.lit('\n    "'), F.substring(x, 1, 200), F.lit('"'))), "")
    shown = F.array_join(F.transform(F.slice("passages", 1, 3), lambda p: F.concat(F.lit("\n  Document ["), F.coalesce(p["citation"], F.lit("")), F.lit("]:"), quoted(p), F.lit("\n  Page text:\n    "), F.substring(p["text"], 1, 800))), "")
    node = F.coalesce(F.format_string("\n  Graph: %s (score: %.2f)", F.col("schema_type"), "graph_score"), F.lit(""))
    line = F.concat(F.lit("\n["), "confidence_level", F.lit("] "), "name", F.when(F.col("graph"), node).otherwise(""), shown)
    ranked = fused.agg(
        F.count("*").alias("n"), F.count_if(F.col("confidence_level") == "HIGH").alias("high"), F.count_if(F.col("confidence_level") == "MEDIUM").alias("medium"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(rank.alias("r"), (-F.col("final_score")).alias("s"), "name", line.alias("line")))), lambda x: x["line"]), "\n").alias("results"),
    )
    told = triples.agg(
        F.count_if(strength(F.col("rel")) == "typed").alias("typed"), F.count_if(strength(F.col("rel")) != "typed").alias("weak"),
        F.array_join(F.slice(F.array_sort(F.collect_list(F.format_string("  [%s] (%s) --[%s]--> (%s)", strength(F.col("rel")), "src", "rel", "dst"))), 1, 30), "\n").alias("triples"),
    )
    more = grounded.agg(F.array_join(F.array_sort(F.collect_list(F.format_string("  [%s] (%s) --[%s]--> (%s) grounded in %s", strength(F.col("rel")), "src", "rel", "dst", "citation"))), "\n").alias("grounded"))
    head = F.format_string("Query: %s\n\nRetrieved %d relevant items (%d HIGH, %d MEDIUM)\nGraph triples: %d typed, %d weak\n\n=== GRAPH ===\n", F.lit(question), "n", "high", "medium", "typed", "weak")
    text = F.concat(head, F.when(F.col("triples") != "", F.col("triples")).otherwise("No direct relationships found."), F.lit("\n\n=== DOCUMENTS ===\n"), "results", F.when(F.col("grounded") != "", F.concat(F.lit("\n\n=== GROUNDED ===\n"), "grounded")).otherwise(""))
    return ranked.crossJoin(told).crossJoin(more).select((F.substring(text, 1, width) if width else text).alias("context"))


def document_citations(fused: DataFrame, forced: bool = False) -> DataFrame:
    """(key, page, citation) of the passages behind the results that have a page, each once; with forced also those without a text line."""
    p = fused.select(F.explode("passages").alias("p")).where("p.page is not null")
    return (p if forced else p.where("size(p.lines) > 0")).select("p.key", "p.page", "p.citation").distinct()


#: Words that make a question complex; one more of the list has a capital and so never stands in a question in small letters.
COMPLEX_WORDS = ["court", "order", "ordered", "ruled", "held", "directed", "judgment", "judgement", "petition", "writ", "appeal", "set aside", "declared", "upheld", "dismissed", "allowed", "scheme", "undertaking", "mortgage", "auction", "certificate", "transfer charge", "amnesty", "allottee", "leaseholder"]


def question_class(question: Column) -> Column:
    """RELATIONSHIP, FACT or COMPLEX by rules; facts with a legal word are complex."""
    low = F.lower(question)
    asked = F.when(low.rlike(r"\b(relat|connect|link|between|stand to each other)"), "RELATIONSHIP").when(low.rlike(r"^(why|how|explain|analy|compare)"), "COMPLEX").otherwise("FACT")
    legal = F.exists(F.array(*[F.lit(w) for w in COMPLEX_WORDS]), lambda w: F.contains(low, w))
    return F.when((asked == "FACT") & legal, "COMPLEX").otherwise(asked)


def route(kind: Column) -> Column:
    return F.when(kind == "RELATIONSHIP", "graph").when(kind == "FACT", "tree").otherwise("both")
