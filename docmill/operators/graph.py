"""The property graph as tables: upserts, degrees, traversal, scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.functions import text as T
from docmill.operators import retrieval
from docmill.session import materialize

#: Relations that only say that two names stand together.
WEAK = ["CO_OCCURS_WITH", "CO_OCCURS", "COOCCURS_WITH"]
ALPHA, BETA, GAMMA = 0.5, 0.3, 0.2
SEEDS = 5
_PARTY = ["Organization", "Person", "FinancialInstitution", "Government", "StatutoryBody"]
#: Words of a question and the types they stand for.
KEYWORDS = {
    "parties": _PARTY, "party": _PARTY, "who": _PARTY, "court": ["Court"], "judge": ["Court", "Person"], "amount": ["Demand", "Amount", "Transaction"], "demand": ["Demand"], "charges": ["Demand"], "payment": ["Transaction", "Amount"],
    "order": ["Court", "LegalProceeding"], "ruling": ["Court", "LegalProceeding"], "case": ["LegalProceeding"], "petition": ["LegalProceeding"], "law": ["Regulation"], "section": ["Regulation"], "act": ["Regulation"], "asset": ["Asset"], "plot": ["Asset", "Location"], "land": ["Asset", "Location"],
    "loan": ["Transaction", "FinancialInstitution"], "bank": ["FinancialInstitution"],
}


def upsert(rows: DataFrame, keys: list[str], confidence: str, order: str) -> DataFrame:
    """Attributes of the first row of each key, the highest confidence of all."""
    rest = [c for c in rows.columns if c not in [*keys, confidence]]
    out = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(order)).alias("r"), F.max(confidence).alias(confidence))
    return out.select(*keys, "r.*", confidence)


def degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, degree); a loop counts once, nodes without an edge have 0."""
    ends = edges.select(F.col("src").alias("node")).unionByName(edges.where("src <> dst").select(F.col("dst").alias("node")))
    return nodes.select("node").join(ends.groupBy("node").agg(F.count("*").alias("degree")), "node", "left").select("node", F.coalesce("degree", F.lit(0)).alias("degree"))


def symmetric(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def traverse(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """(node, hop): everything within hops, at its first hop; the frontier is distinct at each hop."""
    both = symmetric(edges)
    seen = seeds.select("node", F.lit(0).alias("hop")).distinct()
    frontier = seen
    for h in range(1, hops + 1):
        reached = frontier.join(both, frontier["node"] == both["src"]).select(F.col("dst").alias("node")).distinct()
        frontier = reached.join(seen.select("node"), "node", "left_anti").select("node", F.lit(h).alias("hop"))
        seen = seen.unionByName(frontier)
    return seen


def within(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, hops: int, types: list[str] | None = None, k: int = 200) -> DataFrame:
    """nodes(node, label, ...) within hops of the seeds, of the given types, with degree: the k of the highest degree, and the seeds that are not among them.

    Edges and nodes of one case give a traversal of that case.
    """
    kept = nodes.where(F.col("label").isin(types)) if types else nodes
    reached = kept.join(traverse(edges, seeds, hops).select("node"), "node", "left_semi").join(degree(nodes, edges).distinct(), "node")
    best = reached.orderBy(F.desc("degree"), "node", "label").limit(k)
    missing = by_name(kept, edges, seeds).join(best.select("node"), "node", "left_anti")
    return best.unionByName(missing.select(*best.columns))


def by_name(nodes: DataFrame, edges: DataFrame, names: DataFrame) -> DataFrame:
    """nodes of the given names with their degree; only edges at those names are counted."""
    n = names.select("node").distinct()
    found = nodes.join(n, "node", "left_semi")
    near = edges.join(n.withColumnRenamed("node", "src"), "src", "left_semi").select("src", "dst").unionByName(edges.where("src <> dst").join(n.withColumnRenamed("node", "dst"), "dst", "left_semi").select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return found.join(near.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree")), "node", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))


def connect(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """edges(case_id, src, rel, dst, confidence, source, seq) whose ends are nodes(case_id, node, label) of their case, upserted.

    Labels do not matter: an end that stands under several labels is met under each.  An edge
    keeps its first source and the highest confidence.
    """
    ends = nodes.select("case_id", "node", "label")
    a = ends.select("case_id", F.col("node").alias("src"), F.col("label").alias("src_label"))
    b = ends.select("case_id", F.col("node").alias("dst"), F.col("label").alias("dst_label"))
    once = edges.withColumn("rel", T.relation_type(F.col("rel"))).groupBy("case_id", "src", "rel", "dst").agg(F.max("confidence").alias("confidence"), F.min_by("source", "seq").alias("source"))
    return once.join(a, ["case_id", "src"]).join(b, ["case_id", "dst"]).select("case_id", "src", "src_label", "rel", "dst", "dst_label", "confidence", "source")


def counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(case_id, label, nodes, edges) for each label, each case and all; edges by their own case."""
    n = nodes.rollup("case_id", "label").agg(F.count("*").alias("nodes")).select(F.coalesce("case_id", F.lit("all")).alias("case_id"), F.coalesce("label", F.lit("all")).alias("label"), "nodes")
    e = edges.rollup("case_id").agg(F.count("*").alias("edges")).select(F.coalesce("case_id", F.lit("all")).alias("case_id"), F.lit("all").alias("label"), "edges")
    return n.join(e, ["case_id", "label"], "left").withColumn("edges", F.when(F.col("label") == "all", F.coalesce("edges", F.lit(0))))


def cross_case(nodes: DataFrame, name: str, exclude: str | None = None) -> DataFrame:
    """(case_id, node, label) of a name in all cases but one, in order of case; without a case to leave out all come."""
    found = nodes.where(F.col("name") == name)
    return (found if exclude is None else found.where(~F.col("case_id").eqNullSafe(exclude))).select("case_id", "name", "label").orderBy("case_id", "label")


def search(nodes: DataFrame, edges: DataFrame, question: list[str], seeds: DataFrame, vectors_: DataFrame | None, k: int, hops: int, types: list[str] | None = None) -> tuple[DataFrame, DataFrame, bool]:
    """(scored nodes(node, node_score), triples, escalated): traversal from the seeds, and where that is not sufficient from the names of the nearest vectors too.

    nodes(node, name, label, text, confidence), edges(src, rel, dst), vectors_(node, similarity) are
    the nearest names by vector, best first; a node with a similarity takes it as its relevance.
    Nodes of the second search come before those that only the first one found.
    """

    def run(start: DataFrame, similar: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        rows = within(nodes, edges, start, hops, types).withColumn("rel", relevance(question, F.col("name"), F.coalesce("text", F.lit(""))))
        if similar is not None:
            rows = rows.join(F.broadcast(similar), "node", "left").withColumn("rel", F.coalesce("similarity", "rel"))
        scored = materialize(node_scores(rows, k))
        return scored, materialize(subgraph(edges, scored).select("src", "rel", "dst").distinct())

    scored, triples = run(seeds, None)
    told = nodes.join(scored.select("node"), "node", "left_semi")
    if vectors_ is None or sufficiency(told, triples).first().is_sufficient:
        return scored, triples, False
    near = materialize(vectors_)
    more = seeds.select("node").unionByName(near.orderBy(F.desc("similarity"), "node").limit(SEEDS).select("node")).distinct()
    second, more_triples = run(more, near)
    extra = scored.join(second.select("node"), "node", "left_anti")
    both = second.withColumn("o", F.lit(0)).unionByName(extra.withColumn("o", F.lit(1))).orderBy("o", F.desc("node_score"), "node").limit(k).drop("o")
    return both, more_triples.unionByName(triples).distinct(), True


def subgraph(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes."""
    inside = nodes.select("node").distinct()
    return edges.join(inside.withColumnRenamed("node", "src"), "src", "left_semi").join(inside.withColumnRenamed("node", "dst"), "dst", "left_semi")


def touching(edges: DataFrame, names: DataFrame, k: int = 50) -> DataFrame:
    """Edges at any of the names, weak ones left out, in a fixed order."""
    strong = edges.where(~F.col("rel").isin(WEAK))
    n = names.select("node").distinct()
    hit = strong.join(n.withColumnRenamed("node", "src"), "src", "left_semi").select("src", "rel", "dst").unionByName(strong.join(n.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "rel", "dst"))
    return hit.distinct().orderBy("src", "rel", "dst").limit(k)


def relevance(question: list[str], name: Column, text: Column) -> Column:
    """Jaccard overlap of the question's tokens with those of a name and its text."""
    own = F.array_distinct(F.concat(T.name_tokens(name), T.name_tokens(text)))
    asked = F.array(*[F.lit(t) for t in dict.fromkeys(question)])
    union = F.size(F.array_union(own, asked))
    return F.when(union > 0, F.size(F.array_intersect(own, asked)) / union).otherwise(0.0)


def asked_types(question: str) -> list[str]:
    """The types that the question's keywords stand for, in order of the keywords."""
    return list(dict.fromkeys(t for word, types in KEYWORDS.items() if word in question.lower() for t in types))


def type_seeds(nodes: DataFrame, question: str, order: str) -> DataFrame:
    """nodes(node, label, order) -> (node) of the asked types: three of each, the earliest first, until there are SEEDS."""
    types = asked_types(question)
    if not types:
        return nodes.select("node").limit(0)
    place = F.array_position(F.array(*[F.lit(t) for t in types]), F.col("label"))
    few = retrieval.best_per(nodes.where(F.col("label").isin(types)).select("label", "node", order), ["label"], [F.col(order), F.col("node")], 3)
    first = few.groupBy("node").agg(F.min(F.struct(place.alias("place"), F.col(order).alias("at"))).alias("first"))
    return first.orderBy("first", "node").limit(SEEDS).select("node")


def question_seeds(nodes: DataFrame, degrees: DataFrame, question: list[str], order: str) -> DataFrame:
    """nodes(node, name, label, order) -> (node): names that share a word with the question, else names of the types it asks for, else those of the highest degree."""
    overlap = relevance(question, F.col("name"), F.lit(""))
    told = nodes.withColumn("rel", overlap).where("rel > 0").groupBy("node").agg(F.max("rel").alias("rel")).orderBy(F.desc("rel"), "node").limit(SEEDS)
    tiers = [told.select("node"), type_seeds(nodes, " ".join(question), order), degrees.select("node", "degree").distinct().orderBy(F.desc("degree"), "node").limit(SEEDS).select("node")]
    rows = reduce(DataFrame.unionByName, [t.withColumn("tier", F.lit(i)) for i, t in enumerate(tiers)])
    kept = rows.agg(F.array_sort(F.collect_list(F.struct("tier", "node"))).alias("x"))  # at most SEEDS a tier
    return kept.select(F.explode(F.filter("x", lambda r: r["tier"] == F.col("x")[0]["tier"])).alias("r")).select("r.node")


def node_scores(rows: DataFrame, k: int) -> DataFrame:
    """rows(node, rel, degree, confidence) -> (node, node_score): rows of one name add up, damped."""
    most = rows.agg(F.greatest(F.max("degree"), F.lit(1)).alias("most"))
    conf = F.coalesce(F.nullif("confidence", F.lit(0.0)), F.lit(0.5))
    part = ALPHA * F.col("rel") + BETA * F.col("degree") / F.col("most") + GAMMA * conf
    scored = rows.crossJoin(F.broadcast(most)).groupBy("node").agg(F.round(F.sum(part) / F.sqrt(F.count("*") + 1), 4).alias("node_score"))
    return scored.orderBy(F.desc("node_score"), "node").limit(k)


def sufficiency(nodes: DataFrame, triples: DataFrame) -> DataFrame:
    """One row: enough nodes, enough sure ones, any triple."""
    n = nodes.agg(F.count("*").alias("node_count"), F.count_if(F.col("confidence") >= 0.6).alias("confident_node_count")).crossJoin(triples.agg(F.count("*").alias("triple_count")))
    ok = (F.col("node_count") >= 5) & (F.col("confident_node_count") >= 2) & (F.col("triple_count") >= 1)
    why = F.concat_ws("; ", F.when(F.col("node_count") < 5, "node count"), F.when(F.col("confident_node_count") < 2, "confident nodes"), F.when(F.col("triple_count") < 1, "triples"))
    return n.withColumn("is_sufficient", ok).withColumn("reason", why)


def merge_aliases(edges: DataFrame, aliases: DataFrame, preserve_types: bool = False) -> DataFrame:
    """Edges with old names replaced; changed ones become RELATED_TO, loops drop out, repeats are one."""
    a = aliases.select(F.col("old").alias("src"), F.col("canonical").alias("src_new"))
    b = aliases.select(F.col("old").alias("dst"), F.col("canonical").alias("dst_new"))
    joined = edges.select("src", "rel", "dst").join(a, "src", "left").join(b, "dst", "left")
    changed = F.col("src_new").isNotNull() | F.col("dst_new").isNotNull()
    rel = F.col("rel") if preserve_types else F.when(changed, "RELATED_TO").otherwise(F.col("rel"))
    out = joined.select(F.coalesce("src_new", "src").alias("src"), rel.alias("rel"), F.coalesce("dst_new", "dst").alias("dst"), changed.alias("changed"))
    return out.where("not changed or src <> dst").select("src", "rel", "dst").distinct()
