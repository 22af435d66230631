"""Question answering as a bounded loop over retrieval, fusion and graph expansion.

Model-dependent steps are functions handed in; the defaults are rules and extracts, marked as
such.  Only counters, seeds and the final rows reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.operators import fusion, graph, retrieval
from docmill.session import materialize

HOPS, TYPED, FAST = 3, 0.10, 5
TOP_K = {"FACT": 3, "RELATIONSHIP": 6, "COMPLEX": 10, "DEEP": 20}


def graph_augmented(passages: DataFrame, names: DataFrame, edges: DataFrame, passages_k: int = 5, names_k: int = 10, out_k: int = 30) -> DataFrame:
    """Edges of the names that the best passages mention.

    passages(key, page, score, text) are ranked results; the five best are broadcast, so every
    name is looked at once where it is.
    """
    best = F.broadcast(passages.orderBy(F.desc("score"), "key").limit(passages_k).select("key", F.lower("text").alias("low")))
    n = names.select("node").distinct().withColumn("parts", fusion.name_parts(F.col("node")))
    hit = n.join(best, F.exists("parts", lambda p: F.contains(F.col("low"), p))).select("node").distinct().orderBy("node").limit(names_k)
    return graph.touching(edges, hit, out_k)


def grounded(passages: DataFrame, names: DataFrame, edges: DataFrame, passages_k: int = 5, names_k: int = 10, look_k: int = 50, out_k: int = 30) -> DataFrame:
    """(src, rel, dst, citation): typed edges of the names that each of the best passages mentions, with that passage's citation.

    Each passage looks up at most names_k names and look_k edges; an edge keeps its best passage.
    """
    order = F.struct((-F.col("score")).alias("lower"), "key")
    best = F.broadcast(passages.orderBy(F.desc("score"), "key").limit(passages_k).select("key", "score", "citation", F.lower("text").alias("low")))
    n = names.select("node").distinct().withColumn("parts", fusion.name_parts(F.col("node")))
    hit = retrieval.best_per(n.join(best, F.exists("parts", lambda p: F.contains(F.col("low"), p))).select("key", "score", "citation", "node"), ["key"], [F.col("node")], names_k)
    strong = edges.where(~F.col("rel").isin(graph.WEAK)).select("src", "rel", "dst").distinct()
    ends = strong.join(F.broadcast(hit), strong["src"] == hit["node"]).unionByName(strong.join(F.broadcast(hit), (strong["dst"] == hit["node"]) & (strong["src"] != strong["dst"])))
    looked = retrieval.best_per(ends.select("key", "score", "citation", "src", "rel", "dst").distinct(), ["key"], [F.col("src"), F.col("rel"), F.col("dst")], look_k)
    once = looked.groupBy("src", "rel", "dst").agg(F.min_by("citation", order).alias("citation"), F.min(order).alias("first"))
    return once.orderBy("first", "src", "rel", "dst").limit(out_k).select("src", "rel", "dst", "citation")


def sufficiency_gate(triples: DataFrame, grounded_triples: DataFrame, fused: DataFrame, least: float = TYPED, expand_k: int = 4) -> DataFrame:
    """One row: share of triples that say something, whether that is enough, and otherwise the best sure names to expand."""
    share = (F.col("typed") + F.col("grounded")) / F.greatest(F.col("triples") + F.col("grounded"), F.lit(1))
    n = triples.agg(F.count("*").alias("triples"), F.count_if(~F.col("rel").isin(graph.WEAK)).alias("typed")).crossJoin(grounded_triples.agg(F.count("*").alias("grounded")))
    sure = fused.where("confidence_level = 'HIGH'").orderBy(*fusion.order_by_level()).limit(expand_k).agg(F.array_join(F.array_sort(F.collect_list("name")), ";").alias("expand"))
    out = n.crossJoin(sure).withColumn("typed_ratio", F.round(share, 6))
    return out.select("triples", "typed", "grounded", "typed_ratio", (F.col("typed_ratio") >= least).alias("passes"), F.when(F.col("typed_ratio") < least, F.col("expand")).otherwise("").alias("expand"))


def deep_research(search: Callable[[list[str]], tuple[DataFrame, DataFrame]], question: list[str], hops: int = HOPS, names_k: int = 6) -> tuple[DataFrame, int]:
    """fuse_pages results after hops expansions that are always made, each by the best names that are sure or likely, and how many were made.

    search(tokens) gives the nodes and passages of fuse_pages.  Each result is written before the
    next expansion reads it.
    """
    asked = list(question)
    fused, taken = materialize(fusion.fuse_pages(*search(asked))), 0
    while taken < hops:
        names = [r.name for r in fused.where("confidence_level in ('HIGH', 'MEDIUM')").orderBy(*fusion.order_by_level()).limit(names_k).collect()]
        if not names:
            break
        asked += [t for n in names for t in n.replace("_", " ").split() if t not in asked]
        fused, taken = materialize(fusion.merge_pages(fused, fusion.fuse_pages(*search(asked)))), taken + 1
    return fused, taken


#: Parts of a report.
SECTIONS = ["Summary", "Parties", "Timeline", "Facts", "Relationships", "Legal Basis", "Amounts", "Gaps", "Sources"]


def report(context: DataFrame, provider: Callable[[str, str], str] | None = None, width: int = 32_000) -> list[tuple[str, str]]:
    """(section, text) of each of the nine sections from one row of context; without a provider each quotes the context's lines that name it."""
    text = context.first().context[:width]
    quote = lambda section, t: "\n".join(x for x in t.splitlines() if section.split()[0].lower() in x.lower())
    return [(s, (provider or quote)(s, text)) for s in SECTIONS]


def typed_ratio(triples: DataFrame) -> DataFrame:
    """One row: how many triples say more than that names stand together."""
    typed = F.count_if(~F.col("rel").isin(graph.WEAK))
    return triples.agg(F.count("*").alias("triples"), F.coalesce(typed / F.nullif(F.count("*"), F.lit(0)), F.lit(0.0)).alias("typed_ratio")).withColumn("passes", F.col("typed_ratio") >= TYPED)


def fast_path(fused: DataFrame, kind: str) -> bool:
    """A fact with enough sure results needs no further look."""
    return kind == "FACT" and fused.where("confidence_level = 'HIGH'").limit(FAST).count() >= FAST


def extract_answer(passages: DataFrame, question: list[str], k: int = 3) -> DataFrame:
    """(rank, answer, citation, provider): the most telling lines of the best passages."""
    best = passages.orderBy(F.desc("score"), "key").limit(k)
    lines = retrieval.relevant_lines(F.col("text"), question, 2)
    return best.select("key", F.round("score", 4).alias("score"), F.array_join(lines, " ").alias("answer"), F.lit("extract").alias("provider"))


def answer(search: Callable[[list[str]], tuple[DataFrame, DataFrame]], question: list[str], edges: DataFrame, kind: str = "COMPLEX", enough: Callable[[DataFrame], bool] | None = None, hops: int = HOPS) -> tuple[DataFrame, int]:
    """Fused results of a question after at most hops expansions, and how many were taken.

    search(tokens) gives nodes(name, graph_score) and passages(key, page, score, text).  Each
    expansion adds the tokens of the best names (four at most) to the question and merges.
    """
    asked = list(question)
    fused = fusion.fuse(*search(asked))
    if fast_path(fused, kind):
        return fused, 0
    enough = enough or (lambda f: f.where("confidence_level = 'HIGH'").limit(1).count() > 0)
    taken = 0
    while taken < hops and not enough(fused):
        names = [r.name for r in fused.where("not startswith(name, 'passage_')").orderBy(*fusion.order_by_level()).limit(4).collect()]
        more = [t for n in names for t in n.replace("_", " ").split() if t not in asked]
        if not more:
            break
        asked += more
        taken += 1
        columns = ["name", "graph_score", "tree_score", "passages"]
        fused = materialize(fusion.merge(fused.select(columns), fusion.fuse(*search(asked)).select(columns)))
    return fused, taken
