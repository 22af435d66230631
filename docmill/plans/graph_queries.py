"""The property graph over the relational tables, and the SQL it is checked against.

Regions, nations, customers and suppliers are nodes; their foreign keys are edges; a case is a
region.  Mentions of entities form a second graph by the pairs of names of a page.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.functions import text as T
from docmill.operators import fusion, graph, retrieval, vectors
from docmill.operators.entities import graph_label
from docmill.plans import entity_queries as EQ
from docmill.plans.retrieval_queries import BM25, QUESTION
from docmill.session import materialize, table

SEEDS = ["NATION_1", "NATION_2"]
QUESTION_NAMES = ["customer", "000000042", "supplier", "000000007"]


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, n, c, s = (table(spark, sf_dir, x) for x in ("region", "nation", "customer", "supplier"))
    case = n.select(F.col("n_nationkey").alias("nk"), F.col("n_regionkey").cast("int").alias("case_no"))
    parts = [
        r.select(F.col("r_regionkey").cast("int").alias("case_no"), F.lit("Region").alias("label"), F.col("r_name").alias("node"), F.lit(0.9).alias("confidence")),
        n.select(F.col("n_regionkey").cast("int").alias("case_no"), F.lit("Location").alias("label"), F.col("n_name").alias("node"), F.lit(0.8).alias("confidence")),
        c.join(F.broadcast(case), c["c_nationkey"] == case["nk"]).select("case_no", F.lit("Person").alias("label"), F.col("c_name").alias("node"), F.when(F.col("c_acctbal") > 0, 0.7).otherwise(0.0).alias("confidence")),
        s.join(F.broadcast(case), s["s_nationkey"] == case["nk"]).select("case_no", F.lit("Organization").alias("label"), F.col("s_name").alias("node"), F.when(F.col("s_acctbal") > 0, 0.7).otherwise(0.0).alias("confidence")),
    ]
    return reduce(DataFrame.unionByName, parts).withColumn("label", graph_label(F.col("label")))


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, n, c, s = (table(spark, sf_dir, x) for x in ("region", "nation", "customer", "supplier"))
    named = n.select(F.col("n_nationkey").alias("nk"), F.col("n_name").alias("dst"), F.col("n_regionkey").cast("int").alias("case_no"))
    parts = [
        n.join(F.broadcast(r), n["n_regionkey"] == r["r_regionkey"]).select(F.col("n_regionkey").cast("int").alias("case_no"), F.col("n_name").alias("src"), F.lit("IN_REGION").alias("rel"), F.col("r_name").alias("dst")),
        c.join(F.broadcast(named), c["c_nationkey"] == named["nk"]).select("case_no", F.col("c_name").alias("src"), F.lit("IN_NATION").alias("rel"), "dst"),
        s.join(F.broadcast(named), s["s_nationkey"] == named["nk"]).select("case_no", F.col("s_name").alias("src"), F.lit("IN_NATION").alias("rel"), "dst"),
    ]
    return reduce(DataFrame.unionByName, parts)


def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions upserted into nodes: the first mention's attributes, the highest confidence."""
    m = EQ._mentions(spark, sf_dir).where("case_id is not null and canonical_name is not null")
    rows = m.select("case_id", graph_label(F.col("schema_type")).alias("label"), F.col("canonical_name").alias("node"), "mention_id", "source_pdf", "confidence")
    return graph.upsert(rows, ["case_id", "label", "node"], "confidence", "mention_id")


def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of names of a page upserted into edges, with the first page and the number of pages."""
    p = EQ._pairs(spark, sf_dir).select("case_id", F.least("name_a", "name_b").alias("src"), F.greatest("name_a", "name_b").alias("dst"), F.col("source_page").cast("int").alias("page"))
    return p.groupBy("case_id", "src", "dst").agg(F.count("*").alias("pages"), F.min("page").alias("first_page"))


def graph_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nodes(spark, sf_dir).rollup("case_no", "label").agg(F.count("*").alias("n_nodes")).select(F.coalesce("case_no", F.lit(-1)).alias("case_no"), F.coalesce("label", F.lit("all")).alias("label"), "n_nodes")


def degree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _nodes(spark, sf_dir)
    return graph.degree(n, _edges(spark, sf_dir)).orderBy(F.desc("degree"), "node").limit(20)


def cross_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that stand in more than one case."""
    m = EQ._mentions(spark, sf_dir).where("case_id is not null and canonical_name is not null")
    return m.groupBy("canonical_name").agg(F.count_distinct("case_id").alias("cases"), F.min("case_id").alias("first_case")).where("cases > 1")


def relation_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "passages").select(F.col("section_title")).distinct().select("section_title", T.relation_type(F.col("section_title")).alias("relation"))


def case_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "cases").select("case_id", T.slug(F.col("case_name")).alias("slug"))


def _jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nodes(spark, sf_dir).withColumn("rel", graph.relevance(QUESTION_NAMES, F.translate("node", "#", " "), F.lit("")))


def seed_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _jaccard(spark, sf_dir).where("rel > 0").select("node", F.round("rel", 6).alias("overlap")).orderBy(F.desc("overlap"), "node").limit(5)


def seed_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most three names of each type that a keyword of the question stands for."""
    n = _nodes(spark, sf_dir).where(F.col("label").isin("Organization", "Person"))
    return retrieval.best_per(n.select("label", "node"), ["label"], [F.col("node")], 3)


def _seeds(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(s,) for s in SEEDS], "node string")


def traverse_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.traverse(_edges(spark, sf_dir), _seeds(spark), 3)


def subgraph_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _edges(spark, sf_dir)
    return graph.subgraph(e, graph.traverse(e, _seeds(spark), 1)).select("src", "rel", "dst")


def gar_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.touching(_edges(spark, sf_dir), _seeds(spark))


def _node_scores(spark: SparkSession, sf_dir: str, k: int = 20) -> DataFrame:
    rows = _jaccard(spark, sf_dir).join(graph.degree(_nodes(spark, sf_dir), _edges(spark, sf_dir)), "node")
    return graph.node_scores(rows, k)


def node_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _node_scores(spark, sf_dir)


def sufficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _edges(spark, sf_dir)
    near = graph.traverse(e, _seeds(spark), 1)
    return graph.sufficiency(_nodes(spark, sf_dir).join(near, "node", "left_semi"), graph.subgraph(e, near))


def alias_merge_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations with an odd key are merged into their region's first nation."""
    n = table(spark, sf_dir, "nation")
    first = n.groupBy("n_regionkey").agg(F.min("n_name").alias("canonical"))
    aliases = n.where("n_nationkey % 2 = 1").join(first, "n_regionkey").where("n_name <> canonical").select(F.col("n_name").alias("old"), "canonical")
    return graph.merge_aliases(_edges(spark, sf_dir), aliases)


def kge_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense numbers of the entities of each case, in order of name."""
    e = _edges(spark, sf_dir)
    names = e.select("case_no", F.col("src").alias("entity")).unionByName(e.select("case_no", F.col("dst").alias("entity"))).distinct()
    from pyspark.sql.window import Window

    return names.withColumn("idx", F.row_number().over(Window.partitionBy("case_no").orderBy("entity")) - 1)


def kge_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.train_graph_embeddings(_edges(spark, sf_dir), "case_no").select("case_no", "entity", "idx", F.size("vec").alias("dims"))


def _fusion_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    p = table(spark, sf_dir, "passages")
    scored = retrieval.top(retrieval.score(p, "passage_id", "text", QUESTION).select("passage_id", F.round("score", 6).alias("score")), "passage_id", 20)
    passages = scored.join(p.select("passage_id", "text", F.col("page_number").alias("page")), "passage_id").withColumnRenamed("passage_id", "key")
    m = EQ._mentions(spark, sf_dir).where("canonical_name is not null and schema_type in ('Organization', 'Person')")
    nodes = m.groupBy(F.col("canonical_name").alias("name")).agg(F.round(F.count("*") / (F.count("*") + 10.0), 4).alias("graph_score")).orderBy(F.desc("graph_score"), "name").limit(50)
    return nodes, passages


def _page_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of mentions as nodes; a node is a name in its case."""
    m = EQ._mentions(spark, sf_dir).where("case_id is not null and canonical_name is not null")
    rows = m.select(_in_case("canonical_name"), F.col("canonical_name").alias("name"), "case_id", graph_label(F.col("schema_type")).alias("label"), "mention_id", "context", "confidence")
    return graph.upsert(rows, ["node", "name", "case_id", "label"], "confidence", "mention_id")


def _in_case(name: str):
    return F.concat_ws("|", F.col("case_id").cast("string"), F.col(name)).alias("node" if name == "canonical_name" else name)


def _page_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph_edges(spark, sf_dir).select("case_id", _in_case("src"), F.lit("CO_OCCURS").alias("rel"), _in_case("dst"))


def question_nodes(nodes: DataFrame, edges: DataFrame, passages: DataFrame, question: list[str], hops: int = 3, k: int = 50) -> DataFrame:
    """(node, name, graph_score): the k best of what is within hops of the names that the question or its passages concern.

    nodes(node, name, case_id, label, mention_id, context, confidence), passages(case_id, text)
    are ranked results.  A name stands in a passage if all its longer words do.
    """
    degrees = materialize(graph.degree(nodes, edges).distinct())
    best = F.broadcast(passages.select("case_id", F.lower("text").alias("low")))
    parts = nodes.select("node", "case_id", fusion.name_parts(F.col("name")).alias("parts")).where(F.size("parts") > 0)
    quoted = parts.join(best, "case_id").where(F.forall("parts", lambda p: F.contains(F.col("low"), p))).select("node")
    seeds = materialize(graph.question_seeds(nodes, degrees, question, "mention_id").unionByName(quoted).distinct())
    rows = nodes.join(graph.traverse(edges, seeds, hops), "node").join(degrees, "node").withColumn("rel", graph.relevance(question, F.col("name"), F.coalesce("context", F.lit(""))))
    return graph.node_scores(rows, k).join(nodes.select("node", "name").distinct(), "node").select("node", "name", F.col("node_score").alias("graph_score"))


def _answer_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes and passages of the question, and the edges among those nodes."""
    passages = materialize(_fusion_inputs(spark, sf_dir)[1])
    cases = table(spark, sf_dir, "passages").select(F.col("passage_id").alias("key"), "case_id")
    edges = materialize(_page_edges(spark, sf_dir))
    found = materialize(question_nodes(materialize(_page_nodes(spark, sf_dir)), edges, passages.join(cases, "key"), list(dict.fromkeys(QUESTION))))
    named = F.element_at(F.split("src", r"\|", 2), 2), F.element_at(F.split("dst", r"\|", 2), 2)
    triples = graph.subgraph(edges, found).select(named[0].alias("src"), F.lit("SHARES_PAGE").alias("rel"), named[1].alias("dst")).distinct()
    return found.groupBy("name").agg(F.max("graph_score").alias("graph_score")), passages, triples


def fuse_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fusion.fuse(*_fusion_inputs(spark, sf_dir))
    return f.select("name", "confidence_level", "passages", F.round("final_score", 4).alias("final_score"))


def context_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, passages = _fusion_inputs(spark, sf_dir)
    f = fusion.fuse(nodes, passages).select("name", "graph_score", "tree_score", "passages")
    m = fusion.merge(f, f.where("passages > 0"))
    return m.select("name", "confidence_level", "passages", F.round("final_score", 4).alias("final_score"))


def prompt_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, passages, triples = _answer_inputs(spark, sf_dir)
    return fusion.prompt_context(fusion.fuse(nodes, passages), triples)


def relation_strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, sf_dir).groupBy(F.when(F.col("rel").isin(graph.WEAK), "weak").otherwise("typed").alias("strength"), "rel").agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (graph_nodes, graph_edges, graph_stats, degree_topk, cross_case, relation_types, case_slugs, seed_jaccard, seed_types, traverse_hops, subgraph_triples, gar_lookup, node_scores, sufficiency, alias_merge_edges, kge_vocab, kge_train, fuse_scores, context_merge, prompt_context, relation_strength)
}

_N = """nodes AS (SELECT r_regionkey::INT AS case_no, 'Entity' AS label, r_name AS node, 0.9 AS confidence FROM region UNION ALL SELECT n_regionkey::INT, 'Location', n_name, 0.8 FROM nation
    UNION ALL SELECT n_regionkey::INT, 'Person', c_name, CASE WHEN c_acctbal > 0 THEN 0.7 ELSE 0 END FROM customer JOIN nation ON c_nationkey = n_nationkey
    UNION ALL SELECT n_regionkey::INT, 'Organization', s_name, CASE WHEN s_acctbal > 0 THEN 0.7 ELSE 0 END FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""
_E = """edges AS (SELECT n_regionkey::INT AS case_no, n_name AS src, 'IN_REGION' AS rel, r_name AS dst FROM nation JOIN region ON n_regionkey = r_regionkey
    UNION ALL SELECT n_regionkey::INT, c_name, 'IN_NATION', n_name FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT n_regionkey::INT, s_name, 'IN_NATION', n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""
_SEEDS = ", ".join(f"('{s}')" for s in SEEDS)
_WALK = f"""{_E}, y AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges), seeds(node) AS (VALUES {_SEEDS}),
    h1 AS (SELECT DISTINCT dst AS node FROM y JOIN seeds ON src = node), h2 AS (SELECT DISTINCT dst AS node FROM y JOIN h1 ON src = node), h3 AS (SELECT DISTINCT dst AS node FROM y JOIN h2 ON src = node),
    w AS (SELECT node, min(hop) AS hop FROM (SELECT node, 0 AS hop FROM seeds UNION ALL SELECT node, 1 FROM h1 UNION ALL SELECT node, 2 FROM h2 UNION ALL SELECT node, 3 FROM h3) GROUP BY node)"""
_DEG = "d AS (SELECT n.node, count(e.x) AS degree FROM (SELECT DISTINCT node FROM nodes) n LEFT JOIN (SELECT src AS x FROM edges UNION ALL SELECT dst FROM edges WHERE src <> dst) e ON e.x = n.node GROUP BY n.node)"
_ASK = ", ".join(f"'{t}'" for t in QUESTION_NAMES)
_OWN = f"list_distinct(list_transform(list_filter(regexp_extract_all(replace(replace(lower(node), '#', ' '), '_', ' '), '[^{T.SPACE}]+'), lambda t: length(t) > 2 AND t NOT IN ({', '.join(repr(w) for w in T.STOPWORDS)})), lambda t: regexp_replace(t, '^[.,;:\"''()-]+|[.,;:\"''()-]+$', '', 'g')))"
_J = f"j AS (SELECT *, len(list_intersect({_OWN}, [{_ASK}]))::DOUBLE / len(list_distinct(list_concat({_OWN}, [{_ASK}]))) AS rel FROM nodes)"
_REL = "regexp_replace(regexp_replace(regexp_replace(trim(upper(section_title)), '[^\\p{L}\\p{N}_]', '_', 'g'), '_+', '_', 'g'), '^_|_$', '', 'g')"
_FUSE = f"""
    s AS (SELECT * FROM ({BM25}) WHERE score > 0 ORDER BY score DESC, passage_id LIMIT 20), p AS (SELECT s.passage_id AS key, score, lower(text) AS low FROM s JOIN passages x ON x.passage_id = s.passage_id),
    n AS (SELECT canonical_name AS name, round(count(*) / (count(*) + 10.0), 4) AS graph_score FROM {EQ.MENTIONS} WHERE canonical_name IS NOT NULL AND schema_type IN ('Organization', 'Person') GROUP BY 1 ORDER BY graph_score DESC, name LIMIT 50),
    h AS (SELECT n.name, graph_score, key, score FROM n LEFT JOIN p ON len(list_filter(list_filter(regexp_extract_all(replace(lower(name), '_', ' '), '[^{T.SPACE}]+'), lambda w: length(w) > 3), lambda w: contains(low, w))) > 0),
    f AS (SELECT name, graph_score, coalesce(max(score), 0) AS tree_score, count(key) AS passages, true AS g FROM h GROUP BY 1, 2
      UNION ALL SELECT 'passage_' || key, 0, score, 1, false FROM p WHERE key NOT IN (SELECT key FROM h WHERE key IS NOT NULL))"""

SQL = {
    "graph_nodes": f"""SELECT case_id, label, node, arg_min(mention_id, mention_id) AS mention_id, first(source_pdf ORDER BY mention_id) AS source_pdf, max(confidence) AS confidence
        FROM (SELECT case_id, CASE WHEN schema_type IN ({EQ._list(EQ.E.LABELS)}) THEN schema_type ELSE 'Entity' END AS label, canonical_name AS node, mention_id, source_pdf, confidence FROM {EQ.MENTIONS} WHERE case_id IS NOT NULL AND canonical_name IS NOT NULL) GROUP BY 1, 2, 3""",
    "graph_edges": f"WITH {EQ._FIRST} SELECT case_id, least(name_a, name_b) AS src, greatest(name_a, name_b) AS dst, count(*) AS pages, min(source_page) AS first_page FROM p GROUP BY 1, 2, 3",
    "graph_stats": f"WITH {_N} SELECT coalesce(case_no, -1) AS case_no, coalesce(label, 'all') AS label, n_nodes FROM (SELECT case_no, label, count(*) AS n_nodes FROM nodes GROUP BY ROLLUP (case_no, label))",
    "degree_topk": f"WITH {_N}, {_E}, {_DEG} SELECT node, degree FROM d ORDER BY degree DESC, node LIMIT 20",
    "cross_case": f"SELECT canonical_name, count(DISTINCT case_id) AS cases, min(case_id) AS first_case FROM {EQ.MENTIONS} WHERE case_id IS NOT NULL AND canonical_name IS NOT NULL GROUP BY 1 HAVING count(DISTINCT case_id) > 1",
    "relation_types": f"SELECT DISTINCT section_title, CASE WHEN section_title IS NULL OR {_REL} = '' THEN 'RELATED_TO' WHEN regexp_matches({_REL}, '^\\p{{Nd}}') THEN 'REL_' || {_REL} ELSE {_REL} END AS relation FROM passages",
    "case_slugs": "SELECT case_id, regexp_replace(regexp_replace(regexp_replace(lower(case_name), '[^a-z0-9_]', '_', 'g'), '_+', '_', 'g'), '^_|_$', '', 'g') AS slug FROM cases",
    "seed_jaccard": f"WITH {_N}, {_J} SELECT node, round(rel, 6) AS overlap FROM j WHERE rel > 0 ORDER BY overlap DESC, node LIMIT 5",
    "seed_types": f"WITH {_N} SELECT label, node FROM nodes WHERE label IN ('Organization', 'Person') QUALIFY row_number() OVER (PARTITION BY label ORDER BY node) <= 3",
    "traverse_hops": f"WITH {_WALK} SELECT node, hop FROM w",
    "subgraph_triples": f"WITH {_WALK}, u AS (SELECT node FROM w WHERE hop <= 1) SELECT src, rel, dst FROM edges WHERE src IN (SELECT node FROM u) AND dst IN (SELECT node FROM u)",
    "gar_lookup": f"WITH {_E}, seeds(node) AS (VALUES {_SEEDS}) SELECT DISTINCT src, rel, dst FROM edges WHERE src IN (SELECT node FROM seeds) OR dst IN (SELECT node FROM seeds) ORDER BY src, rel, dst LIMIT 50",
    "node_scores": f"""WITH {_N}, {_E}, {_DEG}, {_J}, m AS (SELECT greatest(max(degree), 1) AS most FROM d)
        SELECT j.node, round(sum(0.5 * rel + 0.3 * degree / most + 0.2 * coalesce(nullif(confidence, 0), 0.5)) / sqrt(count(*) + 1), 4) AS node_score FROM j JOIN d ON d.node = j.node, m GROUP BY j.node ORDER BY node_score DESC, j.node LIMIT 20""",
    "sufficiency": f"""WITH {_N}, {_WALK}, u AS (SELECT node FROM w WHERE hop <= 1), a AS (SELECT count(*) AS node_count, count(*) FILTER (WHERE confidence >= 0.6) AS confident_node_count FROM nodes WHERE node IN (SELECT node FROM u)),
        t AS (SELECT count(*) AS triple_count FROM edges WHERE src IN (SELECT node FROM u) AND dst IN (SELECT node FROM u))
        SELECT *, node_count >= 5 AND confident_node_count >= 2 AND triple_count >= 1 AS is_sufficient, concat_ws('; ', CASE WHEN node_count < 5 THEN 'node count' END, CASE WHEN confident_node_count < 2 THEN 'confident nodes' END, CASE WHEN triple_count < 1 THEN 'triples' END) AS reason FROM a, t""",
    "alias_merge_edges": f"""WITH {_E}, a AS (SELECT n_name AS old, canonical FROM nation JOIN (SELECT n_regionkey AS k, min(n_name) AS canonical FROM nation GROUP BY 1) ON k = n_regionkey WHERE n_nationkey % 2 = 1 AND n_name <> canonical),
        c AS (SELECT coalesce(x.canonical, src) AS src, CASE WHEN x.old IS NOT NULL OR y.old IS NOT NULL THEN 'RELATED_TO' ELSE rel END AS rel, coalesce(y.canonical, dst) AS dst, x.old IS NOT NULL OR y.old IS NOT NULL AS changed FROM edges LEFT JOIN a x ON x.old = src LEFT JOIN a y ON y.old = dst)
        SELECT DISTINCT src, rel, dst FROM c WHERE NOT changed OR src <> dst""",
    "kge_vocab": f"WITH {_E} SELECT case_no, entity, row_number() OVER (PARTITION BY case_no ORDER BY entity) - 1 AS idx FROM (SELECT case_no, src AS entity FROM edges UNION SELECT case_no, dst FROM edges)",
    "fuse_scores": f"WITH {_FUSE.lstrip()} SELECT name, CASE WHEN g AND passages > 0 THEN 'HIGH' WHEN g OR passages > 0 THEN 'MEDIUM' ELSE 'LOW' END AS confidence_level, passages, round(0.6 * graph_score + 0.4 * tree_score, 4) AS final_score FROM f",
    "context_merge": f"""WITH {_FUSE.lstrip()}, m AS (SELECT name, max(graph_score) AS graph_score, max(tree_score) AS tree_score, max(passages)::BIGINT AS passages, bool_or(g) AS g FROM (SELECT * FROM f UNION ALL SELECT * FROM f WHERE passages > 0) GROUP BY name)
        SELECT name, CASE WHEN g AND passages > 0 THEN 'HIGH' WHEN g OR passages > 0 THEN 'MEDIUM' ELSE 'LOW' END AS confidence_level, passages, round(0.6 * graph_score + 0.4 * tree_score, 4) AS final_score FROM m""",
    "relation_strength": f"WITH {_E} SELECT 'typed' AS strength, rel, count(*) AS n FROM edges GROUP BY rel",
}
