"""Relations, the graph of mentions, vectors, stored indexes, fusion by page and the answering steps, and the SQL they are checked against."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.functions import text as T
from docmill.operators import agent, extraction, fusion, graph, retrieval, state, vectors
from docmill.operators import entities as E
from docmill.operators.entities import graph_label
from docmill.plans import entity_queries as EQ
from docmill.plans import graph_queries as GQ
from docmill.plans.retrieval_queries import QUESTION, bm25, lines
from docmill.plans.text_queries import NODES, _nodes
from docmill.session import checkpoint_dir, materialize, table
from docmill.sources import stores

SECOND = ["lease", "rent", "tenant", "court"]
ASKED_TYPES = "Which court ruled on the plot of land"
TYPES = ["Person", "Organization"]
CHUNK = ["case_id", "source_pdf", "source_page"]
KEPT_STATES = ["training", "ready"]


# relations ------------------------------------------------------------------------------------


def _asked_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a page in batches, with the types of their first mentions."""
    p = E.batches(EQ._pairs(spark, sf_dir), CHUNK)
    kinds = EQ._mentions(spark, sf_dir).select("mention_id", "schema_type")
    p = p.join(kinds.toDF("seq_a", "kind_a"), "seq_a").join(kinds.toDF("seq_b", "kind_b"), "seq_b")
    sure = F.round(0.6 + 0.05 * (F.length("name_a") % 8), 2)
    batch = F.concat_ws("|", "case_id", "source_pdf", F.col("source_page").cast("int").cast("string"), F.col("batch_no").cast("string"))
    return p.select("case_id", "source_pdf", batch.alias("batch_no"), "pair_id", "name_a", "name_b", "kind_a", "kind_b", sure.alias("confidence"), "seq_a")


def relation_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is asked for each batch of pairs."""
    p = _asked_pairs(spark, sf_dir).select("batch_no", "pair_id", "name_a", "name_b", "kind_a", "kind_b", "confidence")
    return extraction.ask(p, ["batch_no"]).select("batch_no", F.md5("prompt").alias("prompt_hash"))


def _relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = materialize(_asked_pairs(spark, sf_dir))
    replies = extraction.ask(p.select("batch_no", "pair_id", "name_a", "name_b", "kind_a", "kind_b", "confidence"), ["batch_no"])
    return extraction.parse_relations(replies, p.drop("confidence"), ("case_id", "source_pdf", "seq_a"))


def relation_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the replies say: null relations and low confidences dropped, turned pairs turned back."""
    r = _relations(spark, sf_dir)
    return r.groupBy("case_id", "src", "rel", "dst").agg(F.count("*").alias("replies"), F.max("confidence").alias("confidence"))


def _name_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = EQ._mentions(spark, sf_dir).where("case_id is not null and canonical_name is not null")
    return m.select("case_id", F.col("canonical_name").alias("node"), graph_label(F.col("schema_type")).alias("label")).distinct()


def _typed_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _relations(spark, sf_dir).select("case_id", "src", "rel", "dst", "confidence", F.col("source_pdf").alias("source"), F.col("seq_a").alias("seq"))
    return graph.connect(r, _name_nodes(spark, sf_dir))


def edges_connected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations upserted into edges between the nodes of their case."""
    return _typed_edges(spark, sf_dir)


def kge_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triples to train on: typed relations and shared pages without those that only stand together."""
    typed = _typed_edges(spark, sf_dir).select("case_id", "src", "rel", "dst").distinct()
    pages = GQ.graph_edges(spark, sf_dir).select("case_id", "src", F.lit("CO_OCCURS").alias("rel"), "dst")
    return typed.unionByName(pages).where(~F.col("rel").isin(graph.WEAK)).groupBy("case_id", "rel").agg(F.count("*").alias("triples"))


def kge_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense numbers of the relations of each case, in order of name; a case has a handful of them."""
    from pyspark.sql.window import Window

    r = _typed_edges(spark, sf_dir).select("case_id", "rel").distinct()
    return r.withColumn("idx", F.row_number().over(Window.partitionBy("case_id").orderBy("rel")) - 1)


# the graph of mentions ---------------------------------------------------------------------------


def _page_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return GQ._page_nodes(spark, sf_dir), GQ._page_edges(spark, sf_dir)


def _first_nodes(nodes: DataFrame) -> DataFrame:
    """Seeds for the checks: the names of the five earliest mentions."""
    return nodes.groupBy("node").agg(F.min("mention_id").alias("first")).orderBy("first", "node").limit(5).select("node")


def seed_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of the types that the question's keywords stand for: three of each, the earliest first, until there are five."""
    return graph.type_seeds(GQ._page_nodes(spark, sf_dir), ASKED_TYPES, "mention_id")


def type_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _name_nodes(spark, sf_dir).groupBy("case_id", "label").agg(F.count("*").alias("names"), F.min("node").alias("first_name"))


def traverse_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Persons and organizations within two hops, the 200 of the highest degree and the seeds."""
    nodes, edges = _page_graph(spark, sf_dir)
    seeds = materialize(_first_nodes(nodes))
    return graph.within(nodes.select("node", "label"), edges, seeds, 2, TYPES).select("node", "label", "degree")


def nodes_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _page_graph(spark, sf_dir)
    return graph.by_name(nodes.select("node", "label", "confidence"), edges, _first_nodes(nodes)).select("node", "label", F.round("confidence", 4).alias("confidence"), "degree")


def graph_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.counts(_name_nodes(spark, sf_dir), GQ.graph_edges(spark, sf_dir))


def case_cleared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes and edges that are left when the case with the most nodes is deleted."""
    n = materialize(_name_nodes(spark, sf_dir))
    gone = n.groupBy("case_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "case_id").limit(1)
    left, edges = state.without(n, gone, ["case_id"]), state.without(GQ.graph_edges(spark, sf_dir), gone, ["case_id"])
    return left.groupBy("case_id").agg(F.count("*").alias("nodes")).join(edges.groupBy("case_id").agg(F.count("*").alias("edges")), "case_id", "left").withColumn("edges", F.coalesce("edges", F.lit(0)))


def cross_case_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the name that stands in most cases is met beside its first case."""
    n = materialize(_name_nodes(spark, sf_dir).withColumnRenamed("node", "name"))
    r = n.groupBy("name").agg(F.count_distinct("case_id").alias("n"), F.min("case_id").alias("first")).orderBy(F.desc("n"), "name").first()
    return graph.cross_case(n, r.name, r.first) if r else n.limit(0)


def graph_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search of one hop that is not sufficient, gone on with from the nearest vectors; customers have the vectors of their number."""
    nodes = materialize(GQ._nodes(spark, sf_dir).select("node", F.translate("node", "#", " ").alias("name"), "label", F.lit("").alias("text"), "confidence"))
    seeds = nodes.where(F.col("node").isin(*_ASKED_CUSTOMERS)).select("node")
    near = _nearest_names(spark, sf_dir).select("node", "similarity")
    scored, triples, escalated = graph.search(nodes, materialize(GQ._edges(spark, sf_dir)), GQ.QUESTION_NAMES, seeds, near, 20, 1)
    n = triples.agg(F.count("*").alias("triples"))
    return scored.crossJoin(F.broadcast(n)).select("node", "node_score", "triples", F.lit(escalated).alias("escalated"))


_ASKED_CUSTOMERS = ["Customer#000000042", "Customer#000000007"]


# vectors ---------------------------------------------------------------------------------------


def _customer_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, e = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("node")), table(spark, sf_dir, "embeddings")
    return c.join(e, c["c_custkey"] == e["vec_id"]).select("c_custkey", "node", "embedding")


def _nearest_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _customer_vectors(spark, sf_dir)
    seeds = rows.where(F.col("node").isin(*_ASKED_CUSTOMERS)).orderBy("c_custkey").limit(graph.SEEDS).select("node")
    return vectors.nearest_to(rows, "node", "embedding", vectors.mean_vector(rows, "node", "embedding", seeds), 10)


def vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The names nearest to the mean of the vectors of the names that were asked for."""
    return _nearest_names(spark, sf_dir)


def node_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "customer").select(F.col("c_name").alias("node"))
    return vectors.attach(n, _customer_vectors(spark, sf_dir), "node", "embedding", "RotatE").select("node", "dims", "model", F.round(F.element_at("embedding", 1).cast("double"), 5).alias("first"))


def kge_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of each case after a training is started, and when it ends with the typed edges that it has."""
    c = table(spark, sf_dir, "cases").select("case_id", F.coalesce("kge_status", F.lit("not_started")).alias("status"))
    t = EQ._mentions(spark, sf_dir).where("case_id is not null").groupBy("case_id").agg(F.count("*").alias("triples"))
    started = c.join(t, "case_id", "left").withColumn("started", vectors.start_training(F.col("status")))
    return started.select("case_id", "status", "started", vectors.end_training(F.col("started"), F.coalesce("triples", F.lit(0))).alias("ended"))


def index_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.index_info(table(spark, sf_dir, "embeddings"), "embedding")


# stores ----------------------------------------------------------------------------------------


def bm25_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best passages from an index written before, of which the tokens of the question are read."""
    path = f"{checkpoint_dir(spark)}/index/{uuid4().hex}"
    stores.write_index(table(spark, sf_dir, "passages"), "passage_id", "text", path)
    return retrieval.top(stores.search_index(spark, path, "passage_id", QUESTION).select("passage_id", F.round("score", 6).alias("score")), "passage_id", 20)


def tree_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees written as JSON, read again with their schema, a row for each node."""
    path = f"{checkpoint_dir(spark)}/trees/{uuid4().hex}"
    stores.write_json(stores.trees(_nodes(spark, sf_dir)), path)
    n = stores.node_map(stores.read_json(spark, path, stores.TREE))
    return n.select("case_id", "doc_id", "node_id", "parent_id", "level", "page_num", "title", F.md5("content").alias("content_hash"))


# fusion and answers --------------------------------------------------------------------------------


def _fusion(spark: SparkSession, sf_dir: str, question: list[str], k: int = 20) -> tuple[DataFrame, DataFrame]:
    """The 50 most mentioned persons and organizations, and the best passages of a question."""
    p = table(spark, sf_dir, "passages")
    top = retrieval.top(retrieval.score(p, "passage_id", "text", question).select("passage_id", F.round("score", 6).alias("score")), "passage_id", k)
    page = F.when(~F.isnan(F.col("page_number").cast("double")), F.col("page_number").cast("int"))
    cite = retrieval.citation(page, F.col("section_title"), F.col("source_pdf"))
    found = top.join(p, "passage_id").select(F.col("passage_id").alias("key"), page.alias("page"), "score", "text", cite.alias("citation"), retrieval.relevant_lines(F.col("text"), list(dict.fromkeys(question))).alias("lines"))
    m = EQ._mentions(spark, sf_dir).where("canonical_name is not null and schema_type in ('Organization', 'Person')")
    nodes = m.groupBy(F.col("canonical_name").alias("name")).agg(F.min("schema_type").alias("schema_type"), F.round(F.count("*") / (F.count("*") + 10.0), 4).alias("graph_score")).orderBy(F.desc("graph_score"), "name").limit(50)
    return nodes, found


def _fused(spark: SparkSession, sf_dir: str, question: list[str]) -> DataFrame:
    return fusion.fuse_pages(*[materialize(x) for x in _fusion(spark, sf_dir, question)])


def _shown(fused: DataFrame) -> DataFrame:
    return fused.select("name", "confidence_level", F.size("passages").alias("n_passages"), F.round("final_score", 4).alias("final_score"), F.array_join(F.array_sort("citations"), "; ").alias("citations"))


def fused_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes with the passages that mention them, and pages that mention none."""
    return _shown(_fused(spark, sf_dir, QUESTION))


def fused_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The places of the results; a bounded number of rows."""
    from pyspark.sql.window import Window

    return _fused(spark, sf_dir, QUESTION).select("name", F.row_number().over(Window.orderBy(*fusion.order_by_level())).alias("place"))


def merged_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The results of two questions as one."""
    return _shown(fusion.merge_pages(materialize(_fused(spark, sf_dir, QUESTION)), _fused(spark, sf_dir, SECOND)))


def _shared_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return GQ.graph_edges(spark, sf_dir).select("src", F.lit("SHARES_PAGE").alias("rel"), "dst").distinct()


def _grounded(spark: SparkSession, sf_dir: str, passages: DataFrame) -> DataFrame:
    e = materialize(_shared_edges(spark, sf_dir))
    names = e.select(F.col("src").alias("node")).unionByName(e.select(F.col("dst").alias("node")))
    return agent.grounded(passages, names, e)


def grounded_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of the names that the best passages mention, with the passage's citation."""
    return _grounded(spark, sf_dir, materialize(_fusion(spark, sf_dir, QUESTION)[1]))


def merged_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grounded edges of two questions, each once with the citation of the first."""
    one, two = (_grounded(spark, sf_dir, materialize(_fusion(spark, sf_dir, q)[1])) for q in (QUESTION, SECOND))
    return fusion.merge_triples(one, two)


def prompt_rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole context of an answer as text."""
    nodes, passages = (materialize(x) for x in _fusion(spark, sf_dir, QUESTION))
    fused = materialize(fusion.fuse_pages(nodes, passages))
    names = fused.where("graph").select(F.col("name").alias("node"))
    triples = graph.subgraph(_shared_edges(spark, sf_dir), names).select("src", "rel", "dst")
    return fusion.prompt_text(" ".join(QUESTION), fused, triples, _grounded(spark, sf_dir, passages))


def sufficiency_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether typed and grounded triples are enough; where they are not, what would be expanded."""
    nodes, passages = (materialize(x) for x in _fusion(spark, sf_dir, QUESTION))
    fused = materialize(fusion.fuse_pages(nodes, passages))
    pages = GQ.graph_edges(spark, sf_dir).select("src", F.lit("CO_OCCURS").alias("rel"), "dst")
    typed = GQ._edges(spark, sf_dir).select("src", "rel", "dst")
    return agent.sufficiency_gate(pages.unionByName(typed), _grounded(spark, sf_dir, passages), fused)


def fast_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each question class whether the sure results of the question suffice at once."""
    sure = _fused(spark, sf_dir, QUESTION).agg((F.count_if(F.col("confidence_level") == "HIGH") >= agent.FAST).alias("enough"))
    kinds = spark.createDataFrame([("FACT",), ("RELATIONSHIP",), ("COMPLEX",)], "query_type string")
    return kinds.crossJoin(sure).select("query_type", ((F.col("query_type") == "FACT") & F.col("enough")).alias("fast"))


def _search_of(spark: SparkSession, sf_dir: str):
    def search(tokens: list[str]) -> tuple[DataFrame, DataFrame]:
        nodes, passages = _fusion(spark, sf_dir, tokens)
        return materialize(nodes), materialize(passages)

    return search


def multi_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The loop of an answer: at most three expansions by the best names, until more than 40 results are sure."""
    def search(tokens: list[str]) -> tuple[DataFrame, DataFrame]:
        nodes, passages = _fusion(spark, sf_dir, tokens)
        return materialize(nodes.drop("schema_type")), materialize(passages)

    fused, taken = agent.answer(search, list(dict.fromkeys(QUESTION)), GQ.graph_edges(spark, sf_dir), enough=lambda f: f.where("confidence_level = 'HIGH'").count() > 40)
    return fused.select("name", "confidence_level", "passages", F.round("final_score", 4).alias("final_score"), F.lit(taken).alias("hops"))


def deep_research(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a report rests on after three forced expansions."""
    fused, taken = agent.deep_research(_search_of(spark, sf_dir), list(dict.fromkeys(QUESTION)))
    return _shown(fused).withColumn("hops", F.lit(taken))


def document_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages that an answer cites."""
    return fusion.document_citations(_fused(spark, sf_dir, QUESTION)).select("key", "page", "citation")


QUERIES = {
    f.__name__: f
    for f in (
        relation_prompts, relation_rows, edges_connected, kge_triples, kge_relations, seed_keywords, type_names, traverse_types, nodes_by_name, graph_counts, case_cleared, cross_case_lookup, graph_search, vector_search, node_vectors, kge_status,
        index_info, bm25_stored, tree_export, fused_pages, fused_ranking, merged_pages, grounded_triples, merged_triples, prompt_rendered, sufficiency_gate, fast_path, multi_hop, deep_research, document_citations,
    )
}

# SQL ---------------------------------------------------------------------------------------------

_FIRST = EQ._FIRST
_ASK = f"""{_FIRST}, nn AS (SELECT *, row_number() OVER (PARTITION BY case_id, source_pdf, source_page ORDER BY seq_a, seq_b) - 1 AS k FROM p),
    kd AS (SELECT mention_id, schema_type FROM {EQ.MENTIONS}),
    ask AS (SELECT nn.*, concat_ws('|', case_id, source_pdf, CAST(source_page AS VARCHAR), CAST(k // 10 AS VARCHAR)) AS batch_no, k % 10 AS pair_id, x.schema_type AS kind_a, y.schema_type AS kind_b, CAST(round(0.6 + 0.05 * (length(name_a) % 8), 2) AS DOUBLE) AS confidence
      FROM nn JOIN kd x ON x.mention_id = seq_a JOIN kd y ON y.mention_id = seq_b)"""
_KNOWN = "\n".join(f"{k}: {', '.join(v)}" for k, v in extraction.RELATIONS.items())
_SAID = f"""{_ASK}, sd AS (SELECT *, CASE WHEN (kind_a = 'Court') <> (kind_b = 'Court') THEN 'ORDERED_BY' WHEN kind_a = 'Person' AND kind_b = 'Organization' THEN 'MEMBER_OF' WHEN kind_a = 'Organization' AND kind_b = 'Organization' THEN 'PARTNER_OF' END AS rel, kind_a = 'Court' AS back FROM ask),
    rl AS (SELECT case_id, source_pdf, seq_a, CASE WHEN back THEN name_b ELSE name_a END AS src, rel, CASE WHEN back THEN name_a ELSE name_b END AS dst, confidence FROM sd WHERE rel IS NOT NULL AND confidence >= 0.7)"""
_NM = f"nm AS (SELECT DISTINCT case_id, canonical_name AS node, CASE WHEN schema_type IN ({EQ._list(E.LABELS)}) THEN schema_type ELSE 'Entity' END AS label FROM {EQ.MENTIONS} WHERE case_id IS NOT NULL AND canonical_name IS NOT NULL)"
_TYPED = f"""{_SAID}, {_NM}, ce AS (SELECT case_id, src, rel, dst, max(confidence) AS confidence, first(source_pdf ORDER BY seq_a) AS source FROM rl GROUP BY 1, 2, 3, 4),
    te AS (SELECT ce.case_id, src, a.label AS src_label, rel, dst, b.label AS dst_label, confidence, source FROM ce JOIN nm a ON a.case_id = ce.case_id AND a.node = src JOIN nm b ON b.case_id = ce.case_id AND b.node = dst)"""
_PN = f"""pn AS (SELECT case_id || '|' || canonical_name AS node, CASE WHEN schema_type IN ({EQ._list(E.LABELS)}) THEN schema_type ELSE 'Entity' END AS label, min(mention_id) AS mention_id, max(confidence) AS confidence FROM {EQ.MENTIONS} WHERE case_id IS NOT NULL AND canonical_name IS NOT NULL GROUP BY 1, 2),
    pe AS (SELECT DISTINCT case_id || '|' || least(name_a, name_b) AS src, case_id || '|' || greatest(name_a, name_b) AS dst FROM p),
    fs AS (SELECT node FROM pn GROUP BY node ORDER BY min(mention_id), node LIMIT 5), pd AS (SELECT node, count(*) AS degree FROM (SELECT src AS node FROM pe UNION ALL SELECT dst FROM pe WHERE src <> dst) GROUP BY node)"""
_TYPE_LIST = graph.asked_types(ASKED_TYPES)
_EDGES = f"""ge AS (SELECT case_id, least(name_a, name_b) AS src, greatest(name_a, name_b) AS dst FROM p GROUP BY 1, 2, 3)"""
_MEAN = f"""cv AS (SELECT c_custkey, c_name AS node, CAST(embedding AS DOUBLE[]) AS v FROM customer JOIN embeddings ON vec_id = c_custkey), cu AS (SELECT *, sqrt(list_dot_product(v, v)) AS norm FROM cv),
    mv AS (SELECT list(x ORDER BY pos) AS q FROM (SELECT pos, avg(v[pos]) AS x FROM (SELECT v, unnest(range(1, len(v) + 1)) AS pos FROM cv WHERE node IN ({EQ._list(_ASKED_CUSTOMERS)}) ) GROUP BY pos)),
    nv AS (SELECT node, round(list_dot_product(v, q) / norm / sqrt(list_dot_product(q, q)), 6) AS similarity FROM cu, mv ORDER BY similarity DESC, node LIMIT 10)"""


def _score_sql(seeds: str, similar: bool) -> str:
    rel = "coalesce(similarity, rel)" if similar else "rel"
    return f"""(SELECT j.node, round(sum(0.5 * {rel} + 0.3 * degree / most + 0.2 * coalesce(nullif(confidence, 0), 0.5)) / sqrt(count(*) + 1), 4) AS node_score FROM j JOIN d ON d.node = j.node LEFT JOIN nv ON nv.node = j.node,
      (SELECT greatest(max(degree), 1) AS most FROM d WHERE node IN (SELECT node FROM {seeds}) OR node IN (SELECT dst FROM y WHERE src IN (SELECT node FROM {seeds})))
      WHERE j.node IN (SELECT node FROM {seeds}) OR j.node IN (SELECT dst FROM y WHERE src IN (SELECT node FROM {seeds})) GROUP BY j.node ORDER BY node_score DESC, j.node LIMIT 20)"""


_NODES_TOP = f"""n AS (SELECT canonical_name AS name, min(schema_type) AS schema_type, round(count(*) / (count(*) + 10.0), 4) AS graph_score FROM {EQ.MENTIONS} WHERE canonical_name IS NOT NULL AND schema_type IN ('Organization', 'Person') GROUP BY 1 ORDER BY graph_score DESC, name LIMIT 50)"""
_PARTS = f"list_filter(regexp_extract_all(replace(lower(name), '_', ' '), '[^{T.SPACE}]+'), lambda w: length(w) > 3)"


def _fuse_sql(tag: str, question: list[str]) -> str:
    terms = list(dict.fromkeys(question))
    page = "CASE WHEN page_number IS NOT NULL AND NOT isnan(CAST(page_number AS DOUBLE)) THEN CAST(page_number AS INT) END"
    return f"""s{tag} AS (SELECT * FROM ({bm25(question)}) WHERE score > 0 ORDER BY score DESC, passage_id LIMIT 20),
    p{tag} AS (SELECT s.passage_id AS key, {page} AS page, score, text, lower(text) AS low, concat_ws(', ', 'Page ' || {page}, CASE WHEN section_title <> '' THEN 'Section: ' || section_title END, source_pdf) AS citation, {lines(terms)} AS lines FROM s{tag} s JOIN passages px ON px.passage_id = s.passage_id),
    h{tag} AS (SELECT n.name, schema_type, graph_score, key, page, score, text, citation, lines FROM n LEFT JOIN p{tag} ON len(list_filter({_PARTS}, lambda w: contains(low, w))) > 0),
    a{tag} AS (SELECT 'passage_p' || coalesce(CAST(page AS VARCHAR), 'None') AS name, key, page, score, text, citation, lines FROM p{tag} WHERE key NOT IN (SELECT key FROM h{tag} WHERE key IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY page ORDER BY score, key DESC) = 1),
    r{tag} AS (SELECT name, schema_type, graph_score, true AS graph, key, page, score, text, citation, lines FROM h{tag} UNION ALL SELECT name, NULL, 0, false, key, page, score, text, citation, lines FROM a{tag})"""


def _shown_sql(rows: str) -> str:
    return f"""f AS (SELECT name, max(schema_type) AS schema_type, max(graph_score) AS graph_score, coalesce(max(score), 0) AS tree_score, bool_or(graph) AS graph, CAST(count(DISTINCT key) AS INT) AS n_passages, coalesce(string_agg(DISTINCT citation, '; ' ORDER BY citation), '') AS citations FROM {rows} GROUP BY name),
    o AS (SELECT *, CASE WHEN graph AND n_passages > 0 THEN 'HIGH' WHEN graph OR n_passages > 0 THEN 'MEDIUM' ELSE 'LOW' END AS confidence_level, 0.6 * graph_score + 0.4 * tree_score AS final FROM f)"""


_SHOW = "SELECT name, confidence_level, n_passages, round(final, 4) AS final_score, citations FROM o"
_PLACE = "row_number() OVER (ORDER BY CASE confidence_level WHEN 'HIGH' THEN 0 WHEN 'MEDIUM' THEN 1 ELSE 2 END, final DESC, name)"


def _grounded_sql(tag: str, passages: str) -> str:
    return f"""b{tag} AS (SELECT key, score, citation, low FROM {passages} ORDER BY score DESC, key LIMIT 5), m{tag} AS (SELECT DISTINCT key, score, citation, name FROM (SELECT DISTINCT unnest([src, dst]) AS name FROM se) x JOIN b{tag} ON len(list_filter({_PARTS}, lambda w: contains(low, w))) > 0 QUALIFY row_number() OVER (PARTITION BY key ORDER BY name) <= 10),
    l{tag} AS (SELECT DISTINCT key, score, citation, src, rel, dst FROM se JOIN m{tag} ON name = src OR name = dst), k{tag} AS (SELECT * FROM l{tag} QUALIFY row_number() OVER (PARTITION BY key ORDER BY src, rel, dst) <= 50),
    g{tag} AS (SELECT src, rel, dst, first(citation ORDER BY score DESC, key) AS citation FROM k{tag} GROUP BY 1, 2, 3 ORDER BY max(score) DESC, first(key ORDER BY score DESC, key), src, rel, dst LIMIT 30)"""


_SE = f"{_FIRST.replace('p AS (', 'pp AS (')}, se AS (SELECT DISTINCT least(name_a, name_b) AS src, 'SHARES_PAGE' AS rel, greatest(name_a, name_b) AS dst FROM pp)".replace("f AS (SELECT case_id", "ff AS (SELECT case_id").replace("FROM f a JOIN f b", "FROM ff a JOIN ff b")
_NL = "chr(10)"

SQL = {
    "relation_prompts": f"WITH {_ASK} SELECT batch_no, md5('Relations:' || {_NL} || '{_KNOWN}' || {_NL} || {_NL} || 'Pairs:' || {_NL} || string_agg(pair_id || '. ' || name_a || ' | ' || name_b, {_NL} ORDER BY pair_id)) AS prompt_hash FROM ask GROUP BY batch_no",
    "relation_rows": f"WITH {_SAID} SELECT case_id, src, rel, dst, count(*) AS replies, max(confidence) AS confidence FROM rl GROUP BY 1, 2, 3, 4",
    "edges_connected": f"WITH {_TYPED} SELECT * FROM te",
    "kge_triples": f"WITH {_TYPED} SELECT case_id, rel, count(*) AS triples FROM (SELECT DISTINCT case_id, src, rel, dst FROM te) GROUP BY 1, 2",
    "kge_relations": f"WITH {_TYPED} SELECT case_id, rel, row_number() OVER (PARTITION BY case_id ORDER BY rel) - 1 AS idx FROM (SELECT DISTINCT case_id, rel FROM te)",
    "seed_keywords": f"""WITH {_FIRST}, {_PN}, t AS (SELECT *, list_position([{EQ._list(_TYPE_LIST)}], label) AS place FROM pn WHERE label IN ({EQ._list(_TYPE_LIST)}) QUALIFY row_number() OVER (PARTITION BY label ORDER BY mention_id, node) <= 3)
        SELECT node FROM (SELECT node, min({{'p': place, 'm': mention_id}}) AS first FROM t GROUP BY node) ORDER BY first, node LIMIT 5""",
    "type_names": f"WITH {_NM} SELECT case_id, label, count(*) AS names, min(node) AS first_name FROM nm GROUP BY 1, 2",
    "traverse_types": f"""WITH {_FIRST}, {_PN}, y AS (SELECT src, dst FROM pe UNION SELECT dst, src FROM pe), h1 AS (SELECT DISTINCT dst AS node FROM y JOIN fs ON src = node), h2 AS (SELECT DISTINCT dst AS node FROM y JOIN h1 ON src = node),
        a AS (SELECT pn.node, label, coalesce(degree, 0) AS degree FROM pn LEFT JOIN pd ON pd.node = pn.node WHERE label IN ({EQ._list(TYPES)})), w AS (SELECT * FROM a WHERE node IN (SELECT node FROM fs UNION SELECT node FROM h1 UNION SELECT node FROM h2) ORDER BY degree DESC, node, label LIMIT 200)
        SELECT * FROM w UNION ALL SELECT * FROM a WHERE node IN (SELECT node FROM fs) AND node NOT IN (SELECT node FROM w)""",
    "nodes_by_name": f"WITH {_FIRST}, {_PN} SELECT pn.node, label, round(confidence, 4) AS confidence, coalesce(degree, 0) AS degree FROM pn LEFT JOIN pd ON pd.node = pn.node WHERE pn.node IN (SELECT node FROM fs)",
    "graph_counts": f"""WITH {_FIRST}, {_EDGES}, {_NM}, n AS (SELECT coalesce(case_id, 'all') AS case_id, coalesce(label, 'all') AS label, count(*) AS nodes FROM nm GROUP BY ROLLUP (case_id, label)), e AS (SELECT coalesce(case_id, 'all') AS case_id, count(*) AS edges FROM ge GROUP BY ROLLUP (case_id))
        SELECT n.case_id, label, nodes, CASE WHEN label = 'all' THEN coalesce(edges, 0) END AS edges FROM n LEFT JOIN e ON e.case_id = n.case_id""",
    "case_cleared": f"""WITH {_FIRST}, {_EDGES}, {_NM}, z AS (SELECT case_id FROM nm GROUP BY 1 ORDER BY count(*) DESC, case_id LIMIT 1), e AS (SELECT case_id, count(*) AS edges FROM ge GROUP BY 1)
        SELECT n.case_id, nodes, coalesce(edges, 0) AS edges FROM (SELECT case_id, count(*) AS nodes FROM nm GROUP BY 1) n LEFT JOIN e ON e.case_id = n.case_id WHERE n.case_id NOT IN (SELECT case_id FROM z)""",
    "cross_case_lookup": f"WITH {_NM}, t AS (SELECT node, min(case_id) AS first FROM nm GROUP BY 1 ORDER BY count(DISTINCT case_id) DESC, node LIMIT 1) SELECT case_id, nm.node AS name, label FROM nm JOIN t ON t.node = nm.node WHERE case_id <> first",
    "graph_search": f"""WITH {GQ._N}, {GQ._E}, {GQ._DEG}, {GQ._J}, {_MEAN}, y AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges), s1 AS (SELECT node FROM nodes WHERE node IN ({EQ._list(_ASKED_CUSTOMERS)})), c1 AS {_score_sql('s1', False)},
        t1 AS (SELECT DISTINCT src, rel, dst FROM edges WHERE src IN (SELECT node FROM c1) AND dst IN (SELECT node FROM c1)),
        ok AS (SELECT (SELECT count(*) FROM nodes WHERE node IN (SELECT node FROM c1)) >= 5 AND (SELECT count(*) FROM nodes WHERE node IN (SELECT node FROM c1) AND confidence >= 0.6) >= 2 AND (SELECT count(*) FROM t1) >= 1 AS enough),
        s2 AS (SELECT node FROM s1 UNION SELECT node FROM (SELECT node FROM nv ORDER BY similarity DESC, node LIMIT 5)), c2 AS {_score_sql('s2', True)}, t2 AS (SELECT DISTINCT src, rel, dst FROM edges WHERE src IN (SELECT node FROM c2) AND dst IN (SELECT node FROM c2)),
        u AS (SELECT node, node_score FROM (SELECT *, 0 AS o FROM c2 UNION ALL SELECT *, 1 FROM c1 WHERE node NOT IN (SELECT node FROM c2)) ORDER BY o, node_score DESC, node LIMIT 20)
        SELECT node, node_score, (SELECT count(*) FROM t1) AS triples, false AS escalated FROM c1, ok WHERE enough
        UNION ALL SELECT node, node_score, (SELECT count(*) FROM (SELECT * FROM t1 UNION SELECT * FROM t2)), true FROM u, ok WHERE NOT enough""",
    "vector_search": f"WITH {_MEAN} SELECT * FROM nv",
    "node_vectors": "SELECT c_name AS node, CAST(len(embedding) AS INT) AS dims, CASE WHEN embedding IS NOT NULL THEN 'RotatE' END AS model, round(CAST(embedding[1] AS DOUBLE), 5) AS first FROM customer LEFT JOIN embeddings ON vec_id = c_custkey",
    "kge_status": f"""WITH t AS (SELECT case_id, count(*) AS n FROM {EQ.MENTIONS} WHERE case_id IS NOT NULL GROUP BY 1), s AS (SELECT c.case_id, coalesce(kge_status, 'not_started') AS status, CASE WHEN kge_status IN ({EQ._list(KEPT_STATES)}) THEN kge_status ELSE 'training' END AS started, coalesce(n, 0) AS n FROM cases c LEFT JOIN t ON t.case_id = c.case_id)
        SELECT case_id, status, started, CASE WHEN started <> 'training' THEN started WHEN n >= 10 THEN 'ready' ELSE 'failed' END AS ended FROM s""",
    "index_info": "SELECT count(embedding) AS vectors, CAST(max(len(embedding)) AS INT) AS dims, min(len(embedding)) = max(len(embedding)) AS consistent FROM embeddings",
    "bm25_stored": f"SELECT * FROM ({bm25(QUESTION)}) WHERE score > 0 ORDER BY score DESC, passage_id LIMIT 20",
    "tree_export": f"SELECT case_id, doc_id, node_id, parent_id, level, page_num, title, md5(content) AS content_hash FROM {NODES}",
    "fused_pages": f"WITH {_NODES_TOP}, {_fuse_sql('1', QUESTION)}, {_shown_sql('r1')} {_SHOW}",
    "fused_ranking": f"WITH {_NODES_TOP}, {_fuse_sql('1', QUESTION)}, {_shown_sql('r1')} SELECT name, {_PLACE} AS place FROM o",
    "merged_pages": f"WITH {_NODES_TOP}, {_fuse_sql('1', QUESTION)}, {_fuse_sql('2', SECOND)}, {_shown_sql('(SELECT name, schema_type, graph_score, graph, key, score, citation FROM r1 UNION ALL SELECT name, schema_type, graph_score, graph, key, score, citation FROM r2)')} {_SHOW.replace('n_passages', 'n_passages')}",
    "grounded_triples": f"WITH {_SE}, {_NODES_TOP}, {_fuse_sql('1', QUESTION)}, {_grounded_sql('1', 'p1')} SELECT * FROM g1",
    "merged_triples": f"WITH {_SE}, {_NODES_TOP}, {_fuse_sql('1', QUESTION)}, {_fuse_sql('2', SECOND)}, {_grounded_sql('1', 'p1')}, {_grounded_sql('2', 'p2')} SELECT * FROM g1 UNION ALL SELECT * FROM g2 WHERE (src, rel, dst) NOT IN (SELECT (src, rel, dst) FROM g1)",
    "prompt_rendered": f"""WITH {_SE}, {_NODES_TOP}, {_fuse_sql('1', QUESTION)}, {_shown_sql('r1')}, {_grounded_sql('1', 'p1')},
        q AS (SELECT name, string_agg({_NL} || '  Document [' || citation || ']:' || array_to_string(list_transform(lines[1:5], lambda ql: {_NL} || '    "' || substring(ql, 1, 200) || '"'), '') || {_NL} || '  Page text:' || {_NL} || '    ' || substring(text, 1, 800), '' ORDER BY score DESC, key) AS docs
          FROM (SELECT * FROM r1 WHERE key IS NOT NULL QUALIFY row_number() OVER (PARTITION BY name ORDER BY score DESC, key) <= 3) GROUP BY name),
        ln AS (SELECT *, {_NL} || '[' || confidence_level || '] ' || o.name || CASE WHEN graph THEN {_NL} || '  Graph: ' || schema_type || printf(' (score: %.2f)', graph_score) ELSE '' END || coalesce(docs, '') AS line FROM o LEFT JOIN q ON q.name = o.name),
        rs AS (SELECT count(*) AS n, count(*) FILTER (WHERE confidence_level = 'HIGH') AS high, count(*) FILTER (WHERE confidence_level = 'MEDIUM') AS medium, string_agg(line, {_NL} ORDER BY CASE confidence_level WHEN 'HIGH' THEN 0 WHEN 'MEDIUM' THEN 1 ELSE 2 END, final DESC, ln.name) AS results FROM ln),
        tr AS (SELECT *, '  [typed] (' || src || ') --[' || rel || ']--> (' || dst || ')' AS t FROM se WHERE src IN (SELECT name FROM n) AND dst IN (SELECT name FROM n)),
        tt AS (SELECT (SELECT count(*) FROM tr) AS typed, coalesce(string_agg(t, {_NL} ORDER BY t), '') AS triples FROM (SELECT t FROM tr ORDER BY t LIMIT 30)),
        gg AS (SELECT coalesce(string_agg(t, {_NL} ORDER BY t), '') AS grounded FROM (SELECT '  [typed] (' || src || ') --[' || rel || ']--> (' || dst || ') grounded in ' || citation AS t FROM g1))
        SELECT 'Query: {' '.join(QUESTION)}' || {_NL} || {_NL} || 'Retrieved ' || n || ' relevant items (' || high || ' HIGH, ' || medium || ' MEDIUM)' || {_NL} || 'Graph triples: ' || typed || ' typed, 0 weak' || {_NL} || {_NL} || '=== GRAPH ===' || {_NL} || CASE WHEN triples <> '' THEN triples ELSE 'No direct relationships found.' END
          || {_NL} || {_NL} || '=== DOCUMENTS ===' || {_NL} || results || CASE WHEN grounded <> '' THEN {_NL} || {_NL} || '=== GROUNDED ===' || {_NL} || grounded ELSE '' END AS context FROM rs, tt, gg""",
    "sufficiency_gate": f"""WITH {_SE}, {GQ._E}, {_NODES_TOP}, {_fuse_sql('1', QUESTION)}, {_shown_sql('r1')}, {_grounded_sql('1', 'p1')}, c AS (SELECT (SELECT count(*) FROM (SELECT DISTINCT case_id, least(name_a, name_b), greatest(name_a, name_b) FROM pp)) AS weak, (SELECT count(*) FROM edges) AS typed, (SELECT count(*) FROM g1) AS grounded),
        x AS (SELECT weak + typed AS triples, typed, grounded, round((typed + grounded)::DOUBLE / greatest(weak + typed + grounded, 1), 6) AS typed_ratio FROM c)
        SELECT triples, typed, grounded, typed_ratio, typed_ratio >= 0.1 AS passes, CASE WHEN typed_ratio < 0.1 THEN (SELECT coalesce(string_agg(name, ';' ORDER BY name), '') FROM (SELECT name FROM o WHERE confidence_level = 'HIGH' ORDER BY final DESC, name LIMIT 4)) ELSE '' END AS expand FROM x""",
    "fast_path": f"WITH {_NODES_TOP}, {_fuse_sql('1', QUESTION)}, {_shown_sql('r1')} SELECT k AS query_type, k = 'FACT' AND (SELECT count(*) FROM o WHERE confidence_level = 'HIGH') >= {agent.FAST} AS fast FROM (VALUES ('FACT'), ('RELATIONSHIP'), ('COMPLEX')) t(k)",
    "document_citations": f"WITH {_NODES_TOP}, {_fuse_sql('1', QUESTION)} SELECT DISTINCT key, page, citation FROM r1 WHERE key IS NOT NULL AND page IS NOT NULL AND len(lines) > 0",
}
