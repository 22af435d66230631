from __future__ import annotations

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docmill.functions import text as T
from docmill.operators import entities, fusion, graph, resolution, retrieval, trees, vectors
from docmill.operators.components import connected_components
from docmill.plans import entity_queries


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v")).alias("x")).first().x


def test_canonical_names(spark):
    rows = [("Acme Pvt. Ltd.", "Organization", "acme"), ("14,27,26,992", "Amount", "142726992"), ("O'Neil, J.", "Person", "oneil_j"), (None, "Person", None)]
    got = spark.createDataFrame(rows, "t string, k string, w string").select("w", T.canonical_name(F.col("t"), F.col("k")).alias("g")).collect()
    assert all(r.g == r.w for r in got)


@pytest.mark.parametrize(("value", "want"), [("2nd-party of", "REL_2ND_PARTY_OF"), ("", "RELATED_TO"), (None, "RELATED_TO"), ("__a  b__", "A_B")])
def test_relation_type(spark, value, want):
    assert one(spark, T.relation_type, value) == want


def test_tokens(spark):
    assert one(spark, T.search_tokens, "Éléments d'art. ₹14,27,26,992 no. 5/2023, naïve-x -- a b.") == ["éléments", "art", "14,27,26,992", "no", "5/2023", "naïve-x"]
    assert sorted(one(spark, T.name_tokens, "Is MIDC the owner? (plot_D-105)")) == sorted(["midc", "owner?", "plot", "d-105"])
    assert one(spark, T.search_tokens, None) == []
    assert one(spark, T.words, " a b \n") == ["a", "b"]


@pytest.mark.parametrize(("n", "want"), [(0, 1), (300, 1), (301, 2), (570, 2), (571, 3), (840, 3), (841, 4)])
def test_chunk_counts(spark, n, want):
    got = one(spark, T.chunks, " ".join(f"w{i}" for i in range(n)))
    assert len(got) == want
    assert n == 0 or got[-1].words[-1] == f"w{n - 1}"


def test_clean_text_and_headings(spark):
    assert one(spark, T.clean_text, " a-\r\nb  \n\n\n\n c ") == "ab\n\nc"
    assert one(spark, T.to_markdown, "IN THE HIGH COURT\nFACTS\nLIST OF THINGS\n(A) One\n(a) two\nplain") == "# IN THE HIGH COURT\n## FACTS\n## LIST OF THINGS\n### (A) One\n#### (a) two\nplain"
    assert one(spark, T.clean_text, None) is None


def test_heading_tree(spark):
    text = "\n".join(["<!-- page:2 -->", "intro", "## A", "x", "<!-- page:3 -->", "y", "#### B", "### C", "# D"])
    docs = spark.createDataFrame([(1, text), (2, ""), (3, None)], "k int, t string")
    got = {(r.k, r.title): (r.parent_seq, r.page_num, r.content) for r in trees.heading_tree(docs, "k", "t").collect()}
    assert got[1, "Document"] == (None, 0, "intro")
    assert got[1, "A"] == (0, 2, "x\ny")
    assert got[1, "B"] == (1, 3, "") and got[1, "C"] == (1, 3, "") and got[1, "D"] == (0, 3, "")
    assert got[2, "Document"] == (None, 0, "") and (3, "Document") not in got


def test_heading_tree_parent_is_the_stack(spark):
    rng = random.Random(3)
    levels = [rng.randint(1, 4) for _ in range(60)]
    stack, want = [], []
    for i, level in enumerate(levels, 1):
        while stack and stack[-1][0] >= level:
            stack.pop()
        want.append(stack[-1][1] if stack else 0)
        stack.append((level, i))
    docs = spark.createDataFrame([(1, "\n".join("#" * k + f" h{i}" for i, k in enumerate(levels)))], "k int, t string")
    got = trees.heading_tree(docs, "k", "t").where("seq > 0").orderBy("seq").collect()
    assert [r.parent_seq for r in got] == want


def test_pages_and_sections(spark):
    nodes = spark.createDataFrame([("c", 1, 0, "A", "long enough text"), ("c", 1, 1, "B", "another long text"), ("c", 2, 2, "C", "short")], "k string, page int, ord int, title string, content string")
    got = trees.pages(nodes, ["k"], "ord", "page", "title", "content").collect()
    assert [(r.page, r.text, r.word_count) for r in got] == [(1, "A\n\nlong enough text\n\nB\n\nanother long text", 8)]
    pages = spark.createDataFrame([("c", 1, "FACTS\nx"), ("c", 2, "y"), ("c", 3, "1. Background Facts\nz")], "k string, page int, t string")
    got = sorted((r.title, r.start_page, r.end_page) for r in trees.sections(pages, ["k"], "page", "t").collect())
    assert got == [("1. Background Facts", 3, 3), ("FACTS", 1, 2)]


def test_bm25(spark):
    docs = spark.createDataFrame([(1, "a1 b1 a1"), (2, "b1 c1"), (3, "b1")], "k int, t string")
    score = lambda q: {r.k: round(r.score, 6) for r in retrieval.score(docs, "k", "t", q).collect()}
    assert score(["a1"]) == {1: 0.628708}
    assert score(["b1"]) == {1: -0.062875, 2: -0.077022, 3: -0.099383}
    assert score(["a1", "a1", "b1"]) == {1: 1.194542, 2: -0.077022, 3: -0.099383}
    assert retrieval.score(docs.limit(0), "k", "t", ["a1"]).count() == 0
    assert retrieval.score(docs, "k", "t", []).count() == 0


def test_snippets(spark):
    df = spark.createDataFrame([("b x\n\na x y\nz",)], "t string")
    r = df.select(retrieval.relevant_lines(F.col("t"), ["x", "y"]).alias("l"), retrieval.matched_terms(F.col("t"), ["x", "q"]).alias("m"), retrieval.citation(F.lit(3), F.lit("S"), F.lit("f.pdf")).alias("c")).first()
    assert (r.l, r.m, r.c) == (["a x y", "b x"], ["x"], "Page 3, Section: S, f.pdf")


def test_rejections(spark):
    rows = [("ab", 0.9, 1, "f", "name too short"), ("142726992", 0.9, 1, "f", "purely numeric"), ("abc", 0.49, 1, "f", "low confidence"), ("abc", 0.9, 0, "f", "missing page"), ("abc", 0.9, 1, "", "missing file"), ("etc", 0.9, 1, "f", "noise word"), ("abc", None, 1, "f", "low confidence"), ("abc", 0.5, 1, "f", None), (None, 0.9, 1, "f", "name too short")]
    got = spark.createDataFrame(rows, "n string, c double, p int, f string, w string").select("w", entities.rejection(F.col("n"), F.col("c"), F.col("p"), F.col("f")).alias("g")).collect()
    assert all(r.g == r.w for r in got)


def test_pairs_and_batches(spark):
    rows = [(1, "a", "Person", 1), (1, "b", "Court", 2), (1, "a", "Person", 3), (1, "d", "Date", 4)]
    m = spark.createDataFrame(rows, "chunk int, n string, k string, seq int")
    p = entities.pairs(m, ["chunk"], "n", "k", "seq")
    assert [(r.name_a, r.name_b) for r in p.collect()] == [("a", "b")]
    many = spark.createDataFrame([(1, f"n{i}", "Person", i) for i in range(6)], "chunk int, n string, k string, seq int")
    got = entities.batches(entities.pairs(many, ["chunk"], "n", "k", "seq"), ["chunk"]).groupBy("batch_no").count().collect()
    assert sorted((r.batch_no, r["count"]) for r in got) == [(0, 10), (1, 5)]


def test_shared_sentences(spark):
    text = "Ann came. Bob sat. Nobody spoke. Ann met Bob. Then left. Ann slept."
    df = spark.createDataFrame([(text, "ann", "bob"), ("Nothing here.", "ann", "bob")], "t string, a string, b string")
    got = [r.s for r in df.select(entities.shared_sentences(F.col("t"), F.col("a"), F.col("b")).alias("s")).collect()]
    assert got[0] == ["Ann came.", "Bob sat.", "Nobody spoke.", "Ann met Bob."]
    assert got[1] == ["Nothing here."]


def test_pairs_of_a_page_are_not_shuffled(spark):
    """Evidence is found beside the names of a page; only mentions are ever moved."""
    rows = [(1, "Ann", "Ann came."), (2, "Bob", "Ann met Bob."), (3, "Cy", None), (4, "Ann", "Bob and Ann sat."), (5, "Dee", "Nobody."), (None, "Bob", None)]
    m = spark.createDataFrame([(i, "c", "f", 1, n, "Person", n, t) for i, n, t in rows], "mention_id long, case_id string, source_pdf string, source_page int, canonical_name string, schema_type string, text string, context string")
    df = entity_queries._evidence(m)
    got = {(r.name_a, r.name_b): (r.mention_id, r.sentences) for r in df.collect()}
    assert got == {
        ("Ann", "Bob"): (2, "Ann met Bob."), ("Ann", "Cy"): (1, "Ann came."), ("Ann", "Dee"): (1, "Ann came."),
        ("Bob", "Cy"): (2, "Ann met Bob."), ("Bob", "Dee"): (2, "Ann met Bob."), ("Cy", "Dee"): (1, "Ann came."),
    }
    moved = [x for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in x]
    assert moved and not any("seq_" in x or "name_a" in x for x in moved)


def test_first_best_and_latest(spark):
    df = spark.createDataFrame([("k", 0.5, 2, "b"), ("k", 0.5, 1, "a"), ("k", 0.2, 0, "c")], "key string, conf double, seq int, v string")
    assert entities.first_best(df, ["key"], "conf", "seq").first().v == "a"
    assert entities.latest(df, "key", "seq").first().v == "b"
    assert entities.latest(df.limit(0), "key", "seq").count() == 0


def test_components_match_union_find(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(i, i + 1) for i in range(100, 140)] + [(3, 3), (None, 2)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_graph(spark):
    e = spark.createDataFrame([("a", "R", "b"), ("b", "R", "c"), ("c", "CO_OCCURS", "d"), ("d", "R", "d")], "src string, rel string, dst string")
    n = spark.createDataFrame([("a",), ("b",), ("c",), ("d",), ("z",)], "node string")
    assert {r.node: r.degree for r in graph.degree(n, e).collect()} == {"a": 1, "b": 2, "c": 2, "d": 2, "z": 0}
    seeds = spark.createDataFrame([("a",)], "node string")
    assert {r.node: r.hop for r in graph.traverse(e, seeds, 2).collect()} == {"a": 0, "b": 1, "c": 2}
    assert graph.subgraph(e, spark.createDataFrame([("a",), ("b",)], "node string")).count() == 1
    assert {(r.src, r.dst) for r in graph.touching(e, spark.createDataFrame([("c",)], "node string")).collect()} == {("b", "c")}
    aliases = spark.createDataFrame([("b", "a")], "old string, canonical string")
    assert {tuple(r) for r in graph.merge_aliases(e, aliases).collect()} == {("a", "RELATED_TO", "c"), ("c", "CO_OCCURS", "d"), ("d", "R", "d")}
    up = spark.createDataFrame([("k", 1, "first", 0.2), ("k", 2, "second", 0.9)], "k string, seq int, v string, conf double")
    assert tuple(graph.upsert(up, ["k"], "conf", "seq").select("v", "conf").first()) == ("first", 0.9)


def test_node_scores(spark):
    rows = spark.createDataFrame([("x", 0.5, 4, 0.9)], "node string, rel double, degree int, confidence double")
    assert graph.node_scores(rows, 5).first().node_score == 0.5162
    rows = rows.unionByName(spark.createDataFrame([("x", 0.25, 4, 0.0)], rows.schema))
    assert graph.node_scores(rows, 5).first().node_score == 0.7246
    nodes = spark.createDataFrame([("n", 0.7)] * 3 + [("n", 0.1)], "node string, confidence double")
    r = graph.sufficiency(nodes, spark.createDataFrame([(1,), (2,)], "t int")).first()
    assert (r.is_sufficient, r.reason) == (False, "node count")


def test_resolution(spark):
    rows = spark.createDataFrame([("g", "midc_ltd", 0.9, 1), ("g", "midc", 0.6, 2), ("g", "midx", 0.8, 3)], "g string, n string, c double, s int")
    assert resolution.pick_canonical(rows, ["g"], "n", "c", "s").first().canonical == "midx"
    votes = [("1", "YES", 0.9), ("1", "YES", 0.85), ("2", "NO", 0.3), ("2", "NO", 0.2), ("3", "YES", 0.9), ("3", "NO", 0.2), ("4", "YES", 0.84), ("4", "YES", 0.9), ("5", None, None)]
    got = {r.g: r.resolution for r in resolution.decide(spark.createDataFrame(votes, "g string, vote string, confidence double"), ["g"]).collect()}
    assert got == {"1": "AUTO_MERGE", "2": "AUTO_KEEP", "3": "NEEDS_REVIEW", "4": "NEEDS_REVIEW", "5": "NEEDS_REVIEW"}


def test_registry_match(spark):
    m = spark.createDataFrame([("midc", "c"), ("union_bank", "c"), ("the_authority", "c"), ("exact", "c"), (" ", "c"), ("x", "none")], "name string, block string")
    e = spark.createDataFrame([("c", 1, "midc_ltd"), ("c", 2, "union_bank_of_india"), ("c", 3, "authority"), ("c", 4, "exact")], "block string, seq int, entry string")
    got = {r.name: (r.score, r.status) for r in resolution.match_registry(m, e).collect()}
    assert got["midc"] == (0.6667, "REVIEW") and got["union_bank"] == (0.6897, "REVIEW") and got["the_authority"] == (0.8182, "REVIEW")
    assert got["exact"] == (1.0, "AUTO") and got["x"] == (0.0, "NEW") and len(got) == 5


def test_similar_pairs_match_brute_force(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(60, 8))
    v[30:40] = v[:10] + rng.normal(scale=0.05, size=(10, 8))
    rows = [(i, i % 2, [float(x) for x in v[i]]) for i in range(60)] + [(99, 0, None)]
    df = spark.createDataFrame(rows, "id long, b int, v array<double>")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = {(i, j) for i in range(60) for j in range(i + 1, 60) if i % 2 == j % 2 and u[i] @ u[j] >= 0.8}
    for side in (512, 7):
        assert {(r.a, r.b) for r in vectors.similar_pairs(df, "id", "b", "v", 0.8, side).collect()} == want


def test_fusion(spark):
    nodes = spark.createDataFrame([("acme_works", 0.9), ("zz_other", 0.5)], "name string, graph_score double")
    passages = spark.createDataFrame([(1, 1, 2.0, "The acme plant"), (2, 1, 1.0, "Nothing")], "key int, page int, score double, text string")
    got = {r.name: (r.confidence_level, round(r.final_score, 4)) for r in fusion.fuse(nodes, passages).collect()}
    assert got == {"acme_works": ("HIGH", 1.34), "zz_other": ("MEDIUM", 0.3), "passage_2": ("MEDIUM", 0.4)}
    kinds = spark.createDataFrame([("What is the order?",), ("Who paid?",), ("How are A and B linked?",)], "q string").select(fusion.question_class(F.col("q")).alias("k")).collect()
    assert [r.k for r in kinds] == ["COMPLEX", "FACT", "RELATIONSHIP"]


def test_graph_embeddings(spark):
    e = spark.createDataFrame([("c", f"n{i}", "R", f"n{(i + 1) % 12}") for i in range(12)] + [("d", "a", "R", "b")], "case string, src string, rel string, dst string")
    got = vectors.train_graph_embeddings(e, "case").collect()
    assert {r.case for r in got} == {"c"} and len(got) == 12 and all(abs(np.linalg.norm(r.vec) - 1) < 1e-3 for r in got)


def test_extraction(spark):
    from docmill.operators import extraction

    df = spark.createDataFrame([(1, "On 3 May 2018 Acton Foods LLP paid Rs. 4,500 under WP/12/2010."), (2, None), (3, "")], "k int, t string")
    got = {(r.label, r.text) for r in extraction.mentions(df, ["k"], "t").collect()}
    assert got == {("Date", "3 May 2018"), ("Organization", "Acton Foods LLP"), ("Amount", "Rs. 4,500"), ("Case Number", "WP/12/2010")}
    replies = spark.createDataFrame([(0, '[{"pair_id":1,"relationship":"paid by","direction":"B_TO_A","confidence":0.9},{"pair_id":2,"relationship":null,"confidence":0.9},{"pair_id":9,"relationship":"x","confidence":0.9},{"pair_id":1,"relationship":"low","confidence":0.5}]'), (1, "no json")], "batch_no int, reply string")
    pairs = spark.createDataFrame([(0, 1, "a", "b"), (0, 2, "a", "c")], "batch_no int, pair_id int, name_a string, name_b string")
    assert [tuple(r)[:4] for r in extraction.parse_relations(replies, pairs).collect()] == [("b", "PAID_BY", "a", 0.9)]


def test_answering_loop(spark):
    from docmill.operators import agent

    calls = []

    def search(tokens):
        calls.append(list(tokens))
        nodes = spark.createDataFrame([("acme_works", 0.4)], "name string, graph_score double")
        text = "the acme plant" if "acme" in tokens else "nothing"
        return nodes, spark.createDataFrame([(1, 1, 2.0, text)], "key int, page int, score double, text string")

    edges = spark.createDataFrame([("a", "R", "b")], "src string, rel string, dst string")
    fused, taken = agent.answer(search, ["plant"], edges)
    assert taken == 1 and calls == [["plant"], ["plant", "acme", "works"]]
    assert {r.name: r.confidence_level for r in fused.collect()}["acme_works"] == "HIGH"
    assert agent.typed_ratio(edges.limit(0)).first().typed_ratio == 0.0


def test_question_reaches_rare_names(spark):
    from docmill.plans import graph_queries

    rows = [("1|hub", "hub", 1, "Person", 1, None, 0.9), ("1|sale_deed", "sale_deed", 1, "Agreement", 2, None, 0.9), ("1|near", "near", 1, "Person", 3, None, 0.9), ("1|clara_orlov", "clara_orlov", 1, "Person", 4, None, 0.9), ("2|clara_orlov", "clara_orlov", 2, "Person", 5, None, 0.9), ("1|bench", "bench", 1, "Court", 6, None, 0.9)]
    rows += [(f"1|x{i}", f"x{i}", 1, "Asset", 10 + i, None, 0.9) for i in range(9)]
    nodes = spark.createDataFrame(rows, "node string, name string, case_id long, label string, mention_id long, context string, confidence double")
    edges = spark.createDataFrame([("1|hub", f"1|x{i}") for i in range(9)] + [("1|sale_deed", "1|near")], "src string, dst string")
    passages = spark.createDataFrame([(1, "Clara Orlov signed.")], "case_id long, text string")
    got = {r.node for r in graph_queries.question_nodes(nodes, edges, passages, ["sale"]).collect()}
    assert got == {"1|sale_deed", "1|near", "1|clara_orlov"}
    degrees = graph.degree(nodes, edges)
    seeds = lambda q: {r.node for r in graph.question_seeds(nodes, degrees, q, "mention_id").collect()}
    assert seeds(["court"]) == {"1|bench"} and "1|hub" in seeds(["weather"])
    assert seeds(["judge"]) == {"1|bench", "1|hub", "1|near", "1|clara_orlov"}


def test_evidence_for_all_types(spark):
    from docmill.plans import entity_queries

    one = "Clara Orlov met Ivo Brandt. The High Court sat."
    rows = [(1, "Clara Orlov", "Person", one), (2, "Ivo Brandt", "Person", one), (3, "High Court", "Court", "The High Court sat."), (4, "5 May", "Date", one)]
    m = spark.createDataFrame([(i, 1, "a.pdf", 2.0, t, t.lower(), k, c) for i, t, k, c in rows], "mention_id long, case_id long, source_pdf string, source_page double, text string, canonical_name string, schema_type string, context string")
    got = {(r.name_a, r.name_b): r.sentences for r in entity_queries._evidence(m).collect()}
    assert set(got) == {("clara orlov", "ivo brandt"), ("clara orlov", "high court"), ("ivo brandt", "high court")}
    assert got["clara orlov", "ivo brandt"].startswith("Clara Orlov met Ivo Brandt.") and "High Court sat" in got["clara orlov", "high court"]


def test_domain_configuration(spark, tmp_path):
    from docmill.operators import config

    for k, (d, labels, examples) in enumerate((("universal", ["a", "b"], ["x"]), ("tax", ["b", "c"], ["x"]))):
        (tmp_path / f"{k}.json").write_text(json.dumps({"domain_id": d, "name": d.title(), "labels": labels, "vocabulary": None, "headings": [], "examples": examples}))
    domains = config.read_domains(spark, str(tmp_path))
    cases = spark.createDataFrame([("1", "tax"), ("2", "unheard"), ("3", None), ("4", "universal")], "case_id string, domain string")
    got = {r.case_id: r for r in config.domain_of(cases, domains).collect()}
    assert got["1"].labels == ["a", "b", "c"] and got["1"].examples == ["x", "x"] and got["1"].known
    assert all(got[k].domain_id == "universal" and got[k].labels == ["a", "b"] for k in "234") and (got["2"].known, got["3"].known, got["4"].known) == (False, False, True)
    assert [r.domain_id for r in config.list_domains(domains).collect()] == ["tax"] and config.domain_of(cases, domains.limit(0)).count() == 0


def test_state_changes(spark):
    from docmill.operators import state

    old = spark.createDataFrame([("c", "d1", "failed", 3), ("c", "d2", "ready", 4)], "case_id string, doc_id string, status string, page_count int")
    new = spark.createDataFrame([("c", "b.PDF", 2), ("c", "a.xyz", 1), ("e", "n", 1)], "case_id string, filename string, uploaded_at int")
    assert {(r.case_id, r.doc_id, r.file_type) for r in state.add_documents(old, new).collect()} == {("c", "doc_003", "unknown"), ("c", "doc_004", "pdf"), ("e", "doc_001", "unknown")}
    assert {(r.doc_id, r.status, r.page_count) for r in state.retry(old).collect()} == {("d1", "pending", None), ("d2", "ready", 4)}
    done = spark.createDataFrame([("c", "d1", "processed", None)], old.schema)
    assert {(r.doc_id, r.status, r.page_count) for r in state.set_status(old, done).collect()} == {("d1", "processed", 3), ("d2", "ready", 4)}
    groups = spark.createDataFrame([("c", "1", "n", "AUTO_MERGE", None), ("c", "2", "m", "NEEDS_REVIEW", "KEEP"), ("c", "3", "k", "NEEDS_REVIEW", "SKIP"), ("c", "4", "j", "NEEDS_REVIEW", "MERGE")], "case_id string, group_id string, canonical_name string, resolution string, human_decision string")
    members = spark.createDataFrame([("c", "1", "n"), ("c", "1", "n2"), ("c", "1", "n2"), ("c", "2", "x"), ("c", "3", "y"), ("c", "4", "j3"), ("c", "4", None)], "case_id string, group_id string, name string")
    assert {tuple(r) for r in state.apply_decisions(groups, members).select("group_id", "action", "old", "canonical").collect()} == {("1", "MERGED", "n2", "n"), ("2", "KEPT", None, "m"), ("4", "MERGED", "j3", "j")}
    votes = spark.createDataFrame([("c", "1", "YES"), ("c", "1", "YES"), ("c", "1", "NO"), ("c", "4", "YES"), ("c", "4", "NO")], "case_id string, group_id string, llm_vote string")
    staged = spark.createDataFrame([("c", "1", "KEEP", ["first", "second"], 1), ("c", "4", "MERGE", None, 1), ("c", "9", "MERGE", None, 1)], "case_id string, group_id string, decision string, buckets array<string>, staged_at int")
    assert {(r.group_id, r.canonical_name, r.disagreement) for r in state.confirm_all(groups, votes, staged).collect()} == {("1", "first", True), ("4", "j", True)}


def test_traversal_with_types_and_missing_seeds(spark):
    nodes = spark.createDataFrame([("a", "Person"), ("b", "Court"), ("c", "Person"), ("d", "Person"), ("z", "Person")], "node string, label string")
    edges = spark.createDataFrame([("a", "R", "b"), ("b", "R", "c"), ("c", "R", "d")], "src string, rel string, dst string")
    seeds = spark.createDataFrame([("a",), ("z",)], "node string")
    assert {(r.node, r.degree) for r in graph.within(nodes, edges, seeds, 2, ["Person"]).collect()} == {("a", 1), ("c", 2), ("z", 0)}
    assert {r.node for r in graph.within(nodes, edges, seeds, 2, None, 1).collect()} == {"b", "a", "z"}
    assert graph.within(nodes, edges, seeds.limit(0), 2).count() == 0


def test_edges_need_their_ends(spark):
    nodes = spark.createDataFrame([("c", "a", "Person"), ("c", "b", "Court"), ("c", "b", "Entity"), ("d", "a", "Person")], "case_id string, node string, label string")
    edges = spark.createDataFrame([("c", "a", "filed by", "b", 0.7, "f2", 2), ("c", "a", "FILED_BY", "b", 0.9, "f1", 1), ("d", "a", "x", "b", 0.9, "f", 1)], "case_id string, src string, rel string, dst string, confidence double, source string, seq int")
    got = {(r.case_id, r.rel, r.dst_label, r.confidence, r.source) for r in graph.connect(edges, nodes).collect()}
    assert got == {("c", "FILED_BY", "Court", 0.9, "f1"), ("c", "FILED_BY", "Entity", 0.9, "f1")}


def test_pages_fuse_and_merge(spark):
    nodes = spark.createDataFrame([("acme_works", "Organization", 0.5), ("nobody", "Person", 0.1)], "name string, schema_type string, graph_score double")
    p = spark.createDataFrame([(1, 3, 2.0, "about Acme", "Page 3", ["about Acme"]), (2, 4, 1.0, "other", "Page 4", None), (3, 4, 0.5, "more", "Page 4", None)], "key int, page int, score double, text string, citation string, lines array<string>")
    f = fusion.fuse_pages(nodes, p)
    got = {r.name: r for r in f.collect()}
    assert got["acme_works"].confidence_level == "HIGH" and round(got["acme_works"].final_score, 3) == 1.1 and got["nobody"].confidence_level == "MEDIUM"
    assert [x.key for x in got["passage_p4"].passages] == [3] and got["passage_p4"].citations == ["Page 4"]
    m = {r.name: r for r in fusion.merge_pages(f, fusion.fuse_pages(nodes.limit(0), p)).collect()}
    assert m["acme_works"].confidence_level == "HIGH" and [x.key for x in m["acme_works"].passages] == [1] and [x.key for x in m["passage_p3"].passages] == [1]
    t = spark.createDataFrame([("a", "R", "b")], "src string, rel string, dst string")
    text = fusion.prompt_text("q", f, t, t.withColumn("citation", F.lit("Page 3"))).first().context
    assert "[typed] (a) --[R]--> (b)" in text and "grounded in Page 3" in text and text.index("[HIGH] acme_works") < text.index("[MEDIUM]")
    empty = fusion.prompt_text("q", f.limit(0), t.limit(0), t.withColumn("citation", F.lit("x")).limit(0), 20).first().context
    assert empty == "Query: q\n\nRetrieved 0"[:20]
    assert {(r.key, r.page) for r in fusion.document_citations(f).collect()} == {(1, 3)}


def test_means_and_states_of_vectors(spark):
    rows = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 2.0]), ("c", [1.0, 1.0]), ("d", [-1.0, -1.0])], "node string, v array<double>")
    q = vectors.mean_vector(rows, "node", "v", spark.createDataFrame([("a",), ("b",), ("none",)], "node string"))
    got = [(r.node, r.similarity) for r in vectors.nearest_to(rows, "node", "v", q, 2).collect()]
    assert [g[0] for g in got] == ["c", "b"] and got[0][1] == round(1.5 / (1.25 * 2) ** 0.5, 6)
    s = spark.createDataFrame([("ready", 0), ("failed", 3), ("not_started", 30)], "status string, n int").select(vectors.end_training(vectors.start_training(F.col("status")), F.col("n")).alias("x"))
    assert [r.x for r in s.collect()] == ["ready", "failed", "ready"]
