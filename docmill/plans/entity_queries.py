"""Mentions, validation and resolution, and the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.functions import text as T
from docmill.operators import entities as E
from docmill.operators import resolution as R
from docmill.operators import vectors
from docmill.plans.text_queries import _strip
from docmill.session import table

S = T.SPACE


def _mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.latest(table(spark, sf_dir, "entity_mentions"), "mention_id", "loaded_at")


MENTIONS = "(SELECT * FROM entity_mentions QUALIFY row_number() OVER (PARTITION BY mention_id ORDER BY loaded_at DESC) = 1)"


def canonicalize_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mentions(spark, sf_dir).select("mention_id", T.canonical_name(F.col("text"), F.col("schema_type")).alias("canonical"))


def label_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mentions(spark, sf_dir).groupBy(E.schema_type(F.col("gliner_label")).alias("schema_type")).agg(F.count("*").alias("mentions"))


def entity_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.instr("context", F.col("text"))
    return _mentions(spark, sf_dir).where("text is not null and context is not null").where(at > 0).select("mention_id", T.snippet(F.col("context"), at, F.length("text")).alias("snippet"))


def mention_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _mentions(spark, sf_dir).where("canonical_name is not null and schema_type is not null")
    return E.first_best(m.select("case_id", "canonical_name", "schema_type", "mention_id", F.col("confidence"), "source_pdf"), ["case_id", "canonical_name", "schema_type"], "confidence", "mention_id")


def _reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _mentions(spark, sf_dir)
    page = F.col("source_page").cast("int")
    return m.select("mention_id", E.rejection(F.col("canonical_name"), F.col("confidence"), page, F.col("source_pdf"), F.col("schema_type")).alias("reason"))


def validate_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reasons(spark, sf_dir)


def rejection_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reasons(spark, sf_dir).where("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _mentions(spark, sf_dir).where("case_id is not null and source_pdf is not null and source_page > 0")
    return E.pairs(m, ["case_id", "source_pdf", "source_page"], "canonical_name", "schema_type", "mention_id")


def entity_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("case_id", "source_pdf", F.col("source_page").cast("int").alias("source_page"), "name_a", "name_b")


def pair_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = E.batches(_pairs(spark, sf_dir), ["case_id", "source_pdf", "source_page"])
    return b.groupBy("case_id", "source_pdf", F.col("source_page").cast("int").alias("source_page"), "batch_no").agg(F.count("*").alias("pairs"))


def shared_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence for every pair of names of a page, of all meaningful types: from the first context with both, else the first with either, else the first."""
    needed = table(spark, sf_dir, "entity_mentions").select("mention_id", "case_id", "source_pdf", "source_page", "canonical_name", "schema_type", "text", "context", "loaded_at")
    return _evidence(E.latest(needed, "mention_id", "loaded_at"))


def _evidence(mentions: DataFrame) -> DataFrame:
    """(case_id, source_pdf, source_page, name_a, name_b, mention_id, sentences), a row for each pair of E.pairs; without a context of the page, sentences is null.

    Names and contexts travel once, by page.  Each name takes its contexts along, so a pair finds
    its own among those of its two names, and no row of a pair is ever shuffled.
    """
    chunk = ["case_id", "source_pdf", "source_page"]
    m = mentions.where("case_id is not null and source_pdf is not null and source_page > 0").repartition(*chunk)
    named = m.where(F.col("schema_type").isin(E.MEANINGFUL) & F.col("canonical_name").isNotNull())
    # a filter on mention_id would go below the aggregate of the latest rows, which then runs twice
    first = named.groupBy(*chunk, "canonical_name").agg(F.min(F.when(F.col("mention_id").isNotNull(), F.struct("mention_id", F.coalesce("text", "canonical_name").alias("text")))).alias("f"))
    c = m.where("context is not null").groupBy(*chunk, "context").agg(F.min("mention_id").alias("mention_id"))
    quote = F.struct(F.coalesce("mention_id", F.lit(-(2**63))).alias("at"), "mention_id", "context")
    on = [F.col(k) == F.col(f"c_{k}") for k in chunk]
    # what does not quote the name drops out inside the join, before anything is sorted or collected
    j = first.join(c.select(*[F.col(k).alias(f"c_{k}") for k in chunk], quote.alias("quote")), [*on, F.contains(F.lower("quote.context"), F.lower("f.text"))], "left")
    known = j.groupBy(*chunk, "canonical_name", "f").agg(F.collect_list("quote").alias("hits")).select(*chunk, F.col("canonical_name").alias("name"), F.col("f.mention_id").alias("seq"), F.col("f.text").alias("text"), "hits")
    top = c.groupBy(*chunk).agg(F.min(quote).alias("top"))
    side = lambda x: known.select(*chunk, *[F.col(n).alias(f"{n}_{x}") for n in ("name", "seq", "text", "hits")])
    p = side("a").join(top, chunk, "left").join(side("b"), chunk).where("seq_a < seq_b and name_a <> name_b")
    both = F.array_min(F.array_intersect(F.col("hits_a.at"), F.col("hits_b.at")))
    shared = F.filter("hits_a", lambda h: h["at"] == F.col("both"))
    best = p.withColumn("both", both).withColumn("r", F.when(F.col("both").isNotNull(), F.get(shared, F.lit(0))).otherwise(F.coalesce(F.least(F.array_min("hits_a"), F.array_min("hits_b")), F.col("top"))))
    return best.select("case_id", "source_pdf", F.col("source_page").cast("int").alias("source_page"), "name_a", "name_b", "r.mention_id", F.when(F.col("r.context").isNotNull(), F.array_join(E.shared_sentences(F.col("r.context"), F.col("text_a"), F.col("text_b")), " / ")).alias("sentences"))


def _votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "candidate_entities").where("group_id is not null")
    return c.select("case_id", "group_id", F.col("llm_vote").alias("vote"), F.nanvl("llm_merge_confidence", F.lit(0.0)).alias("confidence"))


def resolution_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.decide(_votes(spark, sf_dir), ["case_id", "group_id"])


def resolution_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.decide(_votes(spark, sf_dir), ["case_id", "group_id"]).groupBy("case_id").agg(*[F.count_if(F.col("resolution") == x).alias(x.lower()) for x in ("AUTO_MERGE", "AUTO_KEEP", "NEEDS_REVIEW")])


def pick_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "candidate_entities").where("group_id is not null and canonical_name is not null")
    return R.pick_canonical(c.withColumn("confidence", F.nanvl("confidence", F.lit(0.0))), ["case_id", "group_id"], "canonical_name", "confidence", "candidate_id")


def registry_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "resolution_groups").where("decided_at is not null").select("case_id", "group_id", "canonical_name", "decided_at")
    c = table(spark, sf_dir, "candidate_entities").where("group_id is not null").select("case_id", "group_id", F.col("canonical_name").alias("alias"), F.col("source_pdf").alias("file"), F.col("candidate_id").alias("seq"))
    r = R.registry(g.join(c, ["case_id", "group_id"]))
    return r.select("case_id", "key", F.array_join("aliases", ";").alias("aliases"), F.array_join("source_docs", ";").alias("source_docs"))


def registry_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of mentions against the names decided in their case."""
    g = table(spark, sf_dir, "resolution_groups").where("canonical_name is not null and trim(canonical_name) <> ''")
    c = table(spark, sf_dir, "candidate_entities").where("canonical_name is not null")
    return R.match_registry(c.select(F.col("canonical_name").alias("name"), F.col("case_id").alias("block")), g.select(F.col("case_id").alias("block"), F.col("group_id").alias("seq"), F.col("canonical_name").alias("entry")))


def registry_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates that are left to resolve once the registry has taken those it knows."""
    g = table(spark, sf_dir, "resolution_groups").where("canonical_name is not null and trim(canonical_name) <> ''")
    c = table(spark, sf_dir, "candidate_entities").where("canonical_name is not null").select("candidate_id", F.col("canonical_name").alias("name"), F.col("case_id").alias("block"))
    return R.unmatched(c, g.select(F.col("case_id").alias("block"), F.col("group_id").alias("seq"), F.col("canonical_name").alias("entry"))).select("candidate_id", F.col("block").alias("case_id"))


def shape_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the shapes of the types find, beside the other rules."""
    m = _mentions(spark, sf_dir)
    page = F.when(~F.isnan(F.col("source_page").cast("double")), F.col("source_page"))
    v = E.violations(F.col("schema_type"), {"canonical_name": F.col("canonical_name"), "source_pdf": F.col("source_pdf"), "source_page": page, "confidence": F.col("confidence")})
    return m.select("mention_id", F.array_join(v, "; ").alias("violations")).where("violations <> ''")


def validated_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid and rejected mentions of each case, and the part that is noise."""
    m = _mentions(spark, sf_dir)
    reason = E.rejection(F.col("canonical_name"), F.col("confidence"), F.col("source_page").cast("int"), F.col("source_pdf"), F.col("schema_type"))
    valid, rejected = E.validate_batch(m, reason)
    n = valid.select("case_id", F.lit(1).alias("ok")).unionByName(rejected.select("case_id", F.lit(0).alias("ok"))).groupBy("case_id").agg(F.sum("ok").alias("valid"), F.count("*").alias("all"))
    return n.select("case_id", "valid", (F.col("all") - F.col("valid")).alias("rejected"), F.round(1 - F.col("valid") / F.col("all"), 6).alias("noise_rate"))


#: The vectors given are nearly unrelated: at the threshold for names none would be a pair.
NEAR = 0.3


def cosine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return vectors.similar_pairs(e, "vec_id", "label", "embedding", NEAR).select("a", "b", F.round("cosine", 4).alias("cosine"))


def similarity_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    p = vectors.similar_pairs(e, "vec_id", "label", "embedding", NEAR)
    return R.clusters(e.select(F.col("vec_id").alias("id")), p)


def l2_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors.normalized(F.col("embedding"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(F.element_at(v, 1), 6).alias("x1"), F.round(F.element_at(v, -1), 6).alias("xn"), F.size(v).alias("dims"))


QUESTION_VECTOR = [1.0 if i % 3 == 0 else -0.5 for i in range(64)]


def knn_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.nearest(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", QUESTION_VECTOR, 10)


QUERIES = {
    f.__name__: f
    for f in (canonicalize_names, label_types, entity_context, mention_dedupe, validate_reasons, rejection_stats, entity_pairs, pair_batches, shared_sentences, resolution_votes, resolution_summary, pick_canonical, registry_build, registry_match, registry_unmatched, shape_violations, validated_cases, cosine_pairs, similarity_clusters, l2_normalize, knn_topk)
}


def _list(xs: list[str]) -> str:
    return ", ".join(f"'{x}'" for x in xs)


_NAME = f"lower({_strip('text')})"
_BARE = _NAME
for _s in T.SUFFIXES:
    _BARE = f"replace({_BARE}, '{_s}', '')"
_CANON = f"array_to_string(regexp_extract_all(translate(CASE WHEN schema_type = 'Organization' THEN {_BARE} ELSE {_NAME} END, ',.''', ''), '[^{S}]+'), '_')"
_LABEL = "CASE " + " ".join(f"WHEN gliner_label = '{k}' THEN '{v}'" for k, v in E.LABEL_TYPES.items()) + " ELSE 'Entity' END"
_N = _strip("coalesce(canonical_name, '')")
_REASON = f"""CASE WHEN length({_N}) < 3 THEN 'name too short' WHEN regexp_matches(regexp_replace({_N}, '[., ]', '', 'g'), '^\\p{{N}}+$') THEN 'purely numeric' WHEN lower({_N}) IN ({_list(E.NOISE)}) THEN 'noise word'
    WHEN coalesce(confidence, 0) < 0.5 THEN 'low confidence' WHEN coalesce(source_page, 0) = 0 THEN 'missing page' WHEN coalesce(source_pdf, '') = '' THEN 'missing file' WHEN confidence > 1.0 AND schema_type IN ('Person', 'Organization') THEN 'confidence above 1' END"""
_FIRST = f"""f AS (SELECT case_id, source_pdf, CAST(source_page AS INT) AS source_page, canonical_name AS name, min(mention_id) AS seq FROM {MENTIONS} WHERE case_id IS NOT NULL AND source_pdf IS NOT NULL AND source_page > 0 AND schema_type IN ({_list(E.MEANINGFUL)}) AND canonical_name IS NOT NULL GROUP BY 1, 2, 3, 4),
    p AS (SELECT a.case_id, a.source_pdf, a.source_page, a.name AS name_a, b.name AS name_b, a.seq AS seq_a, b.seq AS seq_b FROM f a JOIN f b ON a.case_id = b.case_id AND a.source_pdf = b.source_pdf AND a.source_page = b.source_page AND a.seq < b.seq)"""
_COS = "list_dot_product(CAST(x.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[])) / sqrt(list_dot_product(CAST(x.embedding AS DOUBLE[]), CAST(x.embedding AS DOUBLE[])) * list_dot_product(CAST(y.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[])))"
_PAIRS = f"SELECT x.vec_id AS a, y.vec_id AS b, {_COS} AS cosine FROM embeddings x JOIN embeddings y ON x.label = y.label AND x.vec_id < y.vec_id WHERE {_COS} >= {NEAR}"
_DECIDE = """SELECT case_id, group_id, CASE WHEN bool_and(coalesce(llm_vote = 'YES', false) AND c >= 0.85) THEN 'AUTO_MERGE' WHEN bool_and(coalesce(llm_vote = 'NO', false) AND c < 0.35) THEN 'AUTO_KEEP' ELSE 'NEEDS_REVIEW' END AS resolution
    FROM (SELECT *, CASE WHEN llm_merge_confidence IS NULL OR isnan(llm_merge_confidence) THEN 0 ELSE llm_merge_confidence END AS c FROM candidate_entities WHERE group_id IS NOT NULL) GROUP BY case_id, group_id"""

SQL = {
    "canonicalize_names": f"SELECT mention_id, {_CANON} AS canonical FROM {MENTIONS}",
    "label_types": f"SELECT {_LABEL} AS schema_type, count(*) AS mentions FROM {MENTIONS} GROUP BY 1",
    "entity_context": f"SELECT mention_id, replace(substring(context, greatest(0, strpos(context, text) - 51) + 1, strpos(context, text) - 1 + length(text) + 50 - greatest(0, strpos(context, text) - 51)), chr(10), ' ') AS snippet FROM {MENTIONS} WHERE strpos(context, text) > 0",
    "mention_dedupe": f"SELECT case_id, canonical_name, schema_type, mention_id, confidence, source_pdf FROM {MENTIONS} WHERE canonical_name IS NOT NULL AND schema_type IS NOT NULL QUALIFY row_number() OVER (PARTITION BY case_id, canonical_name, schema_type ORDER BY coalesce(confidence, 0) DESC, mention_id) = 1",
    "validate_reasons": f"SELECT mention_id, {_REASON} AS reason FROM {MENTIONS}",
    "rejection_stats": f"SELECT * FROM (SELECT {_REASON} AS reason, count(*) AS n FROM {MENTIONS} GROUP BY 1) WHERE reason IS NOT NULL",
    "validated_cases": f"SELECT case_id, CAST(count(*) FILTER (WHERE r IS NULL) AS BIGINT) AS valid, count(*) FILTER (WHERE r IS NOT NULL) AS rejected, round(1 - count(*) FILTER (WHERE r IS NULL)::DOUBLE / count(*), 6) AS noise_rate FROM (SELECT case_id, {_REASON} AS r FROM {MENTIONS}) GROUP BY case_id",
    "shape_violations": f"""WITH v AS (SELECT mention_id, CASE {' '.join("WHEN schema_type = '" + k + "' THEN concat_ws('; ', " + ", ".join(f"CASE WHEN {c} IS NULL" + (" OR isnan(CAST(source_page AS DOUBLE))" if c == 'source_page' else "") + f" THEN '{c} missing' END" for c in need) + (", CASE WHEN confidence < 0 OR confidence > 1 THEN 'confidence out of range' END" if lim else "") + ")" for k, (need, lim) in E.SHAPES.items())} ELSE '' END AS violations FROM {MENTIONS})
        SELECT * FROM v WHERE violations <> ''""",
    "shared_sentences": f"""WITH {_FIRST}, t AS (SELECT mention_id, coalesce(text, canonical_name) AS text FROM {MENTIONS}),
        c AS (SELECT case_id, source_pdf, CAST(source_page AS INT) AS source_page, context, min(mention_id) AS mention_id FROM {MENTIONS} WHERE case_id IS NOT NULL AND source_pdf IS NOT NULL AND source_page > 0 AND context IS NOT NULL GROUP BY 1, 2, 3, 4),
        j AS (SELECT p.case_id, p.source_pdf, p.source_page, name_a, name_b, lower(ta.text) AS la, lower(tb.text) AS lb, context, c.mention_id, CASE WHEN contains(lower(context), lower(ta.text)) AND contains(lower(context), lower(tb.text)) THEN 0 WHEN contains(lower(context), lower(ta.text)) OR contains(lower(context), lower(tb.text)) THEN 1 ELSE 2 END AS rank
          FROM p JOIN t ta ON ta.mention_id = seq_a JOIN t tb ON tb.mention_id = seq_b LEFT JOIN c ON c.case_id = p.case_id AND c.source_pdf = p.source_pdf AND c.source_page = p.source_page),
        b AS (SELECT *, string_split(regexp_replace(context, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS ss FROM j QUALIFY row_number() OVER (PARTITION BY case_id, source_pdf, source_page, name_a, name_b ORDER BY rank, mention_id, context) = 1),
        k AS (SELECT *, coalesce(list_position(list_transform(ss, lambda q: contains(lower(q), la) AND contains(lower(q), lb)), true), 0) AS both_at FROM b),
        fx AS (SELECT *, list_concat(list_transform(list_filter(range(1, len(ss) + 1), lambda i: (both_at = 0 OR i < both_at) AND (contains(lower(ss[i]), la) OR contains(lower(ss[i]), lb))), lambda i: ss[i]), CASE WHEN both_at > 0 THEN ss[greatest(1, both_at - 1):greatest(1, both_at - 1) + CASE WHEN both_at > 1 THEN 2 ELSE 1 END] ELSE [] END)[1:4] AS found FROM k)
        SELECT case_id, source_pdf, source_page, name_a, name_b, mention_id, CASE WHEN context IS NULL THEN NULL WHEN len(found) > 0 THEN array_to_string(found, ' / ') ELSE substring(context, 1, 300) END AS sentences FROM fx""",
    "entity_pairs": f"WITH {_FIRST} SELECT case_id, source_pdf, source_page, name_a, name_b FROM p",
    "pair_batches": f"WITH {_FIRST}, n AS (SELECT *, (row_number() OVER (PARTITION BY case_id, source_pdf, source_page ORDER BY seq_a, seq_b) - 1) // 10 AS batch_no FROM p) SELECT case_id, source_pdf, source_page, batch_no, count(*) AS pairs FROM n GROUP BY 1, 2, 3, 4",
    "resolution_votes": _DECIDE,
    "resolution_summary": f"SELECT case_id, count(*) FILTER (WHERE resolution = 'AUTO_MERGE') AS auto_merge, count(*) FILTER (WHERE resolution = 'AUTO_KEEP') AS auto_keep, count(*) FILTER (WHERE resolution = 'NEEDS_REVIEW') AS needs_review FROM ({_DECIDE}) GROUP BY case_id",
    "pick_canonical": """SELECT case_id, group_id, first(canonical_name ORDER BY length(canonical_name), CASE WHEN confidence IS NULL OR isnan(confidence) THEN 0 ELSE -confidence END, candidate_id) AS canonical, count(*) AS size, count(*) > 3 AS is_complex
        FROM candidate_entities WHERE group_id IS NOT NULL AND canonical_name IS NOT NULL GROUP BY case_id, group_id""",
    "registry_build": """WITH r AS (SELECT g.case_id, replace(lower(g.canonical_name), ' ', '_') AS key, c.canonical_name AS alias, c.source_pdf AS file FROM resolution_groups g JOIN candidate_entities c ON g.case_id = c.case_id AND g.group_id = c.group_id WHERE g.decided_at IS NOT NULL AND g.canonical_name IS NOT NULL AND trim(g.canonical_name) <> '')
        SELECT case_id, key, coalesce(string_agg(DISTINCT alias, ';' ORDER BY alias), '') AS aliases, coalesce(string_agg(DISTINCT file, ';' ORDER BY file), '') AS source_docs FROM r GROUP BY case_id, key""",
    "cosine_pairs": f"SELECT a, b, round(cosine, 4) AS cosine FROM ({_PAIRS})",
    "similarity_clusters": f"""WITH RECURSIVE p AS ({_PAIRS}), e AS (SELECT a, b FROM p UNION SELECT b, a FROM p), r(id, c) AS (SELECT a, a FROM e UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.id)
        SELECT id, min(c) AS component FROM r GROUP BY id""",
    "l2_normalize": "WITH n AS (SELECT vec_id, embedding AS v, CASE WHEN list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])) = 0 THEN 1 ELSE sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) END AS n FROM embeddings) SELECT vec_id, round(CAST(v[1] AS DOUBLE) / n, 6) AS x1, round(CAST(v[len(v)] AS DOUBLE) / n, 6) AS xn, len(v) AS dims FROM n",
    "knn_topk": f"WITH q AS (SELECT {QUESTION_VECTOR}::DOUBLE[] AS q) SELECT vec_id, round(list_dot_product(CAST(embedding AS DOUBLE[]), q) / sqrt(list_dot_product(q, q) * list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6) AS score FROM embeddings, q ORDER BY score DESC, vec_id LIMIT 10",
}
