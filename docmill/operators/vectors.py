"""Dense vectors: norms, pairs above a threshold, nearest neighbours, graph embeddings."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    n = F.sqrt(dot(v, v))
    return F.when(n == 0, 1.0).otherwise(n)


def normalized(v: Column) -> Column:
    n = norm(v)
    return F.transform(v, lambda x: x.cast("double") / n)


def similar_pairs(rows: DataFrame, key: str, block: str, vector: str, least: float, side: int = 512) -> DataFrame:
    """(a, b, cosine) of the vectors of one block at or above a threshold.

    Vectors are cut into sheets of a bounded number; pairs of sheets are multiplied as matrices
    in Arrow batches, so a block of any size is spread over its pairs of sheets and only hits
    leave the worker.
    """
    sized = rows.where(F.col(vector).isNotNull()).select(F.col(key).alias("id"), F.col(block).alias("block"), F.col(vector).cast("array<double>").alias("v"))
    counts = sized.groupBy("block").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / side)).cast("int").alias("sheets"))
    placed = sized.join(counts, "block").withColumn("sheet", F.pmod(F.xxhash64("id"), F.col("sheets")).cast("int"))
    spread = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("sheets") - 1))).withColumn("left", F.least("sheet", "other")).withColumn("right", F.greatest("sheet", "other"))

    def work(group: pd.DataFrame) -> pd.DataFrame:
        v = np.stack(group["v"].to_numpy())
        v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
        ids, sheet = group["id"].to_numpy(), group["sheet"].to_numpy()
        low, high = group["left"].iloc[0], group["right"].iloc[0]
        i, j = np.flatnonzero(sheet == low), np.flatnonzero(sheet == high)
        c = v[i] @ v[j].T
        p, q = np.nonzero(c >= least)
        a, z, s = ids[i[p]], ids[j[q]], c[p, q]
        keep = a < z if low == high else np.ones(len(a), dtype=bool)
        return pd.DataFrame({"a": np.minimum(a, z)[keep], "b": np.maximum(a, z)[keep], "cosine": s[keep]})

    kind = rows.schema[key].dataType.simpleString()
    return spread.groupBy("block", "left", "right").applyInPandas(work, f"a {kind}, b {kind}, cosine double")


def nearest(rows: DataFrame, key: str, vector: str, query: list[float], k: int) -> DataFrame:
    """The k vectors with the greatest inner product with a normalized query."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return rows.select(key, F.round(dot(normalized(F.col(vector)), normalized(q)), 6).alias("score")).orderBy(F.desc("score"), key).limit(k)


def mean_vector(rows: DataFrame, key: str, vector: str, seeds: DataFrame) -> DataFrame:
    """One row (query): the normalized mean of the vectors of the seeds(key); a handful of seeds."""
    own = rows.join(F.broadcast(seeds.select(key).distinct()), key, "left_semi").select(F.posexplode(vector).alias("at", "x"))
    mean = own.groupBy("at").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return mean.agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda s: s["x"]).alias("query")).select(normalized(F.col("query")).alias("query"))


def nearest_to(rows: DataFrame, key: str, vector: str, query: DataFrame, k: int) -> DataFrame:
    """(key, similarity): the k vectors with the greatest inner product with the query of one row."""
    return rows.crossJoin(F.broadcast(query)).select(key, F.round(dot(normalized(F.col(vector)), F.col("query")), 6).alias("similarity")).orderBy(F.desc("similarity"), key).limit(k)


def attach(nodes: DataFrame, rows: DataFrame, key: str, vector: str, model: str) -> DataFrame:
    """Nodes with their vector, its dimensions and the model's name; nodes without one keep nulls."""
    v = rows.select(key, F.col(vector).alias("embedding"), F.size(vector).alias("dims"), F.lit(model).alias("model"))
    return nodes.join(v, key, "left")


def index_info(rows: DataFrame, vector: str) -> DataFrame:
    """One row: vectors, dimensions, and whether all agree."""
    return rows.agg(F.count(vector).alias("vectors"), F.max(F.size(vector)).alias("dims"), F.coalesce(F.min(F.size(vector)) == F.max(F.size(vector)), F.lit(False)).alias("consistent"))


#: States of the training of a case in which it is not started.
BUSY = ["training", "ready"]


def start_training(status: Column) -> Column:
    """The state after a start: nothing happens while training or when ready."""
    return F.when(status.isin(BUSY), status).otherwise("training")


def end_training(status: Column, triples: Column, least: int = 10) -> Column:
    """The state after training: with too few triples it failed."""
    return F.when(status == "training", F.when(triples >= least, "ready").otherwise("failed")).otherwise(status)


def rotate(triples: np.ndarray, entities: int, relations: int, dimensions: int = 128, epochs: int = 100, rate: float = 0.05, seed: int = 42) -> np.ndarray:
    """Rotation embeddings by SGD with one negative a triple; real and imaginary parts side by side."""
    rng = np.random.default_rng(seed)
    e = rng.normal(0, 0.3, (entities, dimensions)) + 1j * rng.normal(0, 0.3, (entities, dimensions))
    r = rng.uniform(-np.pi, np.pi, (relations, dimensions))
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(len(triples)), max(1, len(triples) // 256)):
            h, k, t = triples[part].T
            for tail, sign in ((t, 1.0), (rng.integers(0, entities, len(part)), -1.0)):
                turn = np.exp(1j * r[k])
                d = e[h] * turn - e[tail]
                weight = 1 / (1 + np.exp(np.clip(sign * (6.0 - np.abs(d).sum(1)), -30, 30)))
                g = sign * weight[:, None] * d / (np.abs(d) + 1e-9)
                np.add.at(e, h, -rate * g * turn.conj())
                np.add.at(e, tail, rate * g)
                np.add.at(r, k, -rate * np.real(g.conj() * 1j * e[h] * turn))
    v = np.concatenate([e.real, e.imag], axis=1)
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def train_graph_embeddings(edges: DataFrame, case: str, least: int = 10, dimensions: int = 64, epochs: int = 100) -> DataFrame:
    """edges(case, src, rel, dst) -> (case, entity, idx, vec): each case is trained by itself.

    Cases with fewer triples than least give no vectors.  The unit of work is the graph of one
    case, which its own model needs as a whole.
    """

    def work(group: pd.DataFrame) -> pd.DataFrame:
        if len(group) < least:
            return pd.DataFrame(columns=[case, "entity", "idx", "vec"], dtype=object)
        names = sorted(set(group["src"]) | set(group["dst"]))
        rels = sorted(set(group["rel"]))
        at, rt = {n: i for i, n in enumerate(names)}, {x: i for i, x in enumerate(rels)}
        direct = [(at[s], rt[r], at[d]) for s, r, d in zip(group["src"], group["rel"], group["dst"], strict=True)]
        inverse = [(d, r + len(rels), s) for s, r, d in direct]
        v = rotate(np.array(sorted(direct + inverse)), len(names), 2 * len(rels), dimensions, epochs)
        return pd.DataFrame({case: group[case].iloc[0], "entity": names, "idx": range(len(names)), "vec": [x.astype(np.float32) for x in v]})

    kind = edges.schema[case].dataType.simpleString()
    return edges.select(case, "src", "rel", "dst").distinct().groupBy(case).applyInPandas(work, f"{case} {kind}, entity string, idx int, vec array<float>")
