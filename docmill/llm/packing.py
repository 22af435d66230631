"""Problem 6: filling containers of fixed capacity with texts measured in tokens.

Method: pattern packing by non-negative least squares.  The lengths of all texts form a
histogram; patterns of a few lengths that fill a container are enumerated; non-negative least
squares fits how often each pattern is used so that the histogram is spent; the repeat counts
are rounded down to what the histogram holds, and what is left is packed best fit, longest
first, into the gaps and into new containers.

Only the histogram reaches the driver: at most capacity x BUCKETS counts, whatever the number
of texts.  The plan works on counts of equal lengths, never on single texts, and each text finds
its container from its length and its rank among the texts of that length.  Ranks are counted
within BUCKETS hash buckets of each length and shifted by the counts of the buckets before, so
one length that holds a third of all texts is still ranked by BUCKETS tasks.

Defined cases: null texts and texts without a token take no room and get a null container; a
text longer than the capacity is cut into full containers and one rest that is packed like a
text; rows that repeat a doc_id are kept and packed as rows of their own.
"""

from __future__ import annotations

import base64
import bisect
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docmill.session import materialize

CAPACITY = 2048
BUCKETS = 64
#: Width of the histogram's bins is capacity / BINS; patterns have at most PARTS lengths.
BINS, PARTS = 128, 4
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how the vocabulary's texts are cut into words before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def encoder(path: str):
    """The tokenizer of a rank file, once for each Python worker."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(docs: DataFrame, id_column: str, text_column: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, n_tokens) of each row; null texts have no token."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(tokenizer).encode_ordinary
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_tokens": [len(encode(t)) if t else 0 for t in batch["text"]]})

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")).mapInPandas(count, "doc_id long, n_tokens long")


def patterns(bins: int, parts: int) -> list[tuple[int, ...]]:
    """All ways to fill bins with at most parts lengths, longest first."""
    out: list[tuple[int, ...]] = []

    def grow(head: tuple[int, ...], rest: int, most: int) -> None:
        if not rest:
            out.append(head)
        elif len(head) < parts and most * (parts - len(head)) >= rest:
            for x in range(min(rest, most), 0, -1):
                grow((*head, x), rest - x, x)

    grow((), bins, bins)
    return out


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Non-negative least squares by active sets."""
    n = a.shape[1]
    x, on = np.zeros(n), np.zeros(n, dtype=bool)
    for _ in range(rounds):
        pull = a.T @ (b - a @ x)
        pull[on] = -np.inf
        if pull.max() <= 1e-9 * max(1.0, np.abs(b).max()):
            break
        on[int(pull.argmax())] = True
        while True:
            idx = np.flatnonzero(on)
            s = np.linalg.lstsq(a[:, idx], b, rcond=None)[0]
            if s.min() > 0:
                x[:] = 0
                x[idx] = s
                break
            low = s <= 0
            step = np.min(x[idx][low] / np.maximum(x[idx][low] - s[low], 1e-300))
            x[idx] += step * (s - x[idx])
            on[idx[x[idx] <= 1e-12]] = False
            x[~on] = 0
            if not on.any():
                break
    return x


def pack_histogram(counts: dict[int, int], capacity: int, bins: int = BINS, parts: int = PARTS) -> list[tuple[list[tuple[int, int]], int]]:
    """counts of lengths -> groups of equal containers: ([(length, how many in each)], containers)."""
    left = {int(k): int(v) for k, v in counts.items() if v and 0 < k <= capacity}
    groups: list[tuple[list[int], int]] = []
    if full := left.pop(capacity, 0):
        groups.append(([capacity], full))
    bins = min(bins, capacity)
    of_bin = defaultdict(list)
    for length in sorted(left):
        of_bin[-(-length * bins // capacity)].append(length)  # stacks: the longest of a bin goes first
    have = {b: sum(left[x] for x in xs) for b, xs in of_bin.items()}
    usable = [p for p in patterns(bins, parts) if len(p) > 1 and all(b in have for b in p)]
    if usable:
        a = np.zeros((bins + 1, len(usable)), dtype=np.float64)
        for j, p in enumerate(usable):
            for b in p:
                a[b, j] += 1
        h = np.array([have.get(b, 0) for b in range(bins + 1)], dtype=np.float64)
        x = nnls(a, h / h.sum()) * h.sum()
        for j in np.argsort(-x, kind="stable"):
            need = defaultdict(int)
            for b in usable[j]:
                need[b] += 1
            repeats = min(int(round(x[j])), *(have[b] // k for b, k in need.items()), int(1e18))
            if x[j] <= 0 or repeats <= 0:
                continue
            for b, k in need.items():
                have[b] -= k * repeats
            while repeats:
                trial, lengths = defaultdict(int), []
                for b in usable[j]:
                    stack = of_bin[b]
                    length = next(v for v in reversed(stack) if left[v] > trial[v])
                    trial[length] += 1
                    lengths.append(length)
                run = min(repeats, *(left[v] // k for v, k in trial.items()))
                for v, k in trial.items():
                    left[v] -= k * run
                for b in set(usable[j]):
                    of_bin[b] = [v for v in of_bin[b] if left[v]]
                groups.append((lengths, run))
                repeats -= run
    # best fit, longest first, group by group
    by_free: dict[int, list[tuple[list[int], int]]] = defaultdict(list)
    for lengths, n in groups:
        by_free[capacity - sum(lengths)].append((lengths, n))
    frees = sorted(by_free)
    def put(free: int, lengths: list[int], n: int) -> None:
        if n:
            if free not in by_free or not by_free[free]:
                if free not in by_free or free not in frees:
                    bisect.insort(frees, free)
            by_free[free].append((lengths, n))

    for length in sorted((v for v, c in left.items() if c), reverse=True):
        c = left[length]
        while c:
            at = bisect.bisect_left(frees, length)
            if at == len(frees):
                each = capacity // length
                full, rest = divmod(c, each)
                put(capacity - each * length, [length] * each, full)
                if rest:
                    put(capacity - rest * length, [length] * rest, 1)
                break
            free = frees[at]
            lengths, n = by_free[free].pop()
            if not by_free[free]:
                frees.pop(at)
            each = min(free // length, c)
            fill = min(n, c // each)
            put(free - each * length, lengths + [length] * each, fill)
            put(free, lengths, n - fill)
            c -= fill * each
    out = []
    for free in sorted(by_free):
        for lengths, n in by_free[free]:
            count: dict[int, int] = defaultdict(int)
            for v in lengths:
                count[v] += 1
            out.append((sorted(count.items(), reverse=True), n))
    return out


def placement(groups: list[tuple[list[tuple[int, int]], int]]) -> tuple[np.ndarray, ...]:
    """Sorted (length, first rank), the first container of that run and how many share one."""
    rows, used, container = [], defaultdict(int), 0
    for lengths, n in groups:
        for length, each in lengths:
            rows.append((length, used[length], container, each))
            used[length] += each * n
        container += n
    rows.sort()
    table = np.array(rows, dtype=np.int64).reshape(-1, 4)
    return table[:, 0], table[:, 1], table[:, 2], table[:, 3]


def pack(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", capacity: int = CAPACITY, tokenizer: str = TOKENIZER, buckets: int = BUCKETS) -> DataFrame:
    """docs -> (doc_id, piece_no, token_start, token_end, n_tokens, container_id)."""
    spark = docs.sparkSession
    sizes = materialize(token_counts(docs, id_column, text_column, tokenizer))
    n = F.col("n_tokens")
    pieces = F.when(n <= capacity, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.ceil(n / capacity).cast("int") - 1))
    items = sizes.select("doc_id", n.alias("total"), F.explode(pieces).alias("piece_no"))
    items = items.withColumn("token_start", F.col("piece_no") * F.lit(capacity).cast("long")).withColumn("n_tokens", F.least(F.col("total") - F.col("token_start"), F.lit(capacity).cast("long")))
    items = items.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece_no"), F.lit(buckets)).cast("int"))
    counted = items.where("n_tokens > 0").groupBy("n_tokens", "bucket").count().toPandas()  # at most capacity x buckets rows
    counted = counted.sort_values(["n_tokens", "bucket"])
    counted["before"] = counted.groupby("n_tokens")["count"].cumsum() - counted["count"]
    groups = pack_histogram(counted.groupby("n_tokens")["count"].sum().to_dict(), capacity)
    offsets = np.zeros((capacity + 1) * buckets, dtype=np.int64)
    offsets[counted["n_tokens"].to_numpy(dtype=np.int64) * buckets + counted["bucket"].to_numpy(dtype=np.int64)] = counted["before"].to_numpy(dtype=np.int64)
    shared = spark.sparkContext.broadcast((offsets, placement(groups)))
    wide = 1 << 44  # more than the texts of any one length

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        offsets, (length, first, container, each) = shared.value
        keys = length * wide + first
        for batch in batches:
            size = batch["n_tokens"].to_numpy(dtype=np.int64)
            rank = batch.pop("rank").to_numpy(dtype=np.int64) - 1 + offsets[size * buckets + batch.pop("bucket").to_numpy(dtype=np.int64)]
            at = np.searchsorted(keys, size * wide + rank, side="right") - 1
            ids = container[np.maximum(at, 0)] + (rank - first[np.maximum(at, 0)]) // each[np.maximum(at, 0)] if len(keys) else np.zeros(len(size), dtype=np.int64)
            yield batch.assign(container_id=pd.array(np.where(size > 0, ids, 0), dtype="Int64").copy()).assign(container_id=lambda b, s=size: b["container_id"].mask(s == 0))

    order = Window.partitionBy("n_tokens", "bucket").orderBy("doc_id", "piece_no")
    ranked = items.where("n_tokens > 0").withColumn("rank", F.row_number().over(order))
    columns = ["doc_id", "piece_no", "token_start", (F.col("token_start") + F.col("n_tokens")).alias("token_end"), "n_tokens"]
    placed = ranked.select(*columns, "bucket", "rank").mapInPandas(place, "doc_id long, piece_no int, token_start long, token_end long, n_tokens long, container_id long")
    return placed.unionByName(items.where("n_tokens = 0").select(*columns, F.lit(None).cast("long").alias("container_id")))
