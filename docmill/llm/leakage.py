"""Problem 7: evaluation passages inside training texts.

Method: a BM25 inverted index of the test items, searched by block-max WAND with every training
passage.  Items are indexed in units of at most UNIT words.  Each posting holds the share of its
unit's BM25 mass that the term carries, in parts of the share asked of that unit: what one of two
stretches that together make the asked coverage would hold of it.  So the threshold is fair to
items of any length.  A search orders the passage's terms by their upper bounds; terms before
the pivot cannot reach the threshold together and are only looked up for units that the others
brought in; bounds per block of units drop most of those.  Every item with a unit at or above
the threshold is then verified on the whole text: chains of equal word runs that allow single
words changed, added or left out must cover the asked share of the item in at most two
stretches.  For each verified pair the share of the question's words that the text holds too
tells whether only the passage leaked or question and passage (both).

Texts are read once, in place; nothing is shuffled.  The index is broadcast: items are indexed
in blocks of at most INDEX_BYTES of text, and more items mean more passes, never a larger index.

Defined cases: null and blank texts and items hold nothing; case, punctuation, white space and
line breaks never matter; words are cut at every character that is not a letter, a digit or an
underscore; equal rows give equal results.  Each pair comes out once per row of the texts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"\w+")
K1, B = 1.2, 0.75
#: Words of a unit of an item, and words and step of a passage of a text.
UNIT, PASSAGE, STEP = 160, 256, 128
#: A passage is verified if it holds this part of the BM25 mass that one stretch of an item would have, were all words alike.
THRESHOLD = 0.75
#: Share of an item's words that must stand in the text, and the longest break within a stretch.
COVERAGE, BREAK = 0.4, 3
#: Share of a question's words from which on the question counts as leaked beside its passage.
QUESTION = 0.8
BLOCK = 16
#: Text indexed at once, in bytes; the index takes some six times as much. Passages x units scored at once.
INDEX_BYTES, CELLS = 16 << 20, 1 << 22
#: Rounding of the sums.
SLACK = 1e-9
FOUND = "doc_id long, item_id long, bm25_share double, coverage double, stretches int, first_word int, question_share double, both boolean"


#: A stretch of the asked share keeps at least this part of it as equal pairs of words.
BIGRAMS = 0.55
ASCII_WORDS = bytes(c if chr(c).isalnum() or c == 95 or c > 127 else 32 for c in range(256))


def words_of(text: str) -> list[bytes]:
    """Lower-case words; the pattern WORD, by a faster way where the text is ASCII."""
    low = text.lower()
    return low.encode().translate(ASCII_WORDS).split() if low.isascii() else " ".join(WORD.findall(low)).encode().split()


class ItemIndex:
    """Postings by term with an upper bound for each term and for each block of units.

    A unit is an item, or UNIT words of a longer item, each beginning UNIT / 2 words after the
    one before.  Weights are shares of the unit's BM25 mass over the share that a passage has to
    hold, so that 1 is the threshold of every unit.  All arrays are as long as the postings.
    """

    def __init__(self, ids: list[int], texts: list[str], questions: list[str | None], threshold: float = THRESHOLD, coverage: float = COVERAGE) -> None:
        words = [words_of(t or "") for t in texts]
        keep = [k for k, w in enumerate(words) if w]
        self.ids = [ids[k] for k in keep]
        self.vocabulary: dict[bytes, int] = {}
        number = self.vocabulary.setdefault
        self.items = [np.array([number(t, len(self.vocabulary)) for t in words[k]], dtype=np.int32) for k in keep]
        self.questions = [frozenset(self.vocabulary.get(t, -2) for t in words_of(questions[k] or "")) for k in keep]
        cuts = [(k, a, min(a + UNIT, len(w)), len(w)) for k, w in enumerate(self.items) for a in range(0, max(1, len(w) - UNIT // 2), UNIT // 2)]
        cut = np.array(cuts, dtype=np.int64).reshape(-1, 4)
        self.owner = cut[:, 0]
        size = cut[:, 2] - cut[:, 1]
        n, v = len(cut), len(self.vocabulary)
        self.n, self.n_terms = n, v
        term = np.concatenate([self.items[k][a:z] for k, a, z, _ in cuts]).astype(np.int64) if n else np.empty(0, dtype=np.int64)
        self.key, count = np.unique(term * max(n, 1) + np.repeat(np.arange(n), size), return_counts=True)
        term, self.unit = self.key // max(n, 1), (self.key % max(n, 1)).astype(np.int32)
        df = np.bincount(term, minlength=v)
        idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
        base = K1 * (1 - B + B * size / max(size.mean() if n else 1.0, 1e-9))
        weight = idf[term] * count * (K1 + 1) / (count + base[self.unit])
        mass = np.maximum(np.bincount(self.unit, weights=weight, minlength=n), 1e-12)
        stretch = np.ceil(cut[:, 3] * coverage / 2)  # one of two stretches; what of it one unit and one passage hold for sure
        sure = np.where(stretch <= UNIT // 2, stretch, np.minimum((stretch + UNIT // 2) // 2, 3 * UNIT // 4))
        self.least = threshold * np.minimum(sure / np.maximum(size, 1), 1.0)
        self.weight = weight / (mass * self.least)[self.unit]
        self.start = np.searchsorted(term, np.arange(v + 1))
        self.bound = np.maximum.reduceat(self.weight, self.start[:-1]) if v else np.zeros(0)
        self.blocks = -(-n // BLOCK) or 1
        cell = term * self.blocks + self.unit // BLOCK
        begins = np.flatnonzero(np.diff(cell, prepend=-1))
        self.block = (cell[begins] % self.blocks).astype(np.int32)
        self.block_bound = np.maximum.reduceat(self.weight, begins) if n else np.zeros(0)
        self.block_start = np.searchsorted(cell[begins] // self.blocks, np.arange(v + 1))
        # postings in more than an eighth of the units stand as whole rows too: at most eight cells a posting
        common = np.flatnonzero(df * 8 > n)
        self.row = np.full(v, -1, dtype=np.int32)
        self.row[common] = np.arange(len(common))
        self.table = np.zeros((len(common), n))
        own = self.row[term] >= 0
        self.table[self.row[term[own]], self.unit[own]] = self.weight[own]
        pairs = [np.unique(w[:-1].astype(np.int64) * v + w[1:]) for w in self.items]
        self.n_pairs = np.array([len(x) for x in pairs], dtype=np.int64)
        code, owner = np.concatenate([*pairs, np.empty(0, dtype=np.int64)]), np.repeat(np.arange(len(pairs)), self.n_pairs)
        order = np.argsort(code, kind="stable")
        self.pair_item = owner[order].astype(np.int32)
        self.pair, begins = np.unique(code[order], return_index=True)
        self.pair_start = np.append(begins, len(code))

    def weights(self, term: np.ndarray, unit: np.ndarray) -> np.ndarray:
        key = term * self.n + unit
        slot = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[slot] == key, self.weight[slot], 0.0)

    def shared_pairs(self, texts: list[np.ndarray]) -> dict[tuple[int, int], int]:
        """How many distinct pairs of neighbouring words of each item each text has, where any."""
        if not len(self.pair):
            return {}
        doc = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        word = np.concatenate(texts)
        on = (doc[:-1] == doc[1:]) & (word[:-1] >= 0) & (word[1:] >= 0)
        code, doc = word[:-1][on] * self.n_terms + word[1:][on], doc[:-1][on]
        slot = np.minimum(np.searchsorted(self.pair, code), len(self.pair) - 1)
        hit = self.pair[slot] == code
        both = np.unique(doc[hit] * len(self.pair) + slot[hit])
        doc, slot = both // len(self.pair), both % len(self.pair)
        at, size = _ranges(self.pair_start[slot], self.pair_start[slot + 1])
        code, count = np.unique(np.repeat(doc, size) * len(self.items) + self.pair_item[at], return_counts=True)
        doc, item = code // len(self.items), code % len(self.items)
        return dict(zip(zip(doc.tolist(), item.tolist(), strict=True), count.tolist(), strict=True))

    def search(self, passage: np.ndarray, term: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All (passage, unit, share of the unit's mass) at or above the unit's threshold.

        passage and term are the distinct pairs, sorted by passage; n is the number of passages.
        So many passages are taken at once that passages x units stays within CELLS.
        """
        at_once = max(1, CELLS // max(self.n, 1))
        out = []
        for lo in range(0, n, at_once):
            a, z = np.searchsorted(passage, lo), np.searchsorted(passage, lo + at_once)
            p, u, s = self._some(passage[a:z] - lo, term[a:z], min(at_once, n - lo))
            out.append((p + lo, u, s * self.least[u]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.empty(0, dtype=np.int64),) * 3

    def _some(self, passage: np.ndarray, term: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.lexsort((self.bound[term], passage))
        passage, term = passage[order], term[order]
        sums = np.cumsum(self.bound[term])
        first = np.searchsorted(passage, np.arange(n + 1))
        before = np.concatenate(([0.0], sums))[first[:-1]]
        low = sums - before[passage] < 1 - SLACK  # terms before the pivot of their passage
        p, t = passage[~low], term[~low]
        at, size = _ranges(self.start[t], self.start[t + 1])
        score = np.bincount(np.repeat(p * self.n, size) + self.unit[at], weights=self.weight[at], minlength=n * self.n).reshape(n, self.n)
        few_p, few_t = passage[low], term[low]
        at, size = _ranges(self.block_start[few_t], self.block_start[few_t + 1])
        rest = np.bincount(np.repeat(few_p * self.blocks, size) + self.block[at], weights=self.block_bound[at], minlength=n * self.blocks).reshape(n, self.blocks)
        live_p, live_u = np.nonzero(score)
        on = score[live_p, live_u] + rest[live_p, live_u // BLOCK] >= 1 - SLACK
        live_p, live_u = live_p[on], live_u[on]
        total = score[live_p, live_u]
        if len(live_p) and len(few_p):
            row = self.row[few_t]
            whole = row >= 0  # terms with whole rows: looked up for all units in one product
            held = np.zeros((n, len(self.table)))
            held[few_p[whole], row[whole]] = 1.0
            total = total + (held @ self.table)[live_p, live_u]
            few_p, few_t = few_p[~whole], few_t[~whole]
            at, size = _ranges(np.searchsorted(few_p, live_p, "left"), np.searchsorted(few_p, live_p, "right"))
            owner = np.repeat(np.arange(len(live_p)), size)
            total = total + np.bincount(owner, weights=self.weights(few_t[at], live_u[owner]), minlength=len(live_p))
        hit = total >= 1 - SLACK
        return live_p[hit], live_u[hit], total[hit]


def _ranges(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places from each start to its end, one range after the other, and the sizes."""
    size = end - start
    return np.arange(size.sum()) + np.repeat(start - np.concatenate(([0], np.cumsum(size)[:-1])), size), size


def runs(item: np.ndarray, text: np.ndarray) -> list[tuple[int, int, int]]:
    """Maximal equal runs of at least two words: (item position, text position, length)."""
    item = item.astype(np.int64)
    top = int(max(item.max(initial=0), text.max(initial=0))) + 2
    a, b = item[:-1] * top + item[1:], text[:-1] * top + text[1:]
    b = np.where((text[:-1] < 0) | (text[1:] < 0), -1, b)
    order = np.argsort(a, kind="stable")
    low, high = np.searchsorted(a[order], b, "left"), np.searchsorted(a[order], b, "right")
    size = high - low
    j = np.repeat(np.arange(len(b)), size)
    i = order[np.arange(size.sum()) + np.repeat(low - np.concatenate(([0], np.cumsum(size)[:-1])), size)] if len(j) else j
    by = np.lexsort((j, j - i))
    i, j = i[by], j[by]
    out: list[tuple[int, int, int]] = []
    for x, y in zip(i.tolist(), j.tolist(), strict=True):
        if out and out[-1][0] + out[-1][2] - 1 == x and out[-1][1] + out[-1][2] - 1 == y:
            out[-1] = (out[-1][0], out[-1][1], out[-1][2] + 1)
        else:
            out.append((x, y, 2))
    return sorted(out, key=lambda r: (r[1], r[0]))


def stretch(found: list[tuple[int, int, int]]) -> tuple[int, int, int, int, int]:
    """The heaviest chain of runs: (words, item from, item to, text from, text to)."""
    best = [r[2] for r in found]
    back = [-1] * len(found)
    live: list[int] = []  # runs that end late enough in the text to be gone on from
    for s, (i, j, n) in enumerate(found):
        live = [r for r in live if found[r][1] + found[r][2] + BREAK >= j]
        for r in live:
            a, b, m = found[r]
            gap_i, gap_j = i - (a + m), j - (b + m)
            over = max(0, -gap_i, -gap_j)
            if a < i and b < j and over < n and gap_i <= BREAK and gap_j <= BREAK and best[r] + n - over > best[s]:
                best[s], back[s] = best[r] + n - over, r
        live.append(s)
    last = max(range(len(found)), key=lambda s: best[s])
    first = last
    while back[first] >= 0:
        first = back[first]
    return best[last], found[first][0], found[last][0] + found[last][2], found[first][1], found[last][1] + found[last][2]


def outside(found: list[tuple[int, int, int]], used: tuple[int, int, int, int, int]) -> list[tuple[int, int, int]]:
    """What is left of the runs before or after a stretch, in the item and in the text."""
    _, a, b, c, d = used
    out = []
    for i, j, n in found:
        k = 0
        while k < n:  # the parts of the run that touch neither range
            while k < n and (a <= i + k < b or c <= j + k < d):
                k += 1
            begin = k
            while k < n and not (a <= i + k < b or c <= j + k < d):
                k += 1
            if k - begin >= 2:
                out.append((i + begin, j + begin, k - begin))
    return out


def covered(item: np.ndarray, text: np.ndarray, least: float = 0.0) -> tuple[float, int, int]:
    """Share of the item's words in the best one or two stretches, how many, and where they begin.

    Shares below least may come out as 0.
    """
    found = runs(item, text)
    marks = np.zeros(len(item) + 1, dtype=np.int64)
    for i, _, n in found:
        marks[i] += 1
        marks[i + n] -= 1
    if not found or (np.cumsum(marks[:-1]) > 0).sum() < least * len(item):
        return 0.0, 0, 0
    one = stretch(found)
    rest = outside(found, one)
    two = stretch(rest) if rest else None
    words = one[0] + (two[0] if two else 0)
    return min(1.0, words / len(item)), 1 + bool(two and two[0] >= 5), min(one[3], two[3] if two and two[0] >= 5 else one[3])


def _passages(docs: list[np.ndarray], n_terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (passage, term) of some texts, and the text of each passage."""
    owner, parts, size = [], [], []
    for k, ids in enumerate(docs):
        for a in range(0, max(1, len(ids) - STEP), STEP):
            owner.append(k)
            parts.append(ids[a : a + PASSAGE])
            size.append(len(parts[-1]))
    term = np.concatenate(parts)
    code = np.repeat(np.arange(len(parts)), size) * n_terms + term
    code = np.sort(code[term >= 0])
    code = code[np.diff(code, prepend=-1) > 0]
    return code // n_terms, code % n_terms, np.array(owner)


def _search(shared, coverage: float):
    def found(index: ItemIndex, docs: list, texts: list[np.ndarray]) -> list[tuple]:
        passage, term, owner = _passages(texts, index.n_terms)
        ps, us, scores = index.search(passage, term, len(owner))
        shares: dict[tuple[int, int], float] = {}
        for d, k, s in zip(owner[ps].tolist(), index.owner[us].tolist(), scores.tolist(), strict=True):
            shares[d, k] = max(s, shares.get((d, k), 0.0))
        rows = []
        least = np.maximum(1, np.ceil(BIGRAMS * coverage * index.n_pairs)).tolist()
        equal = index.shared_pairs(texts) if shares else {}
        for (d, k), s in sorted(shares.items()):
            if equal.get((d, k), 0) < least[k]:
                continue
            ids = texts[d]
            share, n, first = covered(index.items[k], ids, coverage)
            if share >= coverage:
                marked = set(ids.tolist())
                question = index.questions[k]
                asked = len(question & marked) / len(question) if question else None
                rows.append((docs[d], index.ids[k], s, share, n, first, asked, asked is not None and asked >= QUESTION))
        return rows

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index: ItemIndex = shared.value
        get = index.vocabulary.get
        for batch in batches:
            rows, docs, texts, size = [], [], [], 0
            for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                words = words_of(text) if text else []
                if not words:
                    continue
                docs.append(doc)
                texts.append(np.fromiter(map(get, words, repeat(-1)), dtype=np.int64, count=len(words)))
                size += len(words)
                if size > 200_000:  # bounds memory, not the texts
                    rows += found(index, docs, texts)
                    docs, texts, size = [], [], 0
            if docs and index.n:
                rows += found(index, docs, texts)
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in FOUND.split(", ")])

    return run


def leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, coverage: float = COVERAGE, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """docs(doc_id, text), items(item_id, question, text) -> each text with each item it contains."""
    context = docs.sparkSession.sparkContext
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null")
    kept = items.where("item_id is not null and text is not null").select("item_id", "question", "text")
    size = kept.agg(F.sum(F.octet_length("text") + F.coalesce(F.octet_length("question"), F.lit(0)))).first()[0] or 0
    blocks = max(1, -(-size // index_bytes))
    out = []
    for k in range(blocks):
        part = kept if blocks == 1 else kept.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k)
        rows = part.orderBy("item_id").collect()  # at most about index_bytes of text
        index = ItemIndex([r.item_id for r in rows], [r.text for r in rows], [r.question for r in rows], threshold, coverage)
        out.append(texts.mapInPandas(_search(context.broadcast(index), coverage), FOUND))
    return reduce(DataFrame.unionByName, out)
