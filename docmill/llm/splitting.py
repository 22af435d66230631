"""Problem 3: cutting oversized texts into overlapping pieces at natural boundaries.

Method: agglomerative merging.  A text is first cut into atomic segments; adjacent pairs wait in
a heap by the strength of the boundary between them; the weakest boundary is removed first,
while the merged size plus the overlap fits the limit.  What remains standing are the strongest
boundaries, and they become the cuts.

The work on one text needs no other row, so there is no shuffle; texts within the limit never
leave the JVM.  A text is worked through in memory proportional to its own length.

Defined cases: null, empty and blank texts and those within the limit give no piece; a single
word is never cut; where a text has no boundary at all it is cut between words.  Rows that
repeat a key give their pieces once.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PIECES = "record_kind string, record_id long, piece_no int, n_pieces int, n_words int, overlap_words int, char_start int, char_end int, cut string, text string"

#: Strength of a boundary and its name.
NAMES = {0: "word", 1: "comma", 2: "clause", 3: "line", 4: "sentence", 5: "item", 6: "paragraph", 7: "heading", 9: "end"}

WORD = re.compile(r"\S+")
#: What ends in a full stop without ending a sentence.
ABBREVIATIONS = set("mr mrs ms dr smt shri adv prof hon no nos para paras art rs inr st sr jr vs v viz exh ex ltd pvt co m/s ors anr p pp vol sec cl i.e e.g etc fig dt ref".split())
OPENS_ITEM = re.compile(r"(?:[-*•–]|\(?[0-9ivxa-zA-Z]{1,4}[.)]|\d+(?:\.\d+)*\.?$|\|)")
OPENS_HEADING = re.compile(r"#{1,6}$|<!--")


def n_words(text: Column) -> Column:
    """Runs of characters that are not white space; the no-break space is white space."""
    return F.size(F.split(F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", ""), r"(?U)[\s\x1c-\x1f]+")) - F.when(F.regexp_replace(text, r"(?U)[\s\x1c-\x1f]+", "") == "", 1).otherwise(0)


def strength(gap: str, before: str, after: str) -> int:
    """How natural a cut is between two words, by the white space and the marks around it."""
    lines = gap.count("\n") + (gap.count("\r") if "\n" not in gap else 0)
    last = before.rstrip("\"'”’)]»*_")[-1:]
    ends = last in ".?!…" and last != "" and not (last == "." and (before.rstrip(".").lower().lstrip("(") in ABBREVIATIONS or len(before) == 2 and before[0].isupper()))
    if lines:
        if OPENS_HEADING.match(after):
            return 7
        if lines > 1:
            return 6
        if OPENS_ITEM.match(after):
            return 5
        return 4 if ends else 3
    if ends and (after[:1].isupper() or not after[:1].isalpha()):
        return 4
    return 2 if last in ";:" and last else 1 if last == "," else 0


def pieces(text: str, limit: int, overlap: int) -> list[tuple[int, int, int, int, int, str]]:
    """(first word with overlap, first own word, end word, char start, char end, cut) of each piece."""
    spans = [m.span() for m in WORD.finditer(text)]
    n = len(spans)
    if n <= limit:
        return []
    room = limit - overlap
    if room < 1:
        raise ValueError("the limit must exceed the overlap")
    words = [text[a:b] for a, b in spans]
    # strength of the boundary before word i
    force = [9] + [strength(text[spans[i - 1][1] : spans[i][0]], words[i - 1], words[i]) for i in range(1, n)]
    starts = [0]
    level = [i for i in range(1, n) if force[i] >= 3] + [n]
    for end in level:  # atomic: up to a line or sentence end; longer runs at clauses, then between words
        begin = starts[-1]
        if end - begin > room:
            inner = [i for i in range(begin + 1, end) if force[i] >= 1] + [end]
            for stop in inner:
                starts.extend(range(starts[-1] + room, stop, room))
                if stop < end:
                    starts.append(stop)
        if end < n:
            starts.append(end)
    after = {a: b for a, b in zip(starts, [*starts[1:], n], strict=True)}
    before = {b: a for a, b in after.items()}
    heap = [(force[s], after[s] - before[s], s) for s in starts[1:]]
    heapq.heapify(heap)
    while heap:
        weight, size, cut = heapq.heappop(heap)
        if cut not in after or cut not in before:
            continue
        begin, end = before[cut], after[cut]
        if size != end - begin:  # a neighbour grew meanwhile
            heapq.heappush(heap, (weight, end - begin, cut))
            continue
        if size + (overlap if begin else 0) > limit:
            continue
        del after[cut], before[cut]
        after[begin], before[end] = end, begin
        # neighbours' entries are refreshed when they surface
    out, begin = [], 0
    while begin < n:
        end = after[begin]
        first = max(0, begin - overlap)
        out.append((first, begin, end, spans[first][0], spans[end - 1][1], NAMES[9 if end == n else force[end]]))
        begin = end
    return out


def _split(limit: int, overlap: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for kind, key, text in zip(batch["record_kind"], batch["record_id"], batch["text"], strict=True):
                made = pieces(text, limit, overlap)
                for k, (first, begin, end, a, b, cut) in enumerate(made):
                    rows.append((kind, key, k, len(made), end - first, begin - first, a, b, cut, text[a:b]))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in PIECES.split(", ")])

    return run


def split_oversized(records: DataFrame, limit: int, overlap: int = 30) -> DataFrame:
    """records(record_kind, record_id, text) -> the pieces of each text of more than limit words.

    Consecutive pieces cover the text; each after the first begins with the last overlap words
    of the one before; none has more than limit words.
    """
    return records.select("record_kind", "record_id", "text").where(n_words(F.col("text")) > limit).mapInPandas(_split(limit, overlap), PIECES)


def split_records(sources: list[tuple[DataFrame, int]], overlap: int = 30) -> DataFrame:
    """The union over several sources, each with a limit of its own."""
    return reduce(DataFrame.unionByName, [split_oversized(df, limit, overlap) for df, limit in sources])
