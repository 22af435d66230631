"""Problem 5: personal information inside free text.

Method: a character-level bidirectional LSTM with CRF transitions, trained in numpy from labelled
spans (pii_labels), tags every character.  A text is cut where a sentence surely ends; a segment
longer than a window is read in overlapping windows, whose scores are blended where they overlap,
and the whole segment is then decoded as one sequence.  Runs of a tag become spans, which must
hold what their type cannot do without, and are replaced by a placeholder of the type.

Each text is tagged where it is, without a shuffle; segments that are
equal but for their digits are tagged once in a task.
Weights are a small file read once by each worker.

Defined cases: null texts give no row in the result of spans and stay null when replaced; empty
and blank texts hold nothing; texts of any length are read to the end.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.llm import pii_model
from docmill.llm.pii_model import TYPES

WEIGHTS = str(Path(__file__).with_name("pii_weights.npz"))
WINDOW, OVERLAP = 208, 56
#: Segments tagged together, and remembered at most in a task.
TOGETHER, REMEMBERED = 8192, 250_000
BATCH, STRETCH = 512, 4096
#: Characters x long segments decoded together; a longer one is decoded alone.
CELLS = 1 << 20

#: To the tagger all digits are alike, so segments that differ in digits are tagged once.
DIGITS = str.maketrans("123456789", "000000000")


def masked(text: str) -> str:
    """What text.translate(DIGITS) gives, in a fraction of its time."""
    for digit in "123456789":
        text = text.replace(digit, "0")
    return text


DATE = re.compile(r"\d{1,2}([./-])\d{1,2}\1\d{2,4}|\d{4}-\d\d-\d\d")
RUN = re.compile(rb"([\x01-\x05])\1*")
ENDS = re.compile(r"\.(?<=[a-z]{3}\.)(?<!Capt\.)(?<!Prof\.)(\s+)(?=[A-Z])")


def segments(text: str) -> list[tuple[int, int]]:
    """Where a text is cut: after a full stop behind a word in lower case and before a capital."""
    out, begin = [], 0
    for m in ENDS.finditer(text):
        out.append((begin, m.start(1)))
        begin = m.end()
    if begin < len(text):
        out.append((begin, len(text)))
    return out


@lru_cache(maxsize=2)
def weights(path: str = WEIGHTS) -> dict[str, np.ndarray]:
    with np.load(path) as f:
        return pii_model.ready({k: f[k].astype(np.float32) for k in f.files})


#: How much each place of a window counts where windows overlap: less towards the edges.
RAMP = (np.minimum(np.arange(1, WINDOW + 1), np.arange(WINDOW, 0, -1)).clip(max=OVERLAP) / OVERLAP).astype(np.float32)


def tag_segments(texts: list[str], p: dict[str, np.ndarray]) -> list[np.ndarray | None]:
    """The tags of each segment; None where nothing is tagged.

    Of a segment longer than a window the scores of its windows are blended by RAMP first, and
    the whole segment is decoded as one sequence.  Windows are read in batches of similar
    length; what may be tagged in any of them is decoded together.
    """
    codes, size = pii_model.encode("".join(texts)), np.array([len(t) for t in texts], dtype=np.int64)
    step = WINDOW - OVERLAP
    count = -(-np.maximum(size - OVERLAP, 1) // step)
    owner = np.repeat(np.arange(len(texts)), count)
    at = (np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)) * step
    length = np.minimum(size[owner] - at, WINDOW)
    begin = (np.cumsum(size) - size)[owner] + at
    blended: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    parts: list[tuple] = []  # of stretches: segment, begin, end, first, last, scores

    def keep(e: np.ndarray, segment: np.ndarray) -> None:
        column, a, z = pii_model.stretches(e, p["t"])
        parts.append((segment[column], a, z, a == 0, z == len(e), e[pii_model.places(column, a, z)]))

    order = np.argsort(length, kind="stable")
    order = order[length[order] > 0]
    for part in (order[lo : lo + BATCH] for lo in range(0, len(order), BATCH)):
        n, place = length[part], np.arange(length[part[-1]])[:, None]
        x = codes[np.minimum(place, n - 1) + begin[part]]
        x[place >= n] = pii_model.PAD
        e = pii_model.emissions(x, p)
        whole = size[owner[part]] <= WINDOW
        if whole.all():
            keep(e, owner[part])
            continue
        if whole.any():
            keep(e[:, whole], owner[part[whole]])
        for i, score in zip(part[~whole], np.ascontiguousarray(e[:, ~whole].transpose(1, 0, 2)), strict=True):
            k, a, m = int(owner[i]), at[i], length[i]
            total, weight = blended.setdefault(k, (np.zeros((size[k], pii_model.TAGS), dtype=np.float32), np.zeros(size[k], dtype=np.float32)))
            total[a : a + m] += score[:m] * RAMP[:m, None]
            weight[a : a + m] += RAMP[:m]
    order = np.array(sorted(blended, key=lambda k: size[k]), dtype=np.int64)
    while len(order):  # long segments of similar length go together
        part = order[: max(1, CELLS // int(size[order[0]]))][:BATCH]
        part = part[: max(1, CELLS // int(size[part[-1]]))]
        order = order[len(part) :]
        e = np.full((size[part[-1]], len(part), pii_model.TAGS), -100.0, dtype=np.float32)
        e[:, :, 0] = 0.0  # beyond the end nothing is tagged
        for j, k in enumerate(part.tolist()):
            total, weight = blended.pop(k)
            e[: size[k], j] = total / weight[:, None]
        keep(e, part)
    out: list[np.ndarray | None] = [None] * len(texts)
    if not parts:
        return out
    segment, a, z, first, last, values = (np.concatenate(x) for x in zip(*parts, strict=True))
    tags = pii_model.decoded(values, z - a, first, last, p["t"])
    done = 0
    for k, lo, hi in zip(segment.tolist(), a.tolist(), z.tolist()):
        run = tags[done : done + hi - lo]
        done += hi - lo
        if run.any():
            if out[k] is None:
                out[k] = np.zeros(size[k], dtype=np.uint8)
            out[k][lo:hi] = run[: max(0, int(size[k]) - lo)]  # without what stands beyond the end
    return out


#: What ends in a full stop within an address or a name.
DOTTED = re.compile(r"(?:\b(?:St|Rd|Ln|Ave|Apt|Jr|Sr|No|[A-Z])|\.\w)\.$")
EMAIL_END = re.compile(r"[\w%+-]*(?:[.@][\w%+-]+)*")


def found(text: str, tags: np.ndarray | None) -> list[tuple[int, int, str]]:
    """Spans (start, end, type) of a segment that hold what their type needs."""
    if tags is None:
        return []
    out = []
    for run in RUN.finditer(tags.tobytes()):
        a, b = run.span()
        kind = TYPES[tags[a] - 1]
        while a < b and not (text[a].isalnum() or text[a] in "+("):
            a += 1
        while a < b and not (text[b - 1].isalnum() or text[b - 1] == ")" and "(" in text[a:b] or text[b - 1] == "." and DOTTED.search(text[a:b])):
            b -= 1
        if kind == "email":  # to the end of the domain
            b = EMAIL_END.match(text, b).end()
        if out and a < out[-1][1]:
            continue
        span = text[a:b]
        digits, letters = sum(map(str.isdigit, span)), sum(map(str.isalpha, span))
        ok = {  # looked at only where something is tagged
            "email": len(span) > 5 and letters > 3 and bool(re.search(r"@|\bat\b", span, re.IGNORECASE)),
            "phone": digits >= 7 and not DATE.fullmatch(span),
            "identity_number": digits >= 4,
            "street_address": digits >= 1 and letters >= 6 and bool(re.search(r"[A-Z]", span)),
            "person_name": letters >= 3 and digits * 4 <= letters and bool(re.search(r"[^\W\d_]{2}", span)) and (" " in span or span[:1].isupper()),
        }[kind]
        if ok:
            out.append((a, b, kind))
    return out


def _spans(path: str, redact: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = weights(path)
        known: dict[str, list] = {}  # spans of the segments of this task
        for batch in batches:
            keys, texts = list(zip(batch["record_kind"], batch["record_id"], strict=True)), batch["text"].tolist()
            result = []
            for lo in range(0, len(texts), STRETCH):
                cut = [segments(t) if t else [] for t in texts[lo : lo + STRETCH]]
                plain = [masked(t) if t else "" for t in texts[lo : lo + STRETCH]]
                new = list(dict.fromkeys(t[a:b] for t, parts in zip(plain, cut, strict=True) for a, b in parts if t[a:b] not in known))
                for at in range(0, len(new), TOGETHER):
                    part = new[at : at + TOGETHER]
                    for s, tags in zip(part, tag_segments(part, p), strict=True):
                        known[s] = found(s, tags)
                for t, parts in zip(plain, cut, strict=True):
                    result.append([(a + x, a + y, kind) for a, b in parts for x, y, kind in known[t[a:b]]])
                if len(known) > REMEMBERED:
                    known.clear()
            if redact:
                yield pd.DataFrame({"record_kind": [k[0] for k in keys], "record_id": [k[1] for k in keys], "text": [replaced(t, s) for t, s in zip(texts, result, strict=True)]})
            else:
                rows = [(*k, kind, a, b, t[a:b]) for k, t, s in zip(keys, texts, result, strict=True) for a, b, kind in s]
                yield pd.DataFrame(rows, columns=["record_kind", "record_id", "pii_type", "start", "end", "value"])

    return run


def replaced(text: str | None, spans: list[tuple[int, int, str]]) -> str | None:
    if text is None:
        return None
    out, at = [], 0
    for a, b, kind in spans:
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join([*out, text[at:]])


def personal_spans(records: DataFrame, path: str = WEIGHTS) -> DataFrame:
    """records(record_kind, record_id, text) -> a row for each item of personal information."""
    rows = records.select("record_kind", F.col("record_id").cast("long").alias("record_id"), "text").where("text is not null")
    return rows.mapInPandas(_spans(path, False), "record_kind string, record_id long, pii_type string, start int, end int, value string")


def redacted(records: DataFrame, path: str = WEIGHTS) -> DataFrame:
    """records(record_kind, record_id, text) -> the same with placeholders in the text."""
    rows = records.select("record_kind", F.col("record_id").cast("long").alias("record_id"), "text")
    return rows.mapInPandas(_spans(path, True), "record_kind string, record_id long, text string")
