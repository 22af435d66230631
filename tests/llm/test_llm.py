from __future__ import annotations

import itertools
import os
import random
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docmill.llm import leakage, linking, names, packing, pii, pii_model, scans, splitting, subjects, survivors

# 1: scanned text ------------------------------------------------------------------------------

COMMON = "the matter was heard and order shall be placed before bench for days to come with reply that annexed certificate commission filed".split()


def lexicon():
    return scans.Lexicon({w: 500 for w in COMMON} | {"non-agricultural": 400}, None, None)


@pytest.mark.parametrize(
    ("text", "defects"),
    [
        ("the commis-\nsion was heard", {"hyphenation"}),
        ("the certi\xad\n\nPage 3 of 9\n\nficate was filed", {"hyphenation", "page_number"}),
        ("the non-\nagricultural order", set()),
        ("the rnatter was hearcl", {"misread"}),
        ("the 0rder 5hall be p1aced", {"misread"}),
        ("the matter was\nPaper book volume 2\nheard and placed", {"header"}),
        ("the matter was placed before\nActon Works LLP v. Beeford Port Trust    [12]\nthe bench.", {"header", "page_number"}),
        ("the matter was heard.\n\n— 7 —\n\nThe order shall be filed.", {"page_number"}),
        ("the matter was heard on 12/05/2018 by R24 and PW-3/36.", set()),
        ("8.\nthe matter was heard\n9.\nthe order was filed", set()),
        ("Glaikzo Bcnch of Nivdreein", set()),
        ("", set()),
        ("  \n ", set()),
    ],
)
def test_scan_defects(text, defects):
    assert scans.clean(text, lexicon(), frozenset())[1] == defects


def test_scan_text_is_kept():
    made, _ = scans.clean("the commis-\nsion was\n\nPg. 4\n\nheard for 14 clays\nbefore the bench.\n\n(a) the reply\n(b) the order", lexicon(), frozenset())
    assert made == "the commission was heard for 14 days before the bench.\n\n(a) the reply\n(b) the order"


def test_scan_repair_over_tables(spark):
    texts = ["the matter was heard and the order shall be placed before the bench for days to come"] * 30
    rows = [("t", i, "f", None, t) for i, t in enumerate(texts)] + [("t", 90, "f", None, None), ("t", 91, None, None, ""), ("t", 92, "f", None, "the rnatter was\nBook of Names\nheard"), ("t", 93, "f", None, "the order\nBook of Names\nwas placed")]
    df = spark.createDataFrame(rows, "record_kind string, record_id long, file string, title string, text string").selectExpr("*", "1 as repeated", "2 as defects")
    got = {r.record_id: r for r in scans.repair(df).collect()}
    assert 90 not in got and got[91].defects == []
    assert "misread" in got[92].defects and "header" in got[92].defects and got[92].text == "the matter was heard"
    assert scans.repair(df.limit(0)).count() == 0


def test_skip_gram_puts_words_of_one_context_together(spark, monkeypatch):
    n = np.ones((6, 6), dtype=np.int64)
    n[:3, :3] = n[3:, 3:] = 50
    found = []
    for size in (64, 4):  # whatever the blocks, the vectors are the same
        monkeypatch.setattr(scans, "BLOCK", size)
        rows = [(k, [(a - k * size << scans.COUNT_BITS + scans.WORD_BITS) | (b << scans.COUNT_BITS) | int(n[a, b]) for a in range(k * size, min(6, k * size + size)) for b in range(6)]) for k in range(-(-6 // size))]

        class Local:
            """The blocks in place: the fit asks them for nothing but their gradients."""

            sparkSession = spark

            def mapInPandas(self, f, schema, rows=rows):  # noqa: N802
                self.out = pd.concat(f(iter([pd.DataFrame(rows, columns=["block", "packed"])])))
                return self

            def toLocalIterator(self):  # noqa: N802
                return self.out.itertuples()

        u, _ = scans.skip_gram(Local(), n.sum(axis=1).astype(float), 8, 60)
        found.append(u / np.linalg.norm(u, axis=1, keepdims=True))
    c = found[0] @ found[0].T
    assert c[0, 1] > c[0, 4] and c[3, 5] > c[3, 1]
    assert np.allclose(found[0], found[1], atol=1e-3)


@given(st.text(alphabet="abcdefhilmnoprtuv015!ſé-", min_size=1, max_size=7))
@settings(max_examples=300, deadline=None)
def test_near_words_are_those_that_edits_reach(word):
    words = {w: 9 for w in COMMON} | {w: 9 for w in ("cl", "ol", "in", "li", "hand", "did", "burn", "null", "tide", "void", "mill", "vain", "duel", "cold")}
    lexicon_ = scans.Lexicon(words, None, None)
    for w in (word, "c1aim", "rnilI", "vv0rd", "dicl", word.replace("m", "rn")):
        assert set(lexicon_.near(w)) == {e for e in scans.edits(w) if e in words}


# 2: names -------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [
        ("Mrs. Abigail K. Larnzuur", "Lárnzuur, Abigail", True), ("Bill Bluvotani", "W.Bluvotani", True), ("Quetnin Cheek", "Cheek Quentin K.", True), ("Katherine R. Baidao", "Katherine T. Baidao", False),
        ("Clara Ledjeka", "Charlotte Ledjeka", False), ("Acton Auto Comps Ltd", "Auto Components (Acton) Limited", True), ("Acton Foods LLP", "Acton Foods Limited", False), ("Acton Foods & Sons", "M/s ACTON FOODS &SONS", True),
        ("Acton Foods", "Acton Realtors", False), ("Prakash N. Krufoar", "Omprakash Krufoar", False),
    ],
)
def test_names(a, b, same):
    assert names.compatible(names.parse(a), names.parse(b)) is same


@pytest.mark.parametrize("text", [None, "", "  ", "12 May 2018", "Rs. 400", "District Court at Feestead", "Glaiport Municipal Council", "Bank of Kesondara", "Norbury", "WP/12/2010"])
def test_no_names(text):
    assert names.parse(text).kind == ""


@settings(max_examples=150, deadline=None)
@given(st.text("abc", max_size=9), st.text("abc", max_size=9))
def test_banded_distance(a, b):
    d = {}
    for i in range(-1, len(a) + 1):
        for j in range(-1, len(b) + 1):
            d[i, j] = i + j + 2 if i < 0 or j < 0 else 0
    for i in range(len(a)):
        for j in range(len(b)):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i] != b[j]))
            if i and j and a[i] == b[j - 1] and a[i - 1] == b[j]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    assert names.distance(a, b, 2) == min(3, d[len(a) - 1, len(b) - 1])


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_segment_join_misses_nothing(spark):
    rng = random.Random(2)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(1, 9))) for _ in range(70)})
    got = {(r.a, r.b) for r in linking.segment_join(spark.createDataFrame([("x", w) for w in words], "block string, word string"), ["block"]).collect()}
    want = {(a, b) for a in words for b in words if levenshtein(a, b) <= linking.allowed(min(len(a), len(b)))}
    assert want <= got and all(levenshtein(a, b) <= linking.EDITS for a, b in got)


def test_linked(spark):
    rows = [
        (1, "c", "Abigail K. Larnzuur"), (2, "c", "Lárnzuur, Abigail"), (3, "c", "A. Larnzuur"), (4, "c", "Abigail K. Larnzuur"), (5, "d", "Abigail Larnzuur"), (6, "c", "Acton Auto Components Limited"), (7, "c", "AACL"),
        (8, "c", "Kavita Orlov"), (9, "c", "Krishnan Orlov"), (10, "c", "K. Orlov"), (11, "c", None), (12, None, "Abigail Larnzuur"), (1, "c", "Abigail K. Larnzuur"), (13, "c", "District Court at Orlov"),
    ]
    df = spark.createDataFrame(rows, "candidate_id long, case_id string, text string").selectExpr("*", "7 as entity", "8 as node")
    got = {tuple(r) for r in linking.linked(df).collect()}
    assert got == {(1, 2), (1, 3), (2, 3), (2, 4), (3, 4), (6, 7)}
    assert linking.linked(df.limit(0)).count() == 0


def test_names_of_any_script_and_first_letter_meet(spark):
    """No block on initials: a typo in the first letter still meets; names in other scripts are names."""
    assert names.parse("Müller GmbH").kind == "firm" and names.parse("Global Widgets Inc").kind == "firm" and names.parse("University of Oxford").kind == "firm"
    assert names.parse("Иван Петров").kind == "person" and names.parse("12 March 2020").kind == "" and names.parse("Mumbai").kind == ""
    texts = ["Zuri M Okonkwo", "Suri M Okonkwo", "Иван К Петров", "Иван К Петроф", "Acme 3 Traders Private Limited", "Acmee 3 Traders Pvt Ltd", "Someone Else Entirely"]
    df = spark.createDataFrame([(i, "c", t) for i, t in enumerate(texts)], "candidate_id long, case_id string, text string").selectExpr("*", "1 as entity", "2 as part")
    assert {tuple(r) for r in linking.linked(df).collect()} == {(0, 1), (2, 3), (4, 5)}


def test_segments_and_names_are_planned_apart(spark, monkeypatch):
    """The driver plans the pairs of names without the segment join, whose table is gone afterwards."""
    plans, tables, real, kept = [], [], linking.materialize, linking.stored
    monkeypatch.setattr(linking, "materialize", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or real(df))
    monkeypatch.setattr(linking, "stored", lambda df: tables.append(kept(df)) or tables[-1])
    df = spark.createDataFrame([("c", "John Smithson"), ("c", "Jon Smithson"), ("c", "Mary Carpenter")], "case_id string, text string")
    entity = {r.text: r.entity for r in linking.entities(df).collect()}
    assert entity["John Smithson"] == entity["Jon Smithson"] != entity["Mary Carpenter"]
    assert any("_compatible" in p for p in plans) and not any("_compatible" in p and "seg#" in p for p in plans)
    assert len(tables) == 1 and not os.path.exists(tables[0][0].inputFiles()[0].removeprefix("file:").replace("///", "/"))


def test_closest_is_the_nearest_of_all():
    rng = random.Random(2)
    known = sorted(names.BUSINESS)
    for _ in range(300):
        w = list(rng.choice(known))
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = rng.choice("abcdefghijklmnopqrstuvwxyz")
        w = "".join(w)
        want = min((names.distance(w, x, 2), x) for x in known)
        assert names.closest(w, names.BUSINESS_MARKS, 2) == (want[1] if want[0] <= 2 else "")


# 3: splitting ---------------------------------------------------------------------------------


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["word", "end.", "Next", "a,", "b;", "\n", "\n\n", "# Head", "-", "x\xa0y"]), max_size=160), st.integers(8, 30), st.integers(0, 6))
def test_pieces(parts, limit, overlap):
    text = " ".join(parts)
    words = text.split()
    made = splitting.pieces(text, limit, overlap)
    if len(words) <= limit:
        assert made == []
        return
    at = 0
    for first, begin, end, a, b, _ in made:
        assert begin == at and end > begin and end - first <= limit and first == max(0, begin - overlap)
        assert text[a:b].split() == words[first:end]
        at = end
    assert at == len(words)


def test_pieces_cut_at_the_strongest_boundary():
    text = " ".join(["one two three four five six. Seven eight nine ten."] * 2) + "\n\n" + " ".join(["Alpha beta gamma delta."] * 3)
    assert [p[5] for p in splitting.pieces(text, 25, 3)] == ["paragraph", "end"]


def test_split_table(spark):
    rows = [("t", 1, " ".join(["w"] * 31)), ("t", 2, None), ("t", 3, ""), ("t", 4, " ".join(["w"] * 30)), ("t", 5, " ".join(["w"] * 15) + "\xa0" + " ".join(["w"] * 16))]
    df = spark.createDataFrame(rows, "record_kind string, record_id long, text string").selectExpr("*", "1 as piece_no")
    assert {r.record_id for r in splitting.split_oversized(df, 30, 5).collect()} == {1, 5}
    with pytest.raises(ValueError, match="overlap"):
        splitting.pieces("a b c d", 3, 3)


# 4: survivors ---------------------------------------------------------------------------------

CANDIDATE = "candidate_id long, case_id string, group_id string, canonical_name string, source_pdf string, source_page double, source_line double, context string, confidence double, extracted_at timestamp"


def test_survivors(spark):
    from datetime import datetime

    t = [datetime(2024, 1, k) for k in range(1, 6)]
    rows = [
        (1, "c", "g", "acme_works_ltd", "f.pdf", 1.0, 2.0, "text", 0.9, t[3]), (2, "c", "g", "acme_work_ltd", "nil", 0.0, -1.0, None, 80.0, t[1]), (3, "c", "g", "acme_works_ltd", "f.pdf", 1.0, float("nan"), " ", None, t[2]),
        (4, "c", "h", "x_y", "f", 1.0, 1.0, "t", 0.5, t[0]), (5, "c", "h", "x_y", "f", 1.0, 1.0, "t", 0.4, t[1]), (6, "c", "i", "(illegible)", "-", None, None, "N/A", float("nan"), None), (7, "c", "i", None, None, None, None, None, None, None), (8, "c", None, "no_group", "f", 1.0, 1.0, "t", 0.5, t[0]),
    ]
    groups = spark.createDataFrame([("c", "g"), ("c", "h"), ("c", "i"), ("c", "none")], "case_id string, group_id string")
    got = {r.group_id: r for r in survivors.survivors(spark.createDataFrame(rows, CANDIDATE), groups).collect()}
    assert (got["g"].candidate_id, got["g"].dominates, got["g"].canonical_name, got["g"].confidence) == (1, True, "acme_works_ltd", 0.9)
    assert got["h"].dominates is False and got["h"].confidence == 0.5
    assert (got["i"].candidate_id, got["i"].dominates, got["i"].canonical_name, got["i"].confidence) == (6, True, None, None)
    assert got["none"].candidate_id is None
    assert survivors.survivors(spark.createDataFrame([], CANDIDATE)).count() == 0


def test_consensus(spark):
    rows = [("k", f"alpha beta gamma v{i}", 1) for i in range(40)] + [("k", "alpha beta gamma", 30), ("k", "", 9), ("j", "one", 1), ("l", "a_b_c", 2), ("l", "a x b c", 3), ("l", "a x c", 3)]
    got = {r.k: (r.consensus, r.survivor) for r in survivors.consensus(spark.createDataFrame(rows, "k string, value string, w long"), ["k"]).collect()}
    assert got == {"k": ("alpha beta gamma", "alpha beta gamma"), "j": ("one", "one"), "l": ("a x b c", "a x b c")}


def test_consensus_does_not_depend_on_the_spread(spark):
    rng = random.Random(4)
    rows = []
    for g in range(30):
        words = [f"{rng.choice('abcdef')}{k}" for k in range(6)]
        for _ in range(300 if g == 0 else 12):
            value = [w if rng.random() < 0.8 else rng.choice("abcxyz") + w[1:] for w in words if rng.random() < 0.85]
            rows.append((g, " ".join(value), rng.randrange(1, 5)))
    got = []
    for parts in (1, 7):
        df = spark.createDataFrame(rows[::-1] if parts > 1 else rows, "g long, value string, w long").repartition(parts)
        got.append({(r.g, r.consensus, r.survivor) for r in survivors.consensus(df, ["g"]).collect()})
    alone = survivors.consensus(spark.createDataFrame([r for r in rows if r[0] == 3], "g long, value string, w long"), ["g"]).first()
    assert got[0] == got[1] and (3, alone.consensus, alone.survivor) in got[0]


@given(st.lists(st.sampled_from("abc"), max_size=6), st.lists(st.sampled_from("abcd"), max_size=6))
@settings(max_examples=200, deadline=None)
def test_columns(guide, tokens):
    made = survivors.columns(guide, tokens)
    assert len(made) == len(tokens) and made == sorted(set(made))
    assert all(-1 <= c < len(guide) for c, _ in made) and survivors.columns(guide, guide) == [(k, 0) for k in range(len(guide))]


def test_survivor_is_the_row_nearest_to_the_vote(spark):
    """Without a row that leads in all respects the one closest to the voted record survives."""
    from datetime import datetime

    t = [datetime(2024, 1, k) for k in range(1, 6)]
    rows = [
        (1, "c", "g", "odd name", "a.pdf", 9.0, 1.0, "x", 0.9, t[0]), (2, "c", "g", "acme works ltd", "f.pdf", 1.0, 2.0, "text", 0.9, t[1]),
        (3, "c", "g", "acme works ltd", "f.pdf", 1.0, 2.0, "text", 0.8, t[2]), (4, "c", "g", "acme wrks ltd", "f.pdf", 1.0, None, "text", 0.4, t[3]),
    ]
    got = survivors.survivors(spark.createDataFrame(rows, CANDIDATE)).first()
    assert (got.candidate_id, got.dominates, got.canonical_name, got.source_pdf, got.source_page, got.source_line) == (2, False, "acme works ltd", "f.pdf", 1, 2)


# 5: personal information ----------------------------------------------------------------------


def test_gradient_and_viterbi():
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in pii_model.fresh(6).items()}
    x, y = rng.integers(8, 100, (9, 3)).astype(np.uint8), rng.integers(0, pii_model.TAGS, (9, 3)).astype(np.uint8)
    _, g = pii_model.loss_and_gradient(x, y, p)
    for key in ("hf", "hb", "o", "ob", "t"):
        at = tuple(rng.integers(0, s) for s in p[key].shape)
        up, down = ({k: v.copy() for k, v in p.items()} for _ in range(2))
        up[key][at] += 1e-2
        down[key][at] -= 1e-2
        assert abs((pii_model.loss_and_gradient(x, y, up)[0] - pii_model.loss_and_gradient(x, y, down)[0]) / 2e-2 - g[key][at]) < 1e-4
    e, t = rng.normal(size=(4, 5, 6)).astype(np.float32), rng.normal(size=(6, 6)).astype(np.float32)
    tags = pii_model.viterbi(e, t)
    for b in range(5):
        best = max(itertools.product(range(6), repeat=4), key=lambda q, b=b: sum(e[i, b, q[i]] for i in range(4)) + sum(t[q[i], q[i + 1]] for i in range(3)))
        assert tuple(tags[:, b]) == best


def test_best_tags_are_those_of_all_paths():
    """With the transitions that are shipped, runs within, at either end and over the whole; what cannot gain is not decoded."""
    rng = np.random.default_rng(8)
    t, k, steps = pii.weights()["t"], pii_model.TAGS, 4
    paths = np.array(list(itertools.product(range(k), repeat=steps)))
    e = rng.normal(0, 5, (steps, 400, k)).astype(np.float32)
    e[:, :, 0] += rng.normal(0, 4, 400).astype(np.float32)
    tags = pii_model.viterbi(e, t)
    value = sum(e[i][:, paths[:, i]] for i in range(steps)) + sum(t[paths[:, i], paths[:, i + 1]] for i in range(steps - 1))
    got = sum(e[i, np.arange(400), tags[i]] for i in range(steps)) + sum(t[tags[i], tags[i + 1]] for i in range(steps - 1))
    assert np.allclose(got, value.max(axis=1), atol=1e-4)
    assert any(a > 0 and b == 0 for a, b in tags[[0, -1]].T) and any(a == 0 and b > 0 for a, b in tags[[0, -1]].T) and (tags == 0).all(axis=0).any() and (tags > 0).all(axis=0).any()
    e = np.zeros((30, 50, k), dtype=np.float32)
    e[:, :, 0] = 1.0
    e[10, :, 2] = 2.0  # beats the rest in one place, less than it costs to enter and leave
    e[5:20, 7, 3] = 9.0
    column, begin, end = pii_model.stretches(e, t)
    assert column.tolist() == [7] and begin[0] <= 5 and end[0] >= 20
    assert np.flatnonzero(pii_model.viterbi(e, t).any(axis=0)).tolist() == [7]


def test_reading_is_the_trained_network():
    p, n = pii_model.fresh(5), 5
    x = np.random.default_rng(9).integers(60, 100, (20, 7)).astype(np.uint8)  # no digits, which reading takes as alike
    forward, _ = pii_model._run(x, p["xf"], p["hf"], False)
    backward, _ = pii_model._run(x[::-1], p["xb"], p["hb"], False)
    ready = pii_model.ready(p)
    assert all(ready[key].shape[0] == 4 and ready[key].flags.c_contiguous for key in ("xf", "xb", "hf", "hb"))  # each gate apart
    assert np.allclose(pii_model.emissions(x, ready), forward @ p["o"][:n] + backward[::-1] @ p["o"][n:] + p["ob"], atol=1e-4)


def test_masked_texts_and_segments():
    text = "Été 2019, no. 12-34. The lease ended. 7 Capt. Orlov came. Prof. Brook left. He wrote .  No"
    assert pii.masked(text) == text.translate(pii.DIGITS)
    assert [text[a:b] for a, b in pii.segments(text)] == ["Été 2019, no. 12-34. The lease ended. 7 Capt. Orlov came.", "Prof. Brook left.", "He wrote .  No"]


CASES = [
    ("Please write to anna.brook77@quillmail.example and not to the old address.", {"email"}),
    ("She could be reached on +44 20 7946 0127 until 2014.", {"phone"}),
    ("The copy of passport number YF-9245871 is smudged.", {"identity_number"}),
    ("The deponent resides at Flat 12, Oakview Apartments, Milton Lane, Deeford - 079930.", {"street_address"}),
    ("The letter was typed by Mrs. Margaret T. Brikov from Feestead.", {"person_name"}),
    ("The seal bears the number 653-966-5198 and the year 2018.", set()),
    ("The record contains no trace of the counterfeit goods.", set()),
    ("Acton Auto Components Private Limited was joined as a party on its own request.", set()),
]


def test_held_out_examples(spark):
    rows = [("t", i, t) for i, (t, _) in enumerate(CASES)] + [("t", 90, None), ("t", 91, ""), ("t", 92, " ".join(t for t, _ in CASES) * 40)]
    df = spark.createDataFrame(rows, "record_kind string, record_id long, text string").selectExpr("*", "1 as start", "2 as value")
    got = {}
    for r in pii.personal_spans(df).collect():
        got.setdefault(r.record_id, set()).add(r.pii_type)
    assert sum(got.get(i, set()) == want for i, (_, want) in enumerate(CASES)) >= len(CASES) - 1
    assert 90 not in got and 91 not in got and got[92] == set(pii.TYPES)
    made = {r.record_id: r.text for r in pii.redacted(df).collect()}
    assert made[90] is None and made[91] == "" and made[0] == "Please write to [EMAIL] and not to the old address."


def test_windows_are_reconciled():
    p = pii.weights()
    long = "costs were left to be decided at the final hearing, " * 10 + "the letter was typed by Mrs. Margaret T. Brikov from Feestead, " + "no document has been produced to support the plea, " * 8
    tags = pii.tag_segments([long], p)[0]
    assert len(tags) == len(long) and any("Brikov" in long[a:b] for a, b, _ in pii.found(long, tags))


def found_spans(text, p):
    """Spans of a whole text by the operator's own steps."""
    out = []
    for a, b in pii.segments(text):
        s = text[a:b].translate(pii.DIGITS)
        out += [(a + x, a + y, k) for x, y, k in pii.found(s, pii.tag_segments([s], p)[0])]
    return out


def test_sentences_written_by_hand():
    """Recall of at least 0.9 for each type and 0.85 for names, counting a span as found where most of it has its type."""
    from docmill.llm import pii_labels
    from tests.llm import heldout

    known = {n.lower() for n in pii_labels.FORENAMES + pii_labels.SURNAMES}
    p, want, hit, exact, wrong = pii.weights(), Counter(), Counter(), Counter(), 0
    for text, spans in heldout.parsed():
        got = found_spans(text, p)
        for a, b, kind in spans:
            want[kind] += 1
            hit[kind] += any(k == kind and 2 * (min(b, y) - max(a, x)) > b - a for x, y, k in got)
            exact[kind] += (a, b, kind) in got
            assert kind != "person_name" or not all(w.lower().strip(".,") in known for w in text[a:b].split())
        wrong += any(all(min(b, y) <= max(a, x) or k != kind for a, b, kind in spans) for x, y, k in got)
    print({k: (want[k], hit[k], exact[k]) for k in want}, "sentences with something wrong:", wrong)
    assert len(heldout.MARKED) >= 200 and sum(want.values()) >= 190
    assert all(hit[k] >= (0.85 if k == "person_name" else 0.9) * want[k] for k in want), {k: (want[k], hit[k]) for k in want}
    assert wrong <= 0.1 * len(heldout.MARKED)


def test_spans_keep_their_ends():
    p = pii.weights()
    text = "Write to jane.doe@example.com. The keys are there."
    assert [text[a:b] for a, b, k in found_spans(text, p) if k == "email"] == ["jane.doe@example.com"]


# 6: packing -----------------------------------------------------------------------------------


def test_nnls_meets_its_conditions():
    rng = np.random.default_rng(1)
    a, b = rng.random((12, 30)), rng.random(12)
    x = packing.nnls(a, b)
    pull = a.T @ (b - a @ x)
    assert (x >= 0).all() and pull.max() < 1e-6 and np.abs(pull[x > 1e-9]).max() < 1e-6


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 60), max_size=20))
def test_histogram_is_packed_whole(counts):
    groups = packing.pack_histogram(counts, 64, 16, 3)
    used = Counter()
    for lengths, n in groups:
        assert n > 0 and sum(v * k for v, k in lengths) <= 64
        for v, k in lengths:
            used[v] += k * n
    assert dict(used) == counts
    total = sum(k * v for k, v in counts.items())
    assert sum(n for _, n in groups) <= 2 * -(-total // 64) + 1


def test_pack_table(spark):
    rows = [(i, "word " * (i % 9 + 1)) for i in range(200)] + [(900, None), (901, ""), (902, "word " * 100), (5, "word " * 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as container_id", "2 as rank")
    got = packing.pack(df, capacity=32, buckets=4).collect()
    load = Counter()
    for r in got:
        assert (r.container_id is None) == (r.n_tokens == 0) and r.token_end - r.token_start == r.n_tokens
        load[r.container_id] += r.n_tokens
    assert max(v for k, v in load.items() if k is not None) <= 32
    assert sum(r.doc_id == 902 for r in got) == 4 and sum(r.doc_id == 5 for r in got) == 2 and {900, 901} <= {r.doc_id for r in got}
    assert packing.pack(df.limit(0), capacity=32).count() == 0


# 7: leakage -----------------------------------------------------------------------------------


def item(seed, n=60):
    rng = random.Random(seed)
    return " ".join(f"{rng.choice('bcdfgk')}{rng.choice('aeiou')}{rng.randrange(900)}" for _ in range(n))


@pytest.mark.parametrize("threshold", [0.2, 0.75, 2.0])
def test_search_finds_what_brute_force_finds(threshold, monkeypatch):
    texts = [item(k) + " the of and" for k in range(40)] + [item(k, 700) for k in range(40, 44)]
    index = leakage.ItemIndex(list(range(44)), texts, [None] * 44, threshold)
    assert index.n > 60 and len(index.weight) <= 2 * sum(len(x) for x in index.items)
    words = [leakage.words_of(" ".join([texts[3][:160], texts[17][100:260], "other words"])), leakage.words_of(texts[8]), leakage.words_of(texts[41][900:3000])]
    docs = [np.array([index.vocabulary.get(w, -1) for w in ws]) for ws in words]
    passage, term, owner = leakage._passages(docs, index.n_terms)
    dense = np.zeros((index.n_terms, index.n))
    dense[index.key // index.n, index.unit] = index.weight
    want = {(i, j): v * index.least[j] for i in range(len(owner)) for j, v in enumerate(dense[np.unique(term[passage == i])].sum(0)) if v >= 1}
    for cells in (1 << 22, 150):
        monkeypatch.setattr(leakage, "CELLS", cells)
        p, k, s = index.search(passage, term, len(owner))
        assert {(a, b) for a, b in zip(p.tolist(), k.tolist(), strict=True)} == set(want) and all(abs(want[a, b] - c) < 1e-6 for a, b, c in zip(p, k, s, strict=True))


@pytest.mark.parametrize(("n", "every"), [(100, 0), (900, 0), (1100, 0), (3000, 0), (2700, 450), (2700, 390), (3000, 9)])
def test_long_items_are_found(n, every):
    """Items of any length, whole or with single words changed, and two fifths of them in two stretches."""
    words = item(n, n).split()
    items = [" ".join(words), *(item(k) for k in range(20))]
    index = leakage.ItemIndex(list(range(21)), items, [None] * 21)
    text = [("changed" if every and i % every == 7 else w) for i, w in enumerate(words)]
    fifth = int(n / 5 * (1.25 if every else 1)) + 1
    parts = text[:fifth] + item(77, 400).split() + text[-fifth:]

    class Shared:
        value = index

    for doc in (text, item(78, 999).split() + text, parts):
        rows = pd.concat(leakage._search(Shared, leakage.COVERAGE)(iter([pd.DataFrame({"doc_id": [1], "text": [" ".join(doc)]})])))
        assert rows.item_id.tolist() == [0] and rows.coverage[0] >= (0.4 if doc is parts else 0.85)


def test_leaks(spark):
    a, b, c = (item(k).split() for k in (1, 2, 3))
    changed = a[:30]
    changed[7], changed[19] = "other", "another"
    docs = [
        (1, "Intro. " + " ".join(changed).upper() + ". End."), (2, " ".join(b[:14]) + " " + item(9) * 4 + " " + " ".join(b[40:54])), (3, " ".join(c[:12])), (4, None), (5, ""), (6, " ".join(sorted(a))), (7, ",\n".join(c) + item(11, 3000)),
    ]
    items = [(10, "q", " ".join(a)), (20, None, " ".join(b)), (30, "q", " ".join(c)), (40, "q", None), (50, "q", ""), (60, "q", " ".join(c))]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as item_id", "2 as coverage")
    i = spark.createDataFrame(items, "item_id long, question string, text string").selectExpr("*", "3 as doc_id")
    for size in (1 << 20, 300):
        assert {(r.doc_id, r.item_id) for r in leakage.leaks(d, i, index_bytes=size).collect()} == {(1, 10), (2, 20), (7, 30), (7, 60)}
    assert leakage.leaks(d, i.limit(0)).count() == 0 and leakage.leaks(d.limit(0), i).count() == 0


# 8: subjects ----------------------------------------------------------------------------------


def test_sentences_and_words():
    assert subjects.sentences("Rule. Heard on 5 May. Rs. 40 paid to Mr. Orlov. It ended.") == ["Rule. Heard on 5 May.", "Rs. 40 paid to Mr. Orlov.", "It ended."]
    codes = subjects.Codes()
    known = [codes[w] >= 0 for w in subjects.words("The tenant met Clara Orlov at Norbury")]
    assert sum(known) == 3
    assert subjects.code_of("lease") == codes[b"lease"] and subjects.code_of("sale_deed") > 1 << 31


def test_subjects(spark):
    rng = random.Random(4)
    own = {"property": ["the tenant refused to vacate the flat", "the lease deed was never registered", "vacant possession was to follow"], "tax": ["the assessee claimed a deduction", "the levy was passed on to buyers", "the assessment was reopened late"]}
    common = ["the matter was adjourned to next week", "costs were left to the final hearing", "both sides filed short notes"]
    docs, want = [], {}
    for i in range(240):
        kind = ("property", "tax", "universal")[i % 3]
        picks = [rng.choice(common).capitalize() + "." for _ in range(3)] + [rng.choice(own[kind]).capitalize() + "." for _ in range(3 if kind in own else 0)]
        rng.shuffle(picks)
        docs.append((i, "en" if i % 5 else None, " ".join(picks)))
        want[i] = {kind}
    docs += [(900, "en", None), (901, "en", " "), (902, None, "12 34 !!")]
    areas = spark.createDataFrame([("property", "x"), ("tax", None), ("universal", "y"), (None, "z")], "subject_name string, description string")
    labels = spark.createDataFrame([(i, i, ("Property", "TAX", "universal")[i % 3]) for i in range(30)] + [(99, 0, None), (98, None, "tax")], "label_id long, doc_id long, subject_name string")
    d = spark.createDataFrame(docs, "doc_id long, lang string, text string").selectExpr("*", "1 as ids", "2 as w")
    got = {}
    for r in subjects.subjects(d, areas, labels).collect():
        got.setdefault(r.doc_id, set()).add(r.subject_name)
    assert not {900, 901, 902} & set(got)
    assert sum(got[i] == want[i] for i in want) >= 0.95 * len(want)
    assert subjects.subjects(d.limit(0), areas, labels).count() == 0
    parts = subjects.composition(d, areas, labels.limit(0)).groupBy("doc_id").agg({"sentences": "sum", "n_sentences": "max"}).collect()
    assert all(r["sum(sentences)"] == r["max(n_sentences)"] for r in parts)


def test_subjects_of_a_large_share(spark):
    """Words that two fifths of the documents have still tell of the subject that alone has them."""
    rng = random.Random(5)
    own = {"property": "zorbel quandle mirrish", "tax": "vastrel humbick dolfane"}
    common = [f"both sides of case {''.join(rng.choices('abcdefghij', k=6))} filed {''.join(rng.choices('klmnopqrst', k=6))} notes" for _ in range(25)]
    docs, want = [], {}
    for i in range(800):
        kind = ("property", "property", "tax", "universal", "universal")[i % 5]
        picks = [rng.choice(common).capitalize() + "." for _ in range(3)] + [f"There was {own[kind]} at the time." for _ in range(3 if kind in own else 0)]
        docs.append((i, "en", " ".join(picks)))
        want[i] = kind
    areas = spark.createDataFrame([("property", "x"), ("tax", "y")], "subject_name string, description string")
    labels = spark.createDataFrame([(i, i, want[i]) for i in range(200)], "label_id long, doc_id long, subject_name string")
    got = {r.doc_id: r.subject_name for r in subjects.subjects(spark.createDataFrame(docs, "doc_id long, lang string, text string"), areas, labels).collect()}
    assert sum(got[i] == want[i] for i in want) >= 0.95 * len(want)


def test_document_factor_is_that_of_plain_updates():
    rng = np.random.default_rng(6)
    sizes = np.array([3, 0, 17, 1, 400, 5, 0, 30])
    terms, counts = rng.integers(0, 50, sizes.sum()).astype(np.uint16), rng.integers(1, 5, sizes.sum()).astype(np.float32)
    h = rng.random((4, 50)).astype(np.float32)
    w, before, ratio = subjects.document_factor(h, terms, counts, sizes, 3)
    at = 0
    for d, n in enumerate(sizes):
        own, c, now = h[:, terms[at : at + n]], counts[at : at + n], np.full(4, 0.25)
        for _ in range(3):
            last, p = now, now[:, None] * own
            p = p / p.sum(axis=0) * c
            now = (0.02 + p.sum(axis=1)) / (0.02 + p.sum(axis=1)).sum()
        assert np.allclose(w[d], now, rtol=1e-4)
        assert np.allclose(own * before[d][:, None] * ratio[at : at + n], last[:, None] * own / (last[:, None] * own).sum(axis=0) * c, rtol=1e-4)
        at += n


def test_documents_travel_as_bytes():
    texts = ["The lease was signed. It ended\x01early. Été ’twas No. 4 (Tenant).", "", "12 34", "Rs. 40 paid to shri. Orlov by Bank Ltd. at noon! - then\n\nÉcole fermée"]
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3, 4]), pa.array(["en", None, "en", "fr"]), pa.array(texts)], names=["doc_id", "lang", "text"])
    (made,) = subjects._rows([batch])
    codes, n_codes = subjects._lists(made, "codes")
    sizes, n_sizes = subjects._lists(made, "sizes")
    assert made.column("doc_id").to_pylist() == [1, 4] and all(pa.types.is_binary(made.column(c).type) for c in ("codes", "sizes"))
    number = subjects.Codes()
    want = [[[c for w in subjects.words(s) if (c := number[w]) >= 0] for s in subjects.sentences(t)] for t in (texts[0], texts[3])]
    assert codes.tolist() == [c for d in want for s in d for c in s] and n_codes.tolist() == [sum(map(len, d)) for d in want]
    assert sizes.tolist() == [len(s) for d in want for s in d if s] and n_sizes.tolist() == [sum(map(bool, d)) for d in want]
    assert subjects._lists(made.slice(1), "codes")[0].tolist() == [c for s in want[1] for c in s]
    vocabulary = np.unique(np.concatenate((codes, np.arange(1, 1 << 12) << 20)).astype(np.int64))  # many share a slot
    at, hit = subjects.places(vocabulary)(np.append(vocabulary, vocabulary + 1))
    assert hit.tolist() == [True] * len(vocabulary) + np.isin(vocabulary + 1, vocabulary).tolist() and at[: len(vocabulary)].tolist() == list(range(len(vocabulary)))


def test_labels_go_to_the_matrix_and_not_the_matrix_to_them(spark, monkeypatch):
    plans, gather = [], subjects._gather
    monkeypatch.setattr(subjects, "_gather", lambda rows, *a, **k: plans.append(rows._jdf.queryExecution().executedPlan().toString()) or gather(rows, *a, **k))
    docs = spark.createDataFrame([(i, "en", f"The tenant left the flat. The lease {'ended' if i % 2 else 'began'} early.") for i in range(60)], "doc_id long, lang string, text string")
    areas = spark.createDataFrame([("property", "x"), ("tax", "y")], "subject_name string, description string")
    labels = spark.createDataFrame([(i, i, "property") for i in range(20)], "label_id long, doc_id long, subject_name string")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert {r.subject_name for r in subjects.subjects(docs, areas, labels).collect()} == {"property"}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert any("BroadcastHashJoin" in p for p in plans) and not any("SortMergeJoin" in p for p in plans)


def test_nothing_outside_imports_this_subpackage():
    from pathlib import Path

    root = Path(__file__).resolve().parents[2] / "docmill"
    assert not [p for p in root.rglob("*.py") if "llm" not in p.parts and "docmill.llm" in p.read_text()]
