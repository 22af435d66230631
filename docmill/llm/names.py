"""Names as people type them: taken apart, folded, and compared part by part.

Pure functions on single names and pairs of names; problem 2 runs them inside its joins.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache
from typing import NamedTuple

#: Titles and additions that are no part of a name.
TITLES = set("mr mrs ms miss dr shri sri smt kum adv advocate prof hon honble capt col maj lt gen justice sir madam esq ji m/s messrs the late rev".split())
#: Short forms of given names.
NICKNAMES = {
    "abby": "abigail", "alex": "alexander", "sandy": "alexander", "sasha": "alexander", "tony": "anthony", "ben": "benjamin", "benny": "benjamin", "lottie": "charlotte", "charlie": "charles",
    "chris": "christopher", "kit": "christopher", "deepa": "deepika", "dot": "dorothy", "dolly": "dorothy", "ed": "edward", "eddie": "edward", "ned": "edward", "ted": "theodore", "teddy": "theodore", "liz": "elizabeth",
    "beth": "elizabeth", "betty": "elizabeth", "lizzie": "elizabeth", "essie": "esther", "paco": "francisco", "frank": "francis", "fred": "frederick", "freddie": "frederick", "guri": "gurpreet", "hari": "harindra",
    "nell": "helena", "lena": "helena", "inga": "ingrid", "jon": "jonathan", "josie": "josephine", "jo": "josephine", "kate": "katherine", "kathy": "katherine", "katie": "katherine",
    "kittu": "krishnan", "kris": "krishnan", "laxmi": "lakshmi", "leo": "leopold", "lyddie": "lydia", "maggie": "margaret", "peggy": "margaret", "meg": "margaret", "mike": "michael", "mick": "michael",
    "mohd": "mohammed", "mohammad": "mohammed", "md": "mohammed", "nat": "nathaniel", "nate": "nathaniel", "nick": "nicholas", "om": "omprakash", "ozzie": "oscar", "padma": "padmavati", "pat": "patricia", "trish": "patricia",
    "patty": "patricia", "pattie": "patricia", "tricia": "patricia", "quin": "quentin", "raj": "rajendra", "raju": "rajendra", "dick": "richard", "rick": "richard", "rich": "richard", "bob": "robert", "rob": "robert", "bobby": "robert",
    "sam": "samuel", "sammy": "samuel", "sanju": "sanjeev", "suren": "surendra", "theo": "theodore", "venky": "venkatesh", "venkat": "venkatesh", "vicky": "vikram", "vik": "vikram", "wilf": "wilfred",
    "bill": "william", "will": "william", "billy": "william", "willy": "william", "liam": "william", "jim": "james", "jimmy": "james", "jack": "john", "johnny": "john", "tom": "thomas", "dan": "daniel", "dave": "david",
    "steve": "stephen", "joe": "joseph", "greg": "gregory", "jerry": "gerald", "sue": "susan", "maria": "mary", "molly": "mary", "annie": "anne", "nancy": "anne", "becky": "rebecca", "vicki": "victoria",
}
#: Short forms that stand for a second name too.
ALSO = {"ted": "edward", "alex": "alexandra", "sam": "samantha", "chris": "christine", "kit": "katherine", "pat": "patrick", "nick": "nikhil", "dot": "dorothea", "frank": "francisco", "inga": "inge", "leo": "leonard", "jon": "john"}
#: Given names in wide use; they tell the given name from the surname where no comma does.
GIVEN = set(NICKNAMES) | set(NICKNAMES.values()) | set("asha arvind bruno clara damian farida geeta hugo irfan kavita meera nikhil prakash rohan sunil tanvi ursula yusuf zainab anil amit ajay anita deepak ganesh gopal kiran lata manoj mohan neha nisha pooja priya rahul ramesh ravi rekha sanjay sarita suresh uma vijay vinod adam alan albert alice amy andrew anna arthur barbara carl carol cecil diana emily emma eric eva felix george grace henry jane julia karl laura linda lucy mark martin max nora olga paul peter rita rosa ruth sara simon sofia victor walter".split())
#: Words for lines of business and their short forms.
BUSINESS = set("realtors foods works cold storage auto components leasing paper industries agro products engineering chemicals printing services mills textile housing developers steel tubes garments export power systems trading corporation warehousing infrastructure projects shipping agencies pharma laboratories finance motors logistics exports imports enterprises construction constructions builders traders technologies solutions energy media hotels holdings investments plastics electricals packaging ceramics cement jewellers furniture pharmaceuticals transport properties estates fertilizers beverages dairy marine consultants associates company group international university institute hospital foundation college".split())
SHORT = {
    "comps": "components", "comp": "components", "shpg": "shipping", "agcs": "agencies", "agcy": "agencies", "hsg": "housing", "dev": "developers", "devs": "developers", "sys": "systems", "ph": "pharma", "labs": "laboratories", "lab": "laboratories",
    "tex": "textile", "txt": "textile", "proj": "projects", "projs": "projects", "infra": "infrastructure", "engg": "engineering", "eng": "engineering", "trdg": "trading", "trd": "trading", "corpn": "corporation", "corp": "corporation", "prods": "products", "prod": "products",
    "svcs": "services", "svc": "services", "fin": "finance", "inds": "industries", "ind": "industries", "chem": "chemicals", "chems": "chemicals", "whsg": "warehousing", "whse": "warehousing", "exp": "export", "prtg": "printing", "ptg": "printing", "gmts": "garments", "mfg": "manufacturing", "co": "company", "constr": "constructions", "intl": "international", "ent": "enterprises", "tech": "technologies",
}
#: Words that show a court, an office, a bank or a paper, which are no persons or firms here.
OTHER = set("court tribunal bench commission registrar authority department municipal council commissionerate directorate ministry board trust government collector police bank dated reference diary appeal petition rs inr eur usd rupees lakh crore".split())

FORMS = [
    ("society", re.compile(r"\b(?:co[- ]?op(?:erative)?\.? ?(?:society|soc)\.?|c\.?h\.?s\.?)(?: (?:limited|ltd)\b\.?)?")),
    ("llp", re.compile(r"\bl\.? ?l\.? ?p\b\.?")),
    ("private", re.compile(r"(?:\bprivate|\bpvt\b\.?|\(p\)|\bp\b\.?) ?(?:limited|ltd\b\.?)?$|\b(?:private|pvt)\b\.?(?: (?:limited|ltd)\b\.?)?")),
    ("limited", re.compile(r"\b(?:limited|ltd)\b\.?")),
    ("inc", re.compile(r"\b(?:inc|incorporated)\b\.?$")),
    ("llc", re.compile(r"\bl\.? ?l\.? ?c\b\.?$")),
    ("plc", re.compile(r"\bplc\b\.?$")),
    ("gmbh", re.compile(r"\bgmbh\b\.?$")),
    ("sons", re.compile(r"(?:&|\band\b) ?son'?s?\b")),
    ("brothers", re.compile(r"\b(?:brothers|bros)\b\.?")),
]


#: A word of a name in any script.
LETTERS = re.compile(r"[^\W\d_]+(?:'[^\W\d_]*)*")


class Name(NamedTuple):
    kind: str  # person, firm, acronym or "" for anything else
    surnames: tuple[str, ...]  # possible surnames, or the firm's own name
    rest: tuple[tuple[str, ...], ...]  # for each surname the other tokens in order; for firms the business words
    form: str


def plain(text: str) -> str:
    out = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).lower()
    return re.sub(r"\s+", " ", out.replace("’", "'")).strip()


def fold(token: str) -> str:
    """Spelling without what typists vary most: doubled letters, w for v, y for i."""
    t = token.replace("w", "v").replace("y", "i").replace("ee", "i").replace("ou", "o").replace("ph", "f")
    return re.sub(r"(.)\1+", r"\1", t)


@lru_cache(maxsize=200_000)
def distance(a: str, b: str, most: int) -> int:
    """Edits with swaps of neighbours, in a band of the given width; most + 1 where there are more."""
    if a == b:
        return 0
    n, m = len(a), len(b)
    if abs(n - m) > most:
        return most + 1
    before: list[int] = []
    row = [j if j <= most else most + 1 for j in range(m + 1)]
    for i in range(1, n + 1):
        last, row = row, [most + 1] * (m + 1)
        if i <= most:
            row[0] = i
        for j in range(max(1, i - most), min(m, i + most) + 1):
            best = last[j - 1] + (a[i - 1] != b[j - 1])
            best = min(best, last[j] + 1, row[j - 1] + 1)
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                best = min(best, before[j - 2] + 1)
            row[j] = min(best, most + 1)
        if min(row) > most:
            return most + 1
        before = last
    return row[m]


def marks(word: str) -> int:
    """The characters of a word as bits; an edit changes at most two of them."""
    out = 0
    for c in word:
        out |= 1 << (ord(c) % 61)
    return out


def closest(word: str, known: list[tuple[str, int]], most: int) -> str:
    """The nearest of the known words within the given edits, or "" if there is none."""
    own, n = marks(word), len(word)
    close = [(distance(word, w, most), w) for w, m in known if abs(len(w) - n) <= most and (m ^ own).bit_count() <= 2 * most]
    best = min(close, default=(most + 1, ""))
    return best[1] if best[0] <= most else ""


BUSINESS_MARKS = [(w, marks(w)) for w in sorted(BUSINESS)]
GIVEN_MARKS = [(w, marks(w)) for w in sorted(GIVEN) if len(w) >= 4]


def slack(n: int) -> int:
    """Edits allowed between two words, by the length of the shorter."""
    return 0 if n <= 3 else 1 if n <= 5 else 2


def near(a: str, b: str) -> bool:
    k = slack(min(len(a), len(b)))
    return a == b or distance(a, b, k) <= k or distance(fold(a), fold(b), 1) <= min(1, k)


@lru_cache(maxsize=50_000)
def business(token: str) -> tuple[str, ...]:
    """The business words that a token stands for, glued ones taken apart."""
    t = token.strip(".")
    if t in BUSINESS:
        return (t,)
    if t in SHORT:
        return (SHORT[t],)
    if len(t) > 7:
        for head in BUSINESS:
            if t.startswith(head) and len(head) > 3:
                tail = t[len(head) :]
                tail = tail[3:] if tail.startswith("and") and len(tail) > 5 else tail
                more = business(tail) if len(tail) > 1 else ()
                if more:
                    return (head, *more)
    if len(t) >= 4:
        k = 1 if len(t) < 7 else 2
        if close := closest(t, BUSINESS_MARKS, k):
            return (close,)
    return ()


@lru_cache(maxsize=50_000)
def given(token: str) -> str:
    """The full given name that a token stands for, or "" if it is none that is known."""
    if token in NICKNAMES:
        return NICKNAMES[token]
    if token in GIVEN:
        return token
    if len(token) >= 5:
        k = 1 if len(token) < 7 else 2
        if close := closest(token, GIVEN_MARKS, k):
            return NICKNAMES.get(close, close)
    return ""


def parse(text: str | None) -> Name:
    nothing = Name("", (), (), "")
    if not text:
        return nothing
    low = plain(text)
    if re.search(r"\d", low) and not any(p.search(low) for f, p in FORMS if f != "sons"):  # dates, amounts, places; a firm's name may hold a number
        return nothing
    bare = re.sub(r"[^a-z]", "", low)
    raw = text.strip()
    if 2 < len(bare) <= 8 and (" " not in raw or re.fullmatch(r"(?:\w\. ?)+\w?\.?", raw)) and (raw.isupper() or re.fullmatch(r"(?:\w\.)+", low)):
        return Name("acronym", (bare,), ((),), "")
    low = re.sub(r"\(advocate\)|\bm/s\.?", " ", low)
    words = LETTERS.findall(low)
    if not words or any(w in OTHER for w in words):
        return nothing
    form, rest = "", re.sub(r"\s+", " ", low).strip(" ,")
    firm = "m/s" in plain(text)
    rest = re.sub(r"\bco ?[- ]op\b\.?|\bcooperative\b", "coop", rest)
    for name, pattern in FORMS:
        cut = pattern.sub(" ", rest).strip(" ,")
        if cut != rest and (not form or name in ("sons", "brothers", "limited")):
            form = form or name
            rest, firm = re.sub(r"\s+", " ", cut), True
    tokens = re.findall(r"[^\W_]+(?:'[^\W_]*)*", rest.replace("-", ""))
    kinds = [business(t) for t in tokens]
    if firm or any(kinds) and sum(map(bool, kinds)) and any(len(t) > 3 for t, k in zip(tokens, kinds, strict=True) if k) and not any(given(t) for t in tokens if not business(t)):
        own = [t for t, k in zip(tokens, kinds, strict=True) if not k and t not in TITLES and t not in ("and", "coop", "m", "s", "of")]
        line = tuple(w for k in kinds for w in k)
        if not own and len(tokens) > 1 and kinds[0] and tokens[0] not in BUSINESS and tokens[0] not in SHORT:  # a name that only looks like such a word
            own, line = [tokens[0]], tuple(w for k in kinds[1:] for w in k)
        elif not own and form and tokens and tokens[0] not in BUSINESS:
            own, line = [tokens[0]], ()
        if not own or not any(len(t) > 1 for t in own):
            return nothing
        return Name("firm", ("".join(own),), (line,), form)
    head, comma, tail = rest.partition(",")
    split = lambda s: [u for t in LETTERS.findall(s) if t not in TITLES for u in (t if len(t) == 2 and t not in GIVEN else [t])]
    if comma and split(tail) and split(head):
        a, b = split(head), split(tail)
        return Name("person", ("".join(a),), (tuple(b),), "")
    tokens = split(rest)
    if len(tokens) < 2:
        return nothing
    long = [t for t in tokens if len(t) >= 3]
    family = [t for t in long if not given(t)] or long
    ends = [t for t in family if t in (tokens[0], tokens[-1])] or family
    if len(ends) > 1:
        ends = [tokens[-1] if tokens[-1] in ends else ends[-1]] + ([tokens[0]] if tokens[0] in ends and len(tokens) == 2 else [])
    if not ends:
        return nothing
    rests = []
    for s in ends:
        k = len(tokens) - 1 - tokens[::-1].index(s)
        rests.append(tuple(tokens[:k] + tokens[k + 1 :]))
    return Name("person", tuple(ends), tuple(rests), "")


def same_given(a: str, b: str) -> bool:
    if len(a) == 1 or len(b) == 1:
        if a[0] == b[0]:
            return True
        long = a if len(a) > 1 else b
        short = b if len(a) > 1 else a
        return len(long) > 1 and given(long)[:1] == short
    x, y = given(a), given(b)
    if x and y:
        return x == y or ALSO.get(a) in (y, b) or ALSO.get(b) in (x, a)
    if near(a, b):
        return True
    x, y = x or a, y or b
    return x == y or near(x, y) or len(min(a, b, key=len)) >= 3 and (a.startswith(b) or b.startswith(a))


def letters(token: str) -> tuple[str, ...]:
    """The initials that a given name may be written with."""
    return tuple(sorted({token[0], (given(token) or token)[0]}))


def forms(token: str) -> list[str]:
    """The spellings by which a given name is looked up: its own, the full name it stands for, and both folded."""
    full = given(token) or token
    return sorted({token, full, fold(token), fold(full), ALSO.get(token, token)})


def keys(name: Name) -> list[tuple[str, str, str, bool]]:
    """(bucket, string, part, short) under which a name is looked up.

    The part of a person is the given name of that reading, or its initial (short); the part of a
    firm is each word of its line of business, of which the first is marked short, or nothing.
    """
    if name.kind == "firm":
        return [("f", fold(name.surnames[0]), w, k == 0) for k, w in enumerate(dict.fromkeys(name.rest[0] or ("",)))]
    if name.kind == "person":
        return sorted({("p", fold(s), r[0], len(r[0]) == 1) for s, r in zip(name.surnames, name.rest, strict=True) if r})
    return []


def acronyms(name: Name) -> list[str]:
    """What a firm's initials may look like."""
    if name.kind != "firm" or not name.rest[0]:
        return []
    head = name.surnames[0][0] + "".join(w[0] for w in name.rest[0])
    tails = {"private": ["pl"], "limited": ["l"], "llp": ["llp", "l"], "sons": ["s", "as"], "brothers": ["b"], "society": ["csl", "chsl", "cs", "chs"], "": ["pl", "l", "llp"]}
    return [head, *(head + t for t in tails[name.form])]


def compatible(a: Name, b: Name) -> bool:
    """Whether two names can be the same person's or firm's."""
    if a.kind != b.kind or not a.kind:
        return False
    if a.kind == "acronym":
        return a.surnames == b.surnames
    if a.kind == "firm":
        if a.form and b.form and a.form != b.form:
            return False
        if not near(a.surnames[0], b.surnames[0]):
            return False
        x, y = sorted((a.rest[0], b.rest[0]), key=len)
        it = iter(y)
        return all(any(w == v for v in it) for w in x) and (bool(x) or not y)
    for s, r in zip(a.surnames, a.rest, strict=True):
        for t, q in zip(b.surnames, b.rest, strict=True):
            if r and q and near(s, t) and same_given(r[0], q[0]) and (len(r) == 1 or len(q) == 1 or all(same_given(u, v) for u, v in zip(r[1:], q[1:], strict=False))):
                return True
    return False


def rank(name: Name) -> int:
    """How much a name tells: 2 enough to stand alone, 1 without a middle name or business line, 0 initials only."""
    if name.kind == "person":
        r = name.rest[0]
        return 0 if not r or len(r[0]) == 1 else 2 if len(r) > 1 else 1
    if name.kind == "firm":
        return 2 if name.form and name.rest[0] else 1
    return 0
