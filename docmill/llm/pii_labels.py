"""Labelled spans for training the tagger of problem 5.

Two sources, in equal parts.  Spans of a bounded sample of texts, in which the names are known
from their mentions and the rest from cues around them; names are then replaced by others of many
origins and digits by others, so that the tagger learns forms and contexts and not the sample's
own values.  And sentences made by a small grammar, whose spans are known because they were put
there: names, addresses and numbers in general prose, and look-alikes that are none of these.

    python -m docmill.llm.pii_labels TABLES... --seconds 300 --out docmill/llm/pii_weights.npz
"""

from __future__ import annotations

import argparse
import random
import re
from collections import defaultdict

import numpy as np

from docmill.llm import names, pii_model
from docmill.llm.pii import DATE, segments

#: At most so many segments are learned from.
SAMPLE = 260_000

EMAIL = re.compile(r"[\w.+-]+\s?@\s?[\w-]+(?:\.[\w-]+)+|[\w.+-]+\s*[\[(]at[\])]\s*[\w-]+(?:\s*(?:[\[(]dot[\])]|\.)\s*[\w-]+)+|[\w.+-]+ at [\w.-]+(?: dot [\w-]+)+")
PHONE = re.compile(r"(?<![\w/-])(?:1[-.\s])?(?:\(\+?\d{1,4}\)[\s-]?|\+\d{1,3}[\s-]?)?\d{2,5}(?:[\s.-]?\d{2,6}){1,4}(?:\s?(?:ext|x)\.?\s?\d{1,4})?(?![\w/-])")
PHONE_CUE = re.compile(r"(?:phone|mobile|\btel\b|telephone|fax|contact|\bcall(?:ed|er|s)?|messages? (?:went to|from)|reached (?:on|at)|\bring|dial|sms|\bph\b|cell|whatsapp|\bext\b|/)\W*(?:(?:number|no|from|to|on|at|is|was)\W*)*$", re.IGNORECASE)
NOT_PHONE = re.compile(r"(?:seal|meter|token|receipt|folio|diary|account|passport|licen[cs]e|uid|identity|security|voter|\bpan\b|card|serial|survey|invoice|reference|register|column)\b[^.]{0,40}$", re.IGNORECASE)
IDENTITY = re.compile(r"(?:passport|\bPAN\b|permanent\s+account|\bUID\b|national\s+identity|voter|driving\s+licen[cs]e|social\s+security|identity\s+card|taxpayer|aadhaar|\bSSN\b|ration\s+card)(?:\s+(?:number|no\b\.?|card|id))*[\s:.#]*((?:[A-Z]{1,6}[-\s]?)?\d[\d\s-]{3,18}\d[A-Z]?|[A-Z]{3,5}\d{4}[A-Z]|[A-Z]{2}\d{2}[\s/-]?\d{5,8})(?![\w])", re.IGNORECASE)
ADDRESS = re.compile(
    r"(?:(?:Flat|House|Door|Shop|Room|Unit|Apartment|Apt\.?|Block|H\.)\s+(?:No\.?\s*)?\d[\w/-]*|\d+(?:st|nd|rd|th)\s+floor|(?<![\w./-])\d{1,4}[A-Z]?(?:[/-]\d{0,3}[A-Z]?)*(?![\w.]))[,\s]\s*"
    r"(?:[\w'’./-]+[,\s]\s*){0,9}?(?:Street|St\.?|Road|Rd\.?|Lane|Ln\.?|Marg|Avenue|Ave\.?|Cross|Square|Path|Row|Apartments|Colony|Enclave)(?![\w])"
    r"(?:[,\s]\s*[\w'’.-]+\s+(?:Street|St\.?|Road|Rd\.?|Lane|Ln\.?|Marg|Avenue|Ave\.?|Cross|Square|Path|Row)(?![\w]))?"
    r"(?:,\s*(?:near|opposite|behind|above|beside)\s+the\s+[\w ]{3,30}?(?=,))?(?:[,\s]\s*[A-Z][\w'’]+)?(?:\s*[-–]?\s*\d{3}\s?\d{2,3}(?!\d))?"
)
TITLE = r"(?:(?:Mr|Mrs|Ms|Dr|Smt|Shri|Sri|Adv|Prof|Capt|Hon|Kum)\b\.?\s+)"
WORDS = re.compile(r"[^\W\d_](?:[\w'’]*[^\W\d_])?\.?|[,&()]|\S")


def gazetteer(mentions) -> dict:
    """For each case: surnames, given names and the texts that name no person."""
    out = defaultdict(lambda: (set(), set(), set()))
    for case, text, kind in mentions:
        if not text or not case:
            continue
        surnames, given, others = out[case]
        parsed = names.parse(text)
        if kind == "Person" and parsed.kind == "person":
            surnames.update(s for s in parsed.surnames if not names.given(s))
            given.update(t for r in parsed.rest for t in r if len(t) > 2)
        elif kind not in ("Person", "Entity", None) and not re.search(r"\d", text):
            others.add(text.strip())
    return out


def spans(text: str, known: tuple[set, set, set]) -> list[tuple[int, int, int]]:
    """(start, end, tag) without overlap."""
    taken = np.zeros(len(text), dtype=bool)
    out: list[tuple[int, int, int]] = []

    def add(a: int, b: int, tag: int) -> None:
        if b > a and not taken[a:b].any():
            taken[a:b] = True
            if tag:
                out.append((a, b, tag))

    for m in EMAIL.finditer(text):
        add(*m.span(), 1)
    for m in IDENTITY.finditer(text):
        add(*m.span(1), 3)
    for m in ADDRESS.finditer(text):
        a = m.start()
        if re.search(r"[A-Z]", m.group()) and not re.search(r"(?:Rs\.?|INR|EUR|₹|No\.|of)\s*$", text[max(0, a - 5) : a]) or re.search(r"\bof\s*$", text[max(0, a - 5) : a]):
            add(*m.span(), 4)
    for m in PHONE.finditer(text):
        before = text[max(0, m.start() - 60) : m.start()]
        digits = sum(c.isdigit() for c in m.group())
        if 7 <= digits <= 15 and not DATE.fullmatch(m.group()) and not NOT_PHONE.search(before) and (m.group()[0] in "+(" or PHONE_CUE.search(before)):
            add(*m.span(), 2)
    surnames, given, others = known
    for o in others:
        at = text.find(o)
        while at >= 0:
            add(at, at + len(o), 0)
            at = text.find(o, at + 1)
    tokens = [(m.start(), m.end(), m.group()) for m in WORDS.finditer(text)]
    low = [names.plain(t.strip(".")) for _, _, t in tokens]
    role = []
    for (a, _, t), w in zip(tokens, low, strict=True):
        if taken[a]:
            role.append("x")
        elif w in surnames:
            role.append("s")
        elif w in given or w in names.GIVEN:
            role.append("g" if t[0].isupper() or w in given else "x")
        elif re.fullmatch(r"[A-Z]\.?", t):
            role.append("i")
        elif t == ",":
            role.append("c")
        elif w in names.TITLES and (t[0].isupper() or w == "m"):
            role.append("t")
        else:
            role.append("x")
    for m in re.finditer(r"(?:t*)(?:s(?:c(?:g|i)+|(?:g|i)+)?|(?:g|i)+s+|g(?:g|i)*g|tg)", "".join(role)):
        a, b = m.span()
        nxt = low[b] if b < len(low) else ""
        after = tokens[b][2] if b < len(tokens) else ""
        if after == "&" or names.business(nxt) and after[:1].isupper() or nxt in ("and",) and b + 1 < len(low) and low[b + 1] in ("sons", "son"):
            continue
        if tokens[a][0] > 0 and text[tokens[a][0] - 1] in "@._-":
            continue
        add(tokens[a][0], tokens[b - 1][1], 5)
    return sorted(out)


#: Given names and surnames of many origins, to be put into sentences.
FORENAMES = (
    "Amara Kofi Zanele Thabo Nia Sekou Ayodele Ngozi Tendai Abena Yusuf Layla Omar Samira Khalid Noor Hassan Amina Reza Shirin Darius Leila Emre Elif Mehmet Ayse Ivan Olga Sergei Katya Pavel Milena Jan Agnieszka Marek Ewa Istvan Zsofia Andrei Ioana Nikos Eleni Luca Chiara Marco Giulia "
    "Pedro Ines Joao Beatriz Carlos Lucia Diego Sofia Javier Elena Pablo Rosa Jean Camille Luc Margot Pierre Claire Hans Greta Karl Heidi Jurgen Ute Lars Astrid Erik Freya Anders Sigrid Mikko Aino Sean Niamh Callum Fiona Owen Rhys Megan George Alice Henry Clara Samuel Ruth Daniel Laura "
    "Walter Edith Frank Helen Arthur Grace Chen Mei Liang Xiao Jun Hua Ming Ying Haruto Sakura Kenji Aiko Naoki Emi Jiho Soyeon Minseo Hyun Linh Minh Anh Tuan Somchai Malee Putri Budi Siti Arjun Kavya Rohan Meera Vikram Anjali Suresh Divya Ravi Lakshmi Imran Farah Bilal Sana Nimal Dilani"
).split()
SURNAMES = (
    "Mensah Dlamini Okafor Traore Keita Banda Moyo Owusu Achebe Kamau Haddad Nasser Khoury Aziz Rahman Karimi Hosseini Demir Kaya Ozturk Ivanov Sokolov Novak Kovac Horvat Wisniewski Lewandowski Nagy Toth Ionescu Papadakis Rossi Ferrari Romano Conti Silva Santos Pereira Almeida Fernandez Lopez Torres Ramirez Vargas "
    "Mendoza Dubois Moreau Laurent Fontaine Mercier Schmidt Weber Fischer Hoffmann Krause Vogel Jansen Visser Bakker Hansen Olsen Nilsson Berg Dahl Virtanen Murphy Byrne Doyle Stewart Fraser Campbell Evans Pritchard Lloyd Taylor Harper Mason Fletcher Bennett Shepherd Whitaker Carver Ellison Prescott Radcliffe Kensington Lockhart "
    "Wang Liu Yang Zhao Wu Zhou Tanaka Suzuki Yamamoto Nakamura Mori Kim Park Choi Jung Tran Pham Hoang Le Suharto Wijaya Santoso Reddy Nair Menon Banerjee Mukherjee Kapoor Malhotra Bhatt Joshi Pillai Gowda Sheikh Qureshi Siddiqui Perera Fernando Silveira Quispe Mamani Flores Rojas Kealoha"
).split()
ROLES = "clerk manager engineer teacher nurse doctor lawyer tenant owner driver guard baker painter surveyor witness neighbour author editor director chairman secretary treasurer captain farmer mechanic plumber architect broker agent buyer seller heir widow partner judge officer inspector".split()
DEEDS = "signed opened found kept sold bought returned lost described measured repaired inherited rented painted moved read carried checked closed borrowed approved refused translated counted copied delivered arranged requested designed inspected stored photographed".split()
DEEDS += "asked for,spoke about,wrote about,shared,owns,keeps,has rented,never saw,could not open,could not find,came back for,was paid for,was heard on,closes,leads,teaches,will sign,had ordered,is looking for,forgot,gave up,lent,drew,mended,hired,presented".split(",")
#: Beginnings and ends of surnames in several languages, to be put together.
ROOTS = "Hart Black Stone Ash Wind Fair Hol Stein Rosen Gold Sand Lund Nord Wester Kirch Alt Neu Monte Castel Villa Bella Campo Gonz Hern Petr Nikol Alex Step Krish Rama Venkat Subra Chandra Raj Vijay Moham Rah Kar Has Gar Mar Bar Ver Del Fer Gal Hum Jar Kel Lam Mel Nor Pal Quin Ros Sal Tam Ul Var Wal Yar Zam Broad Under Cold Grim Hay Long Mon North Ox Rad Shel Tor West".split()
ENDS_OF_NAMES = "wood ley ford worth well hurst man mann stein berg bach feld meyer strom qvist gren lund sson sen ez era ino elli etti ucci ano ov ova ev enko ski ska wicz escu opoulos idis yan nathan swamy murthy appan wala oglu zadeh ullah ington ster bury more ton don mond negro veria schmidt holt hardt linger auer ette eau ier ard in ois aga iko awa oto ura ano eshi ani oor ela".split()
THINGS = "the ledger,the contract,the second copy,the old mill,the fence,a letter,the minutes,the keys,the invoice,the harbour plan,the boat,the shares,the orchard,the final report,two boxes,the roof,the wall,the budget,a lorry,the cellar,the deed,the map,the cheque,the hall,the garden,the whole collection,an apology,the documents,the machine,the shop".split(",")
WHENS = "yesterday,on Monday,in March,last week,before noon,after the hearing,in the evening,at the gate,twice,in a single night,for three years,without an answer,during the flood,at the auction,by the river,in the spring,after lunch,in the end,once more,with a friend,near the canal,at first,within the hour,since the war,in part".split(",")
CLAUSES = "the boiler had never worked,nothing was paid,the bridge was closed,the water came in,the plan would fail,the lease had ended,nobody came to the meeting,the boxes were empty,the price was too high,the hall was let twice,the wall had moved,it rained all day".split(",")
PLACES = "Harbour Valley River Hill Lake North West Old Mill Temple Castle Garden Market Bridge Green Spring Stone Iron Copper Cedar".split()
FIRMS = "Limited,Ltd.,Private Limited,LLP,Mills Limited,Bank,Steel Works,Foods,& Sons,Brothers,Holdings,Motors,Textiles Private Limited,University,Trust,Foundation,Hospital".split(",")
WAYS = "Street,Road,Lane,Avenue,Marg,Row,Square,Path,Cross,Street,Road,Lane".split(",")
DOMAINS = "example.com example.org example.net mail.example.com example.co.uk post.example.in example.de corp.example.fr dept.example.gov example.edu".split()


def syllables(rng: random.Random) -> str:
    made = "".join(rng.choice(("b", "d", "f", "g", "h", "k", "l", "m", "n", "p", "r", "s", "t", "v", "z", "br", "dr", "gr", "kr", "sh", "st", "th", "tr", "ch", "bl", "gl", "sk", "w", "j", "y", "kw", "zh", "sz")) + rng.choice(("a", "e", "i", "o", "u", "ai", "ee", "oo", "ou", "ie", "ao", "uo", "ei")) for _ in range(rng.choice((1, 2, 2, 3))))
    return (made + rng.choice(("", "n", "r", "v", "sh", "ne", "ni", "t", "s", "l", "th", "va", "ski", "son", "sen", "ez", "ov", "ini", "berg", "wala", "appa", "ton", "ng", "ko", "ius"))).capitalize()


def forename(rng: random.Random) -> str:
    return rng.choice(FORENAMES) if rng.random() < 0.6 else syllables(rng)


def surname(rng: random.Random) -> str:
    kind = rng.random()
    one = rng.choice(SURNAMES) if kind < 0.35 else rng.choice(ROOTS) + rng.choice(("", "", "er", "a", "i", "o")) + rng.choice(ENDS_OF_NAMES) if kind < 0.7 else syllables(rng)
    if rng.random() < 0.06:
        return rng.choice(("Mac", "O'", "De ", "Van ", "St. ", "Al-", "von ")) + one
    return f"{one}-{rng.choice(SURNAMES)}" if rng.random() < 0.06 else one


def person(rng: random.Random) -> str:
    kind = rng.random()
    if kind < 0.62:
        return f"{forename(rng)} {surname(rng)}"
    if kind < 0.7:
        return f"{forename(rng)} {rng.choice('ABCDEFGHIJKLMNOPRSTVW')}. {surname(rng)}"
    if kind < 0.76:
        return f"{forename(rng)} {forename(rng)} {surname(rng)}"
    if kind < 0.82:
        return f"{surname(rng)}, {forename(rng)}"
    title = rng.choice(("Mr.", "Mrs.", "Ms.", "Dr.", "Prof.", "Shri", "Smt.", "Justice", "Advocate", "Capt.", "Sri", "Adv.", "Mr", "Dr"))
    return f"{title} {surname(rng)}" if kind < 0.94 else f"{title} {forename(rng)} {surname(rng)}"


def digits(pattern: str, rng: random.Random) -> str:
    """The pattern with a digit for each # and a capital for each @."""
    return "".join(rng.choice("0123456789") if c == "#" else rng.choice("ABCDEFGHJKLMNPQRSTUVWXYZ") if c == "@" else c for c in pattern)


def email(rng: random.Random) -> str:
    a, b = forename(rng).lower(), syllables(rng).lower()
    local = rng.choice((f"{a}.{b}", f"{a[0]}.{b}", f"{a}{rng.randrange(100)}", f"{b}-office", f"{a}_{b}", f"{b}+news", b, f"info.{b}"))
    domain = rng.choice(DOMAINS) if rng.random() < 0.6 else f"{syllables(rng).lower()}{rng.choice(('', '-' + syllables(rng).lower()))}.{rng.choice(('com', 'org', 'net', 'co.in', 'example', 'de', 'ac.uk'))}"
    return f"{local}@{domain}"


def phone(rng: random.Random) -> str:
    return digits(rng.choice(("+## #### ######", "(###) ###-####", "### #### ####", "+# ### ### ####", "##### #####", "+## ##### #####", "###-#### ####", "##### ######", "+## # ## ## ## ##", "#### ### ####", "###-####-###", "##########", "+### # ### ####", "###.###.####", "+# (###) ###-####", "+## ## ### ## ##", "(0##) #### ####", "+##-##########", "0## #### ####", "#### #### ####")), rng)


def identity(rng: random.Random) -> tuple[str, str]:
    name, pattern = rng.choice((
        ("social security number", "###-##-####"), ("SSN", "###-##-####"), ("taxpayer number", "###-##-####"), ("passport number", "@#######"), ("passport No.", "@#######"), ("passport", "@#######"), ("PAN", "@@@@@####@"), ("PAN:", "@@@@@####@"), ("permanent account number", "@@@@@####@"), ("national identity number", "#### #### ####"),
        ("Aadhaar", "#### #### ####"), ("Aadhaar number:", "#### #### ####"), ("identity number", "####-####-####"), ("identity card", "####-####-####"), ("driving licence", "@@## ###########"), ("driver's licence number", "@@## ###########"), ("voter card", "@@@#######"), ("voter identity number", "@@@#######"), ("ration card", "############"), ("UID", "#### #### ####"),
    ))
    return name, digits(pattern, rng)


def address(rng: random.Random) -> str:
    way = f"{rng.choice((syllables(rng), rng.choice(PLACES), rng.choice(SURNAMES), rng.choice(PLACES) + ' ' + rng.choice(PLACES)))} {rng.choice(WAYS)}"
    town = rng.choice((syllables(rng), rng.choice(PLACES) + rng.choice(("ton", "field", "pur", "ville", "burg", "dale"))))
    no = str(rng.randrange(1, 990))
    return rng.choice((f"{no} {way}, {town}", f"{no} {way}", f"Flat {rng.randrange(1, 90)}, {no} {way}, {town}", f"House No. {no}, {way}, {town} {digits('######', rng)}", f"{no}, {way}, {town} {digits('######', rng)}", f"{no} {way}, {town} {digits('#####', rng)}", f"Flat {rng.randrange(1, 90)}, {syllables(rng)} Apartments, {way}, {town} {digits('######', rng)}", f"Door No. {no}, {way}, {town}", f"{no}/{rng.randrange(1, 9)}, {way}, {town}", f"Shop No. {no}, {way}, {town}"))


def made(rng: random.Random) -> tuple[str, np.ndarray]:
    """A sentence of the grammar and the tag of each character."""
    pick = rng.choice
    n, role, deed, thing, when, clause = (lambda: (person(rng), 5)), pick(ROLES), pick(DEEDS), pick(THINGS), pick(WHENS), pick(CLAUSES)
    kind = rng.random()
    if kind < 0.42:
        parts = pick((
            [n(), f" {deed} {thing} {when}."], [f"{when[0].upper() + when[1:]} ", n(), f" {deed} {thing}."], [f"The {role}, ", n(), f", {deed} {thing} {when}."], [f"The {role} ", n(), f" {deed} {thing}."], [f"{thing[0].upper() + thing[1:]} was {deed} by ", n(), f" {when}."], ["According to ", n(), f", {clause}."], [f"{clause[0].upper() + clause[1:]}, said ", n(), "."],
            [n(), " and ", n(), f" {deed} {thing}."], ["It was ", n(), f" who {deed} {thing}."], [f"A {pick(('letter', 'reply', 'note', 'cousin', 'bill'))} from ", n(), f" came {when}."], [f"They {pick(('met', 'sent', 'asked', 'paid', 'told', 'thanked', 'remember', 'followed'))} ", n(), f" {when}."], [f"{pick(('His', 'Her', 'My', 'Our'))} {role}, ", n(), f", {deed} {thing}."], [f"We {pick(('spoke with', 'wrote to', 'owe it to', 'waited for', 'heard of'))} ", n(), f" about {thing}."],
            [f"{pick(('Even', 'Neither', 'Nobody but', 'Only', 'Perhaps'))} ", n(), f" {deed} {thing}."], [f"The {pick(('house', 'dog', 'signature', 'vote', 'claim', 'will', 'work', 'fee'))} of ", n(), f" was {pick(('lost', 'counted', 'heard', 'known'))} {when}."], [n(), f" is {pick(('listed', 'named', 'known', 'shown'))} as the {role}."], [f"{clause[0].upper() + clause[1:]} when ", n(), f" {deed} {thing}."], ["Nothing was said about ", n(), "."], [f"The {pick(('register', 'report', 'list', 'will', 'order'))} {pick(('shows', 'names'))} ", n(), f" as the {role}."],
        ))
    elif kind < 0.52:
        e = lambda: (email(rng), 1)
        parts = pick((["Write to ", e(), f" {when}."], [f"The {role} replied from ", e(), "."], [f"{pick(('Contact', 'E-mail', 'Mail', 'Email'))}: ", e(), pick(("", "."))], [f"Send {thing} to ", e(), f" {when}."], ["Use ", e(), f" for {thing}."], [f"{pick(('Her', 'His', 'My', 'The'))} address is ", e(), "."], ["Questions go to ", e(), " only."], [f"{thing[0].upper() + thing[1:]} was mailed by ", e(), f" {when}."], ["Both ", e(), " and ", e(), " are closed."]))
    elif kind < 0.64:
        p = (phone(rng), 2)
        parts = pick(([f"Call {pick(('', 'me on ', 'the clerk at ', 'us on ', 'him at '))}", p, f" {when}."], [f"{pick(('Phone', 'Tel', 'Telephone', 'Mobile', 'Fax', 'Tel.'))}{pick((': ', ' ', ' no. '))}", p, pick(("", "."))], [f"{pick(('Her', 'His', 'The', 'My'))} {pick(('mobile', 'phone number', 'number', 'cell', 'fax number', 'contact number'))} is ", p, f" {when}."], [f"The {role} can be reached {pick(('on', 'at'))} ", p, "."], ["Ring ", p, f" and ask for the {role}."], ["Dial ", p, f" {when}."], [f"A message was left on ", p, "."], ["Text ", p, " if you are late."], [f"The {role} answers ", p, f" {when}."]))
    elif kind < 0.74:
        name, number = identity(rng)
        i = (number, 3)
        parts = pick(([f"{pick(('His', 'Her', 'The'))} {name} is ", i, "."], [f"{pick(('The', 'A'))} {name} ", i, f" was {deed} {when}."], [f"{name[0].upper() + name[1:]}{pick((' ', ': '))}", i, pick(("", "."))], [f"The {role} gave {name} ", i, f" {when}."], [f"{name[0].upper() + name[1:]} ", i, f" belongs to the {role}."], [f"The {role}'s {name} ", i, " had expired."], [f"He holds {name} ", i, "."]))
    elif kind < 0.85:
        a = (address(rng), 4)
        parts = pick(([f"{pick(('He', 'She', 'The ' + role))} lives at ", a, "."], ["Deliver it to ", a, f" {when}."], [f"{pick(('His', 'Her', 'The'))} address is ", a, "."], ["Residing at ", a, f", he {deed} {thing}."], [f"The notice was served at ", a, "."], ["They moved to ", a, f" {when}."], [f"The {role} of ", a, f" {deed} {thing}."], [f"{thing[0].upper() + thing[1:]} went to ", a, "."], ["Write to him at ", a, "."], ["Post goes to ", a, f" {when}."], ["He gave ", a, " as his address."], [f"She {pick(('rents', 'bought', 'left'))} ", a, f" {when}."]))
    else:
        firm, place = f"{pick((surname(rng), pick(PLACES) + ' ' + pick(PLACES), syllables(rng)))} {pick(FIRMS)}", pick(PLACES)
        parts = pick(([f"{firm} {deed} {thing} {when}."], [f"The {place} {pick(('Court', 'Tribunal', 'Council', 'Trust', 'Museum', 'Committee'))} of {syllables(rng)} {deed} {thing}."], [f"{thing[0].upper() + thing[1:]} was {deed} by {firm}."], [f"Invoice {digits('####', rng)} of {digits('##.##.20##', rng)} was {deed}."], [f"Case No. {digits('###', rng)} of {digits('20##', rng)} was {deed} {when}."], [f"Receipt {digits('######', rng)} was issued {when}."], [f"Seal number {digits('#####', rng)} does not match."], [f"{clause[0].upper() + clause[1:]} {when}."], [f"Plot {digits('##', rng)}, survey number {digits('##/#', rng)}, lies beyond {syllables(rng)}."], [f"Rs. {digits('#,##,###', rng)} was paid by {firm} {when}."], [f"Section {digits('##', rng)} of the {place} Act applies."]))
    text = "".join(x if isinstance(x, str) else x[0] for x in parts)
    tags = np.concatenate([np.full(len(x if isinstance(x, str) else x[0]), 0 if isinstance(x, str) else x[1], dtype=np.uint8) for x in parts])
    if rng.random() < 0.3:
        more, others = made(rng)
        text, tags = f"{text} {more}", np.concatenate([tags, np.zeros(1, dtype=np.uint8), others])
    return text, tags


def vary(text: str, marked: list[tuple[int, int, int]], rng: random.Random, known: set[str]) -> tuple[str, np.ndarray]:
    """The text with other digits and, often, other surnames, and the tag of each character."""
    tags = np.zeros(len(text), dtype=np.uint8)
    for a, b, t in marked:
        tags[a:b] = t
    out, marks = [], []
    swap, other = rng.random() < 0.6, rng.random() < 0.5
    for m in re.finditer(r"[^\W\d_]+|\d|.", text, re.DOTALL):
        w, t = m.group(), tags[m.start()]
        if w.isdigit() and rng.random() < 0.8:
            w = rng.choice("0123456789")
        elif swap and t == 5 and len(w) > 3 and w.lower() in known:
            new = syllables(rng)
            w = new.upper() if w.isupper() else new if w[0].isupper() else new.lower()
        elif swap and other and t == 5 and len(w) > 2 and w[0].isupper() and w.lower() not in names.TITLES:
            new = rng.choice(FORENAMES + SURNAMES)
            w = new.upper() if w.isupper() else new
        elif rng.random() < 0.002 and len(w) > 3:
            k = rng.randrange(len(w))
            w = w[:k] + rng.choice("abcdefghijklmnopqrstuvwxyz015!") + w[k + 1 :]
        out.append(w)
        marks.append(np.full(len(w), t, dtype=np.uint8))
    text, tags = "".join(out), np.concatenate(marks) if marks else np.zeros(0, dtype=np.uint8)
    if rng.random() < 0.02:
        text = text.upper() if len(text.upper()) == len(text) else text
    return text, tags


def labelled(folders: list[str], sample: int = SAMPLE, seed: int = 5) -> tuple[list[np.ndarray], list[np.ndarray]]:
    import pyarrow.parquet as pq

    rng = random.Random(seed)
    with_spans, without = [], []
    seen = set()
    for folder in folders:
        mentions = pq.read_table(f"{folder}/entity_mentions.parquet", columns=["case_id", "text", "schema_type", "context"]).to_pylist()
        nodes = pq.read_table(f"{folder}/tree_nodes.parquet", columns=["case_id", "content"]).to_pylist()
        known = gazetteer((m["case_id"], m["text"], m["schema_type"]) for m in mentions)
        for case, text in [(m["case_id"], m["context"]) for m in mentions] + [(n["case_id"], n["content"]) for n in nodes]:
            for a, b in segments(text or ""):
                piece = text[a:b]
                if piece in seen or not piece.strip():
                    continue
                seen.add(piece)
                marked = spans(piece, known[case])
                (with_spans if marked else without).append((piece, marked, known[case][0]))
    rng.shuffle(with_spans)
    rng.shuffle(without)
    keep = with_spans[: sample * 2 // 3] + without[: sample // 3]
    texts, tags = [], []
    for piece, marked, surnames in keep:
        text, t = vary(piece, marked, rng, surnames)
        begin = 0 if len(text) <= 208 else rng.randrange(len(text) - 207)
        texts.append(pii_model.encode(text[begin : begin + 208]))
        tags.append(t[begin : begin + 208])
    for _ in range(len(keep)):
        text, t = made(rng)
        texts.append(pii_model.encode(text[:208]))
        tags.append(t[:208])
    return texts, tags


def main() -> None:
    arguments = argparse.ArgumentParser()
    arguments.add_argument("tables", nargs="+")
    arguments.add_argument("--seconds", type=float, default=300)
    arguments.add_argument("--out", default="docmill/llm/pii_weights.npz")
    arguments.add_argument("--sample", type=int, default=SAMPLE)
    arguments.add_argument("--start")
    a = arguments.parse_args()
    texts, tags = labelled(a.tables, a.sample)
    print(len(texts), "segments,", sum(map(len, texts)), "characters,", np.bincount(np.concatenate(tags), minlength=pii_model.TAGS), flush=True)
    p = pii_model.train(texts, tags, a.seconds, start=pii_model.widen({k: v.astype(np.float32) for k, v in np.load(a.start).items()}) if a.start else None)
    np.savez_compressed(a.out, **{k: v.astype(np.float16) for k, v in p.items()})


if __name__ == "__main__":
    main()
