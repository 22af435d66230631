"""Problem 8: the subject areas of each document.

Method: seeded non-negative factorisation of the document-term matrix by alternating
multiplicative updates (Kullback-Leibler form).  One component is anchored to each subject: it
starts from the words that labelled documents of the subject use more than chance allows and
from a short list of its terms, and anchor terms belong to no other component.  A few more
components, one for each language and free of anchors, take up the wording common to all cases.
The document factor is each document's mixture of subjects.  It splits every term of the document
among the components; a sentence deals with the subject that gets most of its decided terms, and
a document with every subject that has a fifth of its sentences.

Scale: the matrix lives in Spark, a row for each document.  A pass fits the document factor
where the row is and sends only sums by term, combined before the shuffle; the driver holds the
term factor, whose size is bounded by the vocabulary (terms in at least MIN_SHARE of documents;
those in more than MAX_SHARE only where the labels show that subjects differ in them).
Document frequencies, sums and factors cover all documents.  Labels are a bounded sample: at
most LABELS rows, the earliest by label_id.

Defined cases: null, blank and unreadable texts have no row; without labels the terms alone
seed; a sentence of a single word counts with the next; names are no evidence of a subject.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.session import materialize, stored, tidy

OTHER = "universal"
LABELS = 50_000
MIN_SHARE, MIN_DOCS, MAX_SHARE = 0.0005, 3, 0.3
#: So many times as often in a subject as elsewhere, a term tells of it, however many documents have it.
TELLING = 3
PASSES, INNER = 8, 3
#: Documents worked through at once, and entries of documents of similar length, so that their part of the matrix stays in the cache.
AT_ONCE, ENTRIES = 1024, 16384
#: Terms of a block of sums, and tasks whose sums are added up first.
CELL, TEAM = 4096, 32
#: The passes end when no larger part of the decided terms changes its subject.
SETTLED = 0.001
PRIOR = 0.3
DECIDED, ENOUGH, SHARE = 0.5, 0.9, 0.2
#: How far a document's mixture leads its sentences: 0 not at all, 1 as far as the factors say.
TEMPER = 0.25
LANGUAGES = ["en", "es", "fr"]

#: Terms of each subject in English, Spanish and French; _ joins neighbours, words of one or two letters left out.
TERMS = {
    "banking_finance": """borrower lender loan repayment mortgage insolvency moratorium creditor overdraft instalment cheque surety non-performing resolution_professional drawing_power equitable_mortgage
        prestatario préstamo hipoteca hipotecaria acreedor insolvencia aval convenio_pago línea_crédito cuota_vencida garantía_hipotecaria intereses_demora
        emprunteur prêt hypothécaire hypothèque créancier nanti échéance impayée apurement d'apurement plan_d'apurement ligne_crédit intérêts_retard prêt_terme""",
    "constitutional": """writ constitution constitutional statute legislature mandamus certiorari proportionality freedoms ordinance judicial_review fundamental_right locus_standi natural_justice
        amparo igualdad constitucional reglamentaria proporcionalidad legalidad control_judicial justicia_natural derecho_fundamental acto_administrativo
        égalité d'égalité constitutionnel réglementaire proportionnalité juridictionnel équité procédurale droit_fundamental droit_fondamental""",
    "corporate": """shareholder shareholders prospectus amalgamation dividend dividends subscriber equity promoter winding_petition board_resolution rights_issue independent_director related_party
        accionista accionistas estatutos sociales suscripción consejo_administración junta_extraordinaria libro_socios fusión_por fusión_absorción derecho_suscripción
        actionnaire actionnaires associés fusion-absorption souscription statuts_société conseil_d'administration assemblée_générale""",
    "criminal": """accused prosecution jail constable murder penal forensic anticipatory_bail charge_sheet identification_parade judicial_custody
        procesado fiscalía prisión_preventiva forense rueda_reconocimiento testigo_cargo beneficio_duda libertad_provisional escrito_acusación
        d'accusation parquet détention_provisoire médico-légal parade_d'identification bénéfice_doute témoin_charge mise_liberté""",
    "ip_patent": """patent patents trademark copyright infringement inventive royalty licensee counterfeit invention trade_mark passing_off prior_art
        patente marca_registrada derecho_autor estado_técnica inventiva licencia_exclusiva falsificado desleal
        brevet marque_déposée droit_d'auteur état_technique inventive licence_exclusive contrefait déloyale""",
    "labour": """workman workmen wages dismissal retrenchment gratuity superannuation overtime reinstatement trade_union domestic_enquiry back_wages
        despido improcedente salarios_caídos salarios sindicato convenio_colectivo periodo_prueba horas_extraordinarias extraordinarias_fue trabajador huelga
        licenciement abusif arriérés_salaire convention_collective syndicat période_d'essai heures_supplémentaires grève salarié""",
    "property": """tenant lease landlord conveyance plot mutation encumbrance easement possession acres partition right_way sale_deed title_search
        arrendamiento compraventa servidumbre linderos finca desalojo inquilino certificado_cargas registro_propiedad
        contrat_bail acte_vente servitude_passage parcelle locataire foncier certificat_charges""",
    "tax": """assessee assessment levy withholding excise customs gst reassessment disallowed input_credit advance_ruling block_period book_profit
        imponible tributaria retención_fuente sanción_fiscal deducción_por devolución_ingresos crédito_fiscal
        imposable retenue_source pénalité_fiscale déduction_charges remboursement_trop avis_d'imposition générateur crédit_taxe""",
}

#: What ends in a full stop without ending a sentence.
ABBREVIATIONS = set("rs no nos mr mrs ms dr smt shri adv prof hon ltd pvt co v vs exh art sec para st ors inr sri esq capt bros".split())
#: So many letters before a full stop are no abbreviation.
LONG = max(map(len, ABBREVIATIONS)) + 1
ENDS = re.compile(r"[.!?\n](?:(?<!\n)[.!?]*[\"')\]]*(?=\s)|(?<=\n)(?:\s*\n|(?=\s*[-*•(#\d])))")
FIRST = re.compile(r"[^\w]*([^\W\d_])[\w'’-]*(?:[^\w]+(?:[^\W_A-ZÀ-ÖØ-Þ]|$)|[^\w]*$)")
DOTTED = re.compile(r"(?:\w\.)+\w?")


def sentences(text: str) -> list[str]:
    out, begin = [], 0
    for m in ENDS.finditer(text):
        at, end = m.span()
        if text[at] == ".":
            if text[end : end + 3].strip()[:1].islower():
                continue
            if at - begin < LONG or not text[at - LONG : at].isalpha():
                word = text[max(begin, at - 24) : at].rsplit(None, 1)[-1:]
                word = word[0].lower().lstrip("(") if word else ""
                if word in ABBREVIATIONS or len(word) == 1 and word.isalpha() or DOTTED.fullmatch(word):
                    continue
        part = text[begin:end].strip()
        if len(part) > 12 or " " in part:  # a single word counts with what follows
            out.append(part)
            begin = end
    part = text[begin:].strip()
    return [*out, part] if part else out


class Apart(dict):
    """What stands for a character beyond ASCII: letters stay, capitals become A, the rest is space."""

    def __missing__(self, c: str) -> str:
        self[c] = out = "'" if c == "’" else "A" if c.isupper() else c if c.isalpha() else " "
        return out


CAPITAL = "~"
#: Stands between the sentences of a document while their words are told apart.
BREAK = "\x01"
APART = Apart()
#: Letters, apostrophes and hyphens stay, capitals become a mark, the rest is space; bytes beyond ASCII belong to letters.
ASCII_APART = bytes(i if i > 127 or chr(i).islower() or chr(i) in "'-" + BREAK else ord(CAPITAL) if chr(i).isupper() else 32 for i in range(256))


def lowered(sentence: str) -> str:
    """The sentence with a first word in lower case, unless that is a name: it is one only if the next one has a capital too."""
    if sentence.isupper():
        return sentence.lower()
    first = FIRST.match(sentence)
    if not first:
        return sentence
    at = first.start(1)
    return sentence[at].lower() + sentence[at + 1 :]


def apart(text: str) -> list[bytes]:
    """The words of lowered sentences; names are left with a mark instead of their capital."""
    if not text.isascii():
        for c in set(text):
            if c > "\x7f" and APART[c] != c:
                text = text.replace(c, APART[c])
    return text.encode().translate(ASCII_APART).split()


def words(sentence: str) -> list[bytes]:
    """Words in lower case, with a mark instead of the capital of names."""
    return apart(lowered(sentence.replace(BREAK, " ")))


class Codes(dict):
    """A word's number, remembered; it depends on the word alone. Names and short words have none (-1), nor have breaks (-2)."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 1_000_000:
            self.clear()
        bare = word.strip(b"'-")
        self[word] = code = -2 if word == BREAK.encode() else -1 if len(bare.decode()) < 3 or bare[:1] == CAPITAL.encode() else zlib.crc32(bare) & 0x7FFFFFFF
        return code


def pair_codes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Numbers of pairs of neighbours, above those of single words."""
    mixed = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ b.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    mixed ^= mixed >> np.uint64(29)
    return ((mixed * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(24)).astype(np.int64) + (1 << 31)


def code_of(term: str) -> int:
    """The number of a word, or of a pair joined by _."""
    first, _, second = term.encode().partition(b"_")
    codes = Codes()
    return int(pair_codes(np.array([codes[first]]), np.array([codes[second]]))[0]) if second else codes[first]


CODED = "doc_id long, lang string, codes binary, sizes binary"


def _packed(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """A list of numbers for each row as bytes, which travel and are stored as they are."""
    ends = np.append(0, np.cumsum(lengths) * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(values))])


def _lists(batch: pa.RecordBatch, name: str, kind=np.int32) -> tuple[np.ndarray, np.ndarray]:
    """All values of a column made by _packed and their number in each row."""
    column = batch.column(name)
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, dtype=np.int32, count=len(column) + 1, offset=4 * column.offset) if len(column) else np.zeros(1, dtype=np.int32)
    values = np.frombuffer(data, dtype=np.uint8)[ends[0] : ends[-1]].view(kind) if ends[-1] > ends[0] else np.zeros(0, dtype=kind)
    return values, np.diff(ends).astype(np.int64) // np.dtype(kind).itemsize


def _owners(lengths: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(lengths)), lengths)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    codes = Codes()
    for batch in batches:
        flat, sizes = [np.zeros(0, dtype=np.int32)], []
        for text in batch.column("text").to_pylist():
            told = sentences(text) if text else []
            if text and BREAK in text:
                told = [s.replace(BREAK, " ") for s in told]
            # a break ends each sentence
            found = apart(f" {BREAK} ".join([*map(lowered, told), ""])) if told else []
            flat.append(np.fromiter(map(codes.__getitem__, found), dtype=np.int32, count=len(found)))
            sizes.append(len(told))
        code = np.concatenate(flat)
        ended = code == -2
        sentence, known = np.cumsum(ended) - ended, code >= 0
        length = np.bincount(sentence[known], minlength=sum(sizes)).astype(np.int32)
        doc = _owners(np.array(sizes, dtype=np.int64))
        n_words = np.bincount(doc, weights=length, minlength=batch.num_rows).astype(np.int64)
        doc, length = doc[length > 0], length[length > 0]
        made = pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), _packed(code[known], n_words), _packed(length, np.bincount(doc, minlength=batch.num_rows))], names=["doc_id", "lang", "codes", "sizes"])
        yield made.filter(pa.array(n_words > 0))


def _terms(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the words and pairs of some documents, and the sentence of each, in order of sentences."""
    one = _lists(batch, "codes")[0].astype(np.int64)
    sentence = _owners(_lists(batch, "sizes")[0])
    term = np.full(2 * len(one), -1, dtype=np.int64)  # each word and the pair that it begins
    term[::2] = one
    joined = np.flatnonzero(sentence[1:] == sentence[:-1])
    term[1 + 2 * joined] = pair_codes(one[joined], one[joined + 1])
    there = term >= 0
    return term[there], np.repeat(sentence, 2)[there]


def _document_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (b.slice(i, 1 << 16) for b in batches for i in range(0, b.num_rows, 1 << 16)):
        term, sentence = _terms(batch)
        owner = _owners(_lists(batch, "sizes")[1])[sentence]
        both = np.sort(term << 16 | owner)  # terms have 41 bits
        term = both[np.diff(both, prepend=-1) != 0] >> 16
        begins = np.flatnonzero(np.diff(term, prepend=-1))
        counts = np.diff(np.append(begins, len(term)))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(term[begins], -1)), pa.array(np.append(counts, batch.num_rows))], names=["term", "n"])


def place_kind(n_terms: int):
    """The least type that holds places in the vocabulary."""
    return np.uint16 if n_terms <= 1 << 16 else np.int32


MATRIX = "doc_id long, lang string, terms binary, counts binary, ids binary, sizes binary"


def places(vocabulary: np.ndarray):
    """A function from terms to (their places in the vocabulary, whether they are in it)."""
    size = 1 << (16 * len(vocabulary)).bit_length()
    slot, own = vocabulary & (size - 1), np.arange(len(vocabulary), dtype=np.int32)
    table = np.zeros(size, dtype=np.int32)
    table[slot] = own
    lost = np.flatnonzero(table[slot] != own)  # their slots went to others
    spilt = vocabulary[lost]

    def find(term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = table[term & (size - 1)]
        hit = vocabulary[at] == term
        if len(lost):
            rest = np.flatnonzero(~hit)
            among = np.minimum(np.searchsorted(spilt, term[rest]), len(lost) - 1)
            there = spilt[among] == term[rest]
            at[rest[there]] = lost[among[there]]
            hit[rest[there]] = True
        return at, hit

    return find


def _known(shared):
    """Words and pairs as places in the vocabulary; unknown ones drop out, sentences stay.

    terms and counts are the document's row of the matrix, ids and sizes its sentences.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        find = places(vocabulary)
        kind = place_kind(len(vocabulary))
        for batch in (b.slice(i, AT_ONCE) for b in batches for i in range(0, b.num_rows, AT_ONCE)):
            term, sentence = _terms(batch)
            at, hit = find(term)
            at, sentence = at[hit], sentence[hit]
            lengths, n_sentences = _lists(batch, "sizes")
            doc = _owners(n_sentences)
            in_sentence = np.bincount(sentence, minlength=len(lengths)).astype(np.int32)
            cell, count = np.unique(doc[sentence] * len(vocabulary) + at, return_counts=True)
            n_terms = np.bincount(cell // len(vocabulary), minlength=batch.num_rows)
            n_ids = np.bincount(doc[sentence], minlength=batch.num_rows)
            made = [_packed((cell % len(vocabulary)).astype(kind), n_terms), _packed(count.astype(np.int32), n_terms), _packed(at.astype(kind), n_ids), _packed(in_sentence, n_sentences)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), *made], names=["doc_id", "lang", "terms", "counts", "ids", "sizes"])

    return run


def document_factor(h: np.ndarray, terms: np.ndarray, counts: np.ndarray, sizes: np.ndarray, inner: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(w[n, k], before[n, k], ratio[entries]): the mixture of each document, the one an update earlier, and each entry's count over what that one expects.

    h[k, terms] is the term factor; an entry gives h * before * ratio to each component.
    Documents of similar length are worked through together, as products of small matrices.
    """
    n, k = len(sizes), len(h)
    w = np.full((n, k), 1.0 / k, dtype=np.float32)  # a document without terms keeps it
    before, ratio = w.copy(), np.zeros(len(terms), dtype=np.float32)
    starts = np.cumsum(sizes) - sizes
    order = np.argsort(sizes, kind="stable")
    order = order[sizes[order] > 0]
    while len(order):
        part = order[: max(1, ENTRIES // int(sizes[order[0]]))]
        part = part[: max(1, ENTRIES // int(sizes[part[-1]]))]
        order = order[len(part) :]
        length = sizes[part][:, None]
        place = np.arange(length[-1, 0])
        inside = place < length
        at = np.minimum(place, length - 1) + starts[part][:, None]
        some, count = np.take(h, terms[at], axis=1).transpose(1, 0, 2), counts[at] * inside
        now = w[part]
        for _ in range(inner):
            last = now
            r = count / (np.matmul(now[:, None, :], some)[:, 0] + np.float32(1e-30))
            now = now * np.matmul(some, r[:, :, None])[:, :, 0] + np.float32(0.02)
            now /= now.sum(axis=1, keepdims=True)
        w[part], before[part], ratio[at[inside]] = now, last, r[inside]
    return w, before, ratio


def _sums(shared, n_terms: int, inner: int, presence: bool = False):
    """Each partition's part of the numerator of the term factor but for the factor itself, a row for each block of terms.

    shared holds the term factor; where it is None the batch brings its document factor along.
    With presence a term counts once in a document.
    """
    kind = place_kind(n_terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = np.ascontiguousarray(shared.value.T, dtype=np.float32) if shared is not None else None
        total = None
        for batch in (b.slice(i, AT_ONCE) for b in batches for i in range(0, b.num_rows, AT_ONCE)):
            terms, sizes = _lists(batch, "terms", kind)
            counts = np.ones(len(terms), dtype=np.float32) if presence else _lists(batch, "counts")[0].astype(np.float32)
            if h is None:
                w, ratio = batch.column("w").flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(len(sizes), -1), counts
            else:
                _, w, ratio = document_factor(h, terms, counts, sizes, inner)
            order = np.argsort(terms, kind="stable")
            some = terms[order]
            begins = np.flatnonzero(np.diff(some.astype(np.int32), prepend=-1))
            some = some[begins]
            if total is None:
                total = np.zeros((w.shape[1], n_terms))
            if len(begins):
                ratio, row = ratio[order], _owners(sizes)[order]
                for j, own in enumerate(np.ascontiguousarray(w.T)):
                    total[j, some] += np.add.reduceat(np.take(own, row) * ratio, begins)
        if total is not None:
            task = TaskContext.get()
            team = task.partitionId() // TEAM if task else 0
            for block in range(-(-n_terms // CELL)):
                part = total[:, block * CELL : (block + 1) * CELL].T
                if part.any():
                    yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([team], pa.int32()), pa.array([part.astype(np.float32, order="C").tobytes()])], names=["block", "team", "part"])

    return run


def _added(group: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(x, dtype=np.float32).astype(np.float64) for x in group["part"])
    return pd.DataFrame({"block": group["block"].iloc[:1], "team": [0], "part": [total.astype(np.float32).tobytes()]})


def _gather(rows: DataFrame, shared, n_terms: int, k: int, columns: list[str], inner: int = INNER, presence: bool = False) -> np.ndarray:
    """Sums over all documents by term: blocks of terms are added up within teams of tasks, then over the teams."""
    kind = "block int, team int, part binary"
    sums = rows.select(*columns).mapInArrow(_sums(shared, n_terms, inner, presence), kind).groupBy("block", "team").applyInPandas(_added, kind).groupBy("block").applyInPandas(_added, kind).toPandas()  # at most the vocabulary
    out = np.zeros((n_terms, k))
    for block, part in zip(sums["block"], sums["part"], strict=True):
        part = np.frombuffer(part, dtype=np.float32).reshape(-1, k)
        out[block * CELL : block * CELL + len(part)] = part
    return out * shared.value if shared is not None else out


def _judge(shared, names: list[str], inner: int = INNER):
    """What each document's sentences deal with, by its own mixture.

    A term speaks for a subject where the term factor decides so, with the part of it that the
    document factor gives to the subject in this document.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factor, decided = shared.value
        h = np.ascontiguousarray(factor.T, dtype=np.float32)
        said = np.ascontiguousarray(decided.T, dtype=np.float32)
        k = len(names)
        said *= h[:k]
        kind = place_kind(h.shape[1])
        for batch in (b.slice(i, AT_ONCE) for b in batches for i in range(0, b.num_rows, AT_ONCE)):
            n = batch.num_rows
            terms, n_terms = _lists(batch, "terms", kind)
            w = document_factor(h, terms, _lists(batch, "counts")[0].astype(np.float32), n_terms, inner)[0].T
            ids, n_ids = _lists(batch, "ids", kind)
            sizes, n_sentences = _lists(batch, "sizes")
            doc, owner = _owners(n_sentences), _owners(n_ids)
            led = w**TEMPER
            whole = np.full(len(ids), 1e-30, dtype=np.float32)
            for j, own in enumerate(led):
                whole += np.take(h[j], ids) * np.take(own, owner)
            spoken = sizes > 0
            begins = (np.cumsum(sizes) - sizes)[spoken]
            weight = np.zeros((k, len(sizes)), dtype=np.float32)
            for j in range(k if len(begins) else 0):
                weight[j, spoken] = np.add.reduceat(np.take(said[j], ids) / whole, begins)
                weight[j] *= led[j, doc]
            weight = weight.T
            best = weight.argmax(axis=1)
            dealt = np.where(weight[np.arange(len(sizes)), best] >= ENOUGH, best, k)
            counts = np.bincount(doc * (k + 1) + dealt, minlength=n * (k + 1)).reshape(-1, k + 1)
            made = [pa.array(counts.sum(axis=1)), *(pa.array(counts[:, j]) for j in range(k)), *(pa.array(w[j].astype(np.float64)) for j in range(k))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *made], names=["doc_id", "n_sentences", *(f"s{j}" for j in range(k)), *(f"w{j}" for j in range(k))])

    return run


def label_shares(labels: DataFrame, names: list[str]) -> DataFrame:
    """(doc_id, w): the share of each subject in the labels of a document."""
    subject = F.regexp_replace(F.lower(F.trim("subject_name")), r"[\s_-]+", "_")
    kept = labels.select("label_id", "doc_id", subject.alias("subject")).where(F.col("subject").isin(names) & F.col("doc_id").isNotNull()).orderBy("label_id").limit(LABELS)
    votes = kept.groupBy("doc_id").agg(F.count("*").alias("n"), *[F.count_if(F.col("subject") == s).alias(f"v{j}") for j, s in enumerate(names)])
    return votes.select("doc_id", F.array(*[F.col(f"v{j}") / F.col("n") for j in range(len(names))]).alias("w"))


def telling(inside: np.ndarray, outside: np.ndarray, n_inside: float, n_outside: float) -> np.ndarray:
    """Whether terms are found in a subject TELLING times as often as outside it, beyond chance."""
    expected = n_inside * outside / max(n_outside, 1e-12)
    chance = np.sqrt(expected * (1 + n_inside / max(n_outside, 1e-12)) + 1e-9)
    return (inside > TELLING * expected) & (inside - expected > 4 * chance) & (n_outside > 0)


def _differing(coded: DataFrame, frequent: np.ndarray, shares: DataFrame, k: int) -> np.ndarray:
    """Those of the frequent terms that tell of a subject by the labelled documents."""
    context = coded.sparkSession.sparkContext
    known = coded.join(F.broadcast(shares.select("doc_id")), "doc_id", "left_semi").mapInArrow(_known(context.broadcast(frequent)), MATRIX)
    given = known.join(F.broadcast(shares), "doc_id").select("terms", "w")
    documents = _gather(given, None, len(frequent), k, ["terms", "w"], presence=True)
    sums = coded.select("doc_id").join(F.broadcast(shares), "doc_id").agg(*[F.sum(F.col("w")[j]) for j in range(k)]).first()
    labelled = np.array([x or 0.0 for x in sums])
    found = np.zeros(len(frequent), dtype=bool)
    for j in range(k):
        found |= telling(documents[:, j], documents.sum(axis=1) - documents[:, j], labelled[j], labelled.sum() - labelled[j])
    return frequent[found]


def fit(rows: DataFrame, vocabulary: np.ndarray, shares: DataFrame, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(term factor, the share of each subject in each term, 0 where it is not decided)."""
    context = rows.sparkSession.sparkContext
    index = {t: i for i, t in enumerate(vocabulary.tolist())}
    n, k = len(vocabulary), len(names)
    spoken = [F.when(F.lower("lang") == x, 1.0).otherwise(0.0) for x in LANGUAGES]
    own = F.coalesce("w", F.array(*[F.lit(0.0)] * k))
    given = rows.join(F.broadcast(shares), "doc_id", "left").withColumn("w", F.concat(own, F.array(*spoken, F.lit(1.0))))
    both = _gather(given, None, n, k + len(spoken) + 1, ["terms", "counts", "w"])
    labelled, common = both[:, :k], both[:, k:]
    base = common[:, -1] / max(common[:, -1].sum(), 1.0)
    anchor = np.zeros((n, k))
    for j, s in enumerate(names):
        for t in TERMS.get(s, "").split():
            if code_of(t) in index:
                anchor[index[code_of(t)], j] = 1
    seed = np.zeros((n, k))
    for j in range(k):
        expected = labelled[:, j].sum() * base
        often = (labelled[:, j] > TELLING * expected) & (labelled[:, j] - expected > 4 * np.sqrt(expected + 1e-9))
        rest = labelled.sum(axis=1) - labelled[:, j]
        often |= telling(labelled[:, j], rest, labelled[:, j].sum(), rest.sum())  # a large subject weighs in base itself
        seed[:, j] = np.where(often, labelled[:, j], 0)
    seed *= (seed / (seed.sum(axis=1, keepdims=True) + 1e-12)) ** 2
    unit = lambda x: x / (x.sum(axis=0, keepdims=True) + 1e-12)
    seed = unit(unit(seed) + unit(anchor * base[:, None]))
    free = len(LANGUAGES)
    mask = np.ones((n, k + free))
    fixed = anchor.any(axis=1)
    mask[fixed, :k] = anchor[fixed]
    mask[fixed, k:] = 0
    h = unit(np.hstack([0.8 * seed + 0.2 * base[:, None], unit(common[:, :free] + 0.01)]) * mask)
    before = None
    for _ in range(PASSES):
        got = _gather(rows, context.broadcast(h), n, k + free, ["terms", "counts"])
        tidy(rows.sparkSession)  # the shuffle files of a pass
        mass = got.sum(axis=0)
        got[:, :k] += PRIOR * got[:, :k].sum(axis=0) * seed
        h = unit((got + 1e-4) * mask)
        share = h * mass
        share /= share.sum(axis=1, keepdims=True) + 1e-30
        now = np.where(share[:, :k].max(axis=1) >= DECIDED, share[:, :k].argmax(axis=1), -1)
        changed = (now != before).sum() if before is not None else n
        before = now
        if changed <= SETTLED * max((now >= 0).sum(), 1):
            break
    return h, np.where(share[:, :k] >= DECIDED, share[:, :k], 0.0)


def composition(docs: DataFrame, areas: DataFrame, labels: DataFrame) -> DataFrame:
    """docs(doc_id, lang, text) -> (doc_id, n_sentences, subject_name, sentences, mixture), a row for each subject."""
    context = docs.sparkSession.sparkContext
    names = sorted(r[0] for r in areas.select("subject_name").where(f"subject_name is not null and subject_name <> '{OTHER}'").distinct().collect())  # a fixed short list
    texts = docs.select("doc_id", "lang", "text").where("doc_id is not null and text is not null")
    coded, release = stored(texts.mapInArrow(_rows, CODED))
    counts = materialize(coded.select("codes", "sizes").mapInArrow(_document_frequencies, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")))
    n_docs = counts.where("term = -1").agg(F.max("n")).first()[0] or 0
    least = max(MIN_DOCS, int(MIN_SHARE * n_docs))
    anchors = [code_of(t) for s in names for t in TERMS.get(s, "").split()]
    usual = (F.col("n") <= max(MAX_SHARE * n_docs, 50)) | F.col("term").isin(anchors)
    kept = counts.where((F.col("term") >= 0) & (F.col("n") >= least)).select("term", usual.alias("usual")).toPandas()  # at most a document's mean terms / MIN_SHARE
    frequent = np.sort(kept["term"][~kept["usual"].astype(bool)].to_numpy(dtype=np.int64))
    vocabulary = kept["term"][kept["usual"].astype(bool)].to_numpy(dtype=np.int64)
    shares = materialize(label_shares(labels, names))  # at most LABELS rows, which are broadcast
    if len(frequent):
        vocabulary = np.append(vocabulary, _differing(coded, frequent, shares, len(names)))
    vocabulary = np.sort(vocabulary)
    if not len(vocabulary):
        vocabulary = np.array([-1], dtype=np.int64)
    matrix, _ = stored(coded.mapInArrow(_known(context.broadcast(vocabulary)), MATRIX))  # read by the result, so it stays
    release()
    tidy(docs.sparkSession)
    factors = fit(matrix, vocabulary, shares, names)
    kind = "doc_id long, n_sentences long, " + ", ".join([*(f"s{j} long" for j in range(len(names))), *(f"w{j} double" for j in range(len(names)))])
    judged = matrix.select("doc_id", "terms", "counts", "ids", "sizes").mapInArrow(_judge(context.broadcast(factors), names), kind)
    pairs = F.array(*[F.struct(F.lit(s).alias("subject_name"), F.col(f"s{j}").alias("sentences"), F.col(f"w{j}").alias("mixture")) for j, s in enumerate(names)])
    rest = F.col("n_sentences") - sum(F.col(f"s{j}") for j in range(len(names)))
    pairs = F.concat(pairs, F.array(F.struct(F.lit(OTHER).alias("subject_name"), rest.alias("sentences"), (1 - sum(F.col(f"w{j}") for j in range(len(names)))).alias("mixture"))))
    return judged.select("doc_id", "n_sentences", F.inline(pairs))


def subjects(docs: DataFrame, areas: DataFrame, labels: DataFrame, share: float = SHARE) -> DataFrame:
    """(doc_id, subject_name): subjects of at least the given share of sentences, else universal."""
    parts = composition(docs, areas, labels)
    dealt = (F.col("subject_name") != OTHER) & (F.col("sentences") >= share * F.col("n_sentences"))
    chosen = parts.groupBy("doc_id").agg(F.collect_set(F.when(dealt, F.col("subject_name"))).alias("chosen"))
    return chosen.select("doc_id", F.explode(F.when(F.size("chosen") > 0, F.col("chosen")).otherwise(F.array(F.lit(OTHER)))).alias("subject_name"))
