"""Text as Column expressions: everything stays inside the JVM and whole-stage code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode has it, spelt out so that every regex engine agrees.
SPACE = r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: A search token: letters, digits and _, with . , / - inside.
TOKEN = r"[\p{L}\p{N}_](?:[\p{L}\p{N}_.,/-]*[\p{L}\p{N}_])?"
#: Words that say nothing in a question.
STOPWORDS = ["the", "a", "an", "is", "are", "was", "were", "of", "in", "on", "at", "to", "for", "with", "by", "from", "and", "or", "not", "that", "this", "it", "its", "be", "has", "have", "had", "what", "who", "how", "why", "when", "which", "did", "does", "between", "about", "any", "all", "as"]
#: Legal forms that are dropped from names of organizations, in this order.
SUFFIXES = [" pvt. ltd.", " pvt ltd", " ltd.", " ltd", " llp", " inc.", " corp.", " limited"]
#: Lines that open a title, a section, a subsection or an item.
TITLE = r"(?i)^(IN THE (HON'?BLE |HONOURABLE )?(.+COURT|TRIBUNAL)|WRIT PETITION|CIVIL APPEAL|SPECIAL LEAVE PETITION|PETITION UNDER|BETWEEN\s*:?$)"
SECTION = r"(?i)^(FACTS|BACKGROUND FACTS?|BRIEF FACTS?|GROUNDS?|PRAYERS?|RELIEF(S)? SOUGHT|SYNOPSIS|LIST OF DATES|INDEX|ANNEXURES?|AFFIDAVIT|SUBMISSIONS?|ARGUMENTS?|ORDERS?|JUDGMENT|WHEREAS|NOW THEREFORE)\s*:?\s*$"
SUBSECTION = r"^(\([A-Z]\)\s+\S|\d+\.\s+[A-Z]|[IVX]+\.\s+[A-Z]|(?i:CLAUSE|SECTION|ARTICLE)\s+\d+)"
ITEM = r"^(\([a-z]\)\s+\S|\([ivxlc]+\)\s+\S|\d+\.\d+\s+\S)"
#: Lines that open a section of pages.
PAGE_SECTION = r"^(\d+\.\s+[A-Z][A-Za-z\s]+$|[A-Z][A-Z\s]{5,}$|\([A-Za-z]\)\s+[A-Z]|WHEREAS|NOW THEREFORE|IN THE.*COURT|PRAYERS?|FACTS|GROUNDS?)"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^[{SPACE}]+|[{SPACE}]+$", "")


def lines(c: Column) -> Column:
    return F.split(c, "\n", -1)


def words(c: Column) -> Column:
    """Runs of characters that are not white space; an empty list for blank or null text."""
    return F.coalesce(F.filter(F.split(c, f"[{SPACE}]+", -1), lambda w: w != ""), F.array().cast("array<string>"))


def clean_text(c: Column) -> Column:
    """LF line ends, words joined over a hyphen, blank lines collapsed, lines and text stripped."""
    c = F.regexp_replace(F.regexp_replace(c, "\r\n", "\n"), r"-\n([\p{L}\p{N}_])", "$1")
    return strip(F.array_join(F.transform(lines(F.regexp_replace(c, "\n{3,}", "\n\n")), strip), "\n"))


def heading_level(line: Column) -> Column:
    """1 to 4 for lines of legal texts that are headings, 0 for others; null stays null."""
    s = strip(line)
    n = F.size(words(s))
    shout = (F.upper(s) == s) & (F.lower(s) != s) & n.between(2, 8) & ~F.substring(s, 1, 3).rlike(r"\p{N}")
    return F.when(line.isNull(), None).when(s.rlike(TITLE), 1).when(s.rlike(SECTION), 2).when(shout, 2).when(s.rlike(SUBSECTION), 3).when(s.rlike(ITEM), 4).otherwise(0)


def markdown_line(line: Column) -> Column:
    level = heading_level(line)
    return F.when(level > 0, F.concat(F.repeat(F.lit("#"), level), F.lit(" "), strip(line))).otherwise(strip(line))


def to_markdown(c: Column) -> Column:
    return F.array_join(F.transform(lines(c), markdown_line), "\n")


def search_tokens(c: Column) -> Column:
    """Lower-case tokens of more than one character, in order, repeats kept."""
    return F.coalesce(F.filter(F.regexp_extract_all(F.lower(c), F.lit(TOKEN), F.lit(0)), lambda t: F.length(t) > 1), F.array().cast("array<string>"))


def name_tokens(c: Column) -> Column:
    """Distinct tokens of a name or question: stop words and short ones dropped, marks stripped after."""
    kept = F.filter(words(F.translate(F.lower(c), "_", " ")), lambda t: (F.length(t) > 2) & ~t.isin(STOPWORDS))
    return F.array_distinct(F.transform(kept, lambda t: F.regexp_replace(t, r"^[.,;:\"'()-]+|[.,;:\"'()-]+$", "")))


def canonical_name(text: Column, kind: Column) -> Column:
    """Lower case, legal forms of organizations removed, marks dropped, words joined by _."""
    name = strip(F.lower(text))
    bare = name
    for suffix in SUFFIXES:
        bare = F.replace(bare, F.lit(suffix), F.lit(""))
    name = F.when(kind == "Organization", bare).otherwise(name)
    return F.when(text.isNotNull(), F.array_join(words(F.translate(name, ",.'", "")), "_"))


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9_]", "_"), "_+", "_"), "^_|_$", "")


def relation_type(c: Column) -> Column:
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace(strip(F.upper(c)), r"[^\p{L}\p{N}_]", "_"), "_+", "_"), "^_|_$", "")
    return F.when(c.isNull() | (t == ""), "RELATED_TO").when(t.rlike(r"^\p{Nd}"), F.concat(F.lit("REL_"), t)).otherwise(t)


def chunks(c: Column, size: int = 300, overlap: int = 30) -> Column:
    """array<struct<chunk_no, words>>: windows of words with a fixed stride, the last ends the text."""
    w = words(c)
    n = F.greatest(F.lit(1), F.ceil((F.size(w) - overlap) / (size - overlap)).cast("int"))
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(i.alias("chunk_no"), F.slice(w, i * (size - overlap) + 1, F.lit(size)).alias("words")))


def snippet(text: Column, at: Column, length: Column, around: int = 50) -> Column:
    """The characters around a place, line breaks as spaces."""
    begin = F.greatest(F.lit(0), at - 1 - around)
    return F.regexp_replace(F.substring(text, begin + 1, at - 1 + length + around - begin), "\n", " ")
