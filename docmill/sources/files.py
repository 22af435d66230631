"""File sources: binary files dispatched by extension to text with a page count.

Every file gives one row; what cannot be read gives its row with an error and no text.
"""

from __future__ import annotations

import email
import email.policy
import html.parser
import io
import re
import struct
import zipfile
from collections.abc import Callable, Iterator
from pathlib import PurePosixPath
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.functions import text as T
from docmill.operators import pages

WORDS_A_PAGE = 300
#: A file of more bytes is not read in one piece; its row says so.
LARGEST = 512 << 20
SCHEMA = "path string, filename string, file_type string, markdown_text string, page_count int, warnings array<string>, error string"


def pages_by_words(text: str) -> int:
    return max(1, len(text.split()) // WORDS_A_PAGE)


def decode(data: bytes) -> str:
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return data.decode("latin-1")


def read_text(name: str, data: bytes) -> tuple[str, int, list[str]]:
    body = decode(data)
    return f"# {PurePosixPath(name).stem}\n\n{body}", pages_by_words(body), []


def read_email(name: str, data: bytes) -> tuple[str, int, list[str]]:
    message = email.message_from_bytes(data, policy=email.policy.default)
    head = [f"**{k}:** {message[k]}" for k in ("From", "To", "Cc", "Date", "Subject") if message[k]]
    parts = [p.get_content() for p in message.walk() if p.get_content_type() == "text/plain" and not p.is_multipart()]
    return "\n".join([f"# {message['Subject'] or PurePosixPath(name).stem}", "", *head, "", "## Email Body", "", *(p.strip() for p in parts)]), 1, [] if parts else ["no plain text part"]


def read_docx(name: str, data: bytes) -> tuple[str, int, list[str]]:
    space = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml")).find(f"{space}body")
    out, tables, page = ["<!-- page:1 -->"], [], 1
    for block in body if body is not None else []:
        if block.tag == f"{space}tbl":  # tables come after the text
            for row in block.iter(f"{space}tr"):
                tables.append(" | ".join("".join(t.text or "" for t in cell.iter(f"{space}t")) for cell in row.iter(f"{space}tc")))
            continue
        breaks = sum(b.get(f"{space}type") == "page" for b in block.iter(f"{space}br")) + len(list(block.iter(f"{space}lastRenderedPageBreak")))
        for _ in range(breaks):
            page += 1
            out.append(f"<!-- page:{page} -->")
        style = next((s.get(f"{space}val", "") for s in block.iter(f"{space}pStyle")), "")
        text = "".join(t.text or "" for t in block.iter(f"{space}t")).strip()
        level = re.fullmatch(r"(?:Heading|heading )(\d)", style)
        if text:
            out.append(f"{'#' * min(4, int(level.group(1)))} {text}" if level else f"# {text}" if style == "Title" else text)
    made = "\n\n".join([*out, *tables])
    return made, page if page > 1 else pages_by_words(made), []


class _Html(html.parser.HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.out: list[str] = []
        self.skip = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("script", "style"):
            self.skip += 1
        elif re.fullmatch(r"h[1-4]", tag):
            self.out.append("\n\n" + "#" * int(tag[1]) + " ")
        elif tag in ("p", "div", "li", "tr", "br"):
            self.out.append("\n")

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style"):
            self.skip -= 1
        elif re.fullmatch(r"h[1-4]|p|div", tag):
            self.out.append("\n")

    def handle_data(self, data: str) -> None:
        if not self.skip:
            self.out.append(data)


def read_html(name: str, data: bytes) -> tuple[str, int, list[str]]:
    parser = _Html()
    parser.feed(decode(data))
    text = re.sub(r"\n{3,}", "\n\n", "".join(parser.out)).strip()
    return text, pages_by_words(text), []


#: Fixed value: an image with fewer pixels in width or height is too coarse to be read well.
COARSE = (800, 600)


def image_size(data: bytes) -> tuple[int, int] | None:
    """(width, height) from the head of a PNG, GIF, BMP or JPEG; None for others."""
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        return struct.unpack(">II", data[16:24])
    if data[:6] in (b"GIF87a", b"GIF89a") and len(data) >= 10:
        return struct.unpack("<HH", data[6:10])
    if data[:2] == b"BM" and len(data) >= 26:
        width, height = struct.unpack("<ii", data[18:26])
        return width, abs(height)
    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 9 < len(data) and data[at] == 0xFF:
            if data[at + 1] in (0xC0, 0xC1, 0xC2):
                height, width = struct.unpack(">HH", data[at + 5 : at + 9])
                return width, height
            at += 2 + int.from_bytes(data[at + 2 : at + 4], "big")
    return None


def image_reader(read: Callable[[bytes], str]) -> Callable[[str, bytes], tuple[str, int, list[str]]]:
    """A reader of images from one of characters, with warnings where the image is coarse or nothing was read."""

    def run(name: str, data: bytes) -> tuple[str, int, list[str]]:
        size, text = image_size(data), read(data).strip()
        coarse = size is not None and (size[0] < COARSE[0] or size[1] < COARSE[1])
        return f"# {PurePosixPath(name).stem}\n\n{text}", 1, [*(["low resolution"] if coarse else []), *([] if text else ["no text found"])]

    return run


def page_rows(files: DataFrame, parse: Callable[[bytes], list[tuple[str, list[str], bytes | None]]], read: Callable[[bytes], str] | None = None) -> DataFrame:
    """files(path, content) -> (path, page, text, tables, read, error), a row for each page.

    parse gives (text, table rows, image) of each page; read reads the characters of the image of
    a page with too little text.  A file that cannot be parsed gives one row with its error, a page
    that cannot be read keeps its text.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, data in zip(batch["path"], batch["content"], strict=True):
                try:
                    found = parse(bytes(data))
                except Exception as why:  # noqa: BLE001
                    rows.append((path, None, None, [], None, f"{type(why).__name__}: {why}"))
                    continue
                for k, (text, table, image) in enumerate(found, 1):
                    seen, error = None, None
                    if read is not None and image is not None and len(text.split()) < pages.DIGITAL_WORDS:
                        try:
                            seen = read(image)
                        except Exception as why:  # noqa: BLE001
                            error = f"{type(why).__name__}: {why}"
                    rows.append((path, k, text, table, seen, error))
            yield pd.DataFrame(rows, columns=["path", "page", "text", "tables", "read", "error"]).astype({"page": "Int32"})

    return files.select("path", "content").mapInPandas(run, "path string, page int, text string, tables array<string>, read string, error string")


def paged_markdown(rows: DataFrame) -> DataFrame:
    """page_rows -> (path, markdown, pages): cleaned, the better reading of short pages, tables under their page, headings, joined under page markers."""
    kept = rows.where("page is not null")
    text = pages.choose(T.clean_text(F.col("text")), T.clean_text(F.col("read")))
    return pages.join_pages(kept.select("path", "page", T.to_markdown(pages.with_table(text, F.col("tables"))).alias("text")), ["path"], "page", "text")


Reader = Callable[[str, bytes], tuple[str, int, list[str]]]
READERS: dict[str, Reader] = {".txt": read_text, ".md": read_text, ".eml": read_email, ".docx": read_docx, ".html": read_html, ".htm": read_html}
#: Known types whose readers (page images, character recognition) must be supplied.
PROVIDED = [".pdf", ".doc", ".msg", ".png", ".jpg", ".jpeg", ".tif", ".tiff", ".bmp", ".webp"]


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def is_supported(path: Column) -> Column:
    return extension(path).isin([*READERS, *PROVIDED])


def extract(files: DataFrame, readers: dict[str, Reader] | None = None) -> DataFrame:
    """files(path, content) -> SCHEMA; a failure stays with its file."""
    known = READERS | (readers or {})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, data in zip(batch["path"], batch["content"], strict=True):
                name = PurePosixPath(path).name
                kind = PurePosixPath(name).suffix.lower()
                try:
                    if len(data) > LARGEST:
                        raise ValueError(f"more than {LARGEST} bytes")
                    if kind not in known:
                        raise ValueError(f"no reader for {kind or 'files without extension'}")
                    text, n, warnings = known[kind](name, bytes(data))
                    rows.append((path, name, kind, text, n, warnings, None))
                except Exception as why:  # noqa: BLE001
                    rows.append((path, name, kind, None, None, [], f"{type(why).__name__}: {why}"))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")]).astype({"page_count": "Int32"})

    return files.select("path", "content").mapInPandas(run, SCHEMA)


def read_folder(spark: SparkSession, folder: str, pattern: str = "*", readers: dict[str, Reader] | None = None) -> DataFrame:
    return extract(spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder), readers)
