from __future__ import annotations

import io
import zipfile

from docmill.session import checkpoint_dir
from docmill.sources import files
from docmill.streaming import ingest


def docx(paragraphs: list[str]) -> bytes:
    body = "".join(f"<w:p>{p}</w:p>" for p in paragraphs)
    xml = f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", xml)
    return out.getvalue()


def test_folder(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("één tekst".encode("latin-1"))
    (tmp_path / "b.eml").write_text("From: a@b.example\nTo: c@d.example\nSubject: Hello\nContent-Type: text/plain\n\nBody text\n")
    (tmp_path / "c.docx").write_bytes(docx(['<w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Head</w:t></w:r>', '<w:r><w:br w:type="page"/><w:t>After</w:t></w:r>']))
    (tmp_path / "d.html").write_text("<h1>T</h1><script>x</script><p>para</p>")
    (tmp_path / "e.pdf").write_bytes(b"%PDF")
    (tmp_path / "f.docx").write_bytes(b"broken")
    got = {r.filename: r for r in files.read_folder(spark, str(tmp_path)).collect()}
    assert got["a.txt"].markdown_text == "# a\n\néén tekst" and got["a.txt"].page_count == 1
    assert "## Email Body\n\nBody text" in got["b.eml"].markdown_text
    assert "## Head" in got["c.docx"].markdown_text and "<!-- page:2 -->" in got["c.docx"].markdown_text and got["c.docx"].page_count == 2
    assert got["d.html"].markdown_text.startswith("# T") and "x" not in got["d.html"].markdown_text.split("para")[0].replace("# T", "")
    assert got["e.pdf"].error and got["e.pdf"].markdown_text is None and got["f.docx"].error


def test_supplied_reader(spark, tmp_path):
    (tmp_path / "e.pdf").write_bytes(b"%PDF")
    r = files.read_folder(spark, str(tmp_path), readers={".pdf": lambda name, data: ("text", 3, [])}).first()
    assert (r.markdown_text, r.page_count, r.error) == ("text", 3, None)


def test_streaming_ingest(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.txt").write_text("one")
    query = ingest.into_table(ingest.watch_folder(spark, str(source)), str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination(60)
    (source / "b.txt").write_text("two")
    query = ingest.into_table(ingest.watch_folder(spark, str(source)), str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination(60)
    assert sorted(r.filename for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a.txt", "b.txt"]


def test_checkpoint_dir_is_set(spark):
    assert checkpoint_dir(spark) == checkpoint_dir(spark)


def test_pages_of_scanned_files(spark):
    made = [("a.pdf", b"one|two words"), ("b.pdf", b"broken")]

    def parse(data):
        if data == b"broken":
            raise ValueError("no pages")
        return [("short", ["x | y"], b"img"), ("", [], None), (" ".join(f"w{i}" for i in range(30)), ["w0 w1 | in text"], b"img")]

    rows = files.page_rows(spark.createDataFrame(made, "path string, content binary"), parse, lambda image: "what the image says is longer")
    got = {(r.path, r.page): r for r in rows.collect()}
    assert got["b.pdf", None].error == "ValueError: no pages" and got["a.pdf", 1].read == "what the image says is longer" and got["a.pdf", 3].read is None
    out = {r.path: r for r in files.paged_markdown(rows).collect()}
    assert out["a.pdf"].pages == 2 and out["a.pdf"].markdown.startswith("<!-- page:1 -->\nwhat the image says is longer\n\nx | y\n\n<!-- page:3 -->\nw0 w1")
    assert "b.pdf" not in out


def test_images_and_mails(spark):
    import struct

    png = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + struct.pack(">II", 640, 900)
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08" + struct.pack(">HH", 700, 1000) + b"\0" * 9
    assert files.image_size(png) == (640, 900) and files.image_size(jpeg) == (1000, 700) and files.image_size(b"other") is None
    read = files.image_reader(lambda data: "" if data == png else "text")
    assert read("scan.png", png) == ("# scan\n\n", 1, ["low resolution", "no text found"]) and read("s.jpg", jpeg)[2] == []
    df = spark.createDataFrame([("/x/a.msg", bytearray(b"\xd0\xcf\x11\xe0")), ("/x/b.png", bytearray(png))], "path string, content binary")
    got = {r.filename: r for r in files.extract(df, {".png": read}).collect()}
    assert got["a.msg"].error and got["a.msg"].markdown_text is None and got["b.png"].warnings == ["low resolution", "no text found"]
