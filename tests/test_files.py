"""Decoding, containers and arriving files."""

from __future__ import annotations

import datetime
import io
import zipfile

import pytest

from bookloom.sources import containers, decode
from bookloom.streaming import arrivals

TEXT = "第一章 渡船\n他把纜繩丟上岸，說：「走吧。」\n" * 20


@pytest.mark.parametrize(("codec", "mark", "want"), [
    ("utf-8", b"", "utf-8"), ("utf-8-sig", b"", "utf-8-sig"), ("utf-16-le", b"", "utf-16-le"), ("utf-16-be", b"", "utf-16-be"), ("utf-16", b"", "utf-16"),
    ("big5", b"", "big5"), ("ascii", b"", "utf-8")])
def test_detected(codec, mark, want):
    text = TEXT if codec != "ascii" else "plain words\n" * 9
    assert decode.detected(mark + text.encode(codec)) == want


def test_detected_edges():
    assert decode.detected(b"") == "utf-8"
    simplified = "第一章 渡船\n他把缆绳丢上岸，说：“走吧。”\n" * 20
    assert decode.detected(simplified.encode("gb18030")) == "gb18030"
    assert decode.detected(("界" * 60_000).encode()) == "utf-8"  # a character is cut at the sample's end


def test_decoded(spark):
    rows = [(1, TEXT.encode("big5")), (2, b"\xff\xfe" + "甲乙".encode("utf-16-le")), (3, None), (4, b"ok \xff")]
    got = {r.i: (r.text, r.n_damaged) for r in decode.decoded(spark.createDataFrame(rows, "i long, content binary")).collect()}
    assert got[1] == (TEXT, 0) and got[2] == ("甲乙", 0) and got[3] == ("", 0)


def docx(body: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        archive.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def test_docx():
    body = "<w:p><w:r><w:t>甲</w:t><w:tab/><w:t>乙</w:t></w:r></w:p><w:p/><w:p><w:del><w:r><w:t>gone</w:t></w:r></w:del><w:r><w:t>丙</w:t><w:br/><w:t>丁</w:t></w:r></w:p>"
    assert containers.docx_text(docx(body)) == "甲\t乙\n\n丙\n丁"


def test_loose_markup():
    """Unclosed tags, references, ruby, scripts; other encodings."""
    loose = "<html><head><title>t</title></head><body><h1>甲<br>乙</h1><p>一&nbsp;二 &#29368;<p>三<br/>四<script>x<y</script><ruby>字<rt>zi</ruby><div>五</body>"
    assert containers.markup_lines(loose.encode()) == ["甲 乙", f"一 二 {chr(29368)}", "三", "四字", "五"]
    assert containers.markup_lines("<?xml version='1.0' encoding='gb18030'?><p>中文</p>".encode("gb18030")) == ["中文"]


def test_epub_round_trip():
    sections = [("第1章 甲", ["一 & 二", "", "三\x00"]), ("", ["四"])]
    assert containers.epub_content(containers.epub_bytes("書", "人", sections)) == ("書", "人", "第1章 甲\n一 & 二\n三\n\n四")


def test_bad_files(spark):
    good = containers.epub_bytes("t", "a", [("h", ["x"])])
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(good)) as old, zipfile.ZipFile(out, "w") as new:
        for name in old.namelist():
            if not name.endswith("s0000.xhtml"):
                new.writestr(name, old.read(name))
    rows = [("a.epub", good), ("b.epub", out.getvalue()), ("c.docx", b"no zip"), ("d.docx", docx("<w:p><w:r><w:t>x</w:t></w:r></w:p>"))]
    got = {r.path: (r.text, r.error) for r in containers.read_files(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert got["a.epub"] == ("h\nx", None) and got["d.docx"] == ("x", None)
    assert "missing" in got["b.epub"][1] and "BadZipFile" in got["c.docx"][1]


def test_arrivals(spark, tmp_path):
    line = "buy at our nice shop today"
    rows = [(1, "\n".join([line, "a", line, "b", line]), datetime.datetime(2026, 1, 1))]
    spark.createDataFrame(rows, arrivals.SCHEMA).write.parquet(str(tmp_path / "in"))
    stream = arrivals.arrivals(spark, str(tmp_path / "in"))
    arrivals.write_repeated_lines(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert [(r.doc_id, r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [(1, 3)]
    assert arrivals.repeated_per_hour(stream).isStreaming
