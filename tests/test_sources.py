"""Scans and decoders of files."""

import io
import json
import zipfile

import pytest

from notegrid.sources import parsers, vault


def zipped(**files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name.replace("__", "/"), text)
    return out.getvalue()


def test_markdown_and_text():
    r = parsers.parse_document("---\ntitle: T\ntags: [test, '#s']\nday: 2024-01-02\n---\n# Head\n[[Link|x]] #inline".encode(), "/v/a.md")
    assert r["tags"] == ["inline", "s", "test"] and r["headings"] == ["Head"] and r["wiki_links"] == ["Link"] and len(r["checksum"]) == 16
    assert json.loads(r["frontmatter"])["day"] == "2024-01-02"
    assert parsers.parse_document(b"---\n: [\n---\nx", "a.md")["frontmatter"] == "{}"
    r = parsers.parse_document("First Line\n\nbody body\nmore\n\nSecond\n\nend".encode(), "a.txt")
    assert json.loads(r["frontmatter"])["title"] == "First Line" and r["headings"] == ["First Line", "Second"]
    assert "한글" in parsers.parse_document("한글".encode("cp949"), "a.txt")["body"]
    with pytest.raises(ValueError):
        parsers.parse_document(b"\xff\xfe" * 9, "a.md")
    with pytest.raises(ValueError):
        parsers.parse_document(b"", "a.exe")
    with pytest.raises(ValueError):
        parsers.parse_document(b"no zip", "a.docx")


def test_office_files():
    docx = zipped(**{"word__document.xml": '<d xmlns:w="w"><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>H</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:t>a</w:t></w:p></w:tc><w:tc><w:p><w:t>b</w:t></w:p></w:tc></w:tr></w:tbl></w:body></d>'})
    r = parsers.parse_document(docx, "a.docx")
    assert r["headings"] == ["H"] and r["body"] == "H\n\na | b"
    xlsx = zipped(**{"xl__workbook.xml": '<w><sheets><sheet name="S1"/></sheets></w>', "xl__sharedStrings.xml": "<s><si><t>x</t></si></s>", "xl__worksheets__sheet1.xml": '<w><row><c t="s"><v>0</v></c><c><v>5</v></c><c/></row></w>'})
    assert parsers.parse_document(xlsx, "a.xlsx")["body"] == "## S1\nx | 5"
    pptx = zipped(**{"ppt__slides__slide1.xml": "<s><p><t>Title</t></p><p><t>one</t></p></s>", "ppt__notesSlides__notesSlide1.xml": "<n><t>said</t></n>"})
    r = parsers.parse_document(pptx, "a.pptx")
    assert r["body"] == "## Slide 1: Title\none\nNotes: said" and json.loads(r["frontmatter"])["slide_count"] == 1
    hwpx = zipped(**{"Contents__section0.xml": "<s><t>1. Start</t><t>text</t></s>"})
    assert parsers.parse_document(hwpx, "a.hwpx")["headings"] == ["1. Start"]
    assert parsers.pdf_day("D:20240102030405") == "2024-01-02" and parsers.pdf_day(None) is None


def test_scan(spark, tmp_path, rows):
    for name, text in {"b.md": "[[a]]", "d/a.md": "x", "d/n.txt": "t\n", ".obsidian/z.md": "no", "bad.md": None}.items():
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_bytes(b"\xff\xfe\xff" if text is None else text.encode())
    got = vault.scan_vault(spark, str(tmp_path))
    assert rows(got, "key", "name", "ord") == [("b", "b", 1), ("d/a", "a", 2)]
    assert rows(vault.scan_vault(spark, str(tmp_path), (".md", ".txt")), "key") == [("b",), ("d/a",), ("d/n",)]
    with pytest.raises(FileNotFoundError):
        vault.scan_vault(spark, str(tmp_path / "none"))
    files = vault.scan_files(spark, str(tmp_path))
    ledger = files.select("path", files.modificationTime.alias("modified"))
    assert vault.new_files(files, ledger).count() == 0 and vault.new_files(files, ledger.limit(0)).count() == 3
    assert rows(vault.first_by_key(got.union(got), 1), "key") == [("b",)]


def test_search_results(spark, tmp_path, rows):
    (tmp_path / "topic.json").write_text(json.dumps({"web": {"results": [{"title": "T", "url": "u", "description": "d"}]}}))
    (tmp_path / "broken.json").write_text("{")
    spark.dataSource.register(vault.SearchResults)
    got = spark.read.format("search_results").option("folder", str(tmp_path)).load()
    assert rows(got) == [("topic", 0, "T", "u", "d", None)]
