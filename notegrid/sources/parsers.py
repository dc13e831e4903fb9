"""Decoders of document formats: bytes of a file to one note record.

They run inside Python workers. Office formats are zip files of XML and need no
library; PDF and old HWP files need an optional one and give an error without it.
"""

from __future__ import annotations

import hashlib
import io
import json
import re
import zipfile
from collections.abc import Callable
from datetime import date, datetime
from pathlib import PurePosixPath
from xml.etree import ElementTree

_FRONT = re.compile(r"^---\s*\n(.*?)\n---\s*(?:\n|$)", re.DOTALL)
_FRONT_LOOSE = re.compile(r"^---\s*\n(.*?)\n---", re.DOTALL)
_LINK = re.compile(r"\[\[([^\]|#]+?)(?:#[^\]|]*)?(?:\|[^\]]+?)?\]\]")
_TAG = re.compile(r"(?:^|\s)#([a-zA-Z가-힣][a-zA-Z0-9가-힣_/-]*)", re.MULTILINE)
_NUMBERED = re.compile(r"^(?:\d+(?:\.\d+)*[.)]?|[가-하]\.|제\s*\d+\s*[장절조])\s+\S")


def decode(data: bytes, *encodings: str) -> str:
    """The text in the first encoding that fits; ValueError if none does."""
    for encoding in encodings or ("utf-8", "cp949"):
        try:
            return data.decode(encoding)
        except UnicodeDecodeError:
            continue
    raise ValueError("the encoding isn't known")


def load_yaml(text: str) -> dict:
    """The mapping of a frontmatter; anything else, and broken YAML, is an empty one."""
    try:
        import yaml
    except ImportError:
        pairs = (line.partition(":") for line in text.splitlines() if ":" in line and not line.startswith((" ", "-", "#")))
        return {k.strip(): v.strip().strip("\"'") or None for k, _, v in pairs}
    try:
        found = yaml.safe_load(text)
    except yaml.YAMLError:
        return {}
    return found if isinstance(found, dict) else {}


def _plain(value):
    if isinstance(value, (datetime, date)):
        return value.isoformat()
    if isinstance(value, dict):
        return {str(k): _plain(v) for k, v in value.items()}
    return [_plain(v) for v in value] if isinstance(value, (list, tuple, set)) else value


def _tags(front: dict, body: str) -> list[str]:
    typed = front.get("tags") or []
    typed = typed.split(",") if isinstance(typed, str) else typed if isinstance(typed, list) else []
    own = {str(t).strip().lstrip("#") for t in typed if t is not None}
    return sorted((own | {t for t in _TAG.findall(body) if len(t) > 1}) - {""})


def _record(content: str, front: dict, body: str, headings: list[str]) -> dict:
    links = dict.fromkeys(x.strip() for x in _LINK.findall(body))
    return {
        "content": content, "body": body, "frontmatter": json.dumps(_plain(front), ensure_ascii=False), "wiki_links": [x for x in links if x],
        "tags": _tags(front, body), "headings": headings, "checksum": hashlib.sha256(content.encode("utf-8", "surrogatepass")).hexdigest()[:16],
    }


def parse_markdown(data: bytes, path: str) -> dict:
    text = decode(data)
    match = _FRONT.match(text) or _FRONT_LOOSE.match(text)
    front, body = (load_yaml(match[1]), text[match.end() :]) if match else ({}, text)
    lines = (line.strip() for line in body.split("\n"))
    heads = [s.lstrip("#").strip() for s in lines if s.startswith("#") and " " in s and len(s) - len(s.lstrip("#")) <= 4]
    return _record(text, front, body, [h for h in heads if h])


def _external(title: str, kind: str, **more) -> dict:
    return {"title": title, "type": "source", "tags": [kind, "external"], "format": kind, **{k: v for k, v in more.items() if v}}


def parse_text(data: bytes, path: str) -> dict:
    """Headings are short lines between blank ones; the title is the first line."""
    text = decode(data, "utf-8", "cp949", "latin-1")
    lines = [s.strip() for s in text.split("\n")]
    heads = [
        s for i, s in enumerate(lines)
        if s and len(s) < 100 and (i == 0 or not lines[i - 1]) and i + 1 < len(lines) and not lines[i + 1]
    ]
    title = next((s[:80] for s in lines if s), PurePosixPath(path).stem)
    return _record(text, _external(title, "txt"), text, heads[:30])


def _xml(archive: zipfile.ZipFile, name: str):
    return ElementTree.fromstring(archive.read(name))


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _all(node, name: str):
    return (x for x in node.iter() if _local(x.tag) == name)


def _core(archive: zipfile.ZipFile) -> dict:
    if "docProps/core.xml" not in archive.namelist():
        return {}
    return {_local(x.tag): x.text for x in _xml(archive, "docProps/core.xml") if x.text}


def _texts(node) -> str:
    return "".join(x.text or "" for x in _all(node, "t"))


def parse_docx(data: bytes, path: str) -> dict:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body, core = next(_all(_xml(z, "word/document.xml"), "body")), _core(z)
    parts, heads = [], []
    for block in body:
        if _local(block.tag) == "p":
            text = _texts(block).strip()
            style = next((v for x in _all(block, "pStyle") for k, v in x.attrib.items() if _local(k) == "val"), "")
            if text and style.lower().startswith("heading"):
                heads.append(text)
            if text:
                parts.append(text)
        elif _local(block.tag) == "tbl":
            parts += [" | ".join(_texts(c).strip() for c in _all(row, "tc")) for row in _all(block, "tr")]
    text = "\n\n".join(parts)
    return _record(text, _external(core.get("title") or PurePosixPath(path).stem, "docx", author=core.get("creator")), text, heads)


def parse_xlsx(data: bytes, path: str) -> dict:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names, core = z.namelist(), _core(z)
        shared = [_texts(s) for s in _all(_xml(z, "xl/sharedStrings.xml"), "si")] if "xl/sharedStrings.xml" in names else []
        titles = [x.get("name") for x in _all(_xml(z, "xl/workbook.xml"), "sheet")]
        files = sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
        parts = []
        for title, name in zip(titles, files):
            parts.append(f"## {title}")
            for row in _all(_xml(z, name), "row"):
                cells = []
                for c in _all(row, "c"):
                    value = next((v.text or "" for v in _all(c, "v")), _texts(c))
                    cells.append(shared[int(value)] if c.get("t") == "s" and value else value)
                if any(cells):
                    parts.append(" | ".join(x for x in cells if x))
    text = "\n".join(parts)
    return _record(text, _external(core.get("title") or PurePosixPath(path).stem, "xlsx", author=core.get("creator")), text, titles)


def parse_pptx(data: bytes, path: str) -> dict:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        core = _core(z)
        number = lambda n: int(re.search(r"(\d+)\.xml$", n)[1])
        slides = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=number)
        parts, heads = [], []
        for i, name in enumerate(slides, 1):
            lines = [t for p in _all(_xml(z, name), "p") if (t := _texts(p).strip())]
            head = f"Slide {i}: {lines[0]}" if lines else f"Slide {i}"
            heads.append(head)
            parts += [f"## {head}", *lines[1:]]
            notes = f"ppt/notesSlides/notesSlide{number(name)}.xml"
            if notes in z.namelist() and (said := _texts(_xml(z, notes)).strip()):
                parts.append(f"Notes: {said}")
    text = "\n".join(parts)
    front = _external(core.get("title") or PurePosixPath(path).stem, "pptx", author=core.get("creator"), slide_count=len(slides))
    return _record(text, front, text, heads)


def numbered_headings(text: str) -> list[str]:
    found = (line.strip()[:80] for line in text.split("\n") if _NUMBERED.match(line.strip()))
    return list(dict.fromkeys(found))[:10]


def parse_hwpx(data: bytes, path: str) -> dict:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        if "Preview/PrvText.txt" in z.namelist():
            text = decode(z.read("Preview/PrvText.txt"), "utf-8", "utf-16", "cp949")
        else:
            sections = sorted(n for n in z.namelist() if re.fullmatch(r"Contents/section\d+\.xml", n))
            text = "\n".join(x.text for n in sections for x in _all(_xml(z, n), "t") if x.text)
    return _record(text, _external(PurePosixPath(path).stem, "hwpx"), text, numbered_headings(text))


def parse_hwp(data: bytes, path: str) -> dict:
    try:
        import olefile
    except ImportError as e:
        raise ValueError("HWP files need olefile") from e
    with olefile.OleFileIO(io.BytesIO(data)) as ole:
        if not ole.exists("PrvText"):
            raise ValueError("no text preview")
        text = ole.openstream("PrvText").read().decode("utf-16-le", "replace")
        meta = ole.get_metadata()
    front = _external(PurePosixPath(path).stem, "hwp", author=meta.author.decode("utf-8", "replace") if meta.author else None)
    return _record(text, front, text, numbered_headings(text))


def pdf_day(value: str | None) -> str | None:
    """The day of a PDF date such as D:20240102030405."""
    match = re.match(r"(?:D:)?(\d{4})(\d{2})(\d{2})", value or "")
    return "-".join(match.groups()) if match else None


def parse_pdf(data: bytes, path: str) -> dict:
    try:
        import pypdf
    except ImportError as e:
        raise ValueError("PDF files need pypdf") from e
    reader = pypdf.PdfReader(io.BytesIO(data))
    text = "\n\n".join(page.extract_text() or "" for page in reader.pages)
    meta = reader.metadata or {}
    lines = (s.strip() for s in text.split("\n"))
    heads = [s for s in lines if 0 < len(s) < 120 and len(s.split()) <= 12 and (s.isupper() or s.istitle())]
    front = _external(meta.get("/Title") or PurePosixPath(path).stem, "pdf", author=meta.get("/Author"), created=pdf_day(meta.get("/CreationDate")))
    return _record(text, front, text, heads[:30])


PARSERS: dict[str, Callable[[bytes, str], dict]] = {
    ".md": parse_markdown, ".txt": parse_text, ".docx": parse_docx, ".xlsx": parse_xlsx, ".pptx": parse_pptx, ".hwpx": parse_hwpx, ".hwp": parse_hwp, ".pdf": parse_pdf,
}


def parse_document(data: bytes, path: str) -> dict:
    """The record of a file by its suffix; ValueError for an unknown or broken one."""
    parser = PARSERS.get(PurePosixPath(path).suffix.lower())
    if parser is None:
        raise ValueError(f"no parser for {path}")
    try:
        return parser(data, path)
    except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, StopIteration) as e:
        raise ValueError(f"{path} is broken: {e}") from e
