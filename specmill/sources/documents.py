"""Documents as fragments of text with page, sheet or section: text, HTML, DOCX, XLSX, RTF and simple PDF, read from binary files."""

from __future__ import annotations

import io
import re
import struct
import zipfile
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from html.parser import HTMLParser
from xml.etree import ElementTree
from xml.sax.saxutils import unescape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import agreed_kind

MOST_BYTES, MOST_PAGES = 10 << 20, 200
SCHEMA = "path string, kind string, page int, sheet string, section string, text string, error string"
_W, _S = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}", "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_ID = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
MOST_COLUMNS = 16_384
# cells without attributes but reference and type, and without shared strings; what XML refuses or changes in a text is in no plain one
_TEXT = "[^<\x00-\x08\x0b-\x1f\ufffe\uffff]*+"
_CELL = rf"""<c(?: r="(G[A-Z]{{1,3}}+)[0-9]++")?+(?: t="(?:inlineStr|str|n)")?+(?:/>|><v>(G{_TEXT})</v></c>|><is><t(?: xml:space="preserve")?+>(G{_TEXT})</t></is></c>)"""
_PLAIN_CELL, _WHOLE_CELL = re.compile(_CELL.replace("(G", "(")), _CELL.replace("(G", "(?:")
_PLAIN_SHEET = re.compile(rf"""(?:<\?xml version="1\.0" encoding="UTF-8"\?>)?+<worksheet xmlns="{re.escape(_S[1:-1])}"><sheetData>(?:<row(?: r="[0-9]++")?+>(?:{_WHOLE_CELL})*+</row>)*+</sheetData></worksheet>""")
_OTHER_ENTITY, _QUOTES = re.compile("&(?!(?:amp|lt|gt|quot|apos);)"), {"&quot;": '"', "&apos;": "'"}
_CONTROL = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f]")
Fragment = tuple[int | None, str | None, str | None, str]


def decode_strict(content: bytes, charset: str = "utf-8") -> str:
    """SRC-5: decodes or fails; control characters are refused, form feeds apart."""
    text = content.decode(charset)
    if _CONTROL.search(text.replace("\f", "")):
        raise ValueError("control characters")
    return text


def _xml(data: bytes) -> ElementTree.Element:
    if b"<!DOCTYPE" in data[:4096] or b"<!ENTITY" in data:
        raise ValueError("document type declarations are refused")
    return ElementTree.fromstring(data)


def _entry(z: zipfile.ZipFile, name: str) -> bytes:
    if z.getinfo(name).file_size > 8 * MOST_BYTES:
        raise ValueError("archive entry too large")
    return z.read(name)


def read_docx(content: bytes) -> list[Fragment]:
    """SRC-2b: parts begin at paragraphs of a heading style; cells of a table row are joined by tabs."""
    out: list[tuple[str | None, list[str]]] = [(None, [])]
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = _xml(_entry(z, "word/document.xml")).find(f"{_W}body")
    said = lambda e: "".join(t.text or "" for t in e.iter(f"{_W}t"))
    for e in body if body is not None else []:
        if e.tag == f"{_W}p":
            style = e.find(f"{_W}pPr/{_W}pStyle")
            if style is not None and style.get(f"{_W}val", "").lower().startswith("heading"):
                out.append((said(e), []))
            elif said(e).strip():
                out[-1][1].append(said(e))
        elif e.tag == f"{_W}tbl":
            out[-1][1].extend("\t".join(said(c) for c in row.iter(f"{_W}tc")) for row in e.iter(f"{_W}tr"))
    return [(None, None, title, "\n".join(lines)) for title, lines in out if lines or title]


def _column(reference: str) -> int:
    """Number of a cell's column from 0; -1 if the cell has no reference."""
    n = 0
    for letter in reference.rstrip("0123456789"):
        n = 26 * n + ord(letter) - 64
    return n - 1


def _entries(content: bytes) -> Callable[[str], bytes | None]:
    """The entry of a name, or None. Of plain archives the directory is read here, which takes far less time for small ones; ``zipfile`` reads, or refuses, everything else."""
    z: zipfile.ZipFile | None = None
    end, found = len(content) - 22, {}
    if end >= 0 and content[end : end + 4] == b"PK\5\6":
        disk, first, here, total, size, at, comment = struct.unpack_from("<4H2LH", content, end + 4)
        if (disk, first, comment) == (0, 0, 0) and here == total < 0xFFFF and at + size == end:
            for _ in range(total):
                if at + 46 > end or content[at : at + 4] != b"PK\1\2":
                    break
                flags, method, crc, packed, whole, n, extra, note, start = struct.unpack_from("<2H4x3L3H8xL", content, at + 8)
                name = content[at + 46 : at + 46 + n]
                found[name] = (flags, method, crc, packed, whole, start, extra)
                at += 46 + n + extra + note
            if at != end or len(found) != total or not all(k.isascii() and 0 not in k for k in found):
                found = {}

    def plain(name: bytes) -> bytes | None:
        flags, method, crc, packed, whole, start, extra = found[name]
        begin = start + 30 + len(name)
        if flags & ~0x808 or method not in (0, 8) or extra or 0xFFFFFFFF in (packed, whole, start) or content[start : start + 4] != b"PK\3\4" or content[start + 30 : begin] != name or len(content) < begin:
            return None
        own, more = struct.unpack_from("<2H", content, start + 26)
        data = content[begin + more : begin + more + packed]
        if own != len(name) or begin + more + packed > end:
            return None
        if method == 8:
            d = zlib.decompressobj(-15)
            data = d.decompress(data, whole + 1)
            if not d.eof or d.unused_data:
                return None
        return data if len(data) == whole and zlib.crc32(data) == crc else None

    def read(name: str) -> bytes | None:
        nonlocal z
        if found and name.isascii():
            key = name.encode()
            if key not in found:
                return None
            data = plain(key) if found[key][4] <= 8 * MOST_BYTES else None
            if data is not None:
                return data
        z = z or zipfile.ZipFile(io.BytesIO(content))
        return _entry(z, name) if name in z.NameToInfo else None

    if not found:
        z = zipfile.ZipFile(io.BytesIO(content))
    return read


def _needed(entry: bytes | None, name: str) -> bytes:
    if entry is None:
        raise KeyError(f"There is no item named {name!r} in the archive")
    return entry


def _sheets(workbook: bytes, relations: bytes | None) -> list[tuple[str | None, str | None]]:
    """Names of sheets with the targets that their relations tell."""
    targets = {r.get("Id"): r.get("Target", "") for r in _xml(relations)} if relations is not None else {}
    return [(s.get("name"), targets.get(s.get(_ID))) for s in _xml(workbook).iter(f"{_S}sheet")]


#: Files that one program wrote mostly agree in these small entries.
_sheets_again = lru_cache(256)(_sheets)
_LETTERS = [chr(65 + k) for k in range(26)]


def _plain_rows(sheet: bytes) -> list[list[str]] | None:
    """Cells of a sheet that is written in the plainest way, which takes a fifth of the time of a parser; None for all others."""
    try:
        text = sheet.decode("utf-8")
    except UnicodeDecodeError:
        return None
    if "]]>" in text or not _PLAIN_SHEET.fullmatch(text) or ("&" in text and _OTHER_ENTITY.search(text)):
        return None
    out = []
    for row in text.split("</row>")[:-1]:
        found = _PLAIN_CELL.findall(row)
        cells = [value or inline for _, value, inline in found]
        if [letters for letters, _, _ in found] != _LETTERS[: len(found)]:
            cells = []
            for letters, value, inline in found:
                cells += [""] * min(_column(letters) - len(cells), MOST_COLUMNS)
                cells.append(value or inline)
        out.append([unescape(x, _QUOTES) if "&" in x else x for x in cells] if "&" in row else cells)
    return out


def _parsed_rows(sheet: bytes, shared: list[str]) -> Iterator[list[str]]:
    for row in _xml(sheet).iter(f"{_S}row"):
        cells: list[str] = []
        for c in row.iter(f"{_S}c"):
            # files leave empty cells out: the reference tells the column
            cells += [""] * min(_column(c.get("r", "")) - len(cells), MOST_COLUMNS)
            v, inline = c.find(f"{_S}v"), c.find(f"{_S}is")
            text = "".join(t.text or "" for t in inline.iter(f"{_S}t")) if inline is not None else (v.text or "") if v is not None else ""
            cells.append(shared[int(text)] if c.get("t") == "s" and text else text)
        yield cells


def read_xlsx(content: bytes) -> list[Fragment]:
    """SRC-2d: one fragment a sheet; cells joined by tabs, rows by line breaks, blank rows dropped; stored values of formulas."""
    out, entry = [], _entries(content)
    strings = entry("xl/sharedStrings.xml")
    shared = ["".join(t.text or "" for t in s.iter(f"{_S}t")) for s in _xml(strings).iter(f"{_S}si")] if strings is not None else []
    relations, workbook = entry("xl/_rels/workbook.xml.rels"), _needed(entry("xl/workbook.xml"), "xl/workbook.xml")
    sheets = (_sheets_again if len(workbook) + len(relations or b"") < 4096 else _sheets)(workbook, relations)
    for k, (name, target) in enumerate(sheets):
        at = f"xl/worksheets/sheet{k + 1}.xml" if not target else target[1:] if target.startswith("/") else f"xl/{target}"
        sheet = _needed(entry(at), at)
        rows = _plain_rows(sheet)
        rows = _parsed_rows(sheet, shared) if rows is None else rows
        out.append((None, name, None, "\n".join("\t".join(cells) for cells in rows if any(x.strip() for x in cells))))
    return out


class _Sections(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[tuple[str | None, list[str]]] = [(None, [])]
        self.heading: list[str] | None = None
        self.hidden = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        label = dict(attrs).get("aria-label")
        if tag in ("script", "style", "noscript", "template"):
            self.hidden += 1
        elif re.fullmatch("h[1-6]", tag):
            self.heading = []
        elif tag in ("section", "article", "main", "nav", "aside") and label:
            self.parts.append((label, []))

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style", "noscript", "template"):
            self.hidden = max(0, self.hidden - 1)
        elif re.fullmatch("h[1-6]", tag) and self.heading is not None:
            self.parts.append((" ".join("".join(self.heading).split()), []))
            self.heading = None

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            (self.heading if self.heading is not None else self.parts[-1][1]).append(data)


def read_html(content: bytes) -> list[Fragment]:
    """SRC-2f: headings and labelled regions begin a section."""
    parser = _Sections()
    parser.feed(decode_strict(content))
    parser.close()
    return [(None, None, title, " ".join("".join(lines).split())) for title, lines in parser.parts if title or "".join(lines).strip()]


def read_rtf(content: bytes) -> list[Fragment]:
    """SRC-2c for RTF: plain text without groups of fonts, colours and styles."""
    text = re.sub(r"\{\\(?:fonttbl|colortbl|stylesheet|info|\*)[^{}]*(?:\{[^{}]*\}[^{}]*)*\}", "", content.decode("latin-1"))
    text = re.sub(r"\\'([0-9a-fA-F]{2})", lambda m: bytes([int(m[1], 16)]).decode("cp1252", "replace"), text)
    text = re.sub(r"\\(?:par|line)\b ?", "\n", text)
    return [(None, None, None, re.sub(r"\\[a-z]+-?\d* ?|[{}]", "", text).strip())]


def read_pdf(content: bytes) -> list[Fragment]:
    """SRC-2a for PDFs of plain text operators: one fragment a content stream; encrypted files are refused and decoded sizes limited."""
    if b"/Encrypt" in content:
        raise ValueError("encrypted")
    out, size = [], 0
    for m in re.finditer(rb"<<(.*?)>>\s*stream\r?\n(.*?)\r?\nendstream", content, re.S):
        data = m[2]
        if b"/FlateDecode" in m[1]:
            d = zlib.decompressobj()
            data = d.decompress(data, 4 * MOST_BYTES)
            if d.unconsumed_tail:
                raise ValueError("stream too large")
        size += len(data)
        if size > 8 * MOST_BYTES:
            raise ValueError("document too large")
        if b"BT" not in data:
            continue
        lines: list[str] = []
        for t in re.finditer(rb"\(((?:\\.|[^\\()])*)\)\s*(?:Tj|'|\")|\[((?:\((?:\\.|[^\\()])*\)|[^\]])*)\]\s*TJ", data, re.S):
            raw = t[1] if t[1] is not None else b"".join(re.findall(rb"\(((?:\\.|[^\\()])*)\)", t[2]))
            lines.append(re.sub(rb"\\([()\\])", rb"\1", raw).decode("latin-1"))
        out.append((len(out) + 1, None, None, "\n".join(lines)))
        if len(out) > MOST_PAGES:
            raise ValueError("too many pages")
    return out


def read_text(content: bytes) -> list[Fragment]:
    """SRC-2e: form feeds part pages."""
    pages = decode_strict(content).split("\f")
    return [(i + 1 if len(pages) > 1 else None, None, None, p) for i, p in enumerate(pages)]


READERS = {"TXT": read_text, "HTML": read_html, "DOCX": read_docx, "XLSX": read_xlsx, "RTF": read_rtf, "PDF": read_pdf}


def _batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for path, kind, content in zip(batch["path"], batch["kind"], batch["content"], strict=True):
            try:
                if content is None or len(content) > MOST_BYTES:
                    raise ValueError("too large")
                if kind not in READERS:
                    raise ValueError(f"no reader for {kind}")
                rows += [(path, kind, *f, None) for f in READERS[kind](bytes(content))]
            except Exception as e:  # one bad document is a row that says so, not a failed job
                rows.append((path, kind, None, None, None, None, f"{type(e).__name__}: {e}"))
        yield pd.DataFrame(rows, columns=["path", "kind", "page", "sheet", "section", "text", "error"]).astype({"page": "Int32"})


def fragments(files: DataFrame) -> DataFrame:
    """SRC-2: (path, media_type, content) as fragments; a document that cannot be read is one row with ``error``."""
    kind = agreed_kind(F.col("media_type"), F.col("path"), F.col("content"))
    return files.select("path", kind.alias("kind"), "content").mapInPandas(_batches, SCHEMA)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """SRC-1: files of a folder as fragments; the format is told by ending and first bytes."""
    return fragments(spark.read.format("binaryFile").load(path).select("path", F.lit(None).cast("string").alias("media_type"), "content"))
