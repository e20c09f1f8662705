"""Reports as files: rows of ``operators.proposals.export_rows`` as XLSX workbooks and PDF documents, made where the rows are."""

from __future__ import annotations

import io
import re
import struct
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The header of a workbook. The price is left to people, and the last column has a header only.
HEADER = ["Line", "Description", "Qty", "Matched Product", "MPN", "Match Type", "Score", "Status", "Price", "Currency", "Alternatives Count"]
COLUMNS = ["line_no", "description", "qty", "product", "mpn", "match_type", "score", "status", None, "currency"]
#: Rows of one file; a tender with more gets further files. Rows of several small files that are made at once.
MOST_ROWS, AT_ONCE = 50_000, 20_000
SCHEMA = "tender_id long, part int, content binary"
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_PACKAGE, _OFFICE = "http://schemas.openxmlformats.org/package/2006", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_XML, _INLINE = '<?xml version="1.0" encoding="UTF-8"?>', '" t="inlineStr"><is><t xml:space="preserve">'
_NOT_XML = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x{FFFE}\x{FFFF}]"


def _packed(entries: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in entries.items():
            # a fixed time, so that reruns give the same bytes
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), _XML + text, zipfile.ZIP_DEFLATED)
    return out.getvalue()


def _fixed() -> tuple[bytes, bytes]:
    """What all workbooks have in common: their entries but the sheet, and the directory of these."""
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    raw = _packed(
        {
            "[Content_Types].xml": f'<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
            f'<Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{kind}.worksheet+xml"/></Types>',
            "_rels/.rels": f'<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_OFFICE}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
            "xl/workbook.xml": f'<workbook xmlns="{_MAIN}" xmlns:r="{_OFFICE}"><sheets><sheet name="Report" sheetId="1" r:id="rId1"/></sheets></workbook>',
            "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_OFFICE}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        }
    )
    (start,) = struct.unpack("<L", raw[-6:-2])
    return raw[:start], raw[start:-22]


def _texts(values: pa.Array) -> pa.Array:
    """Values as the text in their cells, without what XML does not allow; null stays null."""
    if pa.types.is_integer(values.type):
        return values.cast(pa.string())
    if not pa.types.is_string(values.type):
        values = pa.array([None if v is None else str(v) for v in values.to_pylist()], pa.string())
    # bytes that occur at all: most columns have nothing to replace
    held = np.bincount(np.frombuffer(values.buffers()[2] or b"", np.uint8), minlength=256) > 0
    if held[:32].any() or held[0xEF]:
        values = pc.replace_substring_regex(values, _NOT_XML, "")
    for sign, shown in (("&", "&amp;"), (">", "&gt;"), ("<", "&lt;")):
        values = pc.replace_substring(values, sign, shown) if held[ord(sign)] else values
    return values


def _cells(values: pa.Array) -> pa.Array:
    """Cells behind the number of their row; a null is an empty cell."""
    number = pa.types.is_integer(values.type) or pa.types.is_floating(values.type) or pa.types.is_boolean(values.type)
    before, behind = ('"><v>', "</v></c>") if number else (_INLINE, "</t></is></c>")
    return pc.coalesce(pc.binary_join_element_wise(before, _texts(values), behind, ""), '"/>')


def _sheet_rows(columns: dict[str, pa.Array], numbers: pa.Array) -> pa.Array:
    """Rows of a sheet as XML, one for each value of the columns."""
    n = numbers.cast(pa.string())
    parts = ['<row r="', n, '">']
    for k, name in enumerate(COLUMNS):
        parts += [f'<c r="{chr(65 + k)}', n, _cells(columns[name]) if name else '"/>']
    return pc.binary_join_element_wise(*parts, "</row>", "")


_FIXED, _DIRECTORY = _fixed()
_TOP = f'{_XML}<worksheet xmlns="{_MAIN}"><sheetData><row r="1">{"".join(f'<c r="{chr(65 + k)}1{_INLINE}{h}</t></is></c>' for k, h in enumerate(HEADER))}</row>'.encode()


def workbook(rows: bytes) -> bytes:
    """SNK-2: one sheet named Report, of a header and ``rows`` as XML. What all workbooks have in common is not packed again for each."""
    sheet, name = b"".join((_TOP, rows, b"</sheetData></worksheet>")), b"xl/worksheets/sheet1.xml"
    packer = zlib.compressobj(zlib.Z_DEFAULT_COMPRESSION, zlib.DEFLATED, -15)
    data = packer.compress(sheet) + packer.flush()
    # version 2.0, deflated, 1980-01-01; then the directory's entry, with what systems ask for
    told = struct.pack("<5H3L2H", 20, 0, zipfile.ZIP_DEFLATED, 0, 33, zlib.crc32(sheet), len(data), len(sheet), len(name), 0)
    own = struct.pack("<4sH", b"PK\1\2", 20 | 3 << 8) + told + struct.pack("<3H2L", 0, 0, 0, 0o600 << 16, len(_FIXED)) + name
    before = b"".join((_FIXED, b"PK\3\4", told, name, data))
    return b"".join((before, _DIRECTORY, own, struct.pack("<4s4H2LH", b"PK\5\6", 0, 0, 5, 5, len(_DIRECTORY) + len(own), len(before), 0)))


def _shown(text: str) -> bytes:
    raw = re.sub(r"[\x00-\x1f]", " ", text).encode("cp1252", "replace")
    return re.sub(rb"([\\()])", rb"\\\1", raw)


def pdf(title: str, lines: list[str]) -> bytes:
    """SNK-3: a title and one line of text a row; a page ends below 60 points. What the standard fonts cannot show is a question mark."""
    pages: list[list[bytes]] = [[b"BT /F2 14 Tf 50 750 Td (%s) Tj ET" % _shown(title)]]
    y = 720
    for line in lines:
        if y < 60:
            pages.append([])
            y = 750
        pages[-1].append(b"BT /F1 9 Tf 50 %d Td (%s) Tj ET" % (y, _shown(line)))
        y -= 18
    kids = b" ".join(b"%d 0 R" % (5 + 2 * k) for k in range(len(pages)))
    font = b"<< /Type /Font /Subtype /Type1 /BaseFont /%s /Encoding /WinAnsiEncoding >>"
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [%s] /Count %d >>" % (kids, len(pages)), font % b"Helvetica", font % b"Helvetica-Bold"]
    for k, page in enumerate(pages):
        stream = zlib.compress(b"\n".join(page))
        objects.append(b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 612 792] /Resources << /Font << /F1 3 0 R /F2 4 0 R >> >> /Contents %d 0 R >>" % (6 + 2 * k))
        objects.append(b"<< /Length %d /Filter /FlateDecode >>\nstream\n%s\nendstream" % (len(stream), stream))
    out, places = bytearray(b"%PDF-1.4\n"), []
    for n, body in enumerate(objects, 1):
        places.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (n, body)
    table = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + b"".join(b"%010d 00000 n \n" % p for p in places)
    return bytes(out + b"trailer\n<< /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, table))


def _parts(rows: DataFrame, most: int) -> DataFrame:
    """Rows of each file as an ordered array, at most ``most`` of them. Files cost far more time than bytes, so that their tasks are not put together by size."""
    rows = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "tender_id")
    place = F.row_number().over(Window.partitionBy("tender_id").orderBy("line_id")) - 1
    row = F.struct("line_id", *(c for c in rows.columns if c not in ("tender_id", "line_id")))
    return rows.withColumn("part", F.floor(place / most).cast("int")).groupBy("tender_id", "part").agg(F.array_sort(F.collect_list(row)).alias("rows"))


def xlsx_files(rows: DataFrame, most: int = MOST_ROWS) -> DataFrame:
    """SNK-2: (tender_id, part, content); rows go by line_id, and beyond ``most`` into further parts."""

    def batches(files: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f in files:
            ends = f["rows"].offsets.to_numpy()
            k = 0
            while k < f.num_rows:
                # some rows at a time, since their XML is many times larger than they are; a file is not parted
                stop = min(f.num_rows, max(k + 1, int(np.searchsorted(ends, ends[k] + AT_ONCE, "right")) - 1))
                own, sizes = f.slice(k, stop - k), np.diff(ends[k : stop + 1])
                lines, starts = own["rows"].flatten(), np.append(0, np.cumsum(sizes))
                place = np.arange(len(lines)) - np.repeat(starts[:-1], sizes)
                xml = _sheet_rows({name: lines.field(name) for name in COLUMNS if name}, pa.array(place + 2))
                at, text = np.frombuffer(xml.buffers()[1], np.int32)[xml.offset : xml.offset + len(xml) + 1][starts], memoryview(xml.buffers()[2])
                made = [workbook(text[x:y]) for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield pa.record_batch({"tender_id": own["tender_id"], "part": own["part"], "content": pa.array(made, pa.binary())})
                k = stop

    return _parts(rows, most).mapInArrow(batches, SCHEMA)


def pdf_files(lines: DataFrame, most: int = MOST_ROWS) -> DataFrame:
    """SNK-3: the same of (tender_id, line_id, value), the lines of ``text_report``."""

    def batches(files: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f in files:
            made = [pdf(f"Matching report #{t}", values) for t, values in zip(f["tender_id"].to_pylist(), f["values"].to_pylist(), strict=True)]
            yield pa.record_batch({"tender_id": f["tender_id"], "part": f["part"], "content": pa.array(made, pa.binary())})

    values = F.transform("rows", lambda r: r["value"])
    return _parts(lines, most).select("tender_id", "part", values.alias("values")).mapInArrow(batches, SCHEMA)
