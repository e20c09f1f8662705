"""Workbooks made in batches, and small ones read without a parser, against zipfile and ElementTree."""

import io
import zipfile

import pyarrow as pa
import pytest

from specmill.sources import documents, reports

ROW = {"line_no": "1", "description": "a <b> & \x01(c)\\ é ]]> ￾", "qty": 2.5, "product": "", "mpn": None, "match_type": "spec", "score": 66, "status": "partial", "currency": "JOD"}


def made(rows, first=2):
    lines = pa.array(rows)
    xml = reports._sheet_rows({name: lines.field(name) for name in reports.COLUMNS if name}, pa.array(range(first, first + len(rows))))
    return reports.workbook("".join(xml.to_pylist()).encode())


def packed(sheet, compression=zipfile.ZIP_DEFLATED, comment=b"", **more):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", compression) as z:
        z.comment = comment
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{reports._MAIN}" xmlns:r="{reports._OFFICE}"><sheets><sheet name="S" r:id="x"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{reports._PACKAGE}/relationships"><Relationship Id="x" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", sheet)
        for name, text in more.items():
            z.writestr(f"xl/{name}.xml", text)
    return out.getvalue()


def parsed(content, monkeypatch):
    """What the parser and zipfile read, or the error that they raise."""
    with monkeypatch.context() as m:
        m.setattr(documents, "_plain_rows", lambda sheet: None)
        m.setattr(documents, "_entries", lambda content: (z := zipfile.ZipFile(io.BytesIO(content))) and (lambda name: z.read(name) if name in z.namelist() else None))
        return told(content)


def told(content):
    try:
        return documents.read_xlsx(content)
    except Exception as e:
        return type(e).__name__


def test_a_workbook_is_a_whole_archive_and_reruns_agree():
    raw = made([ROW, ROW | {"qty": 1e7, "description": None}])
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        assert z.testzip() is None
        assert z.namelist() == ["[Content_Types].xml", "_rels/.rels", "xl/workbook.xml", "xl/_rels/workbook.xml.rels", "xl/worksheets/sheet1.xml"]
        assert raw == reports._packed({n: z.read(n).decode().removeprefix(reports._XML) for n in z.namelist()})
    assert documents.read_xlsx(raw)[0][3].split("\n")[1:] == ["1\ta <b> & (c)\\ é ]]> \t2.5\t\t\tspec\t66\tpartial\t\tJOD", "1\t\t10000000.0\t\t\tspec\t66\tpartial\t\tJOD"]


def test_many_small_workbooks_are_read_without_a_parser_for_each(monkeypatch):
    files = [made([ROW | {"line_no": str(k), "description": f"spec {k}"}] * (1 + k % 3)) for k in range(40)]
    wanted = [parsed(f, monkeypatch) for f in files]
    calls = []
    for owner, name in ((documents.ElementTree, "fromstring"), (documents.zipfile, "ZipFile")):
        monkeypatch.setattr(owner, name, lambda *a, f=getattr(owner, name), **k: (calls.append(a), f(*a, **k))[1])
    assert [documents.read_xlsx(f) for f in files] == wanted
    assert len(calls) <= 2


CELLS = {
    "plain": '<row r="1"><c r="A1"><v>1</v></c><c r="C1" t="inlineStr"><is><t> a &amp;lt; &quot; </t></is></c><c r="AB1"/></row><row><c><v>2</v></c><c r="B2" t="str"><v></v></c></row><row r="3"></row>',
    "backwards": '<row r="1"><c r="C1"><v>1</v></c><c r="A1"><v>2</v></c></row>',
    "far": '<row r="1"><c r="ZZZ1"><v>1</v></c></row>',
    "number": '<row r="1"><c r="A1"><v>&#65;</v></c></row>',
    "unknown": '<row r="1"><c r="A1"><v>&x;</v></c></row>',
    "cdata": '<row r="1"><c r="A1"><v><![CDATA[a<b]]></v></c></row>',
    "end": '<row r="1"><c r="A1"><v>a]]>b</v></c></row>',
    "control": '<row r="1"><c r="A1"><v>a\x02</v></c></row>',
    "return": '<row r="1"><c r="A1"><v>a\r\nb\tc\nd</v></c></row>',
    "comment": '<row r="1"><!-- <c r="A1"/> --><c r="A1"><v>1<!-- x --></v></c></row>',
    "runs": '<row r="1"><c r="A1" t="inlineStr"><is><r><t>a</t></r><r><t>b</t></r></is></c></row>',
    "shared": '<row r="1"><c r="A1" t="s"><v>1</v></c><c r="B1" s="2"><v>5</v></c></row>',
    "formula": '<row r="1" spans="1:2"><c r="A1"><f>1+1</f><v>2</v></c></row>',
    "blanks": ' <row r="1">\n<c r="A1"><v>1</v></c></row>',
    "open": '<row r="1"><c r="A1"><v>1</v></c>',
}


@pytest.mark.parametrize("cells", CELLS.values(), ids=CELLS)
def test_sheets_are_read_as_a_parser_reads_them(monkeypatch, cells):
    sheet = f'<worksheet xmlns="{reports._MAIN}"><sheetData>{cells}</sheetData></worksheet>'
    strings = f'<sst xmlns="{reports._MAIN}"><si><t>x</t></si><si><t>y</t></si></sst>'
    for content in (packed(sheet), packed(sheet, zipfile.ZIP_STORED, sharedStrings=strings), packed(sheet, comment=b"PK\5\6 a comment of the archive"), packed("﻿" + sheet), b"before" + packed(sheet)):
        assert told(content) == parsed(content, monkeypatch)


def test_broken_archives_are_refused(monkeypatch):
    whole = made([ROW])
    at = whole.index(b"xl/worksheets/sheet1.xml") + 60
    for broken in (whole[:at] + bytes([whole[at] ^ 255]) + whole[at + 1 :], whole[:-1], whole[100:], whole[:-30] + whole[-22:], b"", b"PK\5\6" + bytes(18)):
        assert told(broken) == parsed(broken, monkeypatch)
    assert told(whole[:at] + bytes([whole[at] ^ 255]) + whole[at + 1 :]) in ("error", "BadZipFile")
