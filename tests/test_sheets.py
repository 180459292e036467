"""Excel files: sheets, shared and inline strings, gaps, mapped columns, broken files."""

import io
import zipfile

from lodestone.sources import files

MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def workbook(sheets):
    """A file of sheets {name: rows}; text goes to the shared strings, every other one inline, None leaves a gap."""
    strings, bodies = [], []
    for rows in sheets.values():
        lines = []
        for y, row in enumerate(rows, 1):
            cells = ""
            for x, v in enumerate(row):
                at = f"{chr(65 + x)}{y}"
                if v is None:
                    continue
                if isinstance(v, str) and len(strings) % 2 == 0:
                    strings.append(v)
                    cells += f'<c r="{at}" t="s"><v>{len(strings) - 1}</v></c>'
                elif isinstance(v, str):
                    strings.append("unused")
                    cells += f'<c r="{at}" t="inlineStr"><is><t>{v}</t></is></c>'
                else:
                    cells += f'<c r="{at}"><v>{v}</v></c>'
            lines.append(f'<row r="{y}">{cells}</row>')
        bodies.append(f'<worksheet {MAIN}><sheetData>{"".join(lines)}</sheetData></worksheet>')
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        rel = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
        z.writestr("xl/workbook.xml", f'<workbook {MAIN} {rel}><sheets>' + "".join(f'<sheet name="{n}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(sheets)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="r{i}" Target="{"/xl/" if i % 2 else ""}worksheets/s{i}.xml"/>' for i in range(len(sheets))) + "</Relationships>")
        z.writestr("xl/sharedStrings.xml", f"<sst {MAIN}>" + "".join(f"<si><r><t>{s[:1]}</t></r><r><t>{s[1:]}</t></r></si>" for s in strings) + "</sst>")
        for i, body in enumerate(bodies):
            z.writestr(f"xl/worksheets/s{i}.xml", body)
    return raw.getvalue()


SHEETS = {"C35": [["No", "Question", "Class"], [1, "why so", "r1"], [2, " how ", None], [None, None, None], [3, None, "r2"]], "C36": [["Class", "No", "x", "Question"], ["r9", 7, None, "what"]], "other": [["a"], ["b"]]}


def test_sheets_and_columns(spark, tmp_path):
    (tmp_path / "one.xlsx").write_bytes(workbook(SHEETS))
    (tmp_path / "bad.xlsx").write_bytes(b"no archive")
    (tmp_path / "text.txt").write_text("left out")
    rows = files.sheet_rows(spark, str(tmp_path))
    assert rows.where("cells IS NULL").count() == 1
    found = files.mapped_sheets(rows, {"C35": {"question": 1, "risk": 2}, "C36": {"question": 3, "risk": 0}})
    assert sorted(map(tuple, found.select("sheet", "question", "risk").collect()), key=repr) == sorted([("C35", "why so", "r1"), ("C35", "how", None), ("C35", None, "r2"), ("C36", "what", "r9")], key=repr)


def test_sheets_as_text(spark, tmp_path):
    (tmp_path / "one.xlsx").write_bytes(workbook(SHEETS))
    (tmp_path / "bad.xlsx").write_bytes(b"PK")
    got = {r.path.rsplit("/", 1)[1]: (r.text, r.error) for r in files.documents(spark, str(tmp_path)).collect()}
    assert got["one.xlsx"][0].startswith("C35\nNo\tQuestion\tClass\n1\twhy so\tr1\n2\t how ") and got["one.xlsx"][0].endswith("other\na\nb") and got["one.xlsx"][1] is None
    assert got["bad.xlsx"][0] is None and "BadZipFile" in got["bad.xlsx"][1]
