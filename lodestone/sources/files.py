"""Readers of knowledge files: JSON lines, CSV with a header, Markdown sections, word lists, Word files.

All read through Spark, so a path may be any URI. A record that can't be parsed is left out
and the rest kept; an empty file gives no rows.
"""

from __future__ import annotations

import io
import xml.etree.ElementTree as ET
import zipfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_CORRUPT = "_corrupt_record"
#: Name space of the text parts of a Word file.
_WORD_NS = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
#: Name spaces of an Excel file.
_SHEET_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL_ID = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def json_rows(spark: SparkSession, path: str, schema: T.StructType, multi_line: bool = False) -> DataFrame:
    """JSON objects, one a line or one array a file (``multi_line``); malformed records go."""
    wide = T.StructType([*schema.fields, T.StructField(_CORRUPT, T.StringType())])
    found = spark.read.schema(wide).option("mode", "PERMISSIVE").option("multiLine", multi_line).json(path)
    return found.where(F.col(_CORRUPT).isNull()).drop(_CORRUPT)


def csv_rows(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """CSV with a header; every column is a string, quotes are doubled, fields may hold line ends.

    A file without quoted line ends can be read with ``multi_line=False``, which lets Spark split it.
    """
    return spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"').csv(path)


def tags(column: Column) -> Column:
    """Comma-separated tags, trimmed; null without any."""
    return F.transform(F.split(column, ","), lambda t: F.trim(t))


def routed(rows: DataFrame) -> tuple[DataFrame | None, DataFrame | None]:
    """(products, entries): rows with name and description, else those with title and content."""
    if "tags" in rows.columns and dict(rows.dtypes)["tags"] == "string":
        rows = rows.withColumn("tags", tags(F.col("tags")))
    if {"name", "description"} <= set(rows.columns):
        return rows, None
    return None, rows if {"title", "content"} <= set(rows.columns) else None


def markdown_sections(spark: SparkSession, path: str) -> DataFrame:
    """(title, content, meta) of every section; sections without title or content go.

    A section begins with "# " at the start of a line, which is the reader's record
    separator: large files are split between tasks. Its lines ``**key:** value`` are meta,
    keys in lower case; the heading of the content part is left out.
    """
    raw = spark.read.option("lineSep", "\n# ").text(path)
    lines = F.split(F.regexp_replace("value", r"^\s+|\s+$", ""), "\n")
    body = F.slice("lines", 2, F.greatest(F.size("lines") - 1, F.lit(0)))
    is_meta = lambda line: line.rlike(r"^\*\*[^*]+:\*\*")
    pair = lambda line: F.struct(
        F.lower(F.trim(F.regexp_extract(line, r"^\*\*([^*]+):\*\*", 1))), F.trim(F.regexp_extract(line, r"^\*\*[^*]+:\*\*(.*)$", 1))
    )
    entries = F.transform(F.filter("body", is_meta), pair)
    last = F.filter(entries, lambda e: ~F.exists(F.slice(entries, F.array_position(entries, e).cast("int") + 1, F.size(entries)), lambda o: o["col1"] == e["col1"]))
    # Fixed value: the heading above the content part.
    kept = F.filter("body", lambda line: ~is_meta(line) & ~line.startswith("## 内容"))
    found = raw.select(lines.alias("lines")).select(F.trim(F.regexp_replace(F.col("lines")[0], "#", "")).alias("title"), body.alias("body"))
    found = found.select(
        "title",
        F.regexp_replace(F.array_join(kept, "\n"), r"^\s+|\s+$", "").alias("content"),
        F.map_from_entries(F.array_distinct(last)).alias("meta"),
    )
    return found.where("title <> '' AND content <> ''")


def word_list(spark: SparkSession, path: str) -> DataFrame:
    """(word) of each line that is neither blank nor a # comment, trimmed."""
    return spark.read.text(path).select(F.trim("value").alias("word")).where("word <> '' AND NOT startswith(word, '#')")


def docx_text(raw: bytes) -> str:
    """Paragraphs of a Word file, joined by line ends."""
    with zipfile.ZipFile(io.BytesIO(raw)) as archive:
        root = ET.fromstring(archive.read("word/document.xml"))
    return "\n".join("".join(t.text or "" for t in p.iter(f"{_WORD_NS}t")) for p in root.iter(f"{_WORD_NS}p"))


def xlsx_sheets(raw: bytes) -> dict[str, list[list[str]]]:
    """Rows of each sheet of an Excel file, by the sheet's name; cells as text, empty ones too up to a row's last."""
    with zipfile.ZipFile(io.BytesIO(raw)) as archive:
        names = set(archive.namelist())
        strings = []
        if "xl/sharedStrings.xml" in names:
            root = ET.fromstring(archive.read("xl/sharedStrings.xml"))
            strings = ["".join(t.text or "" for t in item.iter(f"{_SHEET_NS}t")) for item in root.iter(f"{_SHEET_NS}si")]
        targets = {r.get("Id"): r.get("Target") for r in ET.fromstring(archive.read("xl/_rels/workbook.xml.rels"))}
        out = {}
        for sheet in ET.fromstring(archive.read("xl/workbook.xml")).iter(f"{_SHEET_NS}sheet"):
            target = targets[sheet.get(_REL_ID)].lstrip("/")
            root = ET.fromstring(archive.read(target if target.startswith("xl/") else f"xl/{target}"))
            out[sheet.get("name")] = [_cells(row, strings) for row in root.iter(f"{_SHEET_NS}row")]
    return out


def _cells(row: ET.Element, strings: list[str]) -> list[str]:
    out: list[str] = []
    for cell in row.iter(f"{_SHEET_NS}c"):
        letters = "".join(c for c in cell.get("r", "") if c.isalpha())
        at = sum((ord(c) - 64) * 26**i for i, c in enumerate(reversed(letters))) - 1 if letters else len(out)
        value = cell.find(f"{_SHEET_NS}v")
        text = "".join(t.text or "" for t in cell.iter(f"{_SHEET_NS}t")) if cell.get("t") == "inlineStr" else (value.text or "" if value is not None else "")
        out += [""] * (at - len(out)) + [strings[int(text)] if cell.get("t") == "s" and text else text]
    return out


def xlsx_text(raw: bytes) -> str:
    """All sheets as text: a line with the sheet's name, then its rows with cells parted by tabs."""
    return "\n\n".join("\n".join([name, *("\t".join(r) for r in rows)]) for name, rows in xlsx_sheets(raw).items())


def sheet_rows(spark: SparkSession, path: str) -> DataFrame:
    """(path, sheet, row, cells) of all Excel files below ``path``, rows from 0; a file that can't be read has one row with null cells."""

    @F.arrow_udf("array<struct<sheet string, row int, cells array<string>>>")
    def read(contents: pa.Array) -> pa.Array:
        out = []
        for raw in contents:
            try:
                out.append([{"sheet": n, "row": i, "cells": r} for n, rows in xlsx_sheets(raw.as_py() or b"").items() for i, r in enumerate(rows)])
            except (KeyError, ValueError, zipfile.BadZipFile, ET.ParseError):
                out.append([{"sheet": None, "row": None, "cells": None}])
        kind = pa.struct([("sheet", pa.string()), ("row", pa.int32()), ("cells", pa.list_(pa.string()))])
        return pa.array(out, pa.list_(kind))

    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path)
    return found.select("path", F.explode(read("content")).alias("r")).select("path", "r.*")


def mapped_sheets(rows: DataFrame, columns: dict[str, dict[str, int]]) -> DataFrame:
    """(sheet, and the fields) of the rows after each sheet's heading: ``columns`` gives for each sheet the place of every field; other sheets and blank rows go."""
    fields = sorted({f for m in columns.values() for f in m})
    body = rows.where((F.col("row") > 0) & F.col("sheet").isin(list(columns)))

    def field(name: str):
        cases = [F.when(F.col("sheet") == s, F.nullif(F.trim(F.get("cells", m[name])), F.lit(""))) for s, m in columns.items() if name in m]
        return F.coalesce(*cases).alias(name)

    found = body.select("sheet", *[field(f) for f in fields])
    return found.where(" OR ".join(f"{f} IS NOT NULL" for f in fields))


def documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, text, error) of text, Markdown, Word and Excel files; other kinds and broken files carry an error."""

    @F.arrow_udf("text string, error string")
    def read(names: pa.Array, contents: pa.Array) -> pa.Array:
        out = []
        for name, raw in zip(names, contents):
            kind, data = name.as_py().rsplit(".", 1)[-1].lower(), raw.as_py() or b""
            try:
                if kind not in ("txt", "md", "docx", "xlsx"):
                    raise ValueError(f"no reader for .{kind}")
                text = docx_text(data) if kind == "docx" else xlsx_text(data) if kind == "xlsx" else data.decode("utf-8")
                out.append({"text": text, "error": None})
            except (ValueError, KeyError, zipfile.BadZipFile, ET.ParseError) as failed:
                out.append({"text": None, "error": f"{type(failed).__name__}: {failed}"})
        return pa.array(out, pa.struct([("text", pa.string()), ("error", pa.string())]))

    return spark.read.format("binaryFile").load(path).select("path", read("path", "content").alias("r")).select("path", "r.*")
