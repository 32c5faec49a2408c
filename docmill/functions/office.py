"""Text of office documents (DOCX, XLSX, PPTX): zip archives of XML, read by the standard library, a file at a time behind Arrow batches."""

from __future__ import annotations

import datetime
import io
import posixpath
import re
import xml.etree.ElementTree as ET
import zipfile

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

PAGE = T.StructType([T.StructField("page", T.IntegerType()), T.StructField("name", T.StringType()), T.StructField("text", T.StringType())])
#: Days are counted from here; by default sheets date from 1900.
_EPOCH = datetime.datetime(1899, 12, 30)
# Built-in number formats that show dates or times.
_DATE_FORMATS = {*range(14, 23), *range(45, 48)}


def _tag(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2]


def _first(e: ET.Element | None, *path: str) -> ET.Element | None:
    """The element at a path of local names."""
    for name in path:
        e = None if e is None else next((c for c in e if _tag(c) == name), None)
    return e


def _all(e: ET.Element, name: str) -> list[ET.Element]:
    return [c for c in e.iter() if _tag(c) == name]


def _related(archive: zipfile.ZipFile, part: str) -> dict[str, str]:
    """Targets of a part's relations by id."""
    folder, name = posixpath.split(part)
    try:
        root = ET.fromstring(archive.read(f"{folder}/_rels/{name}.rels"))
    except KeyError:
        return {}
    return {r.get("Id", ""): r.get("Target", "").lstrip("/") if r.get("Target", "").startswith("/") else posixpath.normpath(posixpath.join(folder, r.get("Target", ""))) for r in root}


def _relation(e: ET.Element) -> str:
    return next((v for k, v in e.attrib.items() if k.endswith("}id")), "")


def _runs(paragraph: ET.Element) -> str:
    out = []
    for e in paragraph.iter():
        name = _tag(e)
        out.append((e.text or "") if name == "t" else "\t" if name == "tab" else "\n" if name in ("br", "cr") else "")
    return "".join(out).strip()


def _docx(archive: zipfile.ZipFile) -> list[tuple[int, str | None, str]]:
    """One page: all paragraphs, then all tables, cells side by side."""
    body = _first(ET.fromstring(archive.read("word/document.xml")), "body")
    parts = [_runs(p) for p in body if _tag(p) == "p"]
    for table in (t for t in body if _tag(t) == "tbl"):
        rows = [" | ".join("\n".join(_runs(p) for p in cell if _tag(p) == "p").strip() for cell in row if _tag(cell) == "tc") for row in table if _tag(row) == "tr"]
        parts.append("\n".join(rows))
    text = "\n\n".join(p for p in parts if p.strip())
    return [(1, None, text)] if text else []


def _column(reference: str) -> int:
    """B7 is in column 1."""
    n = 0
    for c in reference:
        if not c.isalpha():
            break
        n = 26 * n + ord(c.upper()) - 64
    return n - 1


def _xlsx(archive: zipfile.ZipFile) -> list[tuple[int, str | None, str]]:
    """A page for each sheet that has text: its name, then its rows without the empty ones."""
    names = set(archive.namelist())
    shared = ["".join(t.text or "" for t in _all(s, "t")) for s in ET.fromstring(archive.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
    dated: list[bool] = []
    if "xl/styles.xml" in names:
        root = ET.fromstring(archive.read("xl/styles.xml"))
        own = {f.get("numFmtId"): f.get("formatCode", "") for f in _all(root, "numFmt")}
        shows = lambda k: k.isdigit() and int(k) in _DATE_FORMATS or bool(re.search("[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", own.get(k, "")).lower()))
        dated = [shows(x.get("numFmtId", "0")) for x in _first(root, "cellXfs") or ()]

    def value(cell: ET.Element) -> str:
        kind, raw = cell.get("t", "n"), _first(cell, "v")
        if kind == "inlineStr":
            return "".join(t.text or "" for t in _all(cell, "t")).strip()
        if raw is None or raw.text is None:
            return ""
        if kind == "s":
            return shared[int(raw.text)].strip()
        if kind == "b":
            return "True" if raw.text == "1" else "False"
        style = int(cell.get("s", "0"))
        if kind == "n" and style < len(dated) and dated[style]:
            return str(_EPOCH + datetime.timedelta(seconds=round(float(raw.text) * 86400)))
        return raw.text.strip()

    targets, out = _related(archive, "xl/workbook.xml"), []
    for page, sheet in enumerate(_first(ET.fromstring(archive.read("xl/workbook.xml")), "sheets") or (), 1):
        rows = []
        data = _first(ET.fromstring(archive.read(targets[_relation(sheet)])), "sheetData")
        table = [[(_column(c.get("r", "")) if c.get("r") else i, value(c)) for i, c in enumerate(row)] for row in data or ()]
        width = max((at + 1 for row in table for at, _ in row), default=0)
        for row in table:
            cells = [""] * width
            for at, v in row:
                cells[at] = v
            if any(cells):
                rows.append(" | ".join(cells))
        if rows:
            out.append((page, sheet.get("name"), f"[Sheet: {sheet.get('name')}]\n\n" + "\n".join(rows)))
    return out


def _pptx(archive: zipfile.ZipFile) -> list[tuple[int, str | None, str]]:
    """A page for each slide that has text: its title, then its shapes in order, groups one level deep."""

    def lines(body: ET.Element | None) -> list[str]:
        """Paragraphs, from their runs."""
        texts = ["".join(t.text or "" for r in p if _tag(r) == "r" for t in r if _tag(t) == "t").strip() for p in body or () if _tag(p) == "p"]
        return [t for t in texts if t]

    def of_shape(shape: ET.Element) -> str:
        return "\n".join(lines(_first(shape, "txBody")))

    def is_title(shape: ET.Element) -> bool:
        mark = _first(shape, "nvSpPr", "nvPr", "ph")
        return mark is not None and mark.get("type") in ("title", "ctrTitle")

    targets, out = _related(archive, "ppt/presentation.xml"), []
    for page, slide in enumerate(_first(ET.fromstring(archive.read("ppt/presentation.xml")), "sldIdLst") or (), 1):
        tree = _first(ET.fromstring(archive.read(targets[_relation(slide)])), "cSld", "spTree")
        shapes = list(tree or ())
        title = next((s for s in shapes if _tag(s) == "sp" and is_title(s)), None)
        parts = ["# " + of_shape(title)] if title is not None and of_shape(title) else []
        for shape in shapes:
            if shape is title:
                continue
            if _tag(shape) == "graphicFrame":
                parts += ["\n".join(" | ".join(" ".join(lines(_first(c, "txBody"))) for c in row if _tag(c) == "tc") for row in _all(table, "tr")) for table in _all(shape, "tbl")]
            elif _tag(shape) == "grpSp":
                parts += [of_shape(s) for s in shape if _tag(s) == "sp"]
            elif _tag(shape) == "sp":
                parts.append(of_shape(shape))
        text = "\n\n".join(p for p in parts if p.strip(" |\n"))
        if text:
            out.append((page, None, text))
    return out


_READERS = {"docx": _docx, "xlsx": _xlsx, "pptx": _pptx}


@F.pandas_udf(T.ArrayType(PAGE))
def _pages(contents: pd.Series, formats: pd.Series) -> pd.Series:
    def one(raw: bytes | None, kind: str) -> list[tuple] | None:
        try:
            if raw is None or kind not in _READERS:
                return None
            with zipfile.ZipFile(io.BytesIO(raw)) as archive:
                return _READERS[kind](archive)
        except (zipfile.BadZipFile, KeyError, ET.ParseError, ValueError, IndexError, TypeError):
            return None

    return pd.Series([one(r, k) for r, k in zip(contents, formats, strict=True)], dtype=object)


def pages_by(content: Column, kind: Column) -> Column:
    """pages, of the kind each row names; null where it names another."""
    return _pages(content, kind)


def pages(content: Column, kind: str) -> Column:
    """Pages (number, name, text) of an office file of the kind docx, xlsx or pptx: those that have text; null if it can't be read."""
    if kind not in _READERS:
        raise ValueError(f"unknown kind {kind}; known are {', '.join(_READERS)}")
    return _pages(content, F.lit(kind))


def text(content: Column, kind: str) -> Column:
    """All pages' text; null if it can't be read."""
    return F.array_join(F.transform(pages(content, kind), lambda p: p["text"]), "\n\n")
