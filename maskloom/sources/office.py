"""DOCX and XLSX files as blocks and cells, by the standard library; PDF by ``sources.pdf`` or a reader that is passed in."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from itertools import islice
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame

from maskloom.sources.pdf import pdf_blocks

BLOCKS = "path string, ord int, block_id string, type string, text string, cells array<struct<row:int,col:int,text:string>>, warning string"
#: Bounds of what is read of a workbook.
MOST_CELLS = 200_000
MOST_COMMENTS, MOST_COMMENT_PART, MOST_COMMENT_BYTES = 20_000, 5 << 20, 20 << 20
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def _words(node: ET.Element) -> str:
    out = []
    for x in node.iter():
        if x.tag == f"{_W}t":
            out.append(x.text or "")
        elif x.tag in (f"{_W}tab", f"{_W}br"):
            out.append("\t" if x.tag.endswith("tab") else "\n")
    return "".join(out)


def docx_blocks(body: bytes) -> Iterator[tuple]:
    """Body paragraphs and tables in order, then the different header and footer texts, then comments."""
    z = zipfile.ZipFile(io.BytesIO(body))
    root = ET.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    for node in root if root is not None else []:
        if node.tag == f"{_W}p" and (text := _words(node)).strip():
            style = node.find(f"{_W}pPr/{_W}pStyle")
            name = style.get(f"{_W}val", "") if style is not None else ""
            yield ("heading" if re.match("Heading|Title", name) else "paragraph"), text, []
        elif node.tag == f"{_W}tbl":
            cells = [(r, c, _words(cell)) for r, row in enumerate(node.iter(f"{_W}tr")) for c, cell in enumerate(row.findall(f"{_W}tc"))]
            yield "table", "", [x for x in cells if x[2].strip()]
    seen = set()
    for name in sorted(z.namelist()):
        if re.match(r"word/(header|footer|comments)\d*\.xml$", name):
            for p in ET.fromstring(z.read(name)).iter(f"{_W}p"):
                if (text := _words(p)).strip() and text not in seen:
                    seen.add(text)
                    yield "paragraph", text, []


def _sheets(z: zipfile.ZipFile) -> Iterator[tuple[str, str]]:
    """(title, part) of each sheet in the workbook's order; parts by their relation, as the format has it."""
    relations = {r.get("Id"): r.get("Target", "") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))} if "xl/_rels/workbook.xml.rels" in z.namelist() else {}
    for n, sheet in enumerate(ET.fromstring(z.read("xl/workbook.xml")).iter(f"{_S}sheet"), 1):
        target = relations.get(sheet.get(f"{_R}id"), f"worksheets/sheet{n}.xml")
        part = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
        if part in z.namelist():
            yield sheet.get("name", ""), part


def _cells(body: bytes, strings: list[str]) -> Iterator[tuple[int, int, str]]:
    for c in ET.fromstring(body).iter(f"{_S}c"):
        letters, number = re.match(r"([A-Z]+)(\d+)", c.get("r", "A1")).groups()
        col = 0
        for ch in letters:
            col = col * 26 + ord(ch) - 64
        v = c.find(f"{_S}v")
        if v is None:
            text = "".join(t.text or "" for t in c.iter(f"{_S}t"))
        else:
            text = strings[int(v.text)] if c.get("t") == "s" else v.text
        if text:
            yield int(number) - 1, col - 1, text


def _comments(z: zipfile.ZipFile) -> Iterator[str]:
    """``A1: text`` of cell comments, within the bounds; parts beyond them are left out."""
    left, room = MOST_COMMENTS, MOST_COMMENT_BYTES
    for info in z.infolist():
        if not re.match(r"xl/.*comments.*\.xml$", info.filename, re.IGNORECASE) or info.file_size > MOST_COMMENT_PART:
            continue
        room -= info.file_size
        if room < 0:
            return
        try:
            found = ET.fromstring(z.read(info.filename))
        except ET.ParseError:
            continue
        for comment in found.iter(f"{_S}comment"):
            text = "".join(t.text or "" for t in comment.iter(f"{_S}t")).strip()
            if text and left:
                left -= 1
                yield f"{comment.get('ref')}: {text}" if comment.get("ref") else text


def xlsx_blocks(body: bytes) -> Iterator[tuple]:
    """Each sheet that has cells as a heading and a sparse table, then comments; values as text.

    After ``MOST_CELLS`` cells the workbook is cut, which the last block, of type ``warning``, says.
    """
    z = zipfile.ZipFile(io.BytesIO(body))
    strings = []
    if "xl/sharedStrings.xml" in z.namelist():
        strings = ["".join(t.text or "" for t in si.iter(f"{_S}t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_S}si")]
    left = MOST_CELLS
    for title, part in _sheets(z):
        cells = list(islice(_cells(z.read(part), strings), left + 1))
        left -= len(cells)
        if cells:
            yield "heading", title, []
            yield "table", "", cells[:left] if left < 0 else cells
        if left < 0:
            break
    for text in _comments(z):
        yield "paragraph", text, []
    if left < 0:
        yield "warning", f"truncated:workbook at {MOST_CELLS} cells", []


def extract_blocks(files: DataFrame, pdf: Callable[[bytes], Iterator[tuple]] | None = None) -> DataFrame:
    """Blocks of checked files (path, kind, content); a file that cannot be read gives one row with a warning.

    ``pdf`` reads a PDF's bytes into (type, text, cells) and maybe a block id, where a better reader is at hand.
    """
    readers = {"docx": docx_blocks, "xlsx": xlsx_blocks, "pdf": pdf or pdf_blocks}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, kind, content in zip(b["path"], b["kind"], b["content"], strict=True):
                rows = []
                try:
                    for n, (what, text, cells, *name) in enumerate(readers[kind](bytes(content))):
                        if what == "warning":
                            rows.append((path, n, f"b{n}", "paragraph", "", [], text))
                            continue
                        rows.append((path, n, name[0] if name else f"b{n}", what, text, [{"row": r, "col": c, "text": t} for r, c, t in cells], None))
                except Exception as e:  # whatever a broken file raises fails closed
                    rows = [(path, 0, "b0", "paragraph", "", [], f"extract_failed:{type(e).__name__}")]
                if rows:
                    yield pd.DataFrame(rows, columns=["path", "ord", "block_id", "type", "text", "cells", "warning"])

    return files.select("path", "kind", "content").mapInPandas(run, BLOCKS)
