"""Readers of landed formats: choosing a converter, HTML to blocks, bytes to text, Word documents to paragraphs."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_HEAD = re.compile(r"h[1-6]")
_STRUCK = {"s", "strike", "del"}
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def converter(url: Column, text: Column) -> Column:
    u = F.lower(url)
    out = F.when(u.endswith(".pdf"), "pdf").when(u.endswith(".docx"), "docx").when(u.endswith(".doc"), "doc")
    return out.when(text.rlike(r"(?i)<(p|div|table|h[1-6])[ >]"), "html").otherwise("texto")


class Blocks(HTMLParser):
    """(kind, text) of a page in order; nested tables run on as text of their cell."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[tuple[str, str]] = []
        self.kind, self.text, self.cells, self.tables, self.mute = "parrafo", "", None, 0, 0

    def flush(self, kind: str = "parrafo") -> None:
        line = re.sub(r"~~\s*~~", " ", " ".join(self.text.split())).strip()
        if line and not self.tables:
            self.out.append((self.kind, line))
        if not self.tables:
            self.text, self.kind = "", kind

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("script", "style"):
            self.mute += 1
        elif tag == "table":
            self.flush()
            self.tables += 1
        elif tag == "tr" and self.tables == 1:
            self.cells = []
            self.text = ""
        elif tag in ("td", "th") and self.tables == 1:
            self.text = ""
        elif _HEAD.fullmatch(tag):
            self.flush("titulo")
        elif tag == "li":
            self.flush("item")
        elif tag in ("p", "div", "blockquote", "pre"):
            self.flush()
        elif tag == "br":
            self.text += " "
        elif tag in _STRUCK:
            self.text += "~~"

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style"):
            self.mute = max(0, self.mute - 1)
        elif tag in ("td", "th") and self.tables == 1 and self.cells is not None:
            self.cells.append(" ".join(self.text.split()))
            self.text = ""
        elif tag == "tr" and self.tables == 1 and self.cells is not None:
            if any(self.cells):
                self.out.append(("fila", " | ".join(self.cells)))
            self.cells = None
        elif tag == "table" and self.tables:
            self.tables -= 1
            if not self.tables:
                self.text = ""
        elif _HEAD.fullmatch(tag) or tag in ("p", "div", "li", "blockquote", "pre"):
            self.flush()
        elif tag in _STRUCK:
            self.text += "~~"

    def handle_data(self, data: str) -> None:
        if not self.mute:
            self.text += data


def blocks_of(html: str) -> list[tuple[str, str]]:
    parser = Blocks()
    parser.feed(html)
    parser.close()
    parser.flush()
    return parser.out


def html_blocks(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, bloque, tipo, texto) of every text that holds block tags."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(k, i, kind, t) for k, x in zip(frame[key], frame[text]) for i, (kind, t) in enumerate(blocks_of(x))]
            yield pd.DataFrame(rows, columns=[key, "bloque", "tipo", "texto_bloque"])

    held = df.where(F.col(text).rlike(r"(?i)<(p|div|table|h[1-6])[ >]")).select(key, text)
    return held.mapInPandas(run, f"{key} string, bloque int, tipo string, texto_bloque string")


def decode(content: bytes) -> str:
    """UTF-8, and byte by byte cp1252 where that fails."""
    out, rest = [], content
    while rest:
        try:
            out.append(rest.decode("utf-8"))
            break
        except UnicodeDecodeError as e:
            out.append(rest[: e.start].decode("utf-8"))
            out.append(rest[e.start : e.start + 1].decode("cp1252", "replace"))
            rest = rest[e.start + 1 :]
    return "".join(out)


def problem(content: bytes, name: str) -> str | None:
    """What is wrong with a landed file, by its first and last bytes; None if nothing is."""
    if len(content) < 1024:
        return "pequeño"
    low = name.lower()
    if low.endswith(".pdf"):
        return None if content[:5] == b"%PDF-" and b"%%EOF" in content[-2048:] else "pdf dañado"
    if low.endswith(".docx"):
        return None if zipfile.is_zipfile(io.BytesIO(content)) else "zip dañado"
    if low.endswith((".html", ".htm")):
        return None if b"</html>" in content[-4096:].lower() else "html cortado"
    return None


def docx_paragraphs(content: bytes) -> list[str]:
    """Paragraphs and table rows of a Word document in body order; struck runs are marked."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")

    def para(p) -> str:
        parts = []
        for run in p.iter(f"{_W}r"):
            text = "".join(t.text or "" for t in run.iter(f"{_W}t"))
            off = run.find(f"{_W}rPr/{_W}strike")
            parts.append(f"~~{text}~~" if text and off is not None and off.get(f"{_W}val") not in ("0", "false") else text)
        return "".join(parts).replace("~~~~", "").strip()

    out = []
    for node in body:
        if node.tag == f"{_W}p":
            out.append(para(node))
        elif node.tag == f"{_W}tbl":
            for row in node.iter(f"{_W}tr"):
                out.append(" | ".join(" ".join(para(p) for p in cell.iter(f"{_W}p")) for cell in row.findall(f"{_W}tc")))
    return [x for x in out if x]


def read_landed(spark, folder: str) -> DataFrame:
    """(path, formato, problema, texto) of every file under a folder, read in parallel."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, content in zip(frame.path, frame.content):
                content, kind = bytes(content), path.rsplit(".", 1)[-1].lower()
                bad, text = problem(content, path), None
                if not bad:
                    text = "\n".join(t for _, t in blocks_of(decode(content))) if kind in ("html", "htm") else "\n".join(docx_paragraphs(content)) if kind == "docx" else decode(content) if kind == "txt" else None
                rows.append((path, kind, bad, text))
            yield pd.DataFrame(rows, columns=["path", "formato", "problema", "texto"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "content")
    return files.mapInPandas(run, "path string, formato string, problema string, texto string")
