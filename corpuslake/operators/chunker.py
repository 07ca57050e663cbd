"""Chunks of Markdown documents: norms by their articles, rulings by their sections, each with offsets into the document.

A document is one row and is cut within its row: blocks in order, headings kept on a stack, windows packed greedily.
Documents never meet, so the corpus is cut where it is read and nothing is shuffled.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Sizes in characters of articles, windows, short rests, the parts of a ruling's summary, and boxed notes.
ARTICLE, WINDOW, SHORT, OPENING, DECISION, BOX = 2400, 1700, 200, 1500, 1800, 800
# Boxes that stay with their article; words that open a structural heading; words of a deciding section.
KEPT_BOXES = ("notas de vigencia", "jurisprudencia vigencia", "resumen de notas de vigencia")
STRUCTURE = {
    "parte": "parte", "libro": "libro", "titulo": "titulo", "título": "titulo", "capitulo": "capitulo", "capítulo": "capitulo",
    "seccion": "seccion", "sección": "seccion", "subseccion": "subseccion", "subsección": "subseccion",
}
_DECIDES = re.compile(r"resuelve|decisi[oó]n|decide|falla", re.I)
_BLOCK = re.compile(r"(?:[^\n]+\n?)+")
_HEADING = re.compile(r"(#{2,6}) (.+)")
_ARTICLE = re.compile(r"Artículo (\S+?)\.?(?:\s+(.*))?")
_BOX = re.compile(r"> \*\*(.+?):\*\*")
_BOLD = re.compile(r"\*\*(.+?)\*\*")
_STRUCK = re.compile(r"~~.*?~~", re.S)
_GAP = re.compile(r"\W+")
_NOT_RULED = ("sin_marca", None, "")


class Piece(NamedTuple):
    """Cleaned text with the span of the document it was made from."""

    start: int
    end: int
    text: str


@dataclass
class Chunk:
    chunk_id: str
    kind: str
    head: str
    body: list[Piece]
    article: str | None = None
    article_id: str | None = None
    path: list[str] = field(default_factory=list)
    path_ids: dict[str, str] = field(default_factory=dict)
    struck: bool = False
    part: int | None = None
    parts: int | None = None
    section: str | None = None
    section_id: str | None = None

    @property
    def text(self) -> str:
        body = "\n\n".join(p.text for p in self.body)
        return f"{self.head}\n{body}".strip()


def blocks(markdown: str, base: int = 0) -> Iterator[Piece]:
    """Pieces parted by blank lines, as they stand."""
    for m in _BLOCK.finditer(markdown):
        t = m.group().strip("\n")
        if t.strip():
            yield Piece(base + m.start(), base + m.start() + len(t), t)


def cleaned(t: str) -> str:
    """A block without quote marks, bold marks, escapes and blank lines."""
    lines = (re.sub(r"^>\s?", "", x) for x in t.split("\n"))
    return _BOLD.sub(r"\1", "\n".join(x for x in lines if x.strip())).replace("\\#", "#").replace("\\>", ">").strip()


def pieces_within(pieces: list[Piece], limit: int) -> Iterator[Piece]:
    """Pieces of ``limit`` characters at most, and a mark that ends a sentence right behind them: a longer one is cut behind
    the last sentence end or line end that fits, else hard."""
    cut = re.compile(r".{1,%d}(?:[.;:]\s|\n|$)|.{1,%d}" % (limit, limit), re.S)
    for p in pieces:
        if len(p.text) <= limit:
            yield p
            continue
        at = p.start
        for m in cut.finditer(p.text):
            part = m.group()
            if part.strip():
                yield Piece(at, at + len(part), part.strip())
            at += len(part)


def windows(pieces: list[Piece], limit: int, overlap: bool) -> list[list[Piece]]:
    """Consecutive pieces packed up to ``limit`` characters.

    With ``overlap`` a window begins with the last piece of the one before, if that is under half the limit. Without, a
    short rest goes to the last window.
    """
    out: list[list[Piece]] = []
    open_: list[Piece] = []
    size = 0
    for p in pieces_within(pieces, limit):
        if open_ and size + len(p.text) > limit:
            out.append(open_)
            open_ = open_[-1:] if overlap and len(open_[-1].text) < limit // 2 else []
            size = sum(len(x.text) for x in open_)
        open_ = [*open_, p]
        size += len(p.text)
    if open_ and out and not overlap and size < SHORT:
        out[-1] = [*out[-1], *open_]
    elif open_:
        out.append(open_)
    return out


def struck_share(t: str) -> float:
    return sum(map(len, _STRUCK.findall(t))) / len(t) if t else 0.0


def citable_name(meta: dict) -> str:
    name = meta.get("nombre_citable") or meta.get("titulo") or meta["doc_id"]
    if meta.get("tipo_documento") == "sentencia":
        issuer = meta.get("organo_emisor")
        if not issuer or name.startswith(issuer):
            return name
        return f"{issuer}, {meta['sala']}, {name}" if meta.get("sala") else f"{issuer}, {name}"
    kind, number, year = (meta.get(k) for k in ("tipo_norma", "numero", "anio"))
    if kind in ("ley", "decreto") and number and year and not re.search(rf"\b{re.escape(str(number))}\b", name):
        return f"{name} ({kind.capitalize()} {number} de {year})"
    return name


def head_line(meta: dict, path: list[str], extra: str = "") -> str:
    line = " › ".join(x for x in (citable_name(meta), *path) if x)
    if meta.get("vigencia") not in _NOT_RULED:
        line += f" [vigencia: {meta['vigencia'].replace('_', ' ')}]"
    return f"{line}\n{extra}".rstrip()


class _Stack:
    """Open headings, outermost first; a heading closes those of its level and below."""

    def __init__(self, doc_id: str) -> None:
        self.doc_id, self.open = doc_id, []

    def push(self, level: int, text: str) -> None:
        first = text.split()[0].lower().rstrip(".") if text.split() else ""
        self.open = [*(h for h in self.open if h[0] < level), (level, STRUCTURE.get(first, "subtitulo"), text)]

    @property
    def path(self) -> list[str]:
        return [text for _, _, text in self.open]

    @property
    def ids(self) -> dict[str, str]:
        slugs = [_GAP.sub("_", text.lower())[:40] for _, _, text in self.open]
        return {kind: f"{self.doc_id}/" + "/".join(slugs[: k + 1]) for k, (_, kind, _) in enumerate(self.open)}


@dataclass
class _Article:
    number: str
    title: str
    path: list[str]
    ids: dict[str, str]
    body: list[Piece] = field(default_factory=list)
    notes: list[Piece] = field(default_factory=list)

    def take(self, p: Piece) -> None:
        """A block of the article: boxed notes go apart; of a long note on its validity the beginning stays."""
        box, text = _BOX.match(p.text), cleaned(p.text)
        clean = Piece(p.start, p.end, text)
        if not box:
            self.body.append(clean)
        elif not box[1].lower().startswith(KEPT_BOXES):
            self.notes.append(clean)
        elif len(p.text) > BOX:
            self.body.append(Piece(p.start, p.end, text[:BOX].rsplit(" ", 1)[0] + " …(sigue en notas)"))
            self.notes.append(clean)
        else:
            self.body.append(clean)


def _article_chunks(meta: dict, a: _Article, seen: Counter) -> Iterator[Chunk]:
    seen[a.number] += 1
    aid = f"{meta['doc_id']}/art_{a.number}" + (f"~{seen[a.number]}" if seen[a.number] > 1 else "")
    head = head_line(meta, a.path, f"Artículo {a.number}." + (f" {a.title}" if a.title else ""))
    own = {"article": a.number, "article_id": aid, "path": a.path, "path_ids": a.ids, "struck": struck_share(" ".join(p.text for p in a.body)) > 0.6}
    groups = windows(a.body, ARTICLE, False) or [[]]
    if len(groups) == 1:
        yield Chunk(aid, "articulo", head, groups[0], **own)
    else:
        for k, g in enumerate(groups, 1):
            yield Chunk(f"{aid}#{k}", "parte_articulo", f"{head} (parte {k} de {len(groups)})", g, part=k, parts=len(groups), **own)
    for k, g in enumerate(windows(a.notes, ARTICLE, False), 1):
        yield Chunk(f"{aid}/notas" + (f"#{k}" if k > 1 else ""), "notas", f"{head}\nNotas del artículo {a.number}:", g, **own)


def norm_chunks(meta: dict, markdown: str, base: int = 0) -> list[Chunk]:
    """Articles in order, split when long, with their notes; before them the preamble, after them annexes by their path."""
    doc_id, stack, seen = meta["doc_id"], _Stack(meta["doc_id"]), Counter()
    preamble: list[Piece] = []
    annexes: list[tuple[list[str], list[Piece]]] = []
    out: list[Chunk] = []
    article: _Article | None = None

    def close() -> None:
        nonlocal article
        if article:
            out.extend(_article_chunks(meta, article, seen))
        article = None

    for p in blocks(markdown, base):
        if p.text.startswith("# "):
            continue
        heading = _HEADING.fullmatch(p.text.split("\n")[0])
        if heading:
            title = heading[2].strip()
            close()
            if a := _ARTICLE.fullmatch(title):
                article = _Article(a[1].rstrip("."), (a[2] or "").strip(), stack.path, stack.ids)
            else:
                stack.push(len(heading[1]), title)
        elif article:
            article.take(p)
        elif not seen and not out:
            preamble.append(Piece(p.start, p.end, cleaned(p.text)))
        else:
            path = stack.path
            if not annexes or annexes[-1][0] != path:
                annexes.append((path, []))
            annexes[-1][1].append(Piece(p.start, p.end, cleaned(p.text)))
    close()
    has_articles = any(c.kind in ("articulo", "parte_articulo") for c in out)
    kind = "preambulo" if has_articles else "texto"
    before = [Chunk(f"{doc_id}/{kind}#{k}", kind, head_line(meta, []), g) for k, g in enumerate(windows(preamble, WINDOW, not has_articles), 1)]
    parts = [(path, g) for path, group in annexes for g in windows(group, WINDOW, True)]
    return before + out + [Chunk(f"{doc_id}/anexo#{k}", "anexo", head_line(meta, path), g, path=path) for k, (path, g) in enumerate(parts, 1)]


def _until(pieces: list[Piece], size: int) -> list[Piece]:
    """The first pieces, until they hold ``size`` characters; the one that crosses it is kept."""
    out, held = [], 0
    for p in pieces:
        if held >= size:
            break
        out.append(p)
        held += len(p.text)
    return out


def ruling_chunks(meta: dict, markdown: str, base: int = 0) -> list[Chunk]:
    """The summary (opening and decision), then every section in overlapping windows."""
    doc_id = meta["doc_id"]
    sections: list[tuple[str, list[Piece]]] = [("", [])]
    for p in blocks(markdown, base):
        if p.text.startswith("# "):
            continue
        first, _, rest = p.text.partition("\n")
        if heading := _HEADING.fullmatch(first):
            sections.append((heading[2].strip(), [Piece(p.start, p.end, cleaned(rest))] if rest.strip() else []))
        else:
            sections[-1][1].append(Piece(p.start, p.end, cleaned(p.text)))
    out: list[Chunk] = []
    summary = _until(sections[0][1], OPENING)
    deciding = next((s for s in reversed(sections[1:]) if _DECIDES.search(s[0])), None)
    if deciding:
        taken = _until(deciding[1], DECISION)
        at = taken[0].start if taken else 0
        summary = [*summary, Piece(at, at, f"{deciding[0]}:"), *taken]
    if summary:
        out.append(Chunk(f"{doc_id}/ficha", "ficha", head_line(meta, ["Ficha"]), summary))
    seen: Counter = Counter()
    for title, pieces in sections:
        name = title or "Inicio"
        slug = _GAP.sub("_", name.lower()).strip("_")[:30] or "inicio"
        seen[slug] += 1
        sid = f"{doc_id}/{slug}" + (f"~{seen[slug]}" if seen[slug] > 1 else "")
        groups = windows(pieces, WINDOW, True)
        for k, g in enumerate(groups, 1):
            label = f"{name} ({k}/{len(groups)})" if len(groups) > 1 else name
            out.append(Chunk(f"{sid}#{k}", "seccion", head_line(meta, [label]), g, part=k, parts=len(groups), section=name, section_id=sid))
    return out


def chunks_of(meta: dict, markdown: str, base: int = 0) -> list[Chunk]:
    """The chunker for a document: rulings by type or id, everything else as a norm."""
    ruling = meta.get("tipo_documento") == "sentencia" or meta["doc_id"].startswith("jurisprudencia_")
    return (ruling_chunks if ruling else norm_chunks)(meta, markdown, base)


_SECTION = re.compile(r"(?:[IVX]+\. )?([A-ZÁÉÍÓÚÑ][A-ZÁÉÍÓÚÑ ]{3,}):?")
_OPENS = re.compile(r"(?:ARTÍCULO|Artículo|ART\.|Art\.) ?(\d+)[º°.]*\s*")


def markdown_of(text: str) -> str:
    """Plain legal text as Markdown: a title, sections, and articles parted from their text."""
    out = []
    for k, line in enumerate(text.split("\n")):
        if not k:
            out.append(f"# {line}\n")
        elif m := _OPENS.match(line):
            out.append(f"\n###### Artículo {m[1]}.\n\n{line[m.end() :]}")
        elif m := _SECTION.fullmatch(line.strip()):
            out.append(f"\n## {m[1].strip()}\n")
        else:
            out.append(line)
    return "\n".join(out)


_DDL = "doc_id string, orden int, chunk_id string, tipo_chunk string, articulo string, articulo_id string, ruta array<string>, derogado boolean, parte int, n_partes int, seccion string, inicio int, fin int, texto string"


def chunk_documents(docs: DataFrame) -> DataFrame:
    """Chunks of (doc_id string, md, tipo_documento): null ids and texts give none, an empty text gives none."""
    strings = pa.list_(pa.string())
    types = {"orden": pa.int32(), "parte": pa.int32(), "n_partes": pa.int32(), "inicio": pa.int32(), "fin": pa.int32(), "ruta": strings, "derogado": pa.bool_()}
    schema = pa.schema([(n, types.get(n, pa.string())) for n in (x.split()[0] for x in _DDL.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, md, kind in zip(*(c.to_pylist() for c in batch.columns)):
                for k, c in enumerate(chunks_of({"doc_id": doc_id, "tipo_documento": kind}, md)):
                    a, b = (c.body[0].start, c.body[-1].end) if c.body else (None, None)
                    rows.append((doc_id, k, c.chunk_id, c.kind, c.article, c.article_id, c.path, c.struck, c.part, c.parts, c.section, a, b, c.text))
            cols = list(zip(*rows)) if rows else [[] for _ in schema]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

    return docs.where(F.col("doc_id").isNotNull() & F.col("md").isNotNull()).select("doc_id", "md", "tipo_documento").mapInArrow(run, _DDL)


def markdown_documents(documents: DataFrame) -> DataFrame:
    """(doc_id, md, tipo_documento) of plain documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            md = pa.array([markdown_of(t) for t in batch.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), md, batch.column(2)], names=["doc_id", "md", "tipo_documento"])

    rows = documents.where("doc_id is not null and text is not null")
    rows = rows.select(F.col("doc_id").cast("string").alias("doc_id"), "text", F.when(F.col("tipo_documento") == "fallo", "sentencia").otherwise(F.col("tipo_documento")).alias("tipo_documento"))
    return rows.mapInArrow(run, "doc_id string, md string, tipo_documento string")
