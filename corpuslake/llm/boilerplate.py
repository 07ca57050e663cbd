"""Page boilerplate mixed with main content: keep the heading and the body of each page (problem 2).

Method: a linear-chain conditional random field over the leaf blocks of a page (its lines, each with the path of elements
open around it), trained on labelled pages by gradient ascent on the exact likelihood (forward-backward), decoded by
Viterbi. Four states: content, a line of the site, the head of a block of links, and what stands in such a block. The
features are the words of a block as consonant skeletons (garbled accents change nothing), its shape, the shapes and
edge words around it, its place, and its ancestors. No labelled pages come with the data, so the pages of a bounded
sample are labelled by fixed wordings and the blocks they open; the wordings serve the labels only and are no features.
Each training page is also shown without its words, so that a site that words them otherwise is judged by the rest.
Every page is decoded.

Defined results
    * null or text-less rows: no row; an empty table: no rows; repeated rows: each gives the same answer.
    * ``linea`` counts from 0 over the text split at line feeds; blank lines are never given.
    * a text without any site line gives nothing; very long texts are decoded whole.
    * ties in the decoding go to the lower state, content first; a sample without site lines finds nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame

from .base import keyed_texts, map_arrow, sample_rows, text_of

#: Rows that may be used to fit the field, and of those, texts without a site line (look-alikes three times as many).
PAGES_SAMPLE, PLAIN_SAMPLE = 12000, 600
# Wordings of site lines, as consonant skeletons of their beginnings.
SITE_STARTS = (
    "Volver arriba", "Síganos en redes:", "Política de tratamiento de datos |", "Conmutador:", "Versión para imprimir",
    "Última actualización:", "Horario de atención:", "Visitas:", "Lea también:", "Noticias relacionadas",
    "Lo más consultado", "Documentos relacionados", "Compartir en:", "Suscríbase al boletín.", "Cargando comentarios",
    "Publicidad", "¿Le fue útil esta página?", "Imprimir | Descargar", "Desarrollado por", "Powered by",
    "We use cookies", "Usamos cookies.", "Este sitio utiliza cookies", "Su privacidad es importante:",
    "Aviso de privacidad:", "Al hacer clic en", "Etiquetas:", "Inicio › Normas",
)
# Menu entries.
MENU = (
    "Inicio", "Normatividad", "Jurisprudencia", "Boletines", "Agenda", "PQRS", "Transparencia", "Notificaciones",
    "Directorio", "Biblioteca", "English", "Participa", "Glosario", "Convocatorias", "Ayuda", "Registrarse", "Relatoría",
    "Contáctenos", "Iniciar sesión", "Rendición de cuentas", "Sala de prensa", "Datos abiertos", "Mapa del sitio",
    "Calendario judicial", "Atención al ciudadano", "Trámites y servicios", "Preguntas frecuentes", "Buscador avanzado",
    "Ventanilla virtual",
)
_HEADERS = ("Lea también:", "Noticias relacionadas", "Lo más consultado", "Documentos relacionados")
_SLOGAN = ("Portal oficial de consulta", "Saltar al contenido", "Justicia al alcance", "Sistema de información normativa")
_SPLIT = re.compile(r"\s+(?:[^\w\s]|[^\x00-\x7f]|\?){1,6}\s+|\s{2,}")
_TITLE = re.compile(r"(?:[•→\-]|\S{1,6})?\s*(?:Ley|Decreto|Resoluci\S{1,6}n|Sentencia|C\S{1,6}digo)\s[^.:;,›\[]{3,60}")
_TEASER = re.compile(r"(?:…|(?<!\[)\.\.\.|â€¦|â\x80¦|ÔÇª|‚Ä¶)\s*(?:Ver m\S{1,6}s|\S{1,4})?$|\[Leer m\S{1,8}s\]$")
_COPYRIGHT = re.compile(r"\S{0,3}© ?\d{4} .*|\S{1,4} \d{4} \w+\. Todos los derechos reservados\.?")
_TOOLS = re.compile(r"Ir a: \[.*|A- A A\+.*")
_ADDRESS = re.compile(r"(?:Carrera|Calle|Avenida) \d+ No\. \S+, .*")
_BULLET = re.compile(r"^\s*(?:[•→·*]|â€¢|â†’|\?)\s")
_TAG = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9]*)[^<>]*>")
_VOID = {"br", "hr", "img", "input", "link", "meta"}
_PARTS = re.compile(r"[|›»/·•→—–]\s+|\s{2,}|\s-\s+")
_CONTACT = re.compile(r"\S@\S|https?:|www\.|©|\(\d{1,3}\) ?\d{3}")


#: Consonants and digits stay, everything else parts words or is dropped: vowels, accents and whatever garbling made of them.
class _Fold(dict):
    def __missing__(self, code: int) -> str | None:
        out = self[code] = None if code > 127 else chr(code) if chr(code).isalnum() else " "
        return out


_FOLD = _Fold({**{ord(v): None for v in "aeiou"}, **{ord(c): " " for c in "\t\r\x0b\x0c"}, 10: "\n"})

@lru_cache(1 << 16)
def skeleton(line: str) -> str:
    """Consonants of the line's words; vowels, accents, ñ and whatever garbling made of them are gone."""
    return " ".join(line.lower().translate(_FOLD).split())


_STARTS = tuple(skeleton(s) for s in SITE_STARTS)
_MENU = frozenset(skeleton(s) for s in MENU)
_HEADS = frozenset(skeleton(s) for s in _HEADERS)
_SLOGANS = tuple(skeleton(s) for s in _SLOGAN)


@lru_cache(1 << 17)
def kind(line: str) -> str:
    """What a stripped line looks like on its own: a site wording, a menu, a link, a teaser, or running text."""
    if not line:
        return "blank"
    if _TAG.search(line):
        line = _TAG.sub(" ", line).strip()
    s = skeleton(line)
    if s in _HEADS:
        return "header"
    if len(line) < 260 and not line[:1].islower():
        for k, start in enumerate(_STARTS):
            if s.startswith(start) and (len(s) == len(start) or s[len(start)] == " "):
                return f"site{k}"
    if len(line) < 90 and any(s.endswith(x) and s != x for x in _SLOGANS):
        return "slogan"
    if _TOOLS.fullmatch(line) and len(line) < 90:
        return "tools"
    if _COPYRIGHT.fullmatch(line):
        return "copyright"
    if _ADDRESS.fullmatch(line) and len(line) < 120:
        return "address"
    items = [x for x in (skeleton(p) for p in _SPLIT.split(_BULLET.sub("", line))) if x]
    hits = sum(x in _MENU for x in items)
    if items and hits >= max(1, 0.6 * len(items)):
        if len(items) > 1:
            return "menu"
        if _BULLET.sub("", line)[:1].isupper() and len(line) < 40:
            return "entry"
    if _TEASER.search(line) and len(line) < 220:
        return "teaser"
    if len(line) < 90 and _TITLE.fullmatch(line):
        return "link" if _BULLET.match(line) else "title"
    return "text"


_SURE = frozenset(("tools", "header", "slogan", "copyright", "address", "menu", "entry", "teaser", "link"))


def _sure(k: str) -> bool:
    return k in _SURE or k.startswith("site")


_DIGIT = re.compile(r"\d")
_CONTACT_MARKS = ("@", "http", "www.", "©")


def _path_of(lines: list[str]) -> list[tuple[str, ...]]:
    """The elements open where each line begins or, if it opens some, where its first text stands."""
    stack: list[str] = []
    out: list[tuple[str, ...]] = []
    for line in lines:
        at = None
        for m in _TAG.finditer(line) if "<" in line else ():
            if at is None and line[: m.start()].strip():
                at = tuple(stack)
            tag = m[2].lower()
            if m[1]:
                if tag in stack:
                    while stack.pop() != tag:
                        pass
            elif tag not in _VOID:
                stack.append(tag)
        out.append(tuple(stack) if at is None else at)
    return out


@lru_cache(1 << 16)
def _shape(line: str) -> tuple[str, str]:
    """(coarse, fine) shape of a stripped line: length, parts between separators, how it begins and ends, marks in it."""
    size = len(line).bit_length()
    parts = [p for p in map(str.strip, _PARTS.split(line)) if p]
    short = len(parts) if len(parts) > 1 and max(map(len, parts)) < 40 else 0
    end, first = line[-1], line[0]
    stop = end if end in ".;:,…)]?!↑" else "a" if end.isalpha() else "9" if end.isdigit() else "~"
    begin = "A" if first.isupper() else "a" if first.islower() else "9" if first.isdigit() else "[" if first in "[({" else "•" if not first.isalnum() else "?"
    caps = all(p[:1].isupper() for p in parts)
    inner = f"{'›' in line:d}{'[vigencia' in line:d}{'. ' in line:d}{any(x in line for x in _CONTACT_MARKS):d}{_DIGIT.search(line) is not None:d}{'|' in line:d}{line.isupper():d}"
    coarse = f"{min(size, 9)}{stop}{begin}{min(short, 4)}"
    return coarse, f"{size}|{stop}|{begin}|{min(short, 6)}|{caps:d}|{inner}"


def page_features(text: str, blind: bool = False) -> tuple[list[int], list[tuple[list[str], list[str]]]]:
    """Indexes of the non-blank lines, and of each its (features, words); ``blind`` leaves all words out."""
    lines = text.split("\n")
    folded = [] if blind else text.lower().translate(_FOLD).split("\n")
    at = [i for i, x in enumerate(lines) if x and not x.isspace()]
    paths = _path_of(lines) if "<" in text else None
    n = len(at)
    shapes = [_shape(lines[i].strip()) for i in at]
    words = [[] if blind else folded[i].split() for i in at] if blind or len(folded) == len(lines) else [[] for _ in at]
    out = []
    for j, i in enumerate(at):
        (coarse, fine), ws = shapes[j], words[j]
        before, after = shapes[j - 1][0] if j else "^", shapes[j + 1][0] if j + 1 < n else "$"
        gap = "g" if i and not lines[i - 1].strip() else "-"
        edge = f"{min(j, 3)}{min(n - 1 - j, 4)}"
        f = [
            "bias", "s" + coarse, "S" + fine, f"b{before}>{coarse}", f"a{coarse}<{after}", f"c{before}>{coarse}<{after}",
            f"g{gap}{coarse}", f"e{edge}", f"e{edge}{coarse}", f"G{gap}{before}>{coarse}",
        ]
        if paths is not None and paths[i]:
            f += ["t" + t for t in set(paths[i])]
            f.append("T" + ">".join(paths[i]))
        if not blind:
            head, tail = " ".join(ws[:2]), " ".join(ws[-2:])
            f += [f"h{head}", f"l{tail}", f"H{head}|{coarse}"]
            if j:
                up = words[j - 1]
                f += [f"p{' '.join(up[:2])}", f"q{' '.join(up[-2:])}", f"P{' '.join(up[:2])}|{coarse}"]
            if j + 1 < n:
                f.append(f"n{' '.join(words[j + 1][:2])}")
        out.append((f, ws))
    return at, out


#: States of the field; every one but CONTENT is a site line.
CONTENT, SITE, HEAD, BLOCK = range(4)


def weak_labels(lines: list[str]) -> list[int]:
    """Labels of the non-blank lines of a training page, from the fixed wordings and the blocks they open."""
    at = [i for i, x in enumerate(lines) if x.strip()]
    kinds = [kind(lines[i].strip()) for i in at]
    out = [HEAD if k == "header" else int(_sure(k)) for k in kinds]
    inside = False
    for j, k in enumerate(kinds):
        line = lines[at[j]].strip()
        if k == "header":
            inside = True
        elif k in ("title", "link", "teaser") and inside and "[vigencia" not in line and "›" not in line:
            out[j] = BLOCK
        elif k == "title" and j and j + 1 < len(kinds) and kinds[j + 1] == "teaser":
            out[j] = BLOCK
        elif k == "text" and inside and len(line) < 175 and line.count(". ") == 0 and j + 1 < len(kinds) and kinds[j - 1] in ("title", "link") and kinds[j + 1] in ("title", "link"):
            out[j] = BLOCK
        elif k == "text":
            inside = False
    return out


class Crf:
    """Linear-chain field over the four states; weights are relative to CONTENT, whose emission is 0."""

    def __init__(self) -> None:
        self.ids: dict[str, int] = {}
        self.w = np.zeros((1, 4))  # the last row stands for features that the sample does not have
        self.trans = np.zeros((4, 4))

    def _rows(self, pages: list[list[tuple[list[str], list[str]]]], grow: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(feature, block, value) of every feature of every block; a block's words share one unit of weight."""
        blocks = list(chain.from_iterable(pages))
        names = list(chain.from_iterable(chain(f, ["w" + w for w in ws]) for f, ws in blocks))
        if grow:
            for name in names:
                self.ids.setdefault(name, len(self.ids))
        get, none = self.ids.get, len(self.ids)
        ids = np.fromiter((get(x, none) for x in names), np.int64, len(names))
        nf, nw = np.array([len(f) for f, _ in blocks], np.int64), np.array([len(ws) for _, ws in blocks], np.int64)
        row = np.repeat(np.arange(len(blocks)), nf + nw)
        value = np.ones(len(ids))
        start = np.concatenate([[0], np.cumsum(nf + nw)])[:-1]
        is_word = np.arange(len(ids)) - start[row] >= nf[row]
        value[is_word] = (2.0 / np.sqrt(np.maximum(1, nw)))[row][is_word]
        return ids, row, value

    def emissions(self, pages: list[list[tuple[list[str], list[str]]]]) -> np.ndarray:
        """(blocks, states), the pages one after the other."""
        ids, row, value = self._rows(pages)
        n = sum(map(len, pages))
        out = np.zeros((n, 4))
        for y in (1, 2, 3):
            out[:, y] = np.bincount(row, self.w[ids, y] * value, n)
        return out

    @staticmethod
    def _steps(sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each place in a page: the pages that reach it (longest first), and their blocks there."""
        order = np.argsort(-sizes, kind="stable")
        start = (np.cumsum(sizes) - sizes)[order]
        left = sizes[order]
        for t in range(int(left[0]) if len(left) else 0):
            k = int(np.searchsorted(-left, -t, side="left"))
            yield order[:k], start[:k] + t

    def fit(self, pages: list[tuple[list[tuple[list[str], list[str]]], list[int]]], rounds: int = 40, rate: float = 0.4, decay: float = 2e-3) -> None:
        """AdaGrad on the log-likelihood of all pages at once; exact gradients by forward-backward, page places in step."""
        pages = [p for p in pages if p[1]]
        if not any(any(labels) for _, labels in pages):
            return
        ids, row, value = self._rows([f for f, _ in pages], grow=True)
        gold = np.array(list(chain.from_iterable(labels for _, labels in pages)))
        sizes = np.array([len(labels) for _, labels in pages])
        n, v = len(gold), len(self.ids)
        w, grads = np.zeros((v + 1, 4)), np.full((v + 1, 4), 1e-6)
        trans, tg = np.zeros((4, 4)), np.full((4, 4), 1e-6)
        truth = np.zeros((n, 4))
        truth[np.arange(n), gold] = 1.0
        steps = list(self._steps(sizes))
        follow = np.ones(n, bool)
        follow[np.cumsum(sizes) - 1] = False
        seen = np.zeros((4, 4))
        np.add.at(seen, (gold[:-1][follow[:-1]], gold[1:][follow[:-1]]), 1.0)
        for _ in range(rounds):
            e = np.stack([np.bincount(row, w[ids, y] * value, n) for y in range(4)], axis=1)
            alpha, beta = np.zeros((n, 4)), np.zeros((n, 4))
            last = None
            for _, at in steps:
                if last is None:
                    alpha[at] = e[at]
                else:
                    alpha[at] = e[at] + _lse(alpha[last[: len(at)], :, None] + trans[None], 1)
                last = at
            pairs = np.zeros((4, 4))
            for k in range(len(steps) - 2, -1, -1):
                here, nxt = steps[k][1][: len(steps[k + 1][1])], steps[k + 1][1]
                ahead = trans[None] + (e[nxt] + beta[nxt])[:, None, :]
                beta[here] = _lse(ahead, 2)
                z = _lse(alpha[here] + beta[here], 1)
                pairs += np.exp(alpha[here][:, :, None] + ahead - z[:, None, None]).sum(0)
            z = _lse(alpha + beta, 1)
            miss = truth - np.exp(alpha + beta - z[:, None])
            for y in (1, 2, 3):
                g = np.bincount(ids, miss[row, y] * value, v + 1) - decay * w[:, y]
                grads[:, y] += g * g
                w[:, y] += rate * g / np.sqrt(grads[:, y])
            g = seen - pairs - decay * trans
            tg += g * g
            trans += rate * g / np.sqrt(tg)
        w[v] = 0.0
        kept = np.flatnonzero(np.abs(w).max(1) > 1e-3)
        kept = kept[kept < v]
        names = list(self.ids)
        self.ids = {names[i]: k for k, i in enumerate(kept.tolist())}
        self.w, self.trans = np.concatenate([w[kept], w[v:]]), trans

    def decode(self, pages: list[list[tuple[list[str], list[str]]]]) -> list[np.ndarray]:
        """Viterbi over many pages in step: the states of each page's blocks; a tie goes to the lower state."""
        sizes = np.array([len(p) for p in pages], np.int64)
        if not sizes.sum():
            return [np.empty(0, np.int64) for _ in pages]
        return np.split(self.viterbi(self.emissions(pages), sizes), np.cumsum(sizes)[:-1])

    def viterbi(self, e: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        score, back, out = e.copy(), np.zeros(e.shape, np.int64), np.zeros(len(e), np.int64)
        steps, last = list(self._steps(sizes)), None
        for _, at in steps:
            if last is not None:
                paths = score[last[: len(at)], :, None] + self.trans[None]
                back[at] = paths.argmax(1)
                score[at] = e[at] + paths.max(1)
            last = at
        for k in range(len(steps) - 1, -1, -1):
            at = steps[k][1]
            longer = len(steps[k + 1][1]) if k + 1 < len(steps) else 0
            out[at[longer:]] = score[at[longer:]].argmax(1)
            if longer:
                nxt = steps[k + 1][1]
                out[at[:longer]] = back[nxt, out[nxt]]
        return out

    def pages_lines(self, texts: list[str]) -> list[list[int]]:
        """Indexes of the lines of each text that belong to the site."""
        if not self.ids:
            return [[] for _ in texts]
        read = [page_features(t) for t in texts]
        states = self.decode([f for _, f in read])
        return [[i for i, y in zip(at, ys) if y] for (at, _), ys in zip(read, states)]

    def site_lines(self, text: str) -> list[int]:
        return self.pages_lines([text])[0]

    def main_text(self, text: str, drop: list[int] | None = None) -> str:
        """The page without its site lines; blank lines are kept single."""
        gone = set(self.site_lines(text) if drop is None else drop)
        kept = "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone)
        return re.sub(r"\n{3,}", "\n\n", kept).strip("\n") if gone else text


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis, keepdims=True)
    return np.squeeze(m, axis) + np.log(np.exp(x - m).sum(axis))


def fit(texts: Iterable[str], plain: int = PLAIN_SAMPLE) -> Crf:
    """A field from a sample: every page with site lines, look-alikes of such lines, and some plain texts."""
    pages, others = [], 0
    site_words = {w for s in (*SITE_STARTS, *_SLOGAN) for w in skeleton(s).split() if len(w) > 3}
    for text in texts:
        labels = weak_labels(text.split("\n"))
        if not labels:
            continue
        if not any(labels):
            if others >= plain and (others >= 3 * plain or site_words.isdisjoint(text.lower().translate(_FOLD).split())):
                continue
            others += 1
        else:
            pages.append((page_features(text, blind=True)[1], labels))
        pages.append((page_features(text)[1], labels))
    model = Crf()
    if pages:
        model.fit(pages)
    return model


def fit_model(chunks: DataFrame) -> Crf:
    """Fitted on about ``PAGES_SAMPLE`` records (see :func:`base.sample_rows`)."""
    raw = sample_rows(chunks, "chunk_id", "datos", rows=PAGES_SAMPLE, seed="pages")
    return fit(t for t in (text_of("chunks", r) for r in raw) if t)


def _read(model: Crf, cols: list[list], block: int = 500) -> Iterator[tuple[str, str, str, list[int]]]:
    """(tabla, clave, text, site lines) of the rows of a batch, decoded ``block`` pages at a time."""
    tablas, claves, values = cols
    for a in range(0, len(values), block):
        texts = [text_of(t, v) or "" for t, v in zip(tablas[a : a + block], values[a : a + block])]
        for k, lines in enumerate(model.pages_lines(texts)):
            yield tablas[a + k], claves[a + k], texts[k], lines


def site_lines(chunks: DataFrame, pasajes: DataFrame, model: Crf | None = None) -> DataFrame:
    """(tabla, clave, linea): each line that belongs to the site."""
    model = model or fit_model(chunks)

    def run(cols: list[list]) -> list[list]:
        out: list[list] = [[], [], []]
        for tabla, clave, _, lines in _read(model, cols):
            for i in lines:
                for col, v in zip(out, (tabla, clave, i)):
                    col.append(v)
        return out

    return map_arrow(keyed_texts(chunks, pasajes), "tabla string, clave string, linea int", run)


def main_texts(chunks: DataFrame, pasajes: DataFrame, model: Crf | None = None) -> DataFrame:
    """(tabla, clave, principal): the main body of each page that has site lines."""
    model = model or fit_model(chunks)

    def run(cols: list[list]) -> list[list]:
        out: list[list] = [[], [], []]
        for tabla, clave, text, lines in _read(model, cols):
            if lines and (body := model.main_text(text, lines)) != text:
                for col, v in zip(out, (tabla, clave, body)):
                    col.append(v)
        return out

    return map_arrow(keyed_texts(chunks, pasajes), "tabla string, clave string, principal string", run)


def found(chunks: DataFrame, pasajes: DataFrame) -> DataFrame:
    return site_lines(chunks, pasajes).distinct()
