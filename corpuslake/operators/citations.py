"""Citations of legal texts down to the article: (body, number, year, article).

A text is normalised once and scanned for mentions (numbered norms, laws known by number alone, codes by their names,
rulings); the articles that stand right before or right after a mention belong to it. Scanning needs positions, so it
runs in Arrow batches; everything after it is joins and aggregates on the rows it gives.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tokens import fold, full_year

# Bodies that are cited by name, and their names and short forms in folded text.
CODES = {
    "constitucion": ("constitucion politica", "constitucion nacional", "constitucion", "c.p.", "cp", "c.n.", "carta politica"),
    "codigo_civil": ("codigo civil", "c.c.", "cc", "c.c"),
    "codigo_penal": ("codigo penal", "ley 599 de 2000", "c.p.p", "codigo penal colombiano"),
    "codigo_procedimiento_penal": ("codigo de procedimiento penal", "ley 906 de 2004", "cpp"),
    "codigo_comercio": ("codigo de comercio", "codigo del comercio", "c.co.", "cco"),
    "codigo_sustantivo_trabajo": ("codigo sustantivo del trabajo", "c.s.t.", "cst"),
    "codigo_procesal_trabajo": ("codigo procesal del trabajo", "cpts", "cpt"),
    "codigo_general_proceso": ("codigo general del proceso", "ley 1564 de 2012", "cgp"),
    "cpaca": ("codigo de procedimiento administrativo y de lo contencioso administrativo", "ley 1437 de 2011", "cpaca"),
    "estatuto_tributario": ("estatuto tributario", "decreto 624 de 1989", "e.t.", "et"),
    "codigo_infancia": ("codigo de la infancia y la adolescencia", "ley 1098 de 2006"),
    "codigo_nacional_policia": ("codigo nacional de seguridad y convivencia ciudadana", "codigo nacional de policia", "ley 1801 de 2016"),
    "codigo_disciplinario": ("codigo general disciplinario", "codigo disciplinario unico", "ley 1952 de 2019"),
    "estatuto_consumidor": ("estatuto del consumidor", "estatuto de proteccion al consumidor", "ley 1480 de 2011"),
    "decision_andina_486": ("decision 486 de la comision de la comunidad andina", "decision andina 486", "decision 486"),
}
# Norms that are cited by number alone, and the body each one is.
KNOWN_BY_NUMBER = {
    ("ley", "599"): "codigo_penal", ("ley", "906"): "codigo_procedimiento_penal", ("ley", "1564"): "codigo_general_proceso",
    ("ley", "1437"): "cpaca", ("ley", "1098"): "codigo_infancia", ("ley", "1801"): "codigo_nacional_policia",
    ("ley", "1952"): "codigo_disciplinario", ("decreto", "624"): "estatuto_tributario", ("ley", "1480"): "estatuto_consumidor",
}
# Kinds of norms and the words for each.
KINDS = {
    "ley": ("ley", "leyes"),
    "decreto": ("decreto ley", "decreto-ley", "decreto legislativo", "decreto unico reglamentario", "decreto reglamentario", "decreto"),
    "acto_legislativo": ("acto legislativo",),
    "resolucion": ("resolucion",),
    "circular": ("circular externa", "circular"),
    "acuerdo": ("acuerdo",),
}
_KIND_OF = {word: kind for kind, words in KINDS.items() for word in words}
KIND_WORDS = "|".join(sorted(_KIND_OF, key=len, reverse=True))
NORM = rf"\b({KIND_WORDS})\s*(?:n[°ºo]?\.?\s*)?(\d{{1,5}})\s*(?:de|del|/|-)\s*(\d{{4}})\b"
RULING = r"\b(c|t|su|sl|sc|sp|stc|stl|ac|au)\s*[-\s]?\s*(\d{1,5})\s*(?:de|del|/|-)\s*(\d{2,4})\b"
_NORM, _RULING = re.compile(NORM), re.compile(RULING)
_NUMBER_ALONE = re.compile(r"\b(ley|decreto)\s*(?:n[°ºo]?\.?\s*)?(\d{2,5})\b(?!\s*(?:de|del|/|-)\s*\d{4})")
_CODES = {code: [re.compile(rf"(?<![\w.]){re.escape(n)}(?!\w)") for n in sorted(names, key=len, reverse=True)] for code, names in CODES.items()}
_MARKER = re.compile(r"\barts?\b\.?|\barticulos?\b")
_LIST = re.compile(r"[\s:.,;\-]*(\d+[a-z]?(?:\s*(?:,|y|e)\s*\d+[a-z]?)*)")
_IN_LIST = re.compile(r"\s*(?:,|\by\b|\be\b)\s*")
_CLOSED = re.compile(r"[.;]")
#: How far before and after a mention its articles are looked for.
BEFORE, AFTER, LIST_ROOM = 90, 60, 40


class Mention(NamedTuple):
    start: int
    end: int
    body: str
    number: str | None
    year: str | None


def normalise(text: str) -> str:
    return " ".join(fold(text).split())


def mentions(t: str) -> Iterator[Mention]:
    """Norms and codes of a normalised text, wherever they stand."""
    for m in _NORM.finditer(t):
        kind = _KIND_OF[m[1]]
        known = KNOWN_BY_NUMBER.get((kind, m[2]))
        yield Mention(m.start(), m.end(), known, None, None) if known else Mention(m.start(), m.end(), kind, m[2], m[3])
    for m in _NUMBER_ALONE.finditer(t):
        if known := KNOWN_BY_NUMBER.get((m[1], m[2])):
            yield Mention(m.start(), m.end(), known, None, None)
    for code, names in _CODES.items():
        # the longest name that occurs stands for all shorter ones
        spots = next((found for p in names if (found := list(p.finditer(t)))), [])
        for m in spots:
            yield Mention(m.start(), m.end(), code, None, None)


def listed(text: str) -> list[str]:
    """``13, 15 y 42`` at the beginning of a text as its numbers."""
    m = _LIST.match(text)
    return [n for n in _IN_LIST.split(m[1]) if n] if m else []


def articles_of(t: str, mention: Mention) -> list[str]:
    """Article numbers right before the mention, with no sentence end between, and right after it, with no word between."""
    out: list[str] = []
    before = t[max(0, mention.start - BEFORE) : mention.start]
    last = None
    for last in _MARKER.finditer(before):
        pass
    if last and not _CLOSED.search(before, last.end()):
        out += listed(before[last.end() :])
    after = t[mention.end : mention.end + AFTER]
    first = _MARKER.search(after)
    if first and not any(c.isalnum() or c == "_" for c in after[: first.start()]):
        out += listed(after[first.end() : first.end() + LIST_ROOM])
    return out


def extract(text: str) -> set[tuple[str, str | None, str | None, str | None]]:
    """Distinct citations of a text."""
    t = normalise(text)
    out: set[tuple[str, str | None, str | None, str | None]] = set()
    for m in mentions(t):
        out.update((m.body, m.number, m.year, a) for a in articles_of(t, m) or [None])
    for m in _RULING.finditer(t):
        out.add(("jurisprudencia", f"{m[1].upper()}-{int(m[2])}", full_year(m[3]), None))
    return out


_FIELDS = ("cuerpo", "numero", "anio", "articulo")


def citations(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, cuerpo, numero, anio, articulo): distinct citations of each text; null keys and texts give none."""
    kind = dict(df.dtypes)[key]
    rows = df.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(key, text)
    ddl = f"{key} {kind}, " + ", ".join(f"{f} string" for f in _FIELDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows_ = [], []
            for i, x in enumerate(batch.column(1).to_pylist()):
                got = extract(x)
                at += [i] * len(got)
                rows_ += got
            cols = [batch.column(0).take(pa.array(at, pa.int64())), *(pa.array([r[k] for r in rows_], pa.string()) for k in range(4))]
            yield pa.RecordBatch.from_arrays(cols, names=[key, *_FIELDS])

    return rows.mapInArrow(run, ddl).distinct()


def bodies(cites: DataFrame) -> DataFrame:
    """Citations without their articles."""
    return cites.drop("articulo").distinct()


def score(answers: DataFrame, basis: DataFrame, backing: DataFrame, ids: DataFrame) -> DataFrame:
    """(qid, n_ref, n_citadas, aciertos, respaldados, incorrectas, sin_respaldo) of bodies: what each answer of ``ids`` cites
    against its reference and against what its passages cite. An unbacked citation counts only outside the reference."""
    keys = ["qid", "cuerpo", "numero", "anio"]

    def flag(df: DataFrame, name: str) -> DataFrame:
        return df.select(*keys[:2], *[F.coalesce(k, F.lit("")).alias(k) for k in keys[2:]]).distinct().withColumn(name, F.lit(1))

    both = flag(answers, "a").join(flag(basis, "r"), keys, "full").join(flag(backing, "b"), keys, "left")
    a, r, b = (F.col(c).isNotNull() for c in "arb")
    per = both.groupBy("qid").agg(
        F.count_if(r).alias("n_ref"), F.count_if(a).alias("n_citadas"), F.count_if(a & r).alias("aciertos"), F.count_if(a & r & b).alias("respaldados"),
        F.count_if(a & ~r & b).alias("incorrectas"), F.count_if(a & ~r & ~b).alias("sin_respaldo"),
    )
    return ids.select("qid").distinct().join(per, "qid", "left").na.fill(0)


def points(scores: DataFrame) -> DataFrame:
    """Micro sums over all answers and the points of 20: hits, backed ones whole and others half, less twice the unbacked share."""
    s = scores.agg(*[F.sum(c).alias(c) for c in ("n_ref", "n_citadas", "aciertos", "respaldados", "incorrectas", "sin_respaldo")])
    hits = (F.col("respaldados") + 0.5 * (F.col("aciertos") - F.col("respaldados"))) / F.greatest("n_ref", F.lit(1))
    return s.withColumn("puntos", F.round(20.0 * F.greatest(F.lit(0.0), hits - 2.0 * F.col("sin_respaldo") / F.greatest("n_citadas", F.lit(1))), 4))
