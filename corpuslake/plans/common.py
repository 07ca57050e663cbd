"""Pieces that queries and their SQL share."""

from __future__ import annotations

from ..functions.text import ACCENTED, PLAIN
from ..functions.tokens import CHAMBERS

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query (spark, sf) under its function's name, with the SQL that gives the same rows."""

    def add(fn):
        Q[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return add


def j(field: str, kind: str | None = None) -> str:
    """SQL for a field of a chunk's JSON."""
    text = f"json_extract_string(datos, '$.{field}')"
    return f"CAST({text} AS {kind})" if kind else text


def fold(x: str) -> str:
    return f"translate(lower({x}), '{ACCENTED}', '{PLAIN}')"


def tokens(x: str) -> str:
    """Index tokens in SQL without look-around: groups that share a digit are joined by repeated replacement."""
    y = f"strip_accents(lower({x}))"
    for _ in range(3):
        y = rf"regexp_replace({y}, '(\d)\.(\d\d\d)\b', '\1\2', 'g')"
    ruling = rf"\b({'|'.join(CHAMBERS)})\s*-\s*0*(\d{{1,5}})([a-z]?)"
    year = r"\s*(?:/|-|\bde\b|\bdel\b)\s*"
    for tail, full in ((rf"{year}(\d{{4}})\b", r"\4"), (rf"{year}([0-4]\d)\b", r"20\4"), (rf"{year}([5-9]\d)\b", r"19\4"), ("", "")):
        y = rf"regexp_replace({y}, '{ruling}{tail}', ' \1_\2\3 {full} ', 'g')"
    for _ in range(2):
        y = rf"regexp_replace({y}, '([\p{{L}}\p{{N}}_])[-.](\d)', '\1_\2', 'g')"
    return rf"regexp_extract_all({y}, '[\p{{L}}\p{{N}}_]+')"


#: Distinct chunks.
CH = "ch AS (SELECT DISTINCT chunk_id, doc_id, articulo_id, seccion_id, tipo_chunk, datos FROM chunks WHERE datos IS NOT NULL)"
#: Distinct passages with their document.
PA = "pa AS (SELECT DISTINCT pasaje_id, pregunta_id, id, texto, metadatos, score, split_part(id, '/', 1) AS doc_id FROM pasajes)"
#: The manifest as it stands.
MA = "ma AS (SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY recibido_en DESC) AS n FROM descargas) WHERE n = 1)"
