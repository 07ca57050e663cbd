"""Queries of the training-text operators over whole tables, with production parameters, and the SQL of those that have any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import boilerplate, leakage, markup, mojibake, neardup, ocr, packing, residue, splitter, topn


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _on(fn: Callable[..., DataFrame], *tables: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf: fn(*(_t(spark, sf, t) for t in tables))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": _on(mojibake.found, "chunks"),
        "p1_repaired": _on(mojibake.repair_chunks, "chunks"),
        "p2_found": _on(boilerplate.found, "chunks", "pasajes"),
        "p2_main_text": _on(boilerplate.main_texts, "chunks", "pasajes"),
        "p3_found": _on(splitter.found, "chunks", "limites"),
        "p3_pieces": _on(splitter.distinct_pieces, "chunks", "limites"),
        "p3_rebuilt": _on(splitter.rebuilt, "chunks", "limites"),
        "p4_found": _on(neardup.found, "pasajes"),
        "p4_groups": _on(neardup.groups, "pasajes"),
        "p5_found": _on(ocr.found, "chunks"),
        "p5_repaired": _on(ocr.repair_chunks, "chunks"),
        "p6_found": _on(markup.found, "chunks", "pasajes"),
        "p6_clean_text": _on(markup.clean_texts, "chunks", "pasajes"),
        "p7_found": _on(topn.found, "pasajes"),
        "p8_bins": _on(packing.bins, "documents", "contenedores"),
        "p8_room": _on(packing.room, "documents", "contenedores"),
        "p9_found": _on(leakage.found, "documents", "preguntas"),
        "p9_leaks": _on(leakage.leaks, "documents", "preguntas"),
        "p10_found": _on(residue.found, "documents"),
        "p10_scores": _on(residue.scores, "documents"),
    }


_P3 = """
SELECT DISTINCT c.chunk_id
FROM chunks c JOIN limites l ON c.tipo_chunk = l.tipo_chunk
WHERE length(json_extract_string(c.datos, '$.texto')) > l.max_chars
"""

_P3_REBUILT = """
SELECT c.chunk_id, any_value(length(json_extract_string(c.datos, '$.texto'))) AS letras, any_value(md5(json_extract_string(c.datos, '$.texto'))) AS huella, true AS bajo_limite
FROM chunks c JOIN limites l ON c.tipo_chunk = l.tipo_chunk
WHERE length(json_extract_string(c.datos, '$.texto')) > l.max_chars GROUP BY c.chunk_id
"""

_P4 = r"""
WITH w AS (
    SELECT pasaje_id, regexp_extract_all(lower(min(texto)), '[\p{L}\p{N}]+') AS ws
    FROM pasajes WHERE texto IS NOT NULL AND pasaje_id IS NOT NULL GROUP BY pasaje_id
), s AS (
    SELECT DISTINCT pasaje_id, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS sh
    FROM (SELECT pasaje_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)
), n AS (SELECT pasaje_id, count(*) AS k FROM s GROUP BY pasaje_id),
both_ AS (
    SELECT a.pasaje_id AS x, b.pasaje_id AS y, count(*) AS k
    FROM s a JOIN s b ON a.sh = b.sh AND a.pasaje_id < b.pasaje_id GROUP BY 1, 2
)
SELECT x AS pasaje_id_a, y AS pasaje_id_b
FROM both_ JOIN n p ON p.pasaje_id = x JOIN n q ON q.pasaje_id = y
WHERE both_.k >= 0.6 * (p.k + q.k - both_.k) - 1e-9
"""

_P7 = """
WITH d AS (
    SELECT DISTINCT split_part(id, '/', 1) AS doc_id, id, pasaje_id, score FROM pasajes
    WHERE id IS NOT NULL AND score IS NOT NULL AND NOT isnan(score)
), r AS (
    SELECT doc_id, pasaje_id, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, id, pasaje_id) AS puesto FROM d
)
SELECT doc_id, CAST(puesto AS INTEGER) AS puesto, pasaje_id FROM r WHERE puesto <= 3
"""

_P9 = r"""
WITH f AS (
    SELECT id, pregunta AS t FROM preguntas UNION ALL SELECT id, respuesta_esperada FROM preguntas
), iw AS (SELECT id, regexp_extract_all(strip_accents(lower(t)), '[\p{L}\p{N}]+') AS ws FROM f WHERE t IS NOT NULL),
ig AS (
    SELECT DISTINCT id, array_to_string(ws[i:i + 12], ' ') AS g
    FROM (SELECT id, ws, unnest(range(1, len(ws) - 11)) AS i FROM iw WHERE len(ws) >= 13)
), dw AS (SELECT doc_id, regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}]+') AS ws FROM documents WHERE text IS NOT NULL),
dg AS (
    SELECT doc_id, array_to_string(ws[i:i + 12], ' ') AS g
    FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM dw WHERE len(ws) >= 13)
)
SELECT DISTINCT dg.doc_id, ig.id AS item_id FROM dg JOIN ig ON dg.g = ig.g
"""


def oracle_sql() -> dict[str, str]:
    return {"p3_found": _P3, "p3_rebuilt": _P3_REBUILT, "p4_found": _P4, "p7_found": _P7, "p9_found": _P9}
