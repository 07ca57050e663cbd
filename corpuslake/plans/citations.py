"""Citations down to the article, and answers scored by what they cite."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import citations as C
from ..operators import search as S
from ..sources.tables import passages, table
from .common import PA, query

_SPACE = r"[\s\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x1C-\x1F]+"
_FIX = "CASE {n} " + " ".join(f"WHEN '{k} {n}' THEN '{body}'" for (k, n), body in C.KNOWN_BY_NUMBER.items()) + " END"


def _bodies(source: str, key: str, text: str, name: str) -> str:
    """SQL for the bodies that texts cite: (key, cuerpo, numero, anio). Whether a body is cited needs no positions."""
    kind = "CASE " + " ".join(f"WHEN w IN ({', '.join(repr(x) for x in words)}) THEN '{k}'" for k, words in C.KINDS.items()) + " END"
    year = "CASE WHEN length(y) = 2 THEN CASE WHEN CAST(y AS INTEGER) < 50 THEN '20' ELSE '19' END || y ELSE y END"
    known = _FIX.format(n="k || ' ' || num")
    codes = " UNION ALL ".join(
        f"SELECT {key} AS key_, '{code}', NULL, NULL FROM {name}_t WHERE " + " OR ".join(f"regexp_matches(x, '(^|[^\\p{{L}}\\p{{N}}_.]){n.replace('.', chr(92) + '.')}($|[^\\p{{L}}\\p{{N}}_])')" for n in names)
        for code, names in C.CODES.items()
    )
    alone = " UNION ALL ".join(f"SELECT {key}, '{body}', NULL, NULL FROM {name}_t WHERE regexp_matches(x, '\\b{k}\\s*(?:n[°ºo]?\\.?\\s*)?{n}\\b')" for (k, n), body in C.KNOWN_BY_NUMBER.items())
    return rf"""{name}_t AS (SELECT {key}, trim(regexp_replace(strip_accents(lower({text})), '{_SPACE}', ' ', 'g')) AS x FROM {source} WHERE {text} IS NOT NULL AND {key} IS NOT NULL),
    {name}_n AS (SELECT {key}, unnest(regexp_extract_all(x, '{C.NORM}')) AS m FROM {name}_t), {name}_r AS (SELECT {key}, unnest(regexp_extract_all(x, '{C.RULING}')) AS m FROM {name}_t),
    {name}_k AS (SELECT {key}, {kind} AS k, num, y FROM (SELECT {key}, regexp_extract(m, '{C.NORM}', 1) AS w, regexp_extract(m, '{C.NORM}', 2) AS num, regexp_extract(m, '{C.NORM}', 3) AS y FROM {name}_n)),
    {name} AS (SELECT DISTINCT * FROM (SELECT {key} AS key_, coalesce({known}, k) AS cuerpo, CASE WHEN {known} IS NULL THEN num END AS numero, CASE WHEN {known} IS NULL THEN y END AS anio FROM {name}_k
    UNION ALL SELECT {key}, 'jurisprudencia', upper(regexp_extract(m, '{C.RULING}', 1)) || '-' || CAST(CAST(regexp_extract(m, '{C.RULING}', 2) AS INTEGER) AS VARCHAR), (SELECT {year} FROM (SELECT regexp_extract(m, '{C.RULING}', 3) AS y)) FROM {name}_r
    UNION ALL {codes} UNION ALL {alone}))"""


@query(f"WITH {_bodies('documents', 'doc_id', 'text', 'c')} SELECT key_ AS doc_id, cuerpo, numero, anio FROM c")
def cited_bodies(spark, sf):
    """Bodies that the training texts cite: numbered norms, laws known by number, codes by name, rulings."""
    return C.bodies(C.citations(table(spark, sf, "documents"), "doc_id", "text"))


@query()
def cited_units(spark, sf):
    """The same with the articles that stand by each mention."""
    return C.citations(table(spark, sf, "documents"), "doc_id", "text")


def _answers(spark, sf):
    """(qid, texto, rank) of the first ten passages of each question; the first one stands for an extractive answer."""
    rows = passages(spark, sf).where("score is not null and not isnan(score) and pregunta_id is not null and texto is not null")
    top = S.ranked(rows.select(F.col("pregunta_id").alias("qid"), "pasaje_id", "id", "score"), ["qid"], [F.col("score").desc(), F.col("id"), F.col("pasaje_id")], 10)
    return top.join(rows.select("pasaje_id", "texto"), "pasaje_id").select("qid", "texto", "rank")


def _scores(spark, sf):
    tops, q = _answers(spark, sf), table(spark, sf, "preguntas").select(F.col("id").alias("qid"), "legal_basis")
    basis = C.bodies(C.citations(q, "qid", "legal_basis"))
    asked = tops.join(q.select("qid"), "qid", "left_semi")
    answers = C.bodies(C.citations(asked.where("rank = 1"), "qid", "texto"))
    return C.score(answers, basis, C.bodies(C.citations(asked, "qid", "texto")), q)


_SC = f"""{PA}, o AS (SELECT pregunta_id AS qid, texto, row_number() OVER (PARTITION BY pregunta_id ORDER BY score DESC, id, pasaje_id) AS rank FROM pa WHERE score IS NOT NULL AND NOT isnan(score) AND pregunta_id IS NOT NULL AND texto IS NOT NULL),
    tops AS (SELECT o.* FROM o JOIN preguntas q ON q.id = o.qid WHERE rank <= 10), one AS (SELECT * FROM tops WHERE rank = 1), {_bodies('preguntas', 'id', 'legal_basis', 'r')}, {_bodies('one', 'qid', 'texto', 'a')}, {_bodies('tops', 'qid', 'texto', 'b')},
    j AS (SELECT coalesce(a.key_, r.key_) AS qid, a.key_ IS NOT NULL AS a, r.key_ IS NOT NULL AS r, EXISTS (SELECT 1 FROM b WHERE b.key_ = a.key_ AND b.cuerpo = a.cuerpo AND b.numero IS NOT DISTINCT FROM a.numero AND b.anio IS NOT DISTINCT FROM a.anio) AS b
        FROM a FULL JOIN r ON a.key_ = r.key_ AND a.cuerpo = r.cuerpo AND coalesce(a.numero, '') = coalesce(r.numero, '') AND coalesce(a.anio, '') = coalesce(r.anio, '')),
    s AS (SELECT q.id AS qid, count(*) FILTER (r) AS n_ref, count(*) FILTER (a) AS n_citadas, count(*) FILTER (a AND r) AS aciertos, count(*) FILTER (a AND r AND b) AS respaldados, count(*) FILTER (a AND NOT r AND b) AS incorrectas, count(*) FILTER (a AND NOT r AND NOT b) AS sin_respaldo FROM preguntas q LEFT JOIN j ON j.qid = q.id GROUP BY q.id)"""


@query(f"WITH {_SC} SELECT * FROM s")
def citation_scores(spark, sf):
    """What each extractive answer (the text of the best passage) cites, against the question's basis, backed by the
    citations of its first ten passages."""
    return _scores(spark, sf)


@query(f"WITH {_SC}, g AS (SELECT CAST(sum(n_ref) AS BIGINT) AS n_ref, CAST(sum(n_citadas) AS BIGINT) AS n_citadas, CAST(sum(aciertos) AS BIGINT) AS aciertos, CAST(sum(respaldados) AS BIGINT) AS respaldados, CAST(sum(incorrectas) AS BIGINT) AS incorrectas, CAST(sum(sin_respaldo) AS BIGINT) AS sin_respaldo FROM s) SELECT *, round(20.0 * greatest(0.0, CAST(respaldados + 0.5 * (aciertos - respaldados) AS DOUBLE) / greatest(n_ref, 1) - CAST(2.0 * sin_respaldo AS DOUBLE) / greatest(n_citadas, 1)), 4) AS puntos FROM g")
def citation_score(spark, sf):
    """The points of all answers, from micro sums."""
    return C.points(_scores(spark, sf))
