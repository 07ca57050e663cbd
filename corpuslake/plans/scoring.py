"""Citation, answer and evaluation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import cite, evaluate
from ..operators import search as S
from ..sources.tables import chunks, passages, table
from .common import CH, PA, fold, j, query

_NORM = r"\b(ley|decreto|resolucion) (?:no\. ?|numero )?(\d{1,6}) de (\d{4})"
_RUL = r"\bsentencia (t|c|su|sl|sc|stl|stc)-?(\d{1,6})(?: de |[-/])(\d{4}|\d{2})\b"
_YEAR = "CASE WHEN y >= 1000 THEN y WHEN y < 50 THEN y + 2000 ELSE y + 1900 END"
_CI = rf"""cm AS (SELECT DISTINCT doc_id AS k, unnest(regexp_extract_all(x, '{_NORM}')) AS m, 0 AS r FROM (SELECT doc_id, {fold('text')} AS x FROM documents WHERE text IS NOT NULL)
    UNION ALL SELECT DISTINCT doc_id, unnest(regexp_extract_all(x, '{_RUL}')), 1 FROM (SELECT doc_id, {fold('text')} AS x FROM documents WHERE text IS NOT NULL)),
    ci AS (SELECT DISTINCT k, CASE r WHEN 1 THEN 'sentencia' ELSE regexp_extract(m, '{_NORM}', 1) END AS cuerpo,
        CASE r WHEN 1 THEN regexp_extract(m, '{_RUL}', 1) || '-' || CAST(TRY_CAST(regexp_extract(m, '{_RUL}', 2) AS INTEGER) AS VARCHAR) ELSE CAST(TRY_CAST(regexp_extract(m, '{_NORM}', 2) AS INTEGER) AS VARCHAR) END AS numero,
        CASE r WHEN 1 THEN (SELECT {_YEAR} FROM (SELECT TRY_CAST(regexp_extract(m, '{_RUL}', 3) AS INTEGER) AS y)) ELSE TRY_CAST(regexp_extract(m, '{_NORM}', 3) AS INTEGER) END AS anio FROM cm)"""
_CA = """ca AS (SELECT DISTINCT doc_id, CASE split_part(doc_id, '_', 1) WHEN 'jurisprudencia' THEN 'sentencia' ELSE split_part(doc_id, '_', 1) END AS cuerpo,
    CASE WHEN doc_id LIKE 'codigo%' THEN NULL ELSE regexp_extract(doc_id, '^[a-z]+_(.+)_[0-9]+$', 1) END AS numero, CAST(regexp_extract(doc_id, '_([0-9]+)$', 1) AS INTEGER) AS anio FROM ch)"""


def _cites(spark, sf):
    docs = table(spark, sf, "documents").where("text is not null").select(F.col("doc_id").alias("k"), T.fold("text").alias("x"))
    return cite.extract(docs, "k", F.col("x"))


@query(f"WITH {_CI} SELECT k AS doc_id, cuerpo, numero, anio FROM ci")
def cite_extract(spark, sf):
    """Citations of norms and rulings in the training texts."""
    return _cites(spark, sf).withColumnRenamed("k", "doc_id")


@query(f"WITH {CH}, {_CI}, {_CA} SELECT ci.k, ci.cuerpo, ci.numero, ci.anio, ca.doc_id FROM ci LEFT JOIN ca ON ci.cuerpo = ca.cuerpo AND ci.numero IS NOT DISTINCT FROM ca.numero AND ci.anio IS NOT DISTINCT FROM ca.anio")
def cite_join_nullsafe(spark, sf):
    """Citations with the documents they name, null-safe."""
    return cite.resolve(_cites(spark, sf), chunks(spark, sf).select("doc_id"))


@query(f"WITH {CH}, {_CI}, {_CA} SELECT cuerpo, count(*) AS citas, count(DISTINCT k) AS textos FROM ci WHERE NOT EXISTS (SELECT 1 FROM ca WHERE ci.cuerpo = ca.cuerpo AND ci.numero = ca.numero AND ci.anio = ca.anio) GROUP BY cuerpo")
def cite_invalid_antijoin(spark, sf):
    """Citations of norms that name no document of the corpus, counted by body."""
    known = cite.canonical(chunks(spark, sf).select("doc_id")).select("cuerpo", "numero", "anio").distinct()
    return _cites(spark, sf).join(known, ["cuerpo", "numero", "anio"], "left_anti").groupBy("cuerpo").agg(F.count("*").alias("citas"), F.count_distinct("k").alias("textos"))


@query(f"WITH {_CI} SELECT k AS doc_id, cuerpo, numero, anio, CAST(dense_rank() OVER (PARTITION BY k ORDER BY cuerpo, numero, anio) AS INTEGER) AS marca FROM ci")
def cite_numbering(spark, sf):
    """Citations of a text numbered in order."""
    return S.ranked(_cites(spark, sf), ["k"], [F.col("cuerpo"), F.col("numero"), F.col("anio")], None, "marca").withColumnRenamed("k", "doc_id")


_REL = rf"""rel AS (SELECT DISTINCT q.id AS qid, ch.articulo_id AS doc FROM preguntas q JOIN ch ON {j('articulo')} = regexp_extract(q.legal_basis, 'artículo ([0-9.]+)', 1) AND {j('titulo')} = split_part(q.legal_basis, ',', 1) WHERE q.legal_basis IS NOT NULL AND ch.articulo_id IS NOT NULL)"""
_HIT = """hi AS (SELECT pregunta_id AS qid, coalesce(articulo_id, id) AS doc, row_number() OVER (PARTITION BY pregunta_id ORDER BY score DESC, id, pasaje_id) AS rank FROM pa LEFT JOIN ch ON pa.id = ch.chunk_id WHERE score IS NOT NULL AND NOT isnan(score) AND pregunta_id IS NOT NULL)"""
_MET = """f AS (SELECT qid, doc, min(rank) AS rank FROM hi WHERE rank <= 100 GROUP BY qid, doc),
    p AS (SELECT rel.qid, count(*) AS n_rel, count(rank) AS n, min(rank) AS best, sum(1 / log2(rank + 1.0)) AS gain FROM rel LEFT JOIN f ON rel.qid = f.qid AND rel.doc = f.doc GROUP BY rel.qid),
    m AS (SELECT qid, n_rel, round(n / CAST(n_rel AS DOUBLE), 6) AS recall, round(coalesce(1.0 / best, 0), 6) AS rr, round(coalesce(gain, 0) / list_sum(list_transform(range(1, least(n_rel, 100) + 1), lambda i: 1 / log2(i + 1.0))), 6) AS ndcg FROM p)"""


def _relevant(spark, sf):
    q = table(spark, sf, "preguntas").where("legal_basis is not null").select(F.col("id").alias("qid"), F.regexp_extract("legal_basis", "artículo ([0-9.]+)", 1).alias("articulo"), F.substring_index("legal_basis", ",", 1).alias("titulo"))
    c = chunks(spark, sf, "articulo", "titulo").where("articulo_id is not null").select("articulo", "titulo", F.col("articulo_id").alias("doc"))
    return q.join(c, ["articulo", "titulo"]).select("qid", "doc").distinct()


def _hits(spark, sf, k: int = 100):
    rows = passages(spark, sf).where("score is not null and not isnan(score) and pregunta_id is not null").select("pregunta_id", "id", "pasaje_id", "score")
    top = S.ranked(rows, ["pregunta_id"], [F.col("score").desc(), F.col("id"), F.col("pasaje_id")], k)
    c = chunks(spark, sf).select("chunk_id", "articulo_id")
    return top.join(c, F.col("id") == F.col("chunk_id"), "left").select(F.col("pregunta_id").alias("qid"), F.coalesce("articulo_id", "id").alias("doc"), "rank")


@query(f"WITH {CH}, {PA}, {_REL}, {_HIT}, {_MET} SELECT qid, n_rel, recall, rr, ndcg FROM m")
def retrieval_metrics(spark, sf):
    """Recall, reciprocal rank and gain of each question against its legal basis."""
    return evaluate.retrieval_metrics(_hits(spark, sf), _relevant(spark, sf), 100)


@query(f"WITH {CH}, {PA}, {_REL}, {_HIT}, {_MET} SELECT coalesce(formato, '*') AS formato, count(*) AS n, round(avg(recall), 3) AS recall, round(avg(rr), 3) AS rr, round(avg(ndcg), 3) AS ndcg FROM m JOIN preguntas q ON m.qid = q.id GROUP BY ROLLUP (formato)")
def stage_metrics(spark, sf):
    """Means by format and over all, in one pass."""
    m = evaluate.retrieval_metrics(_hits(spark, sf), _relevant(spark, sf), 100)
    q = table(spark, sf, "preguntas").select(F.col("id").alias("qid"), "formato")
    got = m.join(q, "qid").rollup("formato").agg(F.count("*").alias("n"), *[F.round(F.avg(c), 3).alias(c) for c in ("recall", "rr", "ndcg")])
    return got.select(F.coalesce("formato", F.lit("*")).alias("formato"), "n", "recall", "rr", "ndcg")


@query("SELECT event_type, count(*) AS n, round(avg(value), 4) AS media, quantile_disc(value, 0.95) AS p95 FROM events WHERE value IS NOT NULL GROUP BY event_type")
def latency_p95(spark, sf):
    """Mean and lower 95th percentile, with no interpolation."""
    return table(spark, sf, "events").where("value is not null").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("media"), evaluate.lower_percentile("value", 0.95).alias("p95"))


@query(f"WITH {PA}, a AS (SELECT pregunta_id AS qid, split_part(doc_id, '_', 1) AS brazo, round(avg(score), 6) AS media, count(*) AS n FROM pa WHERE score IS NOT NULL AND NOT isnan(score) AND pregunta_id IS NOT NULL GROUP BY ALL) SELECT brazo, qid, n, CAST(row_number() OVER (PARTITION BY qid ORDER BY media DESC, brazo) AS INTEGER) AS puesto FROM a")
def leaderboard(spark, sf):
    """Arms ranked within comparable groups."""
    rows = passages(spark, sf).where("score is not null and not isnan(score) and pregunta_id is not null")
    a = rows.groupBy(F.col("pregunta_id").alias("qid"), F.substring_index("doc_id", "_", 1).alias("brazo")).agg(F.round(F.avg("score"), 6).alias("media"), F.count("*").alias("n"))
    return S.ranked(a, ["qid"], [F.col("media").desc(), F.col("brazo")], None, "puesto").select("brazo", "qid", "n", "puesto")


_TOP = "o AS (SELECT pregunta_id AS qid, id, score, row_number() OVER (PARTITION BY pregunta_id ORDER BY score DESC, id, pasaje_id) AS a, row_number() OVER (PARTITION BY pregunta_id ORDER BY floor(score * 10) DESC, id, pasaje_id) AS b FROM pa WHERE score IS NOT NULL AND NOT isnan(score) AND pregunta_id IS NOT NULL)"


@query(f"WITH {PA}, {_TOP}, x AS (SELECT qid, list(id ORDER BY a) AS l FROM o WHERE a <= 10 GROUP BY qid), y AS (SELECT qid, list(id ORDER BY b) AS l FROM o WHERE b <= 10 GROUP BY qid) SELECT qid, x.l = y.l AS igual, list_sort(x.l) = list_sort(y.l) AS mismos, CAST(len(list_intersect(x.l, y.l)) AS INTEGER) AS comunes FROM x JOIN y USING (qid)")
def golden_compare(spark, sf):
    """Two runs compared in order, as sets, and by overlap (the second run's scores are coarse)."""
    rows = passages(spark, sf).where("score is not null and not isnan(score) and pregunta_id is not null").select(F.col("pregunta_id").alias("qid"), "id", "pasaje_id", "score")

    def run(score, name):
        top = S.ranked(rows, ["qid"], [score.desc(), F.col("id"), F.col("pasaje_id")], 10, "r")
        return top.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "id"))), lambda v: v["id"]).alias(name))

    got = run(F.col("score"), "x").join(run(F.floor(F.col("score") * 10), "y"), "qid")
    return got.select("qid", (F.col("x") == F.col("y")).alias("igual"), (F.array_sort("x") == F.array_sort("y")).alias("mismos"), F.size(F.array_intersect("x", "y")).alias("comunes"))


@query(f"WITH {CH}, {PA}, {_REL}, {_HIT} SELECT rel.qid, rel.doc, CAST(min(rank) AS INTEGER) AS primero FROM rel LEFT JOIN hi ON rel.qid = hi.qid AND rel.doc = hi.doc AND rank <= 1000 GROUP BY rel.qid, rel.doc")
def first_rank_missing(spark, sf):
    """Where each relevant article first turns up in the deep list, if it does."""
    return _relevant(spark, sf).join(_hits(spark, sf, 1000), ["qid", "doc"], "left").groupBy("qid", "doc").agg(F.min("rank").alias("primero"))


_OPT = rf"""b AS (SELECT pregunta_id AS id, texto FROM (SELECT *, row_number() OVER (PARTITION BY pregunta_id ORDER BY score DESC, id, pasaje_id) AS n FROM pa WHERE score IS NOT NULL AND NOT isnan(score) AND texto IS NOT NULL AND pregunta_id IS NOT NULL) WHERE n = 1),
    op AS (SELECT q.id, e.key AS letra, list_distinct(list_filter(regexp_extract_all({fold('e.value')}, '[\p{{L}}\p{{N}}]+'), lambda v: len(v) > 3)) AS w, b.texto FROM (SELECT id, unnest(map_entries(opciones)) AS e FROM preguntas WHERE opciones IS NOT NULL) q LEFT JOIN b ON q.id = b.id),
    ap AS (SELECT id, letra, CASE WHEN len(w) = 0 THEN 0 ELSE round(len(list_intersect(w, regexp_extract_all({fold("coalesce(texto, '')")}, '[\p{{L}}\p{{N}}]+'))) / CAST(len(w) AS DOUBLE), 6) END AS apoyo FROM op),
    el AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY apoyo DESC, letra) AS n FROM ap) WHERE n = 1)"""


def _support(spark, sf):
    """(id, letra, apoyo): words of each option that the question's best passage holds."""
    rows = passages(spark, sf).where("score is not null and not isnan(score) and texto is not null and pregunta_id is not null")
    best = S.ranked(rows.select("pregunta_id", "id", "pasaje_id", "score"), ["pregunta_id"], [F.col("score").desc(), F.col("id"), F.col("pasaje_id")], 1)
    top = best.join(rows.select("pasaje_id", "texto"), "pasaje_id").select(F.col("pregunta_id").alias("id"), "texto")
    o = table(spark, sf, "preguntas").where("opciones is not null").select("id", F.explode("opciones").alias("letra", "opcion"))
    all_words = lambda c: F.regexp_extract_all(T.fold(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    w = F.array_distinct(F.filter(all_words("opcion"), lambda v: F.length(v) > 3))
    got = o.join(top, "id", "left").select("id", "letra", w.alias("w"), all_words(F.coalesce("texto", F.lit(""))).alias("t"))
    return got.select("id", "letra", F.when(F.size("w") == 0, F.lit(0.0)).otherwise(F.round(F.size(F.array_intersect("w", "t")) / F.size("w"), 6)).alias("apoyo"))


def _choice(spark, sf):
    return S.ranked(_support(spark, sf), ["id"], [F.col("apoyo").desc(), F.col("letra")], 1, "n")


@query(f"WITH {PA}, {_OPT} SELECT id, letra, apoyo FROM el")
def lexical_option_choice(spark, sf):
    """The option that the best passage supports most; ties go to the first letter."""
    return _choice(spark, sf).select("id", "letra", "apoyo")


@query(f"WITH {PA}, {_OPT}, r AS (SELECT q.id, coalesce(el.letra = q.respuesta_correcta, false) AS bien FROM preguntas q LEFT JOIN el ON q.id = el.id WHERE q.formato = 'multiple_choice') SELECT count(*) AS total, count(*) FILTER (bien) AS aciertos, round(20.0 * count(*) FILTER (bien) / greatest(count(*), 1), 4) AS puntos FROM r")
def closed_accuracy(spark, sf):
    """Closed questions right, of all; a missing answer is wrong."""
    q = table(spark, sf, "preguntas").where("formato = 'multiple_choice'").select("id", "respuesta_correcta")
    r = q.join(_choice(spark, sf), "id", "left").select(F.coalesce(F.col("letra") == F.col("respuesta_correcta"), F.lit(False)).alias("bien"))
    return r.agg(F.count("*").alias("total"), F.count_if("bien").alias("aciertos")).withColumn("puntos", evaluate.closed_points(F.col("aciertos"), F.col("total")))


@query(f"WITH {PA}, {_OPT}, r AS (SELECT q.id, el.apoyo IS NULL OR el.apoyo = 0 AS abstiene, q.legal_basis IS NULL AS debe FROM preguntas q LEFT JOIN el ON q.id = el.id) SELECT count(*) FILTER (abstiene AND debe) AS tn, count(*) FILTER (abstiene AND NOT debe) AS fn, count(*) FILTER (NOT abstiene AND debe) AS fp, count(*) FILTER (NOT abstiene AND NOT debe) AS tp, round(10 * (count(*) FILTER (abstiene AND debe) + 0.5 * count(*) FILTER (NOT abstiene)) / greatest(count(*), 1), 4) AS puntos FROM r")
def abstention_confusion(spark, sf):
    """Abstentions against the questions that have no legal basis."""
    q = table(spark, sf, "preguntas").select("id", F.col("legal_basis").isNull().alias("debe"))
    r = q.join(_choice(spark, sf), "id", "left").withColumn("ab", F.expr("apoyo is null or apoyo = 0"))
    g = r.agg(F.expr("count_if(ab and debe)").alias("tn"), F.expr("count_if(ab and not debe)").alias("fn"), F.expr("count_if(not ab and debe)").alias("fp"), F.expr("count_if(not ab and not debe)").alias("tp"))
    return g.withColumn("puntos", F.expr("round(10 * (tn + 0.5 * (tp + fp)) / greatest(tn + fn + tp + fp, 1), 4)").cast("double"))


@query("""WITH v AS (SELECT id, 'sin formato' AS falta FROM preguntas WHERE formato IS NULL UNION ALL SELECT id, 'sin opciones' FROM preguntas WHERE formato = 'multiple_choice' AND opciones IS NULL
    UNION ALL SELECT id, 'respuesta fuera de opciones' FROM preguntas WHERE opciones IS NOT NULL AND NOT list_contains(map_keys(opciones), respuesta_correcta) UNION ALL SELECT id, 'sin respuesta esperada' FROM preguntas WHERE formato <> 'multiple_choice' AND respuesta_esperada IS NULL
    UNION ALL SELECT id, 'sin base legal' FROM preguntas WHERE legal_basis IS NULL UNION ALL SELECT id, 'id repetido' FROM preguntas GROUP BY id HAVING count(*) > 1) SELECT * FROM v""")
def schema_violations(spark, sf):
    """Rules of the item schema that rows break, one row a breach."""
    q = table(spark, sf, "preguntas")
    rules = {
        "sin formato": "formato is null",
        "sin opciones": "formato = 'multiple_choice' and opciones is null",
        "respuesta fuera de opciones": "opciones is not null and respuesta_correcta is not null and not array_contains(map_keys(opciones), respuesta_correcta)",
        "sin respuesta esperada": "formato <> 'multiple_choice' and respuesta_esperada is null",
        "sin base legal": "legal_basis is null",
    }
    broken = q.select("id", F.explode(F.array_compact(F.array(*[F.when(F.expr(e), name) for name, e in rules.items()]))).alias("falta"))
    twice = q.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id", F.lit("id repetido").alias("falta"))
    return broken.unionByName(twice)


@query("SELECT id, CASE WHEN opciones IS NULL THEN pregunta ELSE pregunta || chr(10) || array_to_string(list_transform(list_sort(map_keys(opciones)), lambda k: k || ') ' || opciones[k]), chr(10)) END AS consulta FROM preguntas WHERE pregunta IS NOT NULL")
def question_text(spark, sf):
    """A question with its options in order."""
    options = F.array_join(F.transform(F.array_sort(F.map_entries("opciones")), lambda e: F.concat(e["key"], F.lit(") "), e["value"])), "\n")
    return table(spark, sf, "preguntas").where("pregunta is not null").select("id", F.when(F.col("opciones").isNull(), F.col("pregunta")).otherwise(F.concat("pregunta", F.lit("\n"), options)).alias("consulta"))


_RULES = [("norma aplicable", "cual de las siguientes|que norma"), ("sentido del fallo", "es valido|quien debe|que decision"), ("indemnizacion", "indemnizacion|perjuicios"), ("accion", "que accion|procede")]


@query(rf"WITH q AS (SELECT id, {fold('pregunta')} AS x FROM preguntas WHERE pregunta IS NOT NULL) SELECT id, CASE {' '.join(f'''WHEN regexp_matches(x, '{p}') THEN '{n}' ''' for n, p in _RULES)} ELSE 'general' END AS tarea, CASE WHEN len(regexp_extract_all(x, '[\p{{L}}\p{{N}}]+')) < 20 THEN 'baja' WHEN len(regexp_extract_all(x, '[\p{{L}}\p{{N}}]+')) < 60 THEN 'media' ELSE 'alta' END AS complejidad FROM q")
def question_flags(spark, sf):
    """Task by the first matching rule, complexity by length."""
    n = F.size(F.regexp_extract_all(T.fold("pregunta"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))
    return table(spark, sf, "preguntas").where("pregunta is not null").select("id", T.first_match("pregunta", _RULES, "general").alias("tarea"), F.when(n < 20, "baja").when(n < 60, "media").otherwise("alta").alias("complejidad"))


@query(rf"WITH {CH}, m AS (SELECT chunk_id, unnest(list_transform(regexp_extract_all({j('texto')}, '\d{{1,3}}(?:\.\d{{3}})+'), lambda v: CAST(replace(v, '.', '') AS BIGINT))) AS monto FROM ch), u AS (SELECT DISTINCT chunk_id, monto FROM m) SELECT chunk_id, monto, count(max_chars) AS umbrales, count(*) FILTER (monto > max_chars * 1000) AS excede FROM u, (SELECT DISTINCT max_chars FROM limites) l GROUP BY chunk_id, monto")
def amount_thresholds(spark, sf):
    """Numbers in groups of three digits against every threshold; the thresholds are a handful and travel as one array."""
    t = table(spark, sf, "limites").agg(F.collect_set("max_chars").alias("u"))
    rows = chunks(spark, sf, "texto").select("chunk_id", F.explode(T.amounts("texto")).alias("monto")).distinct()
    got = rows.crossJoin(F.broadcast(t))  # one row
    return got.select("chunk_id", "monto", F.size("u").cast("long").alias("umbrales"), F.size(F.filter("u", lambda v: F.col("monto") > v * 1000)).cast("long").alias("excede"))


@query(f"WITH {CH}, {PA} SELECT pasaje_id, ch.chunk_id IS NOT NULL AS exacto, coalesce({j('titulo')}, json_extract_string(pa.metadatos, '$.titulo')) AS titulo, CASE WHEN doc_id_ LIKE 'jurisprudencia%' THEN 'sentencia' WHEN doc_id_ LIKE 'codigo%' THEN 'código' ELSE 'norma' END AS clase FROM (SELECT *, doc_id AS doc_id_ FROM pa) pa LEFT JOIN ch ON pa.id = ch.chunk_id")
def passage_enrich(spark, sf):
    """A passage with its chunk's title, or its own, and the kind of its source."""
    c = chunks(spark, sf, "titulo").select("chunk_id", "titulo")
    p = passages(spark, sf).select("pasaje_id", "id", "doc_id", F.get_json_object("metadatos", "$.titulo").alias("t"))
    kind = F.when(F.col("doc_id").startswith("jurisprudencia"), "sentencia").when(F.col("doc_id").startswith("codigo"), "código").otherwise("norma")
    return p.join(c, F.col("id") == F.col("chunk_id"), "left").select("pasaje_id", F.col("chunk_id").isNotNull().alias("exacto"), F.coalesce("titulo", "t").alias("titulo"), kind.alias("clase"))


@query(rf"WITH {CH}, {PA}, n AS (SELECT pasaje_id, regexp_replace({fold('pa.texto')}, '[^\p{{L}}\p{{N}}]', '', 'g') AS p, regexp_replace({fold(j('texto'))}, '[^\p{{L}}\p{{N}}]', '', 'g') AS c FROM pa JOIN ch ON pa.id = ch.chunk_id WHERE pa.texto IS NOT NULL AND {j('texto')} IS NOT NULL) SELECT pasaje_id, CAST(strpos(c, substr(p, 31, 30)) AS INTEGER) AS lugar, c = p AS entero FROM n WHERE len(p) >= 60")
def locate_passage(spark, sf):
    """T14, and of U01 one probe: characters 31-60 of a passage located in its chunk, in the normalised text."""
    c = chunks(spark, sf, "texto").select("chunk_id", F.col("texto").alias("x"))
    p = passages(spark, sf).where("texto is not null").select("pasaje_id", "id", "texto")
    n = p.join(c, F.col("id") == F.col("chunk_id")).where("x is not null").select("pasaje_id", T.normalized("texto").alias("p"), T.normalized("x").alias("c"))
    return n.where("length(p) >= 60").select("pasaje_id", F.expr("cast(instr(c, substr(p, 31, 30)) as int)").alias("lugar"), (F.col("c") == F.col("p")).alias("entero"))


@query("WITH a AS (SELECT user_id, event_id, event_type = 'purchase' AS aprobado, CAST(json_extract(props, '$.k') AS INTEGER) AS problemas, ts FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY aprobado DESC, problemas, ts DESC, event_id) AS n FROM a) SELECT user_id, event_id, aprobado, problemas FROM r WHERE n = 1")
def best_attempt(spark, sf):
    """Of several attempts the approved one, else that of fewest problems, the latest of those."""
    a = table(spark, sf, "events").select("user_id", "event_id", (F.col("event_type") == "purchase").alias("aprobado"), F.get_json_object("props", "$.k").cast("int").alias("problemas"), "ts")
    return S.ranked(a, ["user_id"], [F.col("aprobado").desc(), F.col("problemas").asc_nulls_last(), F.col("ts").desc(), F.col("event_id")], 1, "n").select("user_id", "event_id", "aprobado", "problemas")
