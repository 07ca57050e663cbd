"""Retrieval variants, answer routing and intake rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import arms as A
from ..operators import citations as C
from ..operators import cite, evaluate
from ..operators import search as S
from ..session import cut_lineage
from ..sources.tables import chunks, manifest, passages, table
from .common import CH, MA, PA, fold, j, query, tokens
from .scoring import _OPT, _REL, _choice, _relevant
from .search import _D, _N, _bm25, _corpus, _questions

_OPTQ = f"q AS (SELECT id * 10 + ascii(letra) - 64 AS qid, unnest({tokens('o')}) AS term FROM (SELECT id, e.key AS letra, e.value AS o FROM (SELECT id, unnest(map_entries(opciones)) AS e FROM preguntas WHERE id % 20 = 0 AND opciones IS NOT NULL))), qt AS (SELECT qid, term, count(*) AS qtf FROM q GROUP BY ALL)"


@query(f"WITH {CH}, {_OPTQ}, {_bm25(_N, 5)} SELECT qid, id, score, CAST(rank AS INTEGER) AS rank FROM r")
def option_lists(spark, sf):
    """A list of norms for each option of the questions whose id is divisible by 20."""
    q = table(spark, sf, "preguntas").where("id % 20 = 0 and opciones is not null").select("id", F.explode("opciones").alias("letra", "text"))
    return S.bm25(q.select((F.col("id") * 10 + F.ascii("letra") - 64).alias("qid"), "text"), _corpus(spark, sf, norms=True), 5)


_ASKB = f"q AS (SELECT id AS qid, unnest({tokens('pregunta')}) AS term FROM preguntas WHERE id % 20 = 0 AND pregunta IS NOT NULL), qt AS (SELECT qid, term, count(*) AS qtf FROM q GROUP BY ALL)"


@query(f"WITH {CH}, {_ASKB}, {_bm25(_D, 100)}, w AS (SELECT *, row_number() OVER (PARTITION BY qid, split_part(id, '/', 1) ORDER BY score DESC, id) AS n FROM r) SELECT qid, split_part(id, '/', 1) AS doc_id, id, score, CAST(n AS INTEGER) AS n FROM w WHERE n <= 2")
def within_documents(spark, sf):
    """The best two chunks of each document among a question's first 100; :func:`within_every_document` has no such cut."""
    q = table(spark, sf, "preguntas").where("id % 20 = 0 and pregunta is not null").select(F.col("id").alias("qid"), F.col("pregunta").alias("text"))
    hits = S.bm25(q, _corpus(spark, sf), 100).withColumn("doc_id", F.substring_index("id", "/", 1))
    return S.ranked(hits, ["qid", "doc_id"], [F.col("score").desc(), F.col("id")], 2, "n").select("qid", "doc_id", "id", "score", "n")


@query(f"WITH {CH}, {_ASKB}, {_bm25(_D, 1)}, w AS (SELECT *, split_part(id, '/', 1) AS doc_id, row_number() OVER (PARTITION BY qid, split_part(id, '/', 1) ORDER BY score DESC, id) AS n FROM sc WHERE score > 0) SELECT qid, doc_id, id, score, CAST(n AS INTEGER) AS n FROM w WHERE n <= 2")
def within_every_document(spark, sf):
    """R07, and R05 by words: the best two chunks inside each document that a query reaches, whatever their place in the whole corpus."""
    q = table(spark, sf, "preguntas").where("id % 20 = 0 and pregunta is not null").select(F.col("id").alias("qid"), F.col("pregunta").alias("text"))
    return S.bm25_within(q, _corpus(spark, sf), F.substring_index("id", "/", 1), 2)


@query(f"WITH {CH}, {PA}, {_REL} SELECT rel.qid, rel.doc, ch.chunk_id FROM rel JOIN ch ON ch.articulo_id = rel.doc")
def express_citations(spark, sf):
    """All parts of the articles that a question names."""
    return _relevant(spark, sf).join(chunks(spark, sf).select("chunk_id", F.col("articulo_id").alias("doc")), "doc").select("qid", "doc", "chunk_id")


@query(f"WITH {CH}, {PA}, {_REL}, p AS (SELECT pregunta_id AS qid, id, row_number() OVER (PARTITION BY pregunta_id ORDER BY max(score) DESC, id) AS rank FROM pa WHERE score IS NOT NULL AND NOT isnan(score) AND pregunta_id IS NOT NULL GROUP BY pregunta_id, id), f AS (SELECT rel.qid, ch.chunk_id AS id FROM rel JOIN ch ON ch.articulo_id = rel.doc), t AS (SELECT qid, id, 0 AS forzado FROM p WHERE rank <= 150 UNION ALL SELECT qid, id, 1 FROM f) SELECT qid, id, CAST(max(forzado) AS INTEGER) AS forzado FROM t GROUP BY qid, id")
def candidate_pool(spark, sf):
    """The first 150 of a question and the parts of the articles it names, each once; no leader, fixed or wage slots."""
    rows = passages(spark, sf).where("score is not null and not isnan(score) and pregunta_id is not null")
    best = rows.groupBy(F.col("pregunta_id").alias("qid"), "id").agg(F.max("score").alias("score"))
    pool = S.ranked(best, ["qid"], [F.col("score").desc(), F.col("id")], 150).select("qid", "id", F.lit(0).alias("forzado"))
    parts = chunks(spark, sf).select(F.col("chunk_id").alias("id"), F.col("articulo_id").alias("doc"))
    forced = _relevant(spark, sf).join(parts, "doc").select("qid", "id", F.lit(1).alias("forzado"))
    return S.plain_union(pool, forced, by=["qid", "id"]).groupBy("qid", "id").agg(F.max("forzado").alias("forzado"))


@query(f"WITH {PA}, s AS (SELECT pregunta_id AS qid, 'recuperado' AS etapa, id, row_number() OVER (PARTITION BY pregunta_id ORDER BY score DESC, id, pasaje_id) AS rank FROM pa WHERE score IS NOT NULL AND NOT isnan(score) AND pregunta_id IS NOT NULL), c AS (SELECT qid, 'entregado' AS etapa, id, rank FROM s WHERE rank <= 10) SELECT etapa, count(*) AS filas, count(DISTINCT qid) AS preguntas, CAST(max(rank) AS INTEGER) AS hondo FROM (SELECT * FROM s UNION ALL SELECT * FROM c) GROUP BY etapa")
def stage_hits(spark, sf):
    """Hits of each stage as one long table, summed up."""
    from ..operators.ordered import running_sum, with_lag

    rows = passages(spark, sf).where("score is not null and not isnan(score) and pregunta_id is not null").select(F.col("pregunta_id").alias("qid"), "id", "pasaje_id", (-F.col("score")).alias("menos"))
    placed = with_lag(rows, ["qid"], ["menos", "id", "pasaje_id"], ["id"]).withColumn("uno", F.lit(1))
    placed = running_sum(placed, ["qid"], ["menos", "id", "pasaje_id"], "uno", "rank").select("qid", "rank")
    both = placed.withColumn("etapa", F.explode(F.when(F.col("rank") <= 10, F.array(F.lit("recuperado"), F.lit("entregado"))).otherwise(F.array(F.lit("recuperado")))))
    return both.groupBy("etapa").agg(F.count("*").alias("filas"), F.count_distinct("qid").alias("preguntas"), F.max("rank").alias("hondo"))


@query("SELECT id, formato, CASE WHEN formato = 'multiple_choice' THEN 'votar' WHEN formato IN ('semi_open', 'open_ended') THEN 'redactar' ELSE 'abstener' END AS paso, formato = 'multiple_choice' AS usa_bm25, pregunta || CASE WHEN tema IS NULL THEN '' ELSE chr(10) || tema END AS consulta FROM preguntas WHERE pregunta IS NOT NULL")
def route_questions(spark, sf):
    """The next step of each question, whether words are searched, and the query text of a second cycle."""
    q = table(spark, sf, "preguntas").where("pregunta is not null")
    step = F.when(F.col("formato") == "multiple_choice", "votar").when(F.col("formato").isin("semi_open", "open_ended"), "redactar").otherwise("abstener")
    return q.select("id", "formato", step.alias("paso"), (F.col("formato") == "multiple_choice").alias("usa_bm25"), F.concat("pregunta", F.when(F.col("tema").isNull(), "").otherwise(F.concat(F.lit("\n"), "tema"))).alias("consulta"))


@query(f"WITH {PA}, {_OPT}, c AS (SELECT q.id, q.respuesta_correcta AS actual, el.letra AS nueva, coalesce(a.apoyo, 0) AS antes, el.apoyo AS despues FROM preguntas q JOIN el ON q.id = el.id LEFT JOIN ap a ON a.id = q.id AND a.letra = q.respuesta_correcta) SELECT id, CASE WHEN despues > antes THEN nueva ELSE actual END AS letra, despues > antes AS cambia FROM c")
def letter_check(spark, sf):
    """A letter changes only if the other one has more support."""
    from .scoring import _support

    q = table(spark, sf, "preguntas").select("id", F.col("respuesta_correcta").alias("actual"))
    old = _support(spark, sf).select("id", F.col("letra").alias("actual"), F.col("apoyo").alias("antes"))
    c = q.join(_choice(spark, sf).select("id", "letra", "apoyo"), "id").join(old, ["id", "actual"], "left")
    more = F.col("apoyo") > F.coalesce("antes", F.lit(0.0))
    return c.select("id", F.when(more, F.col("letra")).otherwise(F.col("actual")).alias("letra"), more.alias("cambia"))


@query("SELECT id, concat_ws(chr(10), 'Área: ' || area, 'Tema: ' || tema, 'Pregunta: ' || pregunta, CASE complejidad WHEN 'alta' THEN 'Responda con detalle.' WHEN 'media' THEN 'Responda en un párrafo.' ELSE 'Responda en una frase.' END, CASE WHEN sub_tarea = 'sentido del fallo' THEN 'Empiece por la decisión.' WHEN sub_tarea = 'precedente' THEN 'Empiece por el precedente.' END) AS guion FROM preguntas WHERE pregunta IS NOT NULL")
def prompt_sections(spark, sf):
    """The sections of a prompt in order, absent ones left out."""
    q = table(spark, sf, "preguntas").where("pregunta is not null")
    named = [F.concat(F.lit(n), F.col(c)) for n, c in (("Área: ", "area"), ("Tema: ", "tema"), ("Pregunta: ", "pregunta"))]
    length = F.when(F.col("complejidad") == "alta", "Responda con detalle.").when(F.col("complejidad") == "media", "Responda en un párrafo.").otherwise("Responda en una frase.")
    first = F.when(F.col("sub_tarea") == "sentido del fallo", "Empiece por la decisión.").when(F.col("sub_tarea") == "precedente", "Empiece por el precedente.")
    return q.select("id", F.concat_ws("\n", *named, length, first).alias("guion"))


@query("SELECT formato, count(*) FILTER (complejidad = 'alta') AS alta, count(*) FILTER (complejidad = 'media') AS media, count(*) FILTER (complejidad = 'baja') AS baja FROM preguntas GROUP BY formato")
def report_pivot(spark, sf):
    """A report's counts, pivoted."""
    q = table(spark, sf, "preguntas").groupBy("formato").pivot("complejidad", ["alta", "media", "baja"]).agg(F.count(F.lit(1)))
    return q.select("formato", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("alta", "media", "baja")])


_STOP = ("de", "la", "el", "en", "y", "a", "que", "los", "un", "una", "con", "por", "al", "del")


@query(rf"WITH d AS (SELECT DISTINCT doc_id, regexp_extract_all({fold('text')}, '[\p{{L}}\p{{N}}]+') AS w FROM documents WHERE text IS NOT NULL) SELECT doc_id, CAST(len(list_filter(w, lambda v: NOT list_contains(['{"','".replace('"', "'").join(_STOP)}'], v))) AS INTEGER) AS quedan FROM d")
def stopword_filter(spark, sf):
    """Words that stay when the commonest ones go; repeats are kept."""
    w = F.regexp_extract_all(T.fold("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return table(spark, sf, "documents").where("text is not null").select("doc_id", F.size(F.filter(w, lambda v: ~v.isin(*_STOP))).alias("quedan"))


_BOILER = "(Cuál de las siguientes afirmaciones es correcta|Explique si hay lugar a indemnización)[?.]?"


@query(rf"SELECT id, CASE WHEN regexp_matches(pregunta, '{_BOILER}') THEN trim(regexp_replace(regexp_replace(pregunta, '{_BOILER}', '', 'g'), ' +', ' ', 'g')) ELSE pregunta END AS limpia FROM preguntas WHERE pregunta IS NOT NULL")
def exam_phrases(spark, sf):
    """Set phrases of examinations taken off, other texts untouched."""
    q = table(spark, sf, "preguntas").where("pregunta is not null")
    x = F.trim(F.regexp_replace(F.regexp_replace("pregunta", _BOILER, ""), " +", " "))
    return q.select("id", F.when(F.col("pregunta").rlike(_BOILER), x).otherwise(F.col("pregunta")).alias("limpia"))


@query(r"WITH t AS (SELECT doc_id, text, regexp_extract_all(text, '(?:^|\n)([A-D])\) ', 1) AS l FROM documents WHERE text IS NOT NULL) SELECT doc_id, array_to_string(l, '') AS letras, l[1:3] = ['A', 'B', 'C'] AS valida FROM t WHERE len(l) > 0")
def split_options(spark, sf):
    """Option letters that a text holds; a split needs A, B and C in order."""
    letters = F.regexp_extract_all("text", F.lit(r"(?:^|\n)([A-D])\) "), F.lit(1))
    t = table(spark, sf, "documents").where("text is not null").select("doc_id", letters.alias("l")).where("size(l) > 0")
    return t.select("doc_id", F.array_join("l", "").alias("letras"), (F.slice("l", 1, 3) == F.array(F.lit("A"), F.lit("B"), F.lit("C"))).alias("valida"))


@query(r"SELECT DISTINCT doc_id, regexp_extract(text, '(?:por|Por) (?:la|el) cual ([^\n]+)', 1) AS epigrafe FROM documents WHERE regexp_matches(text, '(?:por|Por) (?:la|el) cual ')")
def epigraph(spark, sf):
    """The line that says what a norm is about."""
    p = r"(?:por|Por) (?:la|el) cual ([^\n]+)"
    return table(spark, sf, "documents").where(F.col("text").rlike("(?:por|Por) (?:la|el) cual ")).select("doc_id", F.regexp_extract("text", p, 1).alias("epigrafe")).distinct()


@query(f"WITH {MA}, c AS (SELECT doc_id, estado, url, CASE WHEN NOT regexp_matches(doc_id, '^(ley|decreto|codigo|resolucion|jurisprudencia)_') THEN 'tipo ajeno' WHEN url IS NULL THEN 'sin dirección' WHEN estado = 'falla' THEN 'falla: ' || split_part(error, ':', 1) END AS motivo FROM ma) SELECT doc_id, motivo IS NULL AS admitido, motivo FROM c")
def refilter_targets(spark, sf):
    """Targets let in, and those turned away with the reason."""
    m = manifest(spark, sf)
    why = F.when(~F.col("doc_id").rlike("^(ley|decreto|codigo|resolucion|jurisprudencia)_"), "tipo ajeno").when(F.col("url").isNull(), "sin dirección").when(F.col("estado") == "falla", F.concat(F.lit("falla: "), F.substring_index("error", ":", 1)))
    return m.select("doc_id", why.isNull().alias("admitido"), why.alias("motivo"))


@query(f"WITH {CH}, d AS (SELECT doc_id, min(chunk_id) AS c FROM ch GROUP BY doc_id), k AS (SELECT split_part(doc_id, '_', 1) || '_' || regexp_extract(doc_id, '_([0-9]+)$', 1) AS clave, max(doc_id) AS doc_id, count(*) AS n FROM d GROUP BY 1) SELECT clave, doc_id, n = 1 AS unico FROM k")
def canonical_map(spark, sf):
    """Keys to documents, the last one wins; whether a key is unique."""
    d = chunks(spark, sf).select("doc_id").distinct()
    key = F.concat(F.substring_index("doc_id", "_", 1), F.lit("_"), F.regexp_extract("doc_id", "_([0-9]+)$", 1))
    return d.groupBy(key.alias("clave")).agg(F.max("doc_id").alias("doc_id"), F.count("*").alias("n")).select("clave", "doc_id", (F.col("n") == 1).alias("unico"))


@query("WITH s AS (SELECT doc_id, CAST(regexp_extract(text, '(?:de |[-/])((?:19|20)[0-9]{2})', 1) AS VARCHAR) AS y FROM documents WHERE text IS NOT NULL) SELECT DISTINCT doc_id, CASE WHEN y = '' THEN 1900 ELSE CAST(y AS INTEGER) END AS anio FROM s")
def year_fallback(spark, sf):
    """The first year of a text, 1900 where there is none."""
    y = F.regexp_extract("text", "(?:de |[-/])((?:19|20)[0-9]{2})", 1)
    return table(spark, sf, "documents").where("text is not null").select("doc_id", F.when(y == "", F.lit(1900)).otherwise(F.expr("try_cast(regexp_extract(text, '(?:de |[-/])((?:19|20)[0-9]{2})', 1) as int)")).alias("anio")).distinct()


_FIELDS = ("tipo_documento", "vigencia", "prioridad", "tipo_chunk", "articulo_id", "doc_id")


def _named_parts(spark, sf, questions):
    """(qid, id): chunks of the articles that questions name expressly, and the summaries of the rulings they name."""
    cites = C.citations(questions, "qid", "text").withColumn("anio", F.col("anio").cast("int"))
    cites = cites.withColumn("numero", F.when(F.col("cuerpo") == "jurisprudencia", F.lower("numero")).otherwise(F.col("numero")))
    cites = cites.withColumn("cuerpo", F.when(F.col("cuerpo") == "jurisprudencia", F.lit("sentencia")).otherwise(F.col("cuerpo")))
    rows = chunks(spark, sf).select("chunk_id", "doc_id", "articulo_id", "tipo_chunk")
    named = cite.resolve(cites, rows.select("doc_id")).where("doc_id is not null")
    unit = F.when(F.col("cuerpo") == "sentencia", F.concat("doc_id", F.lit("/ficha"))).otherwise(F.concat("doc_id", F.lit("/art_"), "articulo"))
    key = F.when(F.col("tipo_chunk") == "ficha", F.col("chunk_id")).when(F.col("tipo_chunk").isin("articulo", "parte_articulo"), F.col("articulo_id"))
    return named.select("qid", unit.alias("u")).where("u is not null").distinct().join(rows.select(F.col("chunk_id").alias("id"), key.alias("u")), "u").select("qid", "id").distinct()


@query()
def hybrid_top10(spark, sf):
    """R01, R03, R04, R09, R12, R14, R15, R16, R17 chained: stemmed lists of all chunks and of norms, fused, cited articles
    forced in, scores adjusted, a diverse choice, and parts put together to their article."""
    asked = _questions(spark, sf)
    terms, docs, few = S.matched(asked, _corpus(spark, sf, stems=True, fields=_FIELDS))
    norms = docs.where("coalesce(tipo_documento, '') <> 'sentencia'")
    every = S.best_of(S.bm25_sums(terms, S.postings(docs), S.corpus_stats(docs), few), 100)
    own = S.best_of(S.bm25_sums(terms, S.postings(norms), S.corpus_stats(norms), few), 50)
    fused = S.rrf([every, own]).where("rank <= 150").select("qid", "id", "score")
    named = _named_parts(spark, sf, asked).withColumn("cited", F.lit(True))
    pool = fused.join(named, ["qid", "id"], "full")
    top = fused.groupBy("qid").agg(F.max("score").alias("m"))
    pool = pool.join(top, "qid", "left").withColumn("score", F.coalesce(F.round(F.col("score") / F.col("m"), 4), F.lit(0.0)))
    text = lambda c: F.coalesce(c, F.lit(""))
    ruling, cited = text("tipo_documento") == "sentencia", F.coalesce("cited", F.lit(False))
    scored = pool.join(docs.drop("dl", "p"), "id").withColumn("score", S.adjusted(F.col("score"), text("vigencia") == "derogada", text("prioridad"), text("tipo_chunk"), ruling, cited))
    wanted = pool.select("id").distinct()
    raw = table(spark, sf, "chunks").select(F.col("chunk_id").alias("id"), F.get_json_object("datos", "$.texto").alias("t")).where("t is not null")
    sh = raw.join(wanted, "id", "left_semi").groupBy("id").agg(F.max("t").alias("t")).select("id", T.shingles("t").alias("sh"))
    article = F.col("tipo_chunk").isin("articulo", "parte_articulo")
    unit = F.when(article, F.coalesce("articulo_id", "id")).when(F.col("tipo_chunk") == "seccion", F.regexp_replace("id", r"#\d+$", "")).otherwise(F.col("id"))
    chosen = S.diverse(scored.join(sh, "id").select("qid", "id", F.substring_index("id", "/", 1).alias("doc_id"), unit.alias("unit"), ruling.alias("ruling"), article.alias("article"), "score", "sh", cited.alias("cited"), cited.alias("forced")))
    kinds = docs.select("id", "tipo_chunk", "articulo_id")
    return chosen.join(kinds, "id").select("qid", "rank", F.when(F.col("tipo_chunk") == "parte_articulo", F.col("articulo_id")).otherwise(F.col("id")).alias("pasaje"), "doc_id", "score")


@query()
def arm_metrics(spark, sf):
    """Retrieval arms (all chunks, with stems, norms only) run on every question that has a basis, with their metrics at 10."""
    relevant = cut_lineage(_relevant(spark, sf).select("qid", "doc"))
    asked = table(spark, sf, "preguntas").where("pregunta is not null").select(F.col("id").alias("qid"), F.col("pregunta").alias("text")).join(relevant.select("qid").distinct(), "qid", "left_semi")
    unit = chunks(spark, sf).select(F.col("chunk_id").alias("id"), F.coalesce("articulo_id", "chunk_id").alias("doc"))
    how = {"bm25": A.Arm(), "bm25_raices": A.Arm(stems=True), "bm25_normas": A.Arm(where="coalesce(tipo_documento, '') <> 'sentencia'")}
    found = A.search(asked, _corpus(spark, sf, fields=("tipo_documento",)), how, 10)
    hits = cut_lineage(found.select("arm", "qid", "id", "rank").join(unit, "id").select("arm", "qid", "doc", "rank"))
    out = None
    for name in how:
        got = evaluate.retrieval_metrics(hits.where(F.col("arm") == name), relevant, 10)
        row = got.agg(F.count("*").alias("preguntas"), *[F.round(F.avg(c), 6).alias(c) for c in ("recall", "rr", "ndcg")]).select(F.lit(name).alias("brazo"), "*")
        out = row if out is None else out.unionByName(row)
    return out
