"""Answer post-processing, formats and further checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import convert
from ..operators import search as S
from ..sources.tables import chunks, manifest, passages, table
from .common import CH, MA, PA, fold, j, query


@query(rf"WITH {CH} SELECT chunk_id, CASE WHEN lower({j('url')}) LIKE '%.pdf' THEN 'pdf' WHEN lower({j('url')}) LIKE '%.docx' THEN 'docx' WHEN lower({j('url')}) LIKE '%.doc' THEN 'doc' WHEN regexp_matches({j('texto')}, '(?i)<(p|div|table|h[1-6])[ >]') THEN 'html' ELSE 'texto' END AS conversor FROM ch WHERE {j('texto')} IS NOT NULL")
def choose_converter(spark, sf):
    """Converter by extension, then by a look at the text."""
    return chunks(spark, sf, "url", "texto").where("texto is not null").select("chunk_id", convert.converter(F.col("url"), F.col("texto")).alias("conversor"))


@query()
def html_blocks(spark, sf):
    """Headings, paragraphs, list items and table rows of HTML texts, struck text marked."""
    return convert.html_blocks(chunks(spark, sf, "texto"), "chunk_id", "texto")


@query(rf"WITH {CH}, l AS (SELECT chunk_id, unnest(regexp_extract_all({j('texto')}, '(?:href=[\"'']|\]\(|\[)(https?://[^\s\"''<>)\]]+)', 1)) AS enlace FROM ch) SELECT chunk_id, enlace, regexp_extract(enlace, '^https?://([^/]+)', 1) AS sitio, count(*) AS veces FROM l GROUP BY chunk_id, enlace")
def text_links(spark, sf):
    """Links that a text holds, with their site."""
    found = F.regexp_extract_all("texto", F.lit(r"(?:href=[\"']|\]\(|\[)(https?://[^\s\"'<>)\]]+)"), F.lit(1))
    l = chunks(spark, sf, "texto").select("chunk_id", F.explode(found).alias("enlace"))  # noqa: E741
    return l.groupBy("chunk_id", "enlace").agg(F.count("*").alias("veces")).withColumn("sitio", F.regexp_extract("enlace", "^https?://([^/]+)", 1))


@query(rf"WITH {CH}, l AS (SELECT chunk_id, unnest(string_split({j('texto')}, chr(10))) AS x, generate_subscripts(string_split({j('texto')}, chr(10)), 1) AS i FROM ch) SELECT chunk_id, CAST(i - 1 AS INTEGER) AS linea, CAST(len(string_split(x, ' | ')) AS INTEGER) AS celdas, string_split(x, ' | ')[1] AS primera FROM l WHERE strpos(x, ' | ') > 0")
def table_rows(spark, sf):
    """Rows with cells parted by a bar."""
    l = chunks(spark, sf, "texto").select("chunk_id", F.posexplode(F.split("texto", "\n")).alias("linea", "x")).where("contains(x, ' | ')")  # noqa: E741
    cells = F.split("x", r" \| ")
    return l.select("chunk_id", "linea", F.size(cells).alias("celdas"), cells[0].alias("primera"))


_KIND = [("libro", "^LIBRO "), ("titulo", "^(T[IÍ]TULO|Título) [IVXLC0-9]+"), ("capitulo", "^(CAP[IÍ]TULO|Capítulo) [IVXLC0-9]+"), ("articulo", "^(ART[IÍ]CULO|Artículo|Art\\.) ?[0-9IVX]+"), ("seccion_sentencia", "^([IVX]+\\. [A-ZÁÉÍÓÚÑ ]+|RESUELVE:|FALLA:)$"), ("parrafo", "^(PAR[AÁ]GRAFO|Parágrafo)")]


@query(rf"WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL), k AS (SELECT doc_id, i, x, CASE {' '.join(f'''WHEN regexp_matches(x, '{p}') THEN '{n}' ''' for n, p in _KIND)} END AS tipo FROM l) SELECT doc_id, CAST(i AS INTEGER) AS linea, tipo, regexp_extract(x, '[0-9]+') AS numero FROM k WHERE tipo IS NOT NULL")
def heading_grammar(spark, sf):
    """Kind and number of heading lines."""
    from ..operators.segment import lines

    kind = None
    for name, pattern in _KIND:
        kind = F.when(F.col("x").rlike(pattern), name) if kind is None else kind.when(F.col("x").rlike(pattern), name)
    return lines(table(spark, sf, "documents")).select("doc_id", F.col("i").alias("linea"), kind.alias("tipo"), F.regexp_extract("x", "[0-9]+", 0).alias("numero")).where("tipo is not null")


@query(f"WITH {CH}, k AS (SELECT doc_id, tipo_chunk AS tipo, count(*) AS n FROM ch WHERE tipo_chunk IS NOT NULL GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY CASE tipo WHEN 'articulo' THEN 0 ELSE 1 END, n DESC, tipo) AS p FROM k) SELECT doc_id, tipo, n, CAST(p AS INTEGER) AS nivel FROM r WHERE p <= 5")
def heading_levels(spark, sf):
    """Depth of the kinds that a document has, the commonest first, five at most, articles always."""
    k = chunks(spark, sf).where("tipo_chunk is not null").groupBy("doc_id", F.col("tipo_chunk").alias("tipo")).agg(F.count("*").alias("n"))
    return S.ranked(k, ["doc_id"], [F.when(F.col("tipo") == "articulo", 0).otherwise(1), F.col("n").desc(), F.col("tipo")], 5, "nivel")


@query(f"WITH {CH} SELECT tipo_chunk, count(*) AS trozos, CAST(sum(len({j('texto')})) AS BIGINT) AS letras, CAST(sum(len({j('texto')}) // 4) AS BIGINT) AS fichas, count(*) FILTER ({j('n_chars', 'INTEGER')} <> len({j('texto')})) AS viejos FROM ch WHERE {j('texto')} IS NOT NULL AND tipo_chunk IS NOT NULL GROUP BY tipo_chunk")
def chunk_stats(spark, sf):
    """Chunks, characters and rough tokens of each kind, and stale lengths."""
    c = chunks(spark, sf, "texto", "n_chars").where("texto is not null and tipo_chunk is not null")
    n = F.length("texto")
    return c.groupBy("tipo_chunk").agg(F.count("*").alias("trozos"), F.sum(n).alias("letras"), F.sum(F.floor(n / 4)).alias("fichas"), F.count_if(F.col("n_chars") != n).alias("viejos"))


@query(f"WITH {CH}, {PA}, i AS (SELECT DISTINCT id FROM pa) SELECT ch.chunk_id, ch.doc_id, tipo_chunk FROM ch WHERE chunk_id IN (SELECT id FROM i)")
def multi_get(spark, sf):
    """Chunks fetched by id."""
    ids = passages(spark, sf).select(F.col("id").alias("chunk_id")).distinct()
    return chunks(spark, sf).join(ids, "chunk_id", "left_semi").select("chunk_id", "doc_id", "tipo_chunk")


@query(f"WITH {CH}, o AS (SELECT doc_id, min(struct_pack(i := {j('inicio', 'INTEGER')}, c := chunk_id)) AS m FROM ch WHERE {j('inicio')} IS NOT NULL GROUP BY doc_id) SELECT doc_id, m.c AS chunk_id, m.i AS inicio FROM o")
def first_chunk(spark, sf):
    """The first chunk of every document, in reading order, with no list of the others."""
    c = chunks(spark, sf, "inicio").where("inicio is not null")
    m = c.groupBy("doc_id").agg(F.min(F.struct("inicio", "chunk_id")).alias("m"))
    return m.select("doc_id", "m.chunk_id", "m.inicio")


@query("WITH f AS (SELECT id, formato, trim(concat_ws(' ', coalesce(texto_respuesta_correcta, ''), coalesce(respuesta_esperada, ''), coalesce(legal_basis, ''))) AS t FROM preguntas) SELECT id, t AS respuesta, CAST(len(t) AS INTEGER) AS largo FROM f")
def answer_text(spark, sf):
    """The fields of an answer as one text."""
    t = F.trim(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in ("texto_respuesta_correcta", "respuesta_esperada", "legal_basis")]))
    return table(spark, sf, "preguntas").select("id", t.alias("respuesta"), F.length(t).alias("largo"))


@query("SELECT id, CASE WHEN regexp_matches(trim(texto_respuesta_correcta), '^[A-Da-d][).:]') THEN upper(substr(trim(texto_respuesta_correcta), 1, 1)) ELSE respuesta_correcta END AS letra, map_keys(opciones)[1] AS primera FROM preguntas WHERE opciones IS NOT NULL")
def answer_letter(spark, sf):
    """The letter of a closed answer, taken only from unambiguous forms."""
    x = F.trim("texto_respuesta_correcta")
    return table(spark, sf, "preguntas").where("opciones is not null").select("id", F.when(x.rlike(r"^[A-Da-d][).:]"), F.upper(F.substring(x, 1, 1))).otherwise(F.col("respuesta_correcta")).alias("letra"), F.map_keys("opciones")[0].alias("primera"))


@query("SELECT event_id, TRY_CAST(json_extract_string(regexp_extract('nota ' || props || ' fin', '(?s)\\{.*\\}'), '$.k') AS INTEGER) AS k FROM events")
def outermost_json(spark, sf):
    """JSON taken out of the text around it."""
    body = F.regexp_extract(F.concat(F.lit("nota "), "props", F.lit(" fin")), r"(?s)\{.*\}", 0)
    return table(spark, sf, "events").select("event_id", F.from_json(body, "k int")["k"].alias("k"))


@query(rf"WITH {CH}, {PA}, t AS (SELECT pasaje_id, {fold('texto')} AS x FROM pa WHERE texto IS NOT NULL), c AS (SELECT DISTINCT pasaje_id, unnest(regexp_extract_all(x, 'articulo (\d+(?:\.\d+)*)', 1)) AS articulo FROM t) SELECT articulo, count(*) AS pasajes FROM c GROUP BY articulo")
def cited_articles(spark, sf):
    """J02 (single numbers only): article numbers that passages name, each counted once a passage."""
    c = passages(spark, sf).where("texto is not null").select("pasaje_id", F.explode(F.array_distinct(F.regexp_extract_all(T.fold("texto"), F.lit(r"articulo (\d+(?:\.\d+)*)"), F.lit(1)))).alias("articulo"))
    return c.groupBy("articulo").agg(F.count("*").alias("pasajes"))


@query("WITH l AS (SELECT id, legal_basis FROM preguntas WHERE legal_basis IS NOT NULL), r AS (SELECT id, split_part(legal_basis, ',', 1) AS cuerpo, regexp_extract(legal_basis, '([0-9.]+)$', 1) AS articulo FROM l) SELECT cuerpo, count(DISTINCT articulo) AS articulos, count(*) AS preguntas, array_to_string(list_sort(list(DISTINCT articulo))[1:3], ', ') AS primeros FROM r GROUP BY cuerpo")
def consulted_norms(spark, sf):
    """Bodies that questions rest on, with the number of articles and the first three in order."""
    r = table(spark, sf, "preguntas").where("legal_basis is not null").select(F.substring_index("legal_basis", ",", 1).alias("cuerpo"), F.regexp_extract("legal_basis", "([0-9.]+)$", 1).alias("articulo"))
    firsts = S.ranked(r.distinct(), ["cuerpo"], [F.col("articulo")], 3, "n").groupBy("cuerpo").agg(F.array_join(F.array_sort(F.collect_list("articulo")), ", ").alias("primeros"))
    return r.groupBy("cuerpo").agg(F.count_distinct("articulo").alias("articulos"), F.count("*").alias("preguntas")).join(firsts, "cuerpo")


@query("WITH c AS (SELECT 'cerradas' AS parte, 20.0 AS peso, count(*) FILTER (formato = 'multiple_choice') AS n FROM preguntas UNION ALL SELECT 'abiertas', 30.0, count(*) FILTER (formato = 'open_ended') FROM preguntas UNION ALL SELECT 'sin evaluar', 10.0, NULL), p AS (SELECT *, CASE WHEN n IS NOT NULL THEN peso * n / 400.0 END AS puntos FROM c) SELECT CAST(round(sum(puntos), 4) AS DOUBLE) AS puntos, CAST(round(sum(peso) FILTER (puntos IS NOT NULL), 4) AS DOUBLE) AS posibles FROM p")
def score_report(spark, sf):
    """Points and possible points; parts without a score don't count."""
    q = table(spark, sf, "preguntas")
    parts = [("cerradas", 20.0, F.count_if(F.col("formato") == "multiple_choice")), ("abiertas", 30.0, F.count_if(F.col("formato") == "open_ended")), ("sin evaluar", 10.0, F.lit(None).cast("long"))]
    g = q.agg(F.array(*[F.struct(F.lit(n).alias("parte"), F.lit(w).alias("peso"), c.alias("n")) for n, w, c in parts]).alias("p")).select(F.inline("p"))
    g = g.withColumn("puntos", F.col("peso") * F.col("n") / 400.0)
    return g.agg(F.round(F.sum("puntos"), 4).alias("puntos"), F.round(F.sum(F.when(F.col("puntos").isNotNull(), F.col("peso"))), 4).alias("posibles"))


@query(f"WITH {PA}, v AS (SELECT pasaje_id, split_part(doc_id, '_', 1) AS juez, score >= 0.5 AS voto, json_extract_string(metadatos, '$.vigencia') = 'derogada' AS mala FROM pa WHERE score IS NOT NULL AND NOT isnan(score)) SELECT juez, count(*) AS n, round(count(*) FILTER (voto <> coalesce(mala, false)) / CAST(count(*) AS DOUBLE), 4) AS acuerdo, count(*) FILTER (mala AND NOT voto) AS rechazos FROM v GROUP BY juez")
def judge_agreement(spark, sf):
    """Agreement of each judge with what is known, three-valued."""
    v = passages(spark, sf).where("score is not null and not isnan(score)").select(F.substring_index("doc_id", "_", 1).alias("juez"), (F.col("score") >= 0.5).alias("voto"), (F.get_json_object("metadatos", "$.vigencia") == "derogada").alias("mala"))
    return v.groupBy("juez").agg(F.count("*").alias("n"), F.round(F.count_if(F.col("voto") != F.coalesce("mala", F.lit(False))) / F.count("*"), 4).alias("acuerdo"), F.count_if(F.col("mala") & ~F.col("voto")).alias("rechazos"))


@query("WITH s(seleccion) AS (VALUES ('todo'), ('normas')), e(codificador) AS (VALUES ('a'), ('b')), p(perfil) AS (VALUES ('base'), ('topes')), f AS (SELECT DISTINCT formato FROM preguntas WHERE formato IS NOT NULL) SELECT array_to_string(list_filter([seleccion, codificador, perfil], lambda x: x <> 'base'), '__') AS brazo, formato FROM s, e, p, f")
def benchmark_arms(spark, sf):
    """R19 (names only): arms of a benchmark from a few options, named without the base profile."""
    options = {"seleccion": ["todo", "normas"], "codificador": ["a", "b"], "perfil": ["base", "topes"]}
    rows = table(spark, sf, "preguntas").where("formato is not null").select("formato").distinct()
    for name, values in options.items():
        rows = rows.withColumn(name, F.explode(F.array(*map(F.lit, values))))
    return rows.select(F.array_join(F.filter(F.array(*options), lambda x: x != "base"), "__").alias("brazo"), "formato")


@query(f"WITH {MA}, o AS (SELECT doc_id, CASE WHEN estado = 'ok' THEN archivos[1] END AS archivo FROM ma) SELECT doc_id, archivo, CASE WHEN archivo IS NULL THEN 'ausente' WHEN archivo LIKE '%.pdf' THEN 'pdf' WHEN archivo LIKE '%.html' THEN 'html' ELSE 'otro' END AS formato, coalesce(len(ma2.sha256) = len(ma2.archivos), false) AS completo FROM o JOIN (SELECT doc_id AS d, sha256, archivos FROM ma) ma2 ON ma2.d = o.doc_id")
def file_audit(spark, sf):
    """Files of each download, and whether every one has its hash."""
    m = manifest(spark, sf)
    f = F.when(F.col("estado") == "ok", F.col("archivos")[0])
    kind = F.when(f.isNull(), "ausente").when(f.endswith(".pdf"), "pdf").when(f.endswith(".html"), "html").otherwise("otro")
    return m.select("doc_id", f.alias("archivo"), kind.alias("formato"), F.coalesce(F.size("sha256") == F.when(F.col("archivos").isNotNull(), F.size("archivos")), F.lit(False)).alias("completo"))


@query(rf"WITH {CH}, {PA}, e AS (SELECT pa.pasaje_id, pa.doc_id, round(pa.score, 4) AS score, {j('inicio', 'INTEGER')} AS inicio, {j('fin', 'INTEGER')} AS fin FROM pa LEFT JOIN ch ON pa.id = ch.chunk_id) SELECT pasaje_id, doc_id, CASE WHEN isnan(score) THEN NULL ELSE score END AS score, CASE WHEN inicio >= 0 AND fin > inicio THEN inicio END AS inicio, CASE WHEN inicio >= 0 AND fin > inicio THEN fin END AS fin FROM e")
def submission_rows(spark, sf):
    """The fields that are handed in; offsets only where they are valid."""
    c = chunks(spark, sf, "inicio", "fin").select("chunk_id", "inicio", "fin")
    p = passages(spark, sf).select("pasaje_id", "id", "doc_id", F.round("score", 4).alias("score"))
    ok = (F.col("inicio") >= 0) & (F.col("fin") > F.col("inicio"))
    return p.join(c, F.col("id") == F.col("chunk_id"), "left").select("pasaje_id", "doc_id", F.when(~F.isnan("score"), F.col("score")).alias("score"), F.when(ok, F.col("inicio")).alias("inicio"), F.when(ok, F.col("fin")).alias("fin"))


@query(r"WITH t AS (SELECT id, respuesta_esperada AS x FROM preguntas WHERE respuesta_esperada IS NOT NULL) SELECT id, trim(regexp_replace(regexp_replace(x, '^(?i)(en resumen|en conclusión)[,:]? ', ''), ' +', ' ', 'g')) AS limpio, CAST(len(regexp_extract_all(x, '[^.!?]+[.!?]')) AS INTEGER) AS oraciones, array_to_string(list_transform(regexp_extract_all(x, '[^.!?]+[.!?]')[1:1], lambda v: trim(v)), ' ') AS primera FROM t")
def concise_answer(spark, sf):
    """Set phrases taken off, sentences counted, the first one kept."""
    x = F.col("respuesta_esperada")
    s = F.regexp_extract_all(x, F.lit("[^.!?]+[.!?]"), F.lit(0))
    clean = F.trim(F.regexp_replace(F.regexp_replace(x, "^(?i)(en resumen|en conclusión)[,:]? ", ""), " +", " "))
    return table(spark, sf, "preguntas").where("respuesta_esperada is not null").select("id", clean.alias("limpio"), F.size(s).alias("oraciones"), F.array_join(F.transform(F.slice(s, 1, 1), lambda v: F.trim(v)), " ").alias("primera"))


@query("WITH o AS (SELECT *, row_number() OVER (PARTITION BY formato ORDER BY CASE WHEN sub_tarea = 'precedente' THEN 0 ELSE 1 END, CASE WHEN formato = 'open_ended' THEN len(respuesta_esperada) ELSE id END, id) AS n FROM preguntas WHERE formato <> 'multiple_choice') SELECT formato, id, CAST(n AS INTEGER) AS n FROM o WHERE n <= CASE WHEN formato = 'open_ended' THEN 1 ELSE 2 END")
def style_examples(spark, sf):
    """Examples to write like: same task first, the shortest open answer."""
    q = table(spark, sf, "preguntas").where("formato <> 'multiple_choice'")
    key = F.when(F.col("formato") == "open_ended", F.length("respuesta_esperada").cast("long")).otherwise(F.col("id"))
    near = S.ranked(q.select("formato", "id", "sub_tarea", key.alias("k")), ["formato"], [F.when(F.col("sub_tarea") == "precedente", 0).otherwise(1), F.col("k"), F.col("id")], 2, "n")
    return near.where("n <= case when formato = 'open_ended' then 1 else 2 end").select("formato", "id", "n")
