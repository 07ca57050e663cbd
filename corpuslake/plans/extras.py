"""Smaller operators: records, front matter, recounts, lookups, stems, tolerant parsing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import search as S
from ..sources.tables import chunks, lookup, manifest, passages, table
from .common import CH, MA, PA, fold, j, query
from .scoring import _OPT, _choice

#: Index settings that a reader must share with the index it opens.
TOKENIZER = {"pliega": True, "une_millares": True, "raices": False, "vacias": False}


@query(f"WITH {PA}, {_OPT}, n AS (SELECT DISTINCT pregunta_id AS id FROM pa WHERE pregunta_id IS NOT NULL) SELECT q.id, CAST((CASE WHEN el.apoyo IS NULL OR el.apoyo = 0 THEN 1 ELSE 0 END) + (CASE WHEN q.legal_basis IS NULL THEN 1 ELSE 0 END) + (CASE WHEN n.id IS NULL THEN 1 ELSE 0 END) AS INTEGER) AS problemas FROM preguntas q LEFT JOIN el ON q.id = el.id LEFT JOIN n ON q.id = n.id")
def problem_count(spark, sf):
    """Problems of an answer: no support, no basis, nothing retrieved."""
    q = table(spark, sf, "preguntas").select("id", F.col("legal_basis").isNull().cast("int").alias("b"))
    n = passages(spark, sf).where("pregunta_id is not null").select(F.col("pregunta_id").alias("id"), F.lit(0).alias("v")).distinct()
    got = q.join(_choice(spark, sf).select("id", "apoyo"), "id", "left").join(n, "id", "left")
    return got.select("id", (F.expr("cast(apoyo is null or apoyo = 0 as int)") + F.col("b") + F.coalesce("v", F.lit(1))).alias("problemas"))


@query("SELECT id, formato, true AS abstencion, CASE WHEN formato = 'multiple_choice' THEN 'A' END AS letra, CASE WHEN formato <> 'multiple_choice' THEN 'No hay base suficiente.' END AS texto FROM preguntas WHERE formato IS NOT NULL")
def abstention_records(spark, sf):
    """The record of each format that stands for no answer."""
    closed = F.col("formato") == "multiple_choice"
    return table(spark, sf, "preguntas").where("formato is not null").select("id", "formato", F.lit(True).alias("abstencion"), F.when(closed, "A").alias("letra"), F.when(~closed, "No hay base suficiente.").alias("texto"))


_MD = "'---' || chr(10) || 'doc_id: ' || doc_id || chr(10) || 'source: ' || coalesce(source, '') || chr(10) || '---' || chr(10) || chr(10) || text"


@query(f"WITH m AS (SELECT doc_id, text, {_MD} AS md FROM documents WHERE text IS NOT NULL) SELECT doc_id, CAST(strpos(md, chr(10) || '---' || chr(10)) + 5 AS INTEGER) AS cuerpo_en, regexp_extract(md, 'source: ([^\\n]*)', 1) AS fuente, substr(md, strpos(md, chr(10) || '---' || chr(10)) + 6) = text AS igual FROM m")
def front_matter(spark, sf):
    """Documents written with front matter, read back with the offset of the body."""
    md = F.concat(F.lit("---\ndoc_id: "), F.col("doc_id").cast("string"), F.lit("\nsource: "), F.coalesce("source", F.lit("")), F.lit("\n---\n\n"), F.col("text"))
    m = table(spark, sf, "documents").where("text is not null").select("doc_id", "text", md.alias("md"))
    at = F.instr("md", "\n---\n")
    body = F.substring(F.col("md"), at + F.lit(6), F.length("md"))
    return m.select("doc_id", (at + 5).alias("cuerpo_en"), F.regexp_extract("md", "source: ([^\\n]*)", 1).alias("fuente"), (body == F.col("text")).alias("igual"))


@query(rf"WITH {CH} SELECT chunk_id, tipo_chunk, CAST(len(x) AS INTEGER) AS n_chars, coalesce({j('n_chars', 'INTEGER')} = len(x), false) AS al_dia, {j('titulo')} AS titulo, {j('anio')} AS anio FROM (SELECT *, {j('texto')} AS x FROM ch) WHERE x IS NOT NULL")
def chunk_rows(spark, sf):
    """A chunk's row with its length counted anew and the fields it inherits."""
    c = chunks(spark, sf, "texto", "n_chars", "titulo", "anio").where("texto is not null")
    return c.select("chunk_id", "tipo_chunk", F.length("texto").alias("n_chars"), F.coalesce(F.col("n_chars") == F.length("texto"), F.lit(False)).alias("al_dia"), "titulo", "anio")


@query(rf"WITH d AS (SELECT DISTINCT doc_id, n_chars, text FROM documents WHERE text IS NOT NULL), r AS (SELECT doc_id, n_chars / CAST(greatest(len(text), 1) AS DOUBLE) AS razon, len(regexp_extract_all(text, '(?:^|\n)(?:ART[IÍ]CULO|Artículo|Art\.) ')) AS articulos FROM d) SELECT doc_id, round(razon, 6) AS razon, CAST(articulos AS INTEGER) AS articulos, CASE WHEN razon IS NULL THEN 'REVISAR' WHEN razon < 0.5 THEN 'FALLA' WHEN razon < 0.8 OR razon > 1.2 THEN 'REVISAR' ELSE 'OK' END AS veredicto FROM r")
def coverage_recount(spark, sf):
    """Recorded length against a recount, with a verdict, and articles counted in the text."""
    d = table(spark, sf, "documents").where("text is not null").select("doc_id", "n_chars", "text").distinct()
    r = d.select("doc_id", (F.col("n_chars") / F.greatest(F.length("text"), F.lit(1))).alias("r"), F.regexp_count("text", F.lit(r"(?:^|\n)(?:ART[IÍ]CULO|Artículo|Art\.) ")).alias("articulos"))
    verdict = F.when(F.col("r").isNull(), "REVISAR").when(F.col("r") < 0.5, "FALLA").when((F.col("r") < 0.8) | (F.col("r") > 1.2), "REVISAR").otherwise("OK")
    return r.select("doc_id", F.round("r", 6).alias("razon"), "articulos", verdict.alias("veredicto"))


@query(rf"WITH {CH} SELECT chunk_id, md5(trim(regexp_replace(regexp_replace({j('texto')}, ' ?\[[^\]\n]*\]', '', 'g'), ' +', ' ', 'g'))) AS sin_citas FROM ch WHERE strpos({j('texto')}, '[') > 0")
def suppress_citations(spark, sf):
    """Bracketed ids taken out, spaces tidied."""
    c = chunks(spark, sf, "texto").where("contains(texto, '[')")
    return c.select("chunk_id", F.md5(F.trim(F.regexp_replace(F.regexp_replace("texto", r" ?\[[^\]\n]*\]", ""), " +", " "))).alias("sin_citas"))


@query(rf"WITH {CH} SELECT chunk_id, md5(trim(regexp_replace(replace(replace(regexp_replace({j('texto')}, '<[^<>]+>', ' ', 'g'), '&nbsp;', ' '), '&amp;', '&'), '[ \t\n]+', ' ', 'g'))) AS plano FROM ch WHERE regexp_matches({j('texto')}, '<[a-zA-Z/]')")
def strip_tags(spark, sf):
    """Tags off, the commonest entities opened, white space collapsed."""
    x = F.replace(F.replace(F.regexp_replace("texto", "<[^<>]+>", " "), F.lit("&nbsp;"), F.lit(" ")), F.lit("&amp;"), F.lit("&"))
    return chunks(spark, sf, "texto").where(F.col("texto").rlike("<[a-zA-Z/]")).select("chunk_id", F.md5(F.trim(F.regexp_replace(x, "[ \\t\\n]+", " "))).alias("plano"))


@query("WITH b AS (SELECT id, 'cerrada' AS clase, texto_respuesta_correcta AS respuesta FROM preguntas WHERE formato = 'multiple_choice' UNION ALL SELECT id, 'abierta', respuesta_esperada FROM preguntas WHERE formato <> 'multiple_choice') SELECT id, clase, respuesta, CAST(row_number() OVER (PARTITION BY clase ORDER BY id) AS INTEGER) AS n FROM b WHERE respuesta IS NOT NULL")
def question_bank(spark, sf):
    """Both kinds of questions in one bank, ordered."""
    q = table(spark, sf, "preguntas").where("formato is not null")
    closed = F.col("formato") == "multiple_choice"
    b = q.select("id", F.when(closed, "cerrada").otherwise("abierta").alias("clase"), F.when(closed, F.col("texto_respuesta_correcta")).otherwise(F.col("respuesta_esperada")).alias("respuesta")).where("respuesta is not null")
    return S.ranked(b, ["clase"], [F.col("id")], None, "n")  # the bank is a fixed table of a few hundred rows


@query(f"WITH {MA}, l(fuente, clave) AS (VALUES ('Normograma de Hacienda', 'hacienda'), ('Normativa del Consejo', 'consejo'), ('Relatoría de Casación', 'casacion')) SELECT doc_id, coalesce(l.clave, 'otra') AS clave FROM ma LEFT JOIN l ON ma.fuente = l.fuente")
def source_lookup(spark, sf):
    """A small lookup joined with a default."""
    rows = [("Normograma de Hacienda", "hacienda"), ("Normativa del Consejo", "consejo"), ("Relatoría de Casación", "casacion")]
    small = spark.createDataFrame(rows, "fuente string, clave string")
    return manifest(spark, sf).select("doc_id", "fuente").join(lookup(small), "fuente", "left").select("doc_id", F.coalesce("clave", F.lit("otra")).alias("clave"))


@query(r"WITH d AS (SELECT doc_id, text, regexp_extract(text, '(?:DECRETO|Decreto) (?:NÚMERO )?(\d+) (?:DE|de) (\d{4})', 1) AS n, regexp_extract(text, '(?:DECRETO|Decreto) (?:NÚMERO )?(\d+) (?:DE|de) (\d{4})', 2) AS y FROM documents WHERE text IS NOT NULL AND NOT regexp_matches(text, '(?i)proyecto de')) SELECT n AS numero, y AS anio, min(doc_id) AS doc_id, count(*) AS veces FROM d WHERE n <> '' GROUP BY n, y")
def decree_rows(spark, sf):
    """Decrees by number and year, drafts left out, the first of each kept."""
    p = r"(?:DECRETO|Decreto) (?:NÚMERO )?(\d+) (?:DE|de) (\d{4})"
    d = table(spark, sf, "documents").where("text is not null").where(~F.col("text").rlike("(?i)proyecto de")).select("doc_id", F.regexp_extract("text", p, 1).alias("numero"), F.regexp_extract("text", p, 2).alias("anio"))
    return d.where("numero <> ''").groupBy("numero", "anio").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("veces"))


@query(rf"WITH w AS (SELECT DISTINCT unnest(regexp_extract_all({fold('text')}, '[\p{{L}}]+')) AS palabra FROM documents WHERE text IS NOT NULL) SELECT palabra, CASE WHEN len(palabra) < 5 THEN palabra ELSE regexp_replace(regexp_replace(palabra, '(es|s)$', ''), '(o|a|e)$', '') END AS raiz FROM w")
def light_stems(spark, sf):
    """A light stem of every word: plural and final vowel off. Off by default in the index."""
    w = table(spark, sf, "documents").where("text is not null").select(F.explode(F.array_distinct(F.regexp_extract_all(T.fold("text"), F.lit(r"[\p{L}]+"), F.lit(0)))).alias("palabra")).distinct()
    return w.select("palabra", F.when(F.length("palabra") < 5, F.col("palabra")).otherwise(F.regexp_replace(F.regexp_replace("palabra", "(es|s)$", ""), "(o|a|e)$", "")).alias("raiz"))


@query(f"WITH {PA} SELECT pasaje_id, metadatos IS NOT NULL AND json_valid(metadatos) AS legible, json_extract_string(metadatos, '$.vigencia') AS vigencia, coalesce(json_extract_string(metadatos, '$.tipo_chunk'), 'sin tipo') AS tipo FROM pa")
def tolerant_parse(spark, sf):
    """Metadata parsed with whatever it holds; absent fields get a default."""
    m = F.from_json("metadatos", "vigencia string, tipo_chunk string, titulo string")
    return passages(spark, sf).select("pasaje_id", m.alias("m")).select("pasaje_id", F.col("m").isNotNull().alias("legible"), "m.vigencia", F.coalesce("m.tipo_chunk", F.lit("sin tipo")).alias("tipo"))


@query("WITH e(clave, indice) AS (VALUES ('pliega', true), ('une_millares', true), ('raices', false), ('vacias', false)), l(clave, lector) AS (VALUES ('pliega', true), ('une_millares', true), ('raices', true), ('vacias', false)) SELECT clave, indice, lector, indice = lector AS concuerda FROM e JOIN l USING (clave)")
def index_settings(spark, sf):
    """Settings stored with an index against a reader's; a reader must refuse an index that differs."""
    kept = spark.createDataFrame(list(TOKENIZER.items()), "clave string, indice boolean")
    own = spark.createDataFrame(list((TOKENIZER | {"raices": True}).items()), "clave string, lector boolean")
    return kept.join(lookup(own), "clave").withColumn("concuerda", F.col("indice") == F.col("lector"))


@query("WITH l(letra) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) SELECT q.id, l.letra, coalesce(opciones[l.letra], '') AS texto FROM preguntas q, l WHERE opciones IS NOT NULL")
def fill_boxes(spark, sf):
    """Named boxes filled from a map, empty where it has none."""
    q = table(spark, sf, "preguntas").where("opciones is not null")
    letters = F.explode(F.array(*[F.lit(x) for x in "ABCDE"])).alias("letra")
    return q.select("id", "opciones", letters).select("id", "letra", F.coalesce(F.try_element_at("opciones", F.col("letra")), F.lit("")).alias("texto"))
