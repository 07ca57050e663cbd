"""Manifest, deduplication, frontier and audit queries, and event windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import search as S
from ..session import plain_union
from ..sources.tables import chunks, latest, manifest, table
from ..streaming import windows
from .common import CH, MA, j, query


@query(f"WITH {MA} SELECT doc_id, estado, fuente, CAST(recibido_en AS VARCHAR) AS recibido FROM ma")
def manifest_merge(spark, sf):
    """The manifest as it stands: of rows sent again the last one."""
    got = manifest(spark, sf)
    stamp = F.regexp_replace(F.date_format("recibido_en", "yyyy-MM-dd HH:mm:ss.SSSSSS"), r"\.?0+$", "")
    whole = F.date_format("recibido_en", "yyyy-MM-dd HH:mm:ss")
    return got.select("doc_id", "estado", "fuente", F.when(F.date_format("recibido_en", "SSSSSS") == "000000", whole).otherwise(stamp).alias("recibido"))


@query("WITH d AS (SELECT DISTINCT doc_id, sha256(text) AS h FROM documents WHERE text IS NOT NULL AND trim(text) <> ''), f AS (SELECT h, min(doc_id) AS primero FROM d GROUP BY h) SELECT doc_id, CASE WHEN doc_id = primero THEN 'ok' ELSE 'duplicado' END AS estado, CASE WHEN doc_id <> primero THEN primero END AS duplicado_de FROM d JOIN f USING (h)")
def exact_dup_by_hash(spark, sf):
    """Documents whose content another one owned first. Hashes travel, texts don't."""
    d = table(spark, sf, "documents").where("trim(text) <> ''").select("doc_id", F.sha2("text", 256).alias("h")).distinct()
    first = d.groupBy("h").agg(F.min("doc_id").alias("primero"))
    own = F.col("doc_id") == F.col("primero")
    return d.join(first, "h").select("doc_id", F.when(own, "ok").otherwise("duplicado").alias("estado"), F.when(~own, F.col("primero")).alias("duplicado_de"))


@query(f"WITH {CH}, {MA}, h AS (SELECT doc_id FROM ma WHERE estado IN ('ok', 'duplicado')) SELECT DISTINCT doc_id FROM ch WHERE doc_id NOT IN (SELECT doc_id FROM h) UNION SELECT doc_id FROM ma WHERE doc_id NOT IN (SELECT doc_id FROM h)")
def resume_antijoin(spark, sf):
    """Documents that a run still has to fetch."""
    m = manifest(spark, sf)
    done = m.where("estado in ('ok', 'duplicado')").select("doc_id")
    return plain_union(chunks(spark, sf).select("doc_id"), m.select("doc_id"), by=["doc_id"]).distinct().join(done, "doc_id", "left_anti")


@query(
    f"""WITH {MA}, e AS (SELECT doc_id, unnest(map_entries(enlaces)) AS k, areas FROM ma WHERE estado = 'ok'),
    g AS (SELECT k.key AS destino, CAST(sum(k.value) AS BIGINT) AS citas, count(*) AS citado_por, list_sort(list_distinct(flatten(list(coalesce(areas, []))))) AS areas FROM e GROUP BY k.key)
    SELECT destino, citas, citado_por, array_to_string(areas, '; ') AS areas, CASE WHEN citas >= 30 THEN 'normal' ELSE 'baja' END AS prioridad, CAST(row_number() OVER (ORDER BY citas DESC, destino) AS INTEGER) AS puesto
    FROM g WHERE citas >= 3 AND destino NOT IN (SELECT doc_id FROM ma WHERE profundidad = 0 AND estado = 'ok')"""
)
def link_frontier(spark, sf):
    """Documents that links lead to, with their counts and areas, without those at level 0.

    The place is given by one total order, over aggregated targets only.
    """
    from ..operators.ordered import global_rank

    m = manifest(spark, sf)
    e = m.where("estado = 'ok'").select(F.explode("enlaces").alias("destino", "n"), "areas")
    sums = e.groupBy("destino").agg(F.sum("n").alias("citas"), F.count("*").alias("citado_por"))
    areas = e.select("destino", F.explode("areas").alias("a")).distinct().groupBy("destino").agg(F.array_join(F.sort_array(F.collect_set("a")), "; ").alias("areas"))
    known = m.where("profundidad = 0 and estado = 'ok'").select(F.col("doc_id").alias("destino"))
    got = sums.where("citas >= 3").join(known, "destino", "left_anti").join(areas, "destino", "left").withColumn("areas", F.coalesce("areas", F.lit("")))
    got = got.withColumn("prioridad", F.when(F.col("citas") >= 30, "normal").otherwise("baja"))
    return global_rank(got, [F.col("citas").desc(), F.col("destino")], "puesto")


@query(
    f"""WITH {CH}, {MA}, c AS (SELECT doc_id, count(*) AS trozos, count(DISTINCT CASE WHEN articulo_id IS NOT NULL THEN articulo_id END) AS articulos, max({j('titulo')}) AS titulo, max({j('tipo_documento')}) AS tipo, max({j('anio')}) AS anio FROM ch GROUP BY doc_id)
    SELECT c.*, ma.fuente, CAST(len(ma.archivos) AS INTEGER) AS archivos FROM c JOIN ma ON c.doc_id = ma.doc_id WHERE ma.estado = 'ok'"""
)
def delivery_manifest(spark, sf):
    """What is delivered of each document, joined to its download."""
    c = chunks(spark, sf, "titulo", "tipo_documento", "anio")
    g = c.groupBy("doc_id").agg(F.count("*").alias("trozos"), F.count_distinct("articulo_id").alias("articulos"), F.max("titulo").alias("titulo"), F.max("tipo_documento").alias("tipo"), F.max("anio").alias("anio"))
    ok = manifest(spark, sf).where("estado = 'ok'").select("doc_id", "fuente", F.size("archivos").alias("archivos"))
    return g.join(ok, "doc_id")


@query(f"WITH {MA} SELECT coalesce(origen, '*') AS origen, coalesce(CAST(profundidad AS VARCHAR), '*') AS nivel, coalesce(estado, '*') AS estado, count(*) AS n FROM ma GROUP BY GROUPING SETS ((origen, profundidad), (origen), (estado), ())")
def summary_grouping_sets(spark, sf):
    """Several groupings in one pass."""
    m = manifest(spark, sf).select("origen", "profundidad", "estado")
    got = m.groupingSets([[F.col("origen"), F.col("profundidad")], [F.col("origen")], [F.col("estado")], []], "origen", "profundidad", "estado").agg(F.count("*").alias("n"))
    return got.select(F.coalesce("origen", F.lit("*")).alias("origen"), F.coalesce(F.col("profundidad").cast("string"), F.lit("*")).alias("nivel"), F.coalesce("estado", F.lit("*")).alias("estado"), "n")


@query(f"WITH {MA}, f AS (SELECT coalesce(fuente, '(ninguna)') AS fuente, split_part(coalesce(error, ''), ':', 1) AS motivo, count(*) AS n FROM ma WHERE estado = 'falla' GROUP BY ALL), s AS (SELECT unnest(sha256) AS h, doc_id FROM ma WHERE sha256 IS NOT NULL), d AS (SELECT h, count(DISTINCT doc_id) AS n FROM s GROUP BY h HAVING count(DISTINCT doc_id) > 1) SELECT 'falla' AS clase, fuente AS clave, motivo AS detalle, n FROM f UNION ALL SELECT 'mismo contenido', h, '', n FROM d UNION ALL SELECT 'estado', estado, '', count(*) FROM ma GROUP BY estado")
def download_audit(spark, sf):
    """States, failures by source and reason, contents that several documents share."""
    m = manifest(spark, sf)
    fails = m.where("estado = 'falla'").groupBy(F.coalesce("fuente", F.lit("(ninguna)")).alias("clave"), F.substring_index(F.coalesce("error", F.lit("")), ":", 1).alias("detalle")).agg(F.count("*").alias("n"))
    same = m.select(F.explode("sha256").alias("clave"), "doc_id").groupBy("clave").agg(F.count_distinct("doc_id").alias("n")).where("n > 1")
    states = m.groupBy(F.col("estado").alias("clave")).agg(F.count("*").alias("n"))
    out = fails.select(F.lit("falla").alias("clase"), "clave", "detalle", "n")
    for name, rows in (("mismo contenido", same), ("estado", states)):
        out = out.unionByName(rows.select(F.lit(name).alias("clase"), "clave", F.lit("").alias("detalle"), "n"))
    return out


@query(f"WITH {MA}, c AS (SELECT doc_id, unnest(urls) AS u, generate_subscripts(urls, 1) AS i FROM ma WHERE urls IS NOT NULL UNION ALL SELECT doc_id, url, 0 FROM ma WHERE url IS NOT NULL), r AS (SELECT doc_id, u, CASE WHEN u LIKE '%.pdf' THEN 0 WHEN u LIKE '%.html' THEN 1 ELSE 2 END AS clase, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN u LIKE '%.pdf' THEN 0 WHEN u LIKE '%.html' THEN 1 ELSE 2 END, i, u) AS n, count(*) OVER (PARTITION BY doc_id) AS candidatos FROM c) SELECT doc_id, u AS url, clase, candidatos FROM r WHERE n = 1")
def source_resolution(spark, sf):
    """The preferred one of a document's addresses, PDF first, then the order given."""
    m = manifest(spark, sf)
    every = F.concat(F.array("url"), F.coalesce("urls", F.expr("cast(array() as array<string>)")))
    c = m.select("doc_id", F.posexplode(every).alias("i", "u"))
    c = c.where("u is not null").withColumn("clase", F.when(F.col("u").endswith(".pdf"), 0).when(F.col("u").endswith(".html"), 1).otherwise(2))
    best = S.ranked(c, ["doc_id"], [F.col("clase"), F.col("i"), F.col("u")], 1, "n")
    return best.join(c.groupBy("doc_id").agg(F.count("*").alias("candidatos")), "doc_id").select("doc_id", F.col("u").alias("url"), "clase", "candidatos")


@query(f"WITH {MA}, a AS (SELECT doc_id, unnest(areas) AS area FROM ma) SELECT area, count(*) AS documentos FROM a GROUP BY area")
def area_counts(spark, sf):
    """Documents of each area."""
    return manifest(spark, sf).select(F.explode("areas").alias("area")).groupBy("area").agg(F.count("*").alias("documentos"))


@query(f"WITH {MA}, p AS (SELECT split_part(doc_id, '_', 1) AS carril, estado FROM ma) SELECT carril, count(*) AS total, count(*) FILTER (estado = 'ok') AS hechos, count(*) FILTER (estado = 'falla') AS fallidos, round(100.0 * count(*) FILTER (estado <> 'falla') / count(*), 2) AS avance FROM p GROUP BY carril")
def lane_progress(spark, sf):
    """Progress of each lane of the downloader."""
    p = manifest(spark, sf).select(F.substring_index("doc_id", "_", 1).alias("carril"), "estado")
    return p.groupBy("carril").agg(F.count("*").alias("total"), F.count_if(F.col("estado") == "ok").alias("hechos"), F.count_if(F.col("estado") == "falla").alias("fallidos"), F.round(100.0 * F.count_if(F.col("estado") != "falla") / F.count("*"), 2).alias("avance"))


@query(f"WITH {CH}, {MA} SELECT coalesce(c.doc_id, ma.doc_id) AS doc_id, c.doc_id IS NULL AS sin_trozos, ma.doc_id IS NULL AS sin_descarga FROM (SELECT DISTINCT doc_id FROM ch) c FULL JOIN ma ON c.doc_id = ma.doc_id WHERE c.doc_id IS NULL OR ma.doc_id IS NULL")
def orphans(spark, sf):
    """Documents on one side only."""
    c = chunks(spark, sf).select("doc_id").distinct().withColumn("c", F.lit(True))
    m = manifest(spark, sf).select("doc_id").withColumn("m", F.lit(True))
    return c.join(m, "doc_id", "full").where("c is null or m is null").select("doc_id", F.col("c").isNull().alias("sin_trozos"), F.col("m").isNull().alias("sin_descarga"))


@query("SELECT chunk_id, CAST(count(*) AS BIGINT) AS envios, CAST(date_diff('day', min(cargado_en), max(cargado_en)) AS BIGINT) AS dias FROM chunks GROUP BY chunk_id HAVING count(*) > 1")
def resent_rows(spark, sf):
    """Chunks that were sent more than once, and how far apart."""
    g = table(spark, sf, "chunks").groupBy("chunk_id").agg(F.count("*").alias("envios"), F.min("cargado_en").alias("a"), F.max("cargado_en").alias("b")).where("envios > 1")
    return g.select("chunk_id", "envios", F.datediff("b", "a").cast("long").alias("dias"))


@query("SELECT CAST(date_trunc('hour', ts) AS VARCHAR) AS hora, event_type, count(*) AS n, round(sum(value), 4) AS suma FROM events GROUP BY ALL")
def tumbling_windows(spark, sf):
    """Extension: hourly windows over the events; the same function runs on a stream."""
    got = windows.tumbling(table(spark, sf, "events"), "1 hour")
    return got.select(F.date_format("inicio", "yyyy-MM-dd HH:mm:ss").alias("hora"), "event_type", "n", F.round("suma", 4).alias("suma"))


@query("WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS nueva FROM events), g AS (SELECT *, sum(nueva) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM e) SELECT user_id, count(*) AS n, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS desde FROM g GROUP BY user_id, s")
def session_windows(spark, sf):
    """Extension: sessions that end after half an hour without an event."""
    got = windows.sessions(table(spark, sf, "events"), "30 minutes")
    return got.select("user_id", "n", F.date_format("inicio", "yyyy-MM-dd HH:mm:ss").alias("desde"))


@query("SELECT tipo_chunk, count(DISTINCT chunk_id) AS n FROM chunks WHERE chunk_id IS NOT NULL GROUP BY tipo_chunk")
def stream_append(spark, sf):
    """Landed chunk rows read as a stream, rows sent again dropped by a watermarked key, counted by kind."""
    return windows.append_chunks(spark, sf)
