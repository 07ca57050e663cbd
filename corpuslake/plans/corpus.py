"""Text, segmentation, metadata and audit queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import segment
from ..operators.ordered import running_sum, with_lag
from ..sources.tables import chunks, table
from .common import CH, fold, j, query

AREAS = [
    ("Derecho comercial", r"sociedad|mercantil|accionista"),
    ("Derecho laboral", r"salario|empleador|huelga|sindica"),
    ("Derecho tributario", r"tribut|impuesto|arancel|exencion"),
    ("Derecho de familia", r"adopcion|divorcio|parentesco|filiacion"),
    ("Seguridad social", r"pension|cesantia|invalidez"),
]
SIGLAS = {"FALLA": "se decide", "RESUELVE": "parte resolutiva", "DECRETA": "parte dispositiva"}


@query(f"WITH {CH} SELECT chunk_id, CAST(len({fold(j('texto'))}) AS INTEGER) AS largo, md5({fold(j('texto'))}) AS huella FROM ch WHERE {j('texto')} IS NOT NULL")
def fold_text(spark, sf):
    """Lower case without accents."""
    f = T.fold("texto")
    return chunks(spark, sf, "texto").where("texto is not null").select("chunk_id", F.length(f).alias("largo"), F.md5(f).alias("huella"))


@query(
    r"""WITH d AS (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL)
    SELECT doc_id, CAST(len(regexp_extract_all(translate(lower(text), 'áàâäãåéèêëíìîïóòôöõúùûüñç', 'aaaaaaeeeeiiiiooooouuuunc'), '[\p{L}\p{N}]+')) AS INTEGER) AS palabras,
    CAST(len(list_distinct(regexp_extract_all(translate(lower(text), 'áàâäãåéèêëíìîïóòôöõúùûüñç', 'aaaaaaeeeeiiiiooooouuuunc'), '[\p{L}\p{N}]+'))) AS INTEGER) AS distintas FROM d"""
)
def word_counts(spark, sf):
    """T02 without stems: words of each training text."""
    w = F.regexp_extract_all(T.fold("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return table(spark, sf, "documents").where("text is not null").select("doc_id", F.size(w).alias("palabras"), F.size(F.array_distinct(w)).alias("distintas"))


@query(
    r"""WITH pa AS (SELECT DISTINCT pasaje_id, texto FROM pasajes WHERE texto IS NOT NULL),
    w AS (SELECT pasaje_id, regexp_extract_all(lower(CASE WHEN strpos(texto, chr(10)) > 0 THEN substr(texto, strpos(texto, chr(10)) + 1) ELSE texto END), '[\p{L}\p{N}_]+') AS ws FROM pa),
    s AS (SELECT pasaje_id, CASE WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS sh FROM w)
    SELECT pasaje_id, CAST(len(sh) AS INTEGER) AS tejas, list_min(sh) AS primera FROM s"""
)
def shingle_sets(spark, sf):
    """Five-word shingles of a passage's body."""
    rows = table(spark, sf, "pasajes").where("texto is not null").select("pasaje_id", "texto").dropDuplicates(["pasaje_id"])
    return rows.select("pasaje_id", T.shingles("texto").alias("s")).select("pasaje_id", F.size("s").alias("tejas"), F.array_min("s").alias("primera"))


@query(
    rf"""WITH {CH}, t AS (SELECT chunk_id, {j('texto')} AS x FROM ch)
    SELECT chunk_id, round(list_sum(list_transform(regexp_extract_all(x, '~~(.+?)~~', 1), lambda v: len(v))) / CAST(greatest(len(x), 1) AS DOUBLE), 6) AS tachado
    FROM t WHERE x LIKE '%~~%' AND len(regexp_extract_all(x, '~~(.+?)~~', 1)) > 0"""
)
def strike_fraction(spark, sf):
    """Share of a chunk's text that is struck out."""
    rows = chunks(spark, sf, "texto").where("contains(texto, '~~')").select("chunk_id", F.round(T.struck("texto"), 6).alias("tachado"))
    return rows.where("tachado > 0")


@query(
    rf"""WITH {CH}, t AS (SELECT chunk_id, {j('texto')} AS x FROM ch WHERE {j('texto')} IS NOT NULL)
    SELECT chunk_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '(?m)^> ?', '', 'g'), '\*\*', '', 'g'), '\\([*_~`#])', '\1', 'g'), '\n(?:[ \t]*\n)+', chr(10), 'g')) AS limpio FROM t"""
)
def clean_lines(spark, sf):
    """Quote and bold marks, escapes and blank lines removed."""
    return chunks(spark, sf, "texto").where("texto is not null").select("chunk_id", F.md5(T.clean_lines("texto")).alias("limpio"))


@query(
    rf"""WITH {CH}, t AS (SELECT chunk_id, {j('texto')} AS x FROM ch WHERE {j('texto')} IS NOT NULL)
    SELECT chunk_id, md5(trim(regexp_replace(regexp_replace(replace(replace(replace(x, 'ﬁ', 'fi'), 'ﬂ', 'fl'), 'ﬀ', 'ff'), '[​‌‍﻿�\x{{AD}}]', '', 'g'), '[ \t\n\r\x{{A0}}]+', ' ', 'g'))) AS limpio FROM t"""
)
def clean_text(spark, sf):
    """Ligatures, zero-width and replacement characters, white space."""
    return chunks(spark, sf, "texto").where("texto is not null").select("chunk_id", F.md5(T.clean_text("texto")).alias("limpio"))


@query(
    rf"""WITH {CH}, t AS (SELECT chunk_id, {j('texto')} AS x FROM ch)
    SELECT chunk_id, CAST(len(regexp_extract_all(x, '\p{{L}}[-\x{{AD}}]\n\p{{Ll}}')) AS INTEGER) AS cortes,
    md5(regexp_replace(x, '(\p{{L}})[-\x{{AD}}]\n(\p{{Ll}})', '\1\2', 'g')) AS unido FROM t WHERE regexp_matches(x, '\p{{L}}[-\x{{AD}}]\n\p{{Ll}}')"""
)
def joined_hyphens(spark, sf):
    """Words broken at line ends joined."""
    p = "\\p{L}[-­]\n\\p{Ll}"
    rows = chunks(spark, sf, "texto").where(F.col("texto").rlike(p))
    return rows.select("chunk_id", F.regexp_count("texto", F.lit(p)).alias("cortes"), F.md5(T.joined_hyphens("texto")).alias("unido"))


@query(
    rf"""WITH d AS (SELECT DISTINCT doc_id, {fold('text')} AS x FROM documents WHERE text IS NOT NULL),
    a AS (SELECT doc_id, list_sort(list_filter([{', '.join(f"CASE WHEN regexp_matches(x, '{p}') THEN '{n}' END" for n, p in AREAS)}], lambda v: v IS NOT NULL)) AS l FROM d)
    SELECT doc_id, CASE WHEN len(l) = 0 THEN 'sin área' ELSE array_to_string(l, '; ') END AS areas FROM a"""
)
def area_classifier(spark, sf):
    """Areas of a text by folded patterns, several at once, with a default."""
    rows = table(spark, sf, "documents").where("text is not null")
    return rows.select("doc_id", F.array_join(T.labels("text", AREAS, "sin área"), "; ").alias("areas"))


@query(
    f"""WITH {CH}, d AS (SELECT DISTINCT doc_id FROM ch)
    SELECT doc_id, split_part(doc_id, '_', 1) AS tipo, coalesce(nullif(regexp_extract(doc_id, '^[a-z]+_(.+)_[0-9]+$', 1), ''), '') AS numero,
    CAST(nullif(regexp_extract(doc_id, '_([0-9]+)$', 1), '') AS INTEGER) AS anio,
    CASE WHEN doc_id LIKE 'jurisprudencia_%' THEN 'Sentencia ' || upper(regexp_extract(doc_id, '^[a-z]+_(.+)_[0-9]+$', 1)) || ' de ' || regexp_extract(doc_id, '_([0-9]+)$', 1)
    ELSE upper(substr(doc_id, 1, 1)) || substr(split_part(doc_id, '_', 1), 2) || ' ' || regexp_extract(doc_id, '^[a-z]+_(.+)_[0-9]+$', 1) || ' de ' || regexp_extract(doc_id, '_([0-9]+)$', 1) END AS nombre,
    doc_id LIKE 'jurisprudencia_%' AS sentencia FROM d"""
)
def doc_metadata(spark, sf):
    """Type, number, year and citable name from the id."""
    rows = chunks(spark, sf).select("doc_id").distinct()
    kind, number, year = F.substring_index("doc_id", "_", 1), F.regexp_extract("doc_id", "^[a-z]+_(.+)_[0-9]+$", 1), F.regexp_extract("doc_id", "_([0-9]+)$", 1)
    ruling = F.col("doc_id").startswith("jurisprudencia_")
    title = F.concat(F.upper(F.substring("doc_id", 1, 1)), F.substring(kind, F.lit(2), F.length(kind)), F.lit(" "), number)
    name = F.concat(F.when(ruling, F.concat(F.lit("Sentencia "), F.upper(number))).otherwise(title), F.lit(" de "), year)
    return rows.select("doc_id", kind.alias("tipo"), number.alias("numero"), F.expr("try_cast(regexp_extract(doc_id, '_([0-9]+)$', 1) as int)").alias("anio"), name.alias("nombre"), ruling.alias("sentencia"))


@query(
    rf"""WITH {CH}, a AS (SELECT DISTINCT doc_id, {j('articulo')} AS articulo FROM ch WHERE {j('articulo')} IS NOT NULL),
    k AS (SELECT doc_id, articulo, array_to_string(list_transform(regexp_extract_all(articulo, '\d+'), lambda v: lpad(v, 6, '0')), '.') AS clave FROM a)
    SELECT doc_id, articulo, clave, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY clave, articulo) AS INTEGER) AS orden FROM k"""
)
def natural_sort_key(spark, sf):
    """Article numbers in their natural order."""
    rows = chunks(spark, sf, "articulo").where("articulo is not null").select("doc_id", "articulo").distinct().withColumn("clave", T.natural_key("articulo"))
    rows = with_lag(rows, ["doc_id"], ["clave", "articulo"], ["clave"]).withColumn("uno", F.lit(1))
    return running_sum(rows, ["doc_id"], ["clave", "articulo"], "uno", "orden").select("doc_id", "articulo", "clave", "orden")


_HEAD = f"{j('nombre_citable')} || coalesce(' › ' || array_to_string(CAST(json_extract(datos, '$.ruta') AS VARCHAR[]), ' › '), '') || CASE WHEN coalesce({j('vigencia')}, 'sin_marca') = 'sin_marca' THEN '' ELSE ' [vigencia: ' || replace({j('vigencia')}, '_', ' ') || ']' END"


@query(f"WITH {CH}, h AS (SELECT chunk_id, {_HEAD} AS encabezado, split_part({j('texto')}, chr(10), 1) AS linea FROM ch WHERE {j('nombre_citable')} IS NOT NULL AND {j('texto')} IS NOT NULL) SELECT chunk_id, encabezado, encabezado = linea AS igual FROM h")
def heading_line(spark, sf):
    """Heading of a chunk from its name, path and validity mark, against the line it has."""
    rows = chunks(spark, sf, "nombre_citable", "ruta", "vigencia", "texto").where("nombre_citable is not null and texto is not null")
    path = F.when(F.col("ruta").isNull(), "").otherwise(F.concat(F.lit(" › "), F.array_join("ruta", " › ")))
    mark = F.when(F.coalesce("vigencia", F.lit("sin_marca")) == "sin_marca", "").otherwise(F.concat(F.lit(" [vigencia: "), F.replace("vigencia", F.lit("_"), F.lit(" ")), F.lit("]")))
    head = F.concat("nombre_citable", path, mark)
    return rows.select("chunk_id", head.alias("encabezado"), (head == F.substring_index("texto", "\n", 1)).alias("igual"))


@query(
    r"""WITH d AS (SELECT doc_id, string_split(text, chr(10) || chr(10)) AS b FROM documents WHERE text IS NOT NULL),
    e AS (SELECT doc_id, unnest(b) AS x, generate_subscripts(b, 1) AS i FROM d),
    o AS (SELECT doc_id, i - 1 AS bloque, CAST(coalesce(sum(len(x) + 2) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS inicio, len(x) AS n, x FROM e)
    SELECT doc_id, CAST(bloque AS INTEGER) AS bloque, inicio, inicio + n AS fin FROM o WHERE trim(x, ' ' || chr(9) || chr(10)) <> ''"""
)
def block_offsets(spark, sf):
    """Blocks parted by blank lines, with absolute offsets."""
    return segment.blocks(table(spark, sf, "documents")).where(F.trim(F.regexp_replace("x", "[ \\t\\n]", "")) != "").select("doc_id", "bloque", "inicio", "fin")


@query(
    r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL),
    f AS (SELECT *, lag(x) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM l),
    g AS (SELECT *, sum(CASE WHEN p IS NULL OR trim(p) = '' OR trim(x) = '' OR regexp_matches(p, '[.:;]$') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM f)
    SELECT doc_id, CAST(dense_rank() OVER (PARTITION BY doc_id ORDER BY g) AS INTEGER) AS parrafo, CAST(count(*) AS BIGINT) AS lineas, CAST(sum(len(x)) AS BIGINT) AS letras FROM g WHERE trim(x) <> '' GROUP BY doc_id, g"""
)
def line_groups(spark, sf):
    """Lines grouped into paragraphs, a new one after a stop or a gap."""
    return segment.paragraphs(table(spark, sf, "documents"))


@query(
    f"""WITH {CH}, o AS (SELECT doc_id, chunk_id, {j('inicio', 'INTEGER')} AS inicio, coalesce(array_to_string(CAST(json_extract(datos, '$.ruta') AS VARCHAR[]), ' › '), '') AS ruta FROM ch WHERE {j('inicio')} IS NOT NULL),
    f AS (SELECT *, CASE WHEN ruta = lag(ruta) OVER (PARTITION BY doc_id ORDER BY inicio, chunk_id) THEN 0 ELSE 1 END AS nuevo FROM o),
    g AS (SELECT *, sum(nuevo) OVER (PARTITION BY doc_id ORDER BY inicio, chunk_id) AS isla FROM f)
    SELECT doc_id, CAST(isla AS INTEGER) AS isla, min(ruta) AS ruta, count(*) AS trozos, min(inicio) AS inicio FROM g GROUP BY doc_id, isla"""
)
def path_islands(spark, sf):
    """Consecutive chunks of one path."""
    rows = chunks(spark, sf, "inicio", "ruta").where("inicio is not null").withColumn("ruta", F.coalesce(F.array_join("ruta", " › "), F.lit("")))
    rows = with_lag(rows.select("doc_id", "chunk_id", "inicio", "ruta"), ["doc_id"], ["inicio", "chunk_id"], ["ruta"])
    rows = rows.withColumn("nuevo", F.when(F.col("ruta") == F.col("prev_ruta"), 0).otherwise(1))
    rows = running_sum(rows, ["doc_id"], ["inicio", "chunk_id"], "nuevo", "isla")
    return rows.groupBy("doc_id", "isla").agg(F.min("ruta").alias("ruta"), F.count("*").alias("trozos"), F.min("inicio").alias("inicio"))


_LVL = r"CASE WHEN regexp_matches(x, '^(ARTÍCULO|Artículo|ART\.|Art\.) ?') THEN 2 WHEN regexp_matches(x, '^[IVX]+\. [A-ZÁÉÍÓÚÑ ]+$') THEN 1 END"


@query(
    rf"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL),
    v AS (SELECT *, {_LVL} AS n FROM l),
    s AS (SELECT *, last_value(CASE WHEN n = 1 THEN x END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i) AS seccion,
        last_value(CASE WHEN n = 2 THEN i WHEN n = 1 THEN -1 END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i) AS art FROM v)
    SELECT doc_id, CAST(i AS INTEGER) AS linea, seccion, CAST(CASE WHEN art > 0 THEN art END AS INTEGER) AS articulo_en FROM s WHERE trim(x) <> '' AND (seccion IS NOT NULL OR art > 0)"""
)
def heading_stack(spark, sf):
    """The headings that are open at each line; a higher level closes the lower one."""
    return segment.heading_stack(table(spark, sf, "documents"))


@query(
    r"""WITH d AS (SELECT doc_id, string_split(text, chr(10) || chr(10)) AS b FROM documents WHERE text IS NOT NULL AND trim(text) <> ''),
    e AS (SELECT doc_id, unnest(b) AS x, generate_subscripts(b, 1) AS i FROM d),
    c AS (SELECT *, coalesce(sum(len(x)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS antes FROM e)
    SELECT doc_id, count(*) AS bloques, CAST(sum(len(x)) AS BIGINT) AS letras FROM c WHERE antes < 1500 GROUP BY doc_id"""
)
def ficha_prefix(spark, sf):
    """Opening blocks until 1,500 characters; the block that crosses the mark is kept."""
    rows = segment.blocks(table(spark, sf, "documents").where("trim(text) <> ''"))
    w = Window.partitionBy("doc_id").orderBy("bloque").rowsBetween(Window.unboundedPreceding, -1)
    kept = rows.withColumn("antes", F.coalesce(F.sum(F.length("x")).over(w), F.lit(0))).where("antes < 1500")
    return kept.groupBy("doc_id").agg(F.count("*").alias("bloques"), F.sum(F.length("x")).alias("letras"))


@query()
def pack_windows(spark, sf):
    """Blocks packed greedily into windows of 1,700 characters; a block over the limit is cut at sentence ends."""
    return segment.pack(table(spark, sf, "documents"), 1700)


@query(
    rf"""WITH {CH}, l AS (SELECT DISTINCT doc_id, chunk_id, trim(regexp_replace(regexp_replace({fold('x')}, '\d+', '', 'g'), '[^\p{{L}}]+', ' ', 'g')) AS clave
        FROM (SELECT doc_id, chunk_id, unnest(string_split({j('texto')}, chr(10))) AS x FROM ch) WHERE len(x) < 80),
    n AS (SELECT doc_id, count(*) AS trozos FROM ch GROUP BY doc_id)
    SELECT l.doc_id, clave, count(*) AS trozos_con, n.trozos FROM l JOIN n ON l.doc_id = n.doc_id WHERE clave <> '' GROUP BY l.doc_id, clave, n.trozos HAVING n.trozos >= 3 AND count(*) >= greatest(2, 0.5 * n.trozos)"""
)
def repeated_header_lines(spark, sf):
    """Short lines whose word bag repeats on half of a document's chunks."""
    rows = chunks(spark, sf, "texto")
    lines = rows.select("doc_id", "chunk_id", F.explode(F.split("texto", "\n")).alias("x")).where(F.length("x") < 80)
    key = F.trim(F.regexp_replace(F.regexp_replace(T.fold("x"), r"\d+", ""), r"[^\p{L}]+", " "))
    per = lines.select("doc_id", "chunk_id", key.alias("clave")).where("clave <> ''").distinct().groupBy("doc_id", "clave").agg(F.count("*").alias("trozos_con"))
    total = rows.groupBy("doc_id").agg(F.count("*").alias("trozos"))
    return per.join(total, "doc_id").where("trozos >= 3 and trozos_con >= greatest(2, 0.5 * trozos)")


@query(
    rf"""WITH {CH}, t AS (SELECT chunk_id, {j('texto')} AS x FROM ch WHERE {j('texto')} IS NOT NULL),
    w AS (SELECT chunk_id, x, list_filter(string_split_regex(x, '\s+'), lambda v: v <> '') AS ws FROM t)
    SELECT chunk_id, CAST(len(list_filter(ws, lambda v: len(v) >= 16)) AS INTEGER) AS pegadas, CAST(len(ws) AS INTEGER) AS palabras,
    CAST(len(regexp_extract_all(x, '[\p{{Greek}}\p{{Cyrillic}}]')) AS INTEGER) AS ajenas,
    len(regexp_extract_all(x, '[\p{{Greek}}\p{{Cyrillic}}]')) >= 3 OR (len(ws) >= 30 AND len(list_filter(ws, lambda v: len(v) >= 16)) > 0.08 * len(ws)) AS mala FROM w"""
)
def bad_text_layer(spark, sf):
    """Texts with foreign letters or glued words, as a broken text layer gives them."""
    rows = chunks(spark, sf, "texto").where("texto is not null")
    ws = F.filter(F.split("texto", r"\s+"), lambda v: v != "")
    n = rows.select("chunk_id", F.size(F.filter(ws, lambda v: F.length(v) >= 16)).alias("pegadas"), F.size(ws).alias("palabras"), F.regexp_count("texto", F.lit(r"[\p{IsGreek}\p{IsCyrillic}]")).alias("ajenas"))
    return n.withColumn("mala", F.expr("ajenas >= 3 or (palabras >= 30 and pegadas > 0.08 * palabras)"))


@query(f"WITH {CH} SELECT doc_id, count(*) AS trozos, round(avg(len({j('texto')})), 4) AS media, avg(len({j('texto')})) < 1200 AS requiere_ocr FROM ch WHERE {j('texto')} IS NOT NULL GROUP BY doc_id")
def ocr_gate(spark, sf):
    """Documents whose pages hold too little text."""
    rows = chunks(spark, sf, "texto").where("texto is not null").groupBy("doc_id").agg(F.count("*").alias("trozos"), F.avg(F.length("texto")).alias("m"))
    return rows.select("doc_id", "trozos", F.round("m", 4).alias("media"), (F.col("m") < 1200).alias("requiere_ocr"))


@query(rf"WITH d AS (SELECT DISTINCT doc_id, split_part(text, chr(10), 1) AS x FROM documents WHERE text IS NOT NULL) SELECT doc_id, round(CASE WHEN len(regexp_extract_all(x, '\p{{L}}')) = 0 THEN 0 ELSE len(regexp_extract_all(x, '\p{{Lu}}')) / len(regexp_extract_all(x, '\p{{L}}')) END, 6) AS mayusculas FROM d")
def uppercase_share(spark, sf):
    """Capitals among the letters of a text's first line."""
    return table(spark, sf, "documents").where("text is not null").select("doc_id", F.round(T.uppercase_share(F.substring_index("text", "\n", 1)), 6).alias("mayusculas"))


@query(
    r"""WITH d AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL AND regexp_matches(text, '\b(FALLA|RESUELVE|DECRETA)\b'))
    SELECT doc_id, CAST(len(text) + coalesce(list_sum(list_transform(['RESUELVE', 'DECRETA', 'FALLA'], lambda s: CASE WHEN regexp_matches(text, '(^|[^\p{L}\p{N}_-])' || s || '($|[^\p{L}\p{N}_-])') AND NOT contains(text, CASE s WHEN 'FALLA' THEN 'se decide' WHEN 'RESUELVE' THEN 'parte resolutiva' ELSE 'parte dispositiva' END)
        THEN CASE s WHEN 'FALLA' THEN 12 WHEN 'RESUELVE' THEN 19 ELSE 20 END ELSE 0 END)), 0) AS INTEGER) AS largo FROM d"""
)
def expand_acronyms(spark, sf):
    """A name in brackets after the first mention of its short form."""
    rows = table(spark, sf, "documents").where(F.col("text").rlike(r"\b(FALLA|RESUELVE|DECRETA)\b"))
    return rows.select("doc_id", F.length(T.expand_acronyms("text", SIGLAS)).cast("int").alias("largo"))


@query(
    f"""WITH {CH}, a AS (SELECT doc_id, chunk_id, {j('inicio', 'INTEGER')} AS inicio, CAST(list_last(regexp_extract_all({j('articulo')}, '[0-9]+')) AS INTEGER) AS n, {j('parte', 'INTEGER')} AS parte FROM ch WHERE {j('articulo')} IS NOT NULL AND {j('inicio')} IS NOT NULL),
    b AS (SELECT *, lag(n) OVER (PARTITION BY doc_id ORDER BY inicio, chunk_id) AS p FROM a),
    r AS (SELECT doc_id, count(*) AS articulos, count(*) FILTER (n < p) AS atras, count(*) FILTER (p IS NULL OR n <> p) AS cambios FROM b GROUP BY doc_id)
    SELECT doc_id, articulos, atras, CASE WHEN atras > greatest(1, 0.02 * articulos) THEN 'REVISAR' ELSE 'OK' END AS veredicto FROM r"""
)
def audit_verdict(spark, sf):
    """M17, backward steps only: documents whose article numbers step back too often; OK says nothing of the other checks."""
    rows = chunks(spark, sf, "inicio", "articulo").where("articulo is not null and inicio is not null")
    rows = rows.withColumn("n", F.element_at(F.regexp_extract_all("articulo", F.lit("[0-9]+"), F.lit(0)), -1).cast("int"))
    rows = with_lag(rows.select("doc_id", "chunk_id", "inicio", "n"), ["doc_id"], ["inicio", "chunk_id"], ["n"])
    r = rows.groupBy("doc_id").agg(F.count("*").alias("articulos"), F.count_if(F.col("n") < F.col("prev_n")).alias("atras"))
    return r.withColumn("veredicto", F.expr("case when atras > greatest(1, 0.02 * articulos) then 'REVISAR' else 'OK' end"))


@query(
    """WITH d AS (SELECT doc_id, coalesce(tipo_documento, '?') AS estrato FROM documents),
    c AS (SELECT estrato, count(*) AS n, sum(count(*)) OVER () AS total FROM d GROUP BY estrato),
    q AS (SELECT estrato, greatest(1, CAST(round(50.0 * n / total) AS INTEGER)) AS cupo FROM c),
    r AS (SELECT d.doc_id, d.estrato, row_number() OVER (PARTITION BY d.estrato ORDER BY md5(CAST(d.doc_id AS VARCHAR)), d.doc_id) AS k, q.cupo FROM d JOIN q ON d.estrato = q.estrato)
    SELECT doc_id, estrato FROM r WHERE k <= cupo"""
)
def stratified_sample(spark, sf):
    """Proportional sample of about 50, one of each stratum at least, ordered by a hash of the id."""
    rows = table(spark, sf, "documents").select("doc_id", F.coalesce("tipo_documento", F.lit("?")).alias("estrato"))
    sizes = rows.groupBy("estrato").agg(F.count("*").alias("n"))
    total = rows.agg(F.count("*").alias("total"))
    quota = sizes.crossJoin(F.broadcast(total)).select("estrato", F.greatest(F.lit(1), F.round(50.0 * F.col("n") / F.col("total")).cast("int")).alias("cupo"))
    w = Window.partitionBy("estrato").orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id")
    near = rows.withColumn("k", F.row_number().over(w)).where("k <= 50")  # no quota is larger, and a constant cuts each task's rows before the shuffle
    return near.join(quota, "estrato").where("k <= cupo").select("doc_id", "estrato")
