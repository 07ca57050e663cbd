"""Index, retrieval and selection queries."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import search as S
from ..operators import vectors as V
from ..session import shared_folder
from ..sources.tables import chunks, passages, table
from .common import CH, PA, j, query, tokens

_D = f"d AS (SELECT chunk_id AS id, {tokens(j('texto'))} AS toks FROM ch WHERE {j('texto')} IS NOT NULL)"
_N = f"d AS (SELECT chunk_id AS id, {tokens(j('texto'))} AS toks FROM ch WHERE {j('texto')} IS NOT NULL AND coalesce({j('tipo_documento')}, '') <> 'sentencia')"


def _ask(where: str = "id % 20 = 0") -> str:
    return f"q AS (SELECT id AS qid, unnest({tokens('pregunta')}) AS term FROM preguntas WHERE {where} AND pregunta IS NOT NULL), qt AS (SELECT qid, term, count(*) AS qtf FROM q GROUP BY ALL)"


def _bm25(docs: str, k: int, name: str = "r") -> str:
    return f"""{docs}, st AS (SELECT count(*) AS n, avg(len(toks)) AS avgdl FROM d),
    po AS (SELECT id, len(toks) AS dl, unnest(toks) AS term FROM d), pt AS (SELECT id, dl, term, count(*) AS tf FROM po WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
    df AS (SELECT term, count(*) AS df FROM pt GROUP BY term),
    sc AS (SELECT qid, id, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))), 5) AS score FROM qt JOIN pt USING (term) JOIN df USING (term), st GROUP BY qid, id),
    {name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM sc WHERE score > 0) WHERE rank <= {k})"""


def _questions(spark, sf):
    """Every question whose id is divisible by 20, against all chunks."""
    return table(spark, sf, "preguntas").where("id % 20 = 0 and pregunta is not null").select(F.col("id").alias("qid"), F.col("pregunta").alias("text"))


def _corpus(spark, sf, norms: bool = False, stems: bool = False, fields: tuple[str, ...] = ()):
    """All chunks, or those of norms, as they stand in the table."""
    rows = table(spark, sf, "chunks").select(F.col("chunk_id").alias("id"), F.col("datos").alias("text"))
    if norms:
        rows = rows.where(F.coalesce(F.get_json_object("text", "$.tipo_documento"), F.lit("")) != "sentencia")
    return S.Corpus(rows, stems, fields)


@query(f"WITH {CH}, {_D}, p AS (SELECT id, unnest(toks) AS term FROM d) SELECT term, count(DISTINCT id) AS df, count(*) AS cf FROM p GROUP BY term")
def bm25_terms(spark, sf):
    """Document and collection frequency of every term."""
    return S.postings(S.analysed(_corpus(spark, sf))).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


@query(f"WITH {CH}, {_D} SELECT id, CAST(len(toks) AS INTEGER) AS n, md5(array_to_string(list_sort(list_distinct(toks)), ' ')) AS huella FROM d")
def index_tokens(spark, sf):
    """Tokens of every chunk, with rulings and numbered identifiers whole."""
    docs = S.analysed(_corpus(spark, sf))
    return docs.select("id", F.col("dl").alias("n"), F.md5(F.array_join(F.array_sort(F.col("p.term")), " ")).alias("huella"))


@query()
def stemmed_terms(spark, sf):
    """Document frequency of every stem."""
    return S.postings(S.analysed(_corpus(spark, sf, stems=True))).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


@query(f"WITH {CH}, {_D} SELECT count(*) AS n, round(avg(len(toks)), 6) AS avgdl, CAST(sum(len(toks)) AS BIGINT) AS largo FROM d")
def bm25_stats(spark, sf):
    """Size and mean length of the corpus."""
    docs = S.analysed(_corpus(spark, sf), frozenset())
    return docs.agg(F.count("*").alias("n"), F.round(F.avg("dl"), 6).alias("avgdl"), F.sum("dl").alias("largo"))


_TOP10 = f"WITH {CH}, {_ask()}, {_bm25(_D, 10)} SELECT qid, id, score, CAST(rank AS INTEGER) AS rank FROM r"


@query(_TOP10)
def bm25_top10(spark, sf):
    """The ten best chunks of each question."""
    return S.bm25(_questions(spark, sf), _corpus(spark, sf), 10)


@query()
def bm25_stems_top10(spark, sf):
    """The same with Spanish stems on both sides."""
    return S.bm25(_questions(spark, sf), _corpus(spark, sf, stems=True), 10)


@query(_TOP10)
def bm25_stored_top10(spark, sf):
    """The same from a stored index, built of a first half of the chunks and grown by all of them."""
    corpus = _corpus(spark, sf)
    path = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
    S.build_index(replace(corpus, rows=corpus.rows.where(F.pmod(F.xxhash64("id"), F.lit(2)) == 0)), path)
    S.append_to_index(corpus, path)
    return S.search_index(_questions(spark, sf), path, 10)


@query(f"WITH {CH}, {_ask()}, {_bm25(_N, 10)} SELECT qid, id, score, CAST(rank AS INTEGER) AS rank FROM r")
def bm25_norms_top10(spark, sf):
    """The same on the sub-corpus of norms, with its own frequencies and mean length."""
    return S.bm25(_questions(spark, sf), _corpus(spark, sf, norms=True), 10)


@query(
    f"""WITH {CH}, {_ask()}, a AS (WITH {_bm25(_D, 100)} SELECT qid, id, rank FROM r), b AS (WITH {_bm25(_N, 50)} SELECT qid, id, rank FROM r),
    f AS (SELECT qid, id, round(sum(1.0 / CAST(60 + rank AS DOUBLE)), 8) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY qid, id),
    g AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM f)
    SELECT qid, id, score, CAST(rank AS INTEGER) AS rank FROM g WHERE rank <= 150"""
)
def rrf_fusion(spark, sf):
    """Two lists fused by reciprocal rank, cut to the candidate pool. Both come from one pass over the texts."""
    terms, docs, few = S.matched(_questions(spark, sf), _corpus(spark, sf, fields=("tipo_documento",)))
    norms = docs.where("coalesce(tipo_documento, '') <> 'sentencia'")
    every = S.best_of(S.bm25_sums(terms, S.postings(docs), S.corpus_stats(docs), few), 100)
    own = S.best_of(S.bm25_sums(terms, S.postings(norms), S.corpus_stats(norms), few), 50)
    return S.rrf([every, own]).where("rank <= 150")


@query(f"WITH {PA} SELECT pasaje_id, round(score / max(score) OVER (PARTITION BY pregunta_id), 6) AS relativo FROM pa WHERE score IS NOT NULL AND NOT isnan(score) AND pregunta_id IS NOT NULL")
def no_reranker_score(spark, sf):
    """Score over the question's best. The best is a plain aggregate joined back, so no question is one task."""
    rows = passages(spark, sf).where("score is not null and not isnan(score) and pregunta_id is not null").select("pasaje_id", "pregunta_id", "score")
    top = rows.groupBy("pregunta_id").agg(F.max("score").alias("m"))
    return rows.join(top, "pregunta_id").select("pasaje_id", F.round(F.col("score") / F.col("m"), 6).alias("relativo"))


_ADJ = f"""WITH {CH}, {PA} SELECT pasaje_id, round(score - CASE WHEN {j('vigencia')} = 'derogada' THEN 0.15 ELSE 0.0 END - CASE WHEN {j('prioridad')} = 'baja' THEN 0.05 ELSE 0.0 END
    + CASE WHEN {j('prioridad')} = 'alta' AND coalesce({j('tipo_documento')}, '') <> 'sentencia' THEN 0.1 ELSE 0.0 END
    - CASE tipo_chunk WHEN 'preambulo' THEN 0.2 WHEN 'notas' THEN 0.15 WHEN 'anexo' THEN 0.1 WHEN 'seccion' THEN 0.1 ELSE 0.0 END, 4) + 0.0 AS ajustado
    FROM pa JOIN ch ON pa.id = ch.chunk_id WHERE score IS NOT NULL AND NOT isnan(score)"""


@query(_ADJ)
def score_adjust(spark, sf):
    """Derogation, priority and kind in the score."""
    c = chunks(spark, sf, "vigencia", "prioridad", "tipo_documento").select("chunk_id", "tipo_chunk", "vigencia", "prioridad", "tipo_documento")
    rows = passages(spark, sf).where("score is not null and not isnan(score)").select("pasaje_id", "id", "score")
    got = rows.join(c, F.col("id") == F.col("chunk_id"))
    score = S.adjusted(F.col("score"), F.coalesce(F.col("vigencia") == "derogada", F.lit(False)), F.coalesce("prioridad", F.lit("")), F.coalesce("tipo_chunk", F.lit("")), F.coalesce(F.col("tipo_documento") == "sentencia", F.lit(False)), F.lit(False))
    return got.select("pasaje_id", (score + 0.0).alias("ajustado"))


@query(f"WITH {PA}, r AS (SELECT pregunta_id, doc_id, pasaje_id, row_number() OVER (PARTITION BY pregunta_id, doc_id ORDER BY score DESC, id, pasaje_id) AS n FROM pa WHERE score IS NOT NULL AND NOT isnan(score) AND pregunta_id IS NOT NULL) SELECT pregunta_id, doc_id, pasaje_id, CAST(n AS INTEGER) AS n FROM r WHERE n <= 3")
def cap_per_document(spark, sf):
    """At most three passages of a document for each question."""
    rows = passages(spark, sf).where("score is not null and not isnan(score) and pregunta_id is not null").select("pregunta_id", "doc_id", "pasaje_id", "score", "id")
    return S.ranked(rows, ["pregunta_id", "doc_id"], [F.col("score").desc(), F.col("id"), F.col("pasaje_id")], 3, "n").select("pregunta_id", "doc_id", "pasaje_id", "n")


@query(
    f"""WITH {PA}, s AS (SELECT *, (doc_id LIKE 'jurisprudencia_%') AS fallo FROM pa WHERE score IS NOT NULL AND NOT isnan(score) AND pregunta_id IS NOT NULL),
    r AS (SELECT *, row_number() OVER (PARTITION BY pregunta_id, fallo ORDER BY score DESC, id, pasaje_id) AS n FROM s),
    k AS (SELECT *, CASE WHEN fallo AND n > 4 THEN 1 ELSE 0 END AS diferido FROM r WHERE n <= 10),
    t AS (SELECT *, row_number() OVER (PARTITION BY pregunta_id ORDER BY diferido, score DESC, id, pasaje_id) AS puesto FROM k)
    SELECT pregunta_id, pasaje_id, fallo, diferido = 1 AS diferido, CAST(puesto AS INTEGER) AS puesto FROM t WHERE puesto <= 10"""
)
def cap_with_deferral(spark, sf):
    """Four rulings at most; the rest wait and fill places that stay free."""
    rows = passages(spark, sf).where("score is not null and not isnan(score) and pregunta_id is not null").withColumn("fallo", F.col("doc_id").startswith("jurisprudencia_"))
    order = [F.col("score").desc(), F.col("id"), F.col("pasaje_id")]
    near = S.ranked(rows.select("pregunta_id", "pasaje_id", "id", "score", "fallo"), ["pregunta_id", "fallo"], order, 10, "n")
    near = near.withColumn("diferido", F.col("fallo") & (F.col("n") > 4))
    return S.ranked(near, ["pregunta_id"], [F.col("diferido"), *order], 10, "puesto").select("pregunta_id", "pasaje_id", "fallo", "diferido", "puesto")


@query()
def diverse_top10(spark, sf):
    """R16 whole: greedy choice under all caps and the overlap filter."""
    c = chunks(spark, sf).select("chunk_id", "articulo_id", "tipo_chunk")
    rows = passages(spark, sf).where("score is not null and not isnan(score) and pregunta_id is not null and texto is not null")
    best = rows.groupBy("pregunta_id", "id").agg(F.max("score").alias("score"))
    pool = S.ranked(best, ["pregunta_id"], [F.col("score").desc(), F.col("id")], 150, "r").drop("r")
    texts = rows.groupBy("id").agg(F.first("texto").alias("texto"))
    full = pool.join(c, F.col("id") == F.col("chunk_id")).join(texts, "id")
    article = F.col("tipo_chunk").isin("articulo", "parte_articulo")
    doc = F.substring_index("id", "/", 1)
    return S.diverse(full.select(F.col("pregunta_id").alias("qid"), "id", doc.alias("doc_id"), F.when(article, F.coalesce("articulo_id", "id")).otherwise(F.col("id")).alias("unit"), doc.startswith("jurisprudencia_").alias("ruling"), article.alias("article"), "score", T.shingles("texto").alias("sh")))


@query(
    f"""WITH {CH}, p AS (SELECT articulo_id, chunk_id, {j('parte', 'INTEGER')} AS parte, {j('inicio', 'INTEGER')} AS inicio, {j('fin', 'INTEGER')} AS fin, {j('texto')} AS x FROM ch WHERE tipo_chunk = 'parte_articulo' AND articulo_id IS NOT NULL AND {j('parte')} IS NOT NULL AND {j('texto')} IS NOT NULL)
    SELECT articulo_id, count(*) AS partes, min(inicio) AS inicio, max(fin) AS fin, md5(string_agg(CASE WHEN strpos(x, chr(10)) > 0 THEN substr(x, strpos(x, chr(10)) + 1) ELSE x END, chr(10) || chr(10) ORDER BY parte, chunk_id)) AS texto FROM p GROUP BY articulo_id"""
)
def part_expand(spark, sf):
    """Whole articles from their parts."""
    return S.expand_parts(chunks(spark, sf, "texto", "parte", "inicio", "fin")).withColumn("texto", F.md5("texto"))


@query(
    r"""WITH a AS (SELECT vec_id AS qid, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id % 20 = 0), b AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS w FROM embeddings),
    s AS (SELECT qid, id, round(list_dot_product(v, w), 4) AS score FROM a, b WHERE qid <> id), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM s)
    SELECT qid, id, score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10"""
)
def dense_top10(spark, sf):
    """Exact inner-product search; queries are the vectors whose id is divisible by 20."""
    e = table(spark, sf, "embeddings")
    return V.exact_top_k(e.where("vec_id % 20 = 0"), e, 10)


@query()
def ivf_top10(spark, sf):
    """The same through an inverted file that indexes every vector."""
    e = table(spark, sf, "embeddings")
    return V.ivf_top_k(e.where("vec_id % 20 = 0"), e, 10)


@query()
def ivf_recall(spark, sf):
    """Share of the exact neighbours that the inverted file finds."""
    e = table(spark, sf, "embeddings")
    asks = e.where("vec_id % 20 = 0")
    return V.recall(V.ivf_top_k(asks, e, 10), V.exact_top_k(asks, e, 10))


@query("SELECT count(*) AS preguntas, true AS basta FROM embeddings WHERE vec_id % 20 = 0")
def ivf_recall_enough(spark, sf):
    """Whether the inverted file finds at least nine tenths of the exact neighbours of all questions asked."""
    e = table(spark, sf, "embeddings")
    asks = e.where("vec_id % 20 = 0")
    got = V.recall(V.ivf_top_k(asks, e, 10), V.exact_top_k(asks, e, 10))
    n = asks.agg(F.count("*").alias("preguntas"))
    return n.crossJoin(F.broadcast(got)).select("preguntas", (F.col("recuerdo") >= 0.9).alias("basta"))  # one row each


@query(
    rf"""WITH {PA}, o AS (SELECT *, row_number() OVER (PARTITION BY pregunta_id ORDER BY score DESC, id, pasaje_id) AS n FROM pa WHERE score IS NOT NULL AND NOT isnan(score) AND pregunta_id IS NOT NULL AND texto IS NOT NULL),
    s AS (SELECT pregunta_id, pasaje_id, n, regexp_extract_all(lower(CASE WHEN strpos(texto, chr(10)) > 0 THEN substr(texto, strpos(texto, chr(10)) + 1) ELSE texto END), '[\p{{L}}\p{{N}}_]+') AS ws FROM o WHERE n <= 10),
    h AS (SELECT *, CASE WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS sh FROM s)
    SELECT b.pregunta_id, b.pasaje_id, round(len(list_intersect(a.sh, b.sh)) / CAST(greatest(least(len(a.sh), len(b.sh)), 1) AS DOUBLE), 4) AS contencion FROM h a JOIN h b ON a.pregunta_id = b.pregunta_id AND a.n = 1 AND b.n > 1"""
)
def containment_with_best(spark, sf):
    """How far the ten best passages of a question repeat its first one."""
    rows = passages(spark, sf).where("score is not null and not isnan(score) and pregunta_id is not null and texto is not null")
    top = S.ranked(rows.select("pregunta_id", "pasaje_id", "id", "score"), ["pregunta_id"], [F.col("score").desc(), F.col("id"), F.col("pasaje_id")], 10, "n")
    sh = top.join(rows.select("pasaje_id", "texto"), "pasaje_id").select("pregunta_id", "pasaje_id", "n", T.shingles("texto").alias("sh"))
    first = sh.where("n = 1").select("pregunta_id", F.col("sh").alias("a"))
    return first.join(sh.where("n > 1"), "pregunta_id").select("pregunta_id", "pasaje_id", F.round(T.containment("a", "sh"), 4).alias("contencion"))


@query(
    f"""WITH RECURSIVE {PA}, o AS (SELECT pregunta_id, length(texto) AS n, row_number() OVER (PARTITION BY pregunta_id ORDER BY score DESC, id, pasaje_id) AS k FROM pa WHERE score IS NOT NULL AND NOT isnan(score) AND pregunta_id IS NOT NULL AND texto IS NOT NULL),
    l AS (SELECT pregunta_id, list_sort(list(n)) AS l FROM o WHERE k <= 10 GROUP BY pregunta_id),
    w AS (SELECT pregunta_id, l, 1 AS i, CAST(6000 AS BIGINT) AS resto, CAST([] AS BIGINT[]) AS cupos FROM l
      UNION ALL SELECT pregunta_id, l, i + 1, resto - least(l[i], resto // (len(l) - i + 1)), list_append(cupos, CAST(least(l[i], resto // (len(l) - i + 1)) AS BIGINT)) FROM w WHERE i <= len(l))
    SELECT pregunta_id, cupos FROM w WHERE i > len(l)"""
)
def budget_waterfill(spark, sf):
    """A prompt's 6,000 characters shared among the ten best passages of each question."""
    rows = passages(spark, sf).where("score is not null and not isnan(score) and pregunta_id is not null and texto is not null")
    top = S.ranked(rows.select("pregunta_id", "pasaje_id", "id", "score", F.length("texto").cast("long").alias("n")), ["pregunta_id"], [F.col("score").desc(), F.col("id"), F.col("pasaje_id")], 10)
    got = top.groupBy("pregunta_id").agg(F.collect_list("n").alias("l"))
    return got.select("pregunta_id", S.fill_budget(F.col("l"), 6000).alias("cupos"))


@query(
    f"""WITH {CH}, o AS (SELECT count(*) AS n, count(DISTINCT chunk_id) AS ids FROM ch), {PA}
    SELECT n, ids, n = ids AS unicos, (SELECT count(*) FROM (SELECT DISTINCT id FROM pa WHERE id IS NOT NULL) p WHERE NOT EXISTS (SELECT 1 FROM ch WHERE ch.chunk_id = p.id)) AS ausentes,
    (SELECT count(*) FROM ch WHERE {j('texto')} IS NULL OR {j('texto')} = '') AS vacios FROM o"""
)
def index_verify(spark, sf):
    """Unique ids, passages without a chunk, chunks without text."""
    c = chunks(spark, sf, "texto")
    n = c.agg(F.count("*").alias("n"), F.count_distinct("chunk_id").alias("ids"), F.count_if(F.coalesce(F.col("texto") == "", F.lit(True))).alias("vacios"))
    gone = passages(spark, sf).select(F.col("id").alias("chunk_id")).where("chunk_id is not null").distinct().join(c, "chunk_id", "left_anti").agg(F.count("*").alias("ausentes"))
    return n.crossJoin(F.broadcast(gone)).select("n", "ids", (F.col("n") == F.col("ids")).alias("unicos"), "ausentes", "vacios")


@query(f"WITH {CH}, {_D}, p AS (SELECT DISTINCT id, unnest(toks) AS term FROM d) SELECT term, count(*) AS df FROM p GROUP BY term")
def incremental_append(spark, sf):
    """Frequencies of an index that was grown: only chunks that it lacks are tokenised and added as files."""
    corpus = _corpus(spark, sf)
    path = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
    S.build_index(replace(corpus, rows=corpus.rows.where(F.get_json_object("text", "$.inicio").isNotNull())), path)
    S.append_to_index(corpus, path)
    return spark.read.parquet(f"{path}/postings").groupBy("term").agg(F.count("*").alias("df"))
