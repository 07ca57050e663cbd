"""Lexical index and search, rank fusion, score adjustment and selection, set at a time."""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import tokens as K
from ..session import cut_lineage, input_bytes, plain_union, shuffles_of

# The weights of the ranking, of the fusion and of the score adjustment.
K1, B = 1.2, 0.75
RRF_K = 60
#: Penalty of a passage by its kind, unless it was cited expressly.
KIND_PENALTY = {"preambulo": 0.2, "notas": 0.15, "anexo": 0.1, "seccion": 0.1}
#: Distinct words of the questions that go to every task; with more of them postings are joined instead.
ONLY_TERMS = 50_000


@dataclass(frozen=True)
class Corpus:
    """Texts to be searched: ``rows`` (id, text), where an id may be sent again.

    With ``fields`` the text is a chunk's JSON: ``texto`` is read from it, and the fields are kept beside the id.
    """

    rows: DataFrame
    stems: bool = False
    fields: tuple[str, ...] | None = None


def documents(chunks: DataFrame, text: str = "texto", key: str = "chunk_id", stems: bool = False) -> Corpus:
    return Corpus(chunks.select(F.col(key).alias("id"), F.col(text).alias("text")), stems)


def analysed(corpus: Corpus, only: frozenset[str] | None = None) -> DataFrame:
    """(id, fields, dl, p): one row for each id with a text; ``p`` holds (term, tf), of the terms in ``only`` if given.

    A text is tokenised where it is read and never shuffled: rows sent again are dropped afterwards, from what is left.
    """
    fields, stems = corpus.fields or (), corpus.stems
    ddl = ", ".join(["id string", *(f"{f} string" for f in fields), "dl int, p array<struct<term:string,tf:int>>"])
    pairs = pa.list_(pa.struct([("term", pa.string()), ("tf", pa.int32())]))
    schema = pa.schema([("id", pa.string()), *((f, pa.string()) for f in fields), ("dl", pa.int32()), ("p", pairs)])
    in_json = corpus.fields is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in schema]
            for key, own, text in texts_of(batch, in_json):
                toks = K.tokens(text, stems)
                tf = Counter(toks if only is None else filter(only.__contains__, toks))
                row = [key, *(own.get(f) for f in fields), len(toks), [{"term": t, "tf": n} for t, n in sorted(tf.items())]]
                for col, v in zip(out, row):
                    col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)

    return once(corpus.rows, run, ddl, [*fields, "dl", "p"])


def texts_of(batch: pa.RecordBatch, in_json: bool) -> Iterator[tuple[str, dict, str]]:
    """(id, fields, text) of the rows of a batch (id, text) that have a text."""
    for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
        own: dict = {}
        if in_json:
            try:
                own = json.loads(text)
            except ValueError:
                continue
            text = own.get("texto") if isinstance(own, dict) else None
        if isinstance(text, str):
            yield key, own, text


def once(rows: DataFrame, run, ddl: str, names: list[str]) -> DataFrame:
    """(id, names): rows (id, text) mapped by ``run``; those sent again are dropped afterwards."""
    rows = rows.where(F.col("id").isNotNull() & F.col("text").isNotNull()).select(F.col("id").cast("string").alias("id"), "text")
    only = rows.mapInArrow(run, ddl).groupBy("id").agg(F.max(F.struct(*names)).alias("x"))
    return only.select("id", *[F.col(f"x.{n}").alias(n) for n in names])


def postings(docs: DataFrame, *keep: str) -> DataFrame:
    """(id, keep, dl, term, tf) of analysed texts."""
    return docs.select("id", *keep, "dl", F.explode("p").alias("p")).select("id", *keep, "dl", "p.term", "p.tf")


def corpus_stats(docs: DataFrame) -> DataFrame:
    return docs.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))


def query_terms(queries: DataFrame, stems: bool = False) -> DataFrame:
    """(qid, term, qtf) of queries (qid, text); repeated query words weigh again."""
    rows = queries.where("qid is not null and text is not null").select("qid", "text")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            got = [(q, t, n) for q, x in zip(frame.qid, frame.text) for t, n in Counter(K.tokens(x, stems)).items()]
            yield pd.DataFrame(got, columns=["qid", "term", "qtf"])

    return rows.mapInPandas(run, "qid long, term string, qtf int")


def matched(queries: DataFrame, corpus: Corpus) -> tuple[DataFrame, DataFrame, bool]:
    """(query terms, analysed texts with the postings of those terms, whether the terms are few).

    One pass over the texts, written once: lengths, frequencies and scores are all taken from it.
    """
    terms = query_terms(queries, corpus.stems)
    known = terms.limit(ONLY_TERMS + 1).collect()
    if len(known) <= ONLY_TERMS:
        terms = terms.sparkSession.createDataFrame(known, "qid long, term string, qtf int")
        return terms, cut_lineage(analysed(corpus, frozenset(r.term for r in known))), True
    docs = analysed(corpus)
    wanted = terms.select("term").distinct()
    # every text keeps its row, so that lengths are counted over all of them
    hits = postings(docs).join(wanted, "term", "left_semi").groupBy("id").agg(F.collect_list(F.struct("term", "tf")).alias("p"))
    return terms, cut_lineage(docs.drop("p").join(hits, "id", "left")), False


def bm25_sums(terms: DataFrame, hits: DataFrame, stats: DataFrame, few: bool = True) -> DataFrame:
    """(qid, id, score) of every document that a query reaches, from query terms, their postings and one row of statistics (n, avgdl)."""
    small = F.broadcast if few else (lambda x: x)  # frequencies have no more rows than the query terms
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log1p((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = F.col("qtf") * idf * F.col("tf") / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    scored = hits.join(small(terms), "term").join(small(df), "term").crossJoin(F.broadcast(stats))  # stats: one row
    return scored.groupBy("qid", "id").agg(F.round(F.sum(weight), 5).alias("score")).where("score > 0")


def best_of(sums: DataFrame, k: int) -> DataFrame:
    """(qid, id, score, rank): the best ``k`` of :func:`bm25_sums`."""
    return ranked(sums, ["qid"], [F.col("score").desc(), F.col("id")], k)


def bm25(queries: DataFrame, corpus: Corpus, k: int) -> DataFrame:
    """(qid, id, score, rank): the best ``k`` documents of each query (qid, text)."""
    terms, docs, few = matched(queries, corpus)
    return best_of(bm25_sums(terms, postings(docs), corpus_stats(docs), few), k)


def bm25_within(queries: DataFrame, corpus: Corpus, group: Column, k: int) -> DataFrame:
    """(qid, doc_id, id, score, n): the best ``k`` of each group that a query reaches; nothing is cut before."""
    terms, docs, few = matched(queries, corpus)
    sums = bm25_sums(terms, postings(docs), corpus_stats(docs), few)
    best = ranked(sums.withColumn("doc_id", group), ["qid", "doc_id"], [F.col("score").desc(), F.col("id")], k, "n")
    return best.select("qid", "doc_id", "id", "score", "n")


# -- stored indexes: postings sorted by term, one row for each document, one row of sums for each build or append


def _tokens_as(stems: bool) -> str:
    return K.VERSION + (",stems" if stems else "")


def _add_segment(docs: DataFrame, stems: bool, path: str) -> None:
    flat = postings(docs)
    # ranges over (term, id): the postings of a common term are parted too, and a term's files can be told from their bounds
    with shuffles_of(docs.sparkSession, 8.0 * input_bytes(docs)):
        flat.repartitionByRange("term", "id").sortWithinPartitions("term", "id").write.mode("append").parquet(f"{path}/postings")
    docs.select("id", "dl").write.mode("append").parquet(f"{path}/docs")
    sums = docs.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).cast("long").alias("total"))
    sums.withColumn("tokens_as", F.lit(_tokens_as(stems))).coalesce(1).write.mode("append").parquet(f"{path}/stats")


def build_index(corpus: Corpus, path: str) -> None:
    """An index under ``path``, which must be empty."""
    _add_segment(cut_lineage(analysed(corpus)), corpus.stems, path)


def append_to_index(corpus: Corpus, path: str) -> None:
    """Add the documents that the index lacks, as further files; what is there is neither read again nor rewritten. A document
    without a token counts once, like any other."""
    spark = corpus.rows.sparkSession
    _check(spark.read.parquet(f"{path}/stats"), corpus.stems)
    known = spark.read.parquet(f"{path}/docs").select("id")
    new = replace(corpus, rows=corpus.rows.join(known, "id", "left_anti"))
    _add_segment(cut_lineage(analysed(new)), corpus.stems, path)


def _check(stats: DataFrame, stems: bool) -> None:
    if {r.tokens_as for r in stats.select("tokens_as").distinct().collect()} != {_tokens_as(stems)}:
        raise ValueError("the index was built with other tokens")


def search_index(queries: DataFrame, path: str, k: int, stems: bool = False) -> DataFrame:
    """BM25 on a stored index; only row groups that hold query terms are read when the terms are few."""
    spark = queries.sparkSession
    stats = spark.read.parquet(f"{path}/stats")
    _check(stats, stems)
    sums = stats.agg(F.sum("n").alias("n"), (F.sum("total") / F.sum("n")).alias("avgdl"))
    terms = query_terms(queries, stems)
    known = terms.limit(2001).collect()
    hits = spark.read.parquet(f"{path}/postings")
    few = len(known) <= 2000
    if few:
        terms = spark.createDataFrame(known, "qid long, term string, qtf int")
        hits = hits.where(F.col("term").isin(sorted({r.term for r in known})))
    else:
        hits = hits.join(terms.select("term").distinct(), "term", "left_semi")
    return best_of(bm25_sums(terms, hits, sums, few), k)


def ranked(df: DataFrame, by: list[str], order: list[Column], k: int | None = None, rank: str = "rank") -> DataFrame:
    out = df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return out.where(F.col(rank) <= k) if k else out


def rrf(lists: list[DataFrame], k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of (qid, id, rank) lists of equal weight."""
    rows = plain_union(*(x.select("qid", "id", "rank") for x in lists), by=["qid"])
    fused = rows.groupBy("qid", "id").agg(F.round(F.sum(1.0 / (F.lit(k) + F.col("rank"))), 8).alias("score"))
    return ranked(fused, ["qid"], [F.col("score").desc(), F.col("id")])


def relative(score: str, by: list[str]) -> Column:
    """A score over the best one of its query: what stands in where no reranker runs."""
    return F.round(F.col(score) / F.max(score).over(Window.partitionBy(*by)), 4)


def adjusted(score: Column, derogated: Column, priority: Column, kind: Column, ruling: Column, cited: Column) -> Column:
    """Derogation, priority and kind taken into account; cited passages are spared kind penalties and the bonus alike."""
    penalty = F.lit(0.0)
    for name, value in KIND_PENALTY.items():
        penalty = F.when(kind == name, F.lit(value)).otherwise(penalty)
    bonus = F.when((priority == "alta") & ~ruling, F.lit(0.1)).otherwise(F.lit(0.0))
    free = F.when(cited, F.lit(0.0)).otherwise(bonus - penalty)
    low = F.when(priority == "baja", F.lit(0.05)).otherwise(F.lit(0.0))
    return F.round(score - F.when(derogated, F.lit(0.15)).otherwise(F.lit(0.0)) - low + free, 4)


def expand_parts(chunks: DataFrame) -> DataFrame:
    """Articles put together from their parts: bodies in order, span of the offsets."""
    parts = chunks.where("tipo_chunk = 'parte_articulo' and articulo_id is not null and parte is not null and texto is not null")
    rows = parts.groupBy("articulo_id").agg(
        F.sort_array(F.collect_list(F.struct("parte", "chunk_id", T.body("texto").alias("b")))).alias("p"),
        F.min("inicio").alias("inicio"),
        F.max("fin").alias("fin"),
        F.count("*").alias("partes"),
    )
    return rows.select("articulo_id", "partes", "inicio", "fin", F.array_join(F.transform("p", lambda x: x["b"]), "\n\n").alias("texto"))


def diverse(pool: DataFrame, k: int = 10, per_doc: int = 3, rulings: int = 4, overlap: float = 0.7, pool_size: int = 150) -> DataFrame:
    """Greedy choice of ``k`` passages for each query from (qid, id, doc_id, unit, ruling, article, score, sh), and where
    they are given, ``forced`` (these go in first) and ``cited`` (these are spared the cap on rulings).

    At most ``per_doc`` of a document and one of a unit; rulings over the cap are deferred and used only if places stay
    free; a passage that is no article is left out if it shares too much with a chosen one. A query's pool is cut to
    ``pool_size`` by a window first, so that a group is small whatever the input.
    """
    for flag in ("forced", "cited"):
        if flag not in pool.columns:
            pool = pool.withColumn(flag, F.lit(False))
    best = ranked(pool, ["qid"], [F.col("forced").desc(), F.col("score").desc(), F.col("id")], pool_size, "__r")

    def pick(frame: pd.DataFrame) -> pd.DataFrame:
        chosen: list[int] = []
        docs: dict[str, int] = {}
        units: set[str] = set()
        n_rulings, deferred, rows = 0, [], frame.sort_values("__r").to_dict("records")
        seen: list[set] = []

        def take(i: int) -> None:
            chosen.append(i)
            docs[rows[i]["doc_id"]] = docs.get(rows[i]["doc_id"], 0) + 1
            units.add(rows[i]["unit"])
            seen.append(set(rows[i]["sh"]))

        def allowed(row: dict) -> bool:
            if row["unit"] in units or docs.get(row["doc_id"], 0) >= per_doc:
                return False
            sh = set(row["sh"])
            return bool(row["article"]) or all(len(sh & s) / max(1, min(len(sh), len(s))) < overlap for s in seen)

        for i, row in enumerate(rows):
            if row["forced"] and allowed(row):
                take(i)
        for i, row in enumerate(rows):
            if len(chosen) >= k:
                break
            if not allowed(row):
                continue
            if row["ruling"] and n_rulings >= rulings and not row["cited"]:
                deferred.append(i)
                continue
            n_rulings += bool(row["ruling"])
            take(i)
        for i in deferred:
            if len(chosen) < k and allowed(rows[i]):
                take(i)
        out = frame.sort_values("__r").iloc[sorted(chosen)].sort_values(["score", "id"], ascending=[False, True], kind="stable")
        return pd.DataFrame({"qid": out.qid, "id": out.id, "doc_id": out.doc_id, "score": out.score, "rank": range(1, len(out) + 1)})

    return best.groupBy("qid").applyInPandas(pick, "qid long, id string, doc_id string, score double, rank int")


def fill_budget(lengths: Column, budget: int) -> Column:
    """Water filling: from short to long, each gets its length or an even share of what is left."""
    order = F.array_sort(lengths)
    start = F.struct(F.lit(budget).cast("long").alias("left"), F.size(order).cast("long").alias("n"), F.array().cast("array<long>").alias("out"))

    def step(acc: Column, v: Column) -> Column:
        give = F.least(v.cast("long"), F.floor(acc["left"] / acc["n"]).cast("long"))
        return F.struct((acc["left"] - give).alias("left"), (acc["n"] - 1).alias("n"), F.concat(acc["out"], F.array(give)).alias("out"))

    return F.aggregate(order, start, step, lambda acc: acc["out"])


def predict_batches(df: DataFrame, scorer, schema: str) -> DataFrame:
    """Plug-in point for rerankers, embedders, writers and judges: ``scorer()`` is made once a task and maps frames."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = scorer()
        for frame in frames:
            yield model(frame)

    return df.mapInPandas(run, schema)
