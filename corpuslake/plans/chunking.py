"""Documents cut into chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chunker
from ..sources.tables import table
from .common import query


def _chunks(spark, sf):
    return chunker.chunk_documents(chunker.markdown_documents(table(spark, sf, "documents")))


@query()
def document_chunks(spark, sf):
    """Every document as chunks of its articles or sections, with offsets into its Markdown."""
    return _chunks(spark, sf).withColumn("texto", F.md5("texto"))


@query(
    """WITH l AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, unnest(string_split(text, chr(10))[2:]) AS x FROM documents WHERE text IS NOT NULL AND coalesce(tipo_documento, '') <> 'sentencia'),
    a AS (SELECT doc_id, regexp_extract(x, '^(?:ARTÍCULO|Artículo|ART\\.|Art\\.) ?(\\d+)', 1) AS articulo FROM l)
    SELECT doc_id, articulo, count(*) AS veces FROM a WHERE articulo <> '' GROUP BY ALL"""
)
def chunked_articles(spark, sf):
    """Articles of each norm, and how often a number comes again."""
    rows = _chunks(spark, sf).where("articulo is not null").select("doc_id", "articulo", "articulo_id").distinct()
    return rows.groupBy("doc_id", "articulo").agg(F.count("*").alias("veces"))


@query(
    """SELECT CAST(doc_id AS VARCHAR) AS doc_id, true AS en_orden, true AS dentro FROM documents WHERE text IS NOT NULL AND trim(regexp_replace(text, '^[^\\n]*', '')) <> '' AND regexp_matches(text, '\\n[^\\n]*[\\p{L}\\p{N}]')"""
)
def chunk_offsets(spark, sf):
    """Spans of every document's chunks run forward and stay inside its Markdown."""
    md = chunker.markdown_documents(table(spark, sf, "documents"))
    rows = chunker.chunk_documents(md).groupBy("doc_id").agg(F.min("inicio").alias("a"), F.max("fin").alias("b"), F.bool_and(F.coalesce(F.col("fin") >= F.col("inicio"), F.lit(True))).alias("en_orden"))
    return rows.join(md.select("doc_id", F.length("md").alias("n")), "doc_id").select("doc_id", "en_orden", F.coalesce((F.col("a") >= 0) & (F.col("b") <= F.col("n")), F.lit(True)).alias("dentro"))
