"""Segmentation of texts: blocks with offsets, paragraphs, heading stacks, windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def blocks(docs: DataFrame) -> DataFrame:
    """(doc_id, bloque, inicio, fin, x): pieces parted by blank lines; offsets run through the whole text."""
    rows = docs.where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n\n")).alias("bloque", "x"))
    w = Window.partitionBy("doc_id").orderBy("bloque").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inicio", F.coalesce(F.sum(F.length("x") + 2).over(w), F.lit(0)).cast("long"))
    return rows.withColumn("fin", F.col("inicio") + F.length("x"))


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, i, x): lines counted from 1."""
    return docs.where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "x")).withColumn("i", F.col("i") + 1)


def paragraphs(docs: DataFrame) -> DataFrame:
    """(doc_id, parrafo, lineas, letras): gaps and islands over lines."""
    w = Window.partitionBy("doc_id").orderBy("i")
    rows = lines(docs).withColumn("p", F.lag("x").over(w))
    new = F.col("p").isNull() | (F.trim("p") == "") | (F.trim("x") == "") | F.col("p").rlike("[.:;]$")
    rows = rows.withColumn("g", F.sum(F.when(new, 1).otherwise(0)).over(w)).where(F.trim("x") != "")
    groups = rows.groupBy("doc_id", "g").agg(F.count("*").alias("lineas"), F.sum(F.length("x")).alias("letras"))
    return groups.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("g")).alias("parrafo"), "lineas", "letras")


def heading_stack(docs: DataFrame) -> DataFrame:
    """(doc_id, linea, seccion, articulo_en): last heading of each level; a section closes the article before it."""
    w = Window.partitionBy("doc_id").orderBy("i")
    section, article = F.col("x").rlike(r"^[IVX]+\. [A-ZÁÉÍÓÚÑ ]+$"), F.col("x").rlike(r"^(ARTÍCULO|Artículo|ART\.|Art\.) ?")
    at = F.when(article, F.col("i")).when(section, -1)
    rows = lines(docs).withColumn("seccion", F.last(F.when(section & ~article, F.col("x")), ignorenulls=True).over(w)).withColumn("a", F.last(at, ignorenulls=True).over(w))
    kept = rows.where((F.trim("x") != "") & (F.col("seccion").isNotNull() | (F.col("a") > 0)))
    return kept.select("doc_id", F.col("i").alias("linea"), "seccion", F.when(F.col("a") > 0, F.col("a")).alias("articulo_en"))


def pack(docs: DataFrame, limit: int) -> DataFrame:
    """(doc_id, ventana, bloques, letras): blocks packed in order into windows of at most ``limit`` characters.

    The fold runs inside each row, over the lengths of the text's blocks; longer blocks are first cut at sentence ends,
    then hard.
    """
    hard = F.transform(F.sequence(F.lit(0), F.floor((F.length("s") - 1) / limit).cast("int")), lambda k: F.least(F.lit(limit), F.length("s") - k * limit))
    rows = docs.where("trim(text) <> ''").select("doc_id", F.posexplode(F.split("text", r"\n\n|(?<=[.;]) (?=\p{Lu})")).alias("i", "s")).where("length(s) > 0")
    sizes = rows.select("doc_id", "i", hard.alias("h")).groupBy("doc_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("i", "h"))), lambda x: x["h"])).alias("n"))

    def step(acc: Column, v: Column) -> Column:
        last = F.element_at(acc, -1)
        fits = (F.size(acc) > 0) & (last["letras"] + v + 1 <= limit)
        grown = F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct((last["bloques"] + 1).alias("bloques"), (last["letras"] + v + 1).alias("letras"))))
        return F.when(fits, grown).otherwise(F.concat(acc, F.array(F.struct(F.lit(1).alias("bloques"), v.alias("letras")))))

    packed = F.aggregate("n", F.expr("cast(array() as array<struct<bloques:int,letras:int>>)"), step)
    return sizes.select("doc_id", F.posexplode(packed).alias("ventana", "w")).select("doc_id", "ventana", "w.bloques", "w.letras")
