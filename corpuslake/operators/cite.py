"""Citations in text, and joins with what they name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A norm with number and year, and a ruling, in folded text.
NORM = r"\b(ley|decreto|resolucion) (?:no\. ?|numero )?(\d{1,6}) de (\d{4})"
RULING = r"\bsentencia (t|c|su|sl|sc|stl|stc)-?(\d{1,6})(?: de |[-/])(\d{4}|\d{2})\b"


def full_year(y: Column) -> Column:
    """Two-digit years turn over at 50."""
    n = y.cast("int")
    return F.when(n >= 1000, n).when(n < 50, n + 2000).otherwise(n + 1900)


def extract(texts: DataFrame, key: str, folded: Column) -> DataFrame:
    """(key, cuerpo, numero, anio): distinct citations of each text, by two of J01's four passes: numbered norms and rulings, no
    aliased law without a year and no code by its name. Matches are found once, their parts cut from them."""
    found = texts.select(key, F.explode(F.concat(F.regexp_extract_all(folded, F.lit(NORM), F.lit(0)), F.regexp_extract_all(folded, F.lit(RULING), F.lit(0)))).alias("m"))
    ruling = F.col("m").startswith("sentencia")
    body = F.when(ruling, "sentencia").otherwise(F.regexp_extract("m", NORM, 1))
    number = F.when(ruling, F.concat(F.regexp_extract("m", RULING, 1), F.lit("-"), F.regexp_extract("m", RULING, 2).cast("int").cast("string"))).otherwise(F.regexp_extract("m", NORM, 2).cast("int").cast("string"))
    year = F.when(ruling, full_year(F.regexp_extract("m", RULING, 3))).otherwise(F.regexp_extract("m", NORM, 3).cast("int"))
    return found.select(key, body.alias("cuerpo"), number.alias("numero"), year.alias("anio")).distinct()


def canonical(docs: DataFrame) -> DataFrame:
    """(doc_id, cuerpo, numero, anio) of the documents' ids; codes have no number."""
    kind = F.substring_index("doc_id", "_", 1)
    middle = F.regexp_extract("doc_id", "^[a-z]+_(.+)_[0-9]+$", 1)
    ruling = kind == "jurisprudencia"
    return docs.select(
        "doc_id",
        F.when(ruling, "sentencia").otherwise(kind).alias("cuerpo"),
        F.when(kind == "codigo", F.lit(None)).otherwise(middle).alias("numero"),
        F.regexp_extract("doc_id", "_([0-9]+)$", 1).cast("int").alias("anio"),
    ).distinct()


def resolve(cites: DataFrame, docs: DataFrame) -> DataFrame:
    """Citations with the documents they name; keys may be null on both sides."""
    c, d = cites.alias("c"), canonical(docs).alias("d")
    on = (F.col("c.cuerpo") == F.col("d.cuerpo")) & F.col("c.numero").eqNullSafe(F.col("d.numero")) & F.col("c.anio").eqNullSafe(F.col("d.anio"))
    return c.join(d, on, "left").select("c.*", "d.doc_id")
