"""Reading the tables: typed chunk rows, re-sent rows counted once, JSON lines in and out, keyed upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fields of a chunk's JSON that the engine reads by name; absent ones are null.
CHUNK_FIELDS = (
    "texto string, inicio int, fin int, articulo string, parte int, n_partes int, seccion string, ruta array<string>, "
    "derogado boolean, n_chars int, titulo string, tipo_documento string, tipo_norma string, numero string, anio string, "
    "organo_emisor string, nombre_citable string, epigrafe string, vigencia string, areas array<string>, prioridad string, "
    "nivel int, origen string, fuente string, url string, fecha_consulta string"
)
#: Rows of a lookup table that may be broadcast; beyond it the join is left to Spark.
LOOKUP_ROWS = 100_000


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def chunks(spark: SparkSession, sf: str, *fields: str) -> DataFrame:
    """One row for each chunk with data: its columns and the JSON ``fields`` asked for. Rows sent again are dropped after
    the projection, so that only what a query reads is shuffled."""
    kinds = dict(x.split(" ", 1) for x in CHUNK_FIELDS.split(", "))
    rows = table(spark, sf, "chunks").where("datos is not null and chunk_id is not null")
    cols = ["chunk_id", "doc_id", "articulo_id", "seccion_id", "tipo_chunk"]
    if not fields:
        return rows.select(*cols).dropDuplicates(["chunk_id"])
    parsed = rows.select(*cols, F.from_json("datos", ", ".join(f"{f} {kinds[f]}" for f in fields)).alias("j"))
    return parsed.select(*cols, *[F.col(f"j.{f}").alias(f) for f in fields]).dropDuplicates(["chunk_id"])


def passages(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct passages, with their document."""
    return table(spark, sf, "pasajes").drop("recuperado_en").dropDuplicates(["pasaje_id"]).withColumn("doc_id", F.substring_index("id", "/", 1))


def latest(df: DataFrame, keys: list[str], by: str) -> DataFrame:
    """Keyed upsert: the last row of each key."""
    w = Window.partitionBy(*keys).orderBy(F.col(by).desc())
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def manifest(spark: SparkSession, sf: str) -> DataFrame:
    """The download manifest as it stands now."""
    return latest(table(spark, sf, "descargas"), ["doc_id"], "recibido_en")


def is_small(df: DataFrame, rows: int = LOOKUP_ROWS) -> bool:
    return df.limit(rows + 1).count() <= rows


def lookup(df: DataFrame, rows: int = LOOKUP_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows, as it is otherwise."""
    return F.broadcast(df) if is_small(df, rows) else df


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines, split at line feeds only: other separators occur inside values. Blank lines are skipped."""
    return spark.read.schema(schema).option("lineSep", "\n").json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("lineSep", "\n").json(path)


def merge_manifest(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """This run's rows win, others stay."""
    return new.unionByName(old.join(new.select(key), key, "left_anti"))


def write_index(df: DataFrame, path: str, by: str, buckets: int = 64) -> None:
    """A keyed table laid out for pruning: hashed into files by ``by`` and sorted inside them."""
    df.repartition(buckets, by).sortWithinPartitions(by).write.mode("overwrite").parquet(path)
