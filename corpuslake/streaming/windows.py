"""Streaming: appending landed rows to an index, and event windows (an extension; the same code serves both modes)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder


def tumbling(events: DataFrame, size: str, late: str | None = None) -> DataFrame:
    rows = events.withColumn("t", F.col("ts").cast("timestamp"))
    if late:
        rows = rows.withWatermark("t", late)
    got = rows.groupBy(F.window("t", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("suma"))
    return got.select(F.col("window.start").alias("inicio"), "event_type", "n", "suma")


def sessions(events: DataFrame, gap: str, late: str | None = None) -> DataFrame:
    rows = events.withColumn("t", F.col("ts").cast("timestamp"))
    if late:
        rows = rows.withWatermark("t", late)
    got = rows.groupBy(F.session_window("t", gap), "user_id").agg(F.count("*").alias("n"))
    return got.select(F.col("session_window.start").alias("inicio"), "user_id", "n")


def first_sends(stream: DataFrame, late: str = "400 days") -> DataFrame:
    """Rows of a stream of chunks without those sent again within the watermark."""
    timed = stream.withColumn("cargado_en", F.col("cargado_en").cast("timestamp"))
    return timed.withWatermark("cargado_en", late).dropDuplicatesWithinWatermark(["chunk_id"])


def append_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Run the stream over what has landed, into a table in the shared folder; (tipo_chunk, n) of that table."""
    path = f"{sf}/chunks.parquet"
    run = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    schema = spark.read.parquet(path).schema
    source = spark.readStream.schema(schema).parquet(path.rstrip("/") if _is_dir(spark, path) else f"{sf}/chunks.parquet*")
    rows = first_sends(source.select("chunk_id", "doc_id", "tipo_chunk", "cargado_en"))

    def upsert(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{run}/table/lote={number}")  # a batch that is run again replaces itself

    query = rows.writeStream.foreachBatch(upsert).option("checkpointLocation", f"{run}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{run}/table").groupBy("tipo_chunk").agg(F.count_distinct("chunk_id").alias("n"))


def _is_dir(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()
