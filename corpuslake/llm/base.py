"""Helpers shared by the training-text operators: table access, model samples, Arrow mapping."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import cut_lineage  # noqa: F401

#: Rows of a table that may be used to fit a model; everything else reads every row.
SAMPLE_ROWS = 6000
_BUCKETS = 1 << 30
_MARKS = re.compile("[\u0300-\u036f\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\ufe20-\ufe2f]+")
#: Characters that have no accent to remove.
_PLAIN = re.compile(r"[\x00-\x7fºª°«»“”‘’–—…·•¿¡§©›→]*")


def chunk_texts(chunks: DataFrame) -> DataFrame:
    """(chunk_id, tipo_chunk, articulo_id, texto) of each row whose ``datos`` holds a text."""
    return chunks.select(
        "chunk_id", "tipo_chunk", "articulo_id", F.get_json_object("datos", "$.texto").alias("texto")
    ).where(F.col("texto").isNotNull())


def keyed_texts(chunks: DataFrame, pasajes: DataFrame) -> DataFrame:
    """(tabla, clave, texto) over both text tables; nulls are left out.

    A chunk's text stays inside its JSON here (``datos`` travels as ``texto`` with ``tabla`` = 'chunks'), because the
    Python side parses it for less than the JVM does; see :func:`text_of`.
    """
    a = chunks.select(F.lit("chunks").alias("tabla"), F.col("chunk_id").alias("clave"), F.col("datos").alias("texto"))
    b = pasajes.select(F.lit("pasajes").alias("tabla"), F.col("pasaje_id").cast("string").alias("clave"), "texto")
    return a.unionByName(b).where(F.col("texto").isNotNull() & F.col("clave").isNotNull())


def text_of(tabla: str, value: str) -> str | None:
    """The text of a row of :func:`keyed_texts`; None for JSON that is broken or has no string ``texto``."""
    if tabla != "chunks":
        return value
    try:
        data = json.loads(value)
    except ValueError:
        return None
    text = data.get("texto") if isinstance(data, dict) else None
    return text if isinstance(text, str) else None


def fold(text: str) -> str:
    """Lower case without accents; the common letters by plain replacement, which is ten times faster."""
    text = text.lower()
    if text.isascii():
        return text
    for accented, plain in zip("áéíóúñü", "aeiounu"):
        text = text.replace(accented, plain)
    return text if _PLAIN.fullmatch(text) else _MARKS.sub("", unicodedata.normalize("NFD", text))


def sample_rows(df: DataFrame, key: str, value: str, rows: int = SAMPLE_ROWS, seed: str = "m") -> list:
    """At most about ``rows`` values, chosen by a hash of ``key`` so that the choice does not depend on partitioning.

    ``rows`` is the documented bound of what a model is fitted on (a chance excess of a few per cent aside). Counting
    reads parquet footers only. A key that is sent again counts once, nulls are left out; an empty table: an empty list.
    """
    total = df.count()
    if not total:
        return []
    share = min(_BUCKETS, int(_BUCKETS * min(1.0, rows / total)) + 1)
    picked = df.where(F.pmod(F.xxhash64(F.lit(seed), F.col(key).cast("string")), F.lit(_BUCKETS)) < share)
    named = picked.where(F.col(value).isNotNull() & F.col(key).isNotNull()).select(F.col(key).cast("string").alias("k"), F.col(value).alias("v"))
    got = named.groupBy("k").agg(F.min("v").alias("v")).collect()
    return [r.v for r in sorted(got, key=lambda r: r.k)]


def map_arrow(df: DataFrame, schema: str, fn: Callable[[list[list]], list[list]]) -> DataFrame:
    """Apply ``fn`` to the columns of every Arrow batch, as Python lists; it returns the output columns."""
    out = _arrow_schema(df, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = fn([c.to_pylist() for c in batch.columns])
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, out)], schema=out)

    return df.mapInArrow(run, schema)


def _arrow_schema(df: DataFrame, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(StructType.fromDDL(schema))
