"""Top N items within every group (problem 7).

Method: secondary sort. Rows are hash-partitioned by group, sorted within partitions by group, score and identifier,
and streamed as Arrow batches that let the first N of each group through; no group is ever buffered. A first round does
the same on (group, salt), so that a crowded group is spread over many tasks and only N rows of each go on; the number
of salts follows the number of rows.

Defined results
    * null groups, and null or NaN scores, never count; an empty table: no rows; infinite scores are ordinary.
    * rows with the same group, score and identifiers count once (rows sent again).
    * ties: ``tie_cols`` ascending in turn, strings by code point, nulls first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, StructField, StructType

#: Salts at least, and the rows for each salt beyond: a group of all rows is still parted into tasks of about so many.
SALTS, SALT_ROWS = 16, 500_000


def _first_n(df: DataFrame, group_cols: list[str], key_cols: list[str], n: int, rank: str | None) -> DataFrame:
    """Of rows sorted by group and key: the first ``n`` distinct keys of each group, streamed."""
    names = df.columns
    schema = to_arrow_schema(df.schema)
    if rank:
        schema = schema.append(pa.field(rank, pa.int32()))
    out = StructType([*df.schema.fields, StructField(rank, IntegerType())] if rank else df.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: pa.RecordBatch | None = None
        count = 0  # distinct keys of the open group so far
        for batch in batches:
            rows = batch.num_rows
            if not rows:
                continue
            whole = pa.Table.from_batches([batch] if last is None else [last, batch]).combine_chunks()
            head = 0 if last is None else 1

            def changes(cols: list[str]) -> np.ndarray:
                """Row differs from the row before it in one of the columns."""
                flag = np.zeros(whole.num_rows, bool)
                for c in cols:
                    col = whole.column(names.index(c))
                    a, b = col.slice(0, whole.num_rows - 1), col.slice(1)
                    same = pc.fill_null(pc.equal(a, b), False)
                    both = pc.and_(pc.is_null(a), pc.is_null(b))
                    flag[1:] |= ~pc.or_(same, both).to_numpy(zero_copy_only=False)
                if last is None:
                    flag[0] = True
                return flag[head:]

            new_group = changes(group_cols)
            new_key = changes(group_cols + key_cols)
            total = np.cumsum(new_key)
            starts = np.flatnonzero(new_group)
            base = np.full(rows, -count)
            for_rows = np.searchsorted(starts, np.arange(rows), side="right")
            inside = for_rows > 0
            if len(starts):
                base[inside] = total[starts[for_rows[inside] - 1]] - 1
            place = total - base
            keep = new_key & (place <= n)
            count = int(place[-1])
            last = batch.slice(rows - 1, 1)
            if keep.any():
                cols = [c.filter(pa.array(keep)) for c in batch.columns]
                if rank:
                    cols.append(pa.array(place[keep].astype(np.int32)))
                yield pa.RecordBatch.from_arrays(cols, schema=schema)

    return df.mapInArrow(run, out)


def top_n(df: DataFrame, group_cols: list[str], score_col: str, tie_cols: list[str], n: int, rank: str = "rank", salts: int | None = None) -> DataFrame:
    """The ``n`` rows of highest score of every group, with their place from 1."""
    salts = salts or max(SALTS, -(-df.count() // SALT_ROWS))
    rows = df.where(F.col(score_col).isNotNull() & ~F.isnan(F.col(score_col).cast("double")))
    for c in group_cols:
        rows = rows.where(F.col(c).isNotNull())
    order = [F.col(score_col).desc(), *[F.col(c).asc_nulls_first() for c in tie_cols]]
    salt = "__salt"
    while salt in df.columns:
        salt += "_"
    salted = rows.withColumn(salt, F.pmod(F.xxhash64(*tie_cols), F.lit(salts)).cast("int"))
    near = salted.repartition(*group_cols, salt).sortWithinPartitions(*group_cols, salt, *order)
    near = _first_n(near, [*group_cols, salt], [score_col, *tie_cols], n, None).drop(salt)
    far = near.repartition(*group_cols).sortWithinPartitions(*group_cols, *order)
    return _first_n(far, group_cols, [score_col, *tie_cols], n, rank)


def found(pasajes: DataFrame) -> DataFrame:
    rows = pasajes.select(F.substring_index("id", "/", 1).alias("doc_id"), "score", "id", "pasaje_id")
    return top_n(rows, ["doc_id"], "score", ["id", "pasaje_id"], 3, "puesto").select("doc_id", "puesto", "pasaje_id")
