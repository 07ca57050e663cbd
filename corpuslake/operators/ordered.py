"""Lags, running sums and ranks over long ordered groups without one task for each group.

A frame is range-partitioned by group and order, so that a crowded group spans many partitions; what a partition needs
of the one before it is one row or one sum, and those few rows, one a partition, are joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

_PID = "__pid"


def spread(df: DataFrame, order: list[Column]) -> DataFrame:
    """Range-partitioned by ``order``, with the partition's number; fixed by a checkpoint, as ranges are sampled."""
    return cut_lineage(df.repartitionByRange(*order).withColumn(_PID, F.spark_partition_id()))


def with_lag(df: DataFrame, keys: list[str], order: list[str], cols: list[str]) -> DataFrame:
    """``prev_<col>``: the value in the row before, within the group; null in a group's first row."""
    rows = spread(df, [F.col(c) for c in keys + order])
    w = Window.partitionBy(_PID).orderBy(*keys, *order)
    box = F.struct(*keys, *cols)
    last = rows.groupBy(_PID).agg(F.max_by(box, F.struct(*keys, *order)).alias("__edge"))
    edge = last.select(_PID, F.lag("__edge").over(Window.orderBy(_PID)).alias("__edge"))  # one row a partition
    rows = rows.withColumn("__prev", F.lag(box).over(w)).join(F.broadcast(edge), _PID).withColumn("__prev", F.coalesce("__prev", "__edge"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"__prev.{k}").eqNullSafe(F.col(k))
    out = rows
    for c in cols:
        out = out.withColumn(f"prev_{c}", F.when(same, F.col(f"__prev.{c}")))
    return out.withColumn("__first", ~F.coalesce(same, F.lit(False))).drop("__prev", "__edge")


def running_sum(df: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """Running sum of ``value`` within the group, on a frame of :func:`with_lag`."""
    w = Window.partitionBy(_PID, *keys).orderBy(*order)
    part = df.groupBy(_PID, *keys).agg(F.sum(value).alias("__s"))
    # only the first group of a partition can have begun before it
    edge = part.join(part.groupBy(_PID).agg(F.min(F.struct(*keys)).alias("__k")), _PID)
    begun = edge.where(" and ".join(f"{k} <=> __k.{k}" for k in keys)).select(_PID, *keys)
    before = part.alias("a").join(F.broadcast(begun).withColumnRenamed(_PID, "__to"), keys).where(f"{_PID} < __to").groupBy(F.col("__to").alias(_PID), *keys).agg(F.sum("__s").alias("__before"))
    out = df.withColumn("__in", F.sum(value).over(w)).join(F.broadcast(before), [_PID, *keys], "left")
    return out.withColumn(name, (F.col("__in") + F.coalesce("__before", F.lit(0))).cast("int")).drop("__in", "__before")


def global_rank(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Place of every row in one total order."""
    rows = spread(df, order)
    sizes = rows.groupBy(_PID).agg(F.count("*").alias("__n"))
    before = sizes.select(_PID, F.coalesce(F.sum("__n").over(Window.orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    place = F.row_number().over(Window.partitionBy(_PID).orderBy(*order)) + F.col("__before")
    return rows.join(F.broadcast(before), _PID).withColumn(name, place.cast("int")).drop(_PID, "__before")
