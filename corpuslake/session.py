"""The shared folder that the cluster names, cutting lineage in it, and sizing shuffles from what goes into them."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_PARTITIONS, _ADVISED = "spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes"
#: Most partitions of one shuffle; beyond it they grow instead.
MOST_PARTITIONS = 100_000


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Only a session in one process (tests) may name none: it gets a temporary
    folder, removed when the process ends. On a cluster a missing folder is an error."""
    sc = spark.sparkContext
    own = sc._jsc.sc().getCheckpointDir()
    if own.isDefined():
        return own.get()
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="corpuslake-checkpoint-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    sc.setCheckpointDir(named)
    return sc._jsc.sc().getCheckpointDir().get()


def cut_lineage(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder, which outlives the loss of executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def input_bytes(df: DataFrame) -> int:
    """Bytes that the optimizer expects a frame to have; 0 where it can't tell."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else 0


@contextmanager
def shuffles_of(spark: SparkSession, size: float) -> Iterator[int]:
    """For the jobs that run inside: as many shuffle partitions as ``size`` bytes need at the session's advised partition
    size, never fewer than the session has; adaptive execution still merges and splits them. The setting is put back."""
    before = spark.conf.get(_PARTITIONS)
    each = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(_ADVISED))
    n = max(int(before), min(MOST_PARTITIONS, int(size // max(1, each)) + 1))
    spark.conf.set(_PARTITIONS, n)
    try:
        yield n
    finally:
        spark.conf.set(_PARTITIONS, before)


def plain_union(*frames: DataFrame, by: list[str]) -> DataFrame:
    """Rows of all frames, hashed anew by ``by``, for grouping.

    Spark 4.1 takes a union of equally partitioned frames as partitioned likewise, which adaptive coalescing of one of
    them can break; grouping such a union as it stands then counts a key twice.
    """
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out.repartition(*by)
