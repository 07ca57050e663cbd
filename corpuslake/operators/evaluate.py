"""Metrics of retrieval and answers, as aggregates over long tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def retrieval_metrics(hits: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """(qid, n_rel, recall, rr, ndcg) from (qid, rank, doc) and (qid, doc); a document counts at its first rank.

    No relevant document: null recall, zero rank and gain.
    """
    first = hits.where(F.col("rank") <= k).groupBy("qid", "doc").agg(F.min("rank").alias("rank"))
    got = relevant.select("qid", "doc").distinct().join(first, ["qid", "doc"], "left")
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n_rel"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1.0))
    per = got.groupBy("qid").agg(F.count("*").alias("n_rel"), F.count("rank").alias("n"), F.min("rank").alias("best"), F.sum(1.0 / F.log2(F.col("rank") + 1.0)).alias("gain"))
    out = per.select("qid", "n_rel", F.round(F.col("n") / F.col("n_rel"), 6).alias("recall"), F.round(F.coalesce(1.0 / F.col("best"), F.lit(0.0)), 6).alias("rr"), F.round(F.coalesce(F.col("gain"), F.lit(0.0)) / ideal, 6).alias("ndcg"))
    return out


def lower_percentile(x: str, share: float) -> Column:
    """The value at index int(share * (n - 1)) of the sorted values: no interpolation. Exact, with no list of values."""
    return F.expr(f"percentile_disc({share}) within group (order by {x})")


def closed_points(right: Column, total: Column) -> Column:
    return F.round(20.0 * right / F.greatest(total, F.lit(1)), 4)
