"""Vector search: exact, and by an inverted file of centroids fitted on a bounded sample."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .search import ranked

#: Query vectors that go to every task at once; more are searched in blocks.
QUERY_BLOCK = 4096
#: Vectors that the centroids are fitted on, and of those, the ones that the number of probes is fitted on.
FIT_ROWS, PROBE_ROWS = 20_000, 1000
#: Share of a fitted vector's neighbours that the probed cells must hold.
TARGET = 0.95
#: Most cells; up to it they are about the square root of the number of vectors.
MOST_CELLS = 4096


def exact_top_k(queries: DataFrame, vectors: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(qid, id, score, rank) by inner product, every vector against a stated set of queries, in blocks.

    A task keeps its own best ``k`` (with ties of the rounded score) of each query, so little is shuffled.
    """
    rows = queries.select(F.col(id_col).alias("q"), F.col(vec_col).alias("v")).where("q is not null and v is not null")
    blocks = max(1, -(-rows.count() // QUERY_BLOCK))
    out = None
    for b in range(blocks):
        part = rows.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == b).collect()
        hits = _partial(vectors.select(id_col, vec_col), [r.q for r in part], np.array([r.v for r in part], np.float64), k)
        out = hits if out is None else out.unionByName(hits)
    return ranked(out, ["qid"], [F.col("score").desc(), F.col("id")], k)


def _partial(vectors: DataFrame, ids: list[int], matrix: np.ndarray, k: int) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            frame = frame.dropna()
            if not len(frame) or not len(ids):
                continue
            own = frame.iloc[:, 0].to_numpy()
            score = np.round(matrix @ np.stack(frame.iloc[:, 1].to_numpy()).astype(np.float64).T, 4)
            for qid, row in zip(ids, score):
                row = np.where(own == qid, -np.inf, row)
                edge = np.partition(row, -min(k, len(row)))[-min(k, len(row))]
                at = np.flatnonzero((row >= edge) & np.isfinite(row))
                yield pd.DataFrame({"qid": qid, "id": own[at], "score": row[at]})

    return vectors.mapInPandas(run, "qid long, id long, score double")


def sampled(vectors: DataFrame, vec_col: str = "embedding", id_col: str = "vec_id") -> tuple[np.ndarray, int]:
    """About ``FIT_ROWS`` vectors, chosen by a hash of the id, and the number of all."""
    total = vectors.count()
    share = min(1.0, FIT_ROWS / max(1, total))
    picked = vectors.where(F.pmod(F.xxhash64(id_col), F.lit(1 << 20)) <= int(share * (1 << 20))).orderBy(id_col).select(vec_col).collect()
    x = [r[0] for r in picked if r[0]]
    return (np.array(x, np.float64) if x else np.zeros((0, 0))), total


def centroids(x: np.ndarray, n: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means of ``x``."""
    if not len(x):
        return np.zeros((0, 0))
    rng = np.random.default_rng(0)
    c = x[rng.choice(len(x), min(n, len(x)), replace=False)]
    for _ in range(rounds):
        near = (x @ c.T).argmax(1)
        for j in range(len(c)):
            own = x[near == j]
            if len(own):
                m = own.mean(0)
                c[j] = m / max(1e-12, np.linalg.norm(m))
    return c


def probes_for(x: np.ndarray, c: np.ndarray, k: int, target: float = TARGET) -> int:
    """The least number of cells, nearest first, that hold ``target`` of the ``k`` nearest neighbours of the sample's vectors."""
    if len(x) < 2 or not len(c):
        return 1
    asks = x[np.linspace(0, len(x) - 1, min(PROBE_ROWS, len(x))).astype(int)]
    near = np.argsort(-(asks @ x.T), axis=1, kind="stable")[:, 1 : k + 1]
    cell = (x @ c.T).argmax(1)
    place = np.empty((len(asks), len(c)), int)
    np.put_along_axis(place, np.argsort(-(asks @ c.T), axis=1, kind="stable"), np.arange(len(c))[None], 1)
    depth = np.sort(np.take_along_axis(place, cell[near], 1).ravel())
    return int(depth[min(len(depth) - 1, int(np.ceil(target * len(depth))) - 1)]) + 1


def assign(vectors: DataFrame, c: np.ndarray, probes: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, v, cell): each vector with its ``probes`` nearest cells."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            frame = frame.dropna()
            if len(frame) and len(c):
                near = np.argsort(-(np.stack(frame.iloc[:, 1].to_numpy()).astype(np.float64) @ c.T), axis=1, kind="stable")[:, :probes]
                yield pd.DataFrame({"id": np.repeat(frame.iloc[:, 0].to_numpy(), near.shape[1]), "v": np.repeat(frame.iloc[:, 1].to_numpy(), near.shape[1]), "cell": near.ravel().astype(np.int32)})

    return vectors.select(id_col, vec_col).mapInPandas(run, "id long, v array<float>, cell int")


def ivf_top_k(queries: DataFrame, vectors: DataFrame, k: int, target: float = TARGET) -> DataFrame:
    """(qid, id, score, rank): every vector is indexed in its nearest cell, a query looks into the cells that the sample
    asks for (see :func:`probes_for`). A crowded cell is a skewed join key, which adaptive execution splits."""
    x, total = sampled(vectors)
    c = centroids(x, max(1, min(MOST_CELLS, round(total**0.5))))
    index = assign(vectors, c, 1).select("id", F.col("v").alias("w"), "cell")
    asks = assign(queries, c, probes_for(x, c, k, target)).select(F.col("id").alias("qid"), "v", "cell")
    dot = F.aggregate(F.zip_with("v", "w", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x)
    hits = index.join(asks, "cell").where("qid != id").select("qid", "id", F.round(dot, 4).alias("score"))
    return ranked(hits, ["qid"], [F.col("score").desc(), F.col("id")], k)


def recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """Share of the exact neighbours that an index finds."""
    t = truth.select("qid", "id").distinct()
    hit = t.join(found.select("qid", "id").distinct().withColumn("hit", F.lit(1)), ["qid", "id"], "left")
    return hit.agg(F.count("*").alias("vecinos"), F.round(F.avg(F.coalesce("hit", F.lit(0))), 4).alias("recuerdo"))
