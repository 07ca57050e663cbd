"""Filling fixed-capacity containers with items (problem 8).

Method: best-fit decreasing. Items go in by falling size, each into the tightest open bin; a segment tree over the
remaining capacities finds it in logarithmic time. Items larger than a container are first cut into full containers and
a rest. The corpus is packed in blocks of about ``BLOCK_ITEMS`` items, chosen by a hash of the id: only sizes travel,
a block fits a task however large the corpus is, and what blocks cost is at most their last bins.

Sizes are tokens of a public byte-level BPE vocabulary (``byte_bpe_multi_50k.tiktoken``); its folder is a parameter. The
driver reads it there and ships the file to the executors.

Defined results
    * null and blank texts: no row; an empty table, or no containers: no rows; a capacity below 1 is left out.
    * a text of no tokens (it can't be, unless blank) takes no room but gets a bin; repeated ids are packed once, with
      the smallest of their texts.
    * order: size descending, then id; ties between bins go to the oldest one of the same room.
"""

from __future__ import annotations

import base64
import os
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TOKENIZER_DIR = "/opt/tokenizers"
TOKENIZER = "byte_bpe_multi_50k.tiktoken"
# Fixed value: the splitting pattern of that vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BLOCK_ITEMS = 50_000
#: Most containers that are sent to every task.
CONTAINER_ROWS = 1000


class SegmentTree:
    """Bins by remaining room: each leaf is a room, each node the number of open bins below it."""

    def __init__(self, capacity: int) -> None:
        self.size = 1
        while self.size < capacity + 1:
            self.size *= 2
        self.count = [0] * (2 * self.size)
        self.bins: list[deque[int] | None] = [None] * (capacity + 1)

    def add(self, room: int, bin_id: int) -> None:
        if self.bins[room] is None:
            self.bins[room] = deque()
        self.bins[room].append(bin_id)
        i = room + self.size
        while i:
            self.count[i] += 1
            i >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Remove the bin of least room that is at least ``need``; (room, bin) or None."""
        i, count = need + self.size, self.count
        if not count[i]:
            # climb until a right sibling holds a bin, then go down to its leftmost one
            while True:
                if i <= 1:
                    return None
                if not i & 1 and count[i + 1]:
                    i += 1
                    break
                i >>= 1
            while i < self.size:
                i = 2 * i if count[2 * i] else 2 * i + 1
        room = i - self.size
        bin_id = self.bins[room].popleft()
        while i:
            count[i] -= 1
            i >>= 1
        return room, bin_id


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """Bin of each item; ``sizes`` fall and none exceeds ``capacity``."""
    tree, out, bins = SegmentTree(capacity), [], 0
    for size in sizes:
        got = tree.take(size)
        room, bin_id = got if got else (capacity, bins)
        bins += got is None
        out.append(bin_id)
        tree.add(room - size, bin_id)
    return out


def ship(spark: SparkSession, folder: str, name: str) -> None:
    """The vocabulary's file goes to every executor, unless the session has sent it before."""
    if name not in {os.path.basename(f) for f in spark.sparkContext.listFiles}:
        spark.sparkContext.addFile(os.path.join(folder, name))


def encoder(name: str = TOKENIZER):
    """The tokenizer from the shipped file."""
    import tiktoken

    with open(SparkFiles.get(name), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("corpuslake", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, folder: str = TOKENIZER_DIR, name: str = TOKENIZER) -> DataFrame:
    """(doc_id, tokens) of every non-blank text."""
    schema = pa.schema([("doc_id", pa.int64()), ("tokens", pa.int64())])
    ship(documents.sparkSession, folder, name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(name)
        for batch in batches:
            ids, counts = [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if text.strip():
                    ids.append(i)
                    counts.append(len(enc.encode_ordinary(text)))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(counts, pa.int64())], schema=schema)

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    return rows.mapInArrow(run, "doc_id long, tokens long").groupBy("doc_id").agg(F.min("tokens").alias("tokens"))


def pack(counts: DataFrame, contenedores: DataFrame, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """(contenedor_id, capacidad_tokens, bloque, recipiente, doc_id, parte, tokens), for every capacity."""
    rows = contenedores.where("contenedor_id is not null and capacidad_tokens >= 1").select("contenedor_id", "capacidad_tokens").distinct().take(CONTAINER_ROWS + 1)
    if len(rows) > CONTAINER_ROWS:
        raise ValueError(f"more than {CONTAINER_ROWS} kinds of containers")
    kinds = sorted((r.contenedor_id, r.capacidad_tokens) for r in rows)
    schema = "contenedor_id int, capacidad_tokens int, bloque int, recipiente int, doc_id long, parte int, tokens int"
    blocks = max(1, -(-counts.count() // block_items))

    def block(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["tokens", "doc_id"], ascending=[False, True])
        out = []
        for cid, cap in kinds:
            n = frame.tokens.to_numpy()
            pieces = np.maximum(1, -(-n // cap))
            doc = np.repeat(frame.doc_id.to_numpy(), pieces)
            part = np.concatenate([np.arange(p) for p in pieces]) if len(pieces) else np.empty(0, int)
            size = np.minimum(np.repeat(n, pieces) - part * cap, cap)
            order = np.lexsort((part, doc, -size))
            doc, part, size = doc[order], part[order], size[order]
            bins = best_fit_decreasing(size.tolist(), cap)
            out.append(pd.DataFrame({"contenedor_id": cid, "capacidad_tokens": cap, "bloque": int(frame.bloque.iloc[0]), "recipiente": bins, "doc_id": doc, "parte": part, "tokens": size}))
        return pd.concat(out) if out else pd.DataFrame(columns=[c.split()[0] for c in schema.split(", ")])

    blocked = counts.withColumn("bloque", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int"))
    return blocked.groupBy("bloque").applyInPandas(block, schema)


def room(documents: DataFrame, contenedores: DataFrame) -> DataFrame:
    """(contenedor_id, capacidad_tokens, recipientes, documentos, tokens, libre): bins of each capacity, and the share of
    their room that is left unused."""
    used = bins(documents, contenedores)
    got = used.groupBy("contenedor_id", "capacidad_tokens", "bloque", "recipiente").agg(F.sum("tokens").alias("t"), F.count_if(F.col("parte") == 0).alias("d"))
    got = got.groupBy("contenedor_id", "capacidad_tokens").agg(F.count("*").alias("recipientes"), F.sum("d").alias("documentos"), F.sum("t").alias("tokens"))
    return got.withColumn("libre", F.round(1 - F.col("tokens") / (F.col("recipientes") * F.col("capacidad_tokens")), 6))


def bins(documents: DataFrame, contenedores: DataFrame) -> DataFrame:
    from .base import cut_lineage

    return pack(cut_lineage(token_counts(documents)), contenedores)
