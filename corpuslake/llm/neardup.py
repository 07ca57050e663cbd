"""Near-duplicate records with small edits (problem 4).

Method: circulant MinHash. A first permutation scatters the hashed shingles over a ring of 2**32 places, a second one,
shifted along the ring by k places, gives the k-th coordinate of the signature. Signatures are banded; records that
agree in a band are candidates; every candidate pair is verified by the exact Jaccard similarity of the shingle sets.

Records with equal texts are one class: a class is banded once, its smallest id is compared, and links are given back to
all members at the end.

Defined results
    * null texts and texts without a whole shingle: no row; an empty table: no rows.
    * rows sent again (same id) count once; of several texts of an id, the one of the smallest hash stands for it.
    * the whole text is compared, whatever its length; ties don't arise (a link is a fact).
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import input_bytes, shuffles_of
from .base import cut_lineage

_WORD = re.compile(r"[^\W_]+")
_U = np.uint64
#: Signature shape: at similarity 0.6 a pair shares no band with a probability of 0.011, at 0.65 of 0.001.
BANDS, ROWS = 56, 5


def _mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


#: Odd multipliers of the second permutation, x -> ((x * A) ^ (x * A >> 16)) * B, a bijection of 32-bit numbers.
_SHIFT = np.uint32(16)
_A, _B = np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35)


class Shingler:
    """Hashed runs of ``width`` consecutive words of texts; word hashes are kept by spelling."""

    def __init__(self, width: int = 5) -> None:
        self.width = width
        self._ids: dict[str, int] = {}

    def runs(self, texts: list[str]) -> list[np.ndarray]:
        """64-bit shingle hashes of each text, in order, with repeats; a whole list is hashed at once."""
        ids, lists = self._ids, [_WORD.findall(t.lower()) for t in texts]
        flat = list(itertools.chain.from_iterable(lists))
        if len(ids) > 2_000_000:
            ids.clear()
        try:
            h = np.fromiter(map(ids.__getitem__, flat), np.uint64, len(flat))
        except KeyError:
            for w in set(flat).difference(ids):
                ids[w] = int.from_bytes(hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
            h = np.fromiter(map(ids.__getitem__, flat), np.uint64, len(flat))
        n = max(0, len(h) - self.width + 1)
        out = np.zeros(n, np.uint64)
        for k in range(self.width):
            out = _mix64(out * _U(0x9E3779B97F4A7C15) + h[k : k + n] + _U(k + 1))
        parts, at = [], 0
        for words in lists:
            parts.append(out[at : max(at, at + len(words) - self.width + 1)])
            at += len(words)
        return parts

    def __call__(self, text: str) -> np.ndarray:
        """Sorted distinct shingle hashes of one text."""
        return np.unique(self.runs([text])[0])


def signature(shingles: np.ndarray, size: int) -> np.ndarray:
    """Circulant MinHash: ``size`` coordinates from two permutations."""
    ring = (_mix64(shingles + _U(0x5851F42D4C957F2D)) >> _U(32)).astype(np.uint32) * _A
    shifts = np.arange(1, size + 1, dtype=np.uint32) * _A
    step = max(1, 16_000 // max(1, len(ring)))
    out, x, t = np.empty(size, np.uint32), np.empty((step, len(ring)), np.uint32), np.empty((step, len(ring)), np.uint32)
    for at in range(0, size, step):
        part = shifts[at : at + step, None]
        y, z = x[: len(part)], t[: len(part)]
        np.add(part, ring, out=y)
        np.right_shift(y, _SHIFT, out=z)
        np.bitwise_xor(y, z, out=y)
        np.multiply(y, _B, out=y)
        np.min(y, axis=1, out=out[at : at + step])
    return out


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each band, different between bands."""
    parts = sig.astype(np.uint64).reshape(bands, rows)
    key = np.arange(1, bands + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15)
    for r in range(rows):
        key = _mix64(key + parts[:, r] * _U(0xD6E8FEB86659FD93) + _U(r))
    return key.view(np.int64)


def _bands(texts: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """(banda, clase): the band keys of each class of equal texts, once for each task that meets it."""
    schema = pa.schema([("banda", pa.int64()), ("clase", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int, int]] = set()
        shingle = Shingler(width)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                if len(seen) > 1_000_000:
                    seen.clear()
                new = {r[:3]: r[3] for r in zip(*(c.to_pylist() for c in part.columns)) if r[:3] not in seen}
                seen.update(new)
                keys, classes = [np.empty(0, np.int64)], []
                for (c, _, _), s in zip(new, shingle.runs(list(new.values()))):
                    if len(s):
                        keys.append(band_keys(signature(s, bands * rows), bands, rows))
                        classes.append(c)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.repeat(np.array(classes, np.int64), bands))], schema=schema)

    return texts.select("clase", "doble.h", "doble.n", "t").mapInArrow(run, "banda long, clase long")


def _verify(pairs: DataFrame, width: int, threshold: float) -> DataFrame:
    """Pairs (a, b, ta, tb) whose texts are similar enough."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("similitud", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(width)
        memo: dict[int, np.ndarray] = {}

        def of(i: int, text: str) -> np.ndarray:
            if i not in memo:
                if len(memo) > 20_000:
                    memo.clear()
                memo[i] = shingle(text)
            return memo[i]

        for batch in batches:
            keep: tuple[list, list, list] = ([], [], [])
            for a, b, ta, tb in zip(*(c.to_pylist() for c in batch.columns)):
                x, y = of(a, ta), of(b, tb)
                both = len(np.intersect1d(x, y, assume_unique=True)) if threshold * max(len(x), len(y)) <= min(len(x), len(y)) else 0
                any_ = len(x) + len(y) - both
                if both and both >= threshold * any_ - 1e-9:
                    for col, v in zip(keep, (a, b, both / any_)):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(keep, schema)], schema=schema)

    return pairs.mapInArrow(run, "a long, b long, similitud double")


def near_duplicates(df: DataFrame, id_col: str, text_col: str, width: int = 5, threshold: float = 0.8, bands: int = BANDS, rows: int = ROWS) -> tuple[DataFrame, DataFrame]:
    """(members, links): (id, clase_id) of every record with a shingle, and (a, b, similitud) between classes, a < b.

    A class's id is its smallest member; classes are told apart by two hashes of the whole text and its length. Nothing is
    collected, no partner is capped: a crowded band is an ordinary skewed join key, which adaptive execution splits, and
    copies never enter it more than once. Texts that share the first hash only are banded together and verified apart.
    """
    spark = df.sparkSession
    texts = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")).where(F.col("id").isNotNull() & F.col("t").isNotNull())
    enough = r"([\p{L}\p{N}]+[^\p{L}\p{N}]+){%d}[\p{L}\p{N}]" % (width - 1)
    texts = texts.where(F.col("t").rlike(enough)).withColumn("clase", F.xxhash64("t"))
    texts = texts.withColumn("doble", F.struct("clase", F.hash("t").alias("h"), F.length("t").alias("n")))
    firsts = texts.groupBy("id").agg(F.min("doble").alias("doble"))
    reps = firsts.groupBy("doble").agg(F.min("id").alias("clase_id"))
    members = cut_lineage(firsts.join(reps, "doble").select("id", F.col("doble.clase").alias("clase"), "clase_id"))
    reps = members.where("id = clase_id").select("clase", "clase_id")
    banded = _bands(texts, width, bands, rows)
    # the self-join reads both sides: (8 + 8 bytes) for each band of each class, twice
    with shuffles_of(spark, 2.0 * 16 * bands * reps.count()):
        pairs = banded.select("banda", F.col("clase").alias("x")).join(banded.select("banda", F.col("clase").alias("y")), "banda")
        pairs = pairs.where("x < y").select("x", "y").distinct()
        ends = reps.select(F.col("clase").alias("x"), F.col("clase_id").alias("p"))
        pairs = pairs.join(ends, "x").join(ends.select(F.col("x").alias("y"), F.col("p").alias("q")), "y")
        pairs = cut_lineage(pairs.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")))
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    needed = texts.join(wanted, "id", "left_semi").groupBy("id").agg(F.min_by("t", "doble").alias("t"))
    left = needed.select(F.col("id").alias("a"), F.col("t").alias("ta"))
    right = needed.select(F.col("id").alias("b"), F.col("t").alias("tb"))
    # at most every text stands at both ends, and travels with each of its pairs
    with shuffles_of(spark, 4.0 * input_bytes(df)):
        links = cut_lineage(_verify(pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb"), width, threshold))
    return members.select("id", "clase_id"), links


def expand(members: DataFrame, links: DataFrame) -> DataFrame:
    """Every pair (a, b), a < b, of linked or equal records."""
    m1 = members.select(F.col("id").alias("x"), F.col("clase_id").alias("cx"))
    m2 = members.select(F.col("id").alias("y"), F.col("clase_id").alias("cy"))
    across = links.select("a", "b").join(m1, F.col("a") == F.col("cx")).join(m2, F.col("b") == F.col("cy"))
    crowded = members.groupBy("clase_id").count().where("count > 1").select(F.col("clase_id").alias("c"))
    within = m1.join(crowded, F.col("cx") == F.col("c"), "left_semi").join(m2, F.col("cx") == F.col("cy")).where("x < y")
    both = across.select("x", "y").unionByName(within.select("x", "y"))
    return both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def found(pasajes: DataFrame) -> DataFrame:
    """Pairs of passages whose three-word shingles are at least 0.60 alike."""
    members, links = near_duplicates(pasajes, "pasaje_id", "texto", width=3, threshold=0.60)
    return expand(members, links).select(F.col("a").alias("pasaje_id_a"), F.col("b").alias("pasaje_id_b"))


def components(members: DataFrame, links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(id, grupo): the smallest id that links reach, for every record; labels spread and jump until none changes."""
    nodes = members.select(F.col("clase_id").alias("n")).distinct()
    both_ways = F.explode(F.array(F.struct(F.col("a").alias("n"), F.col("b").alias("m")), F.struct(F.col("b").alias("n"), F.col("a").alias("m"))))
    edges = cut_lineage(links.select(both_ways.alias("e")).select("e.n", "e.m").distinct())
    label = cut_lineage(nodes.join(edges.select("n").distinct(), "n", "left_semi").select("n", F.col("n").alias("g")))
    for _ in range(most_rounds):
        near = edges.join(label.select(F.col("n").alias("m"), F.col("g").alias("h")), "m").groupBy("n").agg(F.min("h").alias("h"))
        step = label.join(near, "n").select("n", F.least("g", "h").alias("h"), "g")
        jump = step.select(F.col("n").alias("h"), F.col("h").alias("j"))
        new = cut_lineage(step.join(jump, "h", "left").select("n", F.least("h", F.coalesce("j", "h")).alias("h"), "g"))
        moved = new.where("h < g").limit(1).count()
        label = new.select("n", F.col("h").alias("g"))
        if not moved:
            break
    else:
        raise RuntimeError(f"labels still move after {most_rounds} rounds")
    grouped = members.join(label, F.col("clase_id") == F.col("n"), "left")
    return grouped.select("id", F.coalesce("g", "clase_id").alias("grupo"))


def groups(pasajes: DataFrame) -> DataFrame:
    """(pasaje_id, doc_id, grupo, enlaces): group of every passage, and its number of links to other texts."""
    members, links = near_duplicates(pasajes, "pasaje_id", "texto", width=3, threshold=0.60)
    degree = links.select(F.explode(F.array("a", "b")).alias("clase_id")).groupBy("clase_id").agg(F.count("*").cast("int").alias("enlaces"))
    docs = pasajes.where("pasaje_id is not null").groupBy(F.col("pasaje_id").alias("id")).agg(F.min(F.substring_index("id", "/", 1)).alias("doc_id"))
    out = components(members, links).join(members, "id").join(degree, "clase_id", "left").join(docs, "id", "left")
    return out.select(F.col("id").alias("pasaje_id"), "doc_id", "grupo", F.coalesce("enlaces", F.lit(0)).alias("enlaces"))
