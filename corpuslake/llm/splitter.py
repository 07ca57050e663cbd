"""Splitting oversized items at natural boundaries (problem 3).

Method: agglomerative merging. A text starts as atomic segments (sentences, and where one is too long its clauses, its
words, its characters); adjacent pairs wait in a heap, and the weakest boundary is merged first while the combined size
plus the overlap fits the limit. Every piece but the first repeats the end of the text before it.

Defined results
    * null texts, null kinds and kinds without a limit are not split; an empty table: no rows.
    * repeated rows count once (of several texts of an id, one of the oversized ones is split whole); a text at the limit
      is not oversized; an overlap that leaves no room for a new character is cut to the limit less one.
    * ties in the heap: the smaller combined size, then the leftmost pair. Pieces without their overlap make up the
      text again, character by character.
"""

from __future__ import annotations

import heapq
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import chunk_texts, map_arrow

#: Boundaries from weak to strong; the strength of a cut after the match.
_LEVELS = (
    (5, re.compile(r"\n[ \t]*\n+")),
    (4, re.compile(r"\n+")),
    (3, re.compile(r"(?<=[.!?])[\"»”)\]]*\s+(?=[^a-záéíóúñ])")),
    (2, re.compile(r"(?<=[;:])\s+")),
    (1, re.compile(r"(?<=,)\s+")),
    (0, re.compile(r"\s+")),
)
_HARD = -1
_HEADING = 0.5
#: Most rows of ``limites`` that are sent to every task.
LIMIT_ROWS = 10_000


def segments(text: str, limit: int) -> list[tuple[int, int, float]]:
    """Atomic segments as (start, end, strength of the boundary at the end), none longer than ``limit``."""
    todo, done = [(0, len(text), 9.0, 0)], []
    while todo:
        start, end, strength, level = todo.pop()
        if level >= 3 and end - start <= limit:
            done.append((start, end, strength))
            continue
        if level == len(_LEVELS):
            cuts = list(range(start + limit, end, limit))
            parts = list(zip([start, *cuts], [*cuts, end]))
            done += [(a, b, float(_HARD) if b < end else strength) for a, b in parts]
            continue
        value, pattern = _LEVELS[level]
        cuts = [m.end() for m in pattern.finditer(text, start, end) if start < m.end() < end]
        for a, b in zip([start, *cuts], [*cuts, end]):
            todo.append((a, b, float(value) if b < end else strength, level + 1))
    done.sort()
    return done


def split(text: str, limit: int, overlap: int = 0) -> list[tuple[int, int, int]]:
    """Pieces as (start of the overlap, start, end) in order; ``end - start of the overlap`` never exceeds ``limit``."""
    limit = max(1, limit)
    overlap = max(0, min(overlap, limit - 1))
    if len(text) <= limit:
        return [(0, 0, len(text))]
    room = limit - overlap
    segs = segments(text, room)
    start = [s for s, _, _ in segs]
    end = [e for _, e, _ in segs]
    power = [p for _, _, p in segs]
    if len(segs) > 1 and "\n" in text[: end[0]]:
        power[0] = _HEADING  # a heading stays with what it heads
    left, right = list(range(-1, len(segs) - 1)), list(range(1, len(segs) + 1))
    alive = [True] * len(segs)
    heap = [(power[i], end[i + 1] - start[i], i, end[i], end[i + 1]) for i in range(len(segs) - 1)]
    heapq.heapify(heap)
    while heap:
        _, size, i, mid, stop = heapq.heappop(heap)
        j = right[i]
        if not alive[i] or j >= len(segs) or end[i] != mid or end[j] != stop:
            continue
        if size > (limit if i == 0 else room):
            continue
        end[i], power[i], right[i] = end[j], power[j], right[j]
        alive[j] = False
        if right[i] < len(segs):
            left[right[i]] = i
            heapq.heappush(heap, (power[i], end[right[i]] - start[i], i, end[i], end[right[i]]))
        if left[i] >= 0:
            k = left[i]
            heapq.heappush(heap, (power[k], end[i] - start[k], k, end[k], end[i]))
    return [(max(0, start[i] - overlap) if start[i] else 0, start[i], end[i]) for i in range(len(segs)) if alive[i]]


def with_limits(chunks: DataFrame, limites: DataFrame) -> DataFrame:
    """Oversized rows with their limit; the limits are broadcast only while there are few of them."""
    limits = limites.where("tipo_chunk is not null and max_chars is not null").groupBy("tipo_chunk").agg(F.min("max_chars").alias("max_chars"), F.min(F.coalesce("traslape_chars", F.lit(0))).alias("traslape_chars"))
    few = len(limites.select("tipo_chunk").take(LIMIT_ROWS + 1)) <= LIMIT_ROWS
    joined = chunk_texts(chunks).join(F.broadcast(limits) if few else limits, "tipo_chunk")
    return joined.where(F.length("texto") > F.col("max_chars"))


def pieces(chunks: DataFrame, limites: DataFrame, once: bool = False) -> DataFrame:
    """(chunk_id, articulo_id, tipo_chunk, parte, n_partes, inicio, fin, traslape, texto) of every oversized chunk; with
    ``once``, rows sent again are dropped before they are split, when only the oversized ones travel."""

    def run(cols: list[list]) -> list[list]:
        out: list[list] = [[] for _ in range(9)]
        for kind, key, article, text, limit, overlap in zip(*cols):
            parts = split(text, limit, overlap)
            for k, (a, s, e) in enumerate(parts, 1):
                for col, v in zip(out, (key, article, kind, k, len(parts), s, e, s - a, text[a:e])):
                    col.append(v)
        return out

    rows = with_limits(chunks, limites).select("tipo_chunk", "chunk_id", "articulo_id", "texto", "max_chars", "traslape_chars").where("chunk_id is not null")
    rows = rows.dropDuplicates(["chunk_id"]) if once else rows
    schema = "chunk_id string, articulo_id string, tipo_chunk string, parte int, n_partes int, inicio int, fin int, traslape int, texto string"
    return map_arrow(rows, schema, run)


def distinct_pieces(chunks: DataFrame, limites: DataFrame) -> DataFrame:
    return pieces(chunks, limites, once=True)


def rebuilt(chunks: DataFrame, limites: DataFrame) -> DataFrame:
    """(chunk_id, letras, huella, bajo_limite): each split text put together again from its pieces, and whether all of them
    keep the limit of its kind."""
    own = F.expr("substring(texto, traslape + 1)")
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("parte", own.alias("x")))), lambda p: p["x"]), "")
    limits = limites.groupBy("tipo_chunk").agg(F.min("max_chars").alias("max_chars"))
    got = distinct_pieces(chunks, limites).join(limits, "tipo_chunk")  # as small as with_limits found it
    got = got.groupBy("chunk_id").agg(whole.alias("t"), F.max(F.length("texto") > F.col("max_chars")).alias("over"))
    return got.select("chunk_id", F.length("t").alias("letras"), F.md5("t").alias("huella"), (~F.col("over")).alias("bajo_limite"))


def found(chunks: DataFrame, limites: DataFrame) -> DataFrame:
    return pieces(chunks, limites).where("parte = 1").select("chunk_id").distinct()
