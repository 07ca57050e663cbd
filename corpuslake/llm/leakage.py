"""Evaluation texts leaking into training text (problem 9).

Method: pigeonhole edit matching. The unit of a leak is a window of ``MIN_WORDS`` consecutive words of a test item.
With a budget of k edits a window is cut into k + 1 pieces; a text within the budget holds at least one of them
exactly. Exact piece hits are found by hashes of word runs over the whole text, and each is verified with Myers'
bit-parallel edit distance. A leak within zero edits is then measured: how many consecutive words are the item's own.

Test items are sent to every task in blocks of ``ITEM_BLOCK`` rows, whatever their number; texts are read once a block.

Defined results
    * null or blank texts, null fields, and fields under ``MIN_WORDS`` words: nothing; empty tables: no rows.
    * words are runs of letters or digits after lower-casing and removing accents; punctuation and line ends don't count.
    * repeated documents and items: one row for each pair of ids; ties between alignments go to the first in the text.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import fold

MIN_WORDS = 13
BUDGET = 1
ITEM_BLOCK = 5000
_WORD = re.compile(r"[^\W_]+")
_U = np.uint64


def words(text: str) -> list[str]:
    return _WORD.findall(fold(text))


def myers(pattern: str, text: str, most: int) -> int:
    """Least edit distance of ``pattern`` to any substring of ``text``, or ``most + 1`` if it is greater."""
    m = len(pattern)
    if not m:
        return 0
    peq: dict[str, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << i
    full, high = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, least = full, 0, m, m
    for c in text:
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | (full & ~(xh | pv)), pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph, mh = (ph << 1) & full, (mh << 1) & full
        pv, mv = mh | (full & ~(xv | ph)), ph & xv
        least = min(least, score)
    return min(least, most + 1)


class Index:
    """The pieces of all windows of some test items."""

    def __init__(self, items: list[tuple[int, str, str]], min_words: int = MIN_WORDS, budget: int = BUDGET) -> None:
        self.min_words, self.budget = min_words, budget
        bounds = [round(k * min_words / (budget + 1)) for k in range(budget + 2)]
        self.pieces = list(zip(bounds, bounds[1:]))
        self.ids: dict[str, int] = {}
        self.entries: list[tuple[int, str, list[str], list[int]]] = []
        self.hits: dict[int, dict[int, list[tuple[int, int]]]] = {}
        for item, field, text in items:
            ws = words(text)
            if len(ws) >= min_words:
                self.entries.append((item, field, ws, [self.ids.setdefault(w, len(self.ids) + 1) for w in ws]))
        for length in sorted({b - a for a, b in self.pieces}):
            table: dict[int, list[tuple[int, int]]] = defaultdict(list)
            for e, (_, _, _, nums) in enumerate(self.entries):
                keys = self._runs(np.array(nums, np.uint64), length)
                for a, b in self.pieces:
                    if b - a == length:
                        for start in range(a, len(nums) - min_words + a + 1):
                            if not table[int(keys[start])] or table[int(keys[start])][-1] != (e, start):
                                table[int(keys[start])].append((e, start))
            self.hits[length] = dict(table)
        self.sorted = {n: np.sort(np.fromiter(t, np.uint64, len(t))) for n, t in self.hits.items()}

    @staticmethod
    def _runs(nums: np.ndarray, length: int) -> np.ndarray:
        n = max(0, len(nums) - length + 1)
        key = np.zeros(n, np.uint64)
        for k in range(length):
            key = (key ^ nums[k : k + n]) * _U(0x9E3779B97F4A7C15)
            key ^= key >> _U(29)
        return key

    def search(self, text: str) -> list[tuple[int, str, int, int, int]]:
        """(item, field, longest run of its own words, edit distance of a window, word position) of each leaked field."""
        ws = words(text)
        if len(ws) < self.min_words - self.budget:
            return []
        get = self.ids.get
        nums = np.array([get(w, 0) for w in ws], np.uint64)
        known = nums > 0
        at: list[tuple[int, int, int]] = []
        for length, table in self.hits.items():
            if len(nums) < length or not len(table):
                continue
            run = np.convolve(known, np.ones(length, int), "valid") == length
            where = np.flatnonzero(run)
            if not len(where):
                continue
            keys = self._runs(nums, length)[where]
            spot = np.searchsorted(self.sorted[length], keys)
            spot[spot == len(self.sorted[length])] = 0
            ok = self.sorted[length][spot] == keys
            for p, key in zip(where[ok].tolist(), keys[ok].tolist()):
                at += [(p, e, start) for e, start in table[key]]
        best: dict[int, tuple[int, int, int]] = {}
        seen: set[tuple[int, int, int]] = set()
        vals = nums.tolist()
        at.sort()
        for p, e, start in at:
            item, field, iws, own = self.entries[e]
            if e in best and best[e][1] == 0 and best[e][0] >= len(own):
                continue
            lo_p, lo_s = p, start
            while lo_p and lo_s and vals[lo_p - 1] == own[lo_s - 1]:
                lo_p, lo_s = lo_p - 1, lo_s - 1
            if (e, lo_p, lo_s) in seen:
                continue
            seen.add((e, lo_p, lo_s))
            n = 0
            while lo_p + n < len(vals) and lo_s + n < len(own) and vals[lo_p + n] == own[lo_s + n]:
                n += 1
            if n >= self.min_words:
                window = " ".join(iws[lo_s : lo_s + self.min_words])
                if myers(window, " ".join(ws[lo_p : lo_p + self.min_words]), self.budget) == 0 and (e not in best or best[e][1] > 0 or n > best[e][0]):
                    best[e] = (n, 0, lo_p)
            elif self.budget and e not in best:
                got = self._near(e, lo_p, lo_s, n, ws, vals)
                if got is not None:
                    best[e] = (n, got, lo_p)
        return [(self.entries[e][0], self.entries[e][1], n, d, p) for e, (n, d, p) in sorted(best.items())]

    def _near(self, e: int, p: int, s: int, n: int, ws: list[str], vals: list[int]) -> int | None:
        """Least distance, within the budget, of a window that holds the run of ``n`` words at ``s``; None if none is."""
        _, _, iws, own = self.entries[e]
        k, size = self.budget, self.min_words
        if k == 1:
            # one edit spoils a word, parts it or joins two; beyond it the words must go on to the window's end
            for i, j in ((1, 1), (1, 2), (2, 1)):
                a, b, m = s + n + i, p + n + j, n + i
                while m < size and a < len(own) and b < len(vals) and own[a] == vals[b]:
                    a, b, m = a + 1, b + 1, m + 1
                if m >= size and s + size <= len(own):
                    got = myers(" ".join(iws[s : s + size]), " ".join(ws[p : p + size + 1]), k)
                    if got <= k:
                        return got
                a, b, m = s - 1 - i, p - 1 - j, n + i
                while m < size and a >= 0 and b >= 0 and own[a] == vals[b]:
                    a, b, m = a - 1, b - 1, m + 1
                if m >= size and s + n >= size:
                    got = myers(" ".join(iws[s + n - size : s + n]), " ".join(ws[max(0, p + n - size - 1) : p + n]), k)
                    if got <= k:
                        return got
            return None
        for start in range(max(0, s + n - self.min_words), min(s, len(iws) - self.min_words) + 1):
            window = iws[start : start + self.min_words]
            lo = max(0, p - (s - start) - k)
            near = ws[lo : p - (s - start) + self.min_words + k]
            have = set(near)
            if sum(w in have for w in window) < self.min_words - 2 * k:
                continue
            got = myers(" ".join(window), " ".join(near), k)
            if got <= k:
                return got
        return None


def leaks(documents: DataFrame, preguntas: DataFrame, min_words: int = MIN_WORDS, budget: int = BUDGET, block: int = ITEM_BLOCK) -> DataFrame:
    """(doc_id, item_id, campo, palabras, distancia, posicion) of each leaked field of each item."""
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("campo", pa.string()), ("palabras", pa.int32()), ("distancia", pa.int32()), ("posicion", pa.int32())])
    ddl = "doc_id long, item_id long, campo string, palabras int, distancia int, posicion int"
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    items = preguntas.where("id is not null").select(F.col("id").cast("long").alias("id"), "pregunta", "respuesta_esperada")
    blocks = max(1, -(-items.count() // block))
    out = None
    for k in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == k).collect()
        fields = sorted({(r.id, f, r[f]) for r in rows for f in ("pregunta", "respuesta_esperada") if r[f]})

        def run(batches: Iterator[pa.RecordBatch], fields: list = fields) -> Iterator[pa.RecordBatch]:
            index = Index(fields, min_words, budget)
            for batch in batches:
                cols: list[list] = [[] for _ in schema]
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    for hit in index.search(text):
                        for col, v in zip(cols, (doc, *hit)):
                            col.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

        part = docs.mapInArrow(run, ddl)
        out = part if out is None else out.unionByName(part)
    return out


def found(documents: DataFrame, preguntas: DataFrame) -> DataFrame:
    """Documents with at least ``MIN_WORDS`` consecutive words of an item's field."""
    exact = leaks(documents, preguntas).where(F.col("palabras") >= MIN_WORDS)
    return exact.select("doc_id", "item_id").distinct()
