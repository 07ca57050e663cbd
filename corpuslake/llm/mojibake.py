"""Text decoded with the wrong character encoding: find it and restore it (problem 1).

Method: a smoothed character trigram model counts the clean strings of all records; for every token the candidate
encode-decode chains are scored and the likeliest one is accepted if it beats the token as it stands by more than a
margin. The margin is set over all clean tokens, each scored by a model that leaves out its own fold of the records: it
lies above every gain, those of tokens aside that are garbled themselves (see :data:`COMMONER`). :func:`recall` garbles
all clean words on purpose by each chain and gives the share that comes back letter by letter.

Defined results
    * null, broken or text-less ``datos``: no row; an empty table: no rows; repeated rows: each gives the same answer,
      and the model counts them once.
    * every string inside ``datos`` is read, whole, at any depth; very long texts cost time in proportion.
    * a record with U+FFFD, or a question mark where the model wants a letter, is found but not recoverable.
    * ties between chains go to the first one in ``CHAINS``.
"""

from __future__ import annotations

import json
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import input_bytes, shuffles_of
from .base import cut_lineage, map_arrow

#: Characters that a cleanly decoded Spanish record uses.
CLEAN = re.compile(r"[\x20-\x7e\n\t\ráéíóúüñÁÉÍÓÚÜÑ¿¡«»“”‘’–—…·•›ºª°§©×→↑]*")
#: Where a letter is lost to a question mark, one of these stood there.
LOST = "áéíóúñÁÉÍÓÚÑ›«»–üº"
MIN_MARGIN = 6.0
#: Parts of the records; a token is scored by a model of the other parts when the margin is set.
FOLDS = 5
#: Some garbled letters are clean characters too (``podr·``, ``ning·n``). A clean token that a chain turns into words this
#: many times as common is taken as garbled, and sets no margin.
COMMONER = 25
_TOKEN = re.compile(r"[^ \n\t\r]+")
_ODD_TOKEN = re.compile(r"[^ \n\t\r\x00-\x3e\x40-\x7f]*[^\x00-\x3e\x40-\x7f]")
_RUN = re.compile(r"[^\x00-\x7f]+")
_WORD = re.compile(r"[^\W\d_]+")


def _table(codec: str) -> dict[str, int]:
    """Character to byte of a one-byte code; bytes that cp1252 leaves open are the control characters, as browsers do."""
    out: dict[str, int] = {}
    for b in range(128, 256):
        try:
            out[bytes([b]).decode(codec)] = b
        except UnicodeDecodeError:
            pass
    if codec == "cp1252":
        for b in range(128, 256):
            out.setdefault(chr(b), b)
    return out


_WRONG = ("cp1252", "mac_roman", "cp437", "cp850", "cp1251", "cp1250", "cp1253", "cp1254", "cp866", "koi8_r", "iso8859_15")
_ONE_BYTE = tuple(("cp1252", w) for w in _WRONG if w not in ("cp1252", "cp1254", "iso8859_15")) + tuple(
    (t, "cp1252") for t in ("mac_roman", "cp437", "cp850")
)
#: (encoding the text was written in, encoding it was read with).
CHAINS = tuple(("utf-8", w) for w in _WRONG) + _ONE_BYTE
_TABLES = {w: _table(w) for w in _WRONG}


def _undo_run(run: str, true: str, wrong: str) -> str:
    """Undo one chain over a run of non-ASCII characters; what can't have come out of the chain stays as it is."""
    table = _TABLES[wrong]
    codes = [table.get(c, -1) for c in run]
    out, i, n = [], 0, len(run)
    while i < n:
        b = codes[i]
        if b < 0:
            out.append(run[i])
            i += 1
        elif true != "utf-8":
            try:
                out.append(bytes([b]).decode(true))
            except UnicodeDecodeError:
                out.append(run[i])
            i += 1
        else:
            width = 2 if 0xC2 <= b < 0xE0 else 3 if 0xE0 <= b < 0xF0 else 4 if 0xF0 <= b < 0xF5 else 0
            part = codes[i : i + width]
            try:
                if not width or len(part) < width or min(part) < 0:
                    raise UnicodeDecodeError("utf-8", b"", 0, 0, "")
                out.append(bytes(part).decode("utf-8"))
                i += width
            except UnicodeDecodeError:
                out.append(run[i])
                i += 1
    return "".join(out)


def undo(token: str, true: str, wrong: str) -> str:
    return _RUN.sub(lambda m: _undo_run(m.group(), true, wrong), token)


def strings_of(value: object, path: str = "") -> Iterator[tuple[str, str]]:
    """(path, string) of every string value of parsed JSON."""
    if isinstance(value, str):
        yield path, value
    elif isinstance(value, dict):
        for k, v in value.items():
            yield from strings_of(v, f"{path}.{k}" if path else str(k))
    elif isinstance(value, list):
        for i, v in enumerate(value):
            yield from strings_of(v, f"{path}[{i}]")


class Model:
    """Character trigrams of lower-cased, space-padded tokens, interpolated down to a uniform floor."""

    WEIGHTS = (0.9, 0.09, 0.009)
    FLOOR = 1e-8

    def __init__(self) -> None:
        self.c3: dict[str, int] = {}
        self.c2: dict[str, int] = {}
        self.h2: dict[str, int] = {}
        self.h1: dict[str, int] = {}
        self.c1: dict[str, int] = {}
        self.n = 0
        self.margin = MIN_MARGIN
        self.recall = math.nan  # of garbled tokens of other folds, at the margin; nan if not measured
        self._memo: dict[str, tuple[str, str, float]] = {}

    @staticmethod
    def _pad(token: str) -> str:
        return f"  {token.lower()} "

    def train(self, c3: Mapping[str, int]) -> Model:
        """Counts of trigrams, which hold those of all shorter runs."""
        c2, h2, h1, c1 = Counter(), Counter(), Counter(), Counter()
        for t, k in c3.items():
            h2[t[:2]] += k
            c2[t[1:]] += k
            h1[t[1]] += k
            c1[t[2]] += k
        self.c3, self.c2, self.h2, self.h1, self.c1, self.n = dict(c3), dict(c2), dict(h2), dict(h1), dict(c1), sum(c1.values())
        return self

    def score(self, token: str) -> float:
        s, total = self._pad(token), 0.0
        for i in range(2, len(s)):
            a, b = s[i - 2 : i], s[i - 1]
            p = self.FLOOR
            if self.n:
                p += self.WEIGHTS[2] * self.c1.get(s[i], 0) / self.n
                p += self.WEIGHTS[1] * self.c2.get(b + s[i], 0) / max(1, self.h1.get(b, 0))
                p += self.WEIGHTS[0] * self.c3.get(a + s[i], 0) / max(1, self.h2.get(a, 0))
            total += math.log(p)
        return total

    def supported(self, token: str, changed: set[int]) -> bool:
        """Every trigram over a changed position was seen in clean text."""
        s = self._pad(token)
        return all(s[i - 2 : i + 1] in self.c3 for at in changed for i in range(at + 2, min(at + 5, len(s))))

    def candidates(self, token: str) -> Iterator[tuple[str, str]]:
        seen = {token}
        for true, wrong in CHAINS:
            once = undo(token, true, wrong)
            if once in seen:
                continue
            seen.add(once)
            yield once, f"{true}>{wrong}"
            if true == "utf-8":
                for true2, wrong2 in CHAINS:
                    twice = undo(once, true2, wrong2)
                    if twice not in seen:
                        seen.add(twice)
                        yield twice, f"{true2}>{wrong2}>{true}>{wrong}"

    def judge(self, token: str) -> tuple[str, str, float]:
        """(likeliest original, chain or '' for none, gain in nats)."""
        if token in self._memo:
            return self._memo[token]
        out = (token, "", 0.0)
        if "�" in token:
            out = (token, "lost", math.inf)
        else:
            base = self.score(token)
            for fixed, chain in self.candidates(token) if _RUN.search(token) else ():
                if "�" in fixed:
                    out = (fixed, "lost", math.inf)
                    break
                gain = self.score(fixed) - base
                if gain > max(self.margin, out[2]) and self.supported(fixed, _changed(token, fixed)):
                    out = (fixed, chain, gain)
            if "?" in token and not out[1]:
                fixed, gain = self._fill(token, base)
                if gain > self.margin:
                    out = (token, "lost", gain)
        if len(self._memo) > 500_000:
            self._memo.clear()
        self._memo[token] = out
        return out

    def _fill(self, token: str, base: float) -> tuple[str, float]:
        """Put the likeliest letter for each question mark, from the left."""
        fixed, changed = token, {i for i, c in enumerate(token) if c == "?"}
        for i in sorted(changed):
            fixed = max((fixed[:i] + c + fixed[i + 1 :] for c in LOST), key=self.score)
        return (fixed, self.score(fixed) - base) if self.supported(fixed, changed) else (token, 0.0)

    def repair(self, text: str) -> tuple[str, set[str]]:
        """The text with every accepted chain undone, and the chains."""
        chains: set[str] = set()
        asked = 0  # questions that are open

        def one(m: re.Match) -> str:
            nonlocal asked
            token = m.group()
            if token.isascii() and "?" not in token:
                return token
            asked += token.count("¿")
            if asked and token[-1] == "?" or asked and "?" in token[-3:] and not token[-1].isalnum():
                asked -= 1
                if token == "?":
                    return token
            fixed, chain, _ = self.judge(token)
            if chain:
                chains.add(chain)
                return fixed
            return token

        if text.isascii() and "?" not in text:
            return text, chains
        return _TOKEN.sub(one, text), chains


def _changed(a: str, b: str) -> set[int]:
    """Positions in ``b`` that differ from ``a``, with runs compared in turn."""
    out: set[int] = set()
    left = right = 0
    runs = list(_RUN.finditer(a))
    for k, m in enumerate(runs):
        plain = m.start() - left
        right += plain
        tail = len(a) - m.end() if k == len(runs) - 1 else None
        if tail is not None:
            end = len(b) - tail
        else:
            follow = a[m.end() : runs[k + 1].start()]
            end = b.find(follow, right)
            end = right if end < 0 else end
        if b[right:end] != m.group():
            out |= set(range(right, end)) - {right + i for i, c in enumerate(m.group()) if right + i < end and b[right + i] == c and end - right == len(m.group())}
        left, right = m.end(), end
    return out


def clean_tokens(records: Iterable[str]) -> dict[int, Counter]:
    """Tokens of the clean strings of JSON records, by the fold that a record's letters put it into."""
    out: dict[int, Counter] = {}
    for raw in records:
        try:
            texts = [s for _, s in strings_of(json.loads(raw))]
        except ValueError:
            continue
        own = out.setdefault(zlib.crc32(raw.encode("utf-8", "surrogatepass")) % FOLDS, Counter())
        for s in texts:
            if CLEAN.fullmatch(s) and s.count("?") <= s.count("¿"):
                own.update(_TOKEN.findall(s))
    return out


def trigrams(tokens: Mapping[str, int]) -> Counter:
    out: Counter = Counter()
    for token, k in tokens.items():
        s = Model._pad(token)
        for i in range(2, len(s)):
            out[s[i - 2 : i + 1]] += k
    return out


def odd_words(tokens: Mapping[str, int]) -> Counter:
    """Lower-cased words with a letter beyond ASCII."""
    out: Counter = Counter()
    for token, k in tokens.items():
        for w in _WORD.findall(token):
            if not w.isascii():
                out[w.lower()] += k
    return out


def fold_models(c3: Mapping[int, Mapping[str, int]]) -> tuple[Model, list[Model]]:
    """The model of all folds, and for each fold the model of the others, from trigrams by fold."""
    total: Counter = Counter()
    for own in c3.values():
        total.update(own)
    others = ({t: k - own.get(t, 0) for t, k in total.items() if k > own.get(t, 0)} for own in (c3.get(f, {}) for f in range(FOLDS)))
    return Model().train(total), [Model().train(c) for c in others]


def high_gains(model: Model, token: str) -> Iterator[tuple[str, str, float]]:
    """(fixed, changed word or '' where none stands, gain) of the chains that could raise the margin, for each changed word."""
    if token.isascii() or not model.c3:
        return
    base = model.score(token)
    for fixed, _ in model.candidates(token):
        changed = _changed(token, fixed)
        if model.supported(fixed, changed) and (gain := model.score(fixed) - base) > MIN_MARGIN - 1.0:
            words = [(m.start(), m.end(), m.group().lower()) for m in _WORD.finditer(fixed)]
            for word in {next((w for a, b, w in words if a <= at < b), "") for at in changed} or {""}:
                yield fixed, word, gain


def _margin(worst: float) -> float:
    return max(MIN_MARGIN, worst + 1.0)


def fit(values: Iterable[str]) -> Model:
    """A model from JSON records: what :func:`fit_model` does for a table."""
    folds = clean_tokens(values)
    model, others = fold_models({f: trigrams(own) for f, own in folds.items()})
    total: Counter = Counter()
    for own in folds.values():
        total.update(own)
    words = odd_words(total)
    found: dict[str, list[tuple[str, str, float]]] = {}
    for f, own in folds.items():
        for token in own:
            if gains := list(high_gains(others[f], token)):
                found.setdefault(token, []).extend(gains)
    worst = 0.0
    for token, gains in found.items():
        least: dict[str, int] = {}
        for fixed, word, _ in gains:
            least[fixed] = min(words[word], least.get(fixed, words[word]))
        if max(least.values()) < COMMONER * total[token]:
            worst = max(worst, *(g for *_, g in gains))
    model.margin = _margin(worst)
    right = tried = 0
    for f, own in folds.items():
        others[f].margin = model.margin
        for token in own:
            a, b = _returned(others[f], token)
            right, tried = right + a, tried + b
    model.recall = right / tried if tried else 0.0
    return model


def garble(token: str, true: str, wrong: str) -> str | None:
    """The token written in one encoding and read with another; None where nothing is garbled or a byte has no letter."""
    back = {b: c for c, b in _TABLES[wrong].items()}
    try:
        out = "".join(chr(b) if b < 128 else back[b] for b in token.encode(true))
    except (UnicodeEncodeError, KeyError):
        return None
    return out if out != token else None


def _returned(model: Model, token: str) -> tuple[int, int]:
    """Of the chains that garble a word: how many are undone letter by letter, and how many there are."""
    if token.isascii() or not token.isalpha():
        return 0, 0
    bad = [b for true, wrong in CHAINS if (b := garble(token, true, wrong))]
    return sum(model.judge(b)[0] == token for b in bad), len(bad)


def count_clean(chunks: DataFrame) -> DataFrame:
    """(clase, s, f, n) over the clean strings of all records: how often each trigram and each token beyond ASCII stands in
    fold ``f``, and each word beyond ASCII (``f`` 0). A record that is sent again counts once."""

    def run(cols: list[list]) -> list[list]:
        out: list[list] = [[], [], [], []]
        for f, own in clean_tokens(cols[0]).items():
            odd = {t: n for t, n in own.items() if not t.isascii()}
            for kind, fold, counts in (("trigrama", f, trigrams(own)), ("token", f, odd), ("palabra", 0, odd_words(odd))):
                for col, v in zip(out, ([kind] * len(counts), counts, [fold] * len(counts), counts.values())):
                    col.extend(v)
        return out

    rows = chunks.select("chunk_id", "datos").where(F.col("datos").isNotNull() & F.col("chunk_id").isNotNull()).distinct()
    counted = map_arrow(rows.select("datos"), "clase string, s string, f int, n long", run)
    with shuffles_of(chunks.sparkSession, input_bytes(rows)):
        return cut_lineage(counted.groupBy("clase", "s", "f").agg(F.sum("n").cast("long").alias("n")))


def _models(counted: DataFrame) -> tuple[Model, list[Model]]:
    """:func:`fold_models`; the characters of ``CLEAN`` make a million trigrams at most, which bounds what comes here."""
    c3: dict[int, dict[str, int]] = {}
    for r in counted.where("clase = 'trigrama'").collect():
        c3.setdefault(r.f, {})[r.s] = r.n
    return fold_models(c3)


def _worst_gain(counted: DataFrame, others: list[Model]) -> float:
    """The highest gain on a clean token that is not itself garbled; 0 for none."""

    def run(cols: list[list]) -> list[list]:
        out: list[list] = [[], [], [], []]
        for token, f in zip(*cols):
            for found in high_gains(others[f], token):
                for col, v in zip(out, (token, *found)):
                    col.append(v)
        return out

    tokens = counted.where("clase = 'token'")
    gains = map_arrow(tokens.select("s", "f"), "s string, fija string, palabra string, ganancia double", run)
    total = tokens.groupBy("s").agg(F.sum("n").alias("total"))
    words = counted.where("clase = 'palabra'").select(F.col("s").alias("palabra"), F.col("n").alias("veces"))
    fixes = gains.join(words, "palabra", "left").groupBy("s", "fija").agg(F.max("ganancia").alias("ganancia"), F.min(F.coalesce("veces", F.lit(0))).alias("veces"))
    by_token = fixes.groupBy("s").agg(F.max("ganancia").alias("ganancia"), F.max("veces").alias("veces"))
    return by_token.join(total, "s").where(F.col("veces") < COMMONER * F.col("total")).agg(F.max("ganancia")).first()[0] or 0.0


def fit_model(chunks: DataFrame) -> Model:
    """Trigrams are counted and the margin is set over the clean strings of all records."""
    counted = count_clean(chunks)
    model, others = _models(counted)
    model.margin = _margin(_worst_gain(counted, others))
    return model


def recall(chunks: DataFrame) -> float:
    """Of all clean words beyond ASCII, garbled by every chain: the share that a model of the other folds restores at the
    margin. Costs many times what :func:`fit_model` does, and settles no row: no query runs it."""
    counted = count_clean(chunks)
    margin = _margin(_worst_gain(counted, others := _models(counted)[1]))
    for m in others:
        m.margin = margin

    def run(cols: list[list]) -> list[list]:
        return [list(c) for c in zip(*(_returned(others[f], token) for token, f in zip(*cols)))] or [[], []]

    got = map_arrow(counted.where("clase = 'token'").select("s", "f").repartition(64), "bien long, todas long", run).agg(F.sum("bien"), F.sum("todas")).first()
    return got[0] / got[1] if got[1] else 0.0


def repair_chunks(chunks: DataFrame, model: Model | None = None) -> DataFrame:
    """(chunk_id, campo, reparado, cadenas, recuperable): one row for each garbled string value of a record."""
    model = model or fit_model(chunks)

    def run(cols: list[list]) -> list[list]:
        out: list[list] = [[], [], [], [], []]
        for key, raw in zip(*cols):
            try:
                data = json.loads(raw)
            except ValueError:
                continue
            for path, text in strings_of(data):
                fixed, chains = model.repair(text)
                if chains:
                    for col, v in zip(out, (key, path, fixed, sorted(chains), "lost" not in chains)):
                        col.append(v)
        return out

    rows = chunks.select("chunk_id", "datos").where(F.col("datos").isNotNull() & F.col("chunk_id").isNotNull())
    return map_arrow(rows, "chunk_id string, campo string, reparado string, cadenas array<string>, recuperable boolean", run)


def found(chunks: DataFrame) -> DataFrame:
    return repair_chunks(chunks).select("chunk_id").distinct()
