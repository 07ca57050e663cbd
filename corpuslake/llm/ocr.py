"""Noise in text from scanned pages: find it and rebuild continuous paragraphs (problem 5).

Method: an averaged-perceptron character editor predicts, for each character of a word that the corpus does not know,
keep, replace, delete or insert; a second set of weights predicts join or keep at a line's end mark; a third one takes
running headers, page numbers and speck lines out by their shape and their place on the page (what the lines before
and after say about a sentence running through) and how often they stand in the text. An edit counts only if it ends
in a word of the corpus and scores above keeping every character.

Defined results
    * null, broken or text-less ``datos``: no row; an empty table: no rows; repeated rows: each gives the same answer.
    * the whole text is read; hard line ends alone, compounds with a hyphen and codes of letters and digits are no fault.
    * without enough clean records there is no lexicon, and only page furniture and marks at line ends are judged.
    * the best score wins; ties between edits go to the one that changes less, then to the alphabetically first word.
"""

from __future__ import annotations

import html
import json
import random
import re
from collections import Counter, defaultdict
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import cut_lineage, map_arrow, sample_rows

# What scanning writes for what stood on paper.
CONFUSIONS = (
    ("rn", "m"), ("m", "rn"), ("cl", "d"), ("d", "cl"), ("li", "h"), ("h", "li"), ("e", "c"), ("c", "e"), ("t", "f"), ("f", "t"),
    ("í", "f"), ("u", "ii"), ("ii", "u"), ("o", "0"), ("l", "1"), ("i", "1"), ("g", "9"), ("a", "@"), ("é", "6"), ("ó", "6"),
    ("s", "5"), ("b", "6"), ("z", "2"), ("n", "ri"), ("fi", "ﬁ"), ("fl", "ﬂ"), ("vv", "w"),
)
#: Marks that scanning leaves where a word is broken at a line's end.
MARKS = "-–¬\xad‐"
#: A word of the lexicon stands in this share of the clean records (and in ``MIN_COUNT`` of them), so that the lexicon is
#: alike at every size and has at most a record's words divided by the share.
MIN_SHARE, MIN_COUNT = 5e-4, 3
#: A word this rare may be a misreading of one ``COMMONER`` times as common.
RARE_SHARE, COMMONER = 0.01, 25
#: Operations tried at a character, and how far below KEEP one may score alone.
NEAR, SLACK = 4, 2.0
#: Words damaged outside the pairs, in each of three ways, for each word of the lexicon.
DAMAGED = 2
#: How often a code that clean records hold is shown, with other numbers each time.
CODE_SHOWN = 20
_WORD = re.compile(r"[A-Za-záéíóúüñÁÉÍÓÚÜÑ0-9@ﬁﬂ]+")
_LETTERS = re.compile(r"[A-Za-záéíóúüñÁÉÍÓÚÜÑ]+")
_BREAK = re.compile(rf"([A-Za-záéíóúüñÁÉÍÓÚÜÑﬁﬂ@0-9]+)([{MARKS}])$")
_HEAD = re.compile(r"[A-Za-záéíóúüñÁÉÍÓÚÜÑﬁﬂ@0-9]+")
_TAG = re.compile(r"</?[A-Za-z][^<>]*>|https?://\S+|\\[A-Za-z]+\*?|\\['~`^\"]\{?\\?[A-Za-z]?\}?")
# The shapes that are trusted as page furniture when the line model is trained.
FURNITURE = tuple(
    re.compile(p)
    for p in (
        r"\[?\d{1,4}\]?",
        r"- ?\d{1,4} ?-",
        r"P\S{1,4}g(?:ina|\.)? ?\d+(?: de \d+)?",
        r"Hoja No\. \d+ de \d+",
        r"GACETA DE NORMAS\s+No\. [\d.]+",
        r"Edici\S{1,6}n de \d+ p\S{1,6}ginas\b.*",
        r"(?:\S{1,9} ){5,}\s*\S{1,9}(?:\s+\S{1,9}){3,}",
        r"\d+ \| [^|]+",
        r"Continuaci\S{1,6}n de .+",
    )
)
_SPECK = re.compile(r"(?=[^\w]*[^\w\s][^\w]*$)[^\w]{1,12}")
_MARKUP_LINE = re.compile(r"\|-+|\{\||\|\}|`{3,}|~{3,}|[-*_=]{3,}|\|[-:| ]+\||\$\$|[*•\-+]|[<>]|\\\\|…|\*{3}")


class Perceptron:
    """Averaged multiclass perceptron over sparse features."""

    def __init__(self) -> None:
        self.w: dict[str, dict[str, float]] = {}
        self._sum: dict[tuple[str, str], float] = defaultdict(float)
        self._at: dict[tuple[str, str], int] = defaultdict(int)
        self._t = 0

    def scores(self, feats: Iterable[str]) -> dict[str, float]:
        out: dict[str, float] = defaultdict(float)
        for f in feats:
            for label, v in self.w.get(f, {}).items():
                out[label] += v
        return out

    def _add(self, f: str, label: str, v: float) -> None:
        row = self.w.setdefault(f, {})
        key = (f, label)
        self._sum[key] += (self._t - self._at[key]) * row.get(label, 0.0)
        self._at[key] = self._t
        row[label] = row.get(label, 0.0) + v

    def fit(self, data: list[tuple[list[str], str]], labels: Iterable[str], epochs: int = 4, seed: int = 7, margin: float = 0.0) -> None:
        """``margin``: how far the right label must lead the next one, or the weights move."""
        order, rng, labels = list(range(len(data))), random.Random(seed), sorted(labels)
        for _ in range(epochs):
            rng.shuffle(order)
            for k in order:
                feats, gold = data[k]
                got = self.scores(feats)
                guess = max(labels, key=lambda x: got.get(x, 0.0))
                self._t += 1
                if margin and guess == gold:
                    near = max((x for x in labels if x != gold), key=lambda x: got.get(x, 0.0))
                    guess = near if got.get(gold, 0.0) - got.get(near, 0.0) < margin else gold
                if guess != gold:
                    for f in feats:
                        self._add(f, gold, 1.0)
                        self._add(f, guess, -1.0)
        for f, row in self.w.items():
            for label in list(row):
                key = (f, label)
                total = self._sum[key] + (self._t - self._at[key]) * row[label]
                row[label] = total / max(1, self._t)
        self._sum.clear()
        self._at.clear()


def char_features(s: str, i: int) -> list[str]:
    p = f"^^{s}$$"
    j = i + 2
    return [f"0{p[j]}", f"1{p[j - 1]}{p[j]}", f"2{p[j]}{p[j + 1]}", f"3{p[j - 1 : j + 2]}", f"4{p[j - 2 : j + 1]}", f"5{p[j : j + 3]}"]


def _ops(true: str, seen: str) -> list[str]:
    """Edit operations, one for each character of ``seen``, that turn it into ``true``."""
    if not seen:
        return []
    ops = []
    for k, _ in enumerate(seen):
        if k < len(seen) - 1:
            ops.append(f"R{true[k]}" if k < len(true) else "D")
        else:
            rest = true[k:]
            ops.append("D" if not rest else f"R{rest[0]}" + "".join(f"I{c}" for c in rest[1:]))
    return ops


def apply_op(c: str, op: str) -> str:
    return c if op == "K" else "" if op == "D" else op[1] + "".join(op[3::2])


class Editor:
    """The models of the operator; see :func:`fit`."""

    def __init__(self, words: Counter, codes: Counter | None = None) -> None:
        self.words, self.codes = words, codes or Counter()
        self.chars, self.ends, self.lines = Perceptron(), Perceptron(), Perceptron()
        self._plain: set[str] = set()
        self._memo: dict[str, str | None] = {}
        self._lines: dict[tuple, bool] = {}

    def known(self, word: str) -> bool:
        return word in self.words or word.lower() in self.words

    # -- characters of a word

    def train_chars(self, seed: int = 11) -> None:
        rng, data = random.Random(seed), []
        for word in sorted(self.words):
            if len(word) < 3:
                continue
            data += [(char_features(word, i), "K") for i in range(len(word))]
            spots = [(at.start(), true, seen) for true, seen in CONFUSIONS for at in re.finditer(re.escape(true), word)]
            for start, true, seen in rng.sample(spots, min(8, len(spots))):
                bad = word[:start] + seen + word[start + len(true) :]
                ops = ["K"] * start + _ops(true, seen) + ["K"] * (len(word) - start - len(true))
                data += [(char_features(bad, i), op) for i, op in enumerate(ops)]
            # faults outside the pairs: one letter replaced, put in or lost
            for _ in range(DAMAGED):
                at, c = rng.randrange(1, len(word) - 1), rng.choice("abcdefghijklmnopqrstuvwxyz")
                for bad, ops in (
                    (word[:at] + c + word[at + 1 :], ["K"] * at + [f"R{word[at]}"] + ["K"] * (len(word) - at - 1)),
                    (word[:at] + c + word[at:], ["K"] * at + ["D"] + ["K"] * (len(word) - at)),
                    (word[:at] + word[at + 1 :], ["K"] * (at - 1) + [f"R{word[at - 1]}I{word[at]}"] + ["K"] * (len(word) - at - 1)),
                ):
                    if bad not in self.words:
                        data += [(char_features(bad, i), op) for i, op in enumerate(ops) if op != "K" or abs(i - at) < 3]
        # codes of letters and digits that clean records hold are kept
        for code in sorted(self.codes):
            for _ in range(CODE_SHOWN):
                own = _DIGITS.sub(lambda _: str(rng.randrange(10 ** rng.randrange(1, 4))), code)
                data += [(char_features(own, i), "K") for i in range(len(own))]
        if data:
            self.chars.fit(data, {op for _, op in data}, epochs=3)

    def correct(self, token: str) -> str | None:
        """The word of the corpus that the editor makes of an unknown token, or None."""
        if token in self._memo:
            return self._memo[token]
        out = self._correct(token.lower())
        if len(self._memo) > 500_000:
            self._memo.clear()
        self._memo[token] = out
        return out

    def _correct(self, s: str, beam: int = 24) -> str | None:
        """Beam search over whole confusions and the operations that the perceptron rates near KEEP or above it.

        A path is (score, edits, word so far) by position in ``s``. The best one that ends in a word of the corpus
        counts if it scores above the path that keeps every character.
        """
        if not s:
            return None
        ops_at = [self.chars.scores(char_features(s, i)) for i in range(len(s))]
        near = [[(op, v) for op, v in sorted(ops.items(), key=lambda x: (-x[1], x[0]))[:NEAR] if op != "K" and v > ops["K"] - SLACK] for ops in ops_at]
        if not any(near) and not any(seen in s for _, seen in CONFUSIONS):
            return None
        paths: list[dict[tuple[int, str], float]] = [{} for _ in range(len(s) + 1)]
        paths[0] = {(0, ""): 0.0}
        for i, c in enumerate(s):
            here = sorted(((p, n, t) for (n, t), p in paths[i].items()), key=lambda x: (-x[0], x[1], x[2]))
            for p, n, t in here[:beam]:
                steps = [(i + 1, p + ops_at[i]["K"], n, t + c)]
                steps += [(i + 1, p + v, n + 1, t + apply_op(c, op)) for op, v in near[i]]
                for true, seen in CONFUSIONS:
                    if s.startswith(seen, i):
                        gain = sum(ops_at[i + k][op] for k, op in enumerate(_ops(true, seen)))
                        steps.append((i + len(seen), p + gain, n + 1, t + true))
                for j, q, m, w in steps:
                    if q > paths[j].get((m, w), -1e18):
                        paths[j][m, w] = q
        keep = sum(ops["K"] for ops in ops_at)
        best = [(p, n, t) for (n, t), p in paths[-1].items() if n and p > keep and t in self.words]
        return min(best, key=lambda x: (-x[0], x[1], x[2]))[2] if best else None

    # -- marks at a line's end

    def end_features(self, left: str, mark: str, right: str) -> list[str]:
        joined = left + right
        whole = self.known(joined) or self.correct(joined) is not None
        return [f"m{mark}", f"j{whole}", f"l{self.known(left)}", f"r{self.known(right)}", f"jlr{whole}{self.known(left)}{self.known(right)}", f"a{right[:1].islower()}", f"d{left[-1:].isdigit()}"]

    def train_ends(self, seed: int = 5) -> None:
        rng, data = random.Random(seed), []
        words = sorted(w for w in self.words if len(w) >= 6)
        for w in words:
            cut, mark = rng.randrange(2, len(w) - 1), rng.choice(MARKS)
            data.append((self.end_features(w[:cut], mark, w[cut:]), "JOIN"))
        for _ in range(len(words) // 4):
            a, b = rng.choice(words), rng.choice(words)
            data.append((self.end_features(a, "-", b), "KEEP"))
            data.append((self.end_features(a, "-", b.upper()), "KEEP"))
            data.append((self.end_features(str(rng.randrange(1900, 2020)), rng.choice("-–"), b), "KEEP"))
        if data:
            self.ends.fit(data, ("JOIN", "KEEP"))

    def joins(self, left: str, mark: str, right: str) -> bool:
        """A word is broken here, by the perceptron; halves that make no word are joined only if the left one is none."""
        if not self.words:
            return right[:1].islower()
        got = self.ends.scores(self.end_features(left, mark, right))
        if self.known(left + right) or self.correct(left + right):
            return got["JOIN"] > got["KEEP"]
        return right[:1].islower() and not left[-1:].isdigit() and not self.known(left) and got["JOIN"] > got["KEEP"]

    # -- lines that belong to the page

    def is_furniture(self, lines: list[str], i: int, title: str, seen: Counter) -> bool:
        line = lines[i].strip()
        if not line or i == 0:
            return False
        feats = line_features(lines, i, title, seen)
        key = tuple(feats)
        if key not in self._lines:
            got = self.lines.scores(feats)
            if len(self._lines) > 200_000:
                self._lines.clear()
            self._lines[key] = got["OUT"] > got["IN"]
        return self._lines[key]

    # -- a whole text

    def repair(self, text: str) -> tuple[str, dict[str, int]]:
        """The text as continuous paragraphs, and how many faults of each kind were mended."""
        faults = {"linea": 0, "corte": 0, "letra": 0}
        lines = text.split("\n")
        title = lines[0].split(" › ")[0].split(" [")[0].strip()
        kept: list[str] = []
        pulled, seen = False, repeats(lines)
        for i, line in enumerate(lines):
            if self.is_furniture(lines, i, title, seen):
                faults["linea"] += 1
                pulled = True
                continue
            if kept and kept[-1].strip() and line.strip() and len(kept) > 1:
                m, h = _broken(kept[-1]), _HEAD.match(line)
                if m and h and self.joins(m[1], m[2], h.group()):
                    kept[-1] = kept[-1][: -len(m[2])] + line
                    faults["corte"] += 1
                    pulled = False
                    continue
            elif pulled and kept and not line.strip() and _open_end(kept[-1]):
                continue  # the blank line belonged to the page break
            if kept and pulled and line.strip() and _open_end(kept[-1]) and line.lstrip()[:1].islower() and len(kept) > 1:
                kept[-1] += " " + line.lstrip()
            else:
                kept.append(line)
            pulled = False
        # a mark left at the very end of a line by a page break that cut the text
        for k in range(1, len(kept)):
            m = _broken(kept[k])
            if m and m[2] in "¬\xad" or m and self.words and not self.known(m[1]) and m[1].isalpha() and not m[1].isupper() and k == len(kept) - 1:
                faults["corte"] += 1
        fixed = kept if self._all_known(text) and not faults["corte"] else [kept[0]] + [self._words(x, faults) for x in kept[1:]]
        return _paragraphs(fixed), faults

    def _all_known(self, text: str) -> bool:
        """No token of the text needs a look; known ones are kept by their spelling."""
        rest = set(_WORD.findall(text)) - self._plain
        if len(self._plain) > 1_000_000:
            self._plain.clear()
        for token in list(rest):
            if self._settled(token) or self.correct(token) is None:
                self._plain.add(token)
                rest.discard(token)
        return not rest

    def _settled(self, token: str) -> bool:
        """Nothing to look at: a word of the corpus, a number, one letter, or a code in capitals."""
        return token in self.words or token.lower() in self.words or token.isdigit() or len(token) < 2 or (token.isupper() and any(c.isdigit() for c in token))

    def _words(self, line: str, faults: dict[str, int]) -> str:
        bare = _TAG.sub(lambda m: " " * len(m.group()), line) if "<" in line or "\\" in line or "://" in line else line
        if "&" in bare and ";" in bare:
            bare = re.sub(r"[^\s&;]*(?:&#?\w{1,8};[^\s&;]*)+", lambda m: " " * len(m.group()), bare)
        out, at = [], 0
        for m in _WORD.finditer(bare):
            token = m.group()
            if self._settled(token):
                continue
            before, after = bare[m.start() - 1 : m.start()], bare[m.end() : m.end() + 1]
            if before in ("-", "_", "\\", "'", "{", "&", "#", "/", ".", "’") and before or after in ("_", "\\", "/", "’", "\xad", "¬") and after or (before and not before.isascii() and before not in "«“¿¡›–") or (after and not after.isascii() and after not in "»”…›–"):
                continue
            if after in (".", "-") and after and bare[m.end() + 1 : m.end() + 2].isdigit() and any(c.isdigit() for c in token):
                continue  # part of a longer code
            word = self.correct(token)
            if word:
                faults["letra"] += 1
                out += [line[at : m.start()], _cased(token, word)]
                at = m.end()
        return "".join(out) + line[at:] if out else line


def _cased(token: str, word: str) -> str:
    return word.upper() if token.isupper() and len(token) > 1 else word[:1].upper() + word[1:] if token[:1].isupper() else word


def _broken(line: str) -> re.Match | None:
    """The word and the mark at a line's end, if there is one."""
    return _BREAK.search(line, max(line.rfind(" "), line.rfind("\t")) + 1) if line and line[-1] in MARKS else None


def _open_end(line: str) -> bool:
    return bool(line.strip()) and line.rstrip()[-1] not in ".:;!?"


def _paragraphs(lines: list[str]) -> str:
    """Hard line ends inside a sentence become spaces; blank lines, lists and headings stay."""
    out: list[str] = []
    for k, line in enumerate(lines):
        flows = k > 1 and out[-1].strip() and line.strip() and _open_end(out[-1]) and len(lines[k - 1]) > 35 and (line.lstrip()[:1].islower() or line.lstrip()[:1].isdigit())
        if flows or (k > 1 and out[-1].strip() and line.strip() and 40 < len(lines[k - 1]) < 85 and line.lstrip()[:1].isupper() and not _open_end(out[-1]) is True and out[-1].rstrip()[-1:] == "," ):
            out[-1] = out[-1].rstrip() + " " + line.lstrip()
        else:
            out.append(line)
    return "\n".join(out)


def _spaced(line: str) -> bool:
    """Letters set apart by spaces, as in a running header."""
    parts = line.split()
    return sum(len(x) == 1 for x in parts) >= 0.7 * len(parts)


def _digitless(line: str) -> str:
    return re.sub(r"\d+", "9", line.strip().lower())


def repeats(lines: list[str]) -> Counter:
    """How often each line stands in a text, whatever its numbers."""
    return Counter(_digitless(x) for x in lines if x.strip())


def line_features(lines: list[str], i: int, title: str, seen: Counter, blind: bool = False) -> list[str]:
    """Shape of a line, its place (what runs through it from the line before to the line after) and its repetition.

    ``blind`` sees no shape: what is left for a line that no pattern knows.
    """
    line = lines[i].strip()
    own = bool(title) and line.endswith(title)
    shapes = [f"s{k}{own if k == 7 else ''}" for k, p in enumerate(FURNITURE) if (k != 6 or _spaced(line)) and p.fullmatch(line)]
    if title and line != title and line.upper() == title.upper() and line == line.upper():
        shapes.append("title")
    if _SPECK.fullmatch(line) and not _MARKUP_LINE.fullmatch(line):
        shapes.append("speck")
    before = next((x for x in reversed(lines[:i]) if x.strip()), "")
    after = next((x for x in lines[i + 1 :] if x.strip()), "")
    words = _LETTERS.findall(line)
    cut = f"{_open_end(before)}{after.lstrip()[:1].islower()}"
    again = min(3, seen[_digitless(line)])
    if blind or not shapes:
        head = f"{line[:1].islower()}{_open_end(line)}"
        size = len(line).bit_length()
        return ["none", f"none:{cut}:{head}", f"z{size}", f"r{again}:{size > 7}", f"r{again}:{cut}:{size > 7}", f"r{again}:{head}:{min(3, len(words))}:{size > 7}"]
    feats = [f"{s}:{cut}" for s in shapes] + shapes
    return feats + [f"n{min(3, len(words))}", f"b{before.rstrip()[-1:] in MARKS and bool(before)}", f"e{_open_end(before)}", f"f{after.lstrip()[:1].islower()}", f"c{line.isupper()}", f"x{line[:1].isdigit()}|{'|' in line}"]


def _text(raw: str) -> str | None:
    try:
        data = json.loads(raw)
    except ValueError:
        return None
    text = data.get("texto") if isinstance(data, dict) else None
    return text if isinstance(text, str) else None


_DIRTY = ("-\n", "–\n", "¬", "\xad", "\\", "<", "&", "�", "Ã", "**", "__")
_LOST = re.compile(r"\w\?\w")
_DIGITS = re.compile(r"\d+")


def clean_words(text: str) -> set[str] | None:
    """Distinct lower-cased words and codes (numbers as 9) of a record that shows no fault; None for one that does."""
    if any(x in text for x in _DIRTY) or _LOST.search(text):
        return None
    return {_DIGITS.sub("9", w.lower()) for w in _WORD.findall(text)}


def fit(texts: Iterable[str], counts: Counter | None = None, records: int = 0) -> Editor:
    """Lexicon and perceptrons; no labels are needed.

    ``counts``: in how many of ``records`` clean records each word stands; counted on the texts if not given. Characters
    and line ends are trained on words damaged on purpose. Lines are trained on trusted shapes, as furniture where they
    stand alone among running text, and on ordinary lines; a table row or list number of the same shape is the other
    class.
    """
    texts = list(texts)
    if counts is None:
        counts = Counter()
        for ws in filter(None, map(clean_words, texts)):
            counts.update(ws)
            records += 1
    least = max(MIN_COUNT, MIN_SHARE * records)
    common = {w: n for w, n in counts.items() if n >= least}
    words = Counter({w: n for w, n in common.items() if _LETTERS.fullmatch(w)})
    editor = Editor(words, Counter({w: n for w, n in common.items() if w not in words and not w.isdigit() and any(c.isdigit() for c in w)}))
    editor.train_chars()
    # a misreading of a far commoner word is no word
    for w in sorted(words, key=lambda w: (words[w], w)):
        n = words.pop(w)
        better = editor._correct(w) if len(w) >= 4 and n < RARE_SHARE * records else None
        if not (better and counts[better] >= COMMONER * n):
            words[w] = n
    editor._memo.clear()
    editor.train_ends()
    data: list[tuple[list[str], str]] = []
    for t in texts:
        lines = t.split("\n")
        title = lines[0].split(" › ")[0].split(" [")[0].strip()
        seen = repeats(lines)
        for i in range(1, len(lines)):
            line = lines[i].strip()
            if not line:
                continue
            feats = line_features(lines, i, title, seen)
            if feats[0] == "none":
                data.append((feats, "IN"))
                continue
            row = line.count("|") and (i + 1 < len(lines) and lines[i + 1].count("|") == line.count("|") or lines[i - 1].count("|") == line.count("|"))
            foreign = FURNITURE[7].fullmatch(line) and not line.endswith(title)
            data.append((feats, "IN" if row or foreign else "OUT"))
            blind = line_features(lines, i, title, seen, blind=True)
            if seen[_digitless(line)] > 1 and "none:TrueTrue" in blind[1]:  # only a sentence that runs through tells it from a list
                data.append((blind, data[-1][1]))
    editor.lines.fit(data, ("IN", "OUT"), epochs=3, margin=4.0)
    return editor


def word_counts(chunks: DataFrame) -> DataFrame:
    """(w, n): in how many clean records each word or code stands, over all records; '' counts the records themselves."""

    def run(cols: list[list]) -> list[list]:
        own: Counter = Counter()
        for raw in cols[0]:
            text = _text(raw)
            ws = clean_words(text) if text else None
            if ws is not None:
                own.update(ws)
                own[""] += 1
        return [list(own), list(own.values())]

    rows = chunks.select("datos").where(F.col("datos").isNotNull())
    return map_arrow(rows, "w string, n long", run).groupBy("w").agg(F.sum("n").cast("long").alias("n"))


def fit_model(chunks: DataFrame) -> Editor:
    """The lexicon is counted over all records; only words of enough of them come to the driver, which bounds their number.
    The perceptrons are fitted on about ``SAMPLE_ROWS`` records (see :func:`base.sample_rows`)."""
    counted = cut_lineage(word_counts(chunks))
    total = counted.where("w = ''").first()
    records = total.n if total else 0
    common = counted.where((F.col("w") != "") & (F.col("n") >= max(MIN_COUNT, MIN_SHARE * records))).collect()
    texts = [t for t in map(_text, sample_rows(chunks, "chunk_id", "datos", seed="ocr")) if t]
    return fit(texts, Counter({r.w: r.n for r in common}), records)


def repair_chunks(chunks: DataFrame, model: Editor | None = None) -> DataFrame:
    """(chunk_id, reparado, lineas, cortes, letras) of each row with at least one scanning fault."""
    model = model or fit_model(chunks)

    def run(cols: list[list]) -> list[list]:
        out: list[list] = [[], [], [], [], []]
        for key, raw in zip(*cols):
            text = _text(raw)
            if not text:
                continue
            fixed, n = model.repair(text)
            if any(n.values()):
                for col, v in zip(out, (key, fixed, n["linea"], n["corte"], n["letra"])):
                    col.append(v)
        return out

    rows = chunks.select("chunk_id", "datos").where(F.col("datos").isNotNull() & F.col("chunk_id").isNotNull())
    return map_arrow(rows, "chunk_id string, reparado string, lineas int, cortes int, letras int", run)


def found(chunks: DataFrame) -> DataFrame:
    return repair_chunks(chunks).select("chunk_id").distinct()
