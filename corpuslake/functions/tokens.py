"""Index tokens, the same for texts and for questions: folded words, legal identifiers whole, Spanish stems.

``C-355 de 2006`` gives ``c_355`` and ``2006``, ``240-1`` gives ``240_1``, ``1.564`` gives ``1564``. Identifiers keep their
form; other words are stemmed if asked. Stemming has no counterpart among the engine's column functions, so tokens are
made in Arrow batches, with a memo of stems by spelling.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from .stem import stem

_COMMON = tuple(zip("áéíóúñü", "aeiounu"))
_UNMARKED = re.compile(r"[\x00-\x7fºª°«»“”‘’–—…·•¿¡§©›→]*")  # none of these has an accent to remove
_MARKS = re.compile("[̀-ͯ҃-҇᪰-᫿᷀-᷿⃐-⃥⃜⃡-⃰︠-︯]+")
# The chambers whose rulings are identifiers, and the shapes that are joined.
CHAMBERS = "su sc sl sp stc stl stp ac al ap c t".split()
_RULING = re.compile(r"\b(" + "|".join(CHAMBERS) + r")\s*-\s*0*(\d{1,5})([a-z]?)(?:\s*(?:/|-|\bde\b|\bdel\b)\s*(\d{4}|\d{2})\b)?")
_THOUSANDS = re.compile(r"\.(?<=\d\.)(?=\d{3}\b)")  # the literals first: they are what the scan looks for
_JOINED = re.compile(r"[-.](?<=\w[-.])(?=\d)")
_DASHED = re.compile(r"-\s*\d")
_WORD = re.compile(r"\w+")
_DIGIT = re.compile(r"\d")
#: How tokens are made; stored with an index, and compared when it is opened.
VERSION = "fold,thousands,rulings,joined"


def full_year(year: str) -> str:
    """Two-digit years turn over at 50."""
    return year if len(year) != 2 else ("20" if int(year) < 50 else "19") + year


def fold(text: str) -> str:
    text = text.lower()
    if text.isascii():
        return text
    for accented, plain in _COMMON:  # replacement is ten times faster than a table
        if accented in text:
            text = text.replace(accented, plain)
    return text if _UNMARKED.fullmatch(text) else _MARKS.sub("", unicodedata.normalize("NFD", text))


_stem = lru_cache(1 << 18)(stem)


def tokens(text: str, stems: bool = False) -> list[str]:
    """Tokens of a text, in order."""
    s = fold(text)
    if _DIGIT.search(s):
        if "." in s:
            s = _THOUSANDS.sub("", s)
        if "-" in s and _DASHED.search(s):
            s = _RULING.sub(lambda m: f" {m[1]}_{m[2]}{m[3]} {full_year(m[4] or '')} ", s)
        s = _JOINED.sub("_", s)
    words = _WORD.findall(s)
    return [term(w) for w in words] if stems else words


def term(word: str) -> str:
    """The stem of a token; one with a digit is an identifier and stays."""
    return word if _DIGIT.search(word) else _stem(word)
