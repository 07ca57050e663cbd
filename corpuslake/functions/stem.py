"""The Spanish Snowball stemmer, written from its published definition (snowballstem.org, "Spanish stemming algorithm")."""

from __future__ import annotations

VOWELS = frozenset("aeiouáéíóúü")
_BARE = str.maketrans("áéíóú", "aeiou")
# The endings of the published algorithm.
PRONOUNS = "me se sela selo selas selos la le lo las les los nos".split()
BEFORE_PRONOUN = "iéndo ándo ár ér ír ando iendo ar er ir".split()
PLAIN = (
    "anza anzas ico ica icos icas ismo ismos able ables ible ibles ista istas oso osa osos osas amiento amientos imiento "
    "imientos"
).split()
AFTER_IC = "adora ador ación acion adoras adores aciones ante antes ancia ancias".split()
LOGY, UTION, ENCY = "logía logías".split(), "ución ucion uciones".split(), "encia encias".split()
IDAD, IVO = "idad idades".split(), "iva ivo ivas ivos".split()
Y_VERBS = "ya ye yan yen yeron yendo yo yó yas yes yais yamos".split()
SHORT_VERBS = "en es éis emos".split()
VERBS = (
    "arían arías arán arás aríais aría aréis aríamos aremos ará aré erían erías erán erás eríais ería eréis eríamos eremos "
    "erá eré irían irías irán irás iríais iría iréis iríamos iremos irá iré aba ada ida ía ara iera ad ed id ase iese aste "
    "iste an aban ían aran ieran asen iesen aron ieron ado ido ando iendo ió ar er ir as abas adas idas ías aras ieras ases "
    "ieses ís áis abais íais arais ierais aseis ieseis asteis isteis ados idos amos ábamos íamos imos áramos iéramos "
    "iésemos ásemos"
).split()
RESIDUE = "os a o á í ó".split()


def _longest(endings: list[str]) -> tuple[tuple[int, frozenset[str]], ...]:
    """Endings by length, the longest first."""
    return tuple((n, frozenset(e for e in endings if len(e) == n)) for n in sorted({len(e) for e in endings}, reverse=True))


_PRONOUN, _BEFORE = _longest(PRONOUNS), _longest(BEFORE_PRONOUN)
_STANDARD = _longest([*PLAIN, *AFTER_IC, *LOGY, *UTION, *ENCY, *IDAD, *IVO, "amente", "mente"])
_Y, _VERB, _REST = _longest(Y_VERBS), _longest([*VERBS, *SHORT_VERBS]), _longest([*RESIDUE, "e", "é"])


def _ending(word: str, by_length: tuple, start: int = 0) -> str:
    """The longest of the endings that the word has at or after ``start``, or ''."""
    for n, endings in by_length:
        if len(word) - start >= n and word[-n:] in endings:
            return word[-n:]
    return ""


def _after(word: str, start: int) -> int:
    """Where the region after the first consonant that follows a vowel begins."""
    for i in range(start + 1, len(word)):
        if word[i] not in VOWELS and word[i - 1] in VOWELS:
            return i + 1
    return len(word)


def regions(word: str) -> tuple[int, int, int]:
    """Starts of RV, R1 and R2."""
    n = len(word)
    rv = n
    if n > 1:
        if word[1] not in VOWELS:
            rv = next((i + 1 for i in range(2, n) if word[i] in VOWELS), n)
        elif word[0] in VOWELS:
            rv = next((i + 1 for i in range(2, n) if word[i] not in VOWELS), n)
        else:
            rv = min(3, n)
    r1 = _after(word, 0)
    return rv, r1, _after(word, r1)


def _without_pronoun(word: str, rv: int) -> str:
    pronoun = _ending(word, _PRONOUN)
    if not pronoun:
        return word
    rest = word[: -len(pronoun)]
    verb = _ending(rest, _BEFORE)
    if verb:
        if len(rest) - len(verb) < rv:
            return word
        return rest[: -len(verb)] + verb.translate(_BARE)
    if rest.endswith("yendo") and len(rest) - 5 >= rv and rest[-6:-5] == "u":
        return rest
    return word


def _standard(word: str, r1: int, r2: int) -> str:
    end = _ending(word, _STANDARD)
    at = len(word) - len(end)
    if not end or at < (r1 if end == "amente" else r2):
        return word
    word = word[:at]

    def drop(*endings: str) -> bool:
        nonlocal word
        for e in endings:
            if word.endswith(e):
                if len(word) - len(e) >= r2:
                    word = word[: -len(e)]
                    return True
                return False
        return False

    if end in AFTER_IC:
        drop("ic")
    elif end in LOGY:
        word += "log"
    elif end in UTION:
        word += "u"
    elif end in ENCY:
        word += "ente"
    elif end == "amente":
        if word.endswith("iv"):
            if drop("iv"):
                drop("at")
        else:
            drop("os", "ic", "ad")
    elif end == "mente":
        drop("ante", "able", "ible")
    elif end in IDAD:
        drop("abil", "ic", "iv")
    elif end in IVO:
        drop("at")
    return word


def _verb(word: str, rv: int) -> str:
    end = _ending(word, _Y, rv)
    if end and word[: -len(end)].endswith("u"):
        return word[: -len(end)]
    end = _ending(word, _VERB, rv)
    if not end:
        return word
    word = word[: -len(end)]
    return word[:-1] if end in SHORT_VERBS and word.endswith("gu") else word


def _residue(word: str, rv: int) -> str:
    end = _ending(word, _REST, rv)
    if not end:
        return word
    word = word[: -len(end)]
    if end in ("e", "é") and word.endswith("gu") and len(word) - 1 >= rv:
        word = word[:-1]
    return word


def stem(word: str) -> str:
    """The stem of a lower-case word."""
    rv, r1, r2 = regions(word)
    word = _without_pronoun(word, rv)
    done = _standard(word, r1, r2)
    if done == word:
        done = _verb(word, rv)
    return _residue(done, rv).translate(_BARE)
