"""Column functions on text; all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Accented letters (lower case) and what they fold to.
ACCENTED = "áàâäãåéèêëíìîïóòôöõúùûüñç"
PLAIN = "aaaaaaeeeeiiiiooooouuuunc"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def fold(x: Column | str) -> Column:
    """Lower case without accents."""
    return F.translate(F.lower(_c(x)), ACCENTED, PLAIN)


def joined_thousands(x: Column | str) -> Column:
    """``1.234.567`` as ``1234567``."""
    return F.regexp_replace(_c(x), r"\.(?<=\d\.)(?=\d{3}(?!\d))", "")  # the literal first: it is what the scan looks for


def tokens(x: Column | str) -> Column:
    """Index tokens: folded, thousands joined, hyphens and dots before digits opened, letters and digits kept."""
    plain = F.regexp_replace(joined_thousands(fold(x)), r"[-.](?<=[\p{L}\p{N}][-.])(?=\d)", " ")
    return F.regexp_extract_all(plain, F.lit(r"[a-z0-9\p{L}\p{N}]+"), F.lit(0))


def words(x: Column | str) -> Column:
    return F.regexp_extract_all(F.lower(_c(x)), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def body(x: Column | str) -> Column:
    """Text after the heading line, if there is one."""
    x = _c(x)
    return F.when(F.instr(x, "\n") > 0, F.substring(x, F.instr(x, "\n") + F.lit(1), F.length(x))).otherwise(x)


def shingles(x: Column | str, n: int = 5) -> Column:
    """Distinct runs of ``n`` words of the body; a shorter text is one shingle of all its words."""

    def of(w: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.array_join(F.slice(w, i, n), " "))
        return F.when(F.size(w) < n, F.array(F.array_join(w, " "))).otherwise(F.array_distinct(runs))

    # bound in a one-element array, so that the words are found once a row and not once a shingle
    return F.transform(F.array(words(body(x))), of)[0]


def containment(a: Column | str, b: Column | str) -> Column:
    """Shared shingles over the smaller set."""
    a, b = _c(a), _c(b)
    return F.size(F.array_intersect(a, b)) / F.greatest(F.least(F.size(a), F.size(b)), F.lit(1))


def amounts(x: Column | str) -> Column:
    """Numbers written with thousands dots, as longs."""
    found = F.regexp_extract_all(_c(x), F.lit(r"\d{1,3}(?:\.\d{3})+"), F.lit(0))
    return F.transform(found, lambda v: F.replace(v, F.lit("."), F.lit("")).cast("long"))


def struck(x: Column | str) -> Column:
    """Share of the characters inside ``~~…~~``."""
    x = _c(x)
    inner = F.aggregate(F.regexp_extract_all(x, F.lit("~~(.+?)~~"), F.lit(1)), F.lit(0), lambda s, v: s + F.length(v))
    return inner / F.greatest(F.length(x), F.lit(1))


def clean_lines(x: Column | str) -> Column:
    """Quote marks, bold marks and escapes gone, blank lines dropped."""
    y = F.regexp_replace(_c(x), r"(?m)^> ?", "")
    y = F.regexp_replace(F.regexp_replace(y, r"\*\*", ""), r"\\([*_~`#])", "$1")
    return F.regexp_replace(y, r"\n[ \t]*(?=\n)", "")


def clean_text(x: Column | str) -> Column:
    """Ligatures opened, zero-width and replacement characters removed, white space collapsed."""
    y = _c(x)
    for a, b in (("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff")):
        y = F.replace(y, F.lit(a), F.lit(b))
    y = F.regexp_replace(y, "[​‌‍﻿�­]", "")
    return F.trim(F.regexp_replace(y, r"[ \t\n\r ]+", " "))


def joined_hyphens(x: Column | str) -> Column:
    """Words broken by a soft hyphen or hyphen at a line's end."""
    return F.regexp_replace(_c(x), "(\\p{L})[-­]\n(\\p{Ll})", "$1$2")


def normalized(x: Column | str) -> Column:
    """Letters and digits only, folded: the form in which a passage is located in its document."""
    return F.regexp_replace(fold(x), r"[^\p{L}\p{N}]", "")


def natural_key(x: Column | str) -> Column:
    """``1.13.2`` as zero-padded parts, for sorting."""
    return F.array_join(F.transform(F.regexp_extract_all(_c(x), F.lit(r"\d+"), F.lit(0)), lambda v: F.lpad(v, 6, "0")), ".")


def uppercase_share(x: Column | str) -> Column:
    x = _c(x)
    letters = F.regexp_count(x, F.lit(r"\p{L}"))
    return F.when(letters == 0, F.lit(0.0)).otherwise(F.regexp_count(x, F.lit(r"\p{Lu}")) / letters)


def expand_acronyms(x: Column | str, names: dict[str, str]) -> Column:
    """After the first mention of each acronym, its name in brackets, unless the name stands in the text. Longest first."""
    y = _c(x)
    for short in sorted(names, key=lambda s: (-len(s), s)):
        pattern = rf"(?s)^(.*?(?<![\p{{L}}\p{{N}}_-]){short}(?![\p{{L}}\p{{N}}_-]))(.*)$"
        y = F.when(F.contains(y, F.lit(names[short])), y).otherwise(F.regexp_replace(y, pattern, f"$1 ({names[short]})$2"))
    return y


def _bound(value: Column, of) -> Column:
    """``of(value)`` with the value computed once a row, however often it is used."""
    return F.transform(F.array(value), of)[0]


def first_match(x: Column | str, rules: list[tuple[str, str]], default: str) -> Column:
    """Label of the first pattern that occurs in the folded text."""

    def of(y: Column) -> Column:
        out = F.when(y.rlike(rules[0][1]), rules[0][0])
        for label, pattern in rules[1:]:
            out = out.when(y.rlike(pattern), label)
        return out.otherwise(default)

    return _bound(fold(x), of)


def labels(x: Column | str, rules: list[tuple[str, str]], default: str) -> Column:
    """Sorted labels of all patterns that occur in the folded text."""
    every = _bound(fold(x), lambda y: F.array(*[F.when(y.rlike(p), F.lit(label)) for label, p in rules]))
    got = F.array_sort(F.array_compact(every))
    return F.when(F.size(got) == 0, F.array(F.lit(default))).otherwise(got)
