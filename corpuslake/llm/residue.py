"""Template residue and error-page text (problem 10).

Method: a positive-unlabelled naive Bayes classifier, learned by expectation-maximization from trusted error and
placeholder passages (the fixed shapes below) and all other passages of a bounded sample as unlabelled. Passages are of
two kinds, each with its own class model: sentences, and marked spots (a bracketed, repeated or blank slot of any
length, with its neighbours). The fixed shapes only train; every passage is judged by its odds. A record is decided by
its passages: one slot is enough; sentences count by their share of the record's letters.

Defined results
    * null or blank texts: no row; an empty table: no rows; repeated ids: found if one of their texts is.
    * the whole text is scored; a tie (odds of one, or a share of exactly one half) is no case.
    * without trusted passages in the sample there is no class to learn, and nothing is found.
"""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import fold, map_arrow, sample_rows

#: Records shorter than this may be nothing but residue; sentences of longer ones are taken as content when the model is fitted.
SHORT = 700
#: Documents that may be used to fit the classifier.
DOCS_SAMPLE = 8000
# Shapes of slots that are trusted as positives when the classifier is fitted.
TRUSTED_SLOT = re.compile(r"\{\{[^{}\n]+\}\}|\$\{[^{}\n]+\}|@@[^@\n]+@@|<<[^<>\n]+>>|%[A-ZÑ]+(?:_[A-ZÑ]+)+%|__[a-zñ]+(?:_[a-zñ]+)*__|(?<!_)_{2,}/_{2,}|\[(?:INSERT|COMPLET|INDI[CQ])\w* [^\]\n]*\]|(?:No\. )?X{2,}(?:\.X{2,})+|X{5,}|_{4,}|\.{8,}")
# Wordings of error pages, filler and script notices that are trusted as positives when the classifier is fitted; folded, numbers as 9.
TRUSTED_LINE = re.compile(
    r"\blorem\b.*\bipsum\b|\bipsum\b.*\blorem\b|HTTP 9\b|\berror 9\b|^error \w+:|pagina nao encontrada|page demandee est introuvable|"
    r"could not be found on this server|enable JavaScript|activer JavaScript|requiere JavaScript|noscript|java\.lang\.|failed to open stream|"
    r"^(?:asdf ?){2,}|^(?:xxxxx ?){2,}|texto de prueba\. |aqui va el texto|pagina en construccion|contenido pendiente de cargue|"
    r"documento en blanco dejado|no admite scripts|se necesitan scripts|ejecucion de (?:codigo|scripts)",
    re.I,
)
_SPOT = re.compile(
    r"\{\{[^{}\n]+\}\}|\$?\{[^{}\n]+\}|<<[^<>\n]+>>|&lt;(?:(?!&[lg]t;)[^\n])+&gt;|<[^<>\n]+>|@@[^@\n]+@@|%\w[\w ]*%|#\w[\w ]*#|"
    r"\[[^\[\]\n]+\]|«[^«»\n]+»|\((?=[^()\n]*[^\W\d])[^()\n]+\)|__\w(?:[^_\n]|_(?!_))*__|_{2,}(?:/_{2,}(?:/\d{0,4}_*)?)?|\.{5,}|…{2,}|(?<!\w)(?:No\. )?X{2,}(?:[.\-/]X+)*(?!\w)"
)
_SENTENCE = re.compile(r"(?<=[.!?:;…])\s+|\n+")
_NUMBER = re.compile(r"\d+")
_WORDS = re.compile(r"[a-z]+|9|[^\w\s]")
_MAY_SPOT = re.compile(r"[{<&@%#\[«_(]|\.{5}|……|XX")
_LATIN = "lorem ipsum dolor amet consectetur adipiscing elit sed tempor incididunt labore magna aliqua enim minim veniam quis nostrud"
# Words before a spot that is spoken of, not left open.
_MENTION = ("campo", "casilla", "mensaje", "clausula", "clave", "palabra", "expresion", "rotulo", "boton", "minuta", "clic", "busqueda")
_PAIRS = ("{{", "${", "{", "<<", "&lt;", "<", "@@", "%", "#", "[", "«", "(", "__", "_", ".", "…", "X", "No. X")


def sentences(text: str) -> list[str]:
    """Sentences of a folded text, numbers as one digit."""
    return [s for s in (x.strip() for x in _SENTENCE.split(_NUMBER.sub("9", text))) if s]


def sentence_features(s: str) -> list[str | tuple[str, str]]:
    """Distinct words, and distinct pairs of neighbours."""
    ws = _WORDS.findall(s)
    return [*set(ws), *set(zip(ws, ws[1:]))]


def _shape(inner: str) -> str:
    if not any(c.isalpha() for c in inner):
        return "digits" if any(c.isdigit() for c in inner) else "marks"
    words_ = inner.split()
    case = "upper" if inner.isupper() else "lower" if inner.islower() else "title" if inner[:1].isupper() else "mixed"
    return f"{case}{'_' if '_' in inner.strip('_') else ''}{min(4, len(words_)) if len(inner) > 1 else 'letter'}"


def spots(text: str) -> list[tuple[str, list[str], bool]]:
    """(span, features, trusted) of every marked spot of a text, however long it is."""
    out = []
    for m in _SPOT.finditer(text) if _MAY_SPOT.search(text) else ():
        span = m.group()
        pair = next((p for p in _PAIRS if span.startswith(p)), "?")
        inner = span.strip("{}$<>@%#[]«»()_.…").removeprefix("&lt;").removesuffix("&gt;")
        before = re.findall(r"[^\W\d_]+", fold(" ".join(text[text.rfind("\n", 0, m.start()) + 1 : m.start()].rsplit(None, 3)[-3:])))[-2:]
        stop = text.find("\n", m.end())
        after = re.findall(r"[^\W\d_]+|[^\w\s]", fold(" ".join(text[m.end() : stop if stop >= 0 else len(text)].split(None, 1)[:1])))[:1]
        inner_words = re.findall(r"[a-z0-9]+", fold(inner))
        shape = _shape(inner)
        # round brackets are ordinary punctuation: their spot is judged by what it holds
        feats = [] if pair == "(" else [f"p={pair}", f"s={shape}", f"ps={pair}|{shape}"]
        feats += [f"w={w}" for w in dict.fromkeys(inner_words) if len(w) > 3]
        if pair != "(":
            feats += [f"i={' '.join(inner_words)}", *[f"b={b}" for b in before[-1:]], *[f"a={a}" for a in after]]
        spoken = [f"m={b}" for b in before if b in _MENTION]
        if spoken:  # what it holds says nothing then
            feats = spoken * 3
        out.append((span, feats, bool(TRUSTED_SLOT.fullmatch(span))))
    return out


def _start(feats: list[str]) -> float:
    """Weight as a slot that an unlabelled spot has in the first round: less the more it holds, none for what is content."""
    if not any(f[:2] == "p=" for f in feats) or "s=digits" in feats:
        return 0.0
    return 0.7 / (1.0 + sum(f[:2] == "w=" for f in feats) / 8.0)


class PuBayes:
    """Multinomial naive Bayes with fixed positives; unlabelled passages start as negatives and are re-weighted."""

    def __init__(self) -> None:
        self.logit: dict[object, float] = {}
        self.prior = -math.inf

    def fit(self, passages: Iterable[list], trusted: list[bool], ruled_out: list[bool], rounds: int = 8, alpha: float = 0.3, least: int = 3, start: list[float] | None = None) -> None:
        """``ruled_out``: unlabelled passages that are known to be content; features of fewer than ``least`` passages don't
        count; ``start``: the weight as a positive that each unlabelled passage has in the first round, 0 if not given."""
        ids: dict[object, int] = {}
        flat_, lens_ = array("i"), array("i")
        for p in passages:
            flat_.extend([ids.setdefault(f, len(ids)) for f in p])
            lens_.append(len(p))
        if not any(trusted):
            return
        flat, row = np.frombuffer(flat_, np.int32), np.repeat(np.arange(len(lens_)), np.frombuffer(lens_, np.int32))
        kept = np.bincount(flat, minlength=len(ids)) >= least
        flat, row = flat[kept[flat]], row[kept[flat]]
        fixed, out = np.array(trusted), np.array(ruled_out) & ~np.array(trusted)
        q = np.where(fixed, 1.0, np.where(out, 0.0, 0.0 if start is None else np.array(start)))
        v = len(ids)
        for _ in range(rounds):
            pos = np.where(kept, np.bincount(flat, q[row], v) + alpha, 0)
            neg = np.where(kept, np.bincount(flat, 1.0 - q[row], v) + alpha, 0)
            w = np.zeros(v)
            w[kept] = np.log(pos[kept] / pos.sum()) - np.log(neg[kept] / neg.sum())
            prior = math.log((q.sum() + 1) / (len(q) - q.sum() + 1))
            odds = np.bincount(row, w[flat], len(q)) + prior
            q = np.where(fixed, 1.0, np.where(out, 0.0, 1.0 / (1.0 + np.exp(-np.clip(odds, -40, 40)))))
        self.logit = {f: float(w[i]) for f, i in ids.items() if kept[i]}
        self.prior = prior

    def score(self, feats: list) -> float:
        get = self.logit.get
        return self.prior + sum([get(f, 0.0) for f in feats])


class Residue:
    def __init__(self) -> None:
        self.lines, self.slots = PuBayes(), PuBayes()
        self._memo: dict[str, bool] = {}

    def _bad_sentence(self, s: str) -> bool:
        got = self._memo.get(s) if len(s) < 300 else None
        if got is None:
            got = self.lines.score(sentence_features(s)) > 0
            if len(s) < 300:
                if len(self._memo) > 200_000:
                    self._memo.clear()
                self._memo[s] = got
        return got

    def judge(self, text: str) -> tuple[int, float]:
        """(slots, share of the letters that stand in residue sentences)."""
        slots = sum(self.slots.score(feats) > 0 for _, feats, _ in spots(text))
        bad = total = 0
        for s in sentences(fold(text)):
            total += len(s)
            bad += len(s) if self._bad_sentence(s) else 0
        return slots, bad / total if total else 0.0


def fit(texts: Iterable[str]) -> Residue:
    model = Residue()
    lines: list[str] = []
    line_trust: list[bool] = []
    line_out: list[bool] = []
    marks: list[list[str]] = []
    mark_trust: list[bool] = []
    latin = set(_LATIN.split())
    for text in texts:
        own = sentences(fold(text))
        short = sum(map(len, own)) < SHORT
        for s in own:
            ws = s.split()
            lines.append(s)
            filler = len(ws) > 3 and sum(w.strip(".,") in latin for w in ws) > 0.5 * len(ws)
            line_trust.append(filler or (short and bool(TRUSTED_LINE.search(s))))
            line_out.append(not short)
        for _, feats, trusted in spots(text):
            marks.append(feats)
            mark_trust.append(trusted)
    model.lines.fit(map(sentence_features, lines), line_trust, line_out)
    model.slots.fit(marks, mark_trust, [any(f[:2] == "m=" for f in m) for m in marks], start=[_start(m) for m in marks])
    return model


def fit_model(documents: DataFrame) -> Residue:
    """Fitted on about ``DOCS_SAMPLE`` documents (see :func:`base.sample_rows`)."""
    return fit(t for t in sample_rows(documents, "doc_id", "text", rows=DOCS_SAMPLE, seed="residue") if t.strip())


def scores(documents: DataFrame, model: Residue | None = None) -> DataFrame:
    """(doc_id, ranuras, parte): slots of each non-blank document, and the share of residue among its letters."""
    model = model or fit_model(documents)

    def run(cols: list[list]) -> list[list]:
        out: list[list] = [[], [], []]
        for key, text in zip(*cols):
            if text.strip():
                for col, v in zip(out, (key, *model.judge(text))):
                    col.append(v)
        return out

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    return map_arrow(rows, "doc_id long, ranuras int, parte double", run)


def found(documents: DataFrame) -> DataFrame:
    return scores(documents).where("ranuras > 0 or parte > 0.5").select("doc_id").distinct()
