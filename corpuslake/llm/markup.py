"""Markup residue in text documents: turn HTML, Markdown, wiki and LaTeX into clean text (problem 6).

Method: a text of any of the four languages is read into one tree; each node carries the marks that it was made from.
The tree is scored: a paragraph passes points for its length and its commas to its parent and, halved, to its
grandparent; link density discounts them. The best container is kept whole, and at every level above it the bare text
and the siblings that score enough or are no lists of links. What is kept is written out as plain text in which
headings, lists, tables, code and formulas stay readable. A record is a case if a node of its tree carries a mark.

Code and formulas are lifted out before anything else is read, and headings are read before lists.

Defined results
    * null or text-less rows: no row; an empty table: no rows; repeated rows: each gives the same answer.
    * a text without any mark comes out as it is and gives no row; very long texts are converted whole.
    * money, comparisons, footnote stars, quoted ids, paths, the law's numbering and rows of `` | `` are no marks.
    * ties between containers go to the one that opens first.
"""

from __future__ import annotations

import html
import re
import unicodedata
from html.parser import HTMLParser

from pyspark.sql import DataFrame

from .base import keyed_texts, map_arrow, text_of

# The element and command names that count as markup.
_TAGS = (
    "a|abbr|address|article|aside|b|big|blockquote|body|br|caption|center|cite|code|col|colgroup|dd|del|div|dl|dt|em|figure|"
    "font|footer|form|h[1-6]|head|header|hr|html|i|iframe|img|input|ins|kbd|label|li|link|main|meta|nav|nowiki|ol|p|pre|q|"
    "ref|references|s|samp|script|section|select|small|span|strike|strong|style|sub|sup|table|tbody|td|tfoot|th|thead|"
    "title|tr|tt|u|ul|var"
)
_COMMANDS = (
    "part|chapter|(?:sub)*section|(?:sub)?paragraph|text(?:bf|it|tt|sc|rm|sf|up|sl)|emph|underline|footnote|begin|end|item|"
    "cite|label|ref|url|href|caption|title|author|date|maketitle|hline|newline|linebreak|noindent|par|centering|"
    "includegraphics|usepackage|documentclass|d?frac|sqrt|sum|alpha|beta|gamma|delta|cdot|times|leq|geq|neq|ldots|dots|"
    "quad|mbox|[hv]space|left|right|bf|it"
)
#: What counts as a mark, by kind.
MARKS = {
    "html": re.compile(rf"</?(?:{_TAGS})(?:\s[^<>]*)?/?>|<!--|<!DOCTYPE", re.I),
    "entity": re.compile(r"&(?:[A-Za-z][A-Za-z0-9]{1,8}|#\d{1,6}|#[xX][0-9A-Fa-f]{1,5});"),
    "heading": re.compile(r"(?m)^#{1,6} \S"),
    "bold": re.compile(r"\*\*(?=[^\s*])[^*\n]+\*\*|(?<!\w)__(?=[^\s_])[^_\n]+__(?!\w)"),
    "italic": re.compile(r"(?<![\w*\\])\*(?=\w)[^*\n]+(?<=\S)\*(?![\w*])|(?<![\w_/\\])_(?=\w)[^_\n]+(?<=\S)_(?![\w_])"),
    "strike": re.compile(r"~~(?=\S)[^~\n]+~~"),
    "code": re.compile(r"(?m)^\s*```|`[^`\n]+`"),
    "link": re.compile(r"!?\[[^\]\n]*\]\([^)\s]+\)"),
    "rule": re.compile(r"(?m)^\|?\s*:?-{3,}:?\s*(?:\|\s*:?-{3,}:?\s*)*\|?$"),
    "quote": re.compile(r"(?m)^> "),
    "list": re.compile(r"(?m)^[*+-] (?=[^\W\d_]).+\n[*+-] (?=[^\W\d_])"),
    "wiki heading": re.compile(r"(?m)^(={2,6})[^=\n]+\1\s*$"),
    "wiki quote": re.compile(r"'{2,5}(?=[^\s'])[^'\n]+'{2,5}"),
    "wiki link": re.compile(r"\[\[[^\]\n]+\]\]|\[https?://\S+[^\]\n]*\]|\{\{[^{}\n]+\}\}"),
    "wiki table": re.compile(r"(?m)^\{\|.*$|^\|\}|^\|-\s*$"),
    "latex": re.compile(rf"\\(?:{_COMMANDS})(?![A-Za-z])"),
    "latex accent": re.compile(r"\\['`^\"~=.]\{?\\?[A-Za-z]\}?|\\c\{"),
    "math": re.compile(r"\$\$|\$(?=[^\s\d$])[^$\n]+(?<=[^\s$])\$(?!\w)|\\\(|\\\["),
}
_MAYBE = re.compile(r"(?m)[<&#*_~`=\\$]|''|\{\{|\]\(|\[\[|\[https?:|^(?:> |\|)")
_ACCENT = re.compile(r"\\(['`^\"~=.])\s?(?:\{\\?([A-Za-z])\}|\\?([A-Za-z]))")
_COMBINING = {"'": "\u0301", "`": "\u0300", "^": "\u0302", '"': "\u0308", "~": "\u0303", "=": "\u0304", ".": "\u0307"}
_BLOCK = frozenset("p div section article main header footer nav aside ul ol li table tr td th blockquote pre h1 h2 h3 h4 h5 h6 dl dt dd body html form figure center line root".split())
_DROP = frozenset("script style head".split())
_VOID = frozenset("br hr img input link meta col".split())


def kinds(text: str) -> list[str]:
    """The kinds of marks that stand in a text."""
    if not _MAYBE.search(text) and not MARKS["list"].search(text):
        return []
    return [k for k, p in MARKS.items() if p.search(text)]


def unaccent(text: str) -> str:
    """LaTeX accents as letters."""

    def one(m: re.Match) -> str:
        return unicodedata.normalize("NFC", (m[2] or m[3]) + _COMBINING[m[1]])

    return re.sub(r"\\c\{([A-Za-z])\}", lambda m: unicodedata.normalize("NFC", m[1] + "\u0327"), _ACCENT.sub(one, text))


class Node:
    """An element of the tree; ``parts`` are texts and nodes in order."""

    def __init__(self, tag: str, parent: Node | None = None, order: int = 0) -> None:
        self.tag, self.parent, self.order = tag, parent, order
        self.parts: list[str | Node] = []
        self.score = 0.0
        self.marks: set[str] = set()

    def text(self) -> str:
        return "".join(p if isinstance(p, str) else p.text() for p in self.parts)

    def linked(self) -> int:
        """Characters inside links."""
        return len(self.text()) if self.tag == "a" else sum(p.linked() for p in self.parts if isinstance(p, Node))

    def walk(self):
        yield self
        for p in self.parts:
            if isinstance(p, Node):
                yield from p.walk()


#: Characters that stand for a mark while a text is read; those of the text itself are lifted out first.
_SIGN = {kind: chr(0xE100 + i) for i, kind in enumerate(MARKS)}
_KIND = {c: kind for kind, c in _SIGN.items()}
_SIGNS = re.compile("[\ue100-\ue1ff]")
_OWN = re.compile("[\ue000-\ue1ff]")
_SLOT = re.compile("\ue000(\\d+)\ue001")


class Lifted:
    """Pieces of a text that no reader may touch, each with a slot in its place."""

    def __init__(self) -> None:
        self.pieces: list[str] = []

    def put(self, piece: str) -> str:
        self.pieces.append(piece)
        return f"\ue000{len(self.pieces) - 1}\ue001"

    def back(self, text: str) -> str:
        while "\ue000" in text and (new := _SLOT.sub(lambda m: self.pieces[int(m[1])], text)) != text:
            text = new
        return text


class _Builder(HTMLParser):
    def __init__(self, lifted: Lifted) -> None:
        super().__init__(convert_charrefs=False)
        self.root = self.at = Node("root")
        self.count = 0
        self.lifted = lifted

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("p", "li", "tr", "td", "th") and self._open(tag):
            self._close(tag)
        node = self._node(tag, attrs)
        if tag not in _VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self._node(tag, attrs)

    def _node(self, tag: str, attrs: list) -> Node:
        self.count += 1
        node = Node(tag, self.at, self.count)
        if ("data-own", None) not in attrs:
            node.marks.add("html")
        self.at.parts.append(node)
        return node

    def handle_comment(self, data: str) -> None:
        self.at.marks.add("html")

    def handle_decl(self, decl: str) -> None:
        self.at.marks.add("html")

    def handle_entityref(self, name: str) -> None:
        self._entity(f"&{name};")

    def handle_charref(self, name: str) -> None:
        self._entity(f"&#{name};")

    def _entity(self, ref: str) -> None:
        self.at.marks.add("entity")
        self.at.parts.append(html.unescape(ref))

    def _open(self, tag: str) -> bool:
        """The element is open, with no list or table opened since."""
        node = self.at
        while node.parent and node.tag not in ("ul", "ol", "table"):
            if node.tag == tag:
                return True
            node = node.parent
        return False

    def handle_endtag(self, tag: str) -> None:
        if not self._close(tag):
            self.at.marks.add("html")

    def _close(self, tag: str) -> bool:
        node = self.at
        while node.parent and node.tag != tag:
            node = node.parent
        if node.parent:
            self.at = node.parent
        return node.parent is not None

    def handle_data(self, data: str) -> None:
        self.at.marks.update(_KIND[c] for c in _SIGNS.findall(data))
        self.at.parts.append(self.lifted.back(_SIGNS.sub("", data)))


def tree(markup: str, lifted: Lifted | None = None) -> Node:
    """The tree of an HTML text; lines of bare text directly under the root are paragraphs of their own."""
    builder = _Builder(lifted or Lifted())
    builder.feed(markup)
    builder.close()
    root = builder.root
    parts: list[str | Node] = []
    run: list[str | Node] = []

    def close() -> None:
        if run:
            p = Node("line", root, run[0].order if isinstance(run[0], Node) else 0)
            p.parts = list(run)
            for x in run:
                if isinstance(x, Node):
                    x.parent = p
            parts.append(p)
            run.clear()

    for part in root.parts:
        if isinstance(part, Node) and part.tag in _BLOCK | _DROP:
            close()
            parts.append(part)
        elif isinstance(part, str) and "\n" in part:
            first, *rest = part.split("\n")
            run.append(first)
            for line in rest:
                close()
                parts.append("\n")
                if line:
                    run.append(line)
        else:
            run.append(part)
    close()
    root.parts = parts
    return root


def link_density(node: Node) -> float:
    n = len(node.text().strip())
    return node.linked() / n if n else 0.0


def best(root: Node, share: float = 0.2) -> list[Node | str]:
    """What is kept, in order: the best container, and around it, level by level, bare text, headings, and siblings that
    score at least ``share`` of it or are no lists of links."""
    for node in root.walk():
        if node.tag in ("p", "line", "td", "pre", "blockquote", "li") and node.parent:
            text = node.text().strip()
            points = min(1.0, len(text) / 25.0) + text.count(",") + min(3.0, len(text) / 100.0)
            node.parent.score += points
            if node.parent.parent:
                node.parent.parent.score += points / 2
    scored = [n for n in root.walk() if n.score > 0 and n.tag in _BLOCK]
    for n in scored:
        n.score *= 1.0 - min(1.0, link_density(n))
    top = max(scored, key=lambda n: (n.score, -n.order)) if scored else root
    kept: list[Node | str] = [top]
    at = top
    while at.parent:
        around = at.parent.parts
        k = next(i for i, p in enumerate(around) if p is at)
        kept = [p for p in around[:k] if _beside(p, top, share)] + kept + [p for p in around[k + 1 :] if _beside(p, top, share)]
        at = at.parent
    return kept


def _beside(part: Node | str, top: Node, share: float) -> bool:
    if isinstance(part, str) or part.tag not in _BLOCK or part.score >= share * top.score > 0:
        return True
    return part.tag[:1] == "h" and part.tag[1:].isdigit() or link_density(part) < 0.25


def _write(node: Node, out: list[str]) -> None:
    """Plain text of a node; ``out`` is joined at the end, ``\\n`` marks ends of lines."""
    tag = node.tag
    if tag in _DROP or tag == "img":
        return
    if tag == "br":
        out.append("\n")
        return
    if tag == "hr":
        out.append("\n")
        return
    if tag == "pre":
        out.append("\n" + "\n".join("    " + x for x in node.text().strip("\n").split("\n")) + "\n")
        return
    if tag == "tr":
        cells = [" ".join(plain(c).split()) for c in node.parts if isinstance(c, Node) and c.tag in ("td", "th")]
        out.append("\n" + " | ".join(cells) + "\n")
        return
    if tag == "ref":
        inner = node.text().strip()
        if inner:
            out.append(f" ({inner})")
        return
    block = tag in _BLOCK and tag != "root"
    if block:
        out.append("\n\n" if tag in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "table", "blockquote", "div") else "\n")
    if tag == "li":
        out.append("• ")
    for p in node.parts:
        if isinstance(p, str):
            out.append(p)
        else:
            _write(p, out)
    if block:
        out.append("\n")


def plain(node: Node | str) -> str:
    if isinstance(node, str):
        return node
    out: list[str] = []
    _write(node, out)
    return "".join(out)


# -- readers: each turns its language into the common one, elements and signs of marks, and leaves the rest alone

_H2, _H2_END = "<h2 data-own>", "</h2>"
_FENCE = re.compile(r"(?ms)^[ \t]*```[^\n]*\n?(.*?)(?:^[ \t]*```[ \t]*$|\Z)")
_INLINE_CODE = re.compile(r"`([^`\n]+)`")
_PRE = re.compile(r"(?is)(<(pre|code|nowiki|kbd|samp)(?! data-own)(?:\s[^<>]*)?>)(.*?)(</\2\s*>)")
_FORMULA = re.compile(r"\$\$\s*([^$]+?)\s*\$\$|\$(?=[^\s\d$])([^$\n]+)(?<=[^\s$])\$(?!\w)|\\\((.+?)\\\)|\\\[(.+?)\\\]", re.S)
_SIGNED = (("leq", "≤"), ("geq", "≥"), ("neq", "≠"), ("times", "×"), ("cdot", "·"), ("ldots", "…"), ("dots", "…"), ("quad", " "))


def _lift(text: str, found: set[str], lifted: Lifted) -> str:
    """Code and formulas out of the way, with the sign of their mark left beside the slot."""
    if _OWN.search(text):
        text = _OWN.sub(lambda m: lifted.put(m.group()), text)
    if "code" in found:
        text = _FENCE.sub(lambda m: f"<pre data-own>{_SIGN['code']}{lifted.put(m[1].rstrip(chr(10)))}</pre>\n", text)
        text = _INLINE_CODE.sub(lambda m: _SIGN["code"] + lifted.put(m[1]), text)
    if "html" in found:
        text = _PRE.sub(lambda m: m[1] + lifted.put(html.unescape(re.sub(rf"</?(?:{_TAGS})(?:\s[^<>]*)?/?>", "", m[3], flags=re.I))) + m[4], text)
    if "math" in found:

        def formula(m: re.Match) -> str:
            inner = next(g for g in m.groups() if g is not None)
            return _SIGN["math"] + (_SIGN["latex"] if MARKS["latex"].search(inner) else "") + lifted.put(_formula(inner))

        text = _FORMULA.sub(formula, text)
        text = re.sub(r"\$\$|\\[()\[\]]", _SIGN["math"], text)
    return text


def _formula(text: str) -> str:
    """A formula with its commonest commands as signs; the rest stays as written."""
    text = re.sub(r"\\d?frac\{([^{}]*)\}\{([^{}]*)\}", r"(\1)/(\2)", text)
    text = re.sub(r"\\sqrt\{([^{}]*)\}", r"√(\1)", text)
    text = re.sub(r"\\(?:left|right)(?![A-Za-z])", "", text)
    for name, sign in _SIGNED:
        text = re.sub(rf"\\{name}(?![A-Za-z])", sign, text)
    return re.sub(r"\\([%&$#_])", r"\1", text)


def _latex(text: str) -> str:
    sign = _SIGN["latex"]
    if MARKS["latex accent"].search(text):
        text = _ACCENT.sub(lambda m: _SIGN["latex accent"] + m.group(), re.sub(r"\\c\{", lambda m: _SIGN["latex accent"] + m.group(), text))
        text = unaccent(text)
    text = MARKS["latex"].sub(lambda m: sign + m.group(), text)
    text = re.sub(r"\\(?:part|chapter|(?:sub)*section|(?:sub)?paragraph|title)\*?\{([^{}]*)\}", rf"{_H2}\1{_H2_END}", text)
    text = re.sub(r"\\footnote\{([^{}]*)\}", r" (\1)", text)
    text = re.sub(r"\\href\{[^{}]*\}\{([^{}]*)\}", r"\1", text)
    text = re.sub(r"\\url\{([^{}]*)\}", r"\1", text)
    text = re.sub(r"\\d?frac\{([^{}]*)\}\{([^{}]*)\}", r"(\1)/(\2)", text)
    text = re.sub(r"\\sqrt\{([^{}]*)\}", r"√(\1)", text)

    def tabular(m: re.Match) -> str:
        rows = [r for r in re.split(r"\\\\", m[1].replace("\\hline", "")) if _SIGNS.sub("", r).strip()]
        return sign + "\n".join(" | ".join(" ".join(c.split()) for c in re.split(r"(?<!\\)&", r)) for r in rows) + "\n"

    text = re.sub(r"(?s)\\begin\{(?:tabular|array|longtable)\*?\}(?:\{[^{}]*\})?(.*?)[\ue100-\ue1ff]?\\end\{(?:tabular|array|longtable)\*?\}", tabular, text)
    text = re.sub(r"\s*[\ue100-\ue1ff]?\\item(?:\[([^\]]*)\])?\s*", lambda m: f"\n{sign}• " + (m[1] + " " if m[1] else ""), text)
    text = re.sub(r"\\(?:begin|end)\{[^{}]*\}(?:\[[^\]]*\])?\n?", "", text)
    for _ in range(3):
        text = re.sub(r"\\(?:text\w+|emph|underline|mbox|caption|author|date)\{([^{}]*)\}", r"\1", text)
    text = re.sub(r"\\(?:cite|label|ref|usepackage|documentclass|includegraphics|[hv]space)\*?(?:\[[^\]]*\])?\{[^{}]*\}", "", text)
    text = re.sub(r"\\(?:hline|newline|linebreak|noindent|par|centering|maketitle|left|right|bf|it)(?![A-Za-z])\s?", "", text)
    for name, glyph in _SIGNED:
        text = re.sub(rf"\\{name}(?![A-Za-z])", glyph, text)
    text = re.sub(r"\\\\\s*$|\\\\(?=\n)", "", text)
    text = re.sub(r"\\([%&$#_{}])", r"\1", text)
    return re.sub(r"(?<=\w|[.,;])~(?=\s|\w)", " ", text).replace("  ", " ")


def _headings(text: str, found: set[str]) -> str:
    """Headings of Markdown and wiki; in a wiki text neighbouring lines with one # are a numbered list."""
    lines = text.split("\n")
    numbered = [bool(found & _WIKI) and x.startswith("# ") for x in lines]
    for k, line in enumerate(lines):
        if "heading" in found and (m := re.fullmatch(r"#{1,6} +(.+?)(?: +#+)?\s*", line)):
            if not (numbered[k] and (k and numbered[k - 1] or k + 1 < len(lines) and numbered[k + 1])):
                lines[k] = f"{_H2}{_SIGN['heading']}{m[1]}{_H2_END}"
            else:
                lines[k] = f"{_SIGN['heading']}• {m[1]}"
        elif "wiki heading" in found and (m := re.fullmatch(r"(={2,6})\s*([^=\n]+?)\s*\1\s*", line)):
            lines[k] = f"{_H2}{_SIGN['wiki heading']}{m[2]}{_H2_END}"
    return "\n".join(lines)


_WIKI = frozenset(("wiki heading", "wiki quote", "wiki link", "wiki table"))
_DOWN = frozenset(("bold", "italic", "strike", "link", "rule", "quote", "list"))


def _wiki(text: str) -> str:
    def table(m: re.Match) -> str:
        rows = []
        for row in re.split(r"(?m)^\|-.*$", m[1]):
            cells = [" ".join(c.split()) for line in row.split("\n") if line[:1] in "|!" and line[1:2] not in "+}" for c in re.split(r"\|\||!!", line[1:])]
            if cells:
                rows.append(" | ".join(c.split("|")[-1].strip() for c in cells))
        return _SIGN["wiki table"] + "\n".join(rows) + "\n"

    text = re.sub(r"(?ms)^\{\|[^\n]*\n(.*?)^\|\}", table, text)
    text = MARKS["wiki table"].sub(_SIGN["wiki table"], text)
    text = re.sub(r"'{2,5}((?=[^\s'])[^'\n]+?)'{2,5}", rf"{_SIGN['wiki quote']}\1", text)
    sign = _SIGN["wiki link"]
    text = re.sub(r"\[\[(?:[^|\]\n]*\|)?([^\]\n]+)\]\]", rf"{sign}\1", text)
    text = re.sub(r"\[https?://\S+?(?:\s+([^\]\n]*))?\]", lambda m: sign + (m[1] or ""), text)
    text = re.sub(r"\{\{(?:[^{}|\n]*\|)*([^{}|\n]*)\}\}", rf"{sign}\1", text)
    bullet = (_SIGN["list"] if MARKS["list"].search(text) else "") + "• "
    return re.sub(r"(?m)^[*#:;]+ +(?=\S)", bullet, text)


def _markdown(text: str) -> str:
    lines = text.split("\n")
    table = any(MARKS["rule"].fullmatch(x) and "|" in x for x in lines)
    bullets = {i for m in MARKS["list"].finditer(text) for i in (text.count("\n", 0, m.start()),)} if MARKS["list"].search(text) else set()
    for k, line in enumerate(lines):
        if MARKS["rule"].fullmatch(line):
            lines[k] = _SIGN["rule"]
            continue
        if line.startswith("|") and line.rstrip().endswith("|") and (table or line.count("|") > 2):
            line = " | ".join(c.strip() for c in line.strip().strip("|").split("|"))
        line = re.sub(r"^> ?", _SIGN["quote"] if line.startswith("> ") else "", line)
        line = re.sub(r"^[*+-] (?=\S)(?!\d+ -$)", (_SIGN["list"] if k in bullets else "") + "• ", line)
        line = re.sub(r"!?\[([^\]\n]*)\]\([^)\s]+\)", rf"{_SIGN['link']}\1", line)
        line = re.sub(r"\*\*((?=[^\s*])[^*\n]+)\*\*|(?<!\w)__((?=[^\s_])[^_\n]+)__(?!\w)", lambda m: _SIGN["bold"] + (m[1] or m[2]), line)
        line = MARKS["italic"].sub(lambda m: _SIGN["italic"] + m.group()[1:-1], line)
        lines[k] = re.sub(r"~~((?=\S)[^~\n]+)~~", rf"{_SIGN['strike']}\1", line)
    return "\n".join(lines)


def read(text: str) -> Node | None:
    """The tree of a text, its nodes with the marks they were made from; None where nothing could be a mark."""
    found = set(kinds(text))
    if not found:
        return None
    lifted = Lifted()
    text = _lift(text, found, lifted)
    if found & {"latex", "latex accent"}:
        text = _latex(text)
    if found & {"heading", "wiki heading"}:
        text = _headings(text, found)
    if found & _WIKI:
        text = _wiki(text)
    if found & _DOWN:
        text = _markdown(text)
    text = re.sub(rf"<(?!/?(?:{_TAGS})(?:\s[^<>]*)?/?>|!--|!DOCTYPE)", lambda m: lifted.put("<"), text, flags=re.I)
    text = re.sub(r"&(?!(?:[A-Za-z][A-Za-z0-9]{1,8}|#\d{1,6}|#[xX][0-9A-Fa-f]{1,5});)", lambda m: lifted.put("&"), text)
    return tree(text, lifted)


def marks_of(root: Node | None) -> list[str]:
    """Kinds of the marks that the nodes of a tree carry."""
    return sorted(set().union(*(n.marks for n in root.walk()))) if root else []


def clean(text: str) -> str:
    """The text without its marks."""
    root = read(text)
    return write(root) if marks_of(root) else text


def write(root: Node) -> str:
    body = "".join(plain(n) for n in best(root))
    lines = [x.rstrip() if x.startswith("    ") else " ".join(x.split()) for x in body.replace("\xa0", " ").split("\n")]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip("\n")


def clean_texts(chunks: DataFrame, pasajes: DataFrame) -> DataFrame:
    """(tabla, clave, marcas, limpio) of each text that holds markup."""

    def run(cols: list[list]) -> list[list]:
        out: list[list] = [[], [], [], []]
        for tabla, clave, value in zip(*cols):
            text = text_of(tabla, value)
            root = read(text) if text else None
            found = marks_of(root)
            if found:
                for col, v in zip(out, (tabla, clave, found, write(root))):
                    col.append(v)
        return out

    return map_arrow(keyed_texts(chunks, pasajes), "tabla string, clave string, marcas array<string>, limpio string", run)


def found(chunks: DataFrame, pasajes: DataFrame) -> DataFrame:
    return clean_texts(chunks, pasajes).select("tabla", "clave").distinct()
