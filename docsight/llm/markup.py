"""Markup residue: clean text from HTML, Markdown, wiki text and LaTeX that keeps headings, lists, code and formulas.

``convert`` scans a text once for every kind of markup, on a copy in which what has been recognised is
blanked out, so code and formulas are never read as markup. Each recognised span has the kinds of markup
it can belong to, an element and a replacement. A span that fits several kinds (``* `` is a list in Markdown and in
wiki text, ``$x$`` a formula in Markdown and in LaTeX) goes to the kind of the nearest span that fits one only.

``page_difference`` is the other way to clean pages: lines that a page shares with its nearest
neighbour by URL path are boilerplate. It does not tell kinds of markup, so it cannot stand in for ``convert``.
"""

from __future__ import annotations

import re
import textwrap
from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsight.runtime import checkpoint

HTML, MARKDOWN, WIKI, LATEX = "html", "markdown", "wiki", "latex"
HEADING, LIST, CODE, FORMULA, OTHER = "heading", "list", "code", "formula", "other"

#: Which HTML tags make which element; all other tags are "other".
_TAGS = {HEADING: "h1 h2 h3 h4 h5 h6", LIST: "ul ol li dl dt dd dir menu", CODE: "pre code samp kbd tt", FORMULA: "math"}
_TAG_ELEMENT = {t: e for e, ts in _TAGS.items() for t in ts.split()}
_BLOCK_TAGS = frozenset("p div br tr table ul ol dl hr body html section article header footer page".split())
#: Named character entities that filings use, and LaTeX commands by element.
_ENTITIES = dict(amp="&", lt="<", gt=">", quot='"', apos="'", nbsp=" ", mdash="\u2014", ndash="\u2013", rsquo="\u2019", lsquo="\u2018", rdquo="\u201d", ldquo="\u201c", bull="\u2022", hellip="\u2026", euro="\u20ac", sect="\u00a7", copy="\u00a9", reg="\u00ae", trade="\u2122", middot="\u00b7", ensp=" ", emsp=" ", thinsp=" ", shy="")
_TEX_HEADINGS = "part|chapter|section|subsection|subsubsection|paragraph|subparagraph"
_TEX_MATH = "equation|align|gather|multline|eqnarray|displaymath|math"
_TEX_DROP = "documentclass|usepackage|label|ref|eqref|pageref|cite|citep|citet|bibliographystyle|bibliography|pagestyle|thispagestyle|vspace|hspace|include|input"

_ANY = re.compile(r"[<>\\{}\[\]|*_~`#$&]|''|^-{3}|^={2}|^(?: {4}|\t)|^[ \t]*(?:[-+]|\d{1,3}[.)])[ \t]", re.M)
_FENCE = re.compile(r"^[ \t]*(```+|~~~+)[ \t]*[\w+-]*[ \t]*\r?\n(.*?)(?:^[ \t]*\1[ \t\r]*$|\Z)", re.M | re.S)
_INDENTED = re.compile(r"(?:\A|(?<=\n\n)|(?<=\n\r\n))(?:(?: {4}|\t)[^\n]*\S[^\n]*(?:\n|\Z)(?:[ \t\r]*\n(?= {4}|\t))?)+")
_HTML_CODE = re.compile(r"<(pre|code|samp|kbd|tt)\b[^<>]*>(.*?)</\1\s*>", re.I | re.S)
_WIKI_CODE = re.compile(r"<(syntaxhighlight|source)\b[^<>]*>(.*?)</\1\s*>", re.I | re.S)
_TEX_CODE = re.compile(r"\\begin\{(verbatim\*?|lstlisting|minted|alltt)\}(?:\[[^\]\n]*\])?(.*?)\\end\{\1\}", re.S)
_TICKS = re.compile(r"(?<!`)`([^`\n]+)`(?!`)")
_MATH_TAG = re.compile(r"<math\b[^<>]*>(.*?)</math\s*>", re.I | re.S)
_DISPLAY = re.compile(r"(?<!\\)\$\$(.+?)(?<!\\)\$\$", re.S)
_INLINE = re.compile(r"(?<![\\\w$])\$(?![\d\s$])([^$\n]*[\\^_=][^$\n]*)(?<![\s\\])\$(?![\d$])")
_TEX_PAREN = re.compile(r"\\\((.+?)\\\)|\\\[(.+?)\\\]", re.S)
_TEX_ENV = re.compile(rf"\\begin\{{((?:{_TEX_MATH})\*?)\}}(.*?)\\end\{{\1\}}", re.S)
_COMMENT = re.compile(r"<!--.*?(?:-->|\Z)", re.S)
_REF = re.compile(r"<ref\b[^<>]*/>|<ref\b[^<>]*>.*?</ref\s*>|</?ref\b[^<>]*>", re.I | re.S)
_TAG = re.compile(r"</?([A-Za-z][A-Za-z0-9:-]*)(?:\s[^<>]*|/)?>|<(?:!DOCTYPE|\?xml)[^<>]*>")
_ENTITY = re.compile(r"&(?:amp;)*(#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,9});")
_WIKI_HEAD = re.compile(r"^(={2,6})[ \t]*([^=\n][^\n]*?)[ \t]*\1[ \t]*\r?$", re.M)
_WIKI_TABLE = re.compile(r"^[ \t]*\{\|.*?(?:^[ \t]*\|\}|\Z)", re.M | re.S)
_WIKI_ROW = re.compile(r"^[ \t]*\|(?:[-}+].*|[^|\n]*\|\|.*)$|^[ \t]*![^\n]*!![^\n]*$", re.M)
_WIKI_LINK = re.compile(r"\[\[(?:[^\[\]|\n]*\|)?([^\[\]|\n]*)\]\]")
_TEMPLATE = re.compile(r"\{\{[^{}]*\}\}")
_WIKI_URL = re.compile(r"(?<!\])\[(?:https?|ftp)://[^\s\]]+(?:\s+([^\]\n]*))?\](?!\()")
_QUOTES = re.compile(r"'{2,5}")
_MD_LINK = re.compile(r"!?\[([^\[\]\n]*)\]\(([^()\n]*)\)")
_MD_NOTE = re.compile(r"^\[\^[\w-]+\]:[ \t]*|\[\^[\w-]+\]|^\[[^\]\n]+\]:[ \t]+\S+.*$", re.M)
_MD_TABLE = re.compile(r"^[ \t]*\|?[ \t]*:?-{3,}:?[ \t]*(?:\|[ \t]*:?-{2,}:?[ \t]*)+\|?[ \t\r]*$", re.M)
_MD_ROW = re.compile(r"^[ \t]*\|(?!\|).*\|[ \t\r]*$", re.M)
_MD_QUOTE = re.compile(r"^[ \t]*>[ \t]?(?=\S)", re.M)
_MD_STRONG = re.compile(r"(\*\*|__|~~)(?=[^\s*_~])([^\n]*?[^\s*_~\\])\1")
_MD_EM = re.compile(r"(?<![\w*\\])([*])(?=[^\s*])([^*\n]*?[^\s*])\1(?![\w*])|(?<![\w_\\])(_)(?=[^\s_])([^_\n]*?[^\s_])\3(?![\w_])")
_MD_ESCAPE = re.compile(r"\\([*_`\[\]#~>|.!+-])")
_SETEXT = re.compile(r"^[ \t]*(?=\S)(?![-=*#>|{+]|\d+[.)]\s)([^\n]*[^\s\n])[ \t]*\r?\n(=+|-+)[ \t]*\r?$", re.M)
_HASH = re.compile(r"^(#{1,6})([ \t]*)(?=[^\s#])", re.M)
_STAR = re.compile(r"^([ \t]*)(\*+)([ \t]*)(?=[^\s*])", re.M)
_DASH = re.compile(r"^[ \t]*[-+][ \t]+(?=\S)(?!\d+[ \t]+-[ \t]*\r?$)", re.M)
_NUMBER = re.compile(r"^[ \t]*(\d{1,3})[.)][ \t]+(?=\S)", re.M)
_COLON = re.compile(r"^([:;]+)[ \t]*(?=\S)", re.M)
_TEX_HEAD = re.compile(rf"\\(?:{_TEX_HEADINGS})\*?(?:\[[^\]\n]*\])?\{{([^{{}}\n]*(?:\{{[^{{}}\n]*\}}[^{{}}\n]*)*)\}}")
_TEX_LIST = re.compile(r"[ \t]*\\(begin|end)\{(itemize|enumerate|description)\}(?:\[[^\]\n]*\])?[ \t]*\n?|\\item\b(?:\[[^\]\n]*\])?[ \t]*")
_TEX_TABULAR = re.compile(r"\\(?:begin|end)\{[A-Za-z]+\*?\}(?:\[[^\]\n]*\])?(?:\{[^{}\n]*\})?")
_TEX_NOTE = re.compile(r"\\footnote(?:text)?\{([^{}]*)\}")
_TEX_GONE = re.compile(rf"~?\\(?:{_TEX_DROP})\*?(?:\[[^\]\n]*\])?\{{[^{{}}\n]*\}}")
_TEX_WORD = re.compile(r"\\([A-Za-z]{2,})\*?(?:\[[^\]\n]*\])?(\{)?")
_TEX_SIGN = re.compile(r"\\([%$&#_{}])|\\\\(?:\[[^\]\n]*\])?|(?<=[\w.])~(?=\\|\w)")


class _Scan:
    def __init__(self, text: str):
        self.text, self.left = text, text
        self.spans: list[tuple[int, int, tuple[str, ...], tuple[str, ...], str]] = []

    def add(self, a: int, b: int, kinds: tuple[str, ...] | str, elements: tuple[str, ...] | str, new: str, blank: bool = True) -> None:
        kinds = (kinds,) if isinstance(kinds, str) else kinds
        elements = (elements,) * len(kinds) if isinstance(elements, str) else elements
        self.spans.append((a, b, kinds, elements, new))
        if blank:
            self.blank.append((a, b))

    def each(self, pattern: re.Pattern, act) -> None:
        """Apply ``act`` to the matches of what is left, then blank out what it added."""
        self.blank: list[tuple[int, int]] = []
        for m in pattern.finditer(self.left):
            act(m)
        if self.blank:
            parts, at = [], 0
            for a, b in sorted(self.blank):
                if a >= at:
                    hole = self.left[a:b]
                    parts += [self.left[at:a], " " * len(hole) if "\n" not in hole else re.sub(r"[^\n]", " ", hole)]
                    at = b
            self.left = "".join(parts) + self.left[at:]

    def block(self, m: re.Match, kinds, element: str, body: str) -> None:
        tail = "\n" if m[0].endswith("\n") else ""
        body = body.strip("\r\n")
        new = (f"```\n{body}\n```" if "\n" in body.strip() or element == CODE and "\n" in m[0] else f"`{body.strip()}`") if element == CODE else f"${' '.join(body.split())}$"
        self.add(m.start(), m.end(), kinds, element, new + tail)

    def around(self, m: re.Match, inner: int, kinds, element: str, left: str = "", right: str = "") -> None:
        """Both ends of a match go, its inner group stays open for other markup."""
        a, b = m.span(inner)
        self.add(m.start(), a, kinds, element, left)
        self.add(b, m.end(), kinds, element, right)


_MD_OR_TEX = (MARKDOWN, LATEX)
_MD_OR_WIKI = (MARKDOWN, WIKI)


def _formulas_and_code(s: _Scan, t: str) -> None:
    if "`" in t or "~~~" in t:
        s.each(_FENCE, lambda m: s.block(m, MARKDOWN, CODE, m[2]))
    if "<" in t:
        s.each(_WIKI_CODE, lambda m: s.block(m, WIKI, CODE, m[2]))
        s.each(_HTML_CODE, lambda m: s.block(m, HTML, CODE, _unescape(_TAG.sub("", m[2]))))
    if "\\begin{" in t:
        s.each(_TEX_CODE, lambda m: s.block(m, LATEX, CODE, m[2]))
        s.each(_TEX_ENV, lambda m: s.block(m, LATEX, FORMULA, m[2]))
    if "\n    " in s.left or "\n\t" in s.left or t[:1] in " \t":
        s.each(_INDENTED, lambda m: s.block(m, MARKDOWN, CODE, textwrap.dedent(m[0].expandtabs(4))))
    if "`" in s.left:
        s.each(_TICKS, lambda m: s.block(m, MARKDOWN, CODE, m[1]))
    if "<math" in t or "<MATH" in t:
        s.each(_MATH_TAG, lambda m: s.block(m, HTML if re.search(r"<m[a-z]+", m[1]) else WIKI, FORMULA, _TAG.sub(" ", m[1])))
    if "$" in s.left:
        s.each(_DISPLAY, lambda m: s.block(m, _MD_OR_TEX, FORMULA, m[1]))
        s.each(_INLINE, lambda m: s.block(m, _MD_OR_TEX, FORMULA, m[1]))
    if "\\" in s.left:
        s.each(_TEX_PAREN, lambda m: s.block(m, _MD_OR_TEX, FORMULA, m[1] or m[2]))


def _unescape(text: str) -> str:
    return _ENTITY.sub(lambda m: _entity(m[1]) if _entity(m[1]) is not None else m[0], text)


def _entity(name: str) -> str | None:
    if name[0] == "#":
        try:
            return chr(int(name[2:], 16) if name[1] in "xX" else int(name[1:])).replace("\xa0", " ")
        except (ValueError, OverflowError):
            return None
    return _ENTITIES.get(name)


def _tags(s: _Scan) -> None:
    def tag(m: re.Match) -> None:
        name = (m[1] or "!doctype").lower()
        new = ""
        element = _TAG_ELEMENT.get(name, OTHER)
        opening = m[0][1] != "/"
        if element == HEADING:
            new = "#" * int(name[1]) + " " if opening else ""
        elif name == "li" and opening:
            new = "- "
        elif name in ("td", "th"):
            new = "" if opening else " "
        elif name in _BLOCK_TAGS and not opening or name == "br":
            new = "\n"
        s.add(m.start(), m.end(), WIKI if name in ("ref", "syntaxhighlight", "nowiki", "gallery", "references") else HTML, CODE if name == "syntaxhighlight" else element, new)

    s.each(_COMMENT, lambda m: s.add(m.start(), m.end(), (HTML, WIKI), OTHER, ""))
    s.each(_REF, lambda m: s.add(m.start(), m.end(), WIKI, OTHER, ""))
    s.each(_TAG, tag)


def _latex(s: _Scan) -> None:
    s.each(_TEX_HEAD, lambda m: s.around(m, 1, LATEX, HEADING, "## "))
    s.each(_TEX_LIST, lambda m: s.add(m.start(), m.end(), LATEX, LIST, "" if m[1] else "- "))
    s.each(_TEX_TABULAR, lambda m: s.add(m.start(), m.end(), LATEX, OTHER, ""))
    s.each(_TEX_NOTE, lambda m: s.around(m, 1, LATEX, OTHER, " (", ")"))
    s.each(_TEX_GONE, lambda m: s.add(m.start(), m.end(), LATEX, OTHER, ""))

    def word(m: re.Match) -> None:
        s.add(m.start(), m.end(), LATEX, OTHER, "")
        if m[2]:
            depth, at = 1, m.end()
            while at < len(s.left) and depth and s.left[at] != "\n":
                depth += (s.left[at] == "{") - (s.left[at] == "}")
                at += 1
            if not depth:
                s.add(at - 1, at, LATEX, OTHER, "")

    s.each(_TEX_WORD, word)
    s.each(_TEX_SIGN, lambda m: s.add(m.start(), m.end(), LATEX, OTHER, m[1] or (" " if m[0] == "~" else "\n")))


def _wiki(s: _Scan, t: str) -> None:
    if "==" in t:
        s.each(_WIKI_HEAD, lambda m: s.around(m, 2, WIKI, HEADING, "#" * len(m[1]) + " "))
    if "{|" in t or "||" in t:
        s.each(_WIKI_TABLE, lambda m: s.add(m.start(), m.end(), WIKI, OTHER, _cells(m[0])))
        s.each(_WIKI_ROW, lambda m: s.add(m.start(), m.end(), WIKI, OTHER, _cells(m[0])))
    if "{{" in t:
        s.each(_TEMPLATE, lambda m: s.add(m.start(), m.end(), WIKI, OTHER, ""))
    if "[[" in t:
        s.each(_WIKI_LINK, lambda m: s.around(m, 1, WIKI, OTHER))
    if "://" in t and "[" in t:
        s.each(_WIKI_URL, lambda m: s.add(m.start(), m.end(), WIKI, OTHER, m[1] or ""))
    if "''" in t:
        s.each(_QUOTES, lambda m: s.add(m.start(), m.end(), WIKI, OTHER, ""))


def _cells(text: str) -> str:
    rows = (re.sub(r"\s*(?:\|\||!!|\|)\s*", " ", line).strip() for line in text.split("\n") if not re.match(r"\s*(?:\{\||\|[-}])", line))
    return "\n".join(r for r in rows if r)


def _markdown(s: _Scan, t: str) -> None:
    if "](" in t:
        s.each(_MD_LINK, lambda m: s.around(m, 1, MARKDOWN, OTHER))
    if "[" in t:
        s.each(_MD_NOTE, lambda m: s.add(m.start(), m.end(), MARKDOWN, OTHER, ""))
    if "|" in s.left:
        s.each(_MD_TABLE, lambda m: s.add(m.start(), m.end(), MARKDOWN, OTHER, ""))
        if any(k == (MARKDOWN,) and new == "" and e[0] == OTHER and "|" in t[a:b] for a, b, k, e, new in s.spans) or s.left.count("|") >= 3:
            s.each(_MD_ROW, lambda m: s.add(m.start(), m.end(), MARKDOWN, OTHER, _cells(m[0])))
    if ">" in s.left:
        s.each(_MD_QUOTE, lambda m: s.add(m.start(), m.end(), MARKDOWN, OTHER, ""))
    if "\n---" in t or "\n===" in t or "\n--" in t:
        s.each(_SETEXT, lambda m: _setext(s, m))
    if "#" in s.left:
        s.each(_HASH, lambda m: s.add(m.start(), m.end(), (WIKI, MARKDOWN) if m[2] else WIKI, (LIST, HEADING) if m[2] else LIST, "\0"))
    if "*" in s.left:
        if s.left.lstrip("\n").startswith("*") or "\n*" in s.left or "\n " in s.left:
            s.each(_STAR, lambda m: _star(s, m))
    s.each(_DASH, lambda m: s.add(m.start(), m.end(), MARKDOWN, LIST, "- "))
    numbers = [(m.start(), m.end(), int(m[1])) for m in _NUMBER.finditer(s.left)]
    near = [k for k, (a, b, n) in enumerate(numbers) if any(0 <= j < len(numbers) and numbers[j][2] == n + j - k and "\n\n\n" not in s.left[min(a, numbers[j][0]) : max(b, numbers[j][1])] for j in (k - 1, k + 1))]
    s.blank = []
    for k in near:
        a, b, _ = numbers[k]
        s.add(a, b, MARKDOWN, LIST, s.text[a:b])
    if "**" in s.left or "__" in s.left or "~~" in s.left:
        s.each(_MD_STRONG, lambda m: s.around(m, 2, MARKDOWN, OTHER))
    if "*" in s.left or "_" in s.left:
        s.each(_MD_EM, lambda m: s.around(m, 2 if m[1] else 4, MARKDOWN, OTHER))
    if "\\" in s.left:
        s.each(_MD_ESCAPE, lambda m: s.add(m.start(), m.end(), MARKDOWN, OTHER, m[1]))
    if any(WIKI in k for _, _, k, _, _ in s.spans):
        s.each(_COLON, lambda m: s.add(m.start(), m.end(), WIKI, LIST, "- "))


def _setext(s: _Scan, m: re.Match) -> None:
    if len(m[2]) >= 3:
        s.add(m.start(1), m.start(1), MARKDOWN, HEADING, "# " if m[2][0] == "=" else "## ")
        s.add(m.end(1), m.end(), MARKDOWN, HEADING, "")


def _star(s: _Scan, m: re.Match) -> None:
    line = s.left[m.end() : s.left.find("\n", m.end()) if "\n" in s.left[m.end() :] else len(s.left)]
    if m[3]:
        s.add(m.start(), m.end(), _MD_OR_WIKI, LIST, "- ")
    elif "*" not in line and not m[1]:
        s.add(m.start(), m.end(), WIKI, LIST, "- ")


def _resolve(spans: list) -> list[tuple[int, int, str, str, str]]:
    """Every span with one kind: its own, or that of the nearest span that has one only."""
    sure = sorted((a, k[0]) for a, _, k, _, _ in spans if len(k) == 1)
    by_kind = {k: [a for a, x in sure if x == k] for k in (HTML, MARKDOWN, WIKI, LATEX)}
    marks = sum(1 for x in spans if x[2] == (WIKI, MARKDOWN))
    out = []
    # Lists and headings first: what they turn out to be tells the kind of the formulas around them.
    for a, b, kinds, elements, new in sorted(spans, key=lambda x: (x[3][0] == FORMULA, x[0])):
        if len(kinds) == 1:
            kind, element = kinds[0], elements[0]
        else:
            def away(k: str) -> float:
                at = by_kind[k]
                j = bisect_left(at, a)
                return min((abs(at[x] - a) for x in (j - 1, j) if 0 <= x < len(at)), default=float("inf"))

            best = min(kinds, key=away)
            if away(best) == float("inf"):
                rest = [k for k in (HTML, WIKI) if by_kind[k]]
                if elements[0] == FORMULA and rest:
                    best = min(rest, key=away)
                elif kinds == (WIKI, MARKDOWN):
                    best = WIKI if marks > 2 else MARKDOWN
                else:
                    best = {FORMULA: LATEX, LIST: MARKDOWN}.get(elements[0], HTML)
            kind = best
            element = elements[kinds.index(kind)] if kind in kinds else elements[0]
            if element != FORMULA:
                insort(by_kind[kind], a)
        if new == "\0":
            new = "# " if element == HEADING else "- "
        out.append((a, b, kind, element, new))
    return out


def convert(text: str | None) -> tuple[str | None, list[tuple[str, str]]]:
    """The clean text, and the sorted (markup, element) pairs that occur in the text.

    In the clean text a heading begins with ``#`` signs, a list item with ``- `` or its number, code stands between
    backticks and a formula between dollar signs; everything else is plain. Null gives null. Rule lines
    between blank lines and page numbers stay as they are.
    """
    if text is None or not _ANY.search(text):
        return text, []
    s = _Scan(text)
    _formulas_and_code(s, text)
    if "<" in s.left:
        _tags(s)
    if "&" in s.left:
        s.each(_ENTITY, lambda m: s.add(m.start(), m.end(), HTML, OTHER, _entity(m[1])) if _entity(m[1]) is not None else None)
    if "\\" in s.left:
        _latex(s)
    _wiki(s, s.left)
    _markdown(s, s.left)
    if not s.spans:
        return text, []
    parts, at = [], 0
    spans = _resolve(s.spans)
    latex = [a for a, _, k, _, _ in spans if k == LATEX]
    for a, b, _, _, new in sorted(spans, key=lambda x: (x[0], x[1])):
        if a >= at:
            parts += [text[at:a], new]
            at = b
    clean = "".join(parts) + text[at:]
    pieces = re.split(r"(```\n.*?\n```|`[^`\n]+`)", clean, flags=re.S)  # every second one is code and stays as it is
    for k in range(0, len(pieces), 2):
        if latex:
            pieces[k] = re.sub(r"[ \t]+&[ \t]+", " ", pieces[k])
        pieces[k] = re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+\n", "\n", re.sub(r"(?<=\S)[ \t]{2,}", " ", pieces[k])))
    return "".join(pieces).strip(), sorted({(k, e) for _, _, k, e, _ in spans})


def clean_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, found array<struct<markup, element>>): ``convert`` over whole texts.

    A null text stays null and an empty one empty, both with an empty list. Repeated rows give repeated
    results; extra columns are not read.
    """
    kind = df.schema[id_col].dataType.simpleString()
    pair = pa.struct([("markup", pa.string()), ("element", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [convert(t) for t in batch.column(1).to_pylist()]
            found = pa.array([[{"markup": m, "element": e} for m, e in f] for _, f in done], pa.list_(pair))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t for t, _ in done], pa.string()), found], [id_col, "text", "found"])

    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, text string, found array<struct<markup:string,element:string>>")


def shared_lines(a: list[str], b: list[str]) -> list[int]:
    """Positions in ``a`` of a longest common subsequence of two lists of lines.

    Bit-parallel: after each line of ``b`` the zeros among the low i bits of a row number the length for the first i lines of ``a``.
    """
    common = set(a) & set(b)
    at = [i for i, line in enumerate(a) if line in common]
    b = [line for line in b if line in common]
    where: dict[str, int] = {}
    for k, i in enumerate(at):
        where[a[i]] = where.get(a[i], 0) | 1 << k
    full = (1 << len(at)) - 1
    rows = [full]
    for line in b:
        v = rows[-1]
        u = v & where[line]
        rows.append((v + u | v - u) & full)
    out, i, j = [], len(at), len(b)
    while i and j:
        if a[at[i - 1]] == b[j - 1]:
            i, j = i - 1, j - 1
            out.append(at[i])
        elif rows[j] >> (i - 1) & 1:
            i -= 1
        else:
            j -= 1
    return out[::-1]


def _difference(text: str, neighbour: str) -> tuple[str, int]:
    """What is left of a text, and how many lines went."""
    lines = text.split("\n")
    full = [i for i, line in enumerate(lines) if line.strip()]
    shared = {full[k] for k in shared_lines([lines[i] for i in full], [line for line in neighbour.split("\n") if line.strip()])}
    return "\n".join(line for i, line in enumerate(lines) if i not in shared), len(shared)


def without_shared_lines(text: str | None, neighbour: str | None) -> str | None:
    """The lines of a text that are not in its longest common subsequence of lines with the neighbour; blank lines stay and are not counted in it."""
    return _difference(text, neighbour)[0] if text and neighbour else text


class _Walk:
    """Rows of one host in order: for each the last one before it that has another page and another text."""

    def __init__(self, carried: list[tuple] = ()):
        self.host = self.page = self.last = self.other = self.before = self.before_other = None
        for row in carried:
            self.step(row)

    def step(self, row: tuple) -> tuple | None:
        """``row`` is (host, page, digest, id). ``other`` is the last row of another text than ``last``; ``before`` the last row of the page before."""
        host, page, digest, _ = row
        if host != self.host or self.last is None:
            self.host, self.page, self.last, self.other, self.before, self.before_other = host, page, None, None, None, None
        elif page != self.page:
            self.page, self.before, self.before_other = page, self.last, self.other
        found = self.before if self.before is None or self.before[2] != digest else self.before_other
        if self.last is not None and self.last[2] != digest:
            self.other = self.last
        self.last = row
        return found


def _state(rows: Iterator[tuple]) -> list[tuple]:
    """The few rows, in order, that leave a walk as all of ``rows`` do."""
    walk, number = _Walk(), {}
    for n, row in enumerate(rows):
        walk.step(row)
        kept = {id(r): r for r in (walk.last, walk.other, walk.before, walk.before_other) if r is not None}
        number = {k: number.get(k, n) for k in kept}
    return sorted(kept.values(), key=lambda r: number[id(r)]) if number else []


def _rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    return zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("host", "page", "digest", "id")), strict=True)


def _next_to(ordered: DataFrame, kind: str, back: bool) -> DataFrame:
    """``ordered`` with the row found before each in its order: the walk runs in every part, from the state that earlier parts leave."""
    state = f"part int, n int, host string, page string, digest binary, id {kind}"

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = []

        def rows() -> Iterator[tuple]:
            for b in batches:
                if b.num_rows:
                    part[:] = [(b.column(b.schema.get_field_index("part"))[0].as_py(), b.schema.field("id").type)]
                    yield from _rows(b)

        kept = _state(rows())
        if kept:
            p, id_type = part[0]
            cols = list(zip(*kept, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array([p] * len(kept), pa.int32()), pa.array(range(len(kept)), pa.int32()), *(pa.array(c, pa.string()) for c in cols[:2]), pa.array(cols[2], pa.binary()), pa.array(cols[3], id_type)], ["part", "n", "host", "page", "digest", "id"])

    left: dict[int, list[tuple]] = {}
    for r in ordered.mapInArrow(ends, state).collect():  # four rows a part at most
        left.setdefault(r["part"], []).append((r["n"], (r["host"], r["page"], bytes(r["digest"]), r["id"])))
    carried, at = {}, []
    for p in sorted(left, reverse=back):
        carried[p] = at
        at = _state(iter([*at, *(row for _, row in sorted(left[p], key=lambda x: x[0]))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk = None
        for b in batches:
            if not b.num_rows:
                continue
            walk = walk or _Walk(carried[b.column(b.schema.get_field_index("part"))[0].as_py()])
            found = [walk.step(row) or (None,) * 4 for row in _rows(b)]
            new = {"near_digest": pa.array([f[2] for f in found], pa.binary()), "near": pa.array([f[3] for f in found], b.schema.field("id").type)}
            yield pa.RecordBatch.from_arrays([*b.columns, *new.values()], [*b.schema.names, *new])

    columns = ", ".join(f"`{c}` {t}" for c, t in ordered.dtypes)
    return ordered.mapInArrow(run, f"{columns}, near_digest binary, near {kind}")


def page_difference(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", url_col: str = "source_file", buckets: int = 64) -> DataFrame:
    """(id, text, neighbour, removed): each page without the lines it shares with the page next to it by URL path.

    The host is what stands before the last path segment. Within a host the distinct texts of each URL are ordered by URL and
    lowest id; the neighbour is the nearest one before that has another URL and another text, or where there is none the
    nearest one after. The order is cut into ``buckets`` ranges, so a host may have any size, and each range goes on where the one
    before ended. Copies share what is found for their text. Pages without such a neighbour stay whole, as do null and blank
    texts, which are nobody's neighbour; rows without a URL count as pages of a host of their own, one for each text.
    """
    kind = df.schema[id_col].dataType.simpleString()
    url = F.when(F.col(url_col) != "", F.col(url_col))
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), url.alias("url"))
    blank = F.coalesce(~F.col("text").rlike(r"\S"), F.lit(True))
    pages = rows.filter(~blank).withColumn("digest", F.unhex(F.md5("text")))
    pages = pages.withColumn("host", F.when(F.col("url").isNull(), "\n").otherwise(F.regexp_extract("url", r"^(.*?)[^/]*$", 1))).withColumn("page", F.coalesce("url", F.hex("digest")))
    distinct = pages.groupBy("host", "page", "digest").agg(F.min("id").alias("id"))
    keys = [F.col("host"), F.when(F.col("host") != "\n", F.col("page")).otherwise(""), F.col("id"), F.col("digest")]
    ordered = checkpoint(distinct.repartitionByRange(buckets, *keys).sortWithinPartitions(*keys).withColumn("part", F.spark_partition_id()))
    before = _next_to(ordered, kind, False).withColumnsRenamed({"near": "b", "near_digest": "b_digest"})
    after = _next_to(before.sortWithinPartitions(*[k.desc() for k in keys]), kind, True)
    first = F.col("b_digest").isNotNull()
    links = after.select("page", "digest", F.when(first, F.col("b")).otherwise(F.col("near")).alias("other"), F.coalesce("b_digest", "near_digest").alias("other_digest"))

    texts = pages.select("digest", "text").dropDuplicates(["digest"])
    pairs = links.filter("other_digest IS NOT NULL").select("digest", "other_digest").distinct()
    both = pairs.join(texts, "digest").join(texts.toDF("other_digest", "near"), "other_digest").select("digest", "other_digest", "text", "near")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = [_difference(t, n) for t, n in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x for x, _ in done], pa.string()), pa.array([n for _, n in done], pa.int32())], ["digest", "other_digest", "text", "removed"])

    cleaned = both.mapInArrow(run, "digest binary, other_digest binary, text string, removed int")
    named = pages.select("id", "page", "digest").join(links, ["page", "digest"])
    out = ["id", "text", "other", "removed"]
    paired = named.filter("other_digest IS NOT NULL").join(cleaned, ["digest", "other_digest"]).select(*out)
    none = (F.lit(None).cast(kind).alias("other"), F.lit(0).alias("removed"))
    whole = named.filter("other_digest IS NULL").join(texts, "digest").select("id", "text", *none)
    return paired.unionByName(whole).unionByName(rows.filter(blank).select("id", "text", *none)).toDF(id_col, "text", "neighbour", "removed")
