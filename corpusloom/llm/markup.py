"""Problem 1: markup residue in text documents.

One tokenizer reads a field as words and marks, each mark with its notation: html, markdown,
wiki or latex. What code blocks show is read as words. Marks that two notations
share wait until the rest of the field has told which of them it uses.

Cleaning. Words score positive and tags negative, with weights that ``fit_weights``
learns from pages whose elements tell content from furniture, and a furniture element weighs on every block within it; a
linear scan finds the contiguous run of blocks with the greatest sum, the content region. Furniture without a positive score goes, and so does,
outside the region, a block that is nothing but links; headings, other list items, code blocks, tables and formulas of
an extract stay. Elsewhere marks become plain text that keeps the structure: headings as ``# ``, list items as ``- ``, code between fences,
formulas in their dollars, table cells between bars.

Which notations a field holds is no question of regions, so ``markup_kinds`` asks the tokenizer alone.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("html", "markdown", "wiki", "latex")

# Element names of HTML.
ELEMENTS = (
    "a abbr acronym address applet area article aside audio b base basefont bdi bdo big blink blockquote body br button canvas caption center cite code col"
    " colgroup data datalist dd del details dfn dialog dir div dl dt em embed fieldset figcaption figure font footer form frame frameset h1 h2 h3 h4"
    " h5 h6 head header hgroup hr html i iframe img input ins kbd label legend li link main map mark marquee menu meta meter nav nobr noframes noscript"
    " object ol optgroup option output p param picture pre progress q rp rt ruby s samp script search section select small source span strike strong style sub"
    " summary sup svg table tbody td template textarea tfoot th thead time title tr track tt u ul var video wbr"
).split()
_NAME = "(?:" + "|".join(sorted(ELEMENTS, key=len, reverse=True)) + ")"
TAG = re.compile(rf"<!--.*?(?:-->|\Z)|<!doctype[^>]*>|<(/?)({_NAME})(?=[\s/>])(?:[^<>\"']|\"[^\"]*\"|'[^']*')*>|<(/?)({_NAME})(?=[\s/>])[^<>]*>", re.I | re.S)
ESCAPED = re.compile(rf"&(?:lt|#60|#x3c);(?:!--|/?{_NAME}\b).*?&(?:gt|#62|#x3e);", re.I | re.S)
REFERENCE = re.compile(r"&(?:#\d{1,7}|#[xX][\da-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,30});")
_UNCLOSED = re.compile(rf"<(?:{_NAME})\s+[a-z-]+=[^<>]*\Z", re.I)

FENCE = re.compile(r"^ {0,3}(```+|~~~+)[^\n`]*\n(.*?)(?:^ {0,3}\1[`~]*[^\S\n]*$|\Z)", re.M | re.S)
HTML_CODE = re.compile(r"<(pre|code|script|style|textarea|xmp|samp|kbd)\b[^>]*>(.*?)</\1\s*>", re.I | re.S)
ESCAPED_CODE = re.compile(r"&lt;(pre|code)\b.*?&gt;(.*?)&lt;/\1\s*&gt;", re.I | re.S)
WIKI_CODE = re.compile(r"<(nowiki|syntaxhighlight|source)\b[^>]*>(.*?)</\1\s*>", re.I | re.S)
LATEX_CODE = re.compile(r"\\begin\{(verbatim\*?|lstlisting|minted|Verbatim)\}(?:\[[^\]]*\]|\{[^}]*\})*(.*?)\\end\{\1\}|\\(?:verb|lstinline)(\W)(.*?)\3", re.S)
INLINE_CODE = re.compile(r"(?<!`)(`{1,2})(?!`)([^`\n]+?)(?<!`)\1(?!`)")

DISPLAY = re.compile(r"\$\$(?!\s*\$\$)(.+?)\$\$|\\\[(.+?)\\\]|\\\((.+?)\\\)|\\begin\{(equation|align|gather|multline|eqnarray|displaymath|math)(\*?)\}(.+?)\\end\{\4\5\}", re.S)
INLINE_MATH = re.compile(r"(?<![\\$\w])\$(?![\s$])([^$\n]+?)(?<![\s\\$])\$(?![\w$])")
_TEX = re.compile(r"\\[A-Za-z]+|[_^](?:\{|\w)|[=<>≤≥±×+]|^[A-Za-z](?:'|\(\w\))?$")
MACRO = re.compile(r"(?<![\w:\\/])\\(?:[A-Za-z]+\*?(?:\[[^\]\n]*\])?\{|(?:item|newpage|clearpage|maketitle|tableofcontents|noindent|centering|par|hline|bigskip|medskip|smallskip|appendix|LaTeX|TeX|newline|linebreak|pagebreak|hfill|vfill|ldots|dots|quad|qquad|itshape|bfseries)(?![A-Za-z\\]))")
COMMENT = re.compile(r"^%(?:%* .*)?$", re.M)

WIKI = re.compile(
    r"(?<!')'{2,5}(?=[^'\s])[^'\n]*(?:'(?!')[^'\n]*)*?'{2,5}(?!')|\[\[[^\[\]\n]+\]\]|\{\{[^{}\s|][^{}|\n]*(?:\|[^{}]*)?\}\}|\[(?:https?|ftp)://\S+ [^\]\n]+\]|\[//\S+ [^\]\n]+\]"
    r"|</?(?:ref|references|gallery|nowiki|noinclude|includeonly|onlyinclude|syntaxhighlight|poem)\b[^>]*>|__(?:NO)?TOC__|__FORCETOC__|^#REDIRECT\b|~~~~~?"
    r"|^\{\|.*$|^\|-{1,3}(?:[^\S\n][^|\n]*)?$|^\|\}|^={1,6}[^=\n]+={1,6}(?=\s|$)",
    re.M | re.I,
)
MARKDOWN = re.compile(
    r"\*\*(?=\S)[^*\n]+(?<=\S)\*\*|(?<![\w_])__(?=\w)[^_\n]+(?<=\S)__(?![\w_])|(?<![\w*])\*(?=[^\s*])[^*\n]*?(?<=[^\s*])\*(?![\w*])|(?<![\w_/])_(?=[^\s_])[^_\n]*?(?<=[^\s_])_(?![\w_])"
    r"|~~(?=[^\s~])[^~\n]+(?<=[^\s~])~~|!?\[[^\[\]\n]*\]\([^()\s]*(?:\([^()\s]*\)[^()\s]*)*(?:\s+[\"'(][^\n]*?[\"')])?\)|\[[^\[\]\n]+\]\[[^\[\]\n]*\]|^ {0,3}\[\^?[^\[\]\n]+\]:\s*\S|\[\^[\w-]+\]"
    r"|<(?:https?://|mailto:)[^<>\s]+>|^ {0,3}#{2,6}[^\S\n]+\S|^[^\S\n]*>[^\S\n]+\S|^[^\S\n]*[-+][^\S\n]+\S|^[^\S\n]*\d{1,3}[.)][^\S\n]+\S"
    r"|^(?=[^\n]*\|)[^\S\n]*\|?(?:[^\S\n]*:?-{2,}:?[^\S\n]*\|)+(?:[^\S\n]*:?-{2,}:?[^\S\n]*)?\|?[^\S\n]*$|(?<=\S\n)={3,}(?=\s|$)|^ {0,3}(?:-{3}|(?:\* ?){3,}|(?:_ ?){3,})[^\S\n]*$|(?<=\S\n)-{3,}[^\S\n]*$|<!-- ?(?:TOC|/TOC) ?-->",
    re.M,
)
SHARED = re.compile(r"^[^\S\n]{0,3}(?:#[^\S\n]+\S|\*+[^\S\n]+\S|-{4,}[^\S\n]*$)", re.M)
_INDENTED = re.compile(r"(?:(?<=\n\n)|\A)(?:(?: {4,}|\t)[^\n]*(?:\n|\Z))+")


def kinds(text: str) -> set[str]:
    """The notations whose marks a field holds."""
    found: set[str] = set()

    def note(kind: str):
        def take(m: re.Match) -> str:
            found.add(kind)
            return " \n" if "\n" in m[0] else " x "

        return take

    if "`" in text or "~~~" in text:
        text = FENCE.sub(note("markdown"), text)
    if "<" in text:
        text = WIKI_CODE.sub(note("wiki"), text)
        text = HTML_CODE.sub(note("html"), text)
    if "&lt;" in text:
        text = ESCAPED_CODE.sub(note("html"), text)
    if "\\" in text:
        text = LATEX_CODE.sub(note("latex"), text)
    macros = "\\" in text and MACRO.search(text)
    if "`" in text:
        if macros:
            text = re.sub(r"``([^`'\n]+)''", r"\1", text)
        text = INLINE_CODE.sub(note("markdown"), text)
    if "$" in text or "\\" in text:
        text = DISPLAY.sub(note("latex"), text)
        if "$" in text:
            text = INLINE_MATH.sub(lambda m: note("latex")(m) if _TEX.search(m[1]) else m[0], text)
        if MACRO.search(text):
            found.add("latex")
            text = MACRO.sub(" ", text)
    if "<" in text:
        text = re.sub(r"<(?:https?://|mailto:)[^<>\s]+>", note("markdown"), text)
        if TAG.search(text) or _UNCLOSED.search(text):
            found.add("html")
            text = TAG.sub(lambda m: "\n" if "\n" in m[0] else "", text)
    if "&" in text:
        if ESCAPED.search(text):
            found.add("html")
            text = ESCAPED.sub("", text)
        for ref in set(REFERENCE.findall(text)):
            if ref[1] == "#" or ref[1:] in _html.entities.html5:
                found.add("html")
                text = text.replace(ref, " ")
    wiki = len(WIKI.findall(text))
    if wiki:
        text = WIKI.sub(lambda m: " x ", text)
    plain = _INDENTED.sub("\n", text)
    markdown = len(MARKDOWN.findall(plain))
    if wiki:
        found.add("wiki")
    if markdown:
        found.add("markdown")
    if not wiki and "markdown" not in found and SHARED.search(plain):
        found.add("latex" if "latex" in found and macros and not re.search(r"^\s*[*#]+ ", plain, re.M) else "markdown")
    return found


# Weights of words and tags in bits where none are passed in: what ``fit_weights`` gave on labelled pages, rounded; tags not named have OTHER.
WORD = 0.25
OTHER = -1.2
WEIGHTS = {"word": WORD, "p": -1.0, "a": -4.6, "li": -2.3, "div": -0.1, "ul": -2.1, "nav": -2.6, "aside": -0.8, "header": -10.3, "footer": -10.3, "article": -0.1, "main": -0.1, "h1": -0.1, "h2": -0.1, "figure": -0.1, "em": -0.1, "b": -0.1, "img": -0.1, "blockquote": -0.1}
# Elements whose content is never read have no labelled words, so their weights are set, not learned.
UNREAD = {"script": -6.0, "style": -6.0, "form": -6.0, "iframe": -4.0}

_BLOCK_TAGS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
_SPLIT = re.compile(rf"(<!--.*?(?:-->|\Z)|<!doctype[^>]*>|</?{_NAME}(?=[\s/>])(?:[^<>\"']|\"[^\"]*\"|'[^']*')*>|</?{_NAME}(?=[\s/>])[^<>]*>)", re.I | re.S)
_FURNITURE = frozenset("nav aside footer header form menu".split())
_TAG_NAME = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)")
_BLOCK_SIGN = re.compile(r"</?(?:p|div|li|h[1-6]|tr|td|th|blockquote|article|section|ul|ol|dl|dd|dt|table|pre)\b", re.I)
_LINE_FEED = re.compile(r"\n(?![^<>]*>)")
_KEPT = "\ue000{}\ue001"
_KEPT_AT = re.compile("\ue000(\\d+)\ue001")


def best_region(scores: list[float]) -> tuple[int, int]:
    """(from, to) of the contiguous run with the greatest sum, by one scan; the longest of equal runs, empty if no sum is positive."""
    best, at, total, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total >= best and total > 0:
            best, at = total, (start, i + 1)
    return at


class Block(NamedTuple):
    score: float
    text: str
    heading: bool
    furniture: bool
    linked: bool


def _html_blocks(text: str, weights: dict[str, float]) -> list[Block]:
    """The blocks of an HTML text with their scores; ``furniture`` stand in a furniture element, ``linked`` are nothing but links."""
    out: list[Block] = []
    piece: list[str] = []
    score, prefix, heading, skip = 0.0, "", False, ""
    open_furniture: list[str] = []
    links = words = linked = 0

    def close() -> None:
        nonlocal score, prefix, heading, words, linked
        plain = " ".join(_html.unescape("".join(piece)).split())
        if plain:
            held = sum(weights.get(name, OTHER) for name in open_furniture)
            out.append(Block(score + held + weights.get("word", WORD) * len(plain.split()), prefix + plain, heading, bool(open_furniture), 0 < words == linked))
            prefix, heading = "", False
        elif score:
            out.append(Block(score, "", False, bool(open_furniture), False))
        piece.clear()
        score, words, linked = 0.0, 0, 0

    for token in _SPLIT.split(text):
        if not token:
            continue
        m = _TAG_NAME.match(token) if token[0] == "<" else None
        if token.startswith(("<!--", "<!")):
            continue
        if m is None:
            if not skip:
                piece.append(token)
                n = len(token.split())
                words += n
                linked += n if links else 0
            continue
        name, end = m[2].lower(), bool(m[1])
        if skip:
            if end and name == skip:
                skip = ""
            continue
        if name in ("script", "style", "noscript", "template", "iframe", "object") and not end and not token.endswith("/>"):
            skip = name
            score += weights.get(name, OTHER)
            continue
        if name == "br":
            piece.append("\n")
            close()
            continue
        if name == "a":
            links = max(0, links - 1) if end else links + 1
        if name == "img":
            alt = re.search(r"\balt\s*=\s*[\"']?([^\"'>]+)", token, re.I)
            if alt:
                piece.append(alt[1])
        if end:
            score += weights.get(name, OTHER)
        if name in _BLOCK_TAGS:
            if name in ("td", "th") and end is False and any(x.strip() for x in piece):
                piece.append(" | ")
            elif name not in ("td", "th"):
                close()
            if name in ("h1", "h2", "h3", "h4", "h5", "h6"):
                prefix, heading = ("", False) if end else ("#" * int(name[1]) + " ", True)
            elif name == "li" and not end:
                prefix = "- "
            elif name == "blockquote" and not end:
                prefix = "> "
            elif name == "tr" and not end:
                prefix = "| "
            elif name in ("table", "p", "div", "ul", "ol", "tr", "blockquote") and end:
                prefix, heading = "", False
            if name in _FURNITURE:
                if not end:
                    open_furniture.append(name)
                elif name in open_furniture:
                    while open_furniture.pop() != name:
                        pass
        if not end:
            score += weights.get(name, OTHER)
    close()
    return out


def kept_blocks(blocks: list[Block]) -> list[Block]:
    """The blocks that stay, by the best region; where no run scores positive, all but furniture stay."""
    lo, hi = best_region([b.score for b in blocks])
    some = hi > lo
    out = []
    for i, b in enumerate(blocks):
        if not b.text:
            continue
        held = "\ue000" in b.text
        if b.furniture and b.score <= 0 and not held:
            continue
        if lo <= i < hi or held or b.heading or b.score > 0 or not (some and b.linked):
            out.append(b)
    return out


def _markdown(text: str) -> str:
    text = re.sub(r"^ {0,3}\[\^?[^\[\]\n]+\]:\s*\S.*$", "", text, flags=re.M)
    text = re.sub(r"!\[([^\[\]\n]*)\]\([^()\n]*(?:\([^()\n]*\)[^()\n]*)*\)", r"\1", text)
    text = re.sub(r"\[([^\[\]\n]*)\]\([^()\n]*(?:\([^()\n]*\)[^()\n]*)*\)", r"\1", text)
    text = re.sub(r"\[([^\[\]\n]+)\]\[[^\[\]\n]*\]", r"\1", text)
    text = re.sub(r"<((?:https?://|mailto:)[^<>\s]+)>", r"\1", text)
    text = re.sub(r"^([^\n]*\S[^\n]*)\n={3,}[^\S\n]*([^\n]*)$", r"# \1 \2", text, flags=re.M)
    text = re.sub(r"^([^\n|]*\S[^\n|]*)\n-{3,}[^\S\n]*$", r"## \1", text, flags=re.M)
    text = re.sub(r"^[^\S\n]*\|?(?:[^\S\n]*:?-{2,}:?[^\S\n]*\|)+(?:[^\S\n]*:?-{2,}:?)?[^\S\n]*$", "", text, flags=re.M)
    text = re.sub(r"^ {0,3}(?:(?:- ?){3,}|(?:\* ?){3,}|(?:_ ?){3,})[^\S\n]*$", "", text, flags=re.M)
    text = re.sub(r"(\*\*|__)(?=\S)([^*_\n]+?)(?<=\S)\1", r"\2", text)
    text = re.sub(r"(?<![\w*])\*(?=[^\s*])([^*\n]*?)(?<=[^\s*])\*(?![\w*])", r"\1", text)
    text = re.sub(r"(?<![\w_/])_(?=[^\s_])([^_\n]*?)(?<=[^\s_])_(?![\w_])", r"\1", text)
    text = re.sub(r"~~(?=[^\s~])([^~\n]+)(?<=[^\s~])~~", r"\1", text)
    return re.sub(r"^([^\S\n]*)[*+-][^\S\n]+(?=\S)", r"\1- ", text, flags=re.M)


def _wiki(text: str) -> str:
    text = re.sub(r"<ref\b[^>]*/>|<ref\b[^>]*>.*?</ref>", "", text, flags=re.S | re.I)
    text = re.sub(r"</?(?:ref|references|gallery|noinclude|includeonly|onlyinclude|poem)\b[^>]*>", "", text, flags=re.I)
    text = re.sub(r"\[\[(?:File|Image|Datei|Fichier|Archivo|Ficheiro|Category|Kategorie|Catégorie|Categoría|Categoria):[^\[\]]*\]\]", "", text, flags=re.I)
    text = re.sub(r"\[\[(?:[^\[\]|\n]*\|)?([^\[\]|\n]*)\]\]", r"\1", text)
    text = re.sub(r"\[(?:https?:|ftp:)?//\S+ ([^\]\n]+)\]", r"\1", text)
    text = re.sub(r"\{\{[^{}]*\}\}", "", text)
    text = re.sub(r"^[*#]+[^\S\n]+(?=\S)", "- ", text, flags=re.M)
    text = re.sub(r"^(={1,6})[^\S\n]*([^=\n]+?)[^\S\n]*={1,6}(?=\s|$)", lambda m: "#" * len(m[1]) + " " + m[2], text, flags=re.M)
    text = re.sub(r"'{2,5}", "", text)
    text = re.sub(r"^\{\|.*$|^\|-{1,3}(?:[^\S\n][^|\n]*)?$|^\|\}.*$|__(?:NO|FORCE)?TOC__|~~~~~?", "", text, flags=re.M)
    return re.sub(r"^[!|][^\S\n]*(.*)$", lambda m: "| " + re.sub(r"\s*(?:\|\||!!)\s*", " | ", m[1]), text, flags=re.M)


def _latex(text: str) -> str:
    text = COMMENT.sub("", text)
    text = re.sub(r"\\(part|chapter|section|subsection|subsubsection|paragraph)\*?(?:\[[^\]]*\])?\{([^{}]*)\}", lambda m: "\n" + "#" * {"part": 1, "chapter": 1, "section": 1, "subsection": 2, "subsubsection": 3, "paragraph": 4}[m[1]] + f" {m[2]}\n", text)
    text = re.sub(r"\\(?:footnote|cite[a-z]*|ref|eqref|label|pageref|index|bibliography(?:style)?|documentclass|usepackage|vspace|hspace|includegraphics)\*?(?:\[[^\]]*\])*\{[^{}]*\}", "", text)
    text = re.sub(r"\\(?:begin|end)\{[^{}]*\}(?:\[[^\]]*\]|\{[^{}]*\})*", "\n", text)
    text = re.sub(r"\\item\b(?:\[([^\]]*)\])?[^\S\n]*", lambda m: "\n- " + (m[1] + " " if m[1] else ""), text)
    for _ in range(3):
        text = re.sub(r"\\[A-Za-z]+\*?(?:\[[^\]\n]*\])?\{([^{}]*)\}", r"\1", text)
    text = re.sub(r"\\\\(?:\[[^\]]*\])?", "\n", text)
    text = MACRO.sub(" ", text)
    return re.sub(r"\\([%&#_{}$])", r"\1", text).replace("~", " ")


def clean(text: str | None, weights: dict[str, float] | None = None) -> str | None:
    """A field as clean text; null stays null, a field without content becomes empty."""
    if text is None:
        return None
    found = kinds(text)
    if not found:
        return text.strip()
    weights = (weights or WEIGHTS) | UNREAD
    kept: list[str] = []

    def keep(shown: str) -> str:
        kept.append(shown)
        return _KEPT.format(len(kept) - 1)

    def code(body: str) -> str:
        body = body.strip("\n")
        return "\n\n" + keep(f"```\n{body}\n```") + "\n\n"

    text = text.replace("\r\n", "\n").replace("\ue000", "").replace("\ue001", "")
    text = FENCE.sub(lambda m: code(m[2]), text)
    text = WIKI_CODE.sub(lambda m: code(m[2]) if "\n" in m[2] else keep(m[2]), text)
    text = re.sub(r"<(script|style)\b[^>]*>.*?</\1\s*>", " ", text, flags=re.I | re.S)
    text = re.sub(r"<pre\b[^>]*>(.*?)</pre\s*>", lambda m: "<p>" + code(_html.unescape(TAG.sub("", m[1]))) + "</p>", text, flags=re.I | re.S)
    text = LATEX_CODE.sub(lambda m: code(m[2]) if m[2] is not None else keep(m[4]), text)
    if "latex" in found:
        text = DISPLAY.sub(lambda m: keep(m[0]), text)
        text = INLINE_MATH.sub(lambda m: keep(m[0]) if _TEX.search(m[1]) else m[0], text)
    if "markdown" in found:
        text = INLINE_CODE.sub(lambda m: keep(m[2]), text)
    if "html" in found:
        if ESCAPED.search(text) and not TAG.search(text.replace("<p>\n\n\ue000", "")):
            text = _html.unescape(text)
        elif ESCAPED.search(text):
            text = ESCAPED.sub(lambda m: _html.unescape(m[0]), text)
        if TAG.search(text):
            filled = [x for x in text.split("\n") if x.strip()]
            tagged = sum(bool(_BLOCK_SIGN.search(x)) for x in filled)
            # where most lines stand without an element, line feeds are the structure
            marked = text if 2 * tagged >= len(filled) else _LINE_FEED.sub("<br>", text)
            text = "\n".join(b.text for b in kept_blocks(_html_blocks(marked, weights)))
        else:
            text = _html.unescape(text)
        text = text.replace("\xa0", " ")
    if "wiki" in found:
        text = _wiki(text)
    if "latex" in found and MACRO.search(text):
        text = _latex(text)
    if "markdown" in found:
        text = _markdown(text)
    text = re.sub(r"[^\S\n]+$", "", text, flags=re.M)
    text = re.sub(r"\n{3,}", "\n\n", text).strip()
    while _KEPT_AT.search(text):
        text = _KEPT_AT.sub(lambda m: kept[int(m[1])], text)
    return text


#: Labelled pages that ``fit_weights`` reads at most.
LABELLED = 2000
_REGION = re.compile(r"<(article|main)\b", re.I)


def count_tokens(page: str) -> tuple[dict[str, int], dict[str, int]]:
    """Words and tags of a page inside its content element, and outside it or in furniture elements."""
    inside: dict[str, int] = {}
    outside: dict[str, int] = {}
    stack: list[str] = []
    for token in _SPLIT.split(HTML_CODE.sub(" ", page)):
        if not token or token.startswith("<!"):
            continue
        m = _TAG_NAME.match(token) if token[0] == "<" else None
        if m:
            name = m[2].lower()
            if name in ("article", "main", *_FURNITURE):
                if not m[1]:
                    stack.append(name)
                elif name in stack:
                    while stack.pop() != name:
                        pass
        content = bool(stack) and not _FURNITURE.intersection(stack)
        counts = inside if content else outside
        key, n = (m[2].lower(), 1) if m else ("word", len(token.split()))
        counts[key] = counts.get(key, 0) + n
    return inside, outside


def fit_weights(df: DataFrame, key: str, html: str, pages: int = LABELLED) -> DataFrame:
    """(token, weight, n): log-odds in bits of each tag, and of a word, for content against furniture.

    Learned from at most ``pages`` labelled pages, those of the smallest hashes of ``key`` among pages
    with a content element and a furniture element. Words weigh at least 0.05, tags at most -0.1.
    """
    labelled = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{html}`").alias("html")).filter("html RLIKE '(?i)<(article|main)' AND html RLIKE '(?i)<(nav|aside|footer)'")
    sample = labelled.orderBy(F.xxhash64("key")).limit(pages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total: list[dict[str, int]] = [{}, {}]
            for page in batch.column(0).to_pylist():
                for have, got in zip(total, count_tokens(page)):
                    for k, n in got.items():
                        have[k] = have.get(k, 0) + n
            tokens = sorted({*total[0], *total[1]})
            yield pa.RecordBatch.from_arrays([pa.array(tokens, pa.string()), pa.array([total[0].get(t, 0) for t in tokens], pa.int64()), pa.array([total[1].get(t, 0) for t in tokens], pa.int64())], names=["token", "inside", "outside"])

    counts = sample.select("html").mapInArrow(run, "token string, inside bigint, outside bigint").groupBy("token").agg(F.sum("inside").alias("i"), F.sum("outside").alias("o"))
    sums = counts.agg(F.sum("i").alias("all_i"), F.sum("o").alias("all_o"), F.count(F.lit(1)).alias("kinds"))
    odds = F.log2((F.col("i") + 1) / (F.col("all_i") + F.col("kinds"))) - F.log2((F.col("o") + 1) / (F.col("all_o") + F.col("kinds")))
    weight = F.when(F.col("token") == "word", F.greatest(odds, F.lit(0.05))).otherwise(F.least(odds, F.lit(-0.1)))
    with_sums = counts.crossJoin(F.broadcast(sums))  # one row
    return with_sums.select("token", F.round(weight, 3).alias("weight"), (F.col("i") + F.col("o")).alias("n"))


def markup_kinds(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, kind): one row for each row, field and notation that the field holds. Null and empty fields have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, named, found = [], [], []
            for j, field in enumerate(fields, 1):
                for i, text in enumerate(batch.column(j).to_pylist()):
                    if text:
                        for kind in sorted(kinds(text)):
                            at.append(i)
                            named.append(field)
                            found.append(kind)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(named, pa.string()), pa.array(found, pa.string())], names=["key", "field", "kind"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(f"`{key}`").alias("key"), *[F.col(f"`{f}`").alias(f"f{i}") for i, f in enumerate(fields)]).mapInArrow(run, f"key {kind}, field string, kind string")


def clean_fields(df: DataFrame, key: str, fields: list[str], weights: DataFrame | None = None) -> DataFrame:
    """(key, fields…): every row with its fields as clean text; null stays null.

    ``weights`` (token, weight) come from ``fit_weights``, one for each element name at most; where it has none, ``WEIGHTS`` hold.
    """
    fitted = {r["token"]: r["weight"] for r in weights.select("token", "weight").collect()} if weights is not None else {}
    use = WEIGHTS | fitted

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([clean(t, use) for t in batch.column(j).to_pylist()], pa.string()) for j in range(1, len(fields) + 1))], names=["key", *fields])

    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(f"`{key}`").alias("key"), *[F.col(f"`{f}`").alias(f) for f in fields])
    return rows.mapInArrow(run, f"key {kind}, " + ", ".join(f"`{f}` string" for f in fields))
