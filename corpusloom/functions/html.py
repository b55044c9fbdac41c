"""One tolerant parse of a page, and all that is read from it."""

from __future__ import annotations

import html as _html
import json
import re
from html.parser import HTMLParser
from urllib.parse import urljoin, urlparse

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.urls import normalize_url, same_page_key

# Elements without content, blocks that hold a link's context, what is no content, media.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTEXT_BLOCKS = frozenset("p li blockquote td th dd dt h1 h2 h3 h4 h5 h6 figcaption".split())
WIDE_BLOCKS = frozenset("div section article".split())
DROPPED = frozenset("script style iframe form footer nav".split())
DROPPED_CLASSES = frozenset("footer nav menu social modal".split())
NO_LINKS = ("mailto:", "javascript:", "tel:", "data:", "#")
IMAGE_ENDINGS = (".jpg", ".jpeg", ".png", ".gif", ".webp", ".bmp", ".svg")
LAZY = ("data-src", "data-lazy-src", "data-original", "data-url")
# Start tags that end an open element of the named kinds, within the elements that bound it.
IMPLIED_ENDS = {
    **dict.fromkeys("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split(), ("p",)),
    "li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "tr": ("tr", "td", "th", "p"), "td": ("td", "th", "p"), "th": ("td", "th", "p"),
    "thead": ("tr", "td", "th"), "tbody": ("tr", "td", "th", "thead", "tbody"), "tfoot": ("tr", "td", "th", "thead", "tbody"), "option": ("option",), "optgroup": ("option", "optgroup"),
}
BOUNDS = frozenset("ul ol dl table select button object article aside section div td th blockquote".split())
#: Elements within each other that are kept; deeper ones stand beside each other.
DEPTH = 512
_TOKEN = re.compile(r"^[A-Za-z0-9_-]+$")
#: Code points kept of a link's context and of the markup around it.
CONTEXT_CHARS, MARKUP_CHARS = 1000, 4000


class Node:
    __slots__ = ("name", "attrs", "kids", "up")

    def __init__(self, name: str, attrs: dict[str, str], up: Node | None):
        self.name, self.attrs, self.kids, self.up = name, attrs, [], up

    def walk(self):
        """The elements within, in order of the page, without recursion."""
        left = [k for k in reversed(self.kids) if isinstance(k, Node)]
        while left:
            node = left.pop()
            yield node
            left.extend(k for k in reversed(node.kids) if isinstance(k, Node))

    def texts(self):
        left = self.kids[::-1]
        while left:
            kid = left.pop()
            if isinstance(kid, Node):
                left.extend(reversed(kid.kids))
            else:
                yield kid

    def find(self, tag: str | None = None, /, **wanted: str) -> Node | None:
        return next((n for n in self.walk() if (tag is None or n.name == tag) and all(_has(n, k, v) for k, v in wanted.items())), None)

    def every(self, name: str):
        return [n for n in self.walk() if n.name == name]

    def markup(self, limit: int | None = None) -> str:
        """The element as HTML; with ``limit``, at least its first ``limit`` code points."""
        out: list[str] = []
        size = 0
        left: list[Node | str | tuple[str]] = [self]
        while left and (limit is None or size < limit):
            kid = left.pop()
            if isinstance(kid, tuple):
                piece = kid[0]
            elif isinstance(kid, str):
                piece = _html.escape(kid, quote=False)
            else:
                attrs = "".join(f' {k}="{_html.escape(v)}"' for k, v in kid.attrs.items())
                piece = f"<{kid.name}{attrs}/>" if kid.name in VOID else f"<{kid.name}{attrs}>"
                if kid.name not in VOID:
                    left.append((f"</{kid.name}>",))
                    left.extend(reversed(kid.kids))
            out.append(piece)
            size += len(piece)
        return "".join(out)


def _has(node: Node, key: str, value: str) -> bool:
    got = node.attrs.get(key)
    return got is not None and (value in got.split() if key in ("rel", "class") else got == value)


def _first_words(block: Node) -> str:
    """The first code points of a block's text; what stands behind is not read."""
    out: list[str] = []
    size = 0
    for t in block.texts():
        if t.strip():
            out.append(t.strip())
            size += len(out[-1]) + 1
            if size > CONTEXT_CHARS:
                break
    return " ".join(out)[:CONTEXT_CHARS]


class _Builder(HTMLParser):
    """Builds the tree; end tags that may be left out are implied, and no more than ``DEPTH`` elements stand within each other."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("", {}, None)
        self.at = self.root
        self.depth = 0

    def handle_starttag(self, tag, attrs):
        ends = IMPLIED_ENDS.get(tag)
        if ends:
            at, up, node = self.at, 0, None
            # the outermost element that this one ends, not beyond a bound
            while at.up is not None and at.name not in BOUNDS - set(ends):
                up += 1
                if at.name in ends:
                    node, steps = at, up
                at = at.up
            if node is not None:
                self.at, self.depth = node.up, self.depth - steps
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.kids.append(node)
        if tag not in VOID and self.depth < DEPTH:
            self.at = node
            self.depth += 1

    def handle_startendtag(self, tag, attrs):
        self.at.kids.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag):
        node, up = self.at, 1
        while node.up is not None and node.name != tag:
            node = node.up
            up += 1
        if node.up is not None:
            self.at = node.up
            self.depth -= up

    def handle_data(self, data):
        self.at.kids.append(data)


class Document:
    """A parsed page. Every method has a defined result for any page."""

    def __init__(self, text: str):
        builder = _Builder()
        try:
            builder.feed(text)
            builder.close()
        except (AssertionError, ValueError):
            pass
        self.root = builder.root

    def _meta(self, *keys: tuple[str, str]) -> str:
        for attr, value in keys:
            node = self.root.find("meta", **{attr: value})
            if node is not None and "content" in node.attrs:
                return node.attrs["content"].strip()
        return ""

    def title(self) -> str:
        named = [("property", "og:title"), ("name", "twitter:title"), ("itemprop", "title")]
        if any((n := self.root.find("meta", **{a: v})) is not None and "content" in n.attrs for a, v in named):
            return self._meta(*named)
        node = self.root.find("title")
        return "".join(node.texts()).strip() if node else ""

    def description(self) -> str:
        return self._meta(("name", "description"), ("property", "og:description"), ("name", "twitter:description"), ("itemprop", "description"))

    def keywords(self) -> str:
        return self._meta(("name", "keywords"), ("property", "og:keywords"), ("name", "twitter:keywords"))

    def lang(self) -> str:
        node = self.root.find("html")
        return node.attrs.get("lang", "") if node else ""

    def dropped(self) -> Document:
        """Without what is no content; works on this tree."""

        left = [self.root]
        while left:
            node = left.pop()
            node.kids = [k for k in node.kids if not isinstance(k, Node) or not (k.name in DROPPED or DROPPED_CLASSES.intersection(k.attrs.get("class", "").split()))]
            left.extend(k for k in node.kids if isinstance(k, Node))
        return self

    def readable(self) -> str:
        """Text by lines, media as ``[IMAGE: address]`` marks."""

        pieces: list[str] = []
        left = self.root.kids[::-1]
        while left:
            kid = left.pop()
            if not isinstance(kid, Node):
                pieces.append(kid)
            elif kid.name in ("img", "video", "audio") and kid.attrs.get("src"):
                pieces.append(f"[{'IMAGE' if kid.name == 'img' else kid.name.upper()}: {kid.attrs['src']}]")
            else:
                left.extend(reversed(kid.kids))
        return "\n".join(x.strip() for x in " ".join(pieces).split("\n") if x.strip())

    def links(self, base: str) -> list[tuple[str, Node]]:
        """(absolute address, element) of every http link to another page, repeats kept."""
        own, out = same_page_key(base), []
        for node in self.root.every("a"):
            href = node.attrs.get("href", "").strip()
            if not href or href.lower().startswith(NO_LINKS):
                continue
            try:
                whole = href if href.startswith(("http://", "https://")) else urljoin(base, href)
            except ValueError:
                continue
            if whole.startswith(("http://", "https://")) and not (own and same_page_key(whole) == own):
                out.append((whole, node))
        return out

    def link_contexts(self, base: str) -> dict[str, dict]:
        """Normal address (and its relaxed form) to the first link's place and context."""
        out: dict[str, dict] = {}
        for whole, node in self.links(base):
            block, wide, path, up = None, None, [], node.up
            while up is not None and up.up is not None:
                if block is None and up.name in CONTEXT_BLOCKS:
                    block = up
                if wide is None and up.name in WIDE_BLOCKS:
                    wide = up
                ident = up.attrs.get("id", "")
                classes = [c for c in up.attrs.get("class", "").split() if _TOKEN.match(c)][:3]
                path.append(up.name + (f"#{ident}" if _TOKEN.match(ident) else "") + "".join("." + c for c in classes))
                up = up.up
            block = block or wide
            key = normalize_url(whole)
            if key in out and key.lower().rstrip("/") in out:
                continue
            info = {
                "dom": " > ".join(reversed(path)),
                "dom_html": block.markup(MARKUP_CHARS)[:MARKUP_CHARS] if block else None,
                "context": _first_words(block) if block else None,
            }
            out.setdefault(key, info)
            out.setdefault(key.lower().rstrip("/"), info)
        return out

    def media(self, base: str, lazy: bool = False) -> list[tuple[str, str]]:
        """(address, kind) of images, videos and audio, each once; addresses are resolved and lower case."""
        found: dict[str, str] = {}

        def add(raw: str | None, kind: str) -> None:
            raw = (raw or "").strip()
            if raw and (kind != "img" or raw.lower().startswith("data:") or urlparse(raw).path.lower().endswith(IMAGE_ENDINGS)):
                try:
                    found.setdefault(urljoin(base, raw).lower(), kind)
                except ValueError:
                    pass

        for kind in ("img", "video", "audio"):
            for node in self.root.every(kind):
                add(node.attrs.get("src"), kind)
                if kind == "img":
                    for candidate in node.attrs.get("srcset", "").split(","):
                        add(candidate.strip().split(" ")[0], "img")
                    if lazy:
                        add(next((node.attrs[a] for a in LAZY if node.attrs.get(a)), None), "img")
                else:
                    for source in node.every("source"):
                        add(source.attrs.get("src"), kind)
        return list(found.items())

    def _linked_data(self, key: str) -> str | None:
        def address(value) -> str | None:
            if isinstance(value, dict):
                return next((value[k].strip() for k in ("url", "@id") if isinstance(value.get(k), str) and value[k].strip()), None)
            return next((a for a in map(address, value) if a), None) if isinstance(value, list) else None

        for node in self.root.every("script"):
            if node.attrs.get("type") != "application/ld+json":
                continue
            try:
                data = json.loads("".join(node.texts()))
            except ValueError:
                continue
            if isinstance(data, dict):
                data = data.get("@graph", [data])
            for item in data if isinstance(data, list) else [data]:
                found = address(item.get(key)) if isinstance(item, dict) else None
                if found:
                    return found
        return None

    def signal(self, name: str, base: str) -> str | None:
        """The publisher's address as one kind of element gives it."""
        def href(node: Node | None) -> str | None:
            return node.attrs.get("href", "").strip() or None if node else None

        if name in ("ldjson_author", "ldjson_publisher"):
            found = self._linked_data(name.removeprefix("ldjson_"))
        elif name == "og_url":
            found = next((x for k in ("og:url", "twitter:url") if (x := self._meta(("property", k), ("name", k)))), None)
        elif name == "rel_author":
            found = href(self.root.find("a", rel="author"))
        elif name == "itemprop_author":
            author = self.root.find(itemprop="author")
            found = (href(author.find(itemprop="url")) or href(author)) if author else None
        elif name == "dailymotion_channel":
            hits = (re.search(r'"channel":\{[^{}]*?"name":"([^"]+)"', "".join(s.texts())) for s in self.root.every("script"))
            found = next(("/" + m[1] for m in hits if m), None)
        else:
            found = href(self.root.find("link", rel="canonical"))
        return urljoin(base, found) if found else None


def parse(text: str) -> Document:
    return Document(text)


def text_media(text: str, base: str) -> list[tuple[str, str]]:
    """Media named in Markdown or by ``[IMAGE: …]`` marks."""
    found: dict[str, str] = {}
    for raw in re.findall(r"!\[[^\]]*\]\(([^)]+)\)", text):
        if raw.strip().lower().startswith("data:") or urlparse(raw.strip()).path.lower().endswith(IMAGE_ENDINGS):
            found.setdefault(urljoin(base, raw.strip()).lower(), "img")
    for label, raw in re.findall(r"\[(IMAGE|VIDEO|AUDIO):\s*([^\]]+)\]", text, re.I):
        kind = "img" if label.lower() == "image" else label.lower()
        if kind != "img" or urlparse(raw.strip()).path.lower().endswith(IMAGE_ENDINGS):
            found.setdefault(urljoin(base, raw.strip()).lower(), kind)
    return list(found.items())


PAGE = "title string, description string, keywords string, lang string, readable string, links array<string>, media array<struct<url: string, type: string>>"


def page_struct(html: Column | str, base: Column | str) -> Column:
    """One parse of each page: title, description, keywords, lang, readable, links and media; null pages give nulls."""

    def run(h: pd.Series, b: pd.Series) -> pd.DataFrame:
        rows = []
        for text, base_ in zip(h, b):
            if not text:
                rows.append((None,) * 7)
                continue
            page = parse(text)
            head = (page.title(), page.description(), page.keywords(), page.lang())
            links = [u for u, _ in page.links(base_ or "")]
            media = [{"url": u, "type": k} for u, k in page.media(base_ or "")]
            rows.append((*head, page.dropped().readable(), links, media))
        return pd.DataFrame(rows, columns=["title", "description", "keywords", "lang", "readable", "links", "media"])

    return F.pandas_udf(run, PAGE)(html, base)


def link_contexts(html: Column | str, base: Column | str) -> Column:
    """array<struct<url, dom, dom_html, context>> of each page's distinct links."""

    def run(h: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([[{"url": k, **v} for k, v in parse(t).link_contexts(x or "").items()] if t else [] for t, x in zip(h, b)])

    return F.pandas_udf(run, "array<struct<url: string, dom: string, dom_html: string, context: string>>")(html, base)


def truncated(html: Column, limit: int = 5120 * 1024) -> Column:
    """At most ``limit`` UTF-8 bytes, cut between characters."""

    def run(h: pd.Series) -> pd.Series:
        return pd.Series([x if x is None or len(x) * 4 <= limit else x.encode()[:limit].decode("utf-8", "ignore") for x in h], dtype=object)

    return F.when(F.octet_length(html) <= limit, html).otherwise(F.pandas_udf(run, "string")(html))


# --- native subset ----------------------------------------------------------------


def title_element(html: Column) -> Column:
    return F.trim(F.regexp_extract(html, "(?is)<title[^>]*>(.*?)</title>", 1))


def lang_attribute(html: Column) -> Column:
    return F.regexp_extract(html, "(?i)<html[^>]*?\\slang=\"([^\"]*)\"", 1)


def hrefs(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit("(?i)<a\\s[^>]*?href=\"([^\"]*)\""), 1)


def main_text(extracted: Column, html: Column | str, base: Column | str, least: int = 100) -> Column:
    """The extractor's text if it is longer than ``least``, else the page's readable text if that is, else null."""
    page = page_struct(html, base)["readable"]
    return F.when(F.length(extracted) > least, extracted).when(F.length(page) > least, page)


def lazy_media(html: Column | str, base: Column | str) -> Column:
    """Media of a rendered page, lazily loaded images among them."""

    def run(h: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([[{"url": u, "type": k} for u, k in parse(t).media(x or "", lazy=True)] if t else [] for t, x in zip(h, b)])

    return F.pandas_udf(run, "array<struct<url: string, type: string>>")(html, base)
