"""Problem 5: page boilerplate mixed with main content.

A host's pages are concatenated token streams, whose site name and digits are masked. The
streams' repeated substrings are found without sorting every suffix: a sparse suffix array
keeps the suffixes at line starts, up to the line's end, and those at anchors that the text itself
chooses (the least of ``WINDOW`` neighbouring hashes of ``SPAN`` tokens), so that equal stretches of ``SPAN + WINDOW`` tokens
share an anchor wherever they start. A suffix is ranked by the hash of its first tokens, and
equal ranks on distinct pages of the host, or of several hosts, are repeated substrings. Lines that these
cover are the standing furniture; a long line that varies in a word or two is covered by
the spans on either side. What is left are unique runs. Long unique runs are main text. Short
ones (headings, list items, but also paths, bylines, tags and teasers) are told apart by a
linear model over their words and their neighbours' coverage.

The model learns from a bounded sample of labelled pages: pages stored with their
elements, in which the elements tell body from furniture. No page needs elements when
it is judged.
"""

from __future__ import annotations

import html as _html
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.sites import by_site
from corpusloom.llm.skew import join_counted
from corpusloom.llm.spans import window_minima
from corpusloom.llm.tokenstream import Stream, chunks, mixed
from corpusloom.sources.tables import ensure_checkpoint_dir

#: Labelled pages for training, about.
SAMPLE = 1500
#: Pages of a host that must repeat a line, and the share of its pages.
HOST_PAGES, HOST_SHARE = 3, 0.004
#: Hosts that must repeat a line, and pages on average on each.
HOSTS, PAGES_PER_HOST = 3, 3
#: Words of a line that is a run of its own; repeated on ``HOST_PAGES`` pages it is furniture, however large the host.
LONG = 14
#: Tokens of a span that may start anywhere in a line, hashes among which its anchor is the least, and the share of a line that repeated spans must cover.
SPAN, WINDOW, COVERED = 12, 16, 0.8
#: Repeated substrings that are sent to the pages, if counted to be no more (32 MB); more meet them in a shuffle.
SENT = 1_000_000
FEATURES = 1 << 16


def site_name(url: Column) -> Column:
    """The first word of the host name, in lower case; empty where it is shorter than four letters."""
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), "^[a-zA-Z]+://(?:[^/@]*@)?(?:www\\.)?([^/:.\\-]+)", 1))
    return F.when(F.length(host) >= 4, host).otherwise("")


def streams(df: DataFrame, doc: str, host: str, url: str, content: str, same: DataFrame | None = None) -> DataFrame:
    """(doc, host, page, line_no, at, size, h, once) of every page with a line that is not blank.

    ``page`` identifies the address, so stored copies count once. The others are arrays with one item for each suffix: a
    whole line has ``at`` -1, a span the token of its line at which it starts; ``size`` is the line's number of tokens.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sites = batch.column(3).to_pylist()
            for rows, texts in chunks(batch.column(4).to_pylist()):
                texts = [t.casefold() for t in texts]
                s = Stream([t.replace(sites[i], "§") if sites[i] else t for i, t in zip(rows, texts)])
                start, end, line = s.tokens()
                first = np.searchsorted(line, np.arange(len(s.page) + 1))
                sizes = np.diff(first)
                n = len(start)
                at, keep = np.zeros(0, np.int64), np.zeros(0, np.int64)
                if n >= SPAN + WINDOW:
                    last = np.minimum(np.arange(n) + SPAN - 1, n - 1)
                    within = line[last] == line
                    within[n - SPAN + 1 :] = False
                    g = s.hashes(start, end[last]).view(np.uint64)
                    g[~within] = np.iinfo(np.uint64).max
                    least = window_minima(g, WINDOW)
                    # a hash is an anchor if it is the least of a window it stands in
                    most = ~window_minima(np.concatenate([np.full(WINDOW - 1, np.iinfo(np.uint64).max, np.uint64), ~least, np.full(WINDOW - 1, np.iinfo(np.uint64).max, np.uint64)]), WINDOW)
                    keep = np.flatnonzero(within & (most == g))
                    at = keep - first[line[keep]]
                lines = np.concatenate([np.arange(len(s.page)), line[keep]])
                order = np.argsort(lines, kind="stable")
                lines = lines[order]
                h = np.concatenate([s.line_hashes(), mixed(s.hashes(start[keep], end[np.minimum(keep + SPAN - 1, max(0, n - 1))]).view(np.uint64)).view(np.int64)])[order]
                at = np.concatenate([np.full(len(s.page), -1), at])[order]
                bounds = np.searchsorted(s.page[lines], np.arange(len(rows) + 1))
                some = np.flatnonzero(np.diff(bounds))
                # a suffix that a page has twice counts once
                once = np.zeros(len(h), bool)
                once[np.unique(mixed(h.view(np.uint64) + s.page[lines].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)[1]] = True
                take = pa.array(np.array(rows)[some], pa.int64())
                offsets = pa.array(np.append(bounds[some], len(lines)), pa.int32())
                made = [pa.ListArray.from_arrays(offsets, x) for x in (pa.array(s.number[lines], pa.int32()), pa.array(at, pa.int32()), pa.array(sizes[lines], pa.int32()), pa.array(h), pa.array(once))]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(take) for c in range(3)), *made], names=["doc", "host", "page", "line_no", "at", "size", "h", "once"])

    kinds = [df.schema[c].dataType.simpleString() for c in (doc, host)]
    rows = df.select(F.col(f"`{doc}`").alias("doc"), F.col(f"`{host}`").alias("host"), F.coalesce(F.xxhash64(f"`{url}`"), F.lit(0)).alias("page"), site_name(F.col(f"`{url}`")).alias("site"), F.col(f"`{content}`").alias("content"))
    found = rows.filter("doc IS NOT NULL AND content RLIKE '\\\\S'").mapInArrow(run, f"doc {kinds[0]}, host {kinds[1]}, page bigint, line_no array<int>, at array<int>, size array<int>, h array<bigint>, once array<boolean>")
    return by_site(found, "host", same)


def repeated_runs(pages: DataFrame) -> DataFrame:
    """(host, h, share, hosts, n): the suffixes repeated across a host's pages or across hosts.

    ``share`` is the part of the host's pages that hold it, ``hosts`` the number of hosts that repeat it, ``n`` the pages. Short lines and
    spans must stand on ``HOST_SHARE`` of the host's pages, since on a large host some repeat by chance; long lines do not. A page
    stored several times counts once, as its row of the smallest ``doc``.
    """
    ids = pages.groupBy("host", "page").agg(F.min("doc").alias("doc"), F.count(F.lit(1)).alias("rows"), F.count_distinct("doc").alias("docs")).checkpoint()
    once = pages.join(ids.select("doc").distinct(), "doc", "left_semi")
    if not ids.filter("rows > docs").isEmpty():  # rows that repeat a document
        once = once.dropDuplicates(["doc"])
    kind = F.when(F.col("at") >= 0, 2).when(F.col("size") >= LONG, 1).otherwise(0)
    per_page = once.select("host", F.inline(F.arrays_zip("at", "size", "h", "once"))).filter("once").select("host", "h", kind.alias("kind"))
    seen = per_page.groupBy("host", "h", "kind").agg(F.count(F.lit(1)).alias("n"))
    sizes = ids.groupBy("host").agg(F.count(F.lit(1)).alias("pages")).withColumnRenamed("host", "host2")
    lines = seen.filter("kind < 2")
    wide = lines.groupBy("h").agg(F.count(F.lit(1)).alias("hosts"), F.sum("n").alias("all_n")).filter((F.col("hosts") >= HOSTS) & (F.col("all_n") >= PAGES_PER_HOST * F.col("hosts"))).select(F.col("h").alias("h2"), "hosts")
    both = seen.join(wide, (F.col("h") == F.col("h2")) & (F.col("kind") < 2), "left").filter((F.col("n") >= HOST_PAGES) | F.col("hosts").isNotNull())
    both = both.join(sizes, F.col("host").eqNullSafe(F.col("host2")))
    share = F.col("n") / F.col("pages")
    return both.filter(((F.col("n") >= HOST_PAGES) & ((share >= HOST_SHARE) | (F.col("kind") == 1))) | F.col("hosts").isNotNull()).select("host", "h", share.cast("float").alias("share"), F.coalesce("hosts", F.lit(0)).cast("int").alias("hosts"), "n")


def covered(pages: DataFrame, runs: DataFrame) -> DataFrame:
    """(doc, cover): for each page the covered lines as an array of (line_no, share, hosts).

    A line is covered as a whole, or by repeated spans that together hold ``COVERED`` of its tokens.
    """
    suffixes = pages.select("doc", "host", F.inline(F.arrays_zip("line_no", "at", "size", "h")))
    if runs.count() <= SENT:
        r = F.broadcast(runs.select(F.col("host").alias("host2"), F.col("h").alias("h2"), "share", "hosts"))
        hit = suffixes.join(r, (F.col("h") == F.col("h2")) & F.col("host").eqNullSafe(F.col("host2")))
    else:
        hit = join_counted(suffixes, runs, ["host", "h"], "n")
    # tokens held by the spans: up to the next start, or to the span's end
    starts = F.array_sort(F.collect_set(F.when(F.col("at") >= 0, F.col("at"))))
    per = hit.groupBy("doc", "line_no", "size").agg(starts.alias("starts"), F.max("share").alias("share"), F.max("hosts").alias("hosts"), F.max(F.col("at") < 0).alias("whole"))
    next_start = F.slice(F.concat(F.col("starts"), F.array(F.lit(1 << 30))), 2, F.size("starts"))
    held = F.aggregate(F.zip_with("starts", next_start, lambda a, b: F.when(b - a <= max(SPAN, WINDOW), b - a).otherwise(SPAN)), F.lit(0), lambda acc, x: acc + x)
    per = per.filter(F.col("whole") | (held >= COVERED * F.col("size")))
    return per.groupBy("doc").agg(F.collect_list(F.struct("line_no", "share", "hosts")).alias("cover"))


# --- the model of short unique runs -------------------------------------------------

_WORDS = re.compile(r"[^\W\d_]+|\d+|[^\w\s]")
_STOP = re.compile(r"[.!?…][»”\"')\]]*$")
_BULLET = re.compile(r"^(?:[•*+\-–—·▪‣]|\d{1,3}[.)])\s+")
_PATH = re.compile(r"\s[›»→>]\s")
_MENU = re.compile(r"\s[|·•/›»>–]\s")


def _shape(word: str) -> str:
    return "N" if word[0].isupper() else "0" if word[0].isdigit() else word


class Page:
    """The lines of a page that are not blank, with their coverage."""

    def __init__(self, content: str, cover: list[dict] | None):
        shares = {c["line_no"]: (c["share"], c["hosts"]) for c in cover or ()}
        self.no: list[int] = []
        self.text: list[str] = []
        self.cover: list[float] = []
        self.hosts: list[int] = []
        for no, line in enumerate(content.split("\n"), 1):
            line = line.strip()
            if line:
                self.no.append(no)
                self.text.append(line)
                share, hosts = shares.get(no, (0.0, 0))
                self.cover.append(share)
                self.hosts.append(hosts)
        self.size = [line.count(" ") + 1 for line in self.text]
        self.stop = [bool(_STOP.search(line)) for line in self.text]

    def sure(self, i: int) -> int:
        """1 furniture, 0 main text, -1 to be judged."""
        if self.cover[i] or self.hosts[i]:
            return 1
        if self.size[i] >= LONG and self.stop[i] and not (self.size[i] < 24 and len(_MENU.findall(self.text[i])) >= 3):
            return 0
        return -1

    def features(self, i: int, sure: list[int], last: int) -> list[int]:
        text, n = self.text[i], self.size[i]
        words = _WORDS.findall(text)
        low = [w.lower() for w in words]
        shapes = [_shape(w) for w in words]
        head = low[0] if low else ""
        prev = sure[i - 1] if i else 2
        nxt = sure[i + 1] if i + 1 < len(sure) else 2
        nxt2 = sure[i + 2] if i + 2 < len(sure) else 2
        back, j = 0, i - 1
        while j >= 0 and sure[j] == -1 and back < 6:
            back += 1
            j -= 1
        opener = self.text[j].lower()[:40] if j >= 0 and sure[j] == 1 else "none" if j < 0 else "long"
        bullet = bool(_BULLET.match(text))
        title = any(text != t and t.endswith(text) and _PATH.search(t) for t in self.text[max(0, i - 8) : i])
        path = bool(_PATH.search(text)) and any(text.endswith(t) and t != text for t in self.text[i + 1 : i + 10] if len(t) > 8)
        seps = min(3, len(_MENU.findall(text)))
        names = [
            "w0=" + head, "w01=" + " ".join(low[:2]), "s012=" + " ".join(shapes[:3]), "w-1=" + (low[-1] if low else ""), "s-2=" + " ".join(shapes[-2:]), "s-3=" + " ".join(shapes[-3:]),
            f"n={min(n, 20)}", f"stop={self.stop[i]}", f"bullet={bullet}", f"seps={seps}", f"path={path}", f"title={title}", f"digit={any(c.isdigit() for c in text)}",
            f"prev={prev}", f"next={nxt}", f"around={prev},{nxt},{nxt2}", f"last={last}", f"last,next={last},{nxt}", f"opener={opener}", f"opener,back={opener},{back}", f"back={back},{nxt}", f"back,last={back},{last}",
            f"first={i < 3}", f"end={len(sure) - i < 3}", f"upper={text.isupper()}", "whole=" + " ".join(shapes[:8]) if n <= 8 else "long", f"colon={':' in text}", f"colon,last={':' in text},{last},{bullet}", f"n,next={min(n, 8)},{nxt},{last}",
        ]
        crc = zlib.crc32
        return [crc(x.encode()) & (FEATURES - 1) for x in names]


def judge(weights: np.ndarray, content: str, cover: list[dict] | None) -> list[int]:
    """Numbers of the lines that are no main body."""
    page = Page(content, cover)
    sure = [page.sure(i) for i in range(len(page.no))]
    out, last = [], 1
    for i, s in enumerate(sure):
        if s < 0:
            s = int(weights[page.features(i, sure, last)].sum() > 0)
        if s:
            out.append(page.no[i])
        last = s
    return out


# --- labels from stored elements --------------------------------------------------

_TOKEN = re.compile(r"<!--.*?-->|<(script|style|title|noscript)\b.*?</\1\s*>|<[^<>]*>|[^<]+", re.S | re.I)
_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)([^<>]*)>")
_CLASS = re.compile(r"\bclass\s*=\s*[\"']?([^\"'>]+)")
_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre div td th section article aside nav header footer main ul ol table tr body figure dd dt form".split())
_FURNITURE = frozenset("nav aside footer header form".split())
_BODY = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre dd dt".split())


def blocks(page: str) -> list[tuple[str, str, str, bool, bool]]:
    """(text, element, class, in a furniture element, all of it linked) of each text block."""
    out = []
    stack: list[tuple[str, str]] = []
    piece: list[str] = []
    plain = link = 0
    in_link = False

    def close() -> None:
        nonlocal plain, link
        text = " ".join(_html.unescape("".join(piece)).split())
        if text:
            near = next(((n, c) for n, c in reversed(stack) if n in _BLOCKS), ("", ""))
            held = any(n in _FURNITURE for n, _ in stack)
            out.append((text, near[0], near[1], held, link > 0 and plain == 0))
        piece.clear()
        plain = link = 0

    for m in _TOKEN.finditer(page):
        token = m[0]
        if token[0] != "<":
            piece.append(token)
            if token.strip():
                if in_link:
                    link += 1
                else:
                    plain += 1
            continue
        t = _TAG.match(token)
        if not t or m[1]:
            continue
        name = t[2].lower()
        if name == "a":
            in_link = not t[1]
        elif name == "br":
            close()
        elif name in _BLOCKS or name == "span" and link and not plain:
            close()
            if name in _BLOCKS:
                if not t[1]:
                    if name in ("p", "h1", "h2", "h3", "h4", "li") and stack and stack[-1][0] in ("p", "li" if name == "li" else "p"):
                        stack.pop()
                    c = _CLASS.search(t[3])
                    stack.append((name, c[1].strip() if c else ""))
                else:
                    for k in range(len(stack) - 1, -1, -1):
                        if stack[k][0] == name:
                            del stack[k:]
                            break
    close()
    return out


def key_of(text: str) -> str:
    return " ".join(re.sub(r"\d+", "0", text.lower()).split())


def training_lines(rows: list[tuple[str, str, str, list[dict] | None]]) -> list[tuple[list[int], int]]:
    """(features, furniture?) of the short unique lines of labelled pages: rows of (host, html, content, cover)."""
    parsed = []
    tally: dict[tuple[str, str], list[int]] = {}
    for host, html, content, cover in rows:
        page = Page(content, cover)
        marked = {key_of(t): c for t, c in zip(page.text, page.cover)}
        found = blocks(html)
        parsed.append((host, page, found))
        for text, _, cls, _, _ in found:
            if cls:
                seen = tally.setdefault((host, cls), [0, 0])
                seen[0] += 1
                seen[1] += marked.get(key_of(text), 0.0) > 0
    out = []
    for host, page, found in parsed:
        label: dict[str, int] = {}
        paragraphs = sum(e == "p" for _, e, _, _, _ in found)
        for text, element, cls, held, linked in found:
            seen, repeated = tally.get((host, cls), (0, 0)) if cls else (0, 0)
            if element == "h1":
                kind = 0
            elif held or linked or (seen >= 2 and repeated >= 0.25 * seen):
                kind = 1
            elif element in _BODY and not cls:
                kind = 0
            elif element == "td" and paragraphs and len(text.split()) < LONG:
                kind = 1
            else:
                continue
            label.setdefault(key_of(text), kind)
        sure = [page.sure(i) for i in range(len(page.no))]
        truth = [s if s >= 0 else label.get(key_of(_BULLET.sub("", t)), label.get(key_of(t), -1)) for s, t in zip(sure, page.text)]
        last = 1
        for i, s in enumerate(sure):
            if s < 0 and truth[i] >= 0:
                out.append((page.features(i, sure, last), truth[i]))
            last = max(truth[i], 0)
    return out


def train(examples: list[tuple[list[int], int]], rounds: int = 8) -> np.ndarray:
    """Weights of a logistic model by stochastic gradient steps with decreasing length."""
    weights = np.zeros(FEATURES)
    squares = np.full(FEATURES, 1e-2)
    order = np.random.default_rng(7)
    for _ in range(rounds):
        for k in order.permutation(len(examples)):
            at, y = examples[k]
            z = float(weights[at].sum())
            p = 1.0 / (1.0 + np.exp(-max(-30.0, min(30.0, z))))
            g = p - y
            np.add.at(squares, at, g * g)
            np.subtract.at(weights, at, 0.25 * g / np.sqrt(squares[at]))
    return weights.astype(np.float32)


def seed_examples() -> list[tuple[list[int], int]]:
    """What holds without any labelled page: a title before text is body; so is a list item; a short line after furniture is not."""
    body = "Title of the page\nThis is a first sentence of the text that goes on for as long as it needs to be long enough.\nA heading\nAnother long sentence of the page follows here and goes on until it is long enough to stand.\n- an item\n- one more item"
    return [(Page(body, None).features(i, [-1, 0, -1, 0, -1, -1], 0), 0) for i in (0, 2, 4, 5)]


def fit(pages: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """Weights from a bounded sample of ``pages`` (doc, host, html, content, cover) with stored elements."""
    have = pages.filter("html IS NOT NULL AND content RLIKE '\\\\S'")
    rows = [(str(r["host"]), r["html"], r["content"], [c.asDict() for c in r["cover"] or ()]) for r in have.orderBy(F.xxhash64("doc")).limit(sample).collect()]
    return train(training_lines(rows) + seed_examples())


def furniture_lines(df: DataFrame, doc: str, host: str, url: str, content: str, html: str, *, without: DataFrame | None = None, same: DataFrame | None = None) -> DataFrame:
    """(doc, line_no): every line of a page that is not its main body.

    Null and blank contents have no rows, nor have the pages of ``without``. The host of a page may
    be null, which is a host of its own; ``same`` (source, site) names hosts that are one. Without pages with stored elements the seeds stand alone.
    """
    ensure_checkpoint_dir(df.sparkSession)
    rows = df.filter(F.col(f"`{doc}`").isNotNull())
    # every text is folded and split once; its suffixes, without any text, serve the counts and the cover
    pages = streams(rows, doc, host, url, content, same).checkpoint()
    cover = covered(pages, repeated_runs(pages).checkpoint()).checkpoint()
    stored = rows.filter(F.col(f"`{html}`").isNotNull() & F.col(f"`{content}`").rlike("\\S")).select(F.col(f"`{doc}`").alias("doc"))
    chosen = stored.orderBy(F.xxhash64("doc")).limit(SAMPLE).select(F.col("doc").alias("_doc")).distinct()  # at most SAMPLE rows
    labelled = rows.select(F.col(f"`{doc}`").alias("doc"), F.col(f"`{host}`").alias("host"), F.col(f"`{html}`").alias("html"), F.col(f"`{content}`").alias("content"))
    labelled = labelled.join(F.broadcast(chosen), F.col("doc") == F.col("_doc"), "left_semi")
    labelled = by_site(labelled, "host", same).join(cover, "doc", "left")
    weights = df.sparkSession.sparkContext.broadcast(fit(labelled))
    texts = rows.select(F.col(f"`{doc}`").alias("doc"), F.col(f"`{content}`").alias("content"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = weights.value
        for batch in batches:
            at, nos = [], []
            for i, (text, cover) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                if text:
                    for no in judge(w, text, cover):
                        at.append(i)
                        nos.append(no)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(nos, pa.int64())], names=["doc", "line_no"])

    kind = df.schema[doc].dataType.simpleString()
    joined = texts.filter("content IS NOT NULL").join(cover, "doc", "left")
    found = joined.select("doc", "content", "cover").mapInArrow(run, f"doc {kind}, line_no bigint")
    if without is not None:
        found = found.join(without.select("doc"), "doc", "left_anti")
    return found
