"""Problem 4: template residue, filler and error-page text.

The lines of all pages are masked (numbers, paths, slots) and counted, and a prefix
tree of fixed depth mines their message templates: a leaf is named by the number of tokens and the first
``DEPTH`` of them, and within a leaf lines that agree in most places share a
template, whose other places become wildcards. Each template is classified once, by
what it is made of (slots, filler), by a model of machine messages learned on seeds
and on labelled templates (``messages``), by the sites over which the same line
spreads and by the share of its pages that it fills. The verdict goes to all lines of the
template, and the lines of a page decide about the page: it has a line of residue, none of text, and
without its residue less prose than an article. Spread counts on thin pages only, since whole articles are copied too.

A masked line is known by 64 bits of hash, so only distinct lines travel as text.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import messages
from corpusloom.llm.messages import fold
from corpusloom.llm.sites import by_site
from corpusloom.llm.skew import join_counted
from corpusloom.sources.tables import ensure_checkpoint_dir

#: Leading tokens that name a leaf of the prefix tree, besides the number of tokens.
DEPTH = 2
#: Share of places in which a line must agree with a template of its leaf.
ALIKE = 0.6
#: Distinct lines of a leaf in one task; a larger leaf is split by a hash of the line.
LEAF = 5_000
#: Pages whose lines a task holds at once.
PAGES = 2_000
#: Words of prose, other than residue, with which a page is an article; a page with fewer in all is thin.
PROSE = 80
#: Sources that must have the same masked sentence before its spread counts.
SPREAD = 3
#: One ordinary page of so many lends its lines to the training; of them and of the labelled templates at most ``LABELLED`` each are taken.
LENT, LABELLED = 64, 800
#: Lines and share of pages with an error status that label a template as a message.
LABEL_LINES, LABEL_SHARE = 8, 0.3

# Notations of slots that a template engine should have filled.
SLOT = re.compile(
    r"\{\{\{?[^{}\n]*\}?\}\}|\{%[^\n]*?%\}|<%[^\n]*?%>|<\?(?:php|=)[^\n]*?\?>|\$\{[^{}\n]*\}|#\{[^{}\n]*\}"
    r"|\$[A-Za-z_]\w*\$|#[A-Za-z_]\w*#|%%\w+%%|%[A-Z][A-Z_0-9]+%|\*\|\w+\|\*|<<\w+>>|&lt;&lt;\w+&gt;&gt;|__[A-Za-z]\w*?__|@@?\w+@@?(?=\s|$|,)|##\w+##"
    r"|\[insert [^\]\n]*\]|\[[A-Z][A-Z_0-9 ]*\]|\[[a-z]+(?:_[a-z]+)*\]|\{[A-Za-z_][\w.]*\}|\{\d\}"
)
# Words of the usual filler text.
FILLER = frozenset(
    "lorem ipsum dolor sit amet consectetur consectetuer adipiscing adipisicing elit sed do eiusmod tempor incididunt ut labore et dolore magna"
    " aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in"
    " reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia"
    " deserunt mollit anim id est laborum vitae augue erat felis nisl morbi urna donec ligula porta mauris lectus vestibulum pellentesque"
    " praesent vivamus curabitur phasellus aenean integer nunc tellus massa sapien tristique viverra faucibus ornare pretium diam justo".split()
)
# Words typed to fill a page.
TYPED = re.compile(r"^(?:x{2,}|y{3,}|z{3,}|(?:asdf|qwer|qwertz?|zxcv|yxcv|jkl|hjkl)\w*|(?:bla|blah|foo|bar|baz|test|text|texte|texto|testo|prova|prueba|teste|essai|todo|tbd|tba|n/a|null|undefined|nan|none|dummy|sample)\d*|\d+)$")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_SIGNS = re.compile(r"[{}\[\]<>$%*_@#]")
_MENU = re.compile(r"[|·•/›»>–]")
#: The characters of ``_SIGNS`` and ``_MENU``, and the beginnings of slots: most pages have no sign and no slot, which is seen without a pattern.
SIGNS, MENU, OPENINGS = "{}[]<>$%*_@#", "|·•/›»>–", ("{", "[", "<", "$", "%", "#", "@", "__", "*|", "&lt;")
_FOOTER = re.compile(r"©|\(c\)|copyright", re.I)


def made_of(line: str) -> str | None:
    """slot, filler or none for lines that are known by what they are made of; null for others."""
    slots = len(SLOT.findall(line)) if any(c in line for c in "{[<$%*_@#") else 0
    folded = fold(SLOT.sub(" ", line) if slots else line)
    words = _WORD.findall(folded)
    n = len(words)
    if slots and (n <= 3 * slots or slots / (slots + n) >= 0.2):
        return "slot"
    if len(line) < 120 and _FOOTER.search(line):
        return "none"
    if not slots and len(_MENU.findall(line)) >= 3:
        return "none"
    if n and sum(map(FILLER.__contains__, words)) >= 0.6 * n and (n >= 3 or folded.startswith("lorem")):
        return "filler"
    tokens = folded.strip(" .,:;!?…").split()
    if tokens and all(TYPED.match(t.strip(".,:;!?")) for t in tokens) and any(not t.isdigit() for t in tokens):
        return "filler"
    return None


def line_kind(line: str, scorer: messages.Scorer | None = None, n_sources: int = 1, fill: float = 0.5, template: str | None = None) -> str:
    """slot, filler, message, text, or none (menus, footers, and what is too short to tell).

    ``n_sources`` have the line, which fills the share ``fill`` of its pages; what varies in its ``template`` has no weight. Without a ``scorer`` the seeds alone decide.
    """
    line = line.strip()
    if not line:
        return "none"
    kind = made_of(line)
    if kind:
        return kind
    if line.isdigit():
        return "message" if len(line) == 3 and line[0] in "45" else "none"
    n = len(_WORD.findall(line))
    # a long line is seldom a message, and a very short one says little
    bar = 1.0 if n < 6 else 0.5 if n <= 22 else 3.0
    if n >= 6:
        bar -= fill - 0.5
        if n_sources >= SPREAD:
            bar -= 2.0
    if (scorer or messages.seed_scorer()).exceeds(template.replace("<*>", " ") if template else mask(line), bar):
        return "message"
    return "text" if n >= 6 else "none"


def prose(line: str, n: int, signs: bool = True) -> int:
    """The ``n`` words of a line if it is one of prose, else 0; ``signs``: whether it may have any of ``SIGNS``."""
    if n < 10 or signs and _SIGNS.search(line) or sum(map(line.count, MENU)) >= 3:
        return 0
    return 0 if sum(map(FILLER.__contains__, line[:300].lower().split())) >= 0.4 * min(n, 45) else n


_NUMBER = re.compile(r"\d+")
_PATH = re.compile(r"/(?<!\S/)[\w./-]+")  # the sign comes first, since it is sought


def mask(line: str) -> str:
    """The line with its variable parts masked: the token sequence that the prefix tree sees."""
    line = SLOT.sub("<slot>", line)
    return " ".join(_NUMBER.sub("<n>", _PATH.sub("<path>", line)).split())


def masked_lines(text: str) -> tuple[list[str], bool]:
    """``mask`` of each line that is not blank, and whether a slot was masked; no pattern goes over a line feed, so each runs once over the page."""
    slots = 0
    if any(map(text.__contains__, OPENINGS)):
        text, slots = SLOT.subn("<slot>", text)
    if "/" in text:
        text = _PATH.sub("<path>", text)
    lines = [" ".join(line.split()) for line in _NUMBER.sub("<n>", text).split("\n")]
    return [line for line in lines if line], slots > 0


def unmasked(masked: str) -> str:
    """A line as it may have read: a number alone is a status, other masks become samples."""
    if masked == "<n>":
        return "404"
    return masked.replace("<slot>", "{{slot}}").replace("<n>", "17").replace("<path>", "/path")


def mine(masked: list[str], alike: float = ALIKE) -> list[str]:
    """The template of each masked line of one leaf: the first one so far that agrees in the most places, and in enough.

    Templates are found by their tokens: a line that agrees in enough of its places agrees in one of
    any ``places - enough + 1`` of them, so only the templates under its rarest tokens are compared.
    """
    templates: list[list[str]] = []
    under: dict[tuple[int, int, str], list[int]] = {}
    member: list[int] = []
    for line in masked:
        tokens = line.split()
        n = len(tokens)
        enough = max(1, -(-int(alike * n * 1000) // 1000))
        keys = sorted((under.get((n, i, t), ()) for i, t in enumerate(tokens)), key=len)
        best, most = -1, 0
        for i in sorted({i for places in keys[: n - enough + 1] for i in places}):
            same = sum([a == b for a, b in zip(templates[i], tokens)])
            if same >= enough and same > most:
                best, most = i, same
        if best < 0:
            best = len(templates)
            templates.append(tokens)
            for i, t in enumerate(tokens):
                under.setdefault((n, i, t), []).append(best)
        elif most < n:
            old = templates[best]
            for i, (a, b) in enumerate(zip(old, tokens)):
                if a != b and a != "<*>":
                    under[n, i, a].remove(best)
            templates[best] = [a if a == b else "<*>" for a, b in zip(old, tokens)]
        member.append(best)
    return [" ".join(templates[i]) for i in member]


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (batch.slice(lo, PAGES) for batch in batches for lo in range(0, batch.num_rows, PAGES))


def page_lines(df: DataFrame, doc: str, source: str, content: str, failed: Column | None = None) -> DataFrame:
    """(doc, source, failed, thin, lent, first, masked, words, prose): every page with its lines that are not blank, as arrays.

    ``prose`` has the words of lines of prose, 0 for others, ``first`` the place, from 1, of the line that has most; one ordinary page
    in ``LENT`` is ``lent`` to the training. Pages with null or blank content have no row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sliced(batches):
            at, thins, lent, first, masks, words, proses = [], [], [], [], [], [], []
            for i, text in enumerate(batch.column(3).to_pylist()):
                if not text or text.isspace():
                    continue
                lines = [line for line in text.split("\n") if line and not line.isspace()]
                masked, slots = masked_lines(text)
                # but for slots, masks keep the number of words
                sizes = [len(line.split()) for line in lines] if slots else [m.count(" ") + 1 for m in masked]
                signs = any(map(text.__contains__, SIGNS))
                have = [prose(line, n, signs) for line, n in zip(lines, sizes)]
                at.append(i)
                thins.append(sum(have) < PROSE)
                lent.append(not thins[-1] and zlib.crc32(text.encode("utf-8", "replace")) % LENT == 0)
                first.append(have.index(max(have)) + 1)
                masks.append(masked)
                words.append(sizes)
                proses.append(have)
            take = pa.array(at, pa.int64())
            made = [pa.array(thins, pa.bool_()), pa.array(lent, pa.bool_()), pa.array(first, pa.int32()), pa.array(masks, pa.list_(pa.string())), pa.array(words, pa.list_(pa.int32())), pa.array(proses, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(take) for c in range(3)), *made], names=["doc", "source", "failed", "thin", "lent", "first", "masked", "words", "prose"])

    kinds = [df.schema[c].dataType.simpleString() for c in (doc, source)]
    rows = df.select(F.col(f"`{doc}`").alias("doc"), F.col(f"`{source}`").alias("source"), F.coalesce(F.lit(False) if failed is None else failed, F.lit(False)).alias("failed"), F.col(f"`{content}`").alias("content"))
    return rows.filter("doc IS NOT NULL AND content IS NOT NULL").mapInArrow(run, f"doc {kinds[0]}, source {kinds[1]}, failed boolean, thin boolean, lent boolean, first int, masked array<string>, words array<int>, prose array<int>")


def line_texts(df: DataFrame, doc: str, content: str) -> DataFrame:
    """(masked): the masked lines of the pages of ``page_lines``, each once for ``PAGES`` pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sliced(batches):
            found = dict.fromkeys(line for text in batch.column(0).to_pylist() for line in masked_lines(text)[0])
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string())], names=["masked"])

    rows = df.filter(F.col(f"`{doc}`").isNotNull() & F.col(f"`{content}`").isNotNull())
    return rows.select(F.col(f"`{content}`").alias("content")).mapInArrow(run, "masked string")


def counted_lines(lines: DataFrame) -> DataFrame:
    """(h, n_lines, n_sites, n_sources, n_thin, failed, fill, fill_thin, lent) of each masked line, by its hash.

    ``n_sources`` are the sites that have it on a thin page, ``n_sites`` all; ``fill`` sums the shares of its pages' words.
    """
    thin = F.col("thin")
    one = lines.groupBy("h", "source").agg(F.count(F.lit(1)).alias("n"), F.count_if(thin).alias("n_thin"), F.count_if("failed").alias("failed"), F.sum("fill").alias("fill"), F.sum(F.when(thin, F.col("fill")).otherwise(0.0)).alias("fill_thin"), F.max("lent").alias("lent"))
    sums = [F.sum(c).alias(c) for c in ("n_thin", "failed", "fill", "fill_thin")]
    return one.groupBy("h").agg(F.sum("n").alias("n_lines"), F.count(F.lit(1)).alias("n_sites"), F.count_if(F.col("n_thin") > 0).alias("n_sources"), *sums, F.max("lent").alias("lent"))


_COUNTS = ["n_lines", "n_sites", "n_sources", "n_thin", "failed", "fill", "fill_thin", "lent"]


def mined_lines(texts: DataFrame, counted: DataFrame) -> DataFrame:
    """(h, t, masked, template, n_lines, …): each distinct masked line with ``t``, the hash of the template it belongs to.

    Equal lines are counted before they reach a leaf, so a frequent message is one row there. A leaf of more
    than ``LEAF`` distinct lines is mined in as many parts; parts that mine the same template share it.
    The text ``masked`` is kept for lines that speak for their template and for those lent to the training, ``template`` where it is another text.
    """
    tokens = F.split("masked", " ")
    leaves = texts.withColumn("leaf", F.concat_ws(" ", F.size(tokens).cast("string"), F.slice(tokens, 1, DEPTH)))
    # at most one leaf for every LEAF lines is large
    large = leaves.groupBy("leaf").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > LEAF)
    parted = leaves.join(F.broadcast(large), "leaf", "left").withColumn("part", F.pmod(F.col("h"), F.coalesce(F.ceil(F.col("size") / LEAF), F.lit(1))).cast("int")).join(counted, "h")
    names = ["h", "t", "masked", "template", *_COUNTS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # leaves are many and small: they are told apart by the order of the rows, not handed over one by one
        begun: list[pa.RecordBatch] = []
        for batch in batches:
            last = int(_starts(batch)[-1]) if batch.num_rows else 0
            if last:
                yield mined_leaves([*begun, batch.slice(0, last)])
                begun = []
            begun.append(batch.slice(last))
        if begun:
            yield mined_leaves(begun)

    ordered = parted.repartition("leaf", "part").sortWithinPartitions("leaf", "part", F.col("n_lines").desc(), "masked").select("leaf", "part", "h", "masked", *_COUNTS)
    mined = ordered.mapInArrow(run, "h bigint, template string, masked string, n_lines bigint, n_sites bigint, n_sources bigint, n_thin bigint, failed bigint, fill double, fill_thin double, lent boolean")
    mined = mined.withColumn("t", F.xxhash64(F.coalesce("template", "masked")))
    return mined.withColumn("template", F.when(F.col("masked").isNotNull(), F.col("template"))).select(*names)


def _starts(rows: pa.RecordBatch | pa.Table) -> np.ndarray:
    """Where a leaf, or a part of one, begins in rows in their order."""
    n = rows.num_rows
    other = np.ones(n, bool)
    if n > 1:
        other[1:] = pc.or_(*(pc.not_equal(c.slice(1), c.slice(0, n - 1)) for c in (rows.column(0), rows.column(1)))).to_numpy(zero_copy_only=False)
    return np.flatnonzero(other)


def mined_leaves(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    """(h, template, masked, n_lines, …) of rows (leaf, part, h, masked, n_lines, …) of whole leaves, in their order.

    ``template`` is null where it is the text ``masked``. A line alone in its leaf is its own template and never leaves its array.
    """
    rows = pa.Table.from_batches(batches).combine_chunks()
    starts = _starts(rows)
    sizes = np.diff(np.append(starts, rows.num_rows))
    many = np.repeat(sizes > 1, sizes)
    column = {c: rows.column(c).combine_chunks() if rows.num_rows else pa.array([], rows.schema.field(c).type) for c in rows.column_names[2:]}
    lines, *weights, lent = (column[c].filter(pa.array(many)).to_pylist() for c in ("masked", "n_thin", "n_lines", "lent"))
    weights = list(zip(*weights, lines))
    named: list[str | None] = []
    keep = list(lent)
    lo = 0
    for size in sizes[sizes > 1].tolist():
        found = mine(lines[lo : lo + size])
        speaks: dict[str, int] = {}
        for i, t in enumerate(found, lo):
            if t not in speaks or weights[speaks[t]] < weights[i]:
                speaks[t] = i
        for i in speaks.values():
            keep[i] = True
        named += [None if k and t == line else t for t, line, k in zip(found, lines[lo : lo + size], keep[lo : lo + size])]
        lo += size
    nothing, at = pa.nulls(rows.num_rows, pa.string()), pa.array(many)
    kept = np.ones(rows.num_rows, bool)
    kept[many] = keep
    made = [column["h"], pc.replace_with_mask(nothing, at, pa.array(named, pa.string())), pc.if_else(pa.array(kept), column["masked"], nothing)]
    return pa.RecordBatch.from_arrays([*made, *(column[c] for c in _COUNTS)], names=["h", "template", "masked", *_COUNTS])


def fit(mined: DataFrame, grouped: DataFrame) -> np.ndarray:
    """Weights from the seeds, from templates whose pages often have an error status, and from lines of ordinary pages; at most ``LABELLED`` of either reach the driver."""
    failing = grouped.filter((F.col("n_lines") >= LABEL_LINES) & (F.col("failed") >= LABEL_SHARE * F.col("n_lines")) & (F.col("n_sites") >= SPREAD)).orderBy(F.col("n_lines").desc(), "masked").limit(LABELLED)
    ordinary = mined.filter("lent").select("t", "masked").join(failing.select("t"), "t", "left_anti").orderBy(F.xxhash64("masked"), "masked").limit(LABELLED)
    labelled = failing.select("masked", F.lit(1).alias("y")).unionByName(ordinary.select("masked", F.lit(0).alias("y")))
    found = sorted((r["masked"], r["y"]) for r in labelled.collect() if made_of(unmasked(r["masked"])) is None)
    return messages.train(messages.seed_examples() + found) if found else messages.seed_weights()


def templates(lines: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """(t, template, masked, n_lines, n_sources, fill) of each template, (h, t, n_lines) of their lines, and the weights of the model.

    The most frequent line of a template, on thin pages if it has any, speaks for it; its spread is that of its most spread line.
    """
    mined = mined_lines(texts, counted_lines(lines)).checkpoint()
    sums = [F.sum(c).alias(c) for c in ("n_lines", "n_thin", "failed", "fill", "fill_thin")]
    speaks = F.max(F.when(F.col("masked").isNotNull(), F.struct("n_thin", "n_lines", "masked", F.coalesce("template", "masked").alias("template")))).alias("s")
    grouped = mined.groupBy("t").agg(speaks, *sums, F.max("n_sources").alias("n_sources"), F.max("n_sites").alias("n_sites"))
    grouped = grouped.select("*", "s.masked", "s.template").drop("s")
    fill = F.when(F.col("n_thin") > 0, F.col("fill_thin") / F.col("n_thin")).otherwise(F.col("fill") / F.col("n_lines"))
    return grouped.select("t", "template", "masked", "n_lines", "n_sources", fill.alias("fill")), mined.select("h", "t", "n_lines"), fit(mined, grouped)


def classified(grouped: DataFrame, weights: np.ndarray) -> DataFrame:
    """(t, template, kind, n_lines, n_sources): the verdict on each template."""
    sent = grouped.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = messages.Scorer(sent.value)
        for batch in batches:
            kinds = [line_kind(unmasked(m), scorer, s, f, t) for m, s, f, t in zip(*(batch.column(i).to_pylist() for i in (4, 3, 5, 1)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(kinds, pa.string()), batch.column(2), batch.column(3)], names=["t", "template", "kind", "n_lines", "n_sources"])

    rows = grouped.select("t", "template", "n_lines", "n_sources", "masked", "fill")
    return rows.mapInArrow(run, "t bigint, template string, kind string, n_lines bigint, n_sources bigint")


def failed_status(status: Column) -> Column:
    """Whether a status is an error: 400 or more, or no number at all."""
    code = status.cast("string").try_cast("int")
    return F.when(status.isNotNull(), F.coalesce((code >= 400) | (code < 100), F.lit(True)))


def _written_pages(df: DataFrame, doc: str, source: str, content: str, status: str | None, same: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(doc, source, failed, thin, lent, first, h, words, prose, total) of all pages, their lines written as numbers, and (h, masked) of the distinct lines."""
    ensure_checkpoint_dir(df.sparkSession)
    pages = page_lines(df, doc, source, content, None if status is None else failed_status(F.col(f"`{status}`")))
    hashes = F.transform("masked", lambda m: F.xxhash64(m)).alias("h")
    total = F.aggregate("words", F.lit(0).cast("long"), lambda a, n: a + n).alias("total")
    narrow = pages.select("doc", "source", "failed", "thin", "lent", "first", hashes, "words", "prose", total)
    texts = line_texts(df, doc, content).select(F.xxhash64("masked").alias("h"), "masked")
    return by_site(narrow, "source", same).checkpoint(), texts.groupBy("h", "masked").agg(F.lit(1)).select("h", "masked")


def _lines(pages: DataFrame) -> DataFrame:
    lines = pages.select("doc", "source", "failed", "thin", "lent", "total", F.inline(F.arrays_zip("h", "words", "prose")))
    return lines.select("doc", "source", "failed", "thin", "lent", "h", "prose", (F.col("words") / F.col("total")).alias("fill"))


def residue_templates(df: DataFrame, doc: str, source: str, content: str, *, status: str | None = None, same: DataFrame | None = None) -> DataFrame:
    """(template, kind, n_lines, n_sources): the templates mined from all pages with their verdicts; ``n_sources`` have it on a thin page."""
    pages, texts = _written_pages(df, doc, source, content, status, same)
    grouped, _, weights = templates(_lines(pages), texts)
    return classified(grouped, weights).drop("t")


def residue_pages(df: DataFrame, doc: str, source: str, content: str, *, status: str | None = None, same: DataFrame | None = None) -> DataFrame:
    """(doc): pages whose text is only template residue, filler, error messages or script notices, with or without menu and footer.

    Null, empty and blank contents are no pages of this kind. Rows of one ``doc`` are
    judged together. ``status`` names the column of the status of a fetch, which labels templates but decides about
    no page; ``same`` (source, site) names sources that are one.

    One line of text settles a page. Ordinary pages are asked for their longest line of prose first, and
    only the lines of those that it does not settle are judged.
    """
    pages, texts = _written_pages(df, doc, source, content, status, same)
    grouped, mined, weights = templates(_lines(pages), texts)

    def judged(lines: DataFrame) -> DataFrame:
        # (doc, h, prose, n_lines, kind) of the lines; a template is classified if one of them has it
        wanted = mined.join(lines.select("h").distinct(), "h", "left_semi")
        kinds = classified(grouped.join(wanted.select("t").distinct(), "t", "left_semi"), weights).select("t", "kind")
        verdicts = wanted.join(kinds, "t").select("h", "kind", "n_lines").checkpoint()
        return join_counted(lines.select("doc", "h", "prose"), verdicts, ["h"], "n_lines")

    asked = pages.filter("NOT thin").select("doc", F.element_at("h", F.col("first")).alias("h"), F.element_at("prose", F.col("first")).alias("prose"))
    settled = judged(asked).filter("kind = 'text'").select("doc").distinct()
    left = pages.join(settled, "doc", "left_anti").checkpoint()
    junk = F.col("kind").isin("slot", "filler", "message")
    per = judged(_lines(left)).groupBy("doc").agg(F.max(junk).alias("junk"), F.max(F.col("kind") == "text").alias("text"), F.sum(F.when(junk, 0).otherwise(F.col("prose"))).alias("prose"))
    return per.filter(F.col("junk") & ~F.col("text") & (F.col("prose") < PROSE)).select("doc")


def open_slots(df: DataFrame, doc: str, content: str) -> DataFrame:
    """(doc, line_no, slot): slots that no engine filled, in any record, ordinary ones too."""
    lines = df.select(F.col(f"`{doc}`").alias("doc"), F.posexplode(F.split(F.col(f"`{content}`"), "\n")).alias("pos", "line"))
    some = lines.filter(F.col("line").rlike("[{\\[<$%*_@#]"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, slots = [], []
            for i, line in enumerate(batch.column(2).to_pylist()):
                for slot in SLOT.findall(line):
                    at.append(i)
                    slots.append(slot)
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(slots, pa.string())], names=["doc", "line_no", "slot"])

    kind = df.schema[doc].dataType.simpleString()
    return some.select("doc", (F.col("pos") + 1).cast("long").alias("line_no"), "line").mapInArrow(run, f"doc {kind}, line_no bigint, slot string")
