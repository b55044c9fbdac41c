"""Problem 7: text cut off by field limits or in transfer.

Each record's ending is read once: in a tag, in an entity, in a sentence, or
complete; what stands behind a cut (closing tags, comments, scripts, an ellipsis, a
truncation mark) is set aside first, and the place of the cut is noted. Places are then a survival process:
the hazard of a place is the share of the records at least that long which end there. Window
functions give each hazard and its neighbours'; a Poisson test against the neighbours
and the Benjamini-Hochberg rule name the significant lengths, over all sources
and for each source, for endings that are open and for those that are in doubt (closed
by their tags, but without an end of the sentence). At a significant length of its class every
such ending is cut. Elsewhere an ending is cut only if it is incomplete in itself, since transfers
also break at no particular length, of which no hazard can tell.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.messages import score, seed_weights
from corpusloom.llm.residue import made_of
from corpusloom.llm.sites import by_site
from corpusloom.sources.tables import ensure_checkpoint_dir

#: Neighbouring lengths on either side.
NEIGHBOURS = 50
#: False-discovery rate of the significant lengths.
FDR = 0.001
#: Records that must end at a length before it is tested.
LEAST = 3
#: Log-odds beyond which a paragraph without a full stop is a message and no cut sentence.
MESSAGE = 3.0
#: Lengths in one task of the window functions.
BLOCK = 4096

_OPEN_TAG = re.compile(r"<(?:[a-zA-Z/!?][^<>]*)?\Z")
_END_TAG = re.compile(r"</[a-zA-Z][^<>]*>")
_SCRIPT = re.compile(r"</?script(?![\w-])", re.I)
_LINKED = re.compile(r"<a\b[^<>]*>[^<>]*\Z")
_ENTITY = re.compile(r"&(?:#\d{0,6}|#[xX][\da-fA-F]{0,5}|[a-zA-Z]{0,7})\Z")
_MARK = re.compile(r"\s*(?:\[(?:truncated|cut|more|\.\.\.|…)\]|\((?:truncated|cut)\)|…|\.\.\.)\Z", re.I)
_SURE_MARK = re.compile(r"\[(?:truncated|cut)\]\Z|\((?:truncated|cut)\)\Z", re.I)
_SENTENCE_END = re.compile(r"[.!?:;»”\"'’)\]}>…]\Z")
_FULL_STOP = re.compile(r"[.!?»”\"…]\Z")
_HIDDEN = re.compile(r"<!--.*?-->|<(script|style|textarea|title)\b[^>]*>.*?</\1\s*>", re.S | re.I)
_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)\b[^<>]*?(/?)>")
_BLOCK = re.compile(r"<(p|li|h[1-6]|blockquote|td|th|div|section|article|pre|dd|dt|main|aside|footer|header|nav)\b([^<>]*)>", re.I)
_WORD = re.compile(r"[^\W\d_]+")
_PLAIN_WORDS = re.compile(r"[\w\s,'’-]+")
_PARAGRAPH = re.compile(r"<p>(.*?)(?=</p>|<p\b|<h[1-6]\b|<ul\b|<div\b|\Z)", re.I | re.S)
_ANY_TAG = re.compile(r"<[^<>]*>")
# Elements whose end tag may be left out, and elements without one.
OPTIONAL = frozenset("p li td tr th tbody thead tfoot dt dd option html body head colgroup".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo cite code dfn em font i kbd mark q s samp small span strike strong sub sup time tt u var".split())


def _script_start(html: str, at: int) -> int:
    """Where the script element that the end tag at ``at`` closes begins; ``at`` itself where none is open."""
    near = at
    while (near := html.rfind("<", 0, near)) >= 0:
        if _SCRIPT.match(html, near):
            return at if html[near + 1] == "/" else near
    return at


def set_aside(html: str) -> tuple[str, str]:
    """(the record up to its last text or start tag, what stands behind)."""
    end = len(html)
    while end:
        if html[end - 1].isspace():
            end -= 1
            continue
        if html[end - 1] != ">":
            break
        if html.endswith("-->", 0, end):
            at = html.rfind("<!--", 0, end)
            # a comment ends at its first end mark
            if at < 0 or html.find("-->", at + 2, end) != end - 3:
                break
        else:
            at = html.rfind("<", 0, end)
            if at < 0 or not _END_TAG.fullmatch(html, at, end):
                break
            if _SCRIPT.match(html, at):
                at = _script_start(html, at)
        end = at
    return html[:end], html[end:]


def last_block(core: str) -> re.Match[str] | None:
    """The last start tag of a block."""
    at = len(core)
    while (at := core.rfind("<", 0, at)) >= 0:
        if m := _BLOCK.match(core, at):
            return m
    return None


def closers_fit(core: str, behind: str) -> bool:
    """Whether the end tags behind the last text close what is open, leaving out only end tags that may be left out."""
    stack: list[str] = []
    for close, name, _ in _TAG.findall(_HIDDEN.sub("", core)):
        name = name.lower()
        if name in VOID:
            continue
        if not close:
            stack.append(name)
        elif name in stack:
            while stack.pop() != name:
                pass
    for close, name, _ in _TAG.findall(_HIDDEN.sub("", behind)):
        name = name.lower()
        if not close or name in ("html", "body"):
            continue
        while stack and stack[-1] != name and stack[-1] in OPTIONAL:
            stack.pop()
        if not stack or stack[-1] != name:
            return False
        stack.pop()
    return True


def ending(html: str) -> str:
    """tag, entity, mark, text (in a sentence or word), loose (complete, but nothing closes it) or whole."""
    return _ending(*set_aside(html))


def read_ending(html: str) -> tuple[str, int, int]:
    """(ending, code points, bytes up to the place of the cut); ``doubt`` for a whole ending whose last text is no finished sentence.

    What was added behind a cut does not count: tags, comments and scripts, and a truncation mark.
    """
    core, behind = set_aside(html)
    kind = _ending(core, behind)
    upto = html[: len(html) - len(behind.lstrip())] if behind.strip() else html
    if kind == "mark":
        upto = _MARK.sub("", core)
    elif kind == "whole" and behind.strip():
        text = core[core.rfind(">") + 1 :].strip()
        if text and not _SENTENCE_END.search(text):
            kind = "doubt"
    return kind, len(upto), len(upto.encode("utf-8", "replace"))


def _ending(core: str, behind: str) -> str:
    if not core:
        return "whole"
    mark = core.rfind("<")
    if mark >= 0 and _OPEN_TAG.match(core, mark):
        return "tag"
    text = core[core.rfind(">") + 1 :].strip()
    closed = bool(re.match(r"\s*</[a-zA-Z]", behind))
    if not text:
        if closed or behind.strip():
            # an inline end tag may have ended the text
            return "whole" if closers_fit(core, behind) else "loose"
        return "loose"
    if not closed:
        if _ENTITY.search(text):
            return "entity"
        if _MARK.search(text):
            return "mark"
        return "loose" if _FULL_STOP.search(text) else "text"
    if _SURE_MARK.search(text):
        return "mark"
    block = last_block(core)
    shown = _ANY_TAG.sub("", core[block.end() :]).strip() if block else text
    fits = closers_fit(core, behind)
    if not fits:
        if _ENTITY.search(text):
            return "entity"
        if _MARK.search(text):
            return "mark"
        return "loose" if _SENTENCE_END.search(shown) else "text"
    linked = mark >= 0 and _LINKED.match(core, mark)
    if _SENTENCE_END.search(shown) or not block or linked:
        return "whole"
    if block[1].lower() in ("p", "blockquote") and not block[2].strip() and not _MARK.search(shown):
        if made_of(shown) is None and len(_WORD.findall(shown)) >= 6 and score(seed_weights(), shown) <= MESSAGE:
            return "text"
        # a few plain words where every other paragraph of an article ends in a full stop
        if block[1].lower() == "p" and _PLAIN_WORDS.fullmatch(_html.unescape(shown)) and re.search(r"<h1\b", core, re.I):
            others = [_ANY_TAG.sub("", x).strip() for x in _PARAGRAPH.findall(core[: block.start()])]
            if all(_SENTENCE_END.search(x) for x in others if x):
                return "text"
    return "whole"


def endings(df: DataFrame, doc: str, source: str, html: str) -> DataFrame:
    """(doc, source, copy, chars, bytes, ending) of every record that is not null or blank.

    Lengths are those up to the place of the cut; ``copy`` is a hash of the record.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, chars, octets = zip(*(read_ending(x) for x in batch.column(3).to_pylist())) if batch.num_rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(chars, pa.int32()), pa.array(octets, pa.int32()), pa.array(kinds, pa.string())], names=["doc", "source", "copy", "chars", "bytes", "ending"])

    kinds = [df.schema[c].dataType.simpleString() for c in (doc, source)]
    rows = df.select(F.col(f"`{doc}`").alias("doc"), F.col(f"`{source}`").alias("source"), F.xxhash64(f"`{html}`").alias("copy"), F.col(f"`{html}`").alias("html"))
    return rows.filter("trim(html) <> ''").mapInArrow(run, f"doc {kinds[0]}, source {kinds[1]}, copy bigint, chars int, bytes int, ending string")


def _poisson_tail(n: pd.Series, mean: pd.Series) -> pd.Series:
    """P(X >= n) for X of a Poisson distribution, at least 1e-300."""
    out = np.ones(len(n))
    for i, (k, m) in enumerate(zip(n.to_numpy(), mean.to_numpy())):
        if k > 0:
            j = np.arange(k, k + 200 + int(10 * m))
            logs = j * np.log(m) - m - np.cumsum(np.concatenate([[np.log(np.arange(1, k + 1)).sum()], np.log(j[1:])]))
            out[i] = min(1.0, max(1e-300, float(np.exp(logs).sum())))
    return pd.Series(out)


def length_hazards(ends: DataFrame) -> DataFrame:
    """(unit, class, scope, source, length, n, at_risk, hazard, expected, p, significant) of each tested length.

    ``unit`` is chars or bytes, ``class`` open or doubt, ``scope`` all or source. Hazards come from one row for each
    length, so the windows hold lengths, not records, and at most ``BLOCK`` of them in one task: each block has a margin of
    ``NEIGHBOURS`` lengths on either side, and what is at risk beyond it is summed over blocks. Every record counts as at risk. Copies
    of a record within a source are one piece of evidence. The discovery rate counts every length at which anything ends as a hypothesis.
    """
    of = F.when(F.col("ending") == "doubt", F.lit("doubt")).when(F.col("ending") != "whole", F.lit("open"))
    units = F.array(F.struct(F.lit("chars").alias("unit"), F.col("chars").alias("length")), F.struct(F.lit("bytes").alias("unit"), F.col("bytes").alias("length")))
    by_unit = ends.dropDuplicates(["source", "copy"]).select("source", of.alias("class"), F.explode(units).alias("u")).select("source", "class", "u.*")
    per = by_unit.groupBy("unit", "source", "length").agg(F.count(F.lit(1)).alias("all"), *[F.sum((F.col("class") == c).cast("long")).alias(c) for c in ("open", "doubt")])
    per = per.fillna(0, ["open", "doubt"])
    whole = per.groupBy("unit", "length").agg(*[F.sum(c).alias(c) for c in ("all", "open", "doubt")])
    scoped = per.withColumn("scope", F.lit("source")).unionByName(whole.withColumn("scope", F.lit("all")).withColumn("source", F.lit(None).cast(ends.schema["source"].dataType)))
    scoped = scoped.withColumn("block", F.expr(f"length div {BLOCK}"))
    one = ["unit", "scope", "source"]
    sums = scoped.groupBy(*one, "block").agg(F.sum("all").alias("in_block"))
    beyond = F.coalesce(F.sum("in_block").over(Window.partitionBy(*one).orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(*[F.col(c).alias(f"_{c}") for c in (*one, "block")], beyond.alias("beyond"))
    inside = Window.partitionBy(*one, "block").orderBy(F.col("length").desc())
    risk = scoped.withColumn("up", F.sum("all").over(inside)).filter(f"open >= {LEAST} OR doubt >= {LEAST}")
    risk = risk.join(sums, F.col("source").eqNullSafe(F.col("_source")) & (F.col("unit") == F.col("_unit")) & (F.col("scope") == F.col("_scope")) & (F.col("block") == F.col("_block"))).select(*one, "length", (F.col("up") + F.col("beyond")).alias("at_risk"))
    stacked = scoped.select(*one, "length", F.explode(F.array(*[F.struct(F.lit(c).alias("class"), F.col(c).alias("n")) for c in ("open", "doubt")])).alias("e")).select(*one, "length", "e.*").filter("n > 0")
    asked = stacked.groupBy("unit", "scope", "class").agg(F.count(F.lit(1)).alias("m")).select(*[F.col(c).alias(f"_{c}") for c in ("unit", "scope", "class")], "m")
    parts = F.array_distinct(F.array(*[F.floor((F.col("length") + d) / BLOCK) for d in (0, -NEIGHBOURS, NEIGHBOURS)]))
    near = Window.partitionBy(*one, "class", "part").orderBy("length").rangeBetween(-NEIGHBOURS, NEIGHBOURS)
    events = stacked.withColumn("part", F.explode(parts)).withColumn("near_n", F.sum("n").over(near)).filter((F.col("part") == F.floor(F.col("length") / BLOCK)) & (F.col("n") >= LEAST))
    r = risk.select(*[F.col(c).alias(f"_{c}") for c in (*one, "length")], "at_risk")
    hazards = events.join(r, F.col("source").eqNullSafe(F.col("_source")) & (F.col("unit") == F.col("_unit")) & (F.col("scope") == F.col("_scope")) & (F.col("length") == F.col("_length"))).select(*one, "class", "length", "n", "near_n", "at_risk")
    tested = hazards.withColumn("expected", (F.col("near_n") - F.col("n") + 1) / (2 * NEIGHBOURS)).withColumn("p", F.pandas_udf(_poisson_tail, "double")("n", "expected"))
    # the hypotheses of all sources count for each of them; lengths are ranked within a source, so no task holds those of many
    tested = tested.join(asked, (F.col("unit") == F.col("_unit")) & (F.col("scope") == F.col("_scope")) & (F.col("class") == F.col("_class"))).select(*one, "class", "length", "n", "at_risk", "expected", "p", "m")
    ranked = Window.partitionBy(*one, "class").orderBy("p")
    every = Window.partitionBy(*one, "class")
    tested = tested.withColumn("ok", F.when(F.col("p") <= FDR * F.rank().over(ranked) / F.col("m"), F.col("p")))
    return tested.select("unit", "class", "scope", "source", "length", "n", "at_risk", (F.col("n") / F.col("at_risk")).alias("hazard"), "expected", "p", F.coalesce(F.col("p") <= F.max("ok").over(every), F.lit(False)).alias("significant"))


def _written_endings(df: DataFrame, doc: str, source: str, html: str, same: DataFrame | None) -> DataFrame:
    # every record is read once; its ending, a narrow row, is written and read again for the lengths and the verdicts
    ensure_checkpoint_dir(df.sparkSession)
    return by_site(endings(df, doc, source, html), "source", same).checkpoint()


def limits(df: DataFrame, doc: str, source: str, html: str, *, same: DataFrame | None = None) -> DataFrame:
    """The tested lengths of ``length_hazards``; ``same`` (source, site) names sources that are one."""
    return length_hazards(_written_endings(df, doc, source, html, same))


def truncated(df: DataFrame, doc: str, source: str, html: str, *, same: DataFrame | None = None) -> DataFrame:
    """(doc, source, ending, at_limit, cut) of every record that is not null or blank.

    ``at_limit``: its cut lies at a length that is significant for its class, over all sources or in its own; such a record is cut
    whatever its ending. Others are cut if their ending is incomplete in itself. ``same`` (source, site) names sources that are one.
    """
    ends = _written_endings(df, doc, source, html, same)
    some = ends.filter("ending <> 'whole'").withColumn("class", F.when(F.col("ending") == "doubt", F.lit("doubt")).otherwise(F.lit("open")))
    both = length_hazards(ends).filter("significant").select("unit", "class", F.col("class").alias("class2"), "scope", F.col("source").alias("s2"), "length").drop("class").distinct()
    hit = None
    for unit in ("chars", "bytes"):
        own = both.filter(F.col("unit") == unit)
        match = some.join(own, (F.col(unit) == F.col("length")) & (F.col("class") == F.col("class2")) & ((F.col("scope") == "all") | F.col("source").eqNullSafe(F.col("s2"))), "left_semi").select(F.col("doc").alias("doc2"))
        hit = match if hit is None else hit.union(match)
    marked = some.join(hit.distinct(), F.col("doc") == F.col("doc2"), "left").select("doc", "source", "ending", F.col("doc2").isNotNull().alias("at_limit"))
    whole = ends.filter("ending = 'whole'").select("doc", "source", "ending", F.lit(False).alias("at_limit"))
    return marked.unionByName(whole).withColumn("cut", F.col("at_limit") | F.col("ending").isin("tag", "entity", "mark", "text"))


def truncation_rates(df: DataFrame, doc: str, source: str, html: str, *, same: DataFrame | None = None) -> DataFrame:
    """(source, n, n_cut, rate, n_at_limit, n_by_limit) of each source: ``n_by_limit`` of the cut records are cut for their length alone."""
    cuts = truncated(df, doc, source, html, same=same)
    return cuts.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("cut").cast("long")).alias("n_cut"), F.avg(F.col("cut").cast("double")).alias("rate"), F.sum(F.col("at_limit").cast("long")).alias("n_at_limit"), F.sum((F.col("at_limit") & F.col("ending").isin("loose", "doubt")).cast("long")).alias("n_by_limit"))
