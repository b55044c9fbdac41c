"""Problem 3: lines repeated across one site's documents.

Every line becomes an identifier, a 64-bit hash of its text without letter case, amount of white
space or the value of digit runs; a source's documents are its concatenated identifiers. The
suffix array of all sources is built by prefix doubling: depth 1 ranks the suffixes by their first
line, depth 2**k by their first 2**k lines, which is by the pair of ranks that their two halves have one
depth before. Ranks are places in a sort, and keep the order of the line identifiers. Suffixes whose
common prefix spans fewer than ``min_docs`` documents leave the array before the next depth, since no
longer prefix of theirs can span more; the doubling ends when all have left. No block crosses
the end of a document. Each suffix has the length of the common prefix with which it stayed last, the
block that starts there, in doublings; the lines of these blocks are the repeated lines.

A source is never one group: identifiers are counted by (source, identifier) with partial counts, hot
identifiers are sent to the lines instead of gathering them, and only identifiers
travel, not text. Two different lines of one source that share a 64-bit hash, of which one is repeated, would be
taken for one: at 10**11 lines and 10**8 repeated ones in one source, about one line in all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.sites import by_site
from corpusloom.llm.skew import join_counted
from corpusloom.llm.tokenstream import Stream, chunks, mixed
from corpusloom.sources.tables import ensure_checkpoint_dir

#: Repeated identifiers that are sent to the lines, if counted to be no more (24 MB); more meet them in a shuffle.
SENT = 1_000_000


def sequences(df: DataFrame, doc: str, source: str, content: str) -> DataFrame:
    """(doc, source, nos, ids) of every document with a line that is not blank: its lines' numbers and identifiers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in chunks(batch.column(2).to_pylist()):
                s = Stream(texts)
                bounds = np.searchsorted(s.page, np.arange(len(texts) + 1))
                some = np.flatnonzero(np.diff(bounds))
                offsets = pa.array(np.append(bounds[some], len(s.page)), pa.int32())
                take = pa.array(np.array(at)[some], pa.int64())
                nos = pa.ListArray.from_arrays(offsets, pa.array(s.number, pa.int32()))
                ids = pa.ListArray.from_arrays(offsets, pa.array(s.line_hashes()))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), nos, ids], names=["doc", "source", "nos", "ids"])

    kinds = [df.schema[c].dataType.simpleString() for c in (doc, source)]
    rows = df.select(F.col(f"`{doc}`").alias("doc"), F.col(f"`{source}`").alias("source"), F.col(f"`{content}`").alias("content"))
    return rows.filter("doc IS NOT NULL AND content <> ''").mapInArrow(run, f"doc {kinds[0]}, source {kinds[1]}, nos array<int>, ids array<bigint>")


def _written(df: DataFrame, doc: str, source: str, content: str, without: DataFrame | None, same: DataFrame | None) -> DataFrame:
    # the texts are read and split once
    ensure_checkpoint_dir(df.sparkSession)
    pages = by_site(sequences(df, doc, source, content), "source", same)
    if without is not None:
        pages = pages.join(without.select("doc"), "doc", "left_anti")
    return pages.checkpoint()


def frequent_ids(pages: DataFrame, min_docs: int) -> DataFrame:
    """(source, h, n_docs, n) of the identifiers found in at least ``min_docs`` documents of one source: depth 1 of the array."""
    per_page = pages.select("source", "doc", F.explode(F.array_distinct("ids")).alias("h"))
    if pages.groupBy("doc").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
        counted = per_page.groupBy("source", "h").agg(F.count(F.lit(1)).alias("n_docs"))
        counted = counted.withColumn("n", F.col("n_docs"))
    else:  # a document in several rows counts once
        counted = per_page.groupBy("source", "h", "doc").agg(F.count(F.lit(1)).alias("n")).groupBy("source", "h").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n").alias("n"))
    return counted.filter(F.col("n_docs") >= min_docs)


def ranked(groups: DataFrame, *order: str) -> DataFrame:
    """``groups`` with ``rank``, which grows in the given order; ranks are apart, but not next to each other. Written, since a rank is a place in one sort."""
    return groups.orderBy(*order).withColumn("rank", F.monotonically_increasing_id()).checkpoint()


def suffix_runs(pages: DataFrame, frequent: DataFrame) -> DataFrame:
    """(doc, source, copy, lines): the suffixes of depth 1 that stay, as an array of (at, line_no, rank, h, n_docs); ``copy`` tells rows of one document apart."""
    lines = pages.select("doc", "source", F.xxhash64("nos", "ids").alias("copy"), F.posexplode(F.arrays_zip("nos", "ids")).alias("at", "line"))
    lines = lines.select("doc", "source", "copy", "at", F.col("line.nos").alias("line_no"), F.col("line.ids").alias("h"))
    if frequent.count() <= SENT:
        f = frequent.select(F.col("source").alias("_s"), F.col("h").alias("_h"), "n_docs", "rank")
        kept = lines.join(F.broadcast(f), (F.col("h") == F.col("_h")) & F.col("source").eqNullSafe(F.col("_s")))
    else:
        kept = join_counted(lines, frequent, ["source", "h"], "n")
    return kept.groupBy("doc", "source", "copy").agg(F.array_sort(F.collect_list(F.struct("at", "line_no", "rank", "h", "n_docs"))).alias("lines"))


def suffix_pairs(runs: DataFrame, half: int) -> DataFrame:
    """(doc, source, copy, at, line_no, r1, r2, h, once): each suffix whose two halves of ``half`` lines have both stayed, with their ranks.

    ``once`` marks one place of each pair in a row, ``h`` is the code of its lines.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            flat = lists.flatten()
            if not len(flat):
                continue
            page = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
            at, no, rank, code = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(4))
            place = page.astype(np.int64) * (1 << 32) + at
            other = np.minimum(np.searchsorted(place, place + half), len(place) - 1)
            first = np.flatnonzero(place[other] == place + half)
            second = other[first]
            r1, r2, of = rank[first], rank[second], page[first]
            order = np.lexsort((r2, r1, of))
            new = np.ones(len(order), bool)
            new[1:] = (np.diff(of[order]) != 0) | (np.diff(r1[order]) != 0) | (np.diff(r2[order]) != 0)
            once = np.zeros(len(order), bool)
            once[order[new]] = True
            code = code.view(np.uint64)
            with np.errstate(over="ignore"):
                h = mixed(code[first] * np.uint64(0xD1342543DE82EF95) + code[second] + np.uint64(2 * half)).view(np.int64)
            take = pa.array(of, pa.int64())
            found = [pa.array(at[first], pa.int32()), pa.array(no[first], pa.int32()), *(pa.array(c, pa.int64()) for c in (r1, r2, h)), pa.array(once)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(take) for c in range(3)), *found], names=["doc", "source", "copy", "at", "line_no", "r1", "r2", "h", "once"])

    kinds = [runs.schema[c].dataType.simpleString() for c in ("doc", "source")]
    return runs.select("doc", "source", "copy", "lines").mapInArrow(run, f"doc {kinds[0]}, source {kinds[1]}, copy bigint, at int, line_no int, r1 bigint, r2 bigint, h bigint, once boolean")


def suffix_depths(runs: DataFrame, min_docs: int) -> Iterator[tuple[int, DataFrame, DataFrame]]:
    """(depth, blocks, suffixes) for the depths 2, 4, 8, … while suffixes stay, of the suffixes of depth 1.

    ``blocks`` (source, r1, r2, h, n_docs, n, rank) are the prefixes that span enough documents, ``suffixes``
    (doc, source, copy, lines) those that have them; both are written. Only these go on to the next depth.
    """
    several, half = _repeats(runs), 1
    while True:
        pairs = suffix_pairs(runs, half)
        n_docs = F.count_distinct("doc") if several else F.count_if("once")
        counted = pairs.groupBy("source", "r1", "r2").agg(F.min("h").alias("h"), n_docs.alias("n_docs"), F.count(F.lit(1)).alias("n"))
        blocks = ranked(counted.filter(F.col("n_docs") >= min_docs), "source", "r1", "r2")
        found = blocks.count()
        if not found:
            return
        # a rank of depth 1 belongs to one source, and so does every pair
        if found <= SENT:
            kept = pairs.join(F.broadcast(blocks.select("r1", "r2", "rank")), ["r1", "r2"])
        else:
            kept = join_counted(pairs, blocks.select("r1", "r2", "rank", "n"), ["r1", "r2"], "n")
        runs = kept.groupBy("doc", "source", "copy").agg(F.array_sort(F.collect_list(F.struct("at", "line_no", "rank", "h"))).alias("lines")).checkpoint()
        half *= 2
        yield half, blocks, runs


def suffix_array(pages: DataFrame, min_docs: int) -> tuple[DataFrame, DataFrame]:
    """The suffixes that stay (doc, line_no, n_docs, prefix), and the blocks (source, h, n_lines, n_docs, rank).

    ``prefix`` is the length in lines of the longest block of 1, 2, 4, … lines that starts there, ``n_docs`` the documents of its first line.
    ``rank`` orders the blocks of one length and source by the identifiers of their lines.
    """
    frequent = ranked(frequent_ids(pages, min_docs), "source", "h")
    runs = suffix_runs(pages, frequent).checkpoint()
    every = runs.select("doc", F.explode("lines").alias("l")).select("doc", F.col("l.line_no").alias("line_no"), F.lit(1).alias("n_lines"), F.col("l.n_docs").alias("n_docs"))
    found = frequent.select("source", "h", F.lit(1).alias("n_lines"), "n_docs", "rank")
    for depth, blocks, suffixes in suffix_depths(runs, min_docs):
        deep = suffixes.select("doc", F.explode("lines.line_no").alias("line_no"), F.lit(depth).alias("n_lines"), F.lit(None).cast("long").alias("n_docs"))
        every = every.unionByName(deep)
        found = found.unionByName(blocks.select("source", "h", F.lit(depth).alias("n_lines"), "n_docs", "rank"))
    return every.groupBy("doc", "line_no").agg(F.max("n_docs").alias("n_docs"), F.max("n_lines").alias("prefix")), found


def _repeats(runs: DataFrame) -> bool:
    return not runs.groupBy("doc").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty()


def repeated_lines(df: DataFrame, doc: str, source: str, content: str, *, min_docs: int = 6, without: DataFrame | None = None, same: DataFrame | None = None) -> DataFrame:
    """(doc, line_no, n_docs, prefix): lines in a block, of one line or more, that spans at least ``min_docs`` documents of its source.

    ``n_docs`` counts the line's documents, ``prefix`` the lines of the longest repeated block (of 1, 2, 4, … lines) that starts
    with it. ``without`` names documents (column ``doc``) that neither count nor come out, ``same`` (source, site) the sources
    that are one; a null source is a source of its own. Documents are told apart by ``doc``; a line repeated in one document
    counts once, and a document in several rows is one, whose lines come out once. Lines of a document with a null ``doc`` or
    content have no row.
    """
    pages = _written(df, doc, source, content, without, same)
    return suffix_array(pages, min_docs)[0].select("doc", F.col("line_no").cast("long").alias("line_no"), "n_docs", "prefix")


def repeated_blocks(df: DataFrame, doc: str, source: str, content: str, *, min_docs: int = 6, without: DataFrame | None = None, same: DataFrame | None = None) -> DataFrame:
    """(source, first_hash, n_lines, n_docs): repeated blocks of 1, 2, 4, … lines.

    Lines stand next to each other if only blank lines stand between them. ``first_hash`` is the code of the block.
    """
    blocks = suffix_array(_written(df, doc, source, content, without, same), min_docs)[1]
    return blocks.select("source", F.col("h").alias("first_hash"), "n_lines", "n_docs")


def without_lines(df: DataFrame, doc: str, content: str, removed: DataFrame) -> DataFrame:
    """(doc, content): each document without the lines (doc, line_no) of ``removed``; null stays null."""
    per = removed.groupBy("doc").agg(F.collect_set("line_no").alias("_gone"))
    rows = df.select(F.col(f"`{doc}`").alias("doc"), F.col(f"`{content}`").alias("content")).join(per, "doc", "left")
    kept = F.filter(F.split("content", "\n"), lambda line, i: ~F.array_contains(F.col("_gone"), (i + 1).cast("long")))
    return rows.select("doc", F.when(F.col("_gone").isNull(), F.col("content")).otherwise(F.array_join(kept, "\n")).alias("content"))
