"""Problem 10: long exact spans shared between records.

MinHash banding over paragraphs, where a paragraph is every window of ``SPAN``
code points and its shingles are the ``GRAM``-long substrings in it. Bands are tuned
for recall: with one band of one row, equal paragraphs always collide, because they
have the same shingles and so the same minimum; a long ``GRAM`` keeps chance
collisions rare. A text's signature is the set of minima of all its paragraphs, about
one for every 50 code points.

Paragraphs that collide are compared exactly, by 96 bits of hash of their ``SPAN`` code points, not
text against text: a passage that n texts share is one group of n rows, not n * n / 2 candidates. Groups
with the same members, such as the paragraphs of one passage, count once. Amounts
and clusters come from the groups alone and stay linear; only where every pair is asked for are the groups
expanded, at the end.

Equal texts are one class first and only its smallest id takes part, so a group of
copies costs one row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.skew import join_counted
from corpusloom.llm.tokenstream import mixed, power_table
from corpusloom.sources.tables import ensure_checkpoint_dir

#: Least length of a shared span, in code points.
SPAN = 300
#: Length of a shingle.
GRAM = 200
#: Members of a group for each of the tasks that pair them.
HOT = 500
#: Rows that are sent to the texts instead of shuffling the texts, if counted to be no more (16 MB).
SENT = 1_000_000

# A second odd multiplier for a second, independent hash.
_OTHER = np.uint64(0xD1342543DE82EF95)


def gram_hashes(points: np.ndarray, k: int, other: bool = False) -> np.ndarray:
    """Hash of each ``k`` consecutive code points; equal substrings have equal hashes. ``other`` gives an independent one."""
    n = len(points)
    if n < k:
        return np.empty(0, np.uint64)
    up, down = power_table(n)
    values = points.astype(np.uint64) + np.uint64(7)
    with np.errstate(over="ignore"):
        if other:
            values = mixed(values * _OTHER)
        sums = np.empty(n + 1, np.uint64)
        sums[0] = 0
        np.cumsum(values * up, out=sums[1:])
        return mixed((sums[k:] - sums[:-k]) * down[: n - k + 1])


def window_minima(values: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each ``w`` consecutive values, by running minima of blocks of ``w``."""
    n = len(values)
    if n < w:
        return np.empty(0, values.dtype)
    rows = -(-n // w)
    block = np.full(rows * w, np.iinfo(values.dtype).max, values.dtype)
    block[:n] = values
    block = block.reshape(rows, w)
    ahead = np.minimum.accumulate(block, axis=1).ravel()
    behind = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


def signature(text: str, span: int = SPAN, gram: int = GRAM) -> np.ndarray:
    """The minima of all paragraphs of a text, each once."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.unique(window_minima(gram_hashes(points, gram), span - gram + 1))


def copy_classes(df: DataFrame, key: str, text: str, least: int = SPAN) -> DataFrame:
    """(key, rep, copies) of every row whose text has at least ``least`` code points.

    ``rep`` is the smallest key with the same text, ``copies`` the rows that have it. Texts
    are told apart by two 64-bit hashes and the length.
    """
    rows = df.filter(F.length(text) >= least).select(F.col(key).alias("key"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), F.col(text)).alias("h2"), F.length(text).alias("n"))
    per = rows.groupBy("h1", "h2", "n").agg(F.min("key").alias("rep"), F.count(F.lit(1)).alias("copies"))
    return per.filter("copies > 1").join(rows, ["h1", "h2", "n"]).select("key", "rep", "copies", "n")


def _texts(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.filter(F.col(f"`{key}`").isNotNull()).select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")).filter(F.length("text") >= SPAN)


def _sent_if_small(keys: DataFrame) -> DataFrame:
    """Keys to be sent to the texts if they are counted to be at most ``SENT``; else texts and keys meet in a shuffle."""
    return F.broadcast(keys) if keys.count() <= SENT else keys


class Shared:
    """What the texts of a table share, each table written to the checkpoint folder.

    ``classes``: (key, rep, copies, n) of the rows whose text others have too. ``windows``: (key, start, group, size) of each paragraph of a class
    representative that another has, worked out when asked for. ``members``: (group, key, size): the groups of representatives that have a paragraph in common.
    """

    def __init__(self, df: DataFrame, key: str, text: str):
        ensure_checkpoint_dir(df.sparkSession)
        texts = _texts(df, key, text)
        self.classes = copy_classes(texts, "key", "text").checkpoint()
        reps = texts.join(_sent_if_small(self.classes.filter("key <> rep").select("key")), "key", "left_anti").select(F.col("key").cast("long").alias("key"), "text")

        def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                signed = [signature(t) for t in batch.column(1).to_pylist()]
                marks = np.concatenate(signed).view(np.int64) if signed else np.empty(0, np.int64)
                offsets = np.concatenate([[0], np.cumsum([len(s) for s in signed])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(marks))], names=["key", "marks"])

        signed = reps.mapInArrow(sign, "key bigint, marks array<bigint>").checkpoint()
        marks = signed.select("key", F.explode("marks").alias("mark"))
        # minima of one text alone go; those of many texts are sent to the rows instead of gathering these
        often = marks.groupBy("mark").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").checkpoint()
        if often.count() <= SENT:
            bucket = marks.join(F.broadcast(often.select("mark")), "mark", "left_semi")
        else:
            bucket = join_counted(marks, often, ["mark"], "n").select("key", "mark")
        wanted = bucket.groupBy("key").agg(F.collect_set("mark").alias("marks")).checkpoint()  # at most the signature of one text
        small = wanted.agg(F.sum(F.size("marks"))).first()[0] or 0
        few = reps.join(F.broadcast(wanted) if small <= SENT else wanted, "key")

        def hash_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cols: list[list[np.ndarray]] = [[], [], [], []]
                for text_, marks_ in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                    points = np.frombuffer(text_.encode("utf-32-le", "surrogatepass"), np.uint32)
                    least = window_minima(gram_hashes(points, GRAM), SPAN - GRAM + 1)
                    start = np.flatnonzero(np.isin(least, np.array(marks_, np.int64).view(np.uint64)))
                    cols[0].append(start)
                    cols[1].append(gram_hashes(points, SPAN)[start].view(np.int64))
                    # a paragraph that a text has twice counts once
                    once = np.zeros(len(start), bool)
                    once[np.unique(cols[1][-1], return_index=True)[1]] = True
                    cols[3].append(once)
                    cols[2].append((gram_hashes(points, SPAN, True)[start] >> np.uint64(32)).astype(np.uint32).view(np.int32))
                if cols[0]:
                    offsets = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in cols[0]])]), pa.int32())
                    lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(c), t)) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.int32(), pa.bool_()))]
                    yield pa.RecordBatch.from_arrays([batch.column(0), *lists], names=["key", "start", "h1", "h2", "once"])

        hashed = few.select("key", "text", "marks").mapInArrow(hash_windows, "key bigint, start array<int>, h1 array<bigint>, h2 array<int>, once array<boolean>")
        groups = hashed.select("key", F.inline(F.arrays_zip("h1", "h2", "once"))).filter("once").groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("size"), F.bit_xor(F.xxhash64("key")).alias("keys")).filter("size > 1")
        # paragraphs with the same members are one group
        groups = groups.select("h1", "h2", "size", F.xxhash64("size", "keys").alias("group")).checkpoint()
        # the few texts with shared marks are hashed again here, which takes less than writing their paragraphs
        windows = hashed.select("key", F.inline(F.arrays_zip("start", "h1", "h2")))
        if groups.count() <= SENT:
            joined = windows.join(F.broadcast(groups), ["h1", "h2"])
        else:
            joined = join_counted(windows, groups, ["h1", "h2"], "size")
        self.windows = joined.select("key", "start", "group", "size")
        self.members = self.windows.select("group", "key", "size").distinct().checkpoint()

    def pairs(self) -> DataFrame:
        """(key_a, key_b) of the representatives that share a paragraph; a large group is paired in several tasks."""
        salts = F.ceil(F.col("size") / HOT).cast("int")
        left = self.members.select(F.col("key").alias("key_a"), "group", F.pmod(F.xxhash64("key"), salts).cast("int").alias("salt"))
        right = self.members.select(F.col("key").alias("key_b"), "group", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
        return left.join(right, ["group", "salt"]).filter("key_a < key_b").select("key_a", "key_b").distinct()


def shared_pairs(df: DataFrame, key: str, text: str, copies: str = "all") -> DataFrame:
    """(doc_a, doc_b), doc_a < doc_b: rows that share a span of at least ``SPAN`` code points, equal in every one.

    ``copies="all"``: every pair of rows comes out, copies of one text included: a group of copies gives a number of rows
    quadratic in its size. ``copies="representatives"``: pairs between the representatives (the smallest key of the rows with one text) only; no
    link between different texts is lost, and ``copy_classes`` has the membership. Null and shorter texts have no pair; rows
    with a null key are left out; rows that repeat a key count as one.
    """
    shared = Shared(df, key, text)
    pairs = shared.pairs()
    if copies == "representatives":
        return pairs.select(F.col("key_a").alias("doc_a"), F.col("key_b").alias("doc_b"))
    members = shared.classes.select("key", "rep").distinct()
    side = lambda c: members.select(F.col("rep").alias(f"key_{c}"), F.col("key").alias(f"m_{c}"))
    each = pairs.join(side("a"), "key_a", "left").join(side("b"), "key_b", "left").select(F.coalesce("m_a", "key_a").alias("x"), F.coalesce("m_b", "key_b").alias("y"))
    own = members.select("rep", F.col("key").alias("x")).join(members.select("rep", F.col("key").alias("y")), "rep").filter("x < y").select("x", "y")
    # a pair of representatives stands once and so does each of its members' pairs: nothing needs to be made distinct
    return each.unionByName(own).select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b")).filter("doc_a < doc_b")


def shared_amount(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, n_chars, shared_chars, share, class_id, n_links) of every row.

    ``shared_chars`` counts the code points that lie in a span shared with another row,
    ``class_id`` is the smallest key with the same text, ``n_links`` the number of other
    classes that have one and the same paragraph in common with it, taken at the paragraph that most have. Texts under ``SPAN`` share nothing; the share of a null or
    empty text is 0.
    """
    shared = Shared(df, key, text)
    starts = shared.windows.select("key", "start").distinct().withColumn("past", F.coalesce(F.lag("start").over(Window.partitionBy("key").orderBy("start")) + SPAN, F.lit(0)))
    cover = starts.groupBy(F.col("key").alias("rep")).agg(F.sum(SPAN - F.greatest(F.lit(0), F.col("past") - F.col("start"))).alias("cover"))
    links = shared.members.groupBy(F.col("key").alias("rep")).agg((F.max("size") - 1).alias("links"))
    rows = df.select(F.col(f"`{key}`").alias("key"), F.length(f"`{text}`").alias("n_chars"))
    rows = rows.join(shared.classes.select("key", "rep", "copies").distinct(), "key", "left").withColumn("rep", F.coalesce("rep", "key"))
    rows = rows.join(cover, "rep", "left").join(links, "rep", "left")
    amount = F.when(F.col("copies") > 1, F.col("n_chars")).otherwise(F.coalesce("cover", F.lit(0))).cast("long")
    return rows.select(F.col("key").alias(key), F.coalesce("n_chars", F.lit(0)).alias("n_chars"), amount.alias("shared_chars"), F.coalesce(amount / F.nullif(F.col("n_chars"), F.lit(0)), F.lit(0.0)).alias("share"), F.col("rep").alias("class_id"), F.coalesce("links", F.lit(0)).alias("n_links"))


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): connected components by alternating large-star and small-star steps.

    Each step sends every node's neighbours to the smallest of them; the edge table is
    written to the checkpoint folder after each round, and the loop ends when it stays the
    same. The component is its smallest node.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct().checkpoint()
    while True:
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.union(least.filter("m < u").select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").filter("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        then = small.union(down.select("u", F.col("m").alias("v"))).filter("u <> v").distinct().checkpoint()
        if then.count() == now.count() and then.exceptAll(now).isEmpty():
            break
        now = then
    rest = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return rest.unionByName(rest.select(F.col("component").alias("node"), "component").distinct())


def removal_clusters(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, cluster_id, keep) of the rows that share spans or copies: one row of each cluster, the smallest key, is kept."""
    shared = Shared(df, key, text)
    first = shared.members.groupBy("group").agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("n"))
    edges = join_counted(shared.members.select("group", "key"), first, ["group"], "n").filter("key <> first").select("key", "first")
    edges = edges.union(shared.classes.filter("key <> rep").select(F.col("key").cast("long"), F.col("rep").cast("long")))
    return components(edges, "key", "first").select(F.col("node").alias(key), F.col("component").alias("cluster_id"), (F.col("node") == F.col("component")).alias("keep"))
