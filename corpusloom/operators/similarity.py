"""Paragraphs, embeddings and the links that likeness makes between them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.functions import vectors as V
from corpusloom.sources.tables import ensure_checkpoint_dir

#: Vectors of a block of the exact join.
BLOCK = 2000


def paragraphs(pages: DataFrame, key: str, domain: str, text: str) -> DataFrame:
    """(expression_id, domain_id, para_index, text, text_hash): each text once in the corpus, where it comes first.

    ``para_index`` counts from 1 within the page, repeated texts included.
    """
    split = pages.select(F.col(key).alias("expression_id"), F.col(domain).alias("domain_id"), F.posexplode(T.paragraphs(F.col(text))).alias("pos", "text"))
    rows = split.select("expression_id", "domain_id", (F.col("pos") + 1).alias("para_index"), "text", T.text_hash(F.col("text")).alias("text_hash"))
    first = rows.groupBy("text_hash").agg(F.min_by(F.struct(*rows.columns[:-1]), F.struct("expression_id", "para_index")).alias("row"))
    return first.select("row.*", "text_hash")


#: Embedding providers by name: functions from a text column to a vector column. Unknown names embed by hash.
PROVIDERS: dict[str, Callable] = {"fake": V.hash_embedding}


def embeddings(paragraph: DataFrame, done: DataFrame | None = None, provider: str = "fake", key: str = "text_hash") -> DataFrame:
    """(key, embedding, norm) of the paragraphs that have none."""
    rows = paragraph.join(done.select(key), key, "left_anti") if done is not None else paragraph
    vector = PROVIDERS.get(provider, V.hash_embedding)(F.col("text"))
    return rows.select(key, vector.alias("embedding")).withColumn("norm", V.norm(F.col("embedding")))


def relevant_vectors(embedding: DataFrame, paragraph: DataFrame, expression: DataFrame, land_id: int, minrel: int | None = None) -> DataFrame:
    """(paragraph_id, expression_id, embedding): the vectors of a land's paragraphs that take part in likeness.

    With a positive ``minrel`` only those of pages of at least that relevance do; pages without a relevance then do not.
    """
    pages = expression.filter(F.col("land_id") == land_id)
    if minrel and minrel > 0:
        pages = pages.filter(F.col("relevance") >= minrel)
    rows = paragraph.select(F.col("id").alias("paragraph_id"), "expression_id").join(pages.select(F.col("id").alias("expression_id")), "expression_id", "left_semi")
    return embedding.select("paragraph_id", "embedding").join(rows, "paragraph_id")


def summary(paragraph: DataFrame, embedding: DataFrame, similarity: DataFrame, expression: DataFrame, land_id: int) -> DataFrame:
    """One row (paragraphs, embeddings, pseudolinks) of a land; a pseudolink has both its ends there."""
    pages = expression.filter(F.col("land_id") == land_id).select(F.col("id").alias("expression_id"))
    own = paragraph.join(pages, "expression_id", "left_semi").select(F.col("id").alias("paragraph_id"))
    one = own.agg(F.count(F.lit(1)).alias("paragraphs"))
    two = embedding.join(own, "paragraph_id", "left_semi").agg(F.count(F.lit(1)).alias("embeddings"))
    ends = similarity.join(own.withColumnRenamed("paragraph_id", "source_paragraph_id"), "source_paragraph_id", "left_semi").join(own.withColumnRenamed("paragraph_id", "target_paragraph_id"), "target_paragraph_id", "left_semi")
    three = ends.agg(F.count(F.lit(1)).alias("pseudolinks"))
    return one.crossJoin(F.broadcast(two)).crossJoin(F.broadcast(three))  # single rows


def _top(pairs: DataFrame, top_k: int | None, max_pairs: int | None) -> DataFrame:
    order = Window.partitionBy("source_paragraph_id").orderBy(F.col("score").desc(), "target_paragraph_id")
    if top_k:
        pairs = pairs.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= top_k).drop("rn")
    return pairs.orderBy("source_paragraph_id", F.col("score").desc(), "target_paragraph_id").limit(max_pairs) if max_pairs else pairs


def _cells(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The rows of each cell: batches come sorted by their first ``keys`` columns. A cell is bounded by its two blocks."""
    held: list[pa.RecordBatch] = []
    now: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        change = np.zeros(batch.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        starts = [0, *np.flatnonzero(change), batch.num_rows]
        for lo, hi in zip(starts, starts[1:]):
            key = tuple(c[lo] for c in cols)
            if key != now and held:
                yield pa.Table.from_batches(held)
                held = []
            now = key
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def _block_pairs(rows: DataFrame, threshold: float) -> DataFrame:
    """Pairs of ``rows`` (bucket, id, grp, v) within a bucket, of different groups, with a cosine from ``threshold``.

    A bucket's vectors are gathered in blocks of about ``BLOCK``. Every pair of blocks meets in one task
    as a matrix product: each block is sent to the blocks of its row and column of the bucket's block grid, so a task
    holds two blocks, however large the bucket, and nothing is compared twice.
    """
    sizes = rows.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("n"))
    placed = rows.join(F.broadcast(sizes), "bucket").withColumn("own", F.pmod(F.xxhash64("id"), F.col("n")).cast("int"))  # a row for each signature
    cells = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).select("bucket", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "own", "id", "grp", "v")
    names = ["source_paragraph_id", "target_paragraph_id", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in _cells(batches, 3):
            a, b = cell.column("a")[0].as_py(), cell.column("b")[0].as_py()
            own, ids, grp, v = cell.column("own").to_numpy(), cell.column("id").to_numpy(), cell.column("grp").to_numpy(), _matrix(cell.column("v"))
            left, right = np.flatnonzero(own == a), np.flatnonzero(own == b)
            if not len(left) or not len(right):
                continue
            score = v[left] @ v[right].T
            i, j = np.nonzero(score >= threshold)
            one, two = ids[left[i]], ids[right[j]]
            ok = (grp[left[i]] != grp[right[j]]) & ((one < two) if a == b else (one != two))
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(one, two)[ok]), pa.array(np.maximum(one, two)[ok]), pa.array(score[i, j][ok])], names=names)

    return cells.repartition("bucket", "a", "b").sortWithinPartitions("bucket", "a", "b").mapInArrow(run, "source_paragraph_id bigint, target_paragraph_id bigint, score double")


def exact_pairs(vectors: DataFrame, key: str, group: str, vector: str, *, threshold: float = 0.75, top_k: int | None = None, max_pairs: int | None = None) -> DataFrame:
    """(source_paragraph_id, target_paragraph_id, score): pairs of different groups with a cosine from ``threshold``, source before target.

    Every vector meets every other, in blocks: the form for up to some hundred thousand vectors. Rows with a null key, group or vector have no pair.
    """
    ensure_checkpoint_dir(vectors.sparkSession)
    rows = vectors.select(F.lit(0).alias("bucket"), F.col(key).cast("long").alias("id"), F.col(group).cast("long").alias("grp"), V.unit(F.col(vector)).alias("v")).filter("id IS NOT NULL AND grp IS NOT NULL AND v IS NOT NULL").checkpoint()
    return _top(_block_pairs(rows, threshold), top_k, max_pairs)


def lsh_pairs(vectors: DataFrame, key: str, group: str, vector: str, *, dim: int, bits: int = 16, tables: int = 1, threshold: float = 0.75, top_k: int | None = None, max_pairs: int | None = None) -> DataFrame:
    """As ``exact_pairs`` among vectors that have one of ``tables`` signatures of ``bits`` in common: the form for any number of vectors.

    Two vectors at the angle t agree in a bit with the chance 1 - t / pi, so ``tables`` raise the recall and ``bits`` lower the
    work: at a cosine of 0.9, 8 bits find 29 % in one table and 93 % in eight. A hot signature is split into blocks.
    """
    ensure_checkpoint_dir(vectors.sparkSession)
    signs = np.array(V.planes(dim, bits * tables), dtype=float)
    weights = 1 << np.arange(bits, dtype=np.int64)

    def signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v = _matrix(pa.chunked_array([batch.column(2)])).astype(float)
            length = np.sqrt((v * v).sum(axis=1, keepdims=True))
            unit = v / np.where(length == 0, 1.0, length)
            on = (v @ signs.T >= 0).reshape(len(v), tables, bits)
            bucket = (on * weights).sum(axis=2) + (np.arange(tables, dtype=np.int64) << bits)
            take = pa.array(np.repeat(np.arange(len(v)), tables))
            lists = pa.FixedSizeListArray.from_arrays(pa.array(unit.ravel()), v.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(bucket.ravel()), batch.column(0).take(take), batch.column(1).take(take), lists.take(take)], names=["bucket", "id", "grp", "v"])

    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(group).cast("long").alias("grp"), F.col(vector).alias("v")).filter("id IS NOT NULL AND grp IS NOT NULL AND v IS NOT NULL")
    signed = rows.mapInArrow(signatures, "bucket bigint, id bigint, grp bigint, v array<double>").checkpoint()
    pairs = _block_pairs(signed, threshold)
    if tables > 1:  # a pair may meet in several tables
        pairs = pairs.groupBy("source_paragraph_id", "target_paragraph_id").agg(F.max("score").alias("score"))
    return _top(pairs, top_k, max_pairs)


def neighbour_pairs(vectors: DataFrame, key: str, group: str, vector: str, *, top_k: int, max_pairs: int | None = None) -> DataFrame:
    """(source_paragraph_id, target_paragraph_id, score): each vector's ``top_k`` + 1 nearest, itself and its own group left out without replacement, every pair once.

    Queries stand in blocks against all vectors, block by block; each block keeps its best, and the best of those are merged.
    """
    spark = vectors.sparkSession
    ensure_checkpoint_dir(spark)
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(group).cast("long").alias("grp"), V.unit(F.col(vector)).alias("v")).checkpoint()
    n = max(1, -(-rows.count() // BLOCK))
    placed = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = placed.withColumn("b", every).select(F.lit(True).alias("query"), "id", "grp", "v", F.col("block").alias("a"), "b")
    found = placed.withColumn("a", every).select(F.lit(False).alias("query"), "id", "grp", "v", "a", F.col("block").alias("b"))

    def run(cell: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        q, t = pdf[pdf["query"]], pdf[~pdf["query"]].sort_values("id")
        if not len(q) or not len(t):
            return pd.DataFrame({"id": [], "grp": [], "other": [], "ogrp": [], "score": []})
        score = np.vstack(q["v"].to_numpy()) @ np.vstack(t["v"].to_numpy()).T
        best = np.argsort(-score, axis=1, kind="stable")[:, : top_k + 1]
        m = best.shape[1]
        return pd.DataFrame({"id": np.repeat(q["id"].to_numpy(), m), "grp": np.repeat(q["grp"].to_numpy(), m), "other": t["id"].to_numpy()[best].ravel(), "ogrp": t["grp"].to_numpy()[best].ravel(), "score": np.take_along_axis(score, best, 1).ravel()})

    near = asked.unionByName(found).groupBy("a", "b").applyInPandas(run, "id bigint, grp bigint, other bigint, ogrp bigint, score double")
    order = Window.partitionBy("id").orderBy(F.col("score").desc(), "other")
    near = near.withColumn("rn", F.row_number().over(order)).filter((F.col("rn") <= top_k + 1) & (F.col("id") != F.col("other")) & (F.col("grp") != F.col("ogrp")))
    pairs = near.groupBy(F.least("id", "other").alias("source_paragraph_id"), F.greatest("id", "other").alias("target_paragraph_id")).agg(F.max("score").alias("score"))
    return _top(pairs, None, max_pairs)


def entailment(pairs: DataFrame, classify: Callable[[Iterator], Iterator] | None = None) -> DataFrame:
    """Pairs with relation (1, 0, -1) and confidence; without a model every pair is neutral at 0.5."""
    if classify is None:
        return pairs.select("source_paragraph_id", "target_paragraph_id", F.lit(0.0).alias("score"), F.lit(0.5).alias("score_raw"), F.lit("nli").alias("method"))
    return pairs.mapInPandas(classify, "source_paragraph_id bigint, target_paragraph_id bigint, score double, score_raw double, method string")


METHODS = ("nli", "cosine", "cosine_lsh")


def _ends(similarity: DataFrame, paragraph: DataFrame, expression: DataFrame, land_id: int, minrel: int) -> DataFrame:
    """Similarities within a land with the pages at both ends; only the source page must qualify."""
    p = paragraph.select("id", "expression_id", "text")
    e = expression.filter(F.col("land_id") == land_id).select("id", "domain_id", "relevance")
    s = similarity.filter(F.col("method").isin(*METHODS))
    one = p.join(e.filter(F.col("relevance") >= minrel).select(F.col("id").alias("expression_id"), "domain_id"), "expression_id")
    two = p.join(e.select(F.col("id").alias("expression_id"), "domain_id"), "expression_id")
    one = one.select(F.col("id").alias("source_paragraph_id"), F.col("expression_id").alias("e1"), F.col("domain_id").alias("d1"), F.col("text").alias("t1"))
    two = two.select(F.col("id").alias("target_paragraph_id"), F.col("expression_id").alias("e2"), F.col("domain_id").alias("d2"), F.col("text").alias("t2"))
    return s.join(one, "source_paragraph_id").join(two, "target_paragraph_id")


def pseudolinks(similarity: DataFrame, paragraph: DataFrame, expression: DataFrame, land_id: int, minrel: int = 1) -> DataFrame:
    rows = _ends(similarity, paragraph, expression, land_id, minrel)
    return rows.select(F.col("source_paragraph_id").alias("Source_ParagraphID"), F.col("target_paragraph_id").alias("Target_ParagraphID"), F.col("score").alias("RelationScore"), F.coalesce("score_raw", "score").alias("ConfidenceScore"), F.col("t1").alias("Source_Text"), F.col("t2").alias("Target_Text"), F.col("e1").alias("Source_ExpressionID"), F.col("e2").alias("Target_ExpressionID"))


def _measures() -> list:
    score = F.col("score")
    return [
        F.count(F.lit(1)).alias("PairCount"), F.count(F.lit(1)).alias("Weight"), F.count_if(score == 1).alias("EntailCount"), F.count_if(score == 0).alias("NeutralCount"), F.count_if(score == -1).alias("ContradictCount"),
        F.round(F.avg("score"), 6).alias("AvgRelationScore"), F.round(F.avg(F.coalesce("score_raw", "score")), 6).alias("AvgConfidence"),
    ]


def pseudolinks_page(similarity: DataFrame, paragraph: DataFrame, expression: DataFrame, land_id: int, minrel: int = 1) -> DataFrame:
    """Similarities by unordered pair of pages."""
    rows = _ends(similarity, paragraph, expression, land_id, minrel)
    first = F.col("e1") <= F.col("e2")
    rows = rows.withColumns({"se": F.least("e1", "e2"), "te": F.greatest("e1", "e2"), "sd": F.when(first, F.col("d1")).otherwise(F.col("d2")), "td": F.when(first, F.col("d2")).otherwise(F.col("d1"))})
    return rows.groupBy(F.col("se").alias("Source_ExpressionID"), F.col("te").alias("Target_ExpressionID"), F.col("sd").alias("Source_DomainID"), F.col("td").alias("Target_DomainID")).agg(*_measures())


def pseudolinks_domain(similarity: DataFrame, paragraph: DataFrame, expression: DataFrame, domain: DataFrame, land_id: int, minrel: int = 1) -> DataFrame:
    """Similarities by unordered pair of domains, pairs within a domain kept."""
    rows = _ends(similarity, paragraph, expression, land_id, minrel)
    per = rows.groupBy(F.least("d1", "d2").alias("Source_DomainID"), F.greatest("d1", "d2").alias("Target_DomainID")).agg(*_measures())
    s = domain.select(F.col("id").alias("Source_DomainID"), F.col("name").alias("Source_Domain"))
    t = domain.select(F.col("id").alias("Target_DomainID"), F.col("name").alias("Target_Domain"))
    return per.join(s, "Source_DomainID").join(t, "Target_DomainID")


def replaced(similarity: DataFrame, paragraph_ids: DataFrame, method: str) -> DataFrame:
    """What stays when a method is computed anew for the given source paragraphs (column id)."""
    again = paragraph_ids.select(F.col("id").alias("source_paragraph_id"), F.lit(method).alias("method"))
    return similarity.join(again, ["source_paragraph_id", "method"], "left_anti")


def reset(paragraph: DataFrame, embedding: DataFrame, similarity: DataFrame, expression_ids: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables without what belongs to the given pages (column id)."""
    gone = paragraph.join(expression_ids.select(F.col("id").alias("expression_id")), "expression_id", "left_semi").select("id")
    left = paragraph.join(gone, "id", "left_anti")
    vectors = embedding.join(gone.select(F.col("id").alias("paragraph_id")), "paragraph_id", "left_anti")
    links = similarity.join(gone.select(F.col("id").alias("source_paragraph_id")), "source_paragraph_id", "left_anti").join(gone.select(F.col("id").alias("target_paragraph_id")), "target_paragraph_id", "left_anti")
    return left, vectors, links
