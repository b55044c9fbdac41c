"""Files. Rows are made by operators; a sink only writes them.

Graph files are one file by their format; they are written by a stream over the rows
(``toLocalIterator``), so the driver holds one partition at a time. For exports of any size the ``_parts`` forms
write from the executors, a file for each partition or archive.
"""

from __future__ import annotations

import csv
import json
import os
import zipfile
from xml.sax.saxutils import quoteattr

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import slug
from corpusloom.operators.select import batches

# Ending of a file by the kind of its export.
ENDINGS = (("csv", ".csv"), ("gexf", ".gexf"), ("corpus", ".zip"), ("htmldump", ".zip"), ("json", ".json"))

# Entries of the header of a corpus file, and the column that fills each.
HEADER = (
    ("Title", "title"), ("Creator", ""), ("Contributor", ""), ("Coverage", ""), ("Date", ""), ("Description", "description"), ("Subject", ""), ("Type", ""), ("Format", ""),
    ("Identifier", "id"), ("Language", ""), ("Publisher", "domain_name"), ("Relation", ""), ("Rights", ""), ("Source", "url"),
)


def file_name(kind: str, stem: str) -> str:
    """Name of an export's file; kinds of no known format get no ending."""
    return stem + next((e for k, e in ENDINGS if kind.endswith(k)), "")


def shown(value) -> str | int | float:
    """A value as graph files show it."""
    if isinstance(value, (bool, int, float)):
        return value
    if isinstance(value, (list, dict)):
        return json.dumps(value, ensure_ascii=False) if value else "na"
    text = str(value).strip() if value is not None else ""
    return "na" if text == "" or text.lower() == "unknown" else text


def write_csv(df: DataFrame, path: str, header: bool = False) -> int:
    """All fields quoted; the header stands only above rows, unless asked for. Returns the rows."""
    n = 0
    with open(path, "w", newline="", encoding="utf-8") as f:
        out = csv.writer(f, quoting=csv.QUOTE_ALL, lineterminator="\n")
        if header:
            out.writerow(df.columns)
        for row in df.toLocalIterator():
            if n == 0 and not header:
                out.writerow(df.columns)
            out.writerow(["" if v is None else v for v in row])
            n += 1
    return n


def write_csv_parts(df: DataFrame, path: str) -> None:
    """For exports of any size: one file for each partition, written by the executors."""
    df.write.mode("overwrite").option("header", True).option("quoteAll", True).csv(path)


def write_graph_json(nodes: DataFrame, links: DataFrame, path: str) -> int:
    """``{nodes, links}`` for a force graph."""
    n = 0
    with open(path, "w", encoding="utf-8") as f:
        f.write('{"nodes":[')
        for n, row in enumerate(nodes.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).toLocalIterator(), 1):
            f.write(("," if n > 1 else "") + row[0])
        f.write('],"links":[')
        for i, row in enumerate(links.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).toLocalIterator()):
            f.write(("," if i else "") + row[0])
        f.write("]}")
    return n


def write_gexf(nodes: DataFrame, edges: DataFrame, path: str, *, key: str, label: str, size: str, attributes: list[str]) -> int:
    """GEXF 1.2: nodes with attributes and size, directed weighted edges (source, target, weight)."""
    n = 0
    with open(path, "w", encoding="utf-8") as f:
        f.write('<?xml version="1.0" encoding="UTF-8"?>\n<gexf xmlns="http://www.gexf.net/1.2draft" xmlns:viz="http://www.gexf.net/1.2draft/viz" version="1.2"><graph mode="static" defaultedgetype="directed"><attributes class="node">')
        kinds = dict(nodes.dtypes)
        for i, a in enumerate(attributes):
            kind = "double" if kinds[a] in ("double", "float") else "integer" if kinds[a] in ("int", "bigint") else "string"
            f.write(f'<attribute id="{i}" title={quoteattr(a)} type="{kind}"/>')
        f.write("</attributes><nodes>")
        for row in nodes.toLocalIterator():
            n += 1
            f.write(f"<node id={quoteattr(str(row[key]))} label={quoteattr(str(shown(row[label])))}><attvalues>")
            f.write("".join(f'<attvalue for="{i}" value={quoteattr(str(shown(row[a])))}/>' for i, a in enumerate(attributes)))
            f.write(f'</attvalues><viz:size value="{row[size] or 0}"/></node>')
        f.write("</nodes><edges>")
        for row in edges.toLocalIterator():
            f.write(f"<edge id={quoteattr(f'{row.source}_{row.target}')} source={quoteattr(str(row.source))} target={quoteattr(str(row.target))} weight=\"{row.weight}\"/>")
        f.write("</edges></graph></gexf>")
    return n


def corpus_files(pages: DataFrame, size: int = 1000) -> DataFrame:
    """(batch, name, body): a text file for each page, 1000 in an archive: a Dublin Core header and the readable text.

    Null values stand as ``None`` in the header; pages without title have the name ``b``.
    """
    none = lambda c: F.coalesce(F.col(c), F.lit(""))
    lines = [x for k, c in HEADER for x in (F.lit(f'{k}: "'), F.coalesce(F.col(c).cast("string"), F.lit("None")) if c else F.lit(""), F.lit('"\n'))]
    head = F.concat(F.lit("---\n"), *lines, F.lit("---\n"))
    # ids alone are numbered, so no text is written to the checkpoint folder
    rows = pages.join(batches(pages.select("id"), ["id"], size).select("id", "batch"), "id")
    return rows.select("batch", F.concat(F.col("id").cast("string"), F.lit("-"), slug("title"), F.lit(".txt")).alias("name"), F.concat(head, none("readable")).alias("body"))


def write_corpus(pages: DataFrame, stem: str, size: int = 1000) -> int:
    """Archives ``stem_00001.zip`` and so on."""
    n, open_, archive = 0, None, None
    for row in corpus_files(pages, size).orderBy("batch", "name").toLocalIterator():
        if row.batch != open_:
            if archive:
                archive.close()
            open_, archive = row.batch, zipfile.ZipFile(f"{stem}_{row.batch:05d}.zip", "w", zipfile.ZIP_DEFLATED)
        archive.writestr(row.name, row.body)
        n += 1
    if archive:
        archive.close()
    return n


def write_corpus_parts(pages: DataFrame, stem: str, size: int = 1000) -> int:
    """The archives of ``write_corpus``, each written by the task that holds its texts; ``stem`` lies in a folder that all executors share. Returns the texts."""
    import pyarrow as pa

    def run(parts):
        n, open_, archive = 0, None, None
        for part in parts:
            for batch, name, body in zip(*(part.column(i).to_pylist() for i in range(3))):
                if batch != open_:
                    if archive:
                        archive.close()
                    open_, archive = batch, zipfile.ZipFile(f"{stem}_{batch:05d}.zip", "w", zipfile.ZIP_DEFLATED)
                archive.writestr(name, body)
                n += 1
        if archive:
            archive.close()
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    files = corpus_files(pages, size).repartition("batch").sortWithinPartitions("batch", "name").select("batch", "name", "body")
    return files.mapInArrow(run, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]


def write_html_dump(pages: DataFrame, manifest: DataFrame, path: str) -> int:
    """Stored pages and ``manifest.csv`` in one archive."""
    n = 0
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
        for row in pages.select("id", "html").toLocalIterator():
            archive.writestr(f"{row.id}.html", row.html)
            n += 1
        side = path + ".manifest"
        write_csv(manifest, side, header=True)
        archive.write(side, "manifest.csv")
        os.remove(side)
    return n


def appended(table: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """A table with the new rows whose keys it lacks, each key once."""
    return table.unionByName(new.dropDuplicates(key).join(table.select(*key), key, "left_anti").select(*table.columns))
