import csv
import json
import zipfile
import xml.etree.ElementTree as ET

import pandas as pd
from pyspark.sql import functions as F

from corpusloom.sinks import files
from corpusloom.sources import inputs
from corpusloom.streaming import incremental


def test_csv(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "q"'), (2, None)], "id int, t string")
    assert files.write_csv(df, str(tmp_path / "a.csv")) == 2
    assert list(csv.reader(open(tmp_path / "a.csv"))) == [["id", "t"], ["1", 'a "q"'], ["2", ""]]
    assert files.write_csv(df.limit(0), str(tmp_path / "b.csv")) == 0 and (tmp_path / "b.csv").read_text() == ""
    files.write_csv(df.limit(0), str(tmp_path / "c.csv"), header=True)
    assert (tmp_path / "c.csv").read_text() == '"id","t"\n'
    files.write_csv_parts(df, str(tmp_path / "parts"))
    assert spark.read.option("header", True).csv(str(tmp_path / "parts")).count() == 2


def test_graph_files(spark, tmp_path):
    nodes = spark.createDataFrame([(1, "a & b", 2.5, None), (2, "unknown", 1.0, "x")], "id int, name string, size double, note string")
    edges = spark.createDataFrame([(1, 2, 3)], "source int, target int, weight int")
    files.write_gexf(nodes, edges, str(tmp_path / "g.gexf"), key="id", label="name", size="size", attributes=["note", "size"])
    ns = {"g": "http://www.gexf.net/1.2draft"}
    root = ET.parse(tmp_path / "g.gexf").getroot()
    assert [n.get("label") for n in root.iterfind(".//g:node", ns)] == ["a & b", "na"] and root.find(".//g:edge", ns).get("id") == "1_2"
    files.write_graph_json(nodes, edges, str(tmp_path / "g.json"))
    got = json.load(open(tmp_path / "g.json"))
    assert got["nodes"][0]["note"] is None and got["links"] == [{"source": 1, "target": 2, "weight": 3}]


def test_archives(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"Title {i}" if i else None, "u", "d", "dom", f"text {i}") for i in range(5)], "id bigint, title string, url string, description string, domain_name string, readable string")
    assert files.write_corpus(pages, str(tmp_path / "corpus"), size=2) == 5
    assert sorted(p.name for p in tmp_path.glob("*.zip")) == ["corpus_00001.zip", "corpus_00002.zip", "corpus_00003.zip"]
    with zipfile.ZipFile(tmp_path / "corpus_00001.zip") as z:
        assert z.namelist() == ["0-b.txt", "1-b-title-1.txt"] and z.read("1-b-title-1.txt").decode()== '---\nTitle: "Title 1"\nCreator: ""\nContributor: ""\nCoverage: ""\nDate: ""\nDescription: "d"\nSubject: ""\nType: ""\nFormat: ""\nIdentifier: "1"\nLanguage: ""\nPublisher: "dom"\nRelation: ""\nRights: ""\nSource: "u"\n---\ntext 1'
    html = spark.createDataFrame([(1, "<p>é")], "id bigint, html string")
    files.write_html_dump(html, html.select("id", F.octet_length("html").alias("size_bytes")), str(tmp_path / "d.zip"))
    with zipfile.ZipFile(tmp_path / "d.zip") as z:
        assert z.read("manifest.csv").decode() == '"id","size_bytes"\n"1","5"\n'


def test_names_and_values():
    assert [files.file_name(k, "x") for k in ("pagecsv", "nodegexf", "corpus", "htmldump", "nodesjson", "pseudolinks")] == ["x.csv", "x.gexf", "x.zip", "x.zip", "x.json", "x"]
    assert [files.shown(v) for v in (None, " ", "Unknown", [], {"a": 1}, 0, True, " x ")] == ["na", "na", "na", "na", '{"a": 1}', 0, True, "x"]


def test_inputs(spark, tmp_path, rows):
    assert rows(inputs.url_argument(spark, "a, ,b,,c ")) == [("",), ("a",), ("b",), ("c",)]
    (tmp_path / "u.txt").write_text("https://a\n\n https://b \n")
    assert rows(inputs.url_file(spark, str(tmp_path / "u.txt"))) == [("https://a",), ("https://b",)]
    urls = spark.createDataFrame([("u1",), ("u2",)], "url string")
    assert rows(inputs.fetched(urls).select("url", "status")) == [("u1", "ERR"), ("u2", "ERR")]
    own = lambda s: pd.DataFrame({"url": s, "strategy": "t", "status": "200", "html": "<p>"})
    assert inputs.fetched(urls, fetch=own).filter("html = '<p>'").count() == 2
    table = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "k int, v string")
    assert rows(files.appended(table.limit(1), table, ["k"])) == [(1, "a"), (2, "b")]


def test_stream(spark, tmp_path):
    src = spark.createDataFrame([(1, "2024-01-01 00:10:00", "a"), (2, "2024-01-01 00:50:00", "a"), (3, "2024-01-01 01:10:00", "b")], "id int, t string, kind string").withColumn("ts", F.to_timestamp("t")).drop("t")
    src.write.parquet(str(tmp_path / "in"))
    stream = incremental.arriving(spark, str(tmp_path / "in"), src.schema)
    q = incremental.events_per_window(stream, "ts", "kind").writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r["kind"], r["n"]) for r in spark.table("windows").collect()) == [("a", 2), ("b", 1)]
    incremental.each_batch(incremental.arriving(spark, str(tmp_path / "in"), src.schema), lambda b: b.filter("id > 1"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
