import csv
import json
import os
import xml.etree.ElementTree as ET
import zipfile

import pytest

from corpusloom.plans.model import Model
from corpusloom.sinks import exports

DATA = os.environ.get("CORPUSLOOM_TESTDATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def tables(spark):
    return Model(spark, DATA)


@pytest.mark.parametrize("kind", exports.KINDS)
def test_every_kind(tables, tmp_path, kind):
    stem = str(tmp_path / "out")
    n = exports.export(tables, kind, 1, stem)
    pages = tables.expression.filter("land_id = 1 AND relevance >= 1").count()
    made = sorted(os.listdir(tmp_path))
    assert made
    if kind in ("pagecsv", "fullpagecsv", "corpus", "pagesjson", "pagegexf"):
        assert n == pages
    if kind == "pagecsv":
        rows = list(csv.DictReader(open(stem + ".csv")))
        assert len(rows) == pages and "sr_rank" in rows[0] and list(rows[0])[:3] == ["id", "url", "title"]
    if kind == "nodelinkcsv":
        assert made == [f"out_{x}.csv" for x in ("domainlinks", "domainnodes", "pageslinks", "pagesnodes")]
        assert all("" not in r.values() for r in csv.DictReader(open(stem + "_pagesnodes.csv")))
    if kind == "pagesjson":
        node = json.load(open(stem + ".json"))["nodes"][0]
        assert isinstance(node["tags"], list) and isinstance(node["seorank"], dict) and "depth" not in node
    if kind == "nodesjson":
        graph = json.load(open(stem + ".json"))
        assert {"source", "target", "value"} <= set(graph["links"][0]) if graph["links"] else True
        assert [p["urlarticle"] for p in graph["nodes"][0]["corpus"]] == sorted(p["urlarticle"] for p in graph["nodes"][0]["corpus"])
    if kind.endswith("gexf"):
        assert ET.parse(stem + ".gexf").getroot().tag.endswith("gexf")
    if kind == "htmldump":
        with zipfile.ZipFile(stem + ".zip") as z:
            assert len(z.namelist()) == n + 1
    if kind.startswith("pseudolinks"):
        assert made == ["out"]


def test_full_html_switches(tables, tmp_path):
    exports.export(tables, "nodelinkcsv", 1, str(tmp_path / "x"), fullhtml=True)
    assert "x_pageslinksfullhtml.csv" in os.listdir(tmp_path) and "x_pageslinks.csv" not in os.listdir(tmp_path)


def test_tags_and_unknown_kinds(tables, tmp_path):
    assert exports.export_tags(tables, "matrix", 1, str(tmp_path / "m")) > 0 and exports.export_tags(tables, "content", 99, str(tmp_path / "c")) == 0
    assert (tmp_path / "c.csv").read_text() == '"path","content","expression_id"\n'
    with pytest.raises(ValueError):
        exports.frames(tables, "other", 1)


def test_the_package_is_sent_once(spark, tables):
    tables.base("land").count()
    assert sum("corpusloom_package" in x for x in spark.sparkContext._python_includes) == 1


@pytest.mark.parametrize("kind", ["pagecsv", "nodelinkcsv", "pagesjson", "corpus", "htmldump"])
def test_parts(tables, tmp_path, kind):
    stem = str(tmp_path / "out")
    made = exports.export_parts(tables, kind, 1, stem)
    pages = tables.expression.filter("land_id = 1 AND relevance >= 1").count()
    if kind == "pagecsv":
        assert tables.spark.read.option("header", True).option("multiLine", True).csv(made[0]).count() == pages
    elif kind == "nodelinkcsv":
        assert [os.path.basename(x) for x in made] == ["out_pagesnodes", "out_domainnodes", "out_pageslinks", "out_domainlinks"]
    elif kind == "pagesjson":
        assert tables.spark.read.json(made[0]).count() == pages
    elif kind == "corpus":
        names = [n for f in sorted(os.listdir(tmp_path)) for n in zipfile.ZipFile(tmp_path / f).namelist()]
        assert len(names) == pages
    else:
        assert set(tables.spark.read.parquet(made[0]).columns) == {"id", "html"}


def test_orders(tables):
    four = exports.frames(tables, "nodelinkcsv", 1)
    relevance = [int(r["relevance"]) for r in four["pagesnodes"].collect()]
    sizes = [int(r["nbexpressions"]) for r in four["domainnodes"].collect()]
    counts = [r["link_count"] for r in four["domainlinks"].collect()]
    assert relevance == sorted(relevance, reverse=True) and sizes == sorted(sizes, reverse=True) and counts == sorted(counts, reverse=True)
