"""Scans of the corpus tables."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession

_sent: set[str] = set()


def send_package(spark: SparkSession) -> None:
    """Sends this package to the session's Python workers, once, so that they need not have it installed."""
    sc = spark.sparkContext
    if sc.applicationId in _sent:
        return
    _sent.add(sc.applicationId)
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if os.path.isfile(package) or not os.path.isdir(package):
        return  # it runs from an archive that was sent already
    folder = tempfile.mkdtemp(prefix="corpusloom-")  # of the driver, which serves the file
    atexit.register(shutil.rmtree, folder, True)
    path = os.path.join(folder, "corpusloom_package.zip")
    with zipfile.ZipFile(path, "w") as archive:
        for base, _, files in os.walk(package):
            for name in sorted(files):
                if name.endswith(".py"):
                    whole = os.path.join(base, name)
                    archive.write(whole, os.path.relpath(whole, os.path.dirname(package)))
    sc.addPyFile(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data directory; columns and filters reach the parquet scan."""
    send_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session.

    On a cluster it is named by ``spark.checkpoint.dir``. Only where nothing is
    set and the master is local (tests, one machine) a folder below the warehouse is chosen.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    have = sc._jsc.sc().getCheckpointDir()
    if have.isDefined():
        return have.get()
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = spark.conf.get("spark.sql.warehouse.dir", "spark-warehouse")
        named = os.path.join(base, "_checkpoints")
    sc.setCheckpointDir(named)
    return named
