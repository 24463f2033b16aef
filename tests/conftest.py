import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.maxMetadataStringLength", "4000")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture(scope="session")
def data():
    return "/root/testdata/sf0.001"


FILE = "node_id long, path string, name string, is_dir boolean, size long, modified timestamp, created timestamp, hidden boolean, in_package boolean, tags array<string>, text string"


@pytest.fixture
def files(spark):
    """Build a table of files from (path, options) entries."""
    from datetime import datetime

    def build(*entries):
        rows = []
        for i, e in enumerate(entries):
            path, more = (e, {}) if isinstance(e, str) else e
            path = path if path.startswith("/") else "/root/" + path
            row = {"node_id": i, "path": path, "name": path.rsplit("/", 1)[-1], "is_dir": False, "size": 10, "modified": datetime(2024, 1, 1), "created": datetime(2024, 1, 1), "hidden": False, "in_package": False, "tags": [], "text": None} | more
            rows.append(tuple(row.values()))
        return spark.createDataFrame(rows, FILE)

    return build


@pytest.fixture
def names():
    """Names of a search, in order."""

    def run(table, query, options=None, **more):
        from sparklode.operators.search import search

        return [r["name"] for r in search(table, query, options, **more).orderBy("rank").collect()]

    return run
