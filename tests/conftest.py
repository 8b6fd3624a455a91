import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    builder = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        # fixtures hold a handful of rows: compiling generated code would be most of the time
        .config("spark.sql.codegen.wholeStage", "false")
        .config("spark.sql.codegen.factoryMode", "NO_CODEGEN")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
    )
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    if session.sparkContext.getCheckpointDir() is None:
        session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("ckpt")))
    yield session
    session.stop()


@pytest.fixture(scope="session")
def page(spark):
    """Build a page table from ``{page_id: html}`` or one html text."""

    def make(html, url="http://shop.example.com/list/a?page=2"):
        rows = html if isinstance(html, dict) else {1: html}
        return spark.createDataFrame(
            [(i, url, h) for i, h in rows.items()], "page_id bigint, url string, html string"
        ).coalesce(1)

    return make


@pytest.fixture(scope="session")
def sf():
    return SF
