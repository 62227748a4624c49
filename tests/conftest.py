import os
import shutil
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    shared = tempfile.mkdtemp(prefix="trackweave-")
    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", f"file://{shared}")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
    shutil.rmtree(shared, ignore_errors=True)


@pytest.fixture(scope="module", autouse=True)
def emptied(spark):
    """What the tests of a module have cached or written to the shared folder goes after them."""
    yield
    spark.catalog.clearCache()
    top = spark.sparkContext.getConf().get("spark.checkpoint.dir").removeprefix("file://")
    for name in os.listdir(top):
        shutil.rmtree(os.path.join(top, name), ignore_errors=True)


@pytest.fixture(scope="session")
def sf_dir():
    return SF
