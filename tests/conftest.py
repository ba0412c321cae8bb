import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from vigilake.session import configure  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "4g")
        .getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield configure(session)
    session.stop()


@pytest.fixture
def files(spark):
    """Files from a dict of path to content, in one repository."""
    def make(contents: dict, repo: str = "r"):
        return spark.createDataFrame(
            [(repo, p, c) for p, c in contents.items()], "repo string, path string, content string")

    return make


@pytest.fixture
def found(files):
    """Sorted (path, rule, line, column) of a scan."""
    from vigilake.plans.scan import scan

    def run(contents: dict, **options):
        rows = scan(files(contents), **options).select("path", "check_name", "line", "column").collect()
        return sorted(tuple(r) for r in rows)

    return run
