import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from versegrid.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", cores=8)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def column(spark):
    """Evaluate a Column function on single values."""
    from pyspark.sql import functions as F

    def run(function, *values):
        df = spark.createDataFrame([(v,) for v in values], "v string")
        return [r[0] for r in df.select(function(F.col("v"))).collect()]

    return run
