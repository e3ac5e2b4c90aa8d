import os
import sys

import pytest

sys.path[:0] = [os.path.dirname(os.path.dirname(os.path.abspath(__file__))), os.path.dirname(os.path.abspath(__file__))]

from opslake.plans.session import local_session  # noqa: E402

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "opslake-tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


@pytest.fixture
def values(spark):
    """Evaluate a Column -> Column function over a list of texts."""
    def run(fn, texts):
        from pyspark.sql import functions as F
        df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
        return [r[0] for r in df.orderBy("i").select(fn(F.col("t"))).collect()]
    return run
