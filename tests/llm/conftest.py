import os

os.environ.setdefault("OMP_NUM_THREADS", "1")  # small matrices; before numpy loads

import pytest


@pytest.fixture(scope="session")
def sf():
    return os.environ.get("SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def make(spark):
    """DataFrame from tuples and a DDL schema; rows may be empty."""
    return lambda rows, schema: spark.createDataFrame(rows, schema)
