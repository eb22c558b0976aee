import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from refloom.session import local_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return local_session(8, "refloom-tests", shuffle_partitions=4)


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def one(spark):
    """Evaluate a column over a few texts: `one(col_of("t"), texts) -> list`."""

    def run(column, texts):
        df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
        return [r.out for r in df.select("i", column.alias("out")).orderBy("i").collect()]

    return run


@pytest.fixture(scope="session")
def over(spark):
    """Evaluate a column over a few parameter maps."""

    def run(column, maps):
        df = spark.createDataFrame(list(enumerate(maps)), "i int, m map<string,string>")
        return [r.out for r in df.select("i", column.alias("out")).orderBy("i").collect()]

    return run
