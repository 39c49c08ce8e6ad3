import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from workload.check import session

    session_ = session()
    session_.sparkContext.setLogLevel("ERROR")
    yield session_


@pytest.fixture
def files(spark):
    """``make([(path, content), ...])`` gives a files table of one corpus."""
    from pyspark.sql import functions as F

    from corpuslens.sources.files import from_table

    def make(rows, corpus="c"):
        table = spark.createDataFrame(rows, "path string, content string")
        return from_table(
            table, F.lit(corpus), F.concat(F.lit("/r/"), "path"), F.col("content"), F.lit("/r")
        )

    return make
