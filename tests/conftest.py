import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from docweave.session import build_session

    return build_session("tests", 4)


@pytest.fixture(scope="session")
def value(spark):
    """Evaluate a column function on one text."""
    from pyspark.sql import functions as F

    def run(fn, *texts):
        names = [f"c{i}" for i in range(len(texts))]
        df = spark.createDataFrame([tuple(texts)], ", ".join(f"{n} string" for n in names)).coalesce(1)
        return df.select(fn(*[F.col(n) for n in names]).alias("v")).collect()[0]["v"]

    return run
