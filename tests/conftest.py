import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "6g").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def rows_of(frame):
    """Sorted rows of text, columns by name, doubles to six decimals."""
    import pandas as pd

    frame = frame[sorted(frame.columns)].astype(object)

    def one(x):
        if x is None or x is pd.NaT or (isinstance(x, float) and x != x):
            return "null"
        return repr(round(float(x), 6) + 0.0) if isinstance(x, float) else str(x)

    return sorted(tuple(map(one, r)) for r in frame.itertuples(index=False, name=None))
