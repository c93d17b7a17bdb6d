import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "6g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.execute(f"create view {t} as select * from read_parquet('{DATA}/sf0.001/{t}.parquet')")
    return c


def rows(df):
    """Rows of a pandas frame without order, columns by name, doubles at nine digits."""
    import pandas as pd

    df = df.reindex(sorted(df.columns), axis=1)
    clean = lambda x: None if pd.isna(x) is True else round(x, 9) if isinstance(x, float) else x.tolist() if hasattr(x, "tolist") else x
    return sorted((tuple(map(clean, r)) for r in df.itertuples(index=False)), key=repr)
