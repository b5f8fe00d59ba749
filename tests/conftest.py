import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from cohortis.session import session

    made = session("local[4]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false", spark__driver__memory="4g", spark__ui__showConsoleProgress="false")
    made.sparkContext.setLogLevel("ERROR")
    yield made
    made.stop()


@pytest.fixture(scope="session")
def data():
    if not os.path.isdir(DATA):
        pytest.skip("the driver's tables are not mounted")
    return DATA


@pytest.fixture(scope="session")
def duck(data):
    import duckdb

    db = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        db.sql(f"create view {name} as select * from '{data}/{name}.parquet'")
    return db


def same(df, relation):
    """Compare a DataFrame with a DuckDB relation: column names, and rows in any order with doubles to 5 places."""
    import math

    columns = sorted(df.columns)
    assert columns == sorted(relation.columns)

    def text(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return "-"
        if isinstance(v, float):
            return f"{v:.5f}" if abs(v) > 5e-6 else "0.00000"
        return str(v)

    rows = sorted(tuple(map(text, r)) for r in df.select(*[f"`{c}`" for c in columns]).collect())
    want = sorted(tuple(map(text, r)) for r in relation.select(*[f'"{c}"' for c in columns]).fetchall())
    assert rows == want
