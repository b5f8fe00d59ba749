"""Every query runs on the driver's tables, and equals its SQL where there is any."""

import pytest
from conftest import same

from cohortis.plans import catalogue

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, duck, name):
    df = QUERIES[name](spark, data)
    if name in SQL:
        same(df, duck.sql(SQL[name]))
    else:
        first, again = df.collect(), QUERIES[name](spark, data).collect()
        assert first and sorted(map(str, first)) == sorted(map(str, again))


def test_entry(spark, data):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_plans_push_down(spark, data):
    plan = QUERIES["dim_lookup_left"](spark, data)._jdf.queryExecution().toString()
    assert "n_chars" not in plan.split("== Physical Plan ==")[1].split("ReadSchema")[1]  # columns are pruned
    plan = QUERIES["qc_class"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
