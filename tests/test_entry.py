"""Driver contract: entry runs, every oracle key is a query."""

import __spark_entry__ as E


def test_contract(spark):
    qs, sqls = E.queries(), E.oracle_sql()
    assert set(sqls) <= set(qs)
    df = E.entry(spark)
    assert df.count() >= 0 and set(df.columns) == {"district", "number_of_flags", "n"}
