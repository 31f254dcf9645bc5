from __future__ import annotations

import __spark_entry__


def test_queries_and_sql_have_the_same_names():
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) >= 30


def test_flagship_query(spark):
    assert __spark_entry__.entry(spark).count() > 0
