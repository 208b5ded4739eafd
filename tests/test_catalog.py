"""The contract of the entry module."""

import __spark_entry__


def test_every_sql_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_flagship_has_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0
