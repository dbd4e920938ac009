"""Queries on a session that nobody set up for them."""

import pytest
from compare import compare, duck

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
STORE = "spark.sql.streaming.stateStore.providerClass"
PLAIN = "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"


@pytest.mark.parametrize("name", ["stream_changes_initial", "stream_pages_short"])
def test_streams_with_several_states(spark, name):
    given = spark.conf.get(STORE)
    spark.conf.set(STORE, PLAIN)
    try:
        ok, note = compare(spark, duck(SF), SF, entry.queries()[name], entry.oracle_sql()[name])
        assert ok, note
        assert spark.conf.get(STORE) == PLAIN
    finally:
        spark.conf.set(STORE, given)
