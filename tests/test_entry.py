import __spark_entry__


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["query_id", "session_id", "rank", "memory_idx", "segment_id", "text"] and df.count() > 0


def test_keys():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
