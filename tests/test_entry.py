import __spark_entry__ as entry


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["doc_id", "sent_idx", "sentence", "base", "boosted", "rank"] and df.count() > 0
