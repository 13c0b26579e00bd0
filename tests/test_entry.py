import __spark_entry__


def test_entry_and_queries(spark):
    assert __spark_entry__.entry(spark).count() > 0
    names = __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(names)


def test_streaming_equals_batch(spark):
    queries, root = __spark_entry__.queries(), "/root/testdata/sf0.001"
    kept = lambda name: {r.id for r in queries[name](spark, root).filter("drop_code is null").collect()}
    assert len(kept("streaming_exact_dedup")) == len(kept("exact_dedup"))
