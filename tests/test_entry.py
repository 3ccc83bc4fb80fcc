"""Driver contract and partition-count invariance."""
from conftest import SF_SMALL

import __spark_entry__ as entry
from raterlab.plans import catalog


def test_entry_runs(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert rows and set(df.columns) >= {"approach", "persona", "seed", "field", "precision", "recall", "f1_score"}


def test_every_query_has_oracle():
    assert set(catalog.QUERIES) == set(catalog.ORACLE)
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_partition_count_invariance(spark):
    q = entry.queries()["evaluation_report"]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        one = sorted(map(tuple, q(spark, SF_SMALL).collect()))
        spark.conf.set("spark.sql.shuffle.partitions", "13")
        many = sorted(map(tuple, q(spark, SF_SMALL).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert one == many
