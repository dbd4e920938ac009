"""Tasks of a bounded number of rows."""

from atalaya.plans.tables import ROWS_A_TASK, spread


def test_many_rows_in_one_partition(spark):
    cores = spark.sparkContext.defaultParallelism
    rows = spark.range(ROWS_A_TASK * (cores + 3) + 1).coalesce(1)
    dealt = spread(rows)
    assert dealt.rdd.getNumPartitions() == cores + 4 and dealt.count() == rows.count()
    assert max(dealt.rdd.glom().map(len).collect()) <= ROWS_A_TASK + 1
    assert spread(rows.limit(10)).rdd.getNumPartitions() == cores
