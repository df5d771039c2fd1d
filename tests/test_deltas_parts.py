"""How an increment is dealt to tasks."""

from pyspark.sql import functions as F

from ridgeline.operators.deltas import merge_delta
from ridgeline.operators.store import Store


def test_a_bucket_is_written_by_several_tasks(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}")
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        merge_delta(store, "t", spark.range(4000).withColumn("v", F.col("id") * 2), ["id"], buckets=1)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert len(list(tmp_path.glob("t/data/*/*/*.parquet"))) > 1
    assert store.read("t").agg(F.count("*"), F.sum("v")).first() == (4000, 3999 * 4000)
