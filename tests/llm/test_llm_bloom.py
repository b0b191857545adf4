"""The Bloom filter lets every key through and few others."""

from pyspark.sql import functions as F

from skiff.llm import bloom


def test_keys_pass_and_few_others(spark, monkeypatch):
    keys = spark.range(0, 4000, 2).select(F.xxhash64("id").alias("hash"))
    all_of = spark.range(0, 40000).withColumn("hash", F.xxhash64("id"))
    among = bloom.Bloom(keys)
    passed = {r.id for r in all_of.filter(among.maybe(F.col("hash"))).select("id").collect()}
    assert passed >= set(range(0, 4000, 2)) and len(passed) < 2000 + 0.06 * 38000
    assert all_of.filter(bloom.Bloom(keys.limit(0)).maybe(F.col("hash"))).count() == 0
    monkeypatch.setattr(bloom, "MOST", 64)  # full: lets more through, never less
    assert all_of.filter(bloom.Bloom(keys).maybe(F.col("hash"))).count() == 40000
