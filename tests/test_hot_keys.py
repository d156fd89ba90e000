"""Hot keys are those of a plain count, and keys are shuffled only where a hash has too many rows."""

from pyspark.sql import functions as F

from seqloom.operators import skew


def test_like_a_plain_count(spark, hot, monkeypatch):
    rows = [(k, None if k == 9 else f"o{k % 4}") for k in range(10) for _ in range(k)]
    df = spark.createDataFrame(rows, "k int, o string")
    for buckets in (1, 5, skew.HOT_BUCKETS):
        monkeypatch.setattr(skew, "HOT_BUCKETS", buckets)
        for keys in (["k"], ["o"], ["k", "o"]):
            want = df.groupBy(*keys).count().filter("count > 3").select(*keys).collect()
            assert sorted(map(tuple, skew.hot_keys(df, keys).collect()), key=str) == sorted(map(tuple, want), key=str)
    assert skew.hot_keys(df.filter("k < 4"), ["k"]) is None


def test_many_rare_keys_are_not_shuffled_one_by_one(spark, monkeypatch):
    monkeypatch.setattr(skew, "HOT_BUCKETS", 16)
    grouped = []
    plain = type(spark.range(1)).groupBy
    monkeypatch.setattr(type(spark.range(1)), "groupBy", lambda df, *by: grouped.append(by) or plain(df, *by))
    assert skew.hot_keys(spark.range(5000).select(F.col("id").alias("k")), ["k"]) is None
    assert grouped == [("_bucket",)]
