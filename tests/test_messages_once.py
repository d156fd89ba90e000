"""Messages are derived and parsed once each: no path read anew per row, no text parsed twice, no method the JVM never compiles."""

from pyspark.sql import functions as F

from seqloom.sources import messages, wire


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_text_is_parsed_once(spark):
    raw = spark.createDataFrame([('{"a":1}',), ('{"a":1} x',), ('["a"]',), ("",), (None,)], "value string")
    found = raw.select(wire.whole_json(F.col("value")).alias("m"))
    assert planned(found).count("parseJson(") == 1 and planned(found).count("sha2(") == 1
    texts = found.select(F.to_json("m").alias("t")).collect()
    assert [r.t for r in texts] == ['{"a":1}', None, '["a"]', None, None]


def test_paths_are_literals(spark):
    wire.last_key_wins(spark)
    raw = spark.createDataFrame([("{}", 0, 0)], "value string, partition int, offset long")
    assert "concat($." not in planned(wire.parse_envelope(raw).select("parse_ok"))


def test_text_stays_out_of_whole_stage_code(spark):
    raw = messages.raw_events(spark, "/root/testdata/sf0.001").select("value")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = planned(raw)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert plan.startswith("Project")
