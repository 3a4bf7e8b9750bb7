"""Streams against the same aggregates over the whole table."""

from pyspark.sql import functions as F

from riskloom.streaming.live import live_hotspots, live_trend

SF = "/root/testdata/sf0.001"


def items(df):
    risk = F.when(F.col("event_type") == "error", "high").when(F.col("event_type") == "purchase", "medium").otherwise("low")
    return df.select(F.col("ts").cast("timestamp").alias("timestamp"), F.col("user_id").alias("file"), risk.alias("risk"))


def run(spark, make, name, tmp_path):
    whole = spark.read.parquet(f"{SF}/events.parquet")
    whole.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(whole.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = make(items(stream), late="100 days").writeStream.outputMode("complete").format("memory").queryName(name).start()
    query.processAllAvailable()
    query.stop()
    return sorted(map(str, spark.table(name).collect())), sorted(map(str, make(items(whole)).collect()))


def test_streams(spark, tmp_path):
    for k, make in enumerate((live_hotspots, live_trend)):
        got, want = run(spark, make, f"live{k}", tmp_path / str(k))
        assert got == want and len(got) > 10
