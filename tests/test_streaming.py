"""A stream of event files gives the sessions of the batch query."""

from pyspark.sql import functions as F

from quillon.operators import layout
from quillon.streaming.sessions import sessions


def test_sessions_equal_batch_islands(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    late = events.agg(F.max("ts")).first()[0]
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    query = sessions(stream, "user_id", "ts", "6 hours", "3650 days").writeStream.format("memory").queryName("told").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert spark.table("told").count() == 0 and late is not None  # the watermark has passed no session
    batch = sessions(events, "user_id", "ts", "6 hours", "0 seconds")
    marked = layout.gap_islands(events.withColumn("at", F.unix_micros("ts")), ["user_id"], ["at", "event_id"], F.col("at"), 6 * 3600 * 1_000_000 - 1)
    islands = marked.groupBy("user_id", "island").agg(F.count(F.lit(1)).alias("n"))
    assert sorted((r["user_id"], r["n"]) for r in batch.collect()) == sorted((r["user_id"], r["n"]) for r in islands.collect())
