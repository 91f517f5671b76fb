"""A stream's windows against the same windows over the whole table."""

from pyspark.sql import functions as F

from tessera.streaming import windows


def test_windows(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("ts", "event_type", "value")
    events.repartitionByRange(3, "ts").sortWithinPartitions("ts").write.parquet(str(tmp_path / "in"))
    found = windows.windowed(windows.stream(spark, str(tmp_path / "in"), events.schema, 3), "ts", "1 day", "1 hour", "event_type", value="value")
    run = found.writeStream.format("memory").queryName("windows").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert not run.isActive
    got = {(r["start"], r["event_type"]): (r["n"], round(r["total"], 4)) for r in spark.table("windows").collect()}
    whole = events.groupBy(F.window(F.col("ts").cast("timestamp"), "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("t"))
    assert got == {(r["w"]["start"], r["event_type"]): (r["n"], round(r["t"], 4)) for r in whole.collect()}
