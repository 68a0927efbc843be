from pyspark.sql import functions as F

from barloom.streaming.bars import stream_bars

SF = "/root/testdata/sf0.001"


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    for k, part in enumerate(events.orderBy("ts").randomSplit([1.0] * 3, 1)):
        part.coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    stream = spark.readStream.schema(events.schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    # all three files lie within one trigger, so nothing is late
    query = stream_bars(stream, "3 hours", "40 days").writeStream.format("memory").queryName("streamed").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = spark.table("streamed")
    want = stream_bars(events, "3 hours")
    assert want.count() > 100
    # append mode holds back the bars that the watermark has not passed: here all of them
    assert got.join(want, ["symbol", "ts"], "left_anti").count() == 0


def test_batch_bars(spark):
    events = spark.read.parquet(f"{SF}/events.parquet")
    bars = stream_bars(events, "1 hour")
    assert bars.agg(F.sum("volume")).first()[0] == events.count()
    assert bars.where("low > least(open, close) or high < greatest(open, close)").count() == 0
