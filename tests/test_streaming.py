from mosaiq.operators import segments
from mosaiq.sources import adapters
from mosaiq.streaming import segments as streaming

SF = "/root/testdata/sf0.001"


def run(df, mode, name, spark):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def test_streams_equal_batch(spark, tmp_path):
    frames = adapters.frames(spark, SF).select("video_id", "segment_id", "frame_index", "ts", "ts_s", "value", "success")
    frames.write.parquet(str(tmp_path / "frames"))
    stream = spark.readStream.schema(frames.schema).parquet(str(tmp_path / "frames"))
    got = run(streaming.windowed_segments(stream, "1 day", "1 hour"), "complete", "windows", spark)
    batch = streaming.windowed_segments(spark.read.parquet(str(tmp_path / "frames")), "1 day", "1 hour")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.collect()))
    one = frames.filter("segment_id in (3, 4)")
    one.coalesce(1).write.parquet(str(tmp_path / "one"))
    pairs = run(streaming.streaming_pairs(spark.readStream.schema(one.schema).parquet(str(tmp_path / "one"))), "append", "pairs", spark)
    want = segments.adjacent_pairs(one).select("video_id", "segment_id", "pair_index", "ok", "change")
    assert sorted(map(repr, pairs.collect())) == sorted(map(repr, want.collect()))


def test_pairs_over_micro_batches_stay_in_their_segment(spark, tmp_path):
    shape = "video_id long, segment_id int, frame_index int, ts timestamp, value double, success boolean"
    parts = [
        [(1, 0, 0, "2024-01-01 00:00:00", 1.0, True), (1, 0, 1, "2024-01-01 00:00:01", 3.0, True), (1, 1, 0, "2024-01-01 00:00:05", 9.0, True)],
        [(1, 0, 3, "2024-01-01 00:00:03", 5.0, True), (1, 0, 2, "2024-01-01 00:00:02", 4.0, None), (1, 1, 1, "2024-01-01 00:00:06", 7.0, True), (1, 1, None, "2024-01-01 00:00:06", 7.0, True)],
    ]
    for n, rows in enumerate(parts):
        made = spark.createDataFrame([(v, s, f, t, x, ok) for v, s, f, t, x, ok in rows], shape.replace("ts timestamp", "ts string"))
        made.withColumn("ts", made["ts"].cast("timestamp")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = run(streaming.streaming_pairs(stream), "append", "pairs_in_parts", spark)
    assert sorted(map(tuple, got.collect())) == [(1, 0, 0, True, 2.0), (1, 0, 1, False, None), (1, 0, 2, False, None), (1, 1, 0, True, 2.0)]
