"""Streaming counterparts: segments as event-time windows and adjacent pairs with keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed_segments(frames: DataFrame, length: str = "5 seconds", delay: str = "10 seconds") -> DataFrame:
    """Count, mean and largest value of each recording's event-time segment; late frames beyond delay are left out."""
    timed = frames.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    grouped = timed.groupBy("video_id", F.window("ts", length))
    return grouped.agg(F.count(F.lit(1)).alias("frames"), F.count_if("success").alias("used"), F.avg("value").alias("mean"), F.max("value").alias("largest")).select("video_id", F.col("window.start").alias("start"), "frames", "used", "mean", "largest")


def streaming_pairs(frames: DataFrame, delay: str = "10 seconds", keep_ms: int = 60_000) -> DataFrame:
    """Adjacent pairs of each segment over micro-batches; no pair bridges two segments.

    The last frame of a segment is its state, dropped when the watermark is keep_ms past the segment's latest frame, so what is
    held is bounded by the segments that are open. Frames of one segment come in order from one micro-batch to the next. A null
    success is a failed frame; rows without a frame_index are left out.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values("frame_index")
        last = state.get if state.exists else None
        latest = 0 if last is None else last[3]
        out = []
        for r in rows.itertuples(index=False):
            succeeded = r.success is not None and bool(r.success)
            if last is not None:
                ok = bool(last[2]) and succeeded
                out.append((*key, int(last[0]), ok, abs(r.value - last[1]) if ok else None))
            latest = max(latest, int(r.ts.timestamp() * 1000))
            last = (int(r.frame_index), float(r.value), succeeded, latest)
        state.update(last)
        state.setTimeoutTimestamp(max(latest + keep_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["video_id", "segment_id", "pair_index", "ok", "change"])

    timed = frames.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    narrow = timed.select("video_id", "segment_id", "frame_index", "ts", "value", "success").filter("frame_index is not null and ts is not null")
    found = "video_id long, segment_id long, pair_index long, ok boolean, change double"
    held = "frame_index long, value double, success boolean, latest long"
    return narrow.groupBy("video_id", "segment_id").applyInPandasWithState(step, found, held, "append", GroupStateTimeout.EventTimeTimeout)
