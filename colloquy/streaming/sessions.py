"""Streams: sessions by gap, tumbling frames, and exact runs and capped turns with kept state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WATERMARK, GAP, FRAME = "1 hour", "12 hours", "30 seconds"


def sessions(events: DataFrame, gap: str = GAP, watermark: str | None = WATERMARK, key: str = "user_id", ts: str = "ts") -> DataFrame:
    """Events of a key no more than ``gap`` apart (equality joins); batch or stream alike."""
    timed = events.withColumn(ts, F.col(ts).cast("timestamp"))
    timed = timed.withWatermark(ts, watermark) if watermark and events.isStreaming else timed
    found = timed.groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return found.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total")


def frames(events: DataFrame, size: str = FRAME, watermark: str | None = WATERMARK, key: str = "user_id", ts: str = "ts") -> DataFrame:
    """Counts in tumbling frames."""
    timed = events.withColumn(ts, F.col(ts).cast("timestamp"))
    timed = timed.withWatermark(ts, watermark) if watermark and events.isStreaming else timed
    return timed.groupBy(key, F.window(ts, size).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("start"), "n")


def capped_turns(segments: DataFrame, gap: float, cap: float, timeout_ms: int | None = None) -> DataFrame:
    """Turns of a stream of (recording_id, t0, t1, label) that arrives in order of time within a
    recording: a turn is emitted when the next one begins or, with ``timeout_ms``, when its recording
    has been silent for so long. The state of a recording is its open turn."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key, frames_, state: GroupState):
        import pandas as pd

        done = []
        now = state.get if state.exists else None
        if state.hasTimedOut:
            done.append(now)
            state.remove()
        else:
            for frame in frames_:
                for t0, t1, label in frame.sort_values("t0")[["t0", "t1", "label"]].itertuples(index=False):
                    if label < 0:
                        continue
                    if now and now[2] == label and t0 - now[1] <= gap and t1 - now[0] <= cap:
                        now = (now[0], float(t1), now[2], now[3] + 1)
                    else:
                        if now:
                            done.append(now)
                        now = (float(t0), float(t1), int(label), 1)
            if now:
                state.update(now)
                if timeout_ms:
                    state.setTimeoutDuration(timeout_ms)
        yield pd.DataFrame([(key[0], *d) for d in done], columns=["recording_id", "t0", "t1", "label", "n_segs"])

    kind = dict(segments.dtypes)["recording_id"]
    return segments.groupBy("recording_id").applyInPandasWithState(step, f"recording_id {kind}, t0 double, t1 double, label int, n_segs long", "t0 double, t1 double, label int, n_segs long", "append", GroupStateTimeout.ProcessingTimeTimeout if timeout_ms else GroupStateTimeout.NoTimeout)


def run_once(stream: DataFrame, name: str, checkpoint: str) -> DataFrame:
    """Drive a stream over what is there now into a table in memory, for tests and small results."""
    query = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
