"""Capped turns of a stream whose segments arrive in any order, exact up to a watermark.

A segment waits in the state of its recording until the watermark has passed its beginning; from then on
no earlier one can come, and it is taken in order of time. A turn is emitted when the next segment does
not continue it, or when the watermark has passed its end by more than the gap, so that none can. Segments
behind the watermark are late and dropped. A recording that has nothing waiting and no open turn has no
state. Times are microseconds; the watermark counts milliseconds.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from colloquy.sources.shared import new_folder

WATERMARK = "1 hour"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Turns(StatefulProcessor):
    def __init__(self, gap: int, cap: int):
        self.gap, self.cap = gap, cap

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "t0 long, ord long, t1 long, label int")
        self.open = handle.getValueState("open", "t0 long, t1 long, label int, n_segs long")
        self.due = handle.getValueState("due", "ms long")

    def _wake(self, ms: int) -> None:
        """One timer a recording: the earliest that is asked for."""
        set_for = self.due.get()[0] if self.due.exists() else None
        if set_for is None or ms < set_for:
            if set_for is not None:
                self.handle.deleteTimer(set_for)
            self.handle.registerTimer(ms)
            self.due.update((ms,))

    def handleInputRows(self, key, rows, timerValues):
        # the engine's own filter is a batch behind
        late = timerValues.getCurrentWatermarkInMs()
        new = [(r.t0, r.ord, r.t1, r.label) for r in rows if r.label is not None and r.label >= 0 and r.t0 // 1000 >= late]
        if new:
            self.waiting.appendList(new)
            self._wake(min(n[0] for n in new) // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = timerValues.getCurrentWatermarkInMs()
        self.due.clear()
        waiting = sorted(map(tuple, self.waiting.get()))
        n = sum(w[0] // 1000 < now for w in waiting)
        turn, done = tuple(self.open.get()) if self.open.exists() else None, []
        for t0, _, t1, label in waiting[:n]:
            if turn and turn[2] == label and t0 - turn[1] <= self.gap and t1 - turn[0] <= self.cap:
                turn = (turn[0], t1, label, turn[3] + 1)
            else:
                done += [turn] if turn else []
                turn = (t0, t1, label, 1)
        if turn and turn[1] + self.gap < now * 1000:
            done.append(turn)
            turn = None
        if waiting[n:]:
            self.waiting.put(waiting[n:])
            self._wake(waiting[n][0] // 1000 + 1)
        else:
            self.waiting.clear()
        if turn:
            self.open.update(turn)
            self._wake((turn[1] + self.gap) // 1000 + 1)
        else:
            self.open.clear()
        for t0, t1, label, count in done:
            yield Row(recording_id=key[0], t0=t0, t1=t1, label=label, n_segs=count)

    def close(self) -> None:
        pass


def ordered_turns(segments: DataFrame, gap: int, cap: int, watermark: str = WATERMARK) -> DataFrame:
    """(recording_id, t0, t1, label, n_segs) of closed turns, from a stream of (recording_id, ts, t0, t1, label,
    ord): ``ts`` is the time that ``t0`` stands for, ``ord`` tells segments of one beginning apart."""
    kind = dict(segments.dtypes)["recording_id"]
    timed = segments.withColumn("ts", F.timestamp_millis(F.floor(F.col("t0") / 1000))).withWatermark("ts", watermark)
    rows = timed.select("recording_id", "ts", F.col("t0").cast("long").alias("t0"), F.col("ord").cast("long").alias("ord"), F.col("t1").cast("long").alias("t1"), F.col("label").cast("int").alias("label"))
    return rows.groupBy("recording_id").transformWithState(_Turns(gap, cap), f"recording_id {kind}, t0 long, t1 long, label int, n_segs long", "append", "EventTime")


@contextmanager
def kept_state(spark: SparkSession):
    """State of this kind lives in RocksDB; the session's own setting is put back."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)


def run_to_table(stream: DataFrame, label: str, checkpoint: str | None = None, out: str | None = None) -> DataFrame:
    """Drive a stream over what is there now into files; what earlier runs of the same folders wrote is there too."""
    spark = stream.sparkSession
    checkpoint, out = checkpoint or new_folder(spark, f"{label}-state"), out or new_folder(spark, label)
    with kept_state(spark):
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
