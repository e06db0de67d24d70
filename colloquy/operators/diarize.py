"""Who spoke when: voice activity, the sound of each segment, embedding, clustering and turns in one plan.

Sound is a table of frames (recording_id, start, signal): consecutive stretches of samples, ``start`` being
the number of the first. Each stage can be replaced by another function of the same form.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.operators import clustering, dsp, runs
from colloquy.sources.shared import written

FRAME_S, MIN_EMBED_S = 30.0, 0.25


def energies(sound: DataFrame, rate: int = dsp.SAMPLE_RATE, frame_s: float = dsp.FRAME_S, hop_s: float = dsp.HOP_S) -> DataFrame:
    """(recording_id, frame, energy) of short overlapping windows, those across the ends of stored frames
    too. All stored frames but a recording's last hold a window at least; a rest at the end is dropped."""
    size, hop = round(frame_s * rate), round(hop_s * rate)
    after = F.lead("signal").over(Window.partitionBy("recording_id").orderBy("start"))
    longer = F.concat("signal", F.slice(F.coalesce(after, F.array().cast(dict(sound.dtypes)["signal"])), 1, size - 1))
    rows = sound.select("recording_id", "start", F.size("signal").alias("_n"), longer.alias("_x"))
    first, last = F.ceil(F.col("start") / hop), F.floor((F.col("start") + F.least(F.col("_n") - 1, F.size("_x") - size)) / hop)
    rows = rows.withColumn("frame", F.explode(F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))))
    return rows.select("recording_id", "frame", dsp.rms(F.slice("_x", (F.col("frame") * hop - F.col("start") + 1).cast("int"), size)).alias("energy"))


def energy_activity(rate: int = dsp.SAMPLE_RATE, frame_s: float = dsp.FRAME_S, hop_s: float = dsp.HOP_S, **options) -> Callable[[DataFrame], DataFrame]:
    """A voice activity stage: frames -> (recording_id, t0, t1), by energy."""
    return lambda sound: dsp.voiced_segments(energies(sound, rate, frame_s, hop_s), frame_s=frame_s, hop_s=hop_s, **options)


def model_activity(model: Callable, rate: int = dsp.SAMPLE_RATE) -> Callable[[DataFrame], DataFrame]:
    """A voice activity stage by a model: signal -> [(start, end) in seconds]. It sees one stored frame at a
    time; spans that meet at the end of a frame are one. A frame on which it fails has no spans."""

    def stage(sound: DataFrame) -> DataFrame:
        def run(batches):
            import numpy as np
            import pyarrow as pa

            for batch in batches:
                found = []
                for signal in batch.column("signal").to_pylist():
                    try:
                        found.append([{"a": float(a), "b": float(b)} for a, b in model(np.asarray(signal, np.float32))])
                    except Exception:  # one bad frame does not end the recording
                        found.append([])
                yield pa.RecordBatch.from_arrays([batch.column("recording_id"), batch.column("start"), pa.array(found, pa.list_(pa.struct([("a", pa.float64()), ("b", pa.float64())])))], ["recording_id", "start", "spans"])

        kind = dict(sound.dtypes)["recording_id"]
        spans = sound.select("recording_id", F.col("start").cast("long").alias("start"), "signal").mapInArrow(run, f"recording_id {kind}, start long, spans array<struct<a:double,b:double>>")
        timed = spans.select("recording_id", (F.col("start") / rate).alias("at"), F.explode("spans").alias("s"))
        timed = timed.select("recording_id", (F.col("at") + F.col("s.a")).alias("t0"), (F.col("at") + F.col("s.b")).alias("t1"))
        w = Window.partitionBy("recording_id").orderBy("t0", "t1")
        apart = ~F.coalesce(F.col("t0") - F.max("t1").over(w.rowsBetween(Window.unboundedPreceding, -1)) < 1 / rate, F.lit(False))
        joined = timed.withColumn("run", F.sum(apart.cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
        return joined.groupBy("recording_id", "run").agg(F.min("t0").alias("t0"), F.max("t1").alias("t1")).drop("run")

    return stage


def _buckets(first: Column, after: Column, width: int) -> Column:
    return F.when(after > first, F.sequence(F.floor(first / width), F.floor((after - 1) / width))).otherwise(F.array().cast("array<bigint>"))


def cut_sound(sound: DataFrame, segments: DataFrame, rate: int = dsp.SAMPLE_RATE, frame_s: float = FRAME_S) -> DataFrame:
    """``segments`` (recording_id, idx, t0, t1) with ``signal``, their samples; empty where there are none.

    An interval join: frames and segments stand in every bucket of ``frame_s`` that they touch, and meet in
    the first bucket they share. A long recording is as many keys as it has buckets, and only the samples
    of segments are shuffled on."""
    width, kind = round(frame_s * rate), dict(sound.dtypes)["signal"]
    spans = segments.withColumns({"_a": F.floor(F.col("t0") * rate).cast("long"), "_b": F.floor(F.col("t1") * rate).cast("long")})
    asked = spans.select("recording_id", "idx", "_a", "_b", F.floor(F.col("_a") / width).alias("_first"), F.explode(_buckets(F.col("_a"), F.col("_b"), width)).alias("_k"))
    end = F.col("start") + F.size("signal")
    held = sound.select("recording_id", "start", "signal", end.alias("_end"), F.floor(F.col("start") / width).alias("_own"), F.explode(_buckets(F.col("start"), end, width)).alias("_k"))
    met = asked.join(held, ["recording_id", "_k"]).where((F.col("_k") == F.greatest("_first", "_own")) & (F.col("_a") < F.col("_end")) & (F.col("start") < F.col("_b")))
    low, high = F.greatest("_a", "start"), F.least("_b", "_end")
    parts = met.select("recording_id", "idx", F.struct(low.alias("at"), F.slice("signal", (low - F.col("start") + 1).cast("int"), (high - low).cast("int")).alias("x")).alias("part"))
    whole = parts.groupBy("recording_id", "idx").agg(F.flatten(F.transform(F.array_sort(F.collect_list("part")), lambda p: p["x"])).alias("signal"))
    return segments.join(whole, ["recording_id", "idx"], "left").withColumn("signal", F.coalesce("signal", F.array().cast(kind)))


def acoustic_features(rows: DataFrame) -> DataFrame:
    """An embedding stage without a model: rows with ``signal`` -> rows with ``embedding``."""
    return dsp.embed(rows).withColumnRenamed("features", "embedding")


@dataclass
class Diarization:
    """``segments``: recording_id, idx, t0, t1, n_samples, usable, embedding, label. ``turns``: recording_id,
    label, t0, t1, n_segs."""

    segments: DataFrame
    turns: DataFrame


def segments_with_sound(sound: DataFrame, activity: Callable[[DataFrame], DataFrame], rate: int = dsp.SAMPLE_RATE, min_s: float = MIN_EMBED_S) -> DataFrame:
    """(recording_id, idx, t0, t1, n_samples, usable, signal): voiced segments, numbered in order of time.
    Those shorter than ``min_s`` are not usable and have no signal, so no stage embeds them."""
    found = activity(sound)
    numbered = found.select("recording_id", (F.row_number().over(Window.partitionBy("recording_id").orderBy("t0", "t1")) - 1).cast("long").alias("idx"), "t0", "t1")
    cut = cut_sound(sound, written(numbered, "segments"), rate)
    n = F.size("signal")
    usable = n >= int(min_s * rate)
    return cut.select("recording_id", "idx", "t0", "t1", n.cast("long").alias("n_samples"), usable.alias("usable"), F.when(usable, F.col("signal")).otherwise(F.array().cast(dict(sound.dtypes)["signal"])).alias("signal"))


def diarize(sound: DataFrame, activity: Callable[[DataFrame], DataFrame] | None = None, embed: Callable[[DataFrame], DataFrame] = acoustic_features, rate: int = dsp.SAMPLE_RATE, speakers: int | None = None, min_s: float = MIN_EMBED_S, gap: float = runs.TURN_GAP_S, cap: float = runs.TURN_CAP_S) -> Diarization:
    """Segments with the speaker that clustering gives them (-1: not usable), and the turns of these."""
    voiced = segments_with_sound(sound, activity or energy_activity(rate), rate, min_s)
    made = written(embed(voiced).select("recording_id", "idx", "t0", "t1", "n_samples", "usable", F.when(F.col("usable"), F.col("embedding")).alias("embedding")), "embedded")
    labels = clustering.cluster_recordings(made, speakers=speakers)
    labelled = written(made.join(labels, ["recording_id", "idx"]), "labelled")
    return Diarization(labelled, runs.merge_turns(labelled, gap, cap))
