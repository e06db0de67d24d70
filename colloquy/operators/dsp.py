"""Signal features and energy-based voice activity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions import vectors as V

SAMPLE_RATE, FRAME_S, HOP_S, MIN_SEG_S, MAX_GAP_S, QUANTILE, SCALE = 16000, 0.030, 0.010, 0.30, 0.20, 0.5, 1.4
LAGS = (40, 80, 120, 160)


def frames(signal: Column, frame: int, hop: int) -> Column:
    """Whole frames of a signal; what is left at the end is dropped."""
    n = F.size(signal)
    starts = F.when(n >= frame, F.sequence(F.lit(1), n - frame + 1, F.lit(hop))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda s: F.slice(signal, s, frame))


def rms(frame: Column) -> Column:
    return F.when(F.size(frame) > 0, F.sqrt(V.dot(frame, frame) / F.size(frame))).otherwise(F.lit(0.0))


def zero_crossings(frame: Column) -> Column:
    """The share of neighbouring samples whose signs differ (0 counts as positive)."""
    n = F.size(frame)
    changes = F.zip_with(F.slice(frame, 1, n - 1), F.slice(frame, 2, n - 1), lambda a, b: ((a >= 0) != (b >= 0)).cast("double"))
    return F.when(n > 1, F.aggregate(changes, F.lit(0.0), lambda s, x: s + x) / (n - 1)).otherwise(F.lit(0.0))


def autocorrelation(frame: Column, lag: int) -> Column:
    """Correlation with itself ``lag`` samples on, against its energy."""
    n = F.size(frame)
    both = V.dot(F.slice(frame, 1, F.greatest(n - lag, F.lit(0))), F.slice(frame, lag + 1, F.greatest(n - lag, F.lit(0))))
    return F.when(n > lag, both / (V.dot(frame, frame) + 1e-9)).otherwise(F.lit(0.0))


def _at_lag(lag: int):
    return lambda frame: autocorrelation(frame, lag)


def spread(values: Column) -> Column:
    """Population standard deviation of an array."""
    n = F.size(values)
    mean = F.aggregate(values, F.lit(0.0), lambda s, x: s + x) / n
    return V.let(mean, lambda m: F.sqrt(F.aggregate(values, F.lit(0.0), lambda s, x: s + (x - m) * (x - m)) / n))


def embed(rows: DataFrame, signal: str = "signal", frame: int = 400, hop: int = 160, lags: tuple[int, ...] = LAGS) -> DataFrame:
    """``rows`` with ``features``: mean and spread over frames of energy, zero crossings and
    autocorrelation at each lag, at unit length; null for a signal shorter than a frame."""
    staged = rows.withColumn("_frames", frames(F.col(signal), frame, hop))
    tracks = [F.transform("_frames", rms), F.transform("_frames", zero_crossings), *(F.transform("_frames", _at_lag(k)) for k in lags)]
    staged = staged.withColumn("_tracks", F.array(*tracks))
    means = F.transform("_tracks", lambda t: F.aggregate(t, F.lit(0.0), lambda s, x: s + x) / F.size(t))
    spreads = F.transform("_tracks", spread)
    vector = F.when(F.size("_frames") > 0, V.l2(F.concat(means, spreads)))
    return staged.withColumn("features", vector).drop("_frames", "_tracks")


def voiced_segments(energies: DataFrame, by: str = "recording_id", frame: str = "frame", energy: str = "energy", hop_s: float = HOP_S, frame_s: float = FRAME_S, min_s: float = MIN_SEG_S, max_gap_s: float = MAX_GAP_S, quantile: float = QUANTILE, scale: float = SCALE) -> DataFrame:
    """(by, t0, t1) of voiced stretches. A frame is voiced from ``scale`` times the quantile of its
    recording's energies on (the sorted value at floor(n q), no interpolation), found by rank;
    stretches bridge gaps up to ``max_gap_s`` and last ``min_s`` at least."""
    n = F.count(F.lit(1)).over(Window.partitionBy(by))
    rank = F.row_number().over(Window.partitionBy(by).orderBy(energy)) - 1
    at = F.least(n - 1, F.floor(n * quantile))
    limits = energies.withColumns({"_r": rank, "_at": at}).where(F.col("_r") == F.col("_at")).select(by, (F.col(energy) * scale).alias("_limit"))
    voiced = energies.join(limits, by).where(F.col(energy) >= F.col("_limit"))
    w = Window.partitionBy(by).orderBy(frame)
    gap_frames = int(max_gap_s / hop_s)
    fresh = ~F.coalesce(F.col(frame) - F.lag(frame).over(w) <= gap_frames + 1, F.lit(False))
    runs = voiced.withColumn("_run", F.sum(fresh.cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    found = runs.groupBy(by, "_run").agg(F.min(frame).alias("a"), F.max(frame).alias("b"))
    timed = found.select(by, (F.col("a") * hop_s).alias("t0"), (F.col("b") * hop_s + frame_s).alias("t1"))
    return timed.where(F.col("t1") - F.col("t0") >= min_s)
