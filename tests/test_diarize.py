import numpy as np
import pytest

from colloquy.operators import clustering, diarize, dsp

from .conftest import rows

RATE = 400


def voices(n, seed=4):
    """Stretches of two tones with pauses: (samples, spans of sound in samples, tone of each)."""
    draw, parts, spans, tones, at = np.random.default_rng(seed), [], [], [], 0
    for i in range(n):
        size, pause, tone = int(draw.integers(30, 500)), int(draw.integers(120, 300)), int(draw.integers(2))
        t = np.arange(size)
        parts += [np.sin(t / (1.6, 7.0)[tone]) + 0.05 * draw.standard_normal(size), 1e-3 * draw.standard_normal(pause)]
        spans.append((at, at + size))
        tones.append(tone)
        at += size + pause
    return np.concatenate(parts), spans, tones


def stored(spark, recordings, cuts):
    data = []
    for r, x in recordings.items():
        edges = [0, *[c for c in cuts if c < len(x)], len(x)]
        data += [(r, a, x[a:b].tolist()) for a, b in zip(edges, edges[1:])]
    return spark.createDataFrame(data, "recording_id string, start long, signal array<double>").repartition(3)


def test_energies_do_not_see_where_frames_end(spark):
    x, _, _ = voices(6)
    whole = rows(diarize.energies(stored(spark, {"a": x}, []), RATE))
    want = [("a", h, float(np.sqrt(np.mean(x[h * 4 : h * 4 + 12] ** 2)))) for h in range((len(x) - 12) // 4 + 1)]
    for got in (whole, rows(diarize.energies(stored(spark, {"a": x}, range(37, 9999, 101)), RATE))):
        assert [g[:2] for g in got] == [w[:2] for w in sorted(want, key=repr)] and np.allclose([g[2] for g in got], [w[2] for w in sorted(want, key=repr)])


@pytest.mark.parametrize("frame_s", [0.1, 0.5, 30.0])
def test_cut_sound_equals_slices(spark, frame_s):
    draw = np.random.default_rng(1)
    sounds = {r: draw.standard_normal(n) for r, n in {"a": 1500, "b": 40, "c": 900}.items()}
    segs = [(r, i, float(a), float(a + w)) for r in (*sounds, "gone") for i, (a, w) in enumerate(zip(draw.random(30) * 4, draw.random(30) * 2))] + [("a", 99, 1.0, 1.0)]
    found = diarize.cut_sound(stored(spark, sounds, [7, 8, 300, 333, 1200]), spark.createDataFrame(segs, "recording_id string, idx long, t0 double, t1 double"), RATE, frame_s)
    got = {(r.recording_id, r.idx): r.signal for r in found.collect()}
    assert got == {(r, i): sounds.get(r, np.zeros(0))[int(a * RATE) : int(b * RATE)].tolist() for r, i, a, b in segs}


def test_model_activity_joins_spans_at_frame_ends(spark):
    def model(signal):
        if signal[0] < 0:
            raise ValueError("bad frame")
        return [(0.25, 1.0)] if signal[0] == 1 else [(0.0, 0.5), (0.6, 0.7)]

    sound = stored(spark, {"a": np.concatenate([np.full(RATE, v) for v in (1.0, 2.0, -1.0, 1.0)])}, [RATE, 2 * RATE, 3 * RATE])
    got = rows(diarize.model_activity(model, RATE)(sound))
    assert got == [("a", 0.25, 1.5), ("a", 1.6, 1.7), ("a", 3.25, 4.0)]


def test_diarize_equals_the_stages_one_by_one(spark):
    recordings = {r: voices(14, r)[0] for r in (1, 2)}
    sound = stored(spark, {str(r): x for r, x in recordings.items()}, range(RATE, 99999, RATE))
    activity = diarize.energy_activity(RATE, quantile=0.2, scale=8.0, min_s=0.05)
    embed = lambda df: dsp.embed(df, frame=80, hop=40, lags=(1, 2, 4, 8)).withColumnRenamed("features", "embedding")
    found = diarize.diarize(sound, activity, embed, RATE, speakers=2)
    segments = found.segments.orderBy("recording_id", "idx").collect()
    assert {s.usable for s in segments} == {True, False} and all(s.usable == (s.n_samples >= RATE // 4) == (s.label >= 0) for s in segments)
    turns = []
    for r in recordings:
        own = [s for s in segments if s.recording_id == str(r)]
        good = [s for s in own if s.usable]
        assert clustering.cluster(np.array([s.embedding for s in good]), 2).tolist() == [s.label for s in good]
        _, spans, tones = voices(14, r)
        heard = [max((min(b, s.t1 * RATE) - max(a, s.t0 * RATE), tone) for (a, b), tone in zip(spans, tones))[1] for s in good]
        assert heard in ([s.label for s in good], [1 - s.label for s in good])  # each tone is one speaker
        last = None
        for s in good:
            if last and last[1] == s.label and s.t0 - last[3] <= 0.8 and s.t1 - last[2] <= 28:
                last[3:] = [s.t1, last[4] + 1]
            else:
                turns.append(last := [str(r), s.label, s.t0, s.t1, 1])
    assert rows(found.turns, "recording_id", "label", "t0", "t1", "n_segs") == sorted(map(tuple, turns), key=repr)


def test_no_sound(spark):
    none = spark.createDataFrame([], "recording_id string, start long, signal array<double>")
    found = diarize.diarize(none, rate=RATE)
    assert found.segments.count() == found.turns.count() == 0
