import io
import json
import os
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.operators import dsp, stages
from colloquy.sources import readers, sinks
from colloquy.streaming import sessions

from .conftest import rows


def test_frames_and_features(spark):
    x = np.sin(np.arange(700) / 7.0)
    df = spark.createDataFrame([(1, x.tolist()), (2, [0.5] * 10)], "id long, signal array<double>")
    got = {r.id: r.features for r in dsp.embed(df).collect()}
    frames = [x[s : s + 400] for s in range(0, 301, 160)]
    tracks = [[np.sqrt(np.mean(f * f)) for f in frames], [np.mean((f[1:] >= 0) != (f[:-1] >= 0)) for f in frames]] + [[f[:-k] @ f[k:] / (f @ f + 1e-9) for f in frames] for k in dsp.LAGS]
    want = np.array([np.mean(t) for t in tracks] + [np.std(t) for t in tracks])
    assert np.allclose(got[1], want / (np.linalg.norm(want) + 1e-9)) and got[2] is None


def brute_voiced(energies, hop=0.01, frame=0.03, least=0.3, gap=0.2, q=0.5, scale=1.4):
    limit = sorted(energies)[min(len(energies) - 1, int(len(energies) * q))] * scale
    out, start, last = [], None, None
    for i, e in enumerate(energies):
        if e >= limit:
            if start is not None and i - last > int(gap / hop) + 1:
                out.append((start, last))
                start = None
            start = i if start is None else start
            last = i
    if start is not None:
        out.append((start, last))
    return [(round(a * hop, 6), round(b * hop + frame, 6)) for a, b in out if b * hop + frame - a * hop >= least]


def test_voiced_segments_equal_a_sequential_scan(spark):
    draw = np.random.default_rng(3)
    data, want = [], []
    for r in range(20):
        e = np.where(draw.random(300) < 0.5, 1.0, draw.random(300) * 3 + np.repeat(draw.random(10) < 0.4, 30) * 5)
        data += [(r, i, float(v)) for i, v in enumerate(e)]
        want += [(r, *s) for s in brute_voiced(e.tolist())]
    df = spark.createDataFrame(data, "recording_id long, frame long, energy double")
    got = dsp.voiced_segments(df).select("recording_id", F.round("t0", 6).alias("a"), F.round("t1", 6).alias("b"))
    assert rows(got) == sorted(want, key=repr)


def wav(rate=16000, channels=1, n=1600):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((np.arange(n * channels) % 100 * 100).astype("<i2").tobytes())
    return out.getvalue()


def test_wav(spark, tmp_path):
    for name, data in {"a.wav": wav(), "b.wav": wav(channels=2), "c.wav": wav(rate=8000), "d.wav": b"no sound"}.items():
        (tmp_path / name).write_bytes(data)
    files = readers.sound(spark, str(tmp_path))
    named = files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("n"), readers.is_16k_mono(F.col("content")).alias("ok"))
    assert rows(named) == [("a.wav", True), ("b.wav", False), ("c.wav", False), ("d.wav", False)]
    got = {os.path.basename(r.path): r for r in readers.decode_wav(files).collect()}
    assert len(got["a.wav"].signal) == 1600 == len(got["b.wav"].signal) and abs(got["b.wav"].signal[0] - 50 / 32768) < 1e-7
    assert "8000 Hz" in got["c.wav"].error and got["d.wav"].signal is None


def test_model_stages_isolate_failures(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [])], "id long, signal array<double>")
    got = {r.id: r.embedding for r in stages.call_vector(df, "signal", lambda x: x / x.max()).collect()}
    assert got == {1: [0.5, 1.0], 2: None}
    said = stages.transcribe(df, lambda x: "hello " if len(x) else 1 / 0)
    assert rows(said, "id", "text") == [(1, "hello")]


def test_readers(spark, tmp_path):
    meeting = tmp_path / "m1"
    meeting.mkdir()
    (meeting / "transcript.json").write_text(json.dumps([{"t0": 0, "t1": 2.5, "speaker": "S0", "text": "é"}, {"t0": 3, "t1": 4, "speaker": "S1", "text": "b"}], indent=1))
    (meeting / "synthese.json").write_text(json.dumps({"resume": "x"}, indent=1))
    (meeting / "mapping.json").write_text(json.dumps({"mapping": {"S0": "Alice"}}, indent=1))
    (meeting / "report.md").write_text("# x\n\ny\n")
    assert rows(readers.transcripts(spark, str(tmp_path))) == [("m1", 0, 0.0, 2.5, "S0", "é"), ("m1", 1, 3.0, 4.0, "S1", "b")]
    assert readers.reports(spark, str(tmp_path)).first().report.resume == ["x"]
    assert rows(readers.speaker_mapping(spark, str(tmp_path))) == [("m1", "S0", "Alice")]
    assert readers.rendered_text(spark, str(tmp_path)).first().content == "# x\n\ny\n"
    with pytest.raises(FileNotFoundError):
        readers.reports(spark, str(tmp_path / "nowhere"))
    spark.range(3).write.parquet(str(tmp_path / "segs"))
    with pytest.raises(ValueError):
        readers.segments(spark, str(tmp_path / "segs"))
    assert rows(spark.createDataFrame([('{"a":1}',), ("{",), (None,)], "t string").select(readers.valid_json(F.col("t")))) == [(False,), (False,), (True,)]


def test_sinks(spark, tmp_path):
    out = sinks.write_documents(spark.createDataFrame([("a/b.md", "x"), ("../c.md", "y")], "path string, content string"), str(tmp_path / "root"))
    assert rows(out, "path", "ok") == [("../c.md", False), ("a/b.md", True)]
    assert (tmp_path / "root/a/b.md").read_text() == "x"
    snaps = sinks.Snapshots(spark, str(tmp_path / "store"))
    assert snaps.latest() == 0 and [snaps.write(spark.range(n)) for n in (2, 3)] == [1, 2]
    assert snaps.read().count() == 3 and snaps.read(1).count() == 2
    df = spark.createDataFrame([(1, 1, "b"), (1, 0, "a")], "m long, seq long, text string")
    assert sinks.to_json_rows(df, "m", "seq").first().content == '[{"text":"a"},{"text":"b"}]'


@pytest.fixture
def events(spark, tmp_path):
    data = [("u", f"2024-01-01 00:00:{s:02d}", float(s)) for s in (0, 2, 4, 9)] + [("v", "2024-01-01 00:00:01", 1.0), ("u", "2024-01-02 00:00:00", 1.0)]
    df = spark.createDataFrame(data, "user_id string, at string, value double").select("user_id", F.col("at").cast("timestamp").alias("ts"), "value")
    df.write.parquet(str(tmp_path / "events"))
    return df.schema, str(tmp_path / "events"), str(tmp_path / "state")


def test_stream_sessions_equal_batch(spark, events):
    schema, path, state = events
    stream = sessions.sessions(spark.readStream.schema(schema).parquet(path), "2 seconds", "1 minute")
    got = rows(sessions.run_once(stream, "sessions_seen", state), "user_id", "n")
    batch = rows(sessions.sessions(spark.read.parquet(path), "2 seconds", None), "user_id", "n")
    assert batch == [("u", 1), ("u", 1), ("u", 3), ("v", 1)]
    assert got == [("u", 1), ("u", 3), ("v", 1)]  # the last session is still open


def test_stream_turns(spark, tmp_path):
    data = [("r", 0.0, 1.0, 0), ("r", 1.5, 3.0, 0), ("r", 3.1, 4.0, 1), ("r", 4.1, 5.0, -1), ("r", 9.0, 10.0, 1), ("r", 20.0, 21.0, 0)]
    spark.createDataFrame(data, "recording_id string, t0 double, t1 double, label int").coalesce(1).write.parquet(str(tmp_path / "segs"))
    stream = spark.readStream.schema("recording_id string, t0 double, t1 double, label int").parquet(str(tmp_path / "segs"))
    got = rows(sessions.run_once(sessions.capped_turns(stream, 0.8, 28.0), "turns_seen", str(tmp_path / "state")))
    assert got == [("r", 0.0, 3.0, 0, 2), ("r", 3.1, 4.0, 1, 1), ("r", 9.0, 10.0, 1, 1)]
