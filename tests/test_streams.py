import os
import random
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.operators import runs
from colloquy.sources import readers, sound_stream
from colloquy.streaming import turns

from .conftest import rows

SEG = "recording_id string, t0 long, t1 long, label int, ord long"
S = 1_000_000


def stream(spark, folder, per_batch):
    return spark.readStream.schema(SEG).option("maxFilesPerTrigger", per_batch).parquet(folder)


def brute(segments, gap, cap, now):
    """Turns of segments that begin before ``now`` (ms), closed by then."""
    out = []
    for r in sorted({s[0] for s in segments}):
        turn = None
        for _, t0, t1, label, _ in sorted((s for s in segments if s[0] == r and s[3] >= 0 and s[1] // 1000 < now), key=lambda s: (s[1], s[4])):
            if turn and turn[3] == label and t0 - turn[2] <= gap and t1 - turn[1] <= cap:
                turn = (r, turn[1], t1, label, turn[4] + 1)
            else:
                out += [turn] if turn else []
                turn = (r, t0, t1, label, 1)
        if turn and turn[2] + gap < now * 1000:
            out.append(turn)
    return out


def test_turns_of_segments_out_of_order(spark, tmp_path):
    """Segments up to 20 s late, over six files and two runs of the stream; the second picks up where the first ended."""
    draw, data, at = random.Random(2), [], {"a": 1000 * S, "b": 1000 * S, "c": 1000 * S}
    for i in range(400):
        r = draw.choice("aab")
        start = at[r] + draw.choice([0, 1, 200_000, 900_000, 5 * S])
        at[r] = start + draw.randrange(1, 4 * S)
        data.append((r, start, at[r], draw.choice([0, 0, 0, 1, -1]), i))
    arrival = sorted(data, key=lambda s: s[1] + draw.randrange(20 * S))
    folder, state, out = (str(tmp_path / x) for x in ("in", "state", "out"))
    size = -(-len(arrival) // 6)

    def arrive(parts):
        for k in parts:
            spark.createDataFrame(arrival[k * size : (k + 1) * size], SEG).coalesce(1).write.mode("append").parquet(folder)

    def run():
        return rows(turns.run_to_table(turns.ordered_turns(stream(spark, folder, 1), 800_000, 28 * S, "60 seconds"), "turns", state, out))

    arrive(range(4))
    first = run()
    arrive(range(4, 6))
    got = run()
    now = max(s[1] for s in data) // 1000 - 60_000
    want = sorted(brute(data, 800_000, 28 * S, now), key=repr)
    assert got == want and len(want) > 20 and set(first) < set(got)
    # closed turns are those that the whole table has
    batch = spark.createDataFrame(data, SEG).withColumn("idx", F.struct("t0", "ord"))
    assert set(got) <= set(rows(runs.merge_turns(batch, 800_000, 28 * S), "recording_id", "t0", "t1", "label", "n_segs"))


def test_late_and_unlabelled_segments_are_dropped(spark, tmp_path):
    folder = str(tmp_path / "in")
    for part in ([("a", 100 * S, 101 * S, 0, 1), ("a", 200 * S, 201 * S, 0, 2)], [("a", 50 * S, 51 * S, 0, 3), ("a", 300 * S, 301 * S, -1, 4)], [("b", 400 * S, 401 * S, 1, 5)]):
        spark.createDataFrame(part, SEG).coalesce(1).write.mode("append").parquet(folder)
    got = rows(turns.run_to_table(turns.ordered_turns(stream(spark, folder, 1), S, 28 * S, "10 seconds"), "late"))
    assert ("a", 100 * S, 101 * S, 0, 1) in got and ("a", 200 * S, 201 * S, 0, 1) in got and len(got) == 2


@pytest.fixture
def sounds(tmp_path):
    def store(name, n, seed, channels=1, rate=16000):
        x = (np.random.default_rng(seed).standard_normal((n, channels)) * 3000).astype("<i2")
        aside = tmp_path / f"{name}.part"
        with wave.open(str(aside), "wb") as w:
            w.setnchannels(channels)
            w.setsampwidth(2)
            w.setframerate(rate)
            w.writeframes(x.tobytes())
        (tmp_path / "wav").mkdir(exist_ok=True)
        os.rename(aside, tmp_path / "wav" / f"{name}.wav")
        os.utime(tmp_path / "wav" / f"{name}.wav", (seed, seed))

    store("b", 16000 * 3 + 5, 1)
    store("a", 16000 * 2, 2, channels=2)
    return store, str(tmp_path / "wav")


def test_streamed_frames_equal_batch_frames(spark, sounds, tmp_path):
    store, folder = sounds
    spark.dataSource.register(sound_stream.SoundFrames)
    options = {"path": folder, "seconds": "1", "limit": "2", "progress": str(tmp_path / "progress")}
    seen, state, out = [], str(tmp_path / "state"), str(tmp_path / "out")

    def keep(df, n):
        found = df.select("path", "start", "t0", "signal").collect()
        seen.append((n, len(found)))
        if fail[0] and n == fail[0]:
            fail[0] = None
            raise RuntimeError("lost")
        df.write.mode("overwrite").parquet(f"{out}/{n}")

    def run(total):
        import time

        query = spark.readStream.format("sound_frames").options(**options).load().writeStream.foreachBatch(keep).option("checkpointLocation", state).trigger(processingTime="0 seconds").start()
        end = time.time() + 60
        try:
            while query.isActive and time.time() < end and sum(n for n in dict(seen).values()) < total:
                time.sleep(0.2)
            query.processAllAvailable()
        finally:
            query.stop()

    fail = [1]
    with pytest.raises(Exception, match="lost"):
        run(6)
    run(6)  # the batch that failed is read again, as it was
    store("c", 16000 * 4, 3)
    run(10)
    spark.range(1).count()
    assert max(n for _, n in seen) <= 2 and len([n for b, n in seen if b == 1]) == 2 and len({n for b, n in seen if b == 1}) == 1
    got = sorted((os.path.basename(r.path), r.start, tuple(r.signal)) for r in spark.read.parquet(*(f"{out}/{n}" for n in dict(seen))).collect())
    want = []
    for r in readers.decode_wav(readers.sound(spark, folder)).collect():
        want += [(os.path.basename(r.path), a, tuple(r.signal[a : a + 16000])) for a in range(0, len(r.signal), 16000)]
    assert got == sorted(want) and len(got) == 10
    batch = spark.read.format("sound_frames").options(path=folder, seconds="1").load()
    assert sorted((os.path.basename(r.path), r.start, tuple(r.signal)) for r in batch.collect()) == got


def test_sound_of_another_rate_is_an_error(spark, sounds):
    store, folder = sounds
    store("d", 800, 4, rate=8000)
    spark.dataSource.register(sound_stream.SoundFrames)
    with pytest.raises(Exception, match="8000 Hz"):
        spark.read.format("sound_frames").options(path=folder).load().collect()
