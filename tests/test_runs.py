import random

from pyspark.sql import functions as F

from colloquy.operators import runs

from .conftest import rows


def random_rows(draw, n):
    t, out = 0.0, []
    for i in range(n):
        t += draw.choice([0.0, 0.5, 1.0, 1.25, 3.0, -0.25])
        end = t + draw.choice([0.5, 1.0, 2.0, 9.0])
        out.append((i, t, end, draw.choice("AAB"), f"t{i}"))
        t = end
    return out


def test_merge_runs_equals_a_sequential_fold(spark):
    draw, data, want = random.Random(1), [], []
    for m in range(60):
        merged = []
        for i, t0, t1, who, text in random_rows(draw, draw.randrange(1, 25)):
            data.append((m, i, t0, t1, who, text))
            if merged and merged[-1][1] == who and t0 - merged[-1][3] <= 1.2:
                merged[-1][3], merged[-1][4] = t1, merged[-1][4] + " " + text
            else:
                merged.append([m, who, t0, t1, text])
        want += map(tuple, merged)
    df = spark.createDataFrame(data, "meeting_id long, seq long, t0 double, t1 double, speaker string, text string")
    assert rows(runs.merge_runs(df), "meeting_id", "speaker", "t0", "t1", "text") == sorted(want, key=repr)


def test_capped_turns_equal_a_sequential_fold(spark):
    draw, data, want = random.Random(2), [], []
    for m in range(60):
        turns = []
        for i, t0, t1, _, _ in random_rows(draw, draw.randrange(1, 30)):
            label = draw.choice([-1, 0, 0, 1])
            data.append((m, i, t0, t1, label))
            if label < 0:
                continue
            if turns and turns[-1][1] == label and t0 - turns[-1][3] <= 0.8 and t1 - turns[-1][2] <= 8.0:
                turns[-1][3] = t1
                turns[-1][4] += 1
            else:
                turns.append([m, label, t0, t1, 1])
        want += map(tuple, turns)
    df = spark.createDataFrame(data, "recording_id long, idx long, t0 double, t1 double, label int")
    assert rows(runs.merge_turns(df, 0.8, 8.0), "recording_id", "label", "t0", "t1", "n_segs") == sorted(want, key=repr)


def test_chunks_equal_a_sequential_fold(spark):
    draw, data, want = random.Random(3), [], []
    for m in range(40):
        buffer, size, chunks = [], 0, []
        for i in range(draw.randrange(1, 30)):
            line = "x" * draw.choice([1, 10, 40, 200])
            data.append((m, i, line))
            if size + len(line) > 100 and buffer:
                chunks.append("\n".join(buffer))
                buffer, size = [], 0
            buffer.append(line)
            size += len(line) + 1
        chunks.append("\n".join(buffer))
        want += [(m, i, c) for i, c in enumerate(chunks)]
    df = spark.createDataFrame(data, "meeting_id long, seq long, line string")
    assert rows(runs.chunk(df, 100), "meeting_id", "chunk", "text") == sorted(want, key=repr)


def test_relabel(spark):
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate([5, -1, 2, 5, 0, 2])], "recording_id long, idx long, label int")
    assert [r.label for r in runs.relabel_first_seen(df).orderBy("idx").collect()] == [0, -1, 1, 0, 2, 1]


def test_chapters_of_fifteen_rows(spark):
    df = spark.createDataFrame([(1, i, float(i), "z" * 90) for i in range(15)], "meeting_id long, seq long, t0 double, text string")
    got = runs.chapters(df).collect()
    assert len(got) == 15 and {len(r.titre) for r in got} == {60}


def test_durations(spark):
    utts = spark.createDataFrame([(1, 0, 9.0), (1, 1, 5.0)], "meeting_id long, seq long, t1 double")
    meta = spark.createDataFrame([(1, "1:00:00"), (2, "0:01:00"), (3, None)], "meeting_id long, duree string")
    assert rows(runs.durations(utts, meta)) == [(1, 5.0), (2, 60.0), (3, 0.0)]


def test_cleaned_rows_are_dropped_before_runs(spark):
    data = [(1, 0, 0.0, 1.0, "A", "bonjour"), (1, 1, 1.1, 1.2, "B", "merci."), (1, 2, 2.0, 4.0, "A", "à tous")]
    df = spark.createDataFrame(data, "meeting_id long, seq long, t0 double, t1 double, speaker string, text string")
    assert rows(runs.clean_and_merge(df), "t1", "text") == [(4.0, "bonjour à tous")]
    assert runs.clean_and_merge(df.where(F.lit(False))).count() == 0


def test_one_meeting_of_a_million_lines(spark):
    import time

    start = time.time()
    lines = spark.range(1_000_000).select(F.lit("m").alias("meeting_id"), F.col("id").alias("seq"), F.repeat(F.lit("x"), (F.col("id") % 7 + 1).cast("int")).alias("line"))
    found = runs.chunk(lines, 100).select("chunk", "n_lines", F.char_length("text").alias("n"))
    got = found.agg(F.sum("n_lines").alias("lines"), F.max("n").alias("most"), F.count(F.lit(1)).alias("chunks"), F.max("chunk").alias("last")).first()
    assert (got.lines, got.chunks) == (1_000_000, got.last + 1) and 93 <= got.most <= 100
    segs = lines.select(F.lit("r").alias("recording_id"), F.col("seq").alias("idx"), (F.col("seq") * 10).alias("t0"), (F.col("seq") * 10 + 9).alias("t1"), (F.floor(F.col("seq") / 100000) % 2).alias("label"))
    turns = runs.merge_turns(segs, 1, 995)
    assert turns.count() == 10_110 and turns.agg(F.sum("n_segs"), F.max(F.col("t1") - F.col("t0"))).first()[:] == (1_000_000, 989)
    assert time.time() - start < 240
