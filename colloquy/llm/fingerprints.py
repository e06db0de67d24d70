"""Document fingerprints: bottom-k sketches of word-shingle hashes.

A sketch is the ``k`` least distinct 44-bit hashes of a text's runs of five words (fewer where the
text has fewer), in order. Sketches of parts merge by taking the ``k`` least of their union, so the
sketch of a text is that of its parts' shingles wherever they were made. Two sketches estimate
resemblance, containment and the number of distinct shingles; a sketch that is not full holds the
whole set, and estimates from such sketches are exact.

Words are runs without ASCII white space, lower-cased (A-Z). A text of fewer than five words has one
shingle of all its words. Equal texts have equal sketches.

Edge cases: a null text is empty; a text without words has an empty sketch, like any other such text
(likeness 1) and unlike all others (likeness 0); rows of one id are ordered by text; a null id is
ordered last; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.llm._common import U64, chunks, partitions, shingles, words

K, WIDTH, BITS = 256, 5, 44
#: Documents whose ids agree but for so many low bits are compared within one task.
RUN_BITS = 10


def bottom_k(data: np.ndarray, offsets: np.ndarray, k: int, width: int) -> list[np.ndarray]:
    """The sketch of each row of a buffer of texts; fewer than 2 ** 20 rows."""
    hashes, counts = words(data, offsets)
    runs, per_row = shingles(hashes, counts, width)
    row = np.repeat(np.arange(len(counts)), per_row).astype(U64)
    keys = np.sort((row << U64(BITS)) | (runs >> U64(64 - BITS)))
    if len(keys):
        keys = keys[np.concatenate(([True], keys[1:] != keys[:-1]))]
    edge = np.searchsorted(keys, np.arange(len(counts) + 1).astype(U64) << U64(BITS)).tolist()
    values = keys & U64((1 << BITS) - 1)
    return [values[a : min(b, a + k)] for a, b in zip(edge[:-1], edge[1:])]


def likeness(a: np.ndarray, b: np.ndarray, k: int) -> float:
    """Estimated resemblance of two sketches."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.sort(np.concatenate((a, b)))
    twice = both[1:] == both[:-1]
    single = np.concatenate(([True], ~twice))
    rank = np.cumsum(single)
    size = min(k, int(rank[-1]))
    return float(np.count_nonzero(twice & (rank[1:] <= size))) / size


def sketches(docs: DataFrame, text: str = "text", k: int = K, width: int = WIDTH) -> DataFrame:
    """``docs`` without ``text`` and with ``sketch`` (array of bigint)."""
    kept = [f for f in docs.schema.fields if f.name != text]
    from pyspark.sql.types import ArrayType, LongType, StructField, StructType

    def run(batches):
        import pyarrow as pa

        for rows, data, offsets in chunks(batches, text):
            found = bottom_k(data, offsets, k, width)
            column = pa.array([x.astype(np.int64) for x in found], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*(rows.column(f.name) for f in kept), column], [*(f.name for f in kept), "sketch"])

    ready = docs.select(*(f.name for f in kept), F.col(text).cast("string").alias(text))
    return ready.mapInArrow(run, StructType([*kept, StructField("sketch", ArrayType(LongType()))]))


def merge(parts: DataFrame, by: list[str], sketch: str = "sketch", k: int = K) -> DataFrame:
    """One sketch for each key from those of its parts. Equal hashes are first dropped by partial
    aggregation, then each key keeps its ``k`` least; a key with very many parts is split by hash."""
    values = parts.select(*by, F.explode(sketch).alias("value")).distinct()
    split = Window.partitionBy(*by, F.pmod("value", F.lit(64))).orderBy("value")
    few = values.withColumn("n", F.row_number().over(split)).where(F.col("n") <= k).drop("n")
    ranked = few.withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy("value"))).where(F.col("n") <= k)
    merged = ranked.groupBy(*by).agg(F.array_sort(F.collect_list("value")).alias(sketch))
    keys = parts.select(*by).distinct()
    same = [keys[c].eqNullSafe(merged[c]) for c in by]
    from functools import reduce

    return keys.join(merged, reduce(lambda x, y: x & y, same), "left").select(*(keys[c] for c in by), F.coalesce(merged[sketch], F.array().cast("array<bigint>")).alias(sketch))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    union = F.slice(F.array_sort(F.array_union(a, b)), 1, k)
    size = F.size(union)
    return F.when(size == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(union, F.array_intersect(a, b))) / size)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has: of a's hashes up to the lesser full sketch's end."""
    top = F.least(*(F.when(F.size(x) >= k, F.element_at(x, -1)).otherwise(F.lit((1 << BITS) - 1)) for x in (a, b)))
    within = F.filter(a, lambda x: x <= top)
    return F.when(F.size(within) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(within, b)) / F.size(within))


def distinct_shingles(a: Column, k: int = K) -> Column:
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) * F.lit(float(1 << BITS)) / (F.element_at(a, -1) + 1))


def _compare(k: int, width: int):
    def run(batches):
        import base64
        import hashlib

        import pyarrow as pa

        def buffer(texts):
            raw = [t.encode() for t in texts]
            return np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in raw]))).astype(np.int64), raw

        def spelled(x):
            return base64.b64encode(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()).decode()

        def compare(rows):
            """Results for all rows but the last, each against the one after it."""
            texts = [r[3] for r in rows]
            plain = bottom_k(*buffer(texts)[:2], k, width)
            own = [i for i in range(len(rows) - 1) if not rows[i][2]]
            edited = []
            for i in own:
                third = len(texts[i]) // 3
                edited.append(texts[i][: len(texts[i]) - third] + texts[i + 1][:third])
            data, at, raw = buffer(edited)
            after = bottom_k(data, at, k, width)
            columns = [
                pa.array([rows[i][1] for i in own], pa.int64()),
                pa.array([len(texts[i]) for i in own], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in raw], pa.string()),
                pa.array([spelled(plain[i]) for i in own], pa.string()),
                pa.array([spelled(x) for x in after], pa.string()),
                pa.array([likeness(plain[i], x, k) for i, x in zip(own, after)], pa.float64()),
                pa.array([likeness(plain[i], plain[i + 1], k) for i in own], pa.float64()),
            ]
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

        held, chars = [], 0
        for batch in batches:
            for row in zip(batch.column("run").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("guest").to_pylist(), (t.as_py() or "" for t in batch.column("text"))):
                held.append(row)
                chars += len(row[3])
                if chars > 1 << 19 and len(held) > 1:
                    yield compare(held)
                    held, chars = [row], len(row[3])
        if len(held) > 1:
            yield compare(held)

    return run


def _runs_below(runs: DataFrame) -> DataFrame:
    """(run, below) with the next lower run that has documents, null for the lowest. Two levels of
    windows: the single task at the top sees one row for each 2 ** 20 runs of ids."""
    group = F.shiftright("run", RUN_BITS)
    inner = runs.select("run", group.alias("g")).withColumn("below", F.lag("run").over(Window.partitionBy("g").orderBy("run")))
    tops = inner.groupBy("g").agg(F.max("run").alias("top"))
    tops = tops.withColumn("under", F.lag("top").over(Window.orderBy("g"))).select("g", "under")
    return inner.join(tops, "g").select("run", F.coalesce("below", "under").alias("below"))


def edited_fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = K, width: int = WIDTH) -> DataFrame:
    """For each document its fingerprint, that of its edited text (the last third replaced by the
    start of the next document in descending id order, the first following the last), and their
    likenesses. Texts are shuffled once, by runs of ids; only a run's edge sends a text to another.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("rank", F.coalesce("doc_id", F.lit(-(1 << 63)))).withColumn("run", F.shiftright("rank", RUN_BITS))
    runs = rows.select("run").distinct()
    last = runs.agg(F.max("run")).first()[0]
    below = _runs_below(runs).withColumn("below", F.coalesce("below", F.lit(last)))
    top = rows.groupBy("run").agg(F.max(F.struct("rank", "text", "doc_id")).alias("t")).withColumnRenamed("run", "below")
    guests = below.join(top, "below").select(F.col("t.doc_id").alias("doc_id"), F.col("t.text").alias("text"), F.col("t.rank").alias("rank"), "run", F.lit(True).alias("guest"))
    dealt = rows.select("doc_id", "text", "rank", "run", F.lit(False).alias("guest")).union(guests)
    dealt = dealt.repartition(partitions(spark), "run").sortWithinPartitions("run", "guest", F.desc("rank"), F.desc("text"))
    return dealt.select("run", "doc_id", "guest", "text").mapInArrow(_compare(k, width), "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
