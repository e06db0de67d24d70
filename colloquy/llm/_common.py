"""Helpers shared by the operators: the shared folder, Arrow chunks, byte-level words, packing.

Words are maximal runs of bytes other than ASCII white space (``\\x20`` and
``\\x09``-``\\x0D``); ``lower`` folds A-Z only. Both work on UTF-8 bytes, so they
equal the same rules on code points.
"""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession

U64 = np.uint64
CHUNK_BYTES = 1 << 20
#: Rows and bytes of an Arrow batch: what a task holds at once on either side of a Python function.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; only a local session without one gets a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="colloquy-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def shared_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/colloquy-{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    small_batches(spark)
    path = shared_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Texts may be long, so batches are kept small for this session."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", None) or 10000) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def partitions(spark: SparkSession) -> int:
    small_batches(spark)
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def string_buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column; nulls are empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batches, text: str = "text", limit: int = CHUNK_BYTES):
    """Slices of whole rows of each batch of about ``limit`` text bytes: (slice, bytes, offsets)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, offsets = string_buffer(batch.column(text))
        first = 0
        while first < batch.num_rows:
            last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
            last = min(batch.num_rows, max(first + 1, last))
            yield batch.slice(first, last - first), data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
            first = last


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser (splitmix64)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def space_table() -> np.ndarray:
    table = np.zeros(256, bool)
    table[[9, 10, 11, 12, 13, 32]] = True
    return table


def _spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first byte, byte after the last) of each word."""
    solid = ~space_table()[data]
    before = np.empty_like(solid)
    before[0] = False
    before[1:] = solid[:-1]
    before[offsets[:-1][offsets[:-1] < len(data)]] = False
    after = np.empty_like(solid)
    after[-1] = False
    after[:-1] = solid[1:]
    tails = offsets[1:] - 1
    after[tails[tails >= 0]] = False
    return np.flatnonzero(solid & ~before), np.flatnonzero(solid & ~after) + 1


def _bared(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word spans without bytes of ``edge`` at either end; words of nothing else stay as they are."""
    at, stop = starts.copy(), ends.copy()
    for where, step, other in ((at, 1, stop), (stop, -1, at)):
        live = np.arange(len(starts))
        for _ in range(8):
            live = live[(where[live] - other[live]) * step < 0]
            live = live[edge[data[where[live] - (step < 0)]]]
            if not len(live):
                break
            where[live] += step
        # long runs: the nearest other byte of the whole chunk
        if len(live):
            plain = np.flatnonzero(~edge[data])
            if step > 0:
                near = np.searchsorted(plain, where[live])
                where[live] = np.minimum(np.append(plain, len(data))[near], other[live])
            else:
                near = np.searchsorted(plain, where[live]) - 1
                where[live] = np.maximum(np.where(near >= 0, np.append(plain, 0)[near] + 1, 0), other[live])
    whole = at >= stop
    return np.where(whole, starts, at), np.where(whole, ends, stop)


#: Words of more bytes are hashed as a whole.
_LONG_WORD = 256


def _hashed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span, eight at a time."""
    import xxhash

    size = ends - starts
    out = mix64(size.astype(U64) + U64(0x9E3779B97F4A7C15))
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eights = np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))
    live, done = np.flatnonzero(size <= _LONG_WORD), 0
    while len(live):
        left = np.minimum(size[live] - done, 8)
        eight = eights[starts[live] + done] << ((8 - left) * 8).astype(U64)
        out[live] = mix64(out[live] * U64(0xD6E8FEB86659FD93) + eight)
        done += 8
        live = live[size[live] > done]
    for i in np.flatnonzero(size > _LONG_WORD).tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].tobytes())
    return out


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True, edge: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of each word in order, count of words per row); bytes of ``edge`` at either end of
    a word are left out unless nothing else is in it."""
    n_rows = len(offsets) - 1
    if not len(data):
        return np.zeros(0, U64), np.zeros(n_rows, np.int64)
    starts, ends = _spans(data, offsets)
    counts = np.diff(np.searchsorted(starts, offsets)).astype(np.int64)
    if edge:
        table = np.zeros(256, bool)
        table[list(edge)] = True
        starts, ends = _bared(data, starts, ends, table)
    if lower:
        table = np.arange(256, dtype=np.uint8)
        table[65:91] = table[97:123]
        data = table[data]
    return _hashed(data, starts, ends), counts


def shingles(hashes: np.ndarray, counts: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each run of ``width`` words in order, count per row); a row of fewer words has one
    shingle of all its words, a row without words has none."""
    per_row = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    total = int(per_row.sum())
    if not total:
        return np.zeros(0, U64), per_row
    first = np.concatenate(([0], np.cumsum(counts)[:-1]))
    row = np.repeat(np.arange(len(counts)), per_row)
    at = first[row] + np.arange(total) - np.repeat(np.cumsum(per_row) - per_row, per_row)
    last = first + counts
    out = np.zeros(total, U64)
    for j in range(width):
        ok = at + j < last[row]
        word = np.where(ok, hashes[np.minimum(at + j, len(hashes) - 1)], U64(0))
        out = mix64(out * U64(0xD6E8FEB86659FD93) + word + U64(j + 1))
    return out, per_row


def pack(array: np.ndarray) -> bytes:
    """Unsigned 32-bit integers as byte planes under zstd."""
    import zstandard

    planes = np.ascontiguousarray(array, np.uint32).view(np.uint8).reshape(-1, 4).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(data: bytes) -> np.ndarray:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(4, -1).T).view(np.uint32).ravel()


def squeeze(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(data)


def unsqueeze(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(data)


def running(rows: DataFrame, group: list[str], order: list[str], amount: str | None, label: str, about: DataFrame | None = None) -> DataFrame:
    """``rows`` with ``before``, the sum of ``amount`` (None: 1) over the rows ahead in their group by
    ``order``, and ``whole``, the group's sum. Group columns have no nulls. ``about``: more columns of groups.

    Rows are dealt by range of group and order, each task sums its own range as it writes it, and the sums
    of ranges (one for each group and task) are summed by a window and joined back: no task sees a whole
    group. Rows that tie in ``order`` come in any order, so it should tell apart all that matters.
    """
    import pyarrow as pa
    from pyspark.sql import Window
    from pyspark.sql import functions as F
    from pyspark.sql.types import IntegerType, LongType, StructField, StructType

    at = None if amount is None else rows.columns.index(amount)

    def add(batches):
        from pyspark import TaskContext

        band, total = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            own = np.ones(n, np.int64) if at is None else batch.column(at).to_numpy(zero_copy_only=False).astype(np.int64)
            upto = np.cumsum(own) + total
            total = int(upto[-1]) if n else total
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, band, np.int32)), pa.array(upto - own)], [*batch.schema.names, "_band", "_local"])

    keys = [*group, *order]
    schema = StructType([*rows.schema.fields, StructField("_band", IntegerType()), StructField("_local", LongType())])
    placed = materialize(rows.repartitionByRange(partitions(rows.sparkSession), *keys).sortWithinPartitions(*keys).mapInArrow(add, schema), label)
    bands = placed.groupBy(*group, "_band").agg(F.min("_local").alias("_first"), F.sum(F.lit(1) if amount is None else F.col(amount)).alias("_own"))
    below = Window.partitionBy(*group).orderBy("_band").rowsBetween(Window.unboundedPreceding, -1)
    shifts = bands.select(*group, "_band", (F.coalesce(F.sum("_own").over(below), F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_own").over(Window.partitionBy(*group)).alias("whole"))
    if about is not None:
        shifts = shifts.join(about, group, "left")
    return placed.join(shifts, [*group, "_band"]).withColumn("before", F.col("_local") + F.col("_shift")).drop("_band", "_local", "_shift")
