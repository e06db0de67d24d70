"""Ordered folds over the rows of a recording: runs, capped turns, chunks, relabelling."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions import text as T

MERGE_GAP_S, TURN_GAP_S, TURN_CAP_S, CHUNK_CHARS, CHAPTERS, TITLE_CHARS = 1.2, 0.8, 28.0, 6000, 8, 60


def clean(frags: DataFrame) -> DataFrame:
    """Utterances with their texts cleaned; dropped ones are gone."""
    return frags.withColumn("text", T.kept_text(F.col("text"))).where("text is not null")


def merge_runs(frags: DataFrame, gap: float = MERGE_GAP_S) -> DataFrame:
    """Neighbouring rows of one speaker no more than ``gap`` apart become one row; its end is that of
    its last row. One shuffle by meeting: window and aggregation share it."""
    order = Window.partitionBy("meeting_id").orderBy("seq")
    fresh = ~F.coalesce((F.lag("speaker").over(order) == F.col("speaker")) & (F.col("t0") - F.lag("t1").over(order) <= gap), F.lit(False))
    runs = frags.withColumn("run", F.sum(fresh.cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    return runs.groupBy("meeting_id", "run").agg(
        F.min("seq").alias("seq"),
        F.min_by("speaker", "seq").alias("speaker"),
        F.min_by("t0", "seq").alias("t0"),
        F.max_by("t1", "seq").alias("t1"),
        F.count(F.lit(1)).alias("n_frags"),
        F.expr("listagg(text, ' ') within group (order by seq)").alias("text"),
    )


def clean_and_merge(frags: DataFrame, gap: float = MERGE_GAP_S) -> DataFrame:
    return merge_runs(clean(frags), gap)


def in_order(rows: DataFrame, by: str, order: str, fold: Callable, schema: str) -> DataFrame:
    """``fold`` over each task's rows (an iterator of Arrow batches) with the rows of one ``by`` next to each other, in
    order. The fold keeps what it needs of one group, so a group is read as a stream, however long it is."""
    return rows.repartition(by).sortWithinPartitions(by, order).mapInArrow(fold, schema)


def merge_turns(segs: DataFrame, gap, cap, by: str = "recording_id", order: str = "idx", label: str = "label", t0: str = "t0", t1: str = "t1") -> DataFrame:
    """Voiced segments of one label joined into turns while gaps are at most ``gap`` and the turn at
    most ``cap`` long; an over-long segment is still a turn. Unlabelled segments (below 0) are dropped.

    Where a turn ends depends on where it began, so it is a fold in order of time that holds one turn."""
    kinds = dict(segs.dtypes)

    def fold(batches):
        now, out, like = None, [], None
        for batch in batches:
            like = batch.schema
            for key, name, a, b in zip(*(batch.column(c).to_pylist() for c in (by, label, t0, t1))):
                if now and now[0] == key and now[1] == name and a - now[3] <= gap and b - now[2] <= cap:
                    now[3] = b
                    now[4] += 1
                else:
                    out += [now] if now else []
                    now = [key, name, a, b, 1]
            if len(out) >= 1000:
                yield from turns(out, like)
                out = []
        out += [now] if now else []
        if out:
            yield from turns(out, like)

    def turns(out, like):
        import pyarrow as pa

        kinds = [like.field(c).type for c in (by, label, t0, t1)] + [pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*out), kinds)], [by, label, t0, t1, "n_segs"])

    rows = segs.where(F.col(label) >= 0).select(by, order, label, t0, t1)
    return in_order(rows, by, order, fold, f"`{by}` {kinds[by]}, `{label}` {kinds[label]}, `{t0}` {kinds[t0]}, `{t1}` {kinds[t1]}, n_segs bigint")


def relabel_first_seen(segs: DataFrame, by: str = "recording_id", order: str = "idx", label: str = "label") -> DataFrame:
    """Labels numbered 0, 1, 2.. by first appearance in each recording; labels below 0 stay."""
    first = F.min(F.when(F.col(label) >= 0, F.col(order))).over(Window.partitionBy(by, label))
    rows = segs.withColumn("_first", first)
    named = F.dense_rank().over(Window.partitionBy(by).orderBy(F.asc_nulls_last("_first"))) - 1
    return rows.withColumn("label", F.when(F.col(label) >= 0, named).otherwise(F.col(label)).cast("int")).drop("_first")


def chunk(lines: DataFrame, max_chars: int = CHUNK_CHARS, by: str = "meeting_id", order: str = "seq", line: str = "line") -> DataFrame:
    """Lines packed in order into chunks of at most ``max_chars`` (line ends count); a longer line is
    its own chunk. The fold sees lengths only, and holds the size of one chunk."""
    kinds = dict(lines.dtypes)

    def fold(batches):
        import pyarrow as pa

        key, size, place = None, 0, -1
        for batch in batches:
            places = []
            for own, n in zip(batch.column(by).to_pylist(), batch.column("_n").to_pylist()):
                if place < 0 or own != key:
                    key, size, place = own, 0, 0
                elif size and size + n > max_chars:
                    size, place = 0, place + 1
                size += n + 1
                places.append(place)
            yield pa.RecordBatch.from_arrays([batch.column(by), batch.column(order), pa.array(places, pa.int32())], [by, order, "chunk"])

    sizes = lines.select(by, order, F.char_length(line).alias("_n"))
    placed = lines.join(in_order(sizes, by, order, fold, f"`{by}` {kinds[by]}, `{order}` {kinds[order]}, chunk int"), [by, order])
    return placed.groupBy(by, "chunk").agg(F.count(F.lit(1)).alias("n_lines"), F.expr(f"listagg({line}, '\n') within group (order by {order})").alias("text"))


def chapters(utts: DataFrame, parts: int = CHAPTERS, title_chars: int = TITLE_CHARS) -> DataFrame:
    """Every max(1, n // parts)-th utterance opens a chapter titled by its first characters."""
    w = Window.partitionBy("meeting_id")
    rows = utts.withColumns({"_n": F.count(F.lit(1)).over(w), "_at": F.row_number().over(w.orderBy("seq")) - 1})
    step = F.greatest(F.lit(1), F.floor(F.col("_n") / parts))
    return rows.where(F.col("_at") % step == 0).select("meeting_id", "seq", F.col("t0").alias("t"), F.left("text", F.lit(title_chars)).alias("titre"), F.lit("").alias("resume"))


def durations(utts: DataFrame, meta: DataFrame | None = None) -> DataFrame:
    """Seconds to the end of each meeting's last row; else its ``duree``; else 0."""
    ends = utts.groupBy("meeting_id").agg(F.max_by("t1", "seq").alias("duration"))
    if meta is None:
        return ends
    return meta.join(ends, "meeting_id", "full").select("meeting_id", F.coalesce("duration", T.duration_text(F.col("duree")), F.lit(0.0)).alias("duration"))


def in_range(t: Column, duration: Column) -> Column:
    return t.isNull() | (duration == 0) | t.between(F.lit(0), duration + 1)
