"""Conversation views over the driver's tables, as DataFrames and as SQL of the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

HOUR = 3_600_000_000
EPOCH = 1_704_067_200_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _timed(rows: DataFrame) -> DataFrame:
    """Rows with seq, t0 and t1 in sixteenths of a second, so that sums are exact in any order."""
    order = Window.partitionBy("meeting_id").orderBy("turn", "frag")
    rows = rows.withColumns({"seq": (F.row_number().over(order) - 1).cast("long"), "dur": F.greatest(F.length("text"), F.lit(1)) / 16, "gap": F.pmod(F.col("turn") * 7 + F.col("frag") * 3, F.lit(4)) * 0.5})
    before = F.coalesce(F.sum(F.col("dur") + F.col("gap")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return rows.withColumn("t0", F.col("gap") + before).withColumn("t1", F.col("t0") + F.col("dur")).select("meeting_id", "seq", "turn", "frag", "speaker", "t0", "t1", "text")


def frag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each line of each turn."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("meeting_id"), "turn", F.col("role").alias("speaker"), F.posexplode(F.split("text", "\n", -1)).alias("frag", "text"))
    return _timed(rows)


def utt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each turn."""
    return _timed(table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("meeting_id"), "turn", F.col("role").alias("speaker"), F.lit(0).alias("frag"), "text"))


def seg_rows(events: DataFrame) -> DataFrame:
    """Each event as a labelled segment in microseconds."""
    rows = events.withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")) - EPOCH)
    label = F.when(F.col("event_type") == "error", -1).when(F.col("event_type") == "click", 0).when(F.col("event_type") == "purchase", 1).when(F.col("event_type") == "signup", 2).otherwise(3)
    return rows.select(F.col("user_id").alias("recording_id"), "ts", "event_id", F.col("at").alias("t0"), (F.col("at") + F.round(F.col("value") * 100).cast("long") * 10000).alias("t1"), label.alias("label"))


def seg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled segments in microseconds from events."""
    idx = F.row_number().over(Window.partitionBy("recording_id").orderBy("ts", "event_id")) - 1
    return seg_rows(table(spark, sf_dir, "events")).select("recording_id", idx.cast("long").alias("idx"), "t0", "t1", "label")


def vec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), "label")


def _timed_sql(lines: str, name: str) -> str:
    return f"""{name}_l as ({lines}),
{name}_b as (select *, row_number() over (partition by meeting_id order by turn, frag) - 1 as seq, greatest(length(text), 1)::double / 16 as dur, ((turn * 7 + frag * 3) % 4) * 0.5::double as gap from {name}_l),
{name}_t as (select *, gap + coalesce(sum(dur + gap) over (partition by meeting_id order by turn, frag rows between unbounded preceding and 1 preceding), 0) as t0 from {name}_b),
{name} as (select meeting_id, seq, turn, frag, speaker, t0, t0 + dur as t1, text from {name}_t)"""


FRAG_SQL = _timed_sql("select conv_id as meeting_id, turn, role as speaker, unnest(string_split(text, chr(10))) as text, unnest(range(len(string_split(text, chr(10))))) as frag from conversations", "frag")
UTT_SQL = _timed_sql("select conv_id as meeting_id, turn, role as speaker, text, 0 as frag from conversations", "utt")
SEG_SQL = f"""seg as (select user_id as recording_id, row_number() over (partition by user_id order by ts, event_id) - 1 as idx, epoch_us(ts) - {EPOCH} as t0,
  epoch_us(ts) - {EPOCH} + round(value * 100)::bigint * 10000 as t1, case event_type when 'error' then -1 when 'click' then 0 when 'purchase' then 1 when 'signup' then 2 else 3 end as label from events)"""


def sound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings of 200 embeddings as sound of 800 Hz in frames of 2 seconds; 6 of every 17 embeddings are faint,
    but for one of them."""
    rows = vec(spark, sf_dir).withColumn("_at", F.col("vec_id") % 200)
    heard = (F.col("_at") % 17 < 11) | (F.col("_at") % 17 == 14)
    loud = rows.withColumn("_x", F.transform("embedding", lambda v: v * F.when(heard, 1.0).otherwise(0.01)))
    grouped = loud.groupBy(F.floor(F.col("vec_id") / 200).alias("recording_id"), F.floor(F.col("_at") / 25).alias("_frame")).agg(F.array_sort(F.collect_list(F.struct("_at", "_x"))).alias("_p"))
    return grouped.select("recording_id", (F.col("_frame") * 1600).alias("start"), F.flatten(F.transform("_p", lambda p: p["_x"])).alias("signal"))


SOUND_SQL = """snd as (select vec_id // 200 as recording_id, (vec_id % 200) * 64 + generate_subscripts(embedding, 1) - 1 as p,
  unnest(embedding::double[]) * case when (vec_id % 200) % 17 < 11 or (vec_id % 200) % 17 = 14 then 1.0::double else 0.01::double end as x from embeddings)"""
