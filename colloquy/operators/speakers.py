"""Speakers of meetings: names, statistics, search, and votes of who is meant by a name."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colloquy.operators.assignment import assign

VOTES = ((1, 1.0), (-1, 0.6), (2, 0.4))


def named_speakers(utts: DataFrame, mapping: DataFrame | None = None) -> DataFrame:
    """(meeting_id, speaker, name, role) of every speaker; without a mapped name, the id."""
    ids = utts.select("meeting_id", "speaker").distinct()
    if mapping is None:
        return ids.select("meeting_id", "speaker", F.col("speaker").alias("name"), F.lit("").alias("role"))
    return ids.join(mapping, ["meeting_id", "speaker"], "left").select("meeting_id", "speaker", F.coalesce("name", "speaker").alias("name"), F.lit("").alias("role"))


def with_names(utts: DataFrame, speakers: DataFrame) -> DataFrame:
    return utts.join(speakers.select("meeting_id", "speaker", "name"), ["meeting_id", "speaker"], "left").withColumn("name", F.coalesce("name", "speaker"))


def speaker_stats(utts: DataFrame) -> DataFrame:
    """Interventions, talk time, words and share of the meeting's talk time for each speaker."""
    words = F.size(F.filter(F.split("text", r"\s+"), lambda x: x != ""))
    stats = utts.groupBy("meeting_id", "speaker").agg(F.count(F.lit(1)).alias("interventions"), F.sum(F.col("t1") - F.col("t0")).alias("talk_s"), F.sum(words).alias("words"), F.min("t0").alias("first_t0"))
    whole = F.sum("talk_s").over(Window.partitionBy("meeting_id"))
    return stats.withColumn("share", F.coalesce(F.col("talk_s") / F.nullif(whole, F.lit(0.0)), F.lit(0.0)))


def search(utts: DataFrame, query: str = "", speakers: tuple[str, ...] = ()) -> DataFrame:
    """Utterances that contain ``query`` in any case (empty: all) by one of ``speakers`` (none: anyone)."""
    found = utts.where(F.contains(F.lower("text"), F.lit(query.lower()))) if query else utts
    return found.where(F.col("speaker").isin(*speakers)) if speakers else found


def neighbour_votes(utts: DataFrame, names: dict[str, str], votes: tuple[tuple[int, float], ...] = VOTES) -> DataFrame:
    """(meeting_id, name, speaker, votes, share): whoever speaks next to a mention of a name (a regular
    expression, any case) is likely its bearer. The grid of names and speakers is complete; ``names``
    are parameters, so one expression tests them all in one pass."""
    w = Window.partitionBy("meeting_id").orderBy("seq")
    beside = F.array(*(F.struct((F.lead("speaker", k) if k > 0 else F.lag("speaker", -k)).over(w).alias("s"), F.lit(weight).alias("w")) for k, weight in votes))
    said = F.array(*(F.when(F.col("text").rlike("(?iu)" + pattern), F.lit(name)) for name, pattern in names.items()))
    rows = utts.select("meeting_id", "speaker", "text", beside.alias("beside"))
    rows = rows.select("meeting_id", F.col("speaker").alias("by"), "beside", F.explode(F.filter(said, lambda x: x.isNotNull())).alias("name"))
    cast = rows.select("meeting_id", "name", "by", F.explode("beside").alias("v")).where("v.s != by")
    counted = cast.groupBy("meeting_id", "name", F.col("v.s").alias("speaker")).agg(F.sum("v.w").alias("votes"))
    grid = utts.select("meeting_id", "speaker").distinct().withColumn("name", F.explode(F.array(*map(F.lit, names))))
    full = grid.join(counted, ["meeting_id", "name", "speaker"], "left").withColumn("votes", F.coalesce("votes", F.lit(0.0)))
    column = F.sum("votes").over(Window.partitionBy("meeting_id", "speaker"))
    return full.withColumn("share", F.coalesce(F.col("votes") / F.nullif(column, F.lit(0.0)), F.lit(0.0)))


def name_by_votes(utts: DataFrame, names: dict[str, str]) -> DataFrame:
    """(meeting_id, speaker, name, votes, confidence): names given to speakers one to one so that the votes of
    ``neighbour_votes`` are greatest in sum; confidence is the name's share of the speaker's votes. Ties go to
    the first by name and speaker."""
    votes = neighbour_votes(utts, names)
    place = F.row_number().over(Window.partitionBy("meeting_id").orderBy("name", "speaker"))
    ranked = votes.withColumn("score", F.col("votes") + 1e-6 * F.pow(F.lit(2.0), -place))
    found = assign(ranked, "meeting_id", "speaker", "name", "score").select("meeting_id", "speaker", "name")
    return found.join(votes.select("meeting_id", "speaker", "name", "votes", F.col("share").alias("confidence")), ["meeting_id", "speaker", "name"])
