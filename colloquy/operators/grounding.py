"""Are a report's quotes, speakers and times borne out by its transcript?"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.functions import reports as R
from colloquy.functions import text as T
from colloquy.operators.runs import in_range
from colloquy.sources.shared import written

THRESHOLD = 0.5


def _bound(n: Column, m: Column, at: Column) -> Column:
    """The greatest likeness of sets of ``n`` and ``m`` words whose first common one is the first's word ``at`` (from 0)."""
    return F.least((n - at) / (m + at), m / n)


def best_overlap(citations: DataFrame, utterances: DataFrame, by: list[str], cite_id: str = "cite_id", quote: str = "quote", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``citations`` with ``best``, the greatest Jaccard likeness of its word set to any utterance's.

    Utterances are read once and kept as the words that some quote of their group has and their number of
    words; equal ones are one. A quote's words are tried from the rarest on. A first common word at a place
    bounds the likeness by the words still to come and the two sizes, so each round tries the places and
    sizes that can reach its level: first ``threshold``, then a half and a quarter of it, then anything. A
    quote whose best has reached the level is settled, since all that is better was tried; only the others
    go on, and only to what can beat their best so far. So words of every utterance meet few of them."""
    key = [*by, "_q"]
    asked = written(citations.select(*by, F.col(cite_id).alias("_q"), T.tokens(F.col(quote)).alias("_tq")).where(F.size("_tq") > 0), "quotes")
    wanted = written(asked.select(*by, F.explode("_tq").alias("_w")).distinct(), "words")
    said = utterances.select(*by, F.array_sort(T.tokens(F.col(text))).alias("_t"))
    # equal lines are one before their words are taken apart; the words of a line then meet again where they are
    sets = said.select(*by, F.xxhash64("_t").alias("_u"), F.size("_t").alias("_m"), "_t").groupBy(*by, "_u", "_m").agg(F.any_value("_t").alias("_t"))
    words = sets.select(*by, "_u", "_m", F.explode("_t").alias("_w")).join(wanted, [*by, "_w"], "left_semi")
    lines = written(words.groupBy(*by, "_u", "_m").agg(F.collect_list("_w").alias("_words")), "lines")
    index = lines.select(*by, "_u", "_m", F.explode("_words").alias("_w"))
    counts = index.groupBy(*by, "_w").agg(F.count(F.lit(1)).alias("_df"))
    ranked = asked.select(*key, F.explode("_tq").alias("_w")).join(counts, [*by, "_w"], "left").groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(F.coalesce("_df", F.lit(0)).alias("d"), "_w"))).alias("_r"))
    left = written(ranked.select(*key, F.transform("_r", lambda x: x["_w"]).alias("_tq"), F.size("_r").alias("_n"), F.lit(0.0).alias("_best")), "ranked")
    settled, before = [], None
    for level in (threshold, threshold / 2, threshold / 4, 0.0):
        reach = lambda t: F.col("_n") - F.ceil(F.col("_n") * t - 1e-9) + (1 if t else 0)
        tries = left.select(*key, "_n", "_best", F.posexplode("_tq").alias("_at", "_w")).where(F.col("_at") < reach(level))
        met = tries.join(index, [*by, "_w"]).withColumn("_most", _bound(F.col("_n"), F.col("_m"), F.col("_at")))
        met = met.where((F.col("_most") > F.col("_best")) & (F.col("_most") >= level - 1e-9))
        if before is not None:  # what an earlier round has tried
            met = met.where(~((F.col("_at") < reach(before)) & (F.col("_most") >= before - 1e-9)))
        pairs = met.select(*key, "_u", "_m").distinct()
        both = pairs.join(lines, [*by, "_u", "_m"]).join(left.select(*key, "_tq", "_n"), key).withColumn("_both", F.size(F.array_intersect("_tq", "_words")))
        found = both.groupBy(*key).agg(F.max(F.col("_both") / (F.col("_n") + F.col("_m") - F.col("_both"))).alias("_new"))
        now = left.join(found, key, "left").withColumn("_best", F.greatest("_best", F.coalesce("_new", F.lit(0.0)))).drop("_new")
        now = written(now, "tried") if level else now
        settled.append(now.where(F.col("_best") >= level).select(*by, F.col("_q").alias(cite_id), F.col("_best").alias("best")))
        left, before = now.where(F.col("_best") < level), level
        if level and not left.limit(1).count():
            break
    best = reduce(DataFrame.unionByName, settled)
    return citations.join(best, [*by, cite_id], "left").withColumn("best", F.coalesce("best", F.lit(0.0)))


def grounding(citations: DataFrame, utterances: DataFrame, meetings: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(meeting_id, n_citations, grounding_score): the share of grounded citations, 1 without any."""
    scored = best_overlap(citations, utterances, ["meeting_id"])
    shares = scored.groupBy("meeting_id").agg(F.count(F.lit(1)).alias("n_citations"), F.avg((F.col("best") >= threshold).cast("double")).alias("grounding_score"))
    return meetings.select("meeting_id").distinct().join(shares, "meeting_id", "left").select("meeting_id", F.coalesce("n_citations", F.lit(0)).alias("n_citations"), F.coalesce("grounding_score", F.lit(1.0)).alias("grounding_score"))


_ISSUE = "array<struct<kind_ord:int,idx:int,check_ord:int,issue:string,value:double>>"


def _issue(kind: int, check: int, name: str, idx: Column, text: Column, value: Column) -> Column:
    label = F.concat(F.lit(f"{name}["), idx.cast("string"), F.lit("]"), text)
    return F.struct(F.lit(kind).alias("kind_ord"), idx.cast("int").alias("idx"), F.lit(check).alias("check_ord"), label.alias("issue"), value.cast("double").alias("value"))


def _outside(t: Column, duration: Column) -> Column:
    return ~in_range(F.when(t.isNotNull(), T.exact_seconds(t.cast("string"))), duration)


def _late(t: Column, duration: Column) -> Column:
    return F.concat(F.lit(" timestamp "), t.cast("string"), F.lit(" outside [0, "), F.rint(duration).cast("long").cast("string"), F.lit("]"))


def _timed(reports: DataFrame, durations: DataFrame) -> DataFrame:
    """Reports with their durations, written once, since every check reads them."""
    timed = reports.join(durations, "meeting_id", "left").withColumn("duration", F.coalesce("duration", F.lit(0.0)))
    return written(timed, "reports")


def _citations(timed: DataFrame, utterances: DataFrame, threshold: float) -> DataFrame:
    """Each citation with its best overlap and the array of its issues."""
    speakers = F.col("report.speakers")
    known = F.coalesce(F.concat(F.map_keys(speakers), F.transform(F.map_values(speakers), lambda v: v["name"])), F.array().cast("array<string>"))
    cites = timed.select("meeting_id", "duration", known.alias("known"), F.posexplode("report.citations").alias("idx", "item"))
    cites = cites.withColumns({"cite_id": F.col("idx"), "quote": F.coalesce("item.texte", F.lit("")), "who": F.coalesce("item.speaker", F.lit(""))})
    scored = best_overlap(cites, utterances, ["meeting_id"])
    none, idx = F.lit(None), F.col("idx")
    stranger = (F.col("who") != "") & ~F.coalesce(F.array_contains("known", F.col("who")), F.lit(False))
    checks = F.array(
        F.when(F.col("best") < threshold, _issue(0, 0, "citation", idx, F.concat(F.lit(" not grounded in transcript (overlap="), F.format_string("%.2f", F.bround("best", 2)), F.lit(")")), F.col("best"))),
        F.when(stranger, _issue(0, 1, "citation", idx, F.concat(F.lit(" references unknown speaker "), R.quoted(F.col("who"))), none)),
        F.when(_outside(F.col("item.t"), F.col("duration")), _issue(0, 2, "citation", idx, _late(F.col("item.t"), F.col("duration")), F.col("duration"))),
    )
    return scored.withColumn("found", F.filter(checks, lambda x: x.isNotNull()))


def _others(timed: DataFrame) -> DataFrame:
    """Each report with the array of issues of its chapters, decisions and actions."""
    duration, none = F.col("duration"), F.lit(None)
    empty = lambda x: T.strip(F.coalesce(x, F.lit(""))) == ""
    late = F.transform("report.chapitres", lambda c, i: F.when(_outside(c["t"], duration), _issue(1, 0, "chapitre", i, _late(c["t"], duration), duration)))
    decisions = F.transform("report.decisions", lambda d, i: F.when(empty(d["decision"]), _issue(2, 0, "decision", i, F.lit(" is empty"), none)))
    actions = F.transform("report.actions", lambda a, i: F.when(empty(a["action"]), _issue(3, 0, "action", i, F.lit(" is empty"), none)))
    every = F.concat(*(F.coalesce(x, F.array().cast(_ISSUE)) for x in (late, decisions, actions)))
    return timed.select("meeting_id", F.filter(every, lambda x: x.isNotNull()).alias("found"))


def issues(reports: DataFrame, utterances: DataFrame, durations: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(meeting_id, kind_ord, idx, check_ord, issue, value) of everything wrong with a report.

    ``reports``: meeting_id, report (normalised). Times are read tolerantly; a time that can't be read
    counts as 0. Order: kind_ord, idx, check_ord."""
    timed = _timed(reports, durations)
    found = _citations(timed, utterances, threshold).select("meeting_id", F.explode("found").alias("f"))
    return found.union(_others(timed).select("meeting_id", F.explode("found").alias("f"))).select("meeting_id", "f.*")


def verify(reports: DataFrame, utterances: DataFrame, durations: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(meeting_id, ok, n_issues, grounding_score); a report without citations is grounded."""
    timed = _timed(reports, durations)
    cites = _citations(timed, utterances, threshold).groupBy("meeting_id").agg(F.sum(F.size("found")).alias("n"), F.avg((F.col("best") >= threshold).cast("double")).alias("score"))
    joined = _others(timed).join(cites, "meeting_id", "left")
    n = F.size("found") + F.coalesce("n", F.lit(0))
    return joined.select("meeting_id", (n == 0).alias("ok"), n.cast("long").alias("n_issues"), F.coalesce("score", F.lit(1.0)).alias("grounding_score"))
