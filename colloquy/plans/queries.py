"""Every query of the conversation operators by name, with SQL where SQL can express it.

Each takes (spark, sf_dir) and runs over its whole tables. Floats are rounded to 6 places at the end, so
that engines which sum in another order agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.functions import reports as R
from colloquy.functions import text as T
from colloquy.functions import vectors as V
from colloquy.operators import audit, clustering, diarize, dsp, grounding, identity, render, runs, speakers, stages, store
from colloquy.operators.matching import top_matches
from colloquy.plans.views import EPOCH, FRAG_SQL, HOUR, SEG_SQL, SOUND_SQL, UTT_SQL, frag, seg, seg_rows, sound, table, utt, vec
from colloquy.sources.shared import new_folder, written
from colloquy.streaming import sessions as streams
from colloquy.streaming import turns

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


r6 = lambda c: F.round(c, 6)

_FILLER = "(" + ", ".join(f"'{f}'" for f in T.FILLERS) + ")"
_PREFIX = r"^(?:\s*(?:" + "|".join(T.PREFIXES) + "))+"
_JUNK = "(" + "|".join(T.JUNK) + ")"
_WS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _kept_sql(source: str, name: str) -> str:
    """The rows of ``source`` that cleaning keeps, with the cleaned text."""
    return f"""{name}_1 as (select *, trim(regexp_replace(trim(text, {_WS}), '{_PREFIX}', '', 'i'), {_WS}) as c from {source}),
{name}_2 as (select *, trim(regexp_replace(c, '{_JUNK}', '', 'gi'), ' -–—') as d from {name}_1 where c <> '' and trim(lower(c), ' .!?-–—') not in {_FILLER} and not (regexp_matches(c, '{_JUNK}', 'i') and length(c) < 60)),
{name} as (select * exclude (text, c, d), d as text from {name}_2 where d <> '' and trim(lower(d), ' .!?-') not in {_FILLER})"""


@query(
    f"""with {FRAG_SQL}, {_kept_sql("frag", "kept")},
f as (select *, case when speaker = lag(speaker) over w and t0 - lag(t1) over w <= 1.2 then 0 else 1 end as fresh from kept window w as (partition by meeting_id order by seq)),
g as (select *, sum(fresh) over (partition by meeting_id order by seq) - 1 as run from f)
select meeting_id, run::bigint as run, min(seq) as seq, arg_min(speaker, seq) as speaker, arg_min(t0, seq) as t0, arg_max(t1, seq) as t1, count(*) as n_frags, string_agg(text, ' ' order by seq) as text from g group by meeting_id, run"""
)
def merge_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.clean_and_merge(frag(spark, sf_dir))


_LITERALS = ("Sujets : Roadmap produit", "Sujets: Intervenants: bonjour", "merci.", "Merci !", " - ", "Sous-titrage ST' 501", "R&D : le budget est voté", "Nous avons parlé longuement du budget de la chaîne radio-canada avec tous les collègues présents", "- bonjour à tous -")


@query(
    f"""with {FRAG_SQL}, src as (select meeting_id, seq, text from frag union all select * from (values {", ".join(f"(-1, {i}, '" + t.replace("'", "''") + "')" for i, t in enumerate(_LITERALS))}) v(meeting_id, seq, text)),
{_kept_sql("src", "kept")} select s.meeting_id, s.seq, k.text from src s left join kept k using (meeting_id, seq)"""
)
def clean_text_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frag(spark, sf_dir).select("meeting_id", "seq", "text")
    literals = spark.range(1).select(F.posexplode(F.array(*map(F.lit, _LITERALS))).alias("seq", "text")).select(F.lit(-1).cast("long").alias("meeting_id"), F.col("seq").cast("long").alias("seq"), "text")
    return rows.union(literals).select("meeting_id", "seq", T.kept_text(F.col("text")).alias("text"))


@query()
def collapse_loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text without its loops; and its first sentence, if it is of 3 to 40 characters, said three times and
    twice (SQL has no back-references)."""
    rows = frag(spark, sf_dir).withColumn("line", F.nullif(F.regexp_extract("text", r"^[^.!?]{3,40}[.!?]", 0), F.lit("")))
    said = lambda n: F.when(F.col("line").isNotNull(), T.collapse_loops(F.concat_ws(" ", *["line"] * n)))
    return rows.select("meeting_id", "seq", T.collapse_loops(F.col("text")).alias("text"), "line", said(3).alias("once"), said(2).alias("twice"))


@query(
    f"""with recursive {SEG_SQL}, s as (select *, row_number() over (partition by recording_id order by idx) as n from seg where label >= 0),
walk as (select recording_id, n, label, t0, t1, t0 as turn_t0, 1 as turn from s where n = 1
  union all select s.recording_id, s.n, s.label, s.t0, s.t1,
    case when s.label = w.label and s.t0 - w.t1 <= {24 * HOUR} and s.t1 - w.turn_t0 <= {24 * HOUR} then w.turn_t0 else s.t0 end,
    case when s.label = w.label and s.t0 - w.t1 <= {24 * HOUR} and s.t1 - w.turn_t0 <= {24 * HOUR} then w.turn else w.turn + 1 end
  from walk w join s on s.recording_id = w.recording_id and s.n = w.n + 1)
select recording_id, label, min(t0) as t0, arg_max(t1, n) as t1, count(*) as n_segs from walk group by recording_id, turn, label"""
)
def merge_turns_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.merge_turns(seg(spark, sf_dir), 24 * HOUR, 24 * HOUR)


@query(
    f"""with {SEG_SQL}, f as (select *, case when label >= 0 then min(idx) over (partition by recording_id, label) end as first from seg)
select recording_id, idx, case when label >= 0 then dense_rank() over (partition by recording_id order by first nulls last) - 1 else label end::int as label from f"""
)
def relabel_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.relabel_first_seen(seg(spark, sf_dir)).select("recording_id", "idx", "label")


@query(
    f"""with recursive {UTT_SQL}, l as (select meeting_id, seq, '[' || round_even(t0, 0)::bigint || 's] ' || speaker || ': ' || text as line from utt),
walk as (select meeting_id, seq, line, length(line) + 1 as size, 0 as chunk from l where seq = 0
  union all select l.meeting_id, l.seq, l.line, case when w.size + length(l.line) > 1500 then 0 else w.size end + length(l.line) + 1, case when w.size + length(l.line) > 1500 then w.chunk + 1 else w.chunk end
  from walk w join l on l.meeting_id = w.meeting_id and l.seq = w.seq + 1)
select meeting_id, chunk::int as chunk, count(*) as n_lines, string_agg(line, chr(10) order by seq) as text from walk group by meeting_id, chunk"""
)
def chunk_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = utt(spark, sf_dir)
    return runs.chunk(stages.chunk_lines(rows, speakers.named_speakers(rows)), 1500)


@query(
    f"""with {UTT_SQL}, s as (select meeting_id, speaker, count(*) as interventions, sum(t1 - t0) as talk_s, sum(len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')))::bigint as words, min(t0) as first_t0 from utt group by meeting_id, speaker)
select *, round(talk_s / sum(talk_s) over (partition by meeting_id), 6) as share from s"""
)
def speaker_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return speakers.speaker_stats(utt(spark, sf_dir)).withColumn("share", r6(F.col("share")))


@query(f"with {UTT_SQL}, d as (select meeting_id, arg_max(t1, seq) as duration from utt group by meeting_id) select meeting_id, duration, printf('%d:%02d:%02d', (duration::double // 3600)::bigint, ((floor(duration)::bigint % 3600) // 60)::bigint, (floor(duration)::bigint % 60)::bigint) as hms, floor(duration)::bigint as back from d")
def duration_hms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last row's end, as H:MM:SS, and read back to seconds."""
    found = runs.durations(utt(spark, sf_dir)).withColumn("hms", T.hms(F.floor("duration")))
    return found.withColumn("back", T.seconds(F.col("hms")))


@query(
    f"""with {UTT_SQL}, n as (select *, row_number() over (partition by meeting_id order by seq) - 1 as pos, count(*) over (partition by meeting_id) as n from utt)
select meeting_id, seq, t0 as t, left(text, 60) as titre, '' as resume from n where pos % greatest(1, n // 8) = 0"""
)
def heuristic_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.chapters(utt(spark, sf_dir))


_NAMES = {"Than": r"\bthan", "Oner": r"oner", "Étion": r"étion", "Sch": r"sch\b"}
_NAMES_SQL = ", ".join(f"('{n}', '{p}')" for n, p in {"Than": r"\bthan", "Oner": "oner", "Étion": "étion", "Sch": r"sch([^\p{L}\p{N}_]|$)"}.items())


_VOTES_SQL = f"""names as (select * from (values {_NAMES_SQL}) v(name, pattern)),
u as (select *, lead(speaker, 1) over w as a, lag(speaker, 1) over w as b, lead(speaker, 2) over w as c from utt window w as (partition by meeting_id order by seq)),
m as (select u.*, name from u join names on regexp_matches(text, pattern, 'i')),
v as (select meeting_id, name, a as speaker, 1.0::double as w from m where a <> m.speaker union all select meeting_id, name, b, 0.6 from m where b <> m.speaker union all select meeting_id, name, c, 0.4 from m where c <> m.speaker),
t as (select meeting_id, name, speaker, sum(w) as votes from v group by all),
g as (select distinct meeting_id, speaker from utt), x as (select g.meeting_id, n.name, g.speaker, coalesce(t.votes, 0) as votes from g cross join names n left join t on t.meeting_id = g.meeting_id and t.name = n.name and t.speaker = g.speaker)"""


@query(
    f"""with {UTT_SQL}, {_VOTES_SQL}
select meeting_id, name, speaker, round(votes, 6) as votes, round(coalesce(votes / nullif(sum(votes) over (partition by meeting_id, speaker), 0), 0), 6) as share from x"""
)
def neighbour_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = speakers.neighbour_votes(utt(spark, sf_dir), _NAMES)
    return found.select("meeting_id", "name", "speaker", r6(F.col("votes")).alias("votes"), r6(F.col("share")).alias("share"))


def _best_sum_sql(pairs: str, left: str, right: str, score: str, most: int) -> str:
    """CTEs that end in best(recording_id, asg): pairs of greatest total over subsets of the right side, for up to ``most``
    on the left and 60 on the right, where the right side is the longer one."""
    steps = [f"lx as (select *, dense_rank() over (partition by recording_id order by {left}) as l, dense_rank() over (partition by recording_id order by {right}) - 1 as r from {pairs})", "nl as (select recording_id, max(l) as n from lx group by recording_id)"]
    steps.append("k_0 as (select recording_id, n, 0::bigint as mask, 0.0::double as total, []::struct(l varchar, r varchar, s double)[] as asg from nl)")
    for t in range(1, most + 1):
        pick = f"list_append(k.asg, {{'l': lx.{left}::varchar, 'r': lx.{right}::varchar, 's': lx.{score}}})"
        steps.append(f"k_{t} as (select recording_id, n, mask, max(total) as total, arg_max(asg, total) as asg from (select k.recording_id, k.n, k.mask | (1::bigint << lx.r) as mask, k.total + lx.{score} as total, {pick} as asg from k_{t - 1} k join lx on lx.recording_id = k.recording_id and lx.l = {t} and k.mask & (1::bigint << lx.r) = 0) group by recording_id, n, mask union all select * from k_{t - 1} where n < {t})")
    steps.append(f"best as (select recording_id, arg_max(asg, total) as asg from k_{most} group by recording_id)")
    return ",\n".join(steps)


_VOTED_SQL = """y as (select meeting_id as recording_id, name, speaker, votes, votes + 1e-6::double * power(2, -row_number() over (partition by meeting_id order by name, speaker)) as score from x)"""


@query(
    f"""with {UTT_SQL}, {_VOTES_SQL}, {_VOTED_SQL}, {_best_sum_sql("y", "speaker", "name", "score", 4)}, won as (select recording_id as meeting_id, unnest(asg) as u from best)
select x.meeting_id, x.speaker, x.name, round(x.votes, 6) as votes, round(coalesce(x.votes / nullif(z.all_votes, 0), 0), 6) as confidence from won join x on x.meeting_id = won.meeting_id and x.speaker = won.u.l and x.name = won.u.r
join (select meeting_id, speaker, sum(votes) as all_votes from x group by all) z on z.meeting_id = x.meeting_id and z.speaker = x.speaker"""
)
def vote_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names given to speakers so that assigned votes are greatest."""
    found = speakers.name_by_votes(utt(spark, sf_dir), _NAMES)
    return found.select("meeting_id", "speaker", "name", r6(F.col("votes")).alias("votes"), r6(F.col("confidence")).alias("confidence"))


@query(f"with {UTT_SQL} select meeting_id, seq, speaker, text from utt where contains(lower(text), 'tion') and speaker in ('user', 'assistant')")
def search_transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    return speakers.search(utt(spark, sf_dir), "tion", ("user", "assistant")).select("meeting_id", "seq", "speaker", "text")


_TOKENS_SQL = r"list_distinct(list_transform(regexp_extract_all({}, '[\p{{L}}\p{{N}}_]+'), lambda x: lower(x)))"


@query(
    f"""with q as (select item_id, {_TOKENS_SQL.format("text")} as t from benchmark), l as (select unnest(string_split(text, chr(10))) as line from documents),
u as (select distinct list_sort({_TOKENS_SQL.format("line")}) as t from l), un as (select row_number() over () as u, t, len(t) as n from u where len(t) > 0),
qw as (select item_id, len(t) as n, unnest(t) as w from q), uw as (select u, n, unnest(t) as w from un),
s as (select item_id, qw.n as nq, u, uw.n as nu, count(*) as hits from qw join uw using (w) group by all), b as (select item_id, max(hits / (nq + nu - hits)) as best from s group by item_id)
select item_id, round(coalesce(best, 0), 6) as best, coalesce(best, 0) >= 0.5 as grounded from benchmark left join b using (item_id)"""
)
def ground_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best overlap of each benchmark item with any line of any document."""
    cites = table(spark, sf_dir, "benchmark").select(F.lit(0).alias("meeting_id"), F.col("item_id").alias("cite_id"), F.col("text").alias("quote"))
    lines = table(spark, sf_dir, "documents").select(F.lit(0).alias("meeting_id"), F.explode(F.split("text", "\n", -1)).alias("text"))
    found = grounding.best_overlap(cites, lines, ["meeting_id"])
    return found.select(F.col("cite_id").alias("item_id"), r6(F.col("best")).alias("best"), (F.col("best") >= grounding.THRESHOLD).alias("grounded"))


def _reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report for each conversation: its third line quoted and a quote of nothing, a chapter too late, an empty action."""
    rows = utt(spark, sf_dir)
    parts = rows.groupBy("meeting_id").agg(F.max_by("t1", "seq").alias("d"), F.min_by("text", "seq").alias("first"), F.max_by("speaker", "seq").alias("last"), F.min_by("speaker", "seq").alias("opener"))
    raw = F.to_json(
        F.struct(
            F.struct(F.lit("Conversation").alias("titre"), F.lit("2024-01-01").alias("date"), F.lit("—").alias("lieu"), T.hms(F.floor("d")).alias("duree")).alias("meta"),
            F.array(F.lit("A & B")).alias("resume"),
            F.lit("one point").alias("points_cles"),
            F.array(F.struct(F.lit("keep it").alias("decision"), F.lit("cost").alias("contexte"))).alias("decisions"),
            F.array(F.struct(F.lit("").alias("action"), F.col("opener").alias("responsable"), F.lit("—").alias("echeance"))).alias("actions"),
            F.array(F.struct(F.lit(5).alias("t"), F.lit("start").alias("titre")), F.struct(F.lit(99999).alias("t"), F.lit("late").alias("titre"))).alias("chapitres"),
            F.array(F.struct(F.col("opener").alias("speaker"), F.col("first").alias("texte"), F.lit(0).alias("t")), F.struct(F.lit("nobody").alias("speaker"), F.lit("zzz qqq").alias("texte"), F.lit(None).cast("int").alias("t"))).alias("citations"),
        )
    )
    found = parts.select("meeting_id", R.normalize_report(raw).alias("report"))
    names = speakers.named_speakers(rows).groupBy("meeting_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("speaker", F.struct("name", "role", F.lit(None).cast("string").alias("person_id")))))).alias("s"))
    return found.join(names, "meeting_id").select("meeting_id", F.col("report").withField("speakers", F.col("s")).alias("report"))


_OUTSIDE = "(t is not null and d <> 0 and not (t between 0 and d + 1))"
_ISSUES_SQL = f"""m as (select meeting_id, arg_max(t1, seq) as d, arg_min(text, seq) as first, arg_min(speaker, seq) as opener, list(distinct speaker) as known from utt group by meeting_id),
c as (select meeting_id, d, known, 0 as idx, first as quote, opener as who, 0 as t from m union all select meeting_id, d, known, 1, 'zzz qqq', 'nobody', null from m),
w as (select meeting_id, seq, {_TOKENS_SQL.format("text")} as u from utt), q as (select *, {_TOKENS_SQL.format("quote")} as tq from c),
o as (select q.meeting_id, q.idx, max(len(list_intersect(tq, u)) / nullif(len(tq) + len(u) - len(list_intersect(tq, u)), 0)) as best from q join w using (meeting_id) group by all),
b as (select q.*, coalesce(o.best, 0) as best from q left join o using (meeting_id, idx)),
late as (select meeting_id, idx, d, t from (select meeting_id, d, 0 as idx, 5 as t from m union all select meeting_id, d, 1, 99999 from m) where {_OUTSIDE}),
issues as (select meeting_id, 0 as kind_ord, idx, 0 as check_ord, 'citation[' || idx || '] not grounded in transcript (overlap=' || printf('%.2f', round_even(best, 2)) || ')' as issue, best as value from b where best < 0.5
  union all select meeting_id, 0, idx, 1, 'citation[' || idx || '] references unknown speaker ' || chr(39) || who || chr(39), null from b where who <> '' and not list_contains(known, who)
  union all select meeting_id, 0, idx, 2, 'citation[' || idx || '] timestamp ' || t || ' outside [0, ' || round_even(d, 0)::bigint || ']', d from b where {_OUTSIDE}
  union all select meeting_id, 1, idx, 0, 'chapitre[' || idx || '] timestamp ' || t || ' outside [0, ' || round_even(d, 0)::bigint || ']', d from late
  union all select meeting_id, 3, 0, 0, 'action[0] is empty', null from m)"""


@query(
    f"""with {UTT_SQL}, {_ISSUES_SQL}, n as (select meeting_id, count(*) as n from issues group by meeting_id), g as (select meeting_id, avg((best >= 0.5)::int) as score from b group by meeting_id)
select m.meeting_id, n.n is null as ok, coalesce(n.n, 0) as n_issues, score as grounding_score from m left join n using (meeting_id) join g using (meeting_id)"""
)
def verify_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = utt(spark, sf_dir)
    return grounding.verify(_reports(spark, sf_dir), rows, runs.durations(rows))


@query(f"with {UTT_SQL}, {_ISSUES_SQL} select meeting_id, kind_ord, idx, check_ord, issue, round(value, 6) as value from issues")
def report_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = utt(spark, sf_dir)
    return grounding.issues(_reports(spark, sf_dir), rows, runs.durations(rows)).withColumn("value", r6(F.col("value")))


_UNIT_SQL = "list_transform(embedding::double[], lambda x: x / (sqrt(list_dot_product(embedding::double[], embedding::double[])) + 1e-9))"
_CENT_SQL = f"""u as (select vec_id, label, vec_id % 2 as half, {_UNIT_SQL} as e from embeddings where label >= 0),
x as (select half, label, unnest(e) as v, generate_subscripts(e, 1) as i from u), a as (select half, label, i, avg(v) as m from x group by all),
n as (select half, label, sqrt(sum(m * m)) + 1e-9 as n from a group by half, label), c as (select half, label, i, m / n.n as v from a join n using (half, label))"""


@query(f"with {_CENT_SQL} select half, label, i::int as i, round(v, 6) as v from c")
def cluster_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vec(spark, sf_dir).withColumn("half", F.col("vec_id") % 2)
    found = identity.centroids(rows, ["half"]).select("half", "label", F.posexplode("centroid").alias("i", "v"))
    return found.select("half", "label", (F.col("i") + 1).alias("i"), r6(F.col("v")).alias("v"))


@query(
    f"""with {_CENT_SQL}, g as (select i, avg(v) as m from (select unnest(e) as v, generate_subscripts(e, 1) as i from u) group by i), gn as (select sqrt(sum(m * m)) + 1e-9 as n from g),
d as (select half, label, c.i, v - m / n as v from c join g using (i), gn), dn as (select half, label, sqrt(sum(v * v)) + 1e-9 as n from d group by half, label)
select half, label, i::int as i, round(v / n, 6) as v from d join dn using (half, label)"""
)
def global_mean_recentre(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vec(spark, sf_dir).where("label >= 0").withColumn("half", F.col("vec_id") % 2)
    cents = identity.recentred(identity.centroids(rows, ["half"]), identity.global_mean(rows), "centroid")
    found = cents.select("half", "label", F.posexplode("centroid").alias("i", "v"))
    return found.select("half", "label", (F.col("i") + 1).alias("i"), r6(F.col("v")).alias("v"))


def _clusters_and_persons(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Persons: centroids of even vectors; clusters of 10 recordings: centroids of odd ones."""
    rows = vec(spark, sf_dir)
    persons = identity.centroids(rows.where("vec_id % 2 = 0").withColumn("half", F.lit(0)), ["half"])
    persons = persons.select(F.format_string("p%02d", "label").alias("person_id"), F.format_string("Person %d", "label").alias("name"), F.lit("").alias("role"), "centroid", F.lit(0).cast("long").alias("n_exemplars"))
    clusters = identity.centroids(rows.where("vec_id % 2 = 1").withColumn("recording_id", F.floor(F.col("vec_id") / 2) % 10), ["recording_id"])
    return clusters, persons


_MATCH_SQL = f"""eu as (select vec_id, label, {_UNIT_SQL} as e from embeddings where label >= 0),
px as (select label, unnest(e) as v, generate_subscripts(e, 1) as i from eu where vec_id % 2 = 0), pm as (select label, i, avg(v) as m from px group by all), pn as (select label, sqrt(sum(m * m)) + 1e-9 as n from pm group by label),
p as (select printf('p%02d', label) as person_id, label as person, i, m / n as v from pm join pn using (label)),
rx as (select (vec_id // 2) % 10 as recording_id, label, unnest(e) as v, generate_subscripts(e, 1) as i from eu where vec_id % 2 = 1), rm as (select recording_id, label, i, avg(v) as m from rx group by all), rn as (select recording_id, label, sqrt(sum(m * m)) + 1e-9 as n from rm group by all),
r as (select recording_id, label, i, m / n as v from rm join rn using (recording_id, label)),
s as (select recording_id, label, person_id, sum(r.v * p.v) as score from r join p using (i) group by all)"""


@query(f"with {_MATCH_SQL} select recording_id, label, person_id, round(score, 6) as score from s")
def match_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.match_matrix(*_clusters_and_persons(spark, sf_dir)).withColumn("score", r6(F.col("score")))


@query(f"with {_MATCH_SQL}, k as (select *, row_number() over (partition by recording_id, label order by score desc, person_id) as n from s) select recording_id, label, person_id, round(score, 6) as score from k where n <= 3")
def match_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best persons of each cluster."""
    return top_matches(*_clusters_and_persons(spark, sf_dir), 3).withColumn("score", r6(F.col("score")))


_CENTRED_SQL = f"""un as (select vec_id // 50 as recording_id, vec_id, label, {_UNIT_SQL} as e from embeddings where label >= 0),
cx as (select recording_id, vec_id, label, unnest(e) as v, generate_subscripts(e, 1) as i from un), cm as (select recording_id, i, avg(v) as m from cx group by all),
cd as (select recording_id, vec_id, label, i, v - m as v from cx join cm using (recording_id, i)), cn as (select vec_id, sqrt(sum(v * v)) + 1e-9 as n from cd group by vec_id),
cu as (select recording_id, vec_id, label, list(v / n order by i) as e from cd join cn using (vec_id) group by all)"""


@query(
    f"""with {_CENTRED_SQL}, p as (select a.recording_id, a.vec_id, a.label as own, b.label as other, avg(1 - list_dot_product(a.e, b.e)) as d from cu a join cu b on a.recording_id = b.recording_id and a.vec_id <> b.vec_id group by all),
s as (select recording_id, vec_id, max(case when own = other then d end) as w, min(case when own <> other then d end) as b from p group by all)
select u.recording_id, round(avg(case when w is null or b is null or greatest(w, b) <= 0 then 0 else (b - w) / greatest(w, b) end), 6) as silhouette, count(*) as n from (select distinct recording_id, vec_id from cu) u left join s using (recording_id, vec_id) group by u.recording_id"""
)
def silhouette(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well the given labels part recordings of 50 embeddings each."""
    rows = vec(spark, sf_dir).where("label >= 0").select(F.floor(F.col("vec_id") / 50).alias("recording_id"), "embedding", "label")
    return clustering.silhouettes(clustering.centred(rows)).withColumn("silhouette", r6(F.col("silhouette")))


@query(
    f"""with {_MATCH_SQL}, {_best_sum_sql("s", "label", "person_id", "score", 10)}, t as (select recording_id, u.l::int as label, u.r as person_id, u.s as score from (select recording_id, unnest(asg) as u from best))
select c.recording_id, c.label, case when score >= 0.1 then t.person_id end as person_id, case when score >= 0.1 then 'Person ' || substr(t.person_id, 2)::int else 'S' || c.label end as name, round(coalesce(score, 0), 3) as confidence, case when score >= 0.2 then 'auto' when score >= 0.1 then 'suggest' else 'unknown' end as mode
from (select distinct recording_id, label from r) c left join t on t.recording_id = c.recording_id and t.label = c.label"""
)
def identify_optimal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.identify(*_clusters_and_persons(spark, sf_dir), high=0.2, low=0.1)


@query(
    f"""with recursive {_MATCH_SQL}, k as (select *, row_number() over (partition by recording_id order by score desc, label, person_id) as rn from s where score >= 0.1),
walk as (select distinct recording_id, 0::bigint as rn, []::int[] as ls, []::varchar[] as ps, null::int as label, null::varchar as person_id, null::double as score from r
  union all select w.recording_id, k.rn, case when ok then list_append(ls, k.label) else ls end, case when ok then list_append(ps, k.person_id) else ps end, case when ok then k.label end, case when ok then k.person_id end, k.score
  from walk w, lateral (select k.*, not list_contains(w.ls, k.label) and not list_contains(w.ps, k.person_id) as ok from k where k.recording_id = w.recording_id and k.rn = w.rn + 1) k),
t as (select recording_id, label, person_id, score from walk where label is not null)
select c.recording_id, c.label, t.person_id, coalesce('Person ' || substr(t.person_id, 2)::int, 'S' || c.label) as name, round(coalesce(score, 0), 3) as confidence, case when score >= 0.2 then 'auto' when score >= 0.1 then 'suggest' else 'unknown' end as mode
from (select distinct recording_id, label from r) c left join t on t.recording_id = c.recording_id and t.label = c.label"""
)
def identify_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.identify(*_clusters_and_persons(spark, sf_dir), high=0.2, low=0.1, method="greedy")


_EX_SQL = f"ex as (select vec_id, label, {_UNIT_SQL} as e from embeddings where label >= 0)"


@query(
    f"""with {_EX_SQL}, x as (select label, unnest(e) as v, generate_subscripts(e, 1) as i from ex), a as (select label, i, avg(v) as m from x group by all), n as (select label, sqrt(sum(m * m)) + 1e-9 as n from a group by label),
c as (select label, list(m / n order by i) as c from a join n using (label) group by label), own as (select list_dot_product(e, c) as s from ex join c using (label)),
t as (select quantile_cont(s, 0.1) as p10, avg(s) as mi from own), o as (select coalesce(avg(list_dot_product(a.c, b.c)), 0) as mo from c a join c b on a.label < b.label), h as (select least(greatest(p10, 0.4), 0.9) as hi, (mi + mo) / 2 as mid from t, o)
select round(least(greatest(mid, 0.3), hi - 0.05), 3) as tau_low, round(hi, 3) as tau_high from h"""
)
def calibrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vec(spark, sf_dir).where("label >= 0")
    persons = identity.centroids(rows.withColumn("k", F.lit(0)), ["k"]).select(F.col("label").alias("person_id"), "centroid")
    return identity.calibrate(persons, rows.select(F.col("label").alias("person_id"), "embedding"))


def _exemplars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vec(spark, sf_dir).where("label >= 0").select(F.format_string("p%02d", "label").alias("person_id"), F.col("vec_id").alias("seq"), (F.col("vec_id") % 7).cast("double").alias("ts"), "embedding")


@query("with r as (select printf('p%02d', label) as person_id, vec_id as seq, row_number() over (partition by label order by vec_id % 7 desc, vec_id) as n from embeddings where label >= 0) select person_id, seq from r where n <= 32")
def exemplar_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.newest(_exemplars(spark, sf_dir), 32).select("person_id", "seq")


_ENROLLED = "case when c_custkey % 5 = 0 then 'Customer' when c_custkey % 11 = 0 then 'Customer 2' else 'Customer ' || (c_custkey % 50) end"


@query(
    f"""with recursive names as (select c_custkey as ord, {_ENROLLED} as name, row_number() over (order by c_custkey) as n from customer), s as (select *, replace(lower(name), ' ', '-') as slug from names),
walk as (select 0::bigint as n, null::bigint as ord, null::varchar as name, null::varchar as id, ['customer-7', 'customer-7-2'] as taken
  union all select n, ord, name, id, list_append(taken, id) from (
    select s.n, s.ord, s.name, w.taken, list_filter(list_prepend(s.slug, list_transform(range(2, 3 + len(w.taken)), lambda k: s.slug || '-' || k)), lambda x: not list_contains(w.taken, x))[1] as id from walk w join s on s.n = w.n + 1) z)
select ord, name, id as person_id from walk where n > 0"""
)
def enroll_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids for the customers' names, some of which are numbers of others, beside a store of two."""
    names = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("ord"), F.expr(_ENROLLED).alias("name"))
    taken = spark.range(1).select(F.explode(F.array(F.lit("customer-7"), F.lit("customer-7-2"))).alias("person_id"))
    return identity.unique_ids(names, taken).select("ord", "name", "person_id")


@query(
    f"""with {_EX_SQL}, k as (select printf('p%02d', label) as person_id, e, row_number() over (partition by label order by vec_id % 7 desc, vec_id) as n from ex where label not in (3)), x as (select person_id, unnest(e) as v, generate_subscripts(e, 1) as i from k where n <= 64),
a as (select person_id, i, avg(v) as m from x group by all), n as (select person_id, sqrt(sum(m * m)) + 1e-9 as n from a group by person_id), c as (select person_id, count(*) as n_exemplars from k where n <= 64 group by person_id)
select a.person_id, c.n_exemplars, round(max(case when i = 1 then m / n end), 6) as first from a join n using (person_id) join c using (person_id) group by all"""
)
def store_upkeep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store built by pushing all exemplars, one person forgotten."""
    new = _exemplars(spark, sf_dir)
    persons = new.select("person_id").distinct().select("person_id", F.col("person_id").alias("name"), F.lit("").alias("role"), F.array().cast("array<double>").alias("centroid"), F.lit(0).cast("long").alias("n_exemplars"))
    persons, held = identity.push(persons, new.limit(0), new)
    persons, _ = identity.forget(persons, held, ["p03"])
    return persons.select("person_id", "n_exemplars", r6(F.col("centroid")[0]).alias("first"))


@query(
    """with p as (select label, count(*) as n, label % 3 as slug, row_number() over (partition by label % 3 order by label) as k from embeddings where label >= 0 group by label)
select case when k = 1 then 'voice-' || slug else 'voice-' || slug || '-' || k end as person_id, 'Voice ' || slug as name, least(n, 64) as n_exemplars from p"""
)
def voice_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The people of a store that all embeddings were enrolled in, a person for each label and three names for all."""
    kept = store.VoiceStore(spark, new_folder(spark, "voices"))
    rows = vec(spark, sf_dir).where("label >= 0")
    kept.enroll(rows.select(F.col("label").alias("ord"), F.concat(F.lit("Voice "), F.col("label") % 3).alias("name"), F.lit("").alias("role"), F.col("vec_id").alias("seq"), "embedding"))
    return kept.people().select("person_id", "name", "n_exemplars")


_NAMED = "case vec_id % 5 when 0 then 'S' || label when 1 then 'ss0' || label when 2 then cast(label as string) when 3 then 'cluster ' || label else 'S' end"


@query(f"""select vec_id, name, case when regexp_matches(regexp_replace(name, '^[Ss]+', ''), '^-?[0-9]+$') then regexp_replace(name, '^[Ss]+', '')::int end as number from (select vec_id, {_NAMED} as name from embeddings)""")
def cluster_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters as users name them, read back to numbers."""
    rows = vec(spark, sf_dir).select("vec_id", F.expr(_NAMED).alias("name"))
    return rows.withColumn("number", T.cluster_number(F.col("name")))


_DRIFT = (
    '{"resume": "One text", "points_cles": [1, "two", null], "themes": [{"theme": ["A", "B"], "points": "solo"}], "citations": ["just words"], "decisions": null, "chapitres": [{"t": "0:00:28", "titre": "x"}]}',
    'Here it is: {"actions": "call them", "resume": []} thank you',
    "no object at all",
    '{"resume": "cut off',
    "",
)


_EMPTY = '{"meta":{},"speakers":{},"resume":[],"points_cles":[],"decisions":[],"actions":[],"chapitres":[],"themes":[],"citations":[]}'
#: What the literal reports are to become, written by hand.
_BROUGHT = (
    '{"meta":{},"speakers":{},"resume":["One text"],"points_cles":["1","two"],"decisions":[],"actions":[],"chapitres":[{"titre":"x","resume":"","t":"0:00:28"}],"themes":[{"theme":"A B","points":["solo"]}],"citations":[{"texte":"just words"}]}',
    _EMPTY.replace('"actions":[]', '"actions":[{"action":"call them"}]'),
    _EMPTY,
    _EMPTY,
    _EMPTY,
)


@query(
    f"""with e as (select event_id, event_type as e, props->>'$.k' as k from events)
select * from (values {", ".join(f"({-1 - i}::bigint, '{r}')" for i, r in enumerate(_BROUGHT))}) v(id, report) union all select event_id, '{_EMPTY}' from e union all
select event_id + 1000000000, '{{"meta":{{}},"speakers":{{}},"resume":["' || e || '"],"points_cles":["' || k || '","' || e || '"],"decisions":[{{"decision":"' || e || '"}}],"actions":[{{"action":"do ' || e || '"}}],"chapitres":[],"themes":[{{"theme":"' || e || ' ' || k || '","points":["' || k || '"]}}],"citations":[]}}' from e"""
)
def normalize_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drifting reports, the events' properties as raw texts, and reports that drift, made of each event."""
    literals = spark.range(1).select(F.posexplode(F.array(*map(F.lit, _DRIFT))).alias("id", "raw")).select((-1 - F.col("id")).cast("long").alias("id"), "raw")
    events = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k"))
    made = F.format_string('so: {"resume": "%1$s", "points_cles": [%2$s, ["%1$s", null]], "decisions": ["%1$s"], "actions": "do %1$s", "themes": {"theme": ["%1$s", %2$s], "points": %2$s}} end', "event_type", "k")
    rows = literals.union(events.select("event_id", "props")).union(events.select(F.col("event_id") + 1_000_000_000, made))
    return rows.select("id", F.to_json(R.normalize_report(F.col("raw"))).alias("report"))


@query("select event_id, try_cast(props as json) is not null as valid from events")
def valid_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    from colloquy.sources.readers import valid_json

    return table(spark, sf_dir, "events").select("event_id", F.coalesce(valid_json(F.col("props")), F.lit(False)).alias("valid"))


_HMS_SQL = "printf('%d:%02d:%02d', ({0}::bigint // 3600), (({0}::bigint % 3600) // 60), ({0}::bigint % 60))"


@query(
    f"""with {UTT_SQL}, m as (select meeting_id, arg_max(t1, seq) as d, arg_min(text, seq) as first, arg_min(speaker, seq) as opener, string_agg('`' || {_HMS_SQL.format("floor(t0)")} || '` **' || speaker || '** : ' || text, chr(10) order by seq) as said from utt group by meeting_id),
n as (select meeting_id, string_agg(distinct speaker, ', ' order by speaker) as people from utt group by meeting_id)
select meeting_id, '# Conversation' || chr(10) || chr(10) || '**Date** : 2024-01-01  ·  **Durée** : ' || {_HMS_SQL.format("floor(d)")} || chr(10) || chr(10) || '**Participants** : ' || people || chr(10) || chr(10)
 || chr(10) || '## Résumé' || chr(10) || chr(10) || 'A & B' || chr(10) || chr(10) || '## Points clés' || chr(10) || chr(10) || '- one point' || chr(10) || chr(10) || '## Décisions' || chr(10) || chr(10) || '- ✓ **keep it** — cost' || chr(10)
 || chr(10) || '## Actions' || chr(10) || chr(10) || '| Action | Responsable | Échéance |' || chr(10) || '|---|---|---|' || chr(10) || '|  | ' || opener || ' | — |' || chr(10)
 || chr(10) || '## Chapitres' || chr(10) || chr(10) || '- `0:00:05` **start**' || chr(10) || '- `27:46:39` **late**' || chr(10)
 || chr(10) || '## Citations' || chr(10) || chr(10) || '> « ' || trim(first, {_WS}) || ' »' || chr(10) || '> — ' || opener || ' · 0:00:00' || chr(10) || chr(10) || '> « zzz qqq »' || chr(10) || '> — nobody' || chr(10) || chr(10)
 || chr(10) || '## Transcript' || chr(10) || chr(10) || said || chr(10) as content from m join n using (meeting_id)"""
)
def render_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.markdown(_reports(spark, sf_dir), utt(spark, sf_dir))


@query()
def render_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.html(_reports(spark, sf_dir), utt(spark, sf_dir))


@query(
    f"""with {UTT_SQL}, m as (select meeting_id, arg_max(t1, seq) as d, arg_min(text, seq) as first, arg_min(speaker, seq) as opener from utt group by meeting_id),
p as (select meeting_id, string_agg(distinct '"[[' || speaker || ']]"', ', ' order by '"[[' || speaker || ']]"') as people from utt group by meeting_id),
n as (select 'Meetings/2024-01-01 Conversation ' || meeting_id || '.md' as path, '---' || chr(10) || 'type: meeting' || chr(10) || 'date: 2024-01-01' || chr(10) || 'lieu: "—"' || chr(10) || 'duree: "' || {_HMS_SQL.format("floor(d)")} || '"' || chr(10) || 'participants: [' || people || ']' || chr(10) || '---' || chr(10)
  || chr(10) || '# Conversation ' || meeting_id || chr(10) || chr(10) || '## Résumé' || chr(10) || 'A & B' || chr(10) || chr(10) || '## Décisions' || chr(10) || '- ✓ **keep it** — cost' || chr(10) || chr(10)
  || '## Actions' || chr(10) || '- [ ]  [[' || opener || ']]' || chr(10) || chr(10) || '## Citations' || chr(10) || '> « ' || trim(first, {_WS}) || ' » — [[' || opener || ']] · 0:00:00' || chr(10) || '> « zzz qqq » — [[nobody]]' as content from m join p using (meeting_id)
  union all select distinct 'People/' || trim(regexp_replace(speaker, '\\s+', ' ', 'g')) || '.md', '---' || chr(10) || 'type: person' || chr(10) || 'role: ""' || chr(10) || '---' || chr(10) || chr(10) || '# ' || speaker from utt)
select path, content || chr(10) || chr(10) || '{render.MARKER}' || chr(10) || 'mine ' || path as content from n"""
)
def vault_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A note for each meeting and person, written twice: what stood below the marker of the first copy is kept."""
    title = F.concat(F.lit("Conversation "), F.col("meeting_id").cast("string"))
    reports = _reports(spark, sf_dir).withColumn("report", F.col("report").withField("meta", F.col("report.meta").withField("titre", title)))
    notes = written(render.vault(reports).select("path", "content").distinct(), "notes")  # persons are named by several meetings
    old = notes.select("path", F.concat(F.lit("old"), F.lit("\n\n" + render.MARKER + "\nmine "), F.col("path")).alias("content"))
    return render.preserve(notes, old)


@query("""select doc_id, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') as escaped from documents""")
def html_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.html_escape(F.col("text")).alias("escaped"))


@query(
    """with l as (select url as path, unnest(string_split(url || chr(10) || html, chr(10))) as line from pages), h as (select path, count(*) as hits from l where regexp_matches(line, 'https?://') group by path)
select p.url as path, coalesce(h.hits, 0) as hits from (select distinct url from pages) p left join h on h.path = p.url"""
)
def audit_egress(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "pages").select(F.col("url").alias("path"), F.concat("url", F.lit("\n"), "html").alias("content"))
    return audit.counts(files)


_VOICE = {"rate": 800, "quantile": 0.2, "scale": 3.0, "min_s": 0.05}


@query(
    f"""with {SOUND_SQL}, tot as (select recording_id, max(p) + 1 as total from snd group by recording_id),
e as (select recording_id, p // 8 - k as frame, sqrt(sum(x * x) / 24) as energy from snd join tot using (recording_id), range(3) r(k) where p // 8 >= k and (p // 8 - k) * 8 + 24 <= total group by all),
r as (select *, row_number() over (partition by recording_id order by energy) - 1 as rk, count(*) over (partition by recording_id) as n from e), t as (select recording_id, energy * 3.0::double as lim from r where rk = least(n - 1, floor(n * 0.2::double)::bigint)),
v as (select e.recording_id, frame, case when frame - lag(frame) over (partition by e.recording_id order by frame) <= 21 then 0 else 1 end as fresh from e join t using (recording_id) where energy >= lim),
g as (select *, sum(fresh) over (partition by recording_id order by frame) as run from v),
s as (select recording_id, min(frame) * 0.01::double as t0, max(frame) * 0.01::double + 0.03::double as t1 from g group by recording_id, run),
k as (select *, row_number() over (partition by recording_id order by t0) - 1 as idx, floor(t0 * 800)::bigint as a, floor(t1 * 800)::bigint as b from s where t1 - t0 >= 0.05::double)
select k.recording_id, idx, round(t0, 6) as t0, round(t1, 6) as t1, count(p) as n_samples, count(p) >= 200 as usable, round(case when count(p) >= 200 then sqrt(sum(x * x) / count(p)) else 0 end, 6) as rms
from k left join snd on snd.recording_id = k.recording_id and p >= a and p < b group by all"""
)
def diarize_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Voiced segments of sound with the samples they cut out of stored frames."""
    found = diarize.segments_with_sound(sound(spark, sf_dir), diarize.energy_activity(**_VOICE), _VOICE["rate"])
    return found.select("recording_id", "idx", r6(F.col("t0")).alias("t0"), r6(F.col("t1")).alias("t1"), "n_samples", "usable", r6(dsp.rms(F.col("signal"))).alias("rms"))


@query()
def diarize_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of clustered segments; clustering has no SQL."""
    embed = lambda rows: dsp.embed(rows, frame=64, hop=32, lags=(1, 2, 4, 8)).withColumnRenamed("features", "embedding")
    found = diarize.diarize(sound(spark, sf_dir), diarize.energy_activity(**_VOICE), embed, _VOICE["rate"])
    return found.turns.select("recording_id", "label", r6(F.col("t0")).alias("t0"), r6(F.col("t1")).alias("t1"), "n_segs")


@query(
    """with e as (select user_id as recording_id, value as energy, row_number() over (partition by user_id order by ts, event_id) - 1 as frame from events),
r as (select *, row_number() over (partition by recording_id order by energy) - 1 as rk, count(*) over (partition by recording_id) as n from e), t as (select recording_id, energy * 1.4::double as lim from r where rk = least(n - 1, floor(n * 0.5)::bigint)),
v as (select e.recording_id, frame, case when frame - lag(frame) over (partition by e.recording_id order by frame) <= 21 then 0 else 1 end as fresh from e join t using (recording_id) where energy >= lim),
g as (select *, sum(fresh) over (partition by recording_id order by frame) as run from v), s as (select recording_id, min(frame) * 0.01::double as t0, max(frame) * 0.01::double + 0.03::double as t1 from g group by recording_id, run)
select recording_id, round(t0, 6) as t0, round(t1, 6) as t1 from s where t1 - t0 >= 0.05::double"""
)
def energy_vad(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events' values as the energies of each user's frames (stretches of 0.05 s or more)."""
    from pyspark.sql import Window

    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("recording_id"), F.col("value").alias("energy"), (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).alias("frame"))
    found = dsp.voiced_segments(rows, min_s=0.05)
    return found.select("recording_id", r6(F.col("t0")).alias("t0"), r6(F.col("t1")).alias("t1"))


_AC_SQL = ", ".join(f"list_dot_product(f[1:{32 - k}], f[{k + 1}:32]) / (list_dot_product(f, f) + 1e-9)" for k in (1, 2, 4, 8))


@query(
    f"""with f as (select vec_id, embedding[8 * k + 1 : 8 * k + 32]::double[] as f from embeddings, range(5) r(k)),
t as (select vec_id, unnest([sqrt(list_dot_product(f, f) / 32), list_sum(list_transform(range(1, 32), lambda i: case when (f[i] >= 0) <> (f[i + 1] >= 0) then 1.0::double else 0.0::double end)) / 31, {_AC_SQL}]) as x, unnest(range(6)) as track from f),
m as (select vec_id, track, avg(x) as a, stddev_pop(x) as d from t group by all), v as (select vec_id, track as i, a as v from m union all select vec_id, track + 6, d from m),
n as (select vec_id, sqrt(sum(v * v)) + 1e-9 as n from v group by vec_id)
select vec_id, i::int as i, round(v / n, 6) as v from v join n using (vec_id)"""
)
def dsp_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings as signals of 64 samples, in frames of 32."""
    found = dsp.embed(vec(spark, sf_dir), "embedding", 32, 8, (1, 2, 4, 8))
    return found.select("vec_id", F.posexplode("features").alias("i", "v")).withColumn("v", r6(F.col("v")))


@query("select vec_id, round(sqrt(list_dot_product(embedding::double[], embedding::double[]) / len(embedding)), 6) as rms from embeddings")
def signal_rms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vec(spark, sf_dir).select("vec_id", r6(dsp.rms(F.col("embedding"))).alias("rms"))


@query()
def cluster_agglomerative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings of 50 embeddings each, the number of speakers estimated."""
    rows = vec(spark, sf_dir).select(F.floor(F.col("vec_id") / 50).alias("recording_id"), F.col("vec_id").alias("idx"), "embedding")
    return clustering.cluster_recordings(rows)


@query(
    """with e as (select *, case when ts - lag(ts) over (partition by user_id order by ts) <= interval 12 hour then 0 else 1 end as fresh from events), g as (select *, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as s from e)
select user_id, epoch_us(min(ts)) as start, epoch_us(max(ts) + interval 12 hour) as stop, count(*) as n, round(sum(value), 6) as total from g group by user_id, s"""
)
def session_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of the events with gaps up to 12 hours (the form a stream uses, run over all rows)."""
    found = streams.sessions(table(spark, sf_dir, "events"), watermark=None)
    return found.select("user_id", F.unix_micros("start").alias("start"), F.unix_micros("end").alias("stop"), "n", r6(F.col("total")).alias("total"))


@query(
    f"""with recursive {SEG_SQL}, w as (select (epoch_us(max(ts)) // 1000 - 3600000) * 1000 - {EPOCH} as w from events),
s as (select seg.*, row_number() over (partition by recording_id order by idx) as n from seg, w where label >= 0 and (t0 + {EPOCH}) // 1000 * 1000 - {EPOCH} < w),
walk as (select recording_id, n, label, t0, t1, t0 as turn_t0, 1 as turn from s where n = 1
  union all select s.recording_id, s.n, s.label, s.t0, s.t1,
    case when s.label = k.label and s.t0 - k.t1 <= {24 * HOUR} and s.t1 - k.turn_t0 <= {24 * HOUR} then k.turn_t0 else s.t0 end,
    case when s.label = k.label and s.t0 - k.t1 <= {24 * HOUR} and s.t1 - k.turn_t0 <= {24 * HOUR} then k.turn else k.turn + 1 end
  from walk k join s on s.recording_id = k.recording_id and s.n = k.n + 1),
t as (select recording_id, label, min(t0) as t0, arg_max(t1, n) as t1, count(*) as n_segs, turn, max(turn) over (partition by recording_id) as latest from walk group by recording_id, turn, label)
select recording_id, label, t0, t1, n_segs from t, w where turn < latest or t1 + {24 * HOUR} < w"""
)
def stream_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of the events as a stream that have closed when all has been read."""
    path = f"{sf_dir}/events.parquet"
    events = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path + "*")  # a pattern may name a file
    rows = seg_rows(events).select("recording_id", (F.col("t0") + EPOCH).alias("t0"), (F.col("t1") + EPOCH).alias("t1"), "label", F.col("event_id").alias("ord"))
    found = turns.run_to_table(turns.ordered_turns(rows, 24 * HOUR, 24 * HOUR), "turns")
    return found.select("recording_id", "label", (F.col("t0") - EPOCH).alias("t0"), (F.col("t1") - EPOCH).alias("t1"), "n_segs")


@query("select user_id, epoch_us(time_bucket(interval 30 second, ts)) as start, count(*) as n from events group by all")
def stream_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tumbling frames of 30 seconds."""
    return streams.frames(table(spark, sf_dir, "events"), watermark=None).select("user_id", F.unix_micros("start").alias("start"), "n")


@query()
def synthesize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports by a stand-in model that quotes each chunk's first line; every seventh meeting has no model."""

    def model(task: str, text: str) -> str:
        import json

        if task.startswith("map"):
            return "notes: " + json.dumps({"points": [text.split("\n")[0][:80]]})
        if "[0s]" in text and len(text) % 7 == 0:
            raise RuntimeError("no answer")
        return json.dumps({"resume": "All of it", "points_cles": [len(text)], "citations": [{"speaker": "user", "texte": text[:20], "t": 1}]})

    rows = utt(spark, sf_dir)
    found = stages.synthesize(rows, speakers.named_speakers(rows), model, title="T", date="2024-01-01", context="names")
    return found.select("meeting_id", "source", F.to_json("report").alias("report"))


@query(f"with {UTT_SQL} select distinct meeting_id, speaker, case speaker when 'user' then 'Alice' else speaker end as name, '' as role from utt")
def load_speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = utt(spark, sf_dir)
    mapping = rows.where("speaker = 'user'").select("meeting_id", "speaker").distinct().withColumn("name", F.lit("Alice"))
    return speakers.named_speakers(rows, mapping)
