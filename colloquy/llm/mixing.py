"""Mixing sources to target weights by Sainte-Laguë apportionment, with DataFrame operations only.

Targets: sources in order share ``budget`` times all words by weight; no target passes ``epochs``
times its source's size, and what is over is shared again by weight (one water level, found from
running sums over the sources). The total is cut into blocks of ``block`` words, and the blocks are
seats: the k-th seat of a source has the quotient target / (2k - 1), and seats go to the highest
quotients. The order of seats, cut into shards of ``shard_blocks``, gives each shard its integer
quota of each source. Last, a source's documents are laid end to end in a seeded order and the line is
cut into blocks; from a seeded start on, round and round, each shard is dealt as many blocks as its
quota, one shard after another. So documents are taken whole but where a shard or a round ends, none
more than ``epochs`` times.

Scale: seats are ranked within bands of expected rank and offset by the counts of the bands below; a
source's line is summed within 4096 bands of its seeded order and offset likewise; blocks of documents
meet seats by (source, number of the seat), of which each stands once. No task sees a whole source or
all seats. The tables of sources are as long as there are sources.

Edge cases: a null text has no words; null sources are one source, ordered last; documents without
words are kept with nothing taken; rows that repeat, or share an id or have none, are separate
documents (rows are numbered as they are written, and joined by that number); an order without an id
is seeded by the text; an empty table gives an empty result; other columns are carried by ``take`` only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.llm._common import materialize, partitions

#: Fixed: a word is a run of these.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3.0, 1.0, 2.0)
BUDGET, EPOCHS, BLOCK, SHARD_BLOCKS, SEED = 1.5, 2, 128, 1024, "mix-1"
_BANDS_HEX = 3


@dataclass
class Mix:
    """``sources``: source, size, weight, target, seats, blocks, start. ``quotas``: shard, source,
    quota. ``documents``: the rows asked about (uid, doc_id, source, size, source_size, target, taken).
    ``pieces``: uid, shard, round, late (whether it is of the round's end, before the start on the
    line), at (first word), n (words): what each shard takes of a document."""

    sources: DataFrame
    quotas: DataFrame
    documents: DataFrame
    pieces: DataFrame


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _key(source: Column) -> Column:
    """Sources by code point, null last, as one never-null column."""
    return F.coalesce(F.concat(F.lit("0"), source), F.lit("1"))


def _seeded(value: Column, seed: str) -> Column:
    return F.md5(F.concat_ws(":", value, F.lit(seed)))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET, epochs: float = EPOCHS) -> DataFrame:
    """(key, size) with weight and target: min(level * weight, epochs * size), summing to budget * all sizes."""
    by_key = Window.orderBy("key")
    ranked = sizes.withColumn("n", F.row_number().over(by_key) - 1)
    ranked = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("n") % len(weights) + 1).cast("int"))).drop("n")
    limit = F.col("size") * F.lit(float(epochs))
    ranked = ranked.withColumn("limit", limit).withColumn("ratio", limit / F.col("weight"))
    upto = Window.orderBy("ratio", "key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    everything = Window.partitionBy()
    filled = ranked.withColumn("full", F.sum("limit").over(upto)).withColumn("open", F.sum("weight").over(everything) - F.sum("weight").over(upto)).withColumn("goal", F.lit(budget) * F.sum("size").over(everything))
    # the first source at whose ratio the level reaches the goal is the first that does not fill up
    reached = F.col("full") + F.col("ratio") * F.col("open") >= F.col("goal")
    level = F.when(reached, (F.col("goal") - (F.col("full") - F.col("limit"))) / (F.col("open") + F.col("weight")))
    lowest = F.min_by(level, F.when(reached, F.struct("ratio", "key"))).over(everything)
    return filled.withColumn("target", F.least(F.col("limit"), F.coalesce(lowest, F.lit(0.0)) * F.col("weight"))).select("key", "size", "weight", "target")


def _offsets(counts: DataFrame, band: str, count: str) -> DataFrame:
    """(band, offset): the sum of ``count`` in all lower bands, by two levels of windows."""
    grouped = counts.withColumn("g", F.floor(F.col(band) / 1024))
    inner = grouped.withColumn("offset", F.sum(count).over(Window.partitionBy("g").orderBy(band)) - F.col(count))
    tops = grouped.groupBy("g").agg(F.sum(count).alias("t"))
    tops = tops.withColumn("under", F.sum("t").over(Window.orderBy("g")) - F.col("t")).select("g", "under")
    return inner.join(tops, "g").select(band, (F.col("offset") + F.col("under")).alias("offset"))


def allot(goals: DataFrame, block: int = BLOCK, shard_blocks: int = SHARD_BLOCKS) -> DataFrame:
    """(shard, key, k): the seats won, the k-th of its source each, from (key, target); the highest
    quotients win, and shards are cut from the order of quotients."""
    spark = goals.sparkSession
    everything = Window.partitionBy()
    shares = goals.where("target > 0").select("key", "target", F.round(F.sum("target").over(everything) / block).cast("long").alias("seats"), (F.col("target") / F.sum("target").over(everything)).alias("share"))
    # candidates: a source has all but at most half a seat of time * share seats up to a time, so that all of
    # them together have enough by seats + half their number; one more is for rounding
    latest = F.col("seats") + F.count(F.lit(1)).over(everything) / 2
    asked = shares.withColumn("most", F.floor(latest * F.col("share") + 0.5).cast("long") + 1).where("seats > 0")
    runs = asked.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("most") - 1) / 4096)))).repartition(partitions(spark), "key", "run")
    seat = runs.withColumn("k", F.explode(F.sequence(F.col("run") * 4096 + 1, F.least(F.col("run") * 4096 + 4096, F.col("most")))))
    # (2k - 1) / (2 share) rises as the quotient falls, and is about the seat's rank
    seat = seat.select("key", "k", "seats", ((2 * F.col("k") - 1) / (2 * F.col("share"))).alias("time"))
    seat = seat.withColumn("band", F.floor(F.col("time") / shard_blocks).cast("long"))
    seat = materialize(seat, "seats")
    offsets = _offsets(seat.groupBy("band").agg(F.count(F.lit(1)).alias("n")), "band", "n")
    ranked = seat.join(offsets, "band").withColumn("rank", F.col("offset") + F.row_number().over(Window.partitionBy("band").orderBy("time", "key")))
    return ranked.where("rank <= seats").select(F.floor((F.col("rank") - 1) / shard_blocks).cast("long").alias("shard"), "key", "k")


def apportion(goals: DataFrame, block: int = BLOCK, shard_blocks: int = SHARD_BLOCKS) -> DataFrame:
    """(shard, key, quota) from (key, target)."""
    return allot(goals, block, shard_blocks).groupBy("shard", "key").agg(F.count(F.lit(1)).alias("quota"))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET, epochs: int = EPOCHS, block: int = BLOCK, shard_blocks: int = SHARD_BLOCKS, seed: str = SEED, uid: Column | None = None) -> Mix:
    """The mix of ``docs``. ``uid``: a number of each row, if the rows have one."""
    body = F.col(text).cast("string")
    number = F.monotonically_increasing_id() if uid is None else uid
    rows = docs.select(number.alias("uid"), F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), word_count(body).alias("size"), F.xxhash64(body).alias("hash"))
    rows = rows.withColumn("key", _key(F.col("source"))).withColumn("order", _seeded(F.coalesce(F.col("doc_id").cast("string"), F.col("hash").cast("string")), seed))
    rows = materialize(rows.withColumn("band", F.substring("order", 1, _BANDS_HEX)), "sizes")  # rows are numbered here
    bands = materialize(rows.groupBy("key", "band").agg(F.sum("size").alias("size")), "bands")
    goals = materialize(targets(bands.groupBy("key").agg(F.sum("size").alias("size")), weights, budget, epochs), "goals")
    seats = materialize(allot(goals, block, shard_blocks), "allotted")
    quotas = seats.groupBy("shard", "key").agg(F.count(F.lit(1)).alias("quota"))
    plan = goals.join(seats.groupBy("key").agg(F.count(F.lit(1)).alias("seats")), "key", "left").withColumn("seats", F.coalesce("seats", F.lit(0)))
    plan = plan.withColumn("blocks", F.ceil(F.col("size") / block).cast("long"))
    plan = plan.withColumn("start", F.when(F.col("blocks") > 0, F.conv(F.substring(_seeded(F.col("key"), seed), 1, 8), 16, 10).cast("long") % F.col("blocks")).otherwise(F.lit(0)))
    plan = materialize(plan, "plan")
    inside = Window.partitionBy("key").orderBy("band")
    lines = bands.withColumnRenamed("size", "band_size").withColumn("offset", F.sum("band_size").over(inside) - F.col("band_size"))
    lines = lines.join(plan.select("key", "seats", "blocks", "start"), "key").drop("band_size")
    running = Window.partitionBy("key", "band").orderBy("order", "size", "hash", "uid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.where("size > 0").withColumn("stop", F.sum("size").over(running)).join(lines, ["key", "band"]).withColumn("stop", F.col("stop") + F.col("offset")).withColumn("first", F.col("stop") - F.col("size"))
    cut = placed.withColumn("b", F.explode(F.sequence(F.floor(F.col("first") / block), F.floor((F.col("stop") - 1) / block))))
    cut = cut.withColumn("at", F.greatest("first", F.col("b") * block)).withColumn("n", F.least("stop", (F.col("b") + 1) * block) - F.col("at"))
    turns = F.filter(F.sequence(F.lit(0), F.lit(epochs - 1)), lambda e: F.pmod(F.col("b") - F.col("start"), F.col("blocks")) + e * F.col("blocks") < F.col("seats"))
    cut = cut.withColumn("round", F.explode(turns)).withColumn("k", F.pmod(F.col("b") - F.col("start"), F.col("blocks")) + F.col("round") * F.col("blocks") + 1)
    pieces = cut.select("uid", "key", "k", "round", (F.col("b") < F.col("start")).alias("late"), (F.col("at") - F.col("first")).alias("at"), "n").join(seats, ["key", "k"])
    pieces = pieces.groupBy("uid", "shard", "round", "late").agg(F.min("at").alias("at"), F.sum("n").alias("n"))
    pieces = materialize(pieces, "pieces")
    taken = pieces.groupBy("uid").agg(F.sum("n").alias("taken"))
    known = plan.select("key", F.col("size").alias("source_size"), "target")
    documents = rows.join(taken, "uid", "left").join(known, "key").select("uid", "doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
    plain = F.when(F.col("key") != "1", F.substring("key", 2, 1 << 30)).alias("source")
    return Mix(plan.select(plain, "size", "weight", "target", "seats", "blocks", "start"), quotas.select("shard", plain, "quota"), documents, pieces)


def digest(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document."""
    return mix(docs, **options).documents.select("doc_id", "size", "source_size", "target", "taken")


def words_between(text: Column, first: Column, count: Column) -> Column:
    """``count`` words of ``text`` from word ``first`` (0-based) on, with the white space before each."""
    pieces = F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0))
    return F.array_join(F.slice(pieces, (first + 1).cast("int"), count.cast("int")), "")


def take(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shard: str | None = None, **options) -> DataFrame:
    """The mixed documents with the columns of ``docs``: each text once for each round that takes it,
    cut where the round begins or ends within it; a text without words is kept once, since it costs
    nothing. With ``shard``, a column of that name gives the shard, and texts are cut at shards too."""
    kept = materialize(docs.select(F.monotonically_increasing_id().alias("uid"), F.struct(*docs.columns).alias("row")), "numbered")
    flat = kept.select("uid", F.col("row")[doc_id].alias("doc_id"), F.col("row")[text].alias("text"), F.col("row")[options.pop("source", "source")].alias("source"))
    mixed = mix(flat, uid=F.col("uid"), **options)
    place = ["uid", "round", "late", *(["shard"] if shard else [])]
    spans = mixed.pieces.groupBy(*place).agg(F.min("at").alias("at"), F.sum("n").alias("n"))
    blank = mixed.documents.where("size = 0").select("uid", F.lit(0).alias("round"), F.lit(False).alias("late"), *([F.lit(None).cast("long").alias("shard")] if shard else []), F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("n"))
    plan = spans.unionByName(blank)
    body = F.col("row")[text]
    joined = kept.join(plan, "uid")
    whole = (F.col("at") == 0) & (F.col("n") == word_count(body.cast("string")))
    part = F.when(whole, body).otherwise(words_between(body.cast("string"), F.col("at"), F.col("n")))
    columns = [part.alias(c) if c == text else F.char_length(part).cast("long").alias(c) if c == "n_chars" else F.col("row")[c].alias(c) for c in docs.columns if c != shard]
    return joined.select(*columns, *([F.col("shard").alias(shard)] if shard else []))


#: The same rows by SQL: seats ranked by one window, documents by one window a source.
ORACLE_SQL = f"""
with d as (
  select doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint as size, coalesce('0' || source, '1') as key,
    md5(doc_id::varchar || ':{SEED}') as ord from documents),
s as (select key, sum(size)::bigint as size, [3.0::double, 1.0::double, 2.0::double][(row_number() over (order by key) - 1) % 3 + 1] as weight from d group by key),
r as (select *, {float(EPOCHS)}::double * size as lim, {float(EPOCHS)}::double * size / weight as ratio from s),
f as (select *, sum(lim) over (order by ratio, key rows unbounded preceding) as fullsum,
    sum(weight) over () - sum(weight) over (order by ratio, key rows unbounded preceding) as openw, {BUDGET}::double * sum(size) over () as goal from r),
l as (select min((goal - (fullsum - lim)) / (openw + weight)) as level from (select * from f where fullsum + ratio * openw >= goal order by ratio, key limit 1)),
g as (select key, size, least(lim, coalesce(level, 0) * weight) as target from f, l),
t as (select *, round(sum(target) over () / {BLOCK})::bigint as seats_all, target / sum(target) over () as share from g),
n as (select count(*) as sources from t where target > 0),
k as (select key, seats_all, unnest(range(1, floor((seats_all + sources / 2) * share + 0.5)::bigint + 2)) as k, share from t, n where target > 0),
w as (select key, count(*) as seats from (select key, seats_all, row_number() over (order by (2 * k - 1) / (2 * share), key) as rn from k) where rn <= seats_all group by key),
p as (select g.key, g.size as source_size, g.target, coalesce(w.seats, 0) as seats, ceil(g.size / {BLOCK})::bigint as blocks from g left join w using (key)),
q as (select *, case when blocks > 0 then ('0x' || substr(md5(key || ':{SEED}'), 1, 8))::bigint % blocks else 0 end as st from p),
o as (select d.*, sum(size) over (partition by key order by ord, size rows unbounded preceding) as stop from d),
x as (select o.*, o.stop - o.size as first, source_size, target, st, blocks, greatest(0, least(seats, blocks)) as n0, greatest(0, least(seats - blocks, blocks)) as n1 from o join q using (key)),
y as (select *,
    greatest(0, least(stop, (st + n0) * {BLOCK}) - greatest(first, st * {BLOCK})) + greatest(0, least(stop, st * {BLOCK}, greatest(0, (st + n0 - blocks) * {BLOCK})) - first)
  + greatest(0, least(stop, (st + n1) * {BLOCK}) - greatest(first, st * {BLOCK})) + greatest(0, least(stop, st * {BLOCK}, greatest(0, (st + n1 - blocks) * {BLOCK})) - first) as taken from x)
select doc_id, size, source_size, target, taken::bigint as taken from y
"""
