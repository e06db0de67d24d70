"""Voice identity: centroids, matching against known persons, calibration, and the store's upkeep.

The store is a pair of tables, persons (person_id, name, role, centroid, n_exemplars) and exemplars
(person_id, seq, ts, embedding). Changes derive new tables from old ones; nothing is updated in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions import text as T
from colloquy.functions import vectors as V
from colloquy.operators.assignment import assign
from colloquy.operators.matching import all_matches, top_matches
from colloquy.operators.ranks import quantile
from colloquy.sources.shared import written

TAU_HIGH, TAU_LOW, RING = 0.62, 0.45, 64


def centroids(rows: DataFrame, by: list[str], vector: str = "embedding", label: str = "label") -> DataFrame:
    """Unit mean of unit rows for each key and label of 0 or more."""
    unit = rows.where(F.col(label) >= 0).withColumn("_unit", V.l2(F.col(vector)))
    return V.mean_vector(unit, [*by, label], "_unit", "_mean").select(*by, label, V.l2(F.col("_mean")).alias("centroid"))


def global_mean(exemplars: DataFrame, vector: str = "embedding") -> DataFrame:
    """One row: the mean of all exemplars, as unit vectors."""
    unit = exemplars.select(F.lit(0).alias("_k"), V.l2(F.col(vector)).alias("_unit"))
    return V.mean_vector(unit, ["_k"], "_unit", "global_mean").drop("_k")


def recentred(rows: DataFrame, mean: DataFrame, vector: str) -> DataFrame:
    """``vector`` of each row less the global mean (a table of one row)."""
    return rows.crossJoin(F.broadcast(mean)).withColumn(vector, V.recentre(F.col(vector), F.col("global_mean"))).drop("global_mean")


def match_matrix(clusters: DataFrame, persons: DataFrame) -> DataFrame:
    """(recording_id, label, person_id, score): cosine of every cluster with every known person."""
    return all_matches(clusters, persons)


def mode_of(score, high: float = TAU_HIGH, low: float = TAU_LOW):
    return F.when(score >= high, "auto").when(score >= low, "suggest").otherwise("unknown")


def identify(clusters: DataFrame, persons: DataFrame, high: float = TAU_HIGH, low: float = TAU_LOW, method: str = "optimal", mean: DataFrame | None = None) -> DataFrame:
    """(recording_id, label, person_id, name, confidence, mode). Optimal assignment comes before the
    thresholds: a pair under ``low`` keeps its score and loses its person. Greedy assignment takes only
    pairs of ``low`` or more. Clusters left over have score 0. ``mean``: the global mean (one row), which
    both sides are centred on first.

    Of c clusters no more than c - 1 persons go to others, so each cluster's c best persons are enough for
    an assignment of greatest total, and for the greedy one; a task sees c * c pairs, however many persons
    there are."""
    if mean is not None:
        clusters, persons = recentred(clusters, mean, "centroid"), recentred(persons.where(F.size("centroid") > 0), mean, "centroid")
    counted = clusters.withColumn("_c", F.count(F.lit(1)).over(Window.partitionBy("recording_id")))
    found = assign(top_matches(counted, persons, F.col("_c")), "recording_id", "label", "person_id", "score", method, low)
    joined = clusters.select("recording_id", "label").join(found, ["recording_id", "label"], "left")
    score = F.coalesce("score", F.lit(0.0))
    mode = mode_of(score, high, low)
    person = F.when(mode != "unknown", F.col("person_id"))
    rows = joined.select("recording_id", "label", person.alias("person_id"), F.round(score, 3).alias("confidence"), mode.alias("mode"))
    names = persons.select("person_id", "name")
    return rows.join(names, "person_id", "left").select("recording_id", "label", "person_id", F.coalesce("name", F.concat(F.lit("S"), F.col("label").cast("string"))).alias("name"), "confidence", "mode")


def calibrate(persons: DataFrame, exemplars: DataFrame) -> DataFrame:
    """One row (tau_low, tau_high) from cosines within and between persons; defaults without exemplars."""
    own = exemplars.join(persons.select("person_id", "centroid"), "person_id").select(V.dot(V.l2(F.col("embedding")), F.col("centroid")).alias("s"))
    own = written(own.withColumn("_k", F.lit(0)), "scores")
    p10 = quantile(own, ["_k"], "s", 0.1).select(F.col("quantile").alias("p10"))
    # each of one row but p10, which is empty without exemplars
    within = own.agg(F.avg("s").alias("mean_in")).join(F.broadcast(p10), F.lit(True), "left")
    # the sum over all pairs of persons from sums by position: (|sum|^2 - sum of squares) / 2 of n (n - 1) / 2 pairs
    each = persons.where(F.size("centroid") > 0)
    sums = each.select(F.posexplode("centroid").alias("at", "x")).groupBy("at").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))
    pairs = sums.agg(F.sum(F.col("s") * F.col("s") - F.col("q")).alias("p")).crossJoin(F.broadcast(each.agg(F.count(F.lit(1)).alias("n"))))  # two tables of one row
    between = pairs.select(F.coalesce(F.when(F.col("n") > 1, F.col("p") / (F.col("n") * (F.col("n") - 1))), F.lit(0.0)).alias("mean_out"))
    both = within.crossJoin(F.broadcast(between))  # two tables of one row
    high = V.clip(F.col("p10"), 0.4, 0.9)
    low = F.least(F.greatest((F.col("mean_in") + F.col("mean_out")) / 2, F.lit(0.3)), high - 0.05)
    some = F.col("p10").isNotNull()
    return both.select(F.when(some, F.round(low, 3)).otherwise(F.lit(TAU_LOW)).alias("tau_low"), F.when(some, F.round(high, 3)).otherwise(F.lit(TAU_HIGH)).alias("tau_high"))


def newest(exemplars: DataFrame, cap: int = RING) -> DataFrame:
    """The newest ``cap`` exemplars of each person (a retention rule; ties: lower ``seq`` first)."""
    w = Window.partitionBy("person_id").orderBy(F.desc("ts"), "seq")
    return exemplars.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= cap).drop("_n")


def refreshed(persons: DataFrame, exemplars: DataFrame) -> DataFrame:
    """Persons with centroid and count recomputed from the exemplars they have; others as they were."""
    unit = exemplars.withColumn("_unit", V.l2(F.col("embedding")))
    means = V.mean_vector(unit, ["person_id"], "_unit", "_mean").select("person_id", V.l2(F.col("_mean")).alias("_c"))
    counts = exemplars.groupBy("person_id").agg(F.count(F.lit(1)).alias("_n"))
    joined = persons.join(means, "person_id", "left").join(counts, "person_id", "left")
    return joined.select("person_id", "name", "role", F.coalesce("_c", "centroid").alias("centroid"), F.coalesce("_n", "n_exemplars").cast("long").alias("n_exemplars"))


def push(persons: DataFrame, exemplars: DataFrame, new: DataFrame, cap: int = RING) -> tuple[DataFrame, DataFrame]:
    """Reinforce: exemplars with ``new`` (person_id, seq, ts, embedding) added, the ring kept."""
    held = newest(exemplars.unionByName(new.withColumn("embedding", V.l2(F.col("embedding")))), cap)
    return refreshed(persons, held), held


def running_centroid(centroid, count, vector):
    """The incremental form: the mean with one more vector, renormalised."""
    total = F.zip_with(centroid, vector, lambda c, v: (c * count + v) / (count + 1))
    return V.l2(total)


#: A slug or id that another slug may get as its k-th: what is before the number, and the number.
_NUMBERED = r"^(.*)-([2-9]|[1-9][0-9]+)$"


def _parent(slug: str) -> tuple[Column, Column]:
    """(slug, number) that an id is made of, if it ends in a number of 2 or more; else nulls."""
    number = F.regexp_extract(slug, _NUMBERED, 2).try_cast("long")
    return F.when(number.isNotNull(), F.regexp_extract(slug, _NUMBERED, 1)), number


def _settle(table):
    """One slug's blocked numbers (``before`` null) and the numbers that are the plain slugs of other new
    names, with how many names of this slug came before the first of these: which of those do keep theirs.

    A number is given away only if this slug has not reached it by then, which the blocked numbers below
    it bring nearer; so one pass in order of the numbers settles all."""
    import pyarrow as pa

    table = table.sort_by("k")
    skipped, won = 0, []
    for k, before in zip(table.column("k").to_pylist(), table.column("before").to_pylist()):
        won.append(before is None or before + skipped < k)
        skipped += won[-1]
    return table.append_column("won", pa.array(won, pa.bool_())).filter(table.column("before").is_valid())


def unique_ids(names: DataFrame, taken: DataFrame, order: str = "ord") -> DataFrame:
    """person_id for each new name: its slug, or the slug with the least of -2, -3.. that is free, where
    ids of ``taken`` and of names before it in ``order`` are not.

    A slug's names take its free numbers in order. An id has two claimants at most: the slug that it is as
    it stands, and the one it numbers (``bob-2``: that of "Bob 2", and the second "Bob"). Whether the first
    name of the former comes before the latter gets so far is settled level by level, from slugs that
    number no other downwards; there are as many rounds as a contested slug has numbers at its end."""
    rows = names.withColumn("_slug", T.slug(F.col("name")))
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy("_slug").orderBy(order)))
    slugs = rows.groupBy("_slug").agg(F.min(order).alias("_first"))
    parent, number = _parent("person_id")
    ids = taken.select("person_id").distinct()
    held = ids.select(F.col("person_id").alias("_slug"), F.lit(1).cast("long").alias("_k")).union(ids.select(parent, number).where(parent.isNotNull()))
    blocks = held.join(slugs.select("_slug"), "_slug", "left_semi")
    # slugs that are a number of another new slug, and are free so far
    up, k = _parent("_slug")
    depth = F.length(F.regexp_extract("_slug", r"((?:-(?:[2-9]|[1-9][0-9]+))*)$", 1)) - F.length(F.regexp_replace(F.regexp_extract("_slug", r"((?:-(?:[2-9]|[1-9][0-9]+))*)$", 1), "-", ""))
    claims = slugs.select(F.col("_slug").alias("_child"), "_first", up.alias("_slug"), k.alias("_k"), depth.alias("_depth")).where("_slug is not null")
    claims = claims.join(slugs.select("_slug"), "_slug", "left_semi").join(ids.select(F.col("person_id").alias("_child")), "_child", "left_anti")
    levels = [r[0] for r in claims.select("_depth").distinct().collect()]  # the numbers at the end of a slug
    if levels:
        # how many names of the slug came before the first of the child
        w = Window.partitionBy("_slug").orderBy("_at", "_own").rowsBetween(Window.unboundedPreceding, 0)
        line = rows.select("_slug", F.col(order).alias("_at"), F.lit(1).alias("_own"), F.lit(None).cast("string").alias("_child"), F.lit(None).cast("long").alias("_k"))
        line = line.join(claims.select("_slug").distinct(), "_slug", "left_semi").union(claims.select("_slug", "_first", F.lit(0), "_child", "_k"))
        met = line.withColumn("_before", F.sum("_own").over(w)).where("_own = 0")
        claims = written(met.join(claims.select("_child", "_depth"), "_child").select("_slug", "_child", "_depth", F.col("_k").alias("k"), F.col("_before").alias("before")), "claims")
        for level in sorted(levels):
            own = claims.where(F.col("_depth") == level)
            known = blocks.join(own.select("_slug").distinct(), "_slug", "left_semi").select("_slug", F.lit(None).cast("string").alias("_child"), F.lit(level).alias("_depth"), F.col("_k").alias("k"), F.lit(None).cast("long").alias("before"))
            kinds = "_slug string, _child string, _depth int, k long, before long, won boolean"
            settled = written(own.select("_slug", "_child", "_depth", "k", "before").union(known).groupBy("_slug").applyInArrow(_settle, kinds), "settled")
            gone = settled.select(F.when(F.col("won"), F.col("_slug")).otherwise(F.col("_child")).alias("_slug"), F.when(F.col("won"), F.col("k")).otherwise(F.lit(1)).alias("_k"))
            blocks = blocks.unionByName(gone)
    # the j-th blocked number k moves all names from the (k - j + 1)-th on by one
    blocks = blocks.distinct()
    steps = blocks.select("_slug", (F.col("_k") - F.row_number().over(Window.partitionBy("_slug").orderBy("_k")) + 1).alias("_n"))
    marked = rows.select(F.struct(*names.columns).alias("_row"), "_slug", "_n", F.lit(0).alias("_step"))
    both = marked.unionByName(steps.withColumn("_step", F.lit(1)), allowMissingColumns=True)
    passed = F.sum("_step").over(Window.partitionBy("_slug").orderBy("_n", F.desc("_step")).rowsBetween(Window.unboundedPreceding, 0))
    placed = both.withColumn("_number", F.col("_n") + passed).where("_step = 0")
    numbered = F.when(F.col("_number") == 1, F.col("_slug")).otherwise(F.concat("_slug", F.lit("-"), F.col("_number").cast("string")))
    return placed.select("_row.*", numbered.alias("person_id"))


def enroll(persons: DataFrame, exemplars: DataFrame, rows: DataFrame, name: str, role: str = "", ts: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """The store with one more person from the embeddings of a cluster; an error if there are none."""
    if not rows.limit(1).count():
        raise ValueError("the cluster has no usable embeddings")
    spark = persons.sparkSession
    one = spark.range(1).select(F.lit(name).alias("name"), F.lit(0).alias("ord"))
    pid = unique_ids(one, persons).first()["person_id"]  # one row
    new = rows.select(F.lit(pid).alias("person_id"), F.col("seq").cast("long").alias("seq"), F.lit(ts).alias("ts"), V.l2(F.col("embedding")).alias("embedding"))
    blank = one.select(F.lit(pid).alias("person_id"), "name", F.lit(role).alias("role"), F.array().cast("array<double>").alias("centroid"), F.lit(0).cast("long").alias("n_exemplars"))
    held = newest(exemplars.unionByName(new))
    return refreshed(persons.unionByName(blank), held), held


def forget(persons: DataFrame, exemplars: DataFrame, ids: list[str]) -> tuple[DataFrame, DataFrame]:
    return tuple(df.where(~F.col("person_id").isin(*ids)) for df in (persons, exemplars))
