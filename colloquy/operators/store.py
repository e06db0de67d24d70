"""The store of known voices: persons, their exemplars and the global mean, under one version.

Every change derives new tables from those of the latest version, writes them to a folder of their own and
commits that folder as the next version. Readers of a version are not disturbed; of two writers one commits,
and the other derives its change again from what the first has committed. What no version names is of no
effect, so a lost driver leaves files and nothing else.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.functions import vectors as V
from colloquy.operators import identity
from colloquy.sources.commits import Commits, Conflict

PERSONS = "person_id string, name string, role string, centroid array<double>, n_exemplars bigint"
EXEMPLARS = "person_id string, seq bigint, ts double, embedding array<double>"
MEAN = "global_mean array<double>"

Change = Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]]


def enroll_all(persons: DataFrame, exemplars: DataFrame, rows: DataFrame, ts: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """The tables with the persons of ``rows`` (ord, name, role, seq, embedding: a row for each embedding of a new
    person, who is one ``ord``) added in order of ``ord``; rows without an embedding are left out, and so is a
    person without any."""
    usable = rows.where(F.size("embedding") > 0)
    new = usable.groupBy("ord").agg(F.min("name").alias("name"), F.min(F.coalesce("role", F.lit(""))).alias("role"))
    named = identity.unique_ids(new, persons)
    added = usable.select("ord", F.col("seq").cast("bigint").alias("seq"), F.lit(ts).alias("ts"), V.l2(F.col("embedding")).alias("embedding"))
    held = identity.newest(exemplars.unionByName(added.join(named.select("ord", "person_id"), "ord").drop("ord")))
    blank = named.select("person_id", "name", "role", F.array().cast("array<double>").alias("centroid"), F.lit(0).cast("bigint").alias("n_exemplars"))
    return identity.refreshed(persons.unionByName(blank), held), held


class VoiceStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.commits = spark, path.rstrip("/"), Commits(spark, path)

    def version(self) -> int:
        return self.commits.latest()

    # reading

    def _table(self, name: str, schema: str, version: int | None) -> DataFrame:
        version = self.version() if version is None else version
        if not version:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{self.commits.content(version)}/{name}")

    def persons(self, version: int | None = None) -> DataFrame:
        return self._table("persons", PERSONS, version)

    def exemplars(self, version: int | None = None) -> DataFrame:
        return self._table("exemplars", EXEMPLARS, version)

    def global_mean(self, version: int | None = None) -> DataFrame:
        """One row, or none before there are exemplars."""
        return self._table("mean", MEAN, version)

    def people(self, version: int | None = None) -> DataFrame:
        """All persons by name (bytewise), then id."""
        return self.persons(version).orderBy("name", "person_id")

    def person(self, person_id: str, version: int | None = None) -> DataFrame:
        """The person of that id: one row or none; the filter reaches the scan."""
        return self.persons(version).where(F.col("person_id") == person_id)

    def exemplars_of(self, person_id: str, version: int | None = None) -> DataFrame:
        """The exemplars of a person, the newest first; none of an unknown one."""
        return self.exemplars(version).where(F.col("person_id") == person_id).orderBy(F.desc("ts"), "seq")

    # changing

    def change(self, derive: Change, tries: int = 10) -> int:
        """Commit what ``derive`` makes of the latest persons and exemplars; again from newer ones on a conflict."""
        for left in reversed(range(tries)):
            base = self.version()
            folder = f"tables/{base + 1:08d}-{uuid.uuid4().hex}"
            persons, exemplars = derive(self.persons(base), self.exemplars(base))
            exemplars.select(*(c.split()[0] for c in EXEMPLARS.split(", "))).write.parquet(f"{self.path}/{folder}/exemplars")
            held = self.spark.read.schema(EXEMPLARS).parquet(f"{self.path}/{folder}/exemplars")
            persons.select(*(c.split()[0] for c in PERSONS.split(", "))).write.parquet(f"{self.path}/{folder}/persons")
            identity.global_mean(held).write.parquet(f"{self.path}/{folder}/mean")
            try:
                return self.commits.commit(base, folder)
            except Conflict:
                if not left:
                    raise

    def enroll(self, rows: DataFrame, ts: float = 0.0) -> int:
        """Add persons (see ``enroll_all``); an error if one has no usable embedding."""
        empty = rows.groupBy("ord").agg(F.min("name").alias("name"), F.max(F.coalesce(F.size("embedding") > 0, F.lit(False))).alias("some")).where("not some").first()
        if empty:
            raise ValueError(f"{empty['name']!r} has no usable embeddings")
        return self.change(lambda persons, exemplars: enroll_all(persons, exemplars, rows, ts))

    def reinforce(self, new: DataFrame, cap: int = identity.RING) -> int:
        """Add exemplars (person_id, seq, ts, embedding) of persons who are known; others are left out."""
        return self.change(lambda persons, exemplars: identity.push(persons, exemplars, new.join(persons.select("person_id"), "person_id", "left_semi"), cap))

    def forget(self, ids: list[str]) -> int:
        return self.change(lambda persons, exemplars: identity.forget(persons, exemplars, ids))

    def identify(self, clusters: DataFrame, use_global_mean: bool = True, version: int | None = None, **options) -> DataFrame:
        """``identity.identify`` against a version, around its global mean if asked and if there is one."""
        version = self.version() if version is None else version
        mean = self.global_mean(version)
        known = use_global_mean and mean.limit(1).count() > 0
        return identity.identify(clusters, self.persons(version), mean=mean if known else None, **options)
