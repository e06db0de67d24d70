"""Sharding by size-tiered compaction, with DataFrame operations only.

A store is a folder of immutable shards (Parquet files in folders of their own) and of versioned
manifests. ``append`` writes arrivals as small shards. ``compact`` takes the live shards tier by
tier (a tier holds sizes within a factor of ``fanout``), and where a tier has at least ``fanout``
shards below the target size merges them, in order, into files of about the target size. A version
is committed by creating ``_commits/<version>`` where none may exist yet: of two writers one wins,
and a reader sees the whole of a version or none of it. A compaction that loses to another writer is
committed onto that writer's version if all that it merged is still there. A lost executor or driver
leaves files that no version names; ``vacuum`` deletes them after a time of grace, and with them what no
manifest from a given version on names.

The manifest is a table with a row for each shard (name, rows, bytes, tier, and the version that its first
row came with, which orders shards by arrival), read and written by Spark. A merge works in waves of at most ``WAVE`` shards, so the map from shards to files that is
broadcast is of a bounded size; each destination file has a task of its own. Arrivals may be staged: all
are written in one pass, then committed one after another, so that tiers fill and roll between them.

Edge cases: null and empty texts count no bytes and are kept; rows that repeat are kept; a row longer
than the target is in a shard that is longer; an empty arrival adds no shard, and a store without
shards has no rows to read (an error); any columns are carried, since a shard keeps rows as structs.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colloquy.llm._common import materialize

TARGET_BYTES = 32 << 20
FANOUT = 4
#: Shards that one merge job takes: a bound on what is broadcast (about 100 bytes a shard).
WAVE = 4096
#: How long files that no version names are left to a writer that may still commit them.
GRACE_S = 24 * 3600
_ENTRY = "shard string, rows long, bytes long, tier int, since long"


def _shard_of() -> Column:
    return F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+/_batch=[^/]+/_shard=[^/]+)/[^/]+$", 1)


def _job_of() -> Column:
    """The folder of the shards that were written and committed together."""
    return F.substring_index("shard", "/_shard=", 1)


class Conflict(RuntimeError):
    """Another writer committed this version first."""


class ShardStore:
    def __init__(self, spark: SparkSession, path: str, text: str = "text", target_bytes: int = TARGET_BYTES, fanout: int = FANOUT):
        self.spark, self.path, self.text, self.target, self.fanout = spark, path.rstrip("/"), text, target_bytes, fanout

    # versions

    def _fs(self, path: str):
        jvm = self.spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def version(self) -> int:
        """The latest committed version, 0 before the first."""
        fs, folder = self._fs(f"{self.path}/_commits")
        return max((int(x.getPath().getName()) for x in fs.listStatus(folder)), default=0) if fs.exists(folder) else 0

    def manifest(self, version: int | None = None) -> DataFrame:
        """(shard, rows, bytes, tier, since) of the live shards of a version."""
        version = self.version() if version is None else version
        return self._entries([version] if version else [])

    def _entries(self, versions: list[int]) -> DataFrame:
        """The entries of some versions, in one scan."""
        if not versions:
            return self.spark.range(0).selectExpr("'' as shard", "0L as rows", "0L as bytes", "0 as tier", "0L as since")
        names = []
        for version in versions:
            fs, mark = self._fs(f"{self.path}/_commits/{version:08d}")
            stream = fs.open(mark)
            try:
                names.append(stream.readUTF())
            finally:
                stream.close()
        return self.spark.read.schema(_ENTRY).parquet(*(f"{self.path}/_manifests/{name}" for name in names))

    def _commit(self, entries: DataFrame, onto: int) -> int:
        version = onto + 1
        name = f"{version:08d}-{uuid.uuid4().hex}"
        entries.write.parquet(f"{self.path}/_manifests/{name}")
        fs, mark = self._fs(f"{self.path}/_commits/{version:08d}")
        # the pointer is written aside and renamed; a rename onto an existing file fails
        fs, aside = self._fs(f"{self.path}/_aside/{name}")
        stream = fs.create(aside, False)
        stream.writeUTF(name)
        stream.close()
        _, mark = self._fs(f"{self.path}/_commits/{version:08d}")
        fs.mkdirs(mark.getParent())
        jvm = self.spark._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(aside.toUri(), self.spark._jsc.hadoopConfiguration())
        plain = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(aside, mark, plain)
        except Exception as e:
            if "FileAlreadyExists" in str(e):
                raise Conflict(f"version {version} is taken") from None
            raise
        return version

    # writing

    def _write(self, rows: DataFrame, prefix: str) -> DataFrame:
        """Write ``rows`` with ``_batch`` and ``_shard`` as one folder for each shard; returns their entries."""
        job = f"{prefix}-{uuid.uuid4().hex[:12]}"
        rows.write.option("compression", "zstd").partitionBy("_batch", "_shard").parquet(f"{self.path}/{job}")
        # the rows just written are counted from their files: one narrow scan
        back = self.spark.read.option("recursiveFileLookup", "true").schema(rows.drop("_batch", "_shard").schema).parquet(f"{self.path}/{job}")
        sized = back.select(_shard_of().alias("shard"), F.coalesce(F.octet_length(F.col("row")[self.text]), F.lit(0)).alias("n"))
        counted = sized.groupBy("shard").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").cast("long").alias("bytes"))
        return counted.withColumn("tier", self._tier(F.col("bytes")))

    def _tier(self, size):
        """0 below the smallest size, then one for each factor of ``fanout``; full shards are in the top tier."""
        return F.when(size * 4 >= self.target * 3, F.lit(99)).otherwise(F.greatest(F.lit(0), F.floor(F.log(F.greatest(size, F.lit(1)) / F.lit(float(self.target) / self.fanout**4)) / F.log(F.lit(float(self.fanout)))))).cast("int")

    def stage(self, arrivals: DataFrame, batch: Column | None = None) -> DataFrame:
        """Write arrivals as small shards, which no version names yet. Returns their entries, with
        ``batch`` (a whole number, 0 without one) that tells which rows arrive together; a batch is to
        be committed as a whole."""
        number = F.lit(0) if batch is None else batch.cast("long")
        name = F.lpad(F.spark_partition_id().cast("string"), 6, "0")
        entries = self._write(arrivals.select(F.struct(*arrivals.columns).alias("row"), number.alias("_batch"), name.alias("_shard")), "arrive")
        return materialize(entries.withColumn("batch", F.regexp_extract("shard", r"_batch=(-?\d+)/", 1).cast("long")), "staged")

    def add(self, entries: DataFrame, tries: int = 10) -> int:
        """Commit staged shards; where another writer was faster, onto that writer's version."""
        for left in reversed(range(tries)):
            base = self.version()
            dated = entries.select("shard", "rows", "bytes", "tier", F.lit(base + 1).cast("long").alias("since"))
            try:
                return self._commit(self.manifest(base).unionByName(dated), base)
            except Conflict:
                if not left:
                    raise

    def append(self, arrivals: DataFrame) -> int:
        """Commit arrivals as small shards in one version."""
        return self.add(self.stage(arrivals))

    def _due(self, live: DataFrame) -> DataFrame | None:
        """(shard, since, bin) of what is to be merged: the first shards by arrival of the lowest full tier that
        has bins of several of them."""
        full = live.where("tier < 99").groupBy("tier").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= self.fanout)
        for tier in sorted(r.tier for r in full.collect()):  # a handful of tiers
            wave = live.where(F.col("tier") == tier).orderBy("since", "shard").limit(WAVE)
            upto = Window.orderBy("since", "shard").rowsBetween(Window.unboundedPreceding, Window.currentRow)
            cut = wave.select("shard", "since", F.floor((F.sum("bytes").over(upto) - F.col("bytes") / 2) / self.target).alias("bin"))
            several = cut.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("bin"))).where("n > 1")  # a bin of one is as it should be
            found = several.select("shard", "since", (F.dense_rank().over(Window.orderBy("bin")) - 1).alias("bin"))
            if found.limit(1).count():
                return found
        return None

    def compact(self, tries: int = 10) -> int:
        """Merge tiers that are full, in waves; each wave commits a version. Returns the latest."""
        while True:
            base = self.version()
            live = self.manifest(base)
            merged = self._due(live)
            if merged is None:
                return base
            chosen = merged.select("shard", "bin").collect()  # WAVE rows at most
            names = [r.shard for r in chosen]
            entries = self._merge(names, merged, max(r.bin for r in chosen) + 1)
            for left in reversed(range(tries)):
                try:
                    self._commit(live.where(~F.col("shard").isin(names)).unionByName(entries), base)
                    break
                except Conflict:
                    if not left:
                        raise
                    base = self.version()
                    live = self.manifest(base)
                    if live.where(F.col("shard").isin(names)).count() < len(names):
                        break  # another compaction has merged some of them; what was written here is left to vacuum

    def _merge(self, names: list[str], merged: DataFrame, n: int) -> DataFrame:
        """Write the shards of each of ``n`` bins as one, and return the entries of these."""
        joined = self.read(names).join(F.broadcast(merged.select("shard", "bin")), "shard").drop("shard")  # of a bounded size: WAVE
        dealt = joined.repartitionById(n, F.col("bin").cast("int")).withColumn("_shard", F.lpad(F.col("bin").cast("string"), 6, "0")).drop("bin").withColumn("_batch", F.lit(0))
        entries = self._write(dealt, "merge").withColumn("bin", F.substring_index("shard", "_shard=", -1).cast("int"))
        return materialize(entries.join(merged.groupBy("bin").agg(F.min("since").alias("since")), "bin").drop("bin"), "merged")

    # reading

    def read(self, shards: list[str]) -> DataFrame:
        """(row, shard) of some shards: each row as a struct, and the shard it is from."""
        rows = self.spark.read.option("recursiveFileLookup", "true").parquet(*(f"{self.path}/{s}" for s in shards))
        return rows.select("row", _shard_of().alias("shard"))

    def placed(self, version: int | None = None) -> DataFrame:
        """(shard, row, tier, shard_bytes) of a version. Shards that it does not name are left out by a join."""
        live = self.manifest(version)
        jobs = [r[0] for r in live.select(_job_of()).distinct().collect()]  # one for each write job
        if not jobs:
            raise LookupError("the store has no shards yet")
        return self.read(jobs).join(live.select("shard", "tier", F.col("bytes").alias("shard_bytes")), "shard")

    def rows(self, version: int | None = None) -> DataFrame:
        """The rows of a version, as they were appended."""
        return self.placed(version).select("row.*")

    def vacuum(self, keep_from: int, since: int = 1, grace_s: float = GRACE_S) -> int:
        """Delete the shards of versions from ``since`` on that no version from ``keep_from`` on names, and write
        jobs older than ``grace_s`` that no version at all names; returns the number of shards, and of such jobs.
        What was committed together goes in one piece if none of it is live."""
        latest, n = self.version(), self._drop_orphans(grace_s)
        if keep_from <= since:
            return n
        live, old = self._named(keep_from, latest), self._named(since, keep_from - 1)
        dead = old.join(live, "shard", "left_anti").withColumn("job", _job_of())
        jobs = live.select(_job_of().alias("job"), F.lit(True).alias("kept")).distinct()
        dead = dead.join(jobs, "job", "left").withColumn("path", F.when(F.col("kept"), F.col("shard")).otherwise(F.col("job")))
        for path, shards in dead.groupBy("path").agg(F.count(F.lit(1))).toLocalIterator():
            fs, where = self._fs(f"{self.path}/{path}")
            n += shards if fs.delete(where, True) else 0
        return n

    def _drop_orphans(self, grace_s: float) -> int:
        """Delete write jobs that are older than the grace and named by no version."""
        import time

        fs, root = self._fs(self.path)
        if not fs.exists(root):
            return 0
        before = (time.time() - grace_s) * 1000
        old = {x.getPath().getName() for x in fs.listStatus(root) if x.isDirectory() and not x.getPath().getName().startswith("_") and x.getModificationTime() <= before}
        if not old:
            return 0
        named = self._named(1, self.version()).select(F.substring_index("shard", "/", 1).alias("job")).distinct()
        n = 0
        for name in sorted(old - {r.job for r in named.toLocalIterator()}):
            n += fs.delete(self._fs(f"{self.path}/{name}")[1], True)
        return n

    def _named(self, first: int, last: int) -> DataFrame:
        """The shards that versions first to last name."""
        return self._entries(list(range(first, last + 1))).select("shard").distinct()


def arrive_and_compact(docs: DataFrame, path: str, arrivals: int = 8, doc_id: str = "doc_id", **options) -> ShardStore:
    """A store of ``docs`` as they would arrive in so many batches, one after another: each is
    committed, full tiers are compacted, and what the new version no longer names is deleted."""
    store = ShardStore(docs.sparkSession, path, **options)
    staged = store.stage(docs, F.pmod(F.xxhash64(doc_id), F.lit(arrivals)))
    kept = 1
    for i in range(arrivals):
        added = store.add(staged.where(F.col("batch") == i))
        last = store.compact()
        if last > added:  # some shards were merged
            store.vacuum(last, kept)
            kept = last
    return store
