"""Writers: tables as Parquet or JSON, rendered text as files, a store as versioned snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    df.write.mode(mode).format(fmt).save(path)


def write_documents(rendered: DataFrame, root: str) -> DataFrame:
    """Write (path, content) rows as text files under ``root`` by the executors' file system calls,
    one write for each row; returns (path, ok, error). ``root`` must be a folder that all share."""

    def run(batches):
        import os

        import pyarrow as pa

        for batch in batches:
            ok, errors = [], []
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                try:
                    to = os.path.normpath(os.path.join(root, path))
                    if not to.startswith(os.path.normpath(root) + os.sep):
                        raise ValueError("path leaves the root")
                    os.makedirs(os.path.dirname(to), exist_ok=True)
                    aside = f"{to}.{os.getpid()}.tmp"
                    with open(aside, "w", encoding="utf-8") as f:
                        f.write(content or "")
                    os.replace(aside, to)
                    ok.append(True)
                    errors.append(None)
                except Exception as e:  # each file is reported
                    ok.append(False)
                    errors.append(str(e)[:200])
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(ok), pa.array(errors, pa.string())], ["path", "ok", "error"])

    return rendered.select("path", "content").mapInArrow(run, "path string, ok boolean, error string")


class Snapshots:
    """A folder of immutable versions v=1, v=2.. of a table; the latest is read."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def latest(self) -> int:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = where.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(where):
            return 0
        done = [x.getPath() for x in fs.listStatus(where) if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(x.getPath(), "_SUCCESS"))]
        return max((int(p.getName()[2:]) for p in done if p.getName().startswith("v=")), default=0)

    def read(self, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/v={version or self.latest()}")

    def write(self, df: DataFrame) -> int:
        version = self.latest() + 1
        df.write.parquet(f"{self.path}/v={version}")
        return version


def to_json_rows(df: DataFrame, by: str, order: str) -> DataFrame:
    """(by, content): each group's rows as one ordered JSON array."""
    fields = [c for c in df.columns if c not in (by, order)]
    rows = df.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(order, F.struct(*fields).alias("row")))).alias("all"))
    return rows.select(by, F.to_json(F.transform("all", lambda x: x["row"])).alias("content"))
