"""Rendered documents as files, all of them or none: a data source writer with a commit.

Each task writes its documents to a staging folder under the root. When all tasks are done the driver moves them
to their places; if one fails for good, the staging folder is deleted and no document has changed. An attempt
that is lost or repeated leaves files in staging only. Arrow's file systems are used, so the root may be any URI
that they know, and executors share it.

A path has one writer: documents of one path are one file (see ``save_documents``), written by one task.
"""

from __future__ import annotations

import posixpath
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage


def _filesystem(uri: str):
    from pyarrow import fs

    system, root = fs.FileSystem.from_uri(uri if "://" in uri else f"file://{posixpath.abspath(uri)}")
    return system, root.rstrip("/")


@dataclass
class Staged(WriterCommitMessage):
    """Files of a task: (where it is staged, its place), both below the root."""

    files: list[tuple[str, str]]


class _Writer(DataSourceWriter):
    def __init__(self, root: str):
        self.root, self.staging = root, f"_staging-{uuid.uuid4().hex}"

    def write(self, iterator) -> Staged:
        from pyspark import TaskContext

        context = TaskContext.get()
        system, root = _filesystem(self.root)
        folder, files = f"{self.staging}/{context.partitionId()}-{context.attemptNumber()}", []
        system.create_dir(f"{root}/{folder}", recursive=True)
        for row in iterator:
            aside = f"{folder}/{len(files)}"
            with system.open_output_stream(f"{root}/{aside}") as f:
                f.write((row["content"] or "").encode())
            files.append((aside, row["path"]))
        return Staged(files)

    def commit(self, messages) -> None:
        system, root = _filesystem(self.root)
        files = [x for m in messages if m for x in m.files]
        for folder in sorted({posixpath.dirname(place) for _, place in files}):
            system.create_dir(f"{root}/{folder}".rstrip("/"), recursive=True)
        for aside, place in files:
            system.move(f"{root}/{aside}", f"{root}/{place}")
        self._clear(system, root)

    def abort(self, messages) -> None:
        self._clear(*_filesystem(self.root))

    def _clear(self, system, root: str) -> None:
        from pyarrow import fs

        if system.get_file_info(f"{root}/{self.staging}").type != fs.FileType.NotFound:
            system.delete_dir(f"{root}/{self.staging}")


class Documents(DataSource):
    """See the module. Rows have ``path``, below the root, and ``content``; the option ``root`` names the root."""

    @classmethod
    def name(cls) -> str:
        return "documents"

    def schema(self) -> str:
        return "path string, content string"

    def writer(self, schema, overwrite: bool):
        return _Writer(self.options["root"])


def save_documents(rendered: DataFrame, root: str, order: str | None = None) -> None:
    """Write (path, content) below ``root``. Of several documents of one path the last by ``order`` is written (the
    greatest by content without one), whole; a path that is empty or leaves the root is an error, and nothing is
    written then."""
    spark = rendered.sparkSession
    spark.dataSource.register(Documents)
    parts = F.filter(F.split("path", "/"), lambda p: ~p.isin("", "."))
    depth = F.aggregate(parts, F.struct(F.lit(0).alias("d"), F.lit(0).alias("low")), lambda s, p: F.struct((s["d"] + F.when(p == "..", -1).otherwise(1)).alias("d"), F.least(s["low"], s["d"] + F.when(p == "..", -1).otherwise(1)).alias("low")))
    bad = F.col("path").isNull() | (F.size(parts) == 0) | F.startswith("path", F.lit("/")) | F.endswith("path", F.lit("/")) | (depth["low"] < 0)
    checked = F.when(bad, F.raise_error(F.concat(F.lit("no place below the root: "), F.coalesce("path", F.lit("null"))))).otherwise(F.array_join(parts, "/"))
    last = Window.partitionBy("path").orderBy(*([F.desc(order)] if order else []), F.desc("content"))
    rows = rendered.select(checked.alias("path"), "content", *([order] if order else []))
    one = rows.withColumn("_n", F.row_number().over(last)).where("_n = 1").select("path", "content")
    one.write.format("documents").option("root", root).mode("append").save()
