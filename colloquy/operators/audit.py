"""Egress audit: lines of rendered files that hold an address."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

URL = r"https?://"


def lines(files: DataFrame, content: str = "content") -> DataFrame:
    """(path, line_no from 1, line); files under a folder ``assets`` are skipped."""
    kept = files.where(~F.col("path").contains("/assets/"))
    return kept.select("path", F.posexplode(F.split(content, r"\n|\r\n?")).alias("_at", "line")).select("path", (F.col("_at") + 1).alias("line_no"), "line")


def hits(files: DataFrame, content: str = "content") -> DataFrame:
    """Each line with an address once, its first 100 characters."""
    return lines(files, content).where(F.col("line").rlike(URL)).select("path", "line_no", F.left(F.trim("line"), F.lit(100)).alias("line"))


def counts(files: DataFrame, content: str = "content") -> DataFrame:
    found = hits(files, content).groupBy("path").agg(F.count(F.lit(1)).alias("hits"))
    return files.select("path").distinct().join(found, "path", "left").select("path", F.coalesce("hits", F.lit(0)).alias("hits"))
