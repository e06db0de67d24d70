"""Settings by layers: a default, over it a JSON file, over that the environment."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping
from typing import Any

from pyspark.sql import SparkSession

PREFIX = "COLLOQUY_"


def file_settings(spark: SparkSession, path: str) -> dict[str, Any]:
    """The object in a JSON file on any file system Spark reads, but for keys that begin with ``_``; nothing of a
    file that is missing or holds no object."""
    try:
        found = json.loads(spark.read.text(path, wholetext=True).first()[0])
    except Exception:  # a bad file of settings never stops a job
        return {}
    return {k: v for k, v in found.items() if not k.startswith("_")} if isinstance(found, dict) else {}


def settings(spark: SparkSession, defaults: Mapping[str, str], path: str | None = None, environ: Mapping[str, str] | None = None, prefix: str = PREFIX) -> dict[str, str]:
    """Every key of ``defaults`` as text, from the highest layer that has it: the environment (behind ``prefix``),
    the file, the default."""
    environ = os.environ if environ is None else environ
    held = file_settings(spark, path) if path else {}
    return {k: str(environ.get(prefix + k, held.get(k, v))) for k, v in defaults.items()}
