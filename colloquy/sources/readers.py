"""Readers of the inputs: transcripts, reports, mappings, checkpoints, stores, sound and rendered text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.functions import reports as R

UTTERANCE = "t0 double, t1 double, speaker string, text string"
SAMPLE_RATE = 16000


def _with_path(df: DataFrame) -> DataFrame:
    return df.withColumn("path", F.col("_metadata.file_path"))


def transcripts(spark: SparkSession, path: str) -> DataFrame:
    """(meeting_id, seq, t0, t1, speaker, text) from JSON files that are arrays of utterances; the
    meeting is the file's folder, the order that of the array."""
    raw = _with_path(spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "transcript*.json").text(path, wholetext=True))
    rows = raw.select("path", F.posexplode(F.from_json("value", f"array<struct<{UTTERANCE.replace(' double', ':double').replace(' string', ':string')}>>")).alias("seq", "u"))
    return rows.select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("meeting_id"), F.col("seq").cast("long").alias("seq"), "u.*")


def reports(spark: SparkSession, path: str) -> DataFrame:
    """(meeting_id, report) from ``synthese.json`` files, normalised; an error if there is none."""
    try:
        raw = _with_path(spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "synthese.json").text(path, wholetext=True))
        empty = not raw.limit(1).count()
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        empty = True
    if empty:
        raise FileNotFoundError(f"no synthese.json under {path}; write the reports first")
    return raw.select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("meeting_id"), R.normalize_report(F.col("value")).alias("report"))


def speaker_mapping(spark: SparkSession, path: str) -> DataFrame:
    """(meeting_id, speaker, name) from mapping files."""
    raw = _with_path(spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*mapping*.json").text(path, wholetext=True))
    rows = raw.select("path", F.explode(F.from_json("value", "struct<mapping:map<string,string>>")["mapping"]).alias("speaker", "name"))
    return rows.select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("meeting_id"), "speaker", "name")


PERSON = "id string, name string, role string, centroid array<double>, count bigint"


def people_json(spark: SparkSession, path: str) -> DataFrame:
    """(person_id, name, role, centroid, n_exemplars) from a JSON file that is an array of persons; no rows of a
    file that is missing or can't be read as one."""
    fields = ", ".join(f.replace(" ", ":", 1) for f in PERSON.split(", "))
    wanted = "person_id string, name string, role string, centroid array<double>, n_exemplars bigint"
    try:
        raw = spark.read.text(path, wholetext=True)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], wanted)
    people = F.from_json("value", f"array<struct<{fields}>>", {"mode": "PERMISSIVE"})
    return raw.where(F.rlike("value", F.lit(r"^\s*\["))).select(F.explode(people).alias("p")).where("p.id is not null").select(F.col("p.id").alias("person_id"), "p.name", "p.role", "p.centroid", F.col("p.count").alias("n_exemplars"))


def segments(spark: SparkSession, path: str) -> DataFrame:
    """A diarisation checkpoint; an error if it has no labels."""
    df = spark.read.parquet(path)
    if "label" not in df.columns:
        raise ValueError(f"{path} has no label column; cluster the segments first")
    return df


def rendered_text(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of all .html and .md files under ``path``."""
    raw = _with_path(spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.{html,md}").text(path, wholetext=True))
    return raw.select("path", F.col("value").alias("content"))


def valid_json(text: Column) -> Column:
    return F.try_parse_json(text).isNotNull()


def sound(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of sound files."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")


def wav_facts(content: Column) -> Column:
    """struct(channels, rate, bits) of a RIFF/WAVE header, null if it isn't one."""
    number = lambda at, n: F.conv(F.hex(F.concat(*(F.substring(content, at + i, 1) for i in reversed(range(n))))), 16, 10).cast("int")
    is_wav = (F.hex(F.substring(content, 1, 4)) == "52494646") & (F.hex(F.substring(content, 9, 4)) == "57415645") & (F.octet_length(content) >= 44)
    return F.when(is_wav, F.struct(number(23, 2).alias("channels"), number(25, 4).alias("rate"), number(35, 2).alias("bits")))


def is_16k_mono(content: Column) -> Column:
    facts = wav_facts(content)
    return F.coalesce((facts["rate"] == SAMPLE_RATE) & (facts["channels"] == 1), F.lit(False))


def decode_wav(files: DataFrame, rate: int = SAMPLE_RATE) -> DataFrame:
    """(path, signal, error): 16-bit samples in -1..1, channels averaged; another rate is an error."""

    def run(batches):
        import io
        import wave

        import numpy as np
        import pyarrow as pa

        for batch in batches:
            signals, errors = [], []
            for data in batch.column("content").to_pylist():
                try:
                    with wave.open(io.BytesIO(data)) as w:
                        if w.getframerate() != rate or w.getsampwidth() != 2:
                            raise ValueError(f"{w.getframerate()} Hz, {8 * w.getsampwidth()} bits")
                        x = np.frombuffer(w.readframes(w.getnframes()), "<i2").reshape(-1, w.getnchannels()).mean(1) / 32768
                    signals.append(x.astype(np.float32))
                    errors.append(None)
                except Exception as e:  # an unreadable file is reported
                    signals.append(None)
                    errors.append(str(e)[:200])
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(signals, pa.list_(pa.float32())), pa.array(errors, pa.string())], ["path", "signal", "error"])

    return files.select("path", "content").mapInArrow(run, "path string, signal array<float>, error string")
