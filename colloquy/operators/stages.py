"""Plug points for models: voice activity, embedding, recognition, and a language model's map and reduce.

A model is a plain callable. It is called for batches in Arrow workers; a row on which it fails gets an
empty result and its error, never a failed job.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.functions import reports as R
from colloquy.functions import text as T
from colloquy.operators import runs

CONTEXT_CHARS, NOTES_CHARS = 8000, 24000
NO_MODEL = "(Synthèse locale indisponible. Transcription et diarisation restent complètes ci-dessous.)"


def call_text(df: DataFrame, inputs: list[str], model: Callable[..., str], out: str) -> DataFrame:
    """``df`` with ``out``, the model's text for ``inputs`` (empty on failure), and ``out_error``."""
    from pyspark.sql.types import StringType, StructField, StructType

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts, errors = [], []
            for values in zip(*(batch.column(c).to_pylist() for c in inputs)):
                try:
                    texts.append(model(*values))
                    errors.append(None)
                except Exception as e:  # a failing row is reported, not fatal
                    texts.append("")
                    errors.append(f"{type(e).__name__}: {e}"[:200])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string()), pa.array(errors, pa.string())], [*batch.schema.names, out, f"{out}_error"])

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField(out, StringType()), StructField(f"{out}_error", StringType())]))


def call_vector(df: DataFrame, signal: str, model: Callable, out: str = "embedding") -> DataFrame:
    """``df`` with ``out``, the model's vector for each signal (null on failure)."""
    from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            found = []
            for value in batch.column(signal).to_pylist():
                try:
                    found.append(np.asarray(model(np.asarray(value, np.float32)), np.float32).tolist())
                except Exception:  # an unusable segment has no embedding
                    found.append(None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.float32()))], [*batch.schema.names, out])

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField(out, ArrayType(FloatType()))]))


def transcribe(turns: DataFrame, model: Callable[..., str], signal: str = "signal") -> DataFrame:
    """Turns with the recogniser's text; turns without any are dropped."""
    said = call_text(turns, [signal], model, "text")
    return said.withColumn("text", T.strip(F.col("text"))).where("text != ''")


def chunk_lines(utts: DataFrame, speakers: DataFrame) -> DataFrame:
    from colloquy.operators.speakers import with_names

    return with_names(utts, speakers).select("meeting_id", "seq", T.chunk_line(F.col("t0"), F.col("name"), F.col("text")).alias("line"))


def heuristic(utts: DataFrame) -> DataFrame:
    """(meeting_id, raw): the report without a model, chapters only, as JSON text."""
    made = runs.chapters(utts).groupBy("meeting_id").agg(F.array_sort(F.collect_list(F.struct("seq", "t", "titre", "resume"))).alias("c"))
    chapters = F.transform("c", lambda c: F.struct(c["t"].alias("t"), c["titre"].alias("titre"), c["resume"].alias("resume")))
    return made.select("meeting_id", F.to_json(F.struct(F.array(F.lit(NO_MODEL)).alias("resume"), chapters.alias("chapitres"))).alias("raw"))


#: What a partial note may hold; the keys of the report itself are those of its schema.
NOTE = "points: [text], decisions: [{decision, contexte, t}], actions: [{action, responsable, echeance}], citations: [{speaker, texte, t}], themes: [text]"


def _shape(kind) -> str:
    """A Spark type as a prompt spells it."""
    from pyspark.sql.types import ArrayType, StructType

    if isinstance(kind, ArrayType):
        return f"[{_shape(kind.elementType)}]"
    if isinstance(kind, StructType):
        return "{" + ", ".join(f.name if not isinstance(f.dataType, ArrayType) else f"{f.name}: {_shape(f.dataType)}" for f in kind.fields) + "}"
    return "text"


def instructions(task: str, language: str = "fr", context: str = "") -> str:
    """The prompt of a task, ``map`` (notes of an excerpt) or ``reduce`` (the report from notes): what to write, in
    which language, and the keys of its JSON. A context of at most ``CONTEXT_CHARS`` follows."""
    from pyspark.sql.types import _parse_datatype_string

    if task == "map":
        lines = [f"Take notes of this excerpt of a transcript, in {language}: faithful, nothing invented.", f"Answer with one JSON object: {{{NOTE}}}.", "Lines begin with their time in seconds, as in [1979s]: copy that whole number into t. Each decision and quotation keeps the time it comes from."]
    else:
        kinds = _parse_datatype_string(f"struct<{R.LISTED}>")
        lines = [f"Write the report of a meeting from these partial notes, in {language}: faithful to them, nothing invented.", "Answer with strict JSON of exactly these keys: " + "; ".join(f"{f.name}: {_shape(f.dataType)}" for f in kinds.fields) + ". t is in seconds."]
    brief = context.strip()[:CONTEXT_CHARS]
    block = ["", "What the user says of the meeting (people, names, terms). Use it to spell names and to frame the notes, never as a source of facts:", brief] if brief else []
    return "\n".join([task, *lines, *block])


def context_brief(spark, inline: str = "", path: str = "") -> str:
    """The text of the file, if one is given, else the inline text; a file that can't be read is an error."""
    if not path:
        return inline
    return spark.read.text(path, wholetext=True).first()[0]


def synthesize(utts: DataFrame, speakers: DataFrame, model: Callable[[str, str], str] | None, title: str = "", date: str = "", lieu: str = "", context: str = "", max_chars: int = runs.CHUNK_CHARS, language: str = "fr") -> DataFrame:
    """(meeting_id, report, source). ``model`` takes (task, text), task being what
    ``instructions`` says: ``map`` or ``reduce``, the prompt, and the context. Chunks fail alone; a meeting without usable notes, or whose reduction is
    empty, gets the heuristic report (``source`` says which)."""
    plain = heuristic(utts)
    prompt = lambda task: F.lit(instructions(task, language, context))
    if model is None:
        written = plain.select("meeting_id", "raw", F.lit("heuristic").alias("source"))
    else:
        chunks = runs.chunk(chunk_lines(utts, speakers), max_chars)
        mapped = call_text(chunks.withColumn("task", prompt("map")), ["task", "text"], model, "note")
        object_ = F.to_json(R.lax_json(F.col("note")))
        notes = mapped.where("note_error is null").select("meeting_id", "chunk", object_.alias("part"))
        # the cut at NOTES_CHARS is the model's window, as documented for the reduce call
        joined = notes.groupBy("meeting_id").agg(F.sum((F.col("part") != "{}").cast("int")).alias("usable"), F.expr("listagg(part, ', ') within group (order by chunk)").alias("all"))
        joined = joined.where("usable > 0").select("meeting_id", F.left(F.concat(F.lit("["), F.col("all"), F.lit("]")), F.lit(NOTES_CHARS)).alias("notes"))
        reduced = call_text(joined.withColumn("task", prompt("reduce")), ["task", "notes"], model, "final")
        good = reduced.select("meeting_id", F.to_json(R.lax_json(F.col("final"))).alias("final")).where("final != '{}'")
        written = plain.join(good, "meeting_id", "left").select("meeting_id", F.coalesce("final", "raw").alias("raw"), F.when(F.col("final").isNull(), "heuristic").otherwise("model").alias("source"))
    meta = runs.durations(utts).select("meeting_id", F.struct(F.lit(title or "Compte-rendu").alias("titre"), F.coalesce(F.nullif(F.lit(date), F.lit("")), F.current_date().cast("string")).alias("date"), F.lit("").alias("horaire"), F.lit(lieu).alias("lieu"), T.hms(F.floor("duration")).alias("duree")).alias("meta"))
    party = speakers.groupBy("meeting_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("speaker", F.struct("name", "role"))))).alias("party"))
    rows = written.join(meta, "meeting_id").join(party, "meeting_id", "left")
    full = rows.withColumn("report", R.normalize_report(F.col("raw")))
    return full.select("meeting_id", F.col("report").withField("meta", F.from_json(F.to_json("meta"), R.META)).withField("speakers", F.from_json(F.to_json("party"), R.SPEAKERS)).alias("report"), "source")
