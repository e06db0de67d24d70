"""Reports as language models write them, brought to one schema.

The schema says what each field should hold, and whatever stands there is read as that: one rule for
each Spark type, applied down the schema by a vectorised function over the JSON text (lists may be nested
to any depth, for which columns have no recursion). Text: strings stripped, lists joined by spaces, other
values as Python spells them (``True``, ``1.5``). A list: a bare value is a list of one. An object in a
list: a bare value is its first field.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

META = "struct<titre:string,date:string,horaire:string,lieu:string,duree:string,audio_sources:array<struct<src:string,type:string>>>"
SPEAKERS = "map<string,struct<name:string,role:string,person_id:string>>"
#: In every object the field that a bare value is taken for comes first.
LISTED = (
    "resume:array<string>,points_cles:array<string>,decisions:array<struct<decision:string,contexte:string,t:string>>,"
    "actions:array<struct<action:string,responsable:string,echeance:string>>,chapitres:array<struct<titre:string,resume:string,t:string>>,"
    "themes:array<struct<theme:string,points:array<string>>>,citations:array<struct<texte:string,speaker:string,t:string>>"
)
SCHEMA = f"struct<meta:{META},speakers:{SPEAKERS},{LISTED}>"
#: Fields that are kept as they stand.
AS_IS = ("t",)


def lax_json(raw: Column) -> Column:
    """The JSON object in a text: all of it, or its widest braces, or ``{}``; as variant."""
    inner = F.nullif(F.regexp_extract(raw, r"(?s)\{.*\}", 0), F.lit(""))
    return F.coalesce(F.try_parse_json(raw), F.try_parse_json(inner), F.parse_json(F.lit("{}")))


def quoted(text: Column) -> Column:
    """A string as Python spells it, but for control characters."""
    plain = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    single = F.concat(F.lit("'"), F.replace(plain, F.lit("'"), F.lit("\\'")), F.lit("'"))
    return F.when(F.contains(text, F.lit("'")) & ~F.contains(text, F.lit('"')), F.concat(F.lit('"'), plain, F.lit('"'))).otherwise(single)


def leaves(value):
    """What a list holds at any depth, in order, without nulls; any other value is its own leaf."""
    stack = [value]
    while stack:
        top = stack.pop()
        if isinstance(top, list):
            stack.extend(reversed(top))
        elif top is not None:
            yield top


def spelled(value) -> str:
    return " ".join(str(x).strip() for x in leaves(value)).strip()


def read_as(value, kind):
    """A JSON value as a Spark type: text, a list, or an object of those."""
    if isinstance(kind, StringType):
        return spelled(value)
    if isinstance(kind, ArrayType):
        texts = isinstance(kind.elementType, StringType)
        # nothing, or for objects a value that says nothing, is an empty list
        several = value if isinstance(value, list) else [value] if value is not None and (texts or value) else []
        found = [read_as(x, kind.elementType) for x in several]
        return [x for x in found if x] if texts else found
    if not isinstance(value, dict):
        return {kind.fields[0].name: spelled(value)}
    return {f.name: value.get(f.name) if f.name in AS_IS else read_as(value.get(f.name), f.dataType) for f in kind.fields if f.name in value or f.name not in AS_IS}


def _shape(kind: StructType):
    def run(raw):
        import json

        import pandas as pd

        def one(text: str) -> str:
            report = json.loads(text)
            report = report if isinstance(report, dict) else {}
            plain = {k: v if isinstance(v := report.get(k), dict) else {} for k in ("meta", "speakers")}
            return json.dumps(plain | read_as(report, kind), ensure_ascii=False)

        return pd.Series([one(t) for t in raw], dtype=object)

    return run


def normalize_report(raw: Column) -> Column:
    """Raw report text to the fixed schema; ``t`` is kept as its text or JSON text."""
    shaped = F.pandas_udf(_shape(StructType.fromDDL(LISTED)), StringType())
    return F.from_json(shaped(F.to_json(lax_json(raw))), SCHEMA)
