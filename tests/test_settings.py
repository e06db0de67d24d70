import json

from pyspark.sql import functions as F

from colloquy import settings as s
from colloquy.functions import text as T
from colloquy.operators import stages
from colloquy.sources import readers

from .conftest import rows


def test_layers(spark, tmp_path):
    path = tmp_path / "settings.json"
    path.write_text(json.dumps({"_note": "x", "MODEL": "file", "PORT": 7, "OTHER": 1}))
    base = {"MODEL": "code", "PORT": "1", "URL": "u", "_note": "n"}
    assert s.settings(spark, base, str(path), {"COLLOQUY_PORT": "9", "PORT": "3"}) == {"MODEL": "file", "PORT": "9", "URL": "u", "_note": "n"}
    assert s.settings(spark, base, str(tmp_path / "none"), {}) == base
    for bad in ("{", "[1]", ""):
        path.write_text(bad)
        assert s.settings(spark, base, str(path), {}) == base


def test_cluster_numbers(spark):
    names = ["S0", "s3", "SS12", "7", "S-1", "S", "", None, "cluster 3", " 4", "S 5 ", "3S"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in df.select(T.cluster_number(F.col("n"))).collect()] == [0, 3, 12, 7, -1, None, None, None, None, 4, 5, None]


def test_people_json(spark, tmp_path):
    path = tmp_path / "people.json"
    person = {"id": "ann", "name": "Ann", "role": "chair", "centroid": [0.5, 1], "count": 3}
    path.write_text(json.dumps([person, {**person, "id": "bob", "extra": 1}], indent=1))
    found = readers.people_json(spark, str(path))
    assert rows(found) == [("ann", "Ann", "chair", [0.5, 1.0], 3), ("bob", "Ann", "chair", [0.5, 1.0], 3)]
    for bad in ("{", "[]", '{"id": "x"}', "[1]"):
        path.write_text(bad)
        assert readers.people_json(spark, str(path)).count() == 0
    gone = readers.people_json(spark, str(tmp_path / "none"))
    assert gone.count() == 0 and gone.schema.names == found.schema.names


def test_a_context_file_wins(spark, tmp_path):
    (tmp_path / "c.txt").write_text("from\nfile")
    assert stages.context_brief(spark, "inline", str(tmp_path / "c.txt")) == "from\nfile" and stages.context_brief(spark, "inline") == "inline"


def test_prompts_name_language_keys_and_context():
    note, report = (stages.instructions(t, "de", "Ann chairs") for t in ("map", "reduce"))
    assert note.startswith("map\n") and report.startswith("reduce\n") and all("in de" in p and p.endswith("\nAnn chairs") for p in (note, report))
    for key in ("decisions: [{decision, contexte, t}]", "themes: [{theme, points: [text]}]", "citations: [{texte, speaker, t}]", "resume: [text]"):
        assert key in report
    assert "points: [text]" in note and "context" not in stages.instructions("map").lower().replace("contexte", "")
    assert len(stages.instructions("map", context="x" * 9000)) < 8000 + 1000
