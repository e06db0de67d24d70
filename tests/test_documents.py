import os

import pytest
from pyspark.sql import functions as F

from colloquy.functions import reports
from colloquy.operators import render
from colloquy.sources.documents import save_documents


def files(root):
    return {os.path.relpath(os.path.join(d, f), root): open(os.path.join(d, f)).read() for d, _, names in os.walk(root) for f in names}


def docs(spark, data):
    return spark.createDataFrame(data, "path string, content string, v long").repartition(3)


def test_documents_are_written_once_for_each_path(spark, tmp_path):
    root = str(tmp_path / "out")
    save_documents(docs(spark, [(f"a/{i % 7}/é {i}.md", f"text {i}\n", i) for i in range(60)] + [("top.md", None, 0)]), root)
    assert files(root) == {f"a/{i % 7}/é {i}.md": f"text {i}\n" for i in range(60)} | {"top.md": ""}
    save_documents(docs(spark, [("top.md", "zz", 1), ("top.md", "new", 2), ("./b//c.md", "c", 1), ("b/c.md", "b", 0)]), "file://" + root, "v")
    assert {k: v for k, v in files(root).items() if k in ("top.md", "b/c.md")} == {"top.md": "new", "b/c.md": "c"}
    assert not [x for x in os.listdir(root) if x.startswith("_")]


def test_a_failed_task_leaves_no_document(spark, tmp_path):
    root = str(tmp_path / "out")
    save_documents(docs(spark, [("a.md", "old", 1)]), root)
    bad = docs(spark, [(f"{i}.md", "x", i) for i in range(40)] + [("a.md", "new", 1)]).withColumn("content", F.when(F.col("v") == 33, F.raise_error(F.lit("broken"))).otherwise(F.col("content")))
    with pytest.raises(Exception, match="broken"):
        save_documents(bad, root)
    assert files(root) == {"a.md": "old"} and os.listdir(root) == ["a.md"]


@pytest.mark.parametrize("path", ["../x.md", "a/../../x.md", "/x.md", "", None, "a/"])
def test_paths_stay_below_the_root(spark, tmp_path, path):
    with pytest.raises(Exception, match="no place below the root"):
        save_documents(docs(spark, [("ok.md", "x", 1), (path, "y", 1)]), str(tmp_path / "out"))
    assert files(str(tmp_path)) == {}


def test_meetings_that_name_one_person_write_one_note(spark, tmp_path):
    report = F.from_json(F.concat(F.lit('{"meta":{"titre":"M'), F.col("id").cast("string"), F.lit('","date":"2024-01-01"},"speakers":{"S0":{"name":"Ann","role":"chair"}}}')), reports.SCHEMA)
    notes = render.vault(spark.range(3).select(F.col("id").alias("meeting_id"), report.alias("report")))
    assert notes.count() == 6
    save_documents(notes, str(tmp_path / "vault"))
    found = files(str(tmp_path / "vault"))
    assert sorted(found) == ["Meetings/2024-01-01 M0.md", "Meetings/2024-01-01 M1.md", "Meetings/2024-01-01 M2.md", "People/Ann.md"] and found["People/Ann.md"].endswith("# Ann\n")
