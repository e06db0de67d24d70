import json

import pytest
from pyspark.sql import functions as F

from colloquy.functions import reports as R
from colloquy.operators import audit, grounding, render, runs, stages
from colloquy.operators import speakers as S

from .conftest import rows

UTT = "meeting_id long, seq long, t0 double, t1 double, speaker string, text string"


@pytest.fixture(scope="module")
def utts(spark):
    return spark.createDataFrame([(1, 0, 0.0, 2.0, "S0", "The budget was doubled this year"), (1, 1, 2.5, 6.0, "S1", "We ship <on> Friday & that's it")], UTT)


REPORT = {
    "meta": {"titre": "Weekly", "date": "2024-05-01", "lieu": "—", "duree": "0:00:06"},
    "speakers": {"S0": {"name": "Alice", "role": "chair"}, "S1": {"name": "Bob"}},
    "resume": ["A & B"],
    "points_cles": ["one"],
    "decisions": [{"decision": "go", "contexte": "money", "t": 1}],
    "actions": [{"action": "ship", "responsable": "Bob", "echeance": "Friday"}, "call"],
    "chapitres": [{"t": "0:00:02", "titre": "start"}, "bare"],
    "themes": [{"theme": "budget", "points": ["up"]}],
    "citations": [{"speaker": "Alice", "texte": "the budget was doubled", "t": 0.0}],
}


def normal(spark, *raw):
    df = spark.createDataFrame([(i, r if isinstance(r, str) or r is None else json.dumps(r)) for i, r in enumerate(raw, 1)], "meeting_id long, raw string")
    return df.select("meeting_id", R.normalize_report(F.col("raw")).alias("report"))


LAX = [('{"a": 1}', {"a": 1}), ('Here: {"a": 1} ok', {"a": 1}), ('{"a": 1', {}), ("garbage", {}), ("", {}), (None, {})]


def test_lax_json(spark):
    df = spark.createDataFrame([(i, r) for i, (r, _) in enumerate(LAX)], "i long, raw string")
    got = [json.loads(r[0]) for r in df.orderBy("i").select(F.to_json(R.lax_json(F.col("raw")))).collect()]
    assert got == [w for _, w in LAX]


def test_drift_is_coerced(spark):
    drifted = {"resume": "one", "points_cles": None, "themes": [{"theme": ["A", "B"], "points": "solo"}], "citations": ["words"], "decisions": [{"decision": 5, "t": "0:00:28"}], "chapitres": "bare"}
    r = normal(spark, drifted).first().report
    assert r.resume == ["one"] and r.points_cles == []
    assert (r.themes[0].theme, r.themes[0].points) == ("A B", ["solo"])
    assert r.citations[0].texte == "words" and r.citations[0].speaker is None
    assert (r.decisions[0].decision, r.decisions[0].contexte, r.decisions[0].t) == ("5", "", "0:00:28")
    assert r.chapitres[0].titre == "bare"


def test_normalising_comes_to_rest(spark):
    for raw in (REPORT, {"themes": ["x", {"theme": None, "points": [1, None, ["a", "b"]]}], "actions": {"action": "x"}}, {}):
        once = normal(spark, raw)
        twice = once.select(F.to_json("report").alias("raw")).select(R.normalize_report(F.col("raw")).alias("report"))
        thrice = twice.select(F.to_json("report").alias("raw")).select(F.to_json(R.normalize_report(F.col("raw"))))
        assert thrice.first()[0] == twice.select(F.to_json("report")).first()[0]


def test_values_in_place_of_text(spark):
    drifted = {"resume": [True, 1.5, 7, None, ["a", ["b", None, "c"]], {"k": "v", "n": 1, "x": None, "f": False}, " s ", ""], "decisions": 0, "actions": False, "themes": "", "citations": [{"texte": {"q": "it's"}, "t": None}, {"t": [1]}], "chapitres": 3}
    r = normal(spark, drifted).first().report
    assert r.resume == ["True", "1.5", "7", "a b c", "{'f': False, 'k': 'v', 'n': 1, 'x': None}", "s"]  # keys in alphabetical order
    assert r.decisions == [] and r.actions == [] and r.themes == [] and [c.titre for c in r.chapitres] == ["3"]
    assert [(c.texte, c.t) for c in r.citations] == [("{'q': \"it's\"}", None), ("", "[1]")]


def test_grounded_report_is_ok(spark, utts):
    good = REPORT | {"chapitres": [{"t": 1, "titre": "x"}], "actions": [{"action": "ship"}]}
    row = grounding.verify(normal(spark, good), utts, runs.durations(utts)).first()
    assert (row.ok, row.grounding_score) == (True, 1.0)


def test_faults_are_found_in_order(spark, utts):
    bad = {"speakers": REPORT["speakers"], "citations": [{"speaker": "Zoe", "texte": "never said words", "t": 99999}], "chapitres": [{"t": 99999, "titre": "x"}], "decisions": [{"decision": " "}], "actions": [{"action": ""}]}
    found = grounding.issues(normal(spark, bad), utts, runs.durations(utts)).orderBy("kind_ord", "idx", "check_ord").collect()
    assert [r.issue for r in found] == ["citation[0] not grounded in transcript (overlap=0.00)", "citation[0] references unknown speaker 'Zoe'", "citation[0] timestamp 99999 outside [0, 6]", "chapitre[0] timestamp 99999 outside [0, 6]", "decision[0] is empty", "action[0] is empty"]
    row = grounding.verify(normal(spark, bad, {}), utts, runs.durations(utts)).orderBy("meeting_id").collect()
    assert [(r.ok, r.n_issues, r.grounding_score) for r in row] == [(False, 6, 0.0), (True, 0, 1.0)]


def test_times_keep_their_fraction(spark):
    utts = spark.createDataFrame([(1, 0, 0.0, 10.0, "S0", "words")], UTT)
    times = [11.7, -0.5, 10.9, 0, "0:11", None, "0:00:11.5"]
    found = grounding.issues(normal(spark, {"chapitres": [{"titre": "x", "t": t} for t in times]}), utts, runs.durations(utts)).orderBy("idx").collect()
    assert [r.issue for r in found] == ["chapitre[0] timestamp 11.7 outside [0, 10]", "chapitre[1] timestamp -0.5 outside [0, 10]", "chapitre[6] timestamp 0:00:11.5 outside [0, 10]"]


def test_overlap_equals_brute_force(spark):
    import random

    draw = random.Random(8)
    say = lambda n: " ".join(draw.choice("abcdefghij") for _ in range(n))
    quotes, lines = [say(draw.randrange(6)) for _ in range(30)], [say(draw.randrange(8)) for _ in range(50)]
    got = grounding.best_overlap(spark.createDataFrame([(0, i, q) for i, q in enumerate(quotes)], "meeting_id long, cite_id long, quote string"), spark.createDataFrame([(0, x) for x in lines], "meeting_id long, text string"), ["meeting_id"])
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 0.0
    want = {i: max(like(set(q.split()), set(x.split())) for x in lines) for i, q in enumerate(quotes)}
    assert {r.cite_id: round(r.best, 9) for r in got.collect()} == {i: round(b, 9) for i, b in want.items()}


def test_markdown(spark, utts):
    text = render.markdown(normal(spark, REPORT), utts).first().content
    assert text.startswith("# Weekly\n\n**Date** : 2024-05-01  ·  **Durée** : 0:00:06\n\n**Participants** : Alice (chair), Bob\n")
    for part in ("- ✓ **go** — money", "| ship | Bob | Friday |", "| call | — | — |", "- `0:00:02` **start**", "- `0:00:00` **bare**", "### budget", "> « the budget was doubled »\n> — Alice · 0:00:00", "`0:00:02` **Bob** : We ship <on> Friday & that's it"):
        assert part in text
    assert "Lieu" not in text and text.endswith("\n")
    bare = render.markdown(normal(spark, {}), utts.limit(0)).first().content
    assert bare == "# Compte-rendu\n\n\n"


def test_html(spark, utts):
    text = render.html(normal(spark, REPORT), utts).first().content
    assert "http" not in text and "A &amp; B" in text and "We ship &lt;on&gt; Friday &amp; that&#x27;s it" in text
    assert all(f'id="{name}"' in text for name in render.TITLES) and render.PALETTE[0] in text and render.PALETTE[1] in text


def test_vault(spark):
    got = {r.path: r.content for r in render.vault(normal(spark, REPORT), audio="a.mp3").collect()}
    assert set(got) == {"Meetings/2024-05-01 Weekly.md", "People/Alice.md", "People/Bob.md"}
    note = got["Meetings/2024-05-01 Weekly.md"]
    assert 'participants: ["[[Alice]]", "[[Bob]]"]' in note and "- [ ] ship [[Bob]] 📅 Friday" in note and "- [ ] call" in note and 'audio: "[[a.mp3]]"' in note


def test_formats(spark, utts):
    got = render.render(normal(spark, REPORT), utts, ("MD", " html", "vault"))
    assert rows(got.groupBy("format").count()) == [("html", 1), ("md", 1), ("vault", 3)]
    with pytest.raises(ValueError):
        render.render(normal(spark, REPORT), utts, ("pdf?",))


def test_audit(spark):
    files = spark.createDataFrame([("/x/a.html", "one\nsee http://x.y and https://z\nend"), ("/x/b.md", "clean"), ("/x/assets/c.html", "http://a")], "path string, content string")
    assert rows(audit.counts(files)) == [("/x/a.html", 1), ("/x/assets/c.html", 0), ("/x/b.md", 0)]
    assert rows(audit.hits(files), "path", "line_no") == [("/x/a.html", 2)]


def test_synthesis_isolates_failures(spark):
    data = [(m, i, 5.0 * i, 5.0 * i + 4, f"S{i % 2}", "x" * 100) for m in (1, 2, 3) for i in range(90)]
    utts = spark.createDataFrame(data, UTT)
    speakers = S.named_speakers(utts)

    def model(task, text):
        if task.startswith("map") and text.startswith("[0s]"):
            raise RuntimeError("first chunk fails")
        return "so: " + json.dumps({"resume": [task.split("\n")[-1]], "n": len(text)})

    got = stages.synthesize(utts, speakers, model, context="names of people").collect()
    assert {r.source for r in got} == {"model"} and all(r.report.resume == ["names of people"] and r.report.meta.duree == "0:07:29" for r in got)

    def down(task, text):
        raise RuntimeError("no answer")

    for broken in (down, lambda task, text: "nothing useful", None):
        got = stages.synthesize(utts, speakers, broken).collect()
        assert {r.source for r in got} == {"heuristic"} and all(len(r.report.chapitres) == 9 and r.report.speakers["S0"].name == "S0" for r in got)


def test_votes(spark):
    data = [(1, 0, 0.0, 1.0, "A", "salut Émile"), (1, 1, 1.0, 2.0, "B", "oui"), (1, 2, 2.0, 3.0, "A", "bien"), (1, 3, 3.0, 4.0, "B", "ok émile")]
    got = {(r.name, r.speaker): (round(r.votes, 6), round(r.share, 6)) for r in S.neighbour_votes(spark.createDataFrame(data, UTT), {"Emile": "émile", "Zoe": "zoe"}).collect()}
    assert got == {("Emile", "A"): (0.6, 1.0), ("Emile", "B"): (1.0, 1.0), ("Zoe", "A"): (0.0, 0.0), ("Zoe", "B"): (0.0, 0.0)}


def test_best_overlap_equals_all_pairs(spark):
    import random
    import re

    draw = random.Random(11)
    common, rare = [f"le{i}" for i in range(6)], [f"mot{i}" for i in range(120)]
    say = lambda n: " ".join(draw.choice(common if draw.random() < 0.5 else rare) for _ in range(n))
    lines = [(draw.randrange(3), say(draw.randrange(1, 16))) for _ in range(300)] + [(0, ""), (1, None)]
    quotes = []
    for i in range(90):
        g, text = draw.choice(lines[:300])
        words = text.split()
        words = draw.sample(words, draw.randrange(len(words) + 1)) + [f"neu{draw.randrange(50)}" for _ in range(draw.randrange(12))]
        quotes.append((draw.choice([g, g, (g + 1) % 3]), i, " ".join(words)))
    words = lambda t: set(re.findall(r"\w+", (t or "").lower()))
    want = {}
    for g, i, q in quotes:
        a = words(q)
        want[i] = max([len(a & words(t)) / len(a | words(t)) for h, t in lines if h == g and a | words(t)], default=0.0)
    found = grounding.best_overlap(spark.createDataFrame(quotes, "g long, cite_id long, quote string"), spark.createDataFrame(lines, "g long, text string"), ["g"])
    got = {r.cite_id: r.best for r in found.collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-12 for i in want)
    levels = [sum(low <= b < high for b in want.values()) for low, high in ((0.5, 2), (0.25, 0.5), (0.125, 0.25), (0, 0.125))]
    assert all(levels), levels


def test_notes_below_an_earlier_marker_are_kept(spark):
    new = spark.createDataFrame([("a", "new\n"), ("b", "new\n"), ("c", "new\n"), ("d", "new\n")], "path string, content string")
    old = spark.createDataFrame([("a", "x\n<!-- v1 -->\nmine <!-- v1 --> too"), ("b", f"x\n{render.MARKER}\nmine <!-- v1 -->"), ("c", "x <!-- v0 -->\nolder")], "path string, content string")
    got = {r.path: r.content for r in render.preserve(new, old, earlier=("<!-- v1 -->", "<!-- v0 -->")).collect()}
    assert got["a"].endswith(f"{render.MARKER}\nmine <!-- v1 --> too") and got["b"].endswith(f"{render.MARKER}\nmine <!-- v1 -->") and got["c"].endswith(f"{render.MARKER}\nolder")
    assert all(v.startswith("new\n") for v in got.values()) and "mine" not in got["d"]
