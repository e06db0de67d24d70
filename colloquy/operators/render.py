"""Rendered reports: Markdown, HTML and vault notes as text columns.

``reports`` has meeting_id and report (the normalised struct); ``transcripts`` has meeting_id, seq, t0,
speaker and text. Every meeting is rendered on its own; the transcript is aggregated by meeting first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.functions import text as T

MARKER = "<!-- notes below this line are kept -->"
# Section titles of a report.
TITLES = {"resume": "Résumé", "points_cles": "Points clés", "decisions": "Décisions", "actions": "Actions", "chapitres": "Chapitres", "themes": "Thèmes", "citations": "Citations", "transcript": "Transcript"}
DASH = "—"
# Speaker colors by position.
PALETTE = ("#2f6f5e", "#b45309", "#1d4ed8", "#9333ea", "#be123c", "#0f766e")


def _text(x: Column) -> Column:
    return F.coalesce(x, F.lit(""))


def _names(report: Column) -> Column:
    return F.transform_values(report["speakers"], lambda k, v: F.coalesce(v["name"], k))


def _who(report: Column, ref: Column) -> Column:
    return F.coalesce(F.try_element_at(_names(report), ref), ref, F.lit(""))


def _known_id(report: Column, ref: Column) -> Column:
    """A speaker's id from an id or a name (the last of that name)."""
    by_name = F.filter(F.map_keys(report["speakers"]), lambda k: F.try_element_at(_names(report), k) == ref)
    return F.when(F.map_contains_key(report["speakers"], ref), ref).otherwise(F.try_element_at(by_name, F.lit(-1)))


def _stamp(t: Column) -> Column:
    return F.when(t.isNotNull(), F.concat(F.lit(" · "), T.hms(T.seconds(t)))).otherwise(F.lit(""))


def _after(x: Column) -> Column:
    return F.when(_text(x) != "", F.concat(F.lit(f" {DASH} "), x)).otherwise(F.lit(""))


def _section(title: str, items: Column, lines: Column) -> Column:
    """A heading and its lines, an empty array where there are no items."""
    return F.when(F.size(items) > 0, F.concat(F.array(F.lit(f"\n## {title}\n")), lines)).otherwise(F.array().cast("array<string>"))


def with_transcript(reports: DataFrame, transcripts: DataFrame) -> DataFrame:
    rows = transcripts.groupBy("meeting_id").agg(F.array_sort(F.collect_list(F.struct("seq", "t0", "speaker", "text"))).alias("utts"))
    return reports.join(rows, "meeting_id", "left").withColumn("utts", F.coalesce("utts", F.array().cast("array<struct<seq:bigint,t0:double,speaker:string,text:string>>")))


def markdown(reports: DataFrame, transcripts: DataFrame, include_transcript: bool = True) -> DataFrame:
    """(meeting_id, content). Sections stand only where they have something."""
    r = F.col("report")
    bits = F.array(*(F.struct(F.lit(label).alias("label"), T.strip(_text(r["meta"][field])).alias("value")) for label, field in (("Date", "date"), ("Lieu", "lieu"), ("Durée", "duree"))))
    shown = F.filter(bits, lambda b: ~b["value"].isin("", DASH))
    head = F.array(F.concat(F.lit("# "), F.coalesce(r["meta"]["titre"], F.lit("Compte-rendu")), F.lit("\n")), F.array_join(F.transform(shown, lambda b: F.concat(F.lit("**"), b["label"], F.lit("** : "), b["value"])), "  ·  "))
    people = F.array_join(F.transform(F.map_entries(r["speakers"]), lambda e: F.concat(F.coalesce(e["value"]["name"], e["key"]), F.when(_text(e["value"]["role"]) != "", F.concat(F.lit(" ("), e["value"]["role"], F.lit(")"))).otherwise(F.lit("")))), ", ")
    party = F.when(_text(people) != "", F.array(F.concat(F.lit("\n**Participants** : "), people, F.lit("\n")))).otherwise(F.array().cast("array<string>"))
    bullet = lambda items: F.transform(items, lambda x: F.concat(F.lit("- "), x))
    table = F.array(F.lit("| Action | Responsable | Échéance |"), F.lit("|---|---|---|"))
    themes = F.flatten(F.transform(r["themes"], lambda t: F.concat(F.array(F.concat(F.lit("\n### "), _text(t["theme"]), F.lit("\n"))), F.coalesce(bullet(t["points"]), F.array().cast("array<string>")))))
    said = F.transform("utts", lambda u: F.concat(F.lit("`"), T.hms(F.floor(u["t0"])), F.lit("` **"), _who(r, u["speaker"]), F.lit("** : "), _text(u["text"])))
    parts = [
        head,
        party,
        _section(TITLES["resume"], r["resume"], r["resume"]),
        _section(TITLES["points_cles"], r["points_cles"], bullet(r["points_cles"])),
        _section(TITLES["decisions"], r["decisions"], F.transform(r["decisions"], lambda d: F.concat(F.lit("- ✓ **"), _text(d["decision"]), F.lit("**"), _after(d["contexte"])))),
        _section(TITLES["actions"], r["actions"], F.concat(table, F.transform(r["actions"], lambda a: F.concat(F.lit("| "), _text(a["action"]), F.lit(" | "), F.coalesce(a["responsable"], F.lit(DASH)), F.lit(" | "), F.coalesce(a["echeance"], F.lit(DASH)), F.lit(" |"))))),
        _section(TITLES["chapitres"], r["chapitres"], F.transform(r["chapitres"], lambda c: F.concat(F.lit("- `"), T.hms(T.seconds(c["t"])), F.lit("` **"), _text(c["titre"]), F.lit("**"), _after(c["resume"])))),
        _section(TITLES["themes"], r["themes"], themes),
        _section(TITLES["citations"], r["citations"], F.transform(r["citations"], lambda q: F.concat(F.lit("> « "), _text(q["texte"]), F.lit(f" »\n> {DASH} "), _who(r, q["speaker"]), _stamp(q["t"]), F.lit("\n")))),
    ]
    if include_transcript:
        parts.append(_section(TITLES["transcript"], F.col("utts"), said))
    return with_transcript(reports, transcripts).select("meeting_id", F.concat(F.array_join(F.concat(*parts), "\n"), F.lit("\n")).alias("content"))


def html(reports: DataFrame, transcripts: DataFrame) -> DataFrame:
    """(meeting_id, content): one page, a panel for each section, no address of any other host."""
    r, e = F.col("report"), T.html_escape
    ids = F.map_keys(r["speakers"])
    color = lambda sid: F.coalesce(F.element_at(F.array(*map(F.lit, PALETTE)), F.when(F.array_position(ids, sid) > 0, (F.pmod(F.array_position(ids, sid) - 1, F.lit(len(PALETTE))) + 1).cast("int")).otherwise(F.lit(None).cast("int"))), F.lit("#555"))
    each = lambda items, one: F.array_join(F.transform(items, one), "")
    tag = lambda name, *inner: F.concat(F.lit(f"<{name}>"), *inner, F.lit(f"</{name.split(' ')[0]}>"))
    items = lambda xs: tag("ul", each(xs, lambda x: tag("li", e(x))))
    quote = lambda q: F.concat(F.lit('<figure style="border-color:'), color(_known_id(r, q["speaker"])), F.lit('"><blockquote>« '), e(q["texte"]), F.lit(f" »</blockquote><figcaption>{DASH} "), e(_who(r, q["speaker"])), _stamp(q["t"]), F.lit("</figcaption></figure>"))
    row = lambda u: F.concat(F.lit('<div class="utt" data-speaker="'), e(u["speaker"]), F.lit('" data-text="'), F.lower(e(u["text"])), F.lit('"><time>'), T.hms(F.floor(u["t0"])), F.lit('</time><b style="color:'), color(u["speaker"]), F.lit('">'), e(_who(r, u["speaker"])), F.lit("</b> "), e(u["text"]), F.lit("</div>"))
    panels = {
        "resume": each(r["resume"], lambda x: tag("p", e(x))),
        "points_cles": items(r["points_cles"]),
        "decisions": each(r["decisions"], lambda d: tag("div", tag("strong", e(d["decision"])), F.when(_text(d["contexte"]) != "", tag("p", e(d["contexte"]))).otherwise(F.lit("")))),
        "actions": tag("table", each(r["actions"], lambda a: tag("tr", tag("td", e(a["action"])), tag("td", e(F.coalesce(a["responsable"], F.lit(DASH)))), tag("td", e(F.coalesce(a["echeance"], F.lit(DASH))))))),
        "chapitres": each(r["chapitres"], lambda c: tag("div", tag("time", T.hms(T.seconds(c["t"]))), tag("strong", e(c["titre"])), tag("p", e(c["resume"])))),
        "themes": each(r["themes"], lambda t: tag("div", tag("h3", e(t["theme"])), items(F.coalesce(t["points"], F.array().cast("array<string>"))))),
        "citations": each(r["citations"], quote),
        "transcript": each(F.col("utts"), row),
    }
    sections = F.concat(*(F.concat(F.lit(f'<section id="{name}"><h2>{TITLES[name]}</h2>'), inner, F.lit("</section>")) for name, inner in panels.items()))
    chips = each(F.map_entries(r["speakers"]), lambda s: F.concat(F.lit('<span style="background:'), color(s["key"]), F.lit('">'), e(F.coalesce(s["value"]["name"], s["key"])), F.when(_text(s["value"]["role"]) != "", F.concat(F.lit(" · "), e(s["value"]["role"]))).otherwise(F.lit("")), F.lit("</span>")))
    title = e(F.coalesce(r["meta"]["titre"], F.lit("Compte-rendu")))
    facts = F.array_join(F.filter(F.array(*(e(r["meta"][f]) for f in ("date", "horaire", "lieu", "duree"))), lambda x: x != ""), " · ")
    sources = F.coalesce(r["meta"]["audio_sources"], F.array().cast("array<struct<src:string,type:string>>"))
    audio = F.when(F.size(sources) > 0, tag("audio controls", each(sources, lambda s: F.concat(F.lit('<source src="'), e(s["src"]), F.lit('" type="'), e(s["type"]), F.lit('">'))))).otherwise(F.lit(""))
    page = F.concat(F.lit('<!DOCTYPE html><html lang="fr"><head><meta charset="utf-8"><title>'), title, F.lit('</title><link rel="stylesheet" href="assets/report.css"></head><body><header><h1>'), title, F.lit("</h1><p>"), facts, F.lit("</p>"), chips, audio, F.lit("</header>"), sections, F.lit("</body></html>\n"))
    return with_transcript(reports, transcripts).select("meeting_id", page.alias("content"))


def vault(reports: DataFrame, audio: str = "", report: str = "") -> DataFrame:
    """(meeting_id, path, content) of a note for each meeting and each speaker of it."""
    r = F.col("report")
    names = F.map_values(_names(r))
    link = lambda x: F.concat(F.lit("[["), x, F.lit("]]"))
    front = F.array(F.lit("---"), F.lit("type: meeting"), F.concat(F.lit("date: "), _text(r["meta"]["date"])), F.concat(F.lit('lieu: "'), _text(r["meta"]["lieu"]), F.lit('"')), F.concat(F.lit('duree: "'), _text(r["meta"]["duree"]), F.lit('"')), F.concat(F.lit("participants: "), T.yaml_list(F.transform(names, link))), *([F.lit(f'audio: "[[{audio}]]"')] if audio else []), *([F.lit(f'rapport: "[[{report}]]"')] if report else []), F.lit("---"))
    title = F.coalesce(r["meta"]["titre"], F.lit("Compte-rendu"))
    part = lambda name, items, body: F.when(F.size(items) > 0, F.array(F.concat(F.lit(f"## {TITLES[name]}\n"), body, F.lit("\n")))).otherwise(F.array().cast("array<string>"))
    doer = lambda a: F.when(_text(a["responsable"]) == "", F.lit("")).when(F.array_contains(names, a["responsable"]), F.concat(F.lit(" "), link(a["responsable"]))).otherwise(F.concat(F.lit(" "), a["responsable"]))
    due = lambda a: F.when(~_text(a["echeance"]).isin("", DASH), F.concat(F.lit(" 📅 "), a["echeance"])).otherwise(F.lit(""))
    lines = lambda items, one: F.array_join(F.transform(items, one), "\n")
    body = F.concat(
        F.array(F.array_join(front, "\n"), F.concat(F.lit("\n# "), title, F.lit("\n"))),
        part("resume", r["resume"], F.array_join(r["resume"], "\n\n")),
        part("decisions", r["decisions"], lines(r["decisions"], lambda d: F.concat(F.lit("- ✓ **"), _text(d["decision"]), F.lit("**"), _after(d["contexte"])))),
        part("actions", r["actions"], lines(r["actions"], lambda a: F.concat(F.lit("- [ ] "), _text(a["action"]), doer(a), due(a)))),
        part("citations", r["citations"], lines(r["citations"], lambda q: F.concat(F.lit("> « "), _text(q["texte"]), F.lit(f" » {DASH} "), link(_who(r, q["speaker"])), _stamp(q["t"])))),
    )
    meetings = reports.select("meeting_id", F.concat(F.lit("Meetings/"), T.strip(F.concat(_text(r["meta"]["date"]), F.lit(" "), title)), F.lit(".md")).alias("path"), F.array_join(body, "\n").alias("content"))
    each = reports.select("meeting_id", F.explode(F.map_entries(r["speakers"])).alias("s")).withColumn("name", F.coalesce("s.value.name", "s.key"))
    person = F.array(F.lit("---"), F.lit("type: person"), F.concat(F.lit('role: "'), _text(F.col("s.value.role")), F.lit('"')))
    person = F.concat(person, F.when(_text(F.col("s.value.person_id")) != "", F.array(F.concat(F.lit("voiceprint_id: "), F.col("s.value.person_id")))).otherwise(F.array().cast("array<string>")), F.array(F.lit("---")))
    people = each.select("meeting_id", F.concat(F.lit("People/"), T.file_name(F.col("name")), F.lit(".md")).alias("path"), F.concat(F.array_join(person, "\n"), F.lit("\n\n# "), F.col("name"), F.lit("\n")).alias("content"))
    return meetings.unionByName(people)


def preserve(new: DataFrame, old: DataFrame, marker: str = MARKER, earlier: tuple[str, ...] = ()) -> DataFrame:
    """(path, content): generated text above the marker, below it what stood below the old file's first marker.
    ``earlier``: markers that older files may have in its place; the first of them that stands in a file without
    the present one is read as it, so a vault is moved over by being written once."""
    held = F.col("content")
    for name in earlier:
        moved = F.concat(F.substring_index(held, name, 1), F.lit(marker), F.substr(held, F.locate(name, held) + len(name)))
        held = F.when(F.contains(held, F.lit(name)) & ~F.contains(held, F.lit(marker)), moved).otherwise(held)
    return new.select("path", "content").join(old.select("path", held.alias("_old")), "path", "left").select("path", T.preserve_tail(F.col("content"), F.col("_old"), marker).alias("content"))


FORMATS = ("md", "html", "vault")


def render(reports: DataFrame, transcripts: DataFrame, formats: tuple[str, ...] = ("md", "html")) -> DataFrame:
    """(meeting_id, format, path, content) in every format asked for, in any case; an unknown one is an error."""
    asked = [f.strip().lower() for f in formats if f.strip()]
    unknown = [f for f in asked if f not in FORMATS]
    if unknown or not asked:
        raise ValueError(f"formats are {', '.join(FORMATS)}; not {', '.join(unknown) or 'none'}")
    out = []
    for f in dict.fromkeys(asked):
        if f == "vault":
            out.append(vault(reports).select("meeting_id", F.lit(f).alias("format"), "path", "content"))
        else:
            made = markdown(reports, transcripts) if f == "md" else html(reports, transcripts)
            out.append(made.select("meeting_id", F.lit(f).alias("format"), F.concat(F.col("meeting_id").cast("string"), F.lit(f"/report.{f}")).alias("path"), "content"))
    from functools import reduce

    return reduce(DataFrame.unionByName, out)
