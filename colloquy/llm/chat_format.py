"""Chat formatting: conversations as budgeted, turn-aligned training windows.

Prefix sums of turn tokens place every turn on its conversation's line; the line is cut into equal
strides, and a turn belongs to the window of the stride it starts in. A window holds the system turn
(a first turn of that role, repeated in every window), the turns that start in the last ``history``
tokens before its stride, repeated, and its own turns. The stride is half of what the budget leaves after the system turn
and the history, so a window is within the budget unless one of its own turns is longer than a
stride; turns are never cut. The loss mask is the text of the window's own assistant turns: each
assistant text once over all windows, repeated targets masked out.

A turn is ``<|im_start|>`` role, line end, text, ``<|im_end|>``, line end. Within texts and roles a
backslash is put between ``<`` and ``|`` (one more if there are some already), so that no control
string occurs; line ends and backslashes in roles are written ``\\n`` and ``\\\\``. Both are undone exactly.

Prefix sums are taken within bands of 4096 turn numbers and offset by the bands before, and windows
are formatted apart from each other, so a very long conversation is spread over tasks.

Edge cases: a null text or role is empty; a null turn comes first; turns of one number are ordered by
role and text; rows that repeat are separate turns; a null conversation id is one conversation; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.llm._common import partitions

BUDGET, HISTORY, OVERHEAD, BAND_BITS = 512, 128, 4, 12
START, END = "<|im_start|>", "<|im_end|>"
#: Pieces that a byte-level tokenizer would not merge across: the measure of a turn's tokens.
PIECE = r" ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(r"<(\\*)\|"), F.lit(r"<\\$1|"))


def escape_role(role: Column) -> Column:
    plain = F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))
    return escape(plain)


def unescape(text: str) -> str:
    import re

    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def unescape_role(role: str) -> str:
    import re

    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def windows(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """conv_id, window, formatted, loss (spans of code points), n_context (turns repeated at the start), n_turns (own), n_tokens."""
    turns = rows.select(F.col(conv_id).alias("conv_id"), F.coalesce(F.concat(F.lit("c"), F.col(conv_id).cast("string")), F.lit("n")).alias("key"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    turns = turns.withColumn("tokens", (F.regexp_count("text", F.lit(PIECE)) + OVERHEAD).cast("long")).withColumn("band", F.coalesce(F.shiftright("turn", BAND_BITS), F.lit(-(1 << 62))))
    running = Window.partitionBy("key", "band").orderBy(F.asc_nulls_first("turn"), "role", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bands = turns.groupBy("key", "band").agg(F.sum("tokens").alias("n"))
    bands = bands.withColumn("before", F.sum("n").over(Window.partitionBy("key").orderBy("band")) - F.col("n")).drop("n")
    placed = turns.withColumn("upto", F.sum("tokens").over(running)).join(bands, ["key", "band"]).withColumn("start", F.col("before") + F.col("upto") - F.col("tokens"))
    systems = placed.where((F.col("start") == 0) & (F.col("role") == "system")).select("key", F.col("text").alias("system"), F.col("tokens").alias("system_tokens"))
    placed = placed.join(systems.select("key", "system_tokens"), "key", "left")
    placed = placed.withColumn("stride", F.greatest(F.lit(max(1, budget // 8)), F.floor((budget - history - F.coalesce("system_tokens", F.lit(0))) / 2)).cast("long"))
    placed = placed.withColumn("window", F.floor(F.col("start") / F.col("stride")).cast("long"))
    held = F.least(F.lit(history), F.col("stride"))
    kept = F.col("system_tokens").isNotNull() & (F.col("start") == 0)
    # a turn that reaches over its stride's end is history too; the next window is shorter by as much
    again = ~kept & (F.col("start") >= (F.col("window") + 1) * F.col("stride") - held)
    places = F.when(again, F.array(F.struct(F.col("window").alias("window"), F.lit(False).alias("repeated")), F.struct((F.col("window") + 1).alias("window"), F.lit(True).alias("repeated")))).otherwise(F.array(F.struct(F.col("window").alias("window"), F.lit(False).alias("repeated"))))
    spread = placed.select("conv_id", "key", "start", "role", "text", "tokens", F.explode(places).alias("place"))
    # a window's turns number at most its tokens divided by OVERHEAD
    grouped = spread.groupBy("key", F.col("place.window").alias("window")).agg(F.first("conv_id").alias("conv_id"), F.sort_array(F.collect_list(F.struct("start", F.col("place.repeated").alias("repeated"), "role", "text", "tokens"))).alias("turns"))
    grouped = grouped.where(F.exists("turns", lambda t: ~t["repeated"])).join(systems, "key", "left")
    lead = F.when((F.col("window") > 0) & F.col("system").isNotNull(), F.array(F.struct(F.lit(0).cast("long").alias("start"), F.lit(True).alias("repeated"), F.lit("system").alias("role"), F.col("system").alias("text"), F.col("system_tokens").alias("tokens"))))
    grouped = grouped.withColumn("turns", F.when(lead.isNotNull(), F.concat(lead, F.col("turns"))).otherwise(F.col("turns")))
    parts = F.transform("turns", lambda t: F.struct(F.concat(F.lit(START), escape_role(t["role"]), F.lit("\n")).alias("head"), escape(t["text"]).alias("body"), ((t["role"] == "assistant") & ~t["repeated"]).alias("target")))
    done = grouped.withColumn("parts", parts)
    tail = END + "\n"
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<at:bigint,n:bigint>>").alias("spans"))

    def walk(acc, p):
        begin = acc["at"] + F.char_length(p["head"])
        n = F.char_length(p["body"]).cast("long")
        span = F.array(F.struct(begin.cast("long").alias("at"), n.alias("n")))
        return F.struct((begin + n + len(tail)).cast("long").alias("at"), F.when(p["target"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return done.select(
        "conv_id",
        "key",
        "window",
        F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit(tail))), "").alias("formatted"),
        F.aggregate("parts", zero, walk)["spans"].alias("loss"),
        F.size(F.filter("turns", lambda t: t["repeated"])).alias("n_context"),
        F.size(F.filter("turns", lambda t: ~t["repeated"])).alias("n_turns"),
        F.aggregate("turns", F.lit(0).cast("long"), lambda a, t: a + t["tokens"]).alias("n_tokens"),
    )


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The turns of a window, unescaped."""
    import re

    found = re.findall(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", formatted, re.S)
    return [(unescape_role(a), unescape(b)) for a, b in found]


def _digests(batches):
    """One row a conversation from its windows in order; nothing but running digests is held."""
    import hashlib

    import pyarrow as pa

    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_windows"]
    now, state = None, None

    def close():
        conv, turns, told, chars, loss, size, count = state
        return (conv, turns, told.hexdigest(), chars, loss.hexdigest(), size, count)

    for batch in batches:
        out = []
        for key, conv, text, spans, context in zip(*(batch.column(c).to_pylist() for c in ("key", "conv_id", "formatted", "loss", "n_context"))):
            if key != now:
                if state is not None:
                    out.append(close())
                now, state = key, [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
            for role, body in read_back(text)[context:]:
                state[1] += 1
                state[2].update(f"{role}\n{body}\n".encode())
            for s in spans:
                plain = unescape(text[s["at"] : s["at"] + s["n"]])
                state[3] += len(plain)
                state[4].update(plain.encode())
            state[5] += len(text)
            state[6] += 1
        if out:
            yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in out], schema=_schema())
    if state is not None:
        yield pa.RecordBatch.from_pylist([dict(zip(names, close()))], schema=_schema())


def _schema():
    import pyarrow as pa

    n, s = pa.int64(), pa.string()
    return pa.schema([("conv_id", n), ("n_turns", n), ("turns_sha256", s), ("loss_chars", n), ("loss_sha256", s), ("formatted_chars", n), ("n_windows", n)])


def digests(rows: DataFrame, **options) -> DataFrame:
    """Per conversation what its windows hold, read back from them."""
    made = windows(rows, **options).select(F.col("conv_id").cast("long").alias("conv_id"), "key", "window", "formatted", "loss", "n_context")
    ordered = made.repartition(partitions(rows.sparkSession), "key").sortWithinPartitions("key", "window")
    return ordered.mapInArrow(_digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long")
