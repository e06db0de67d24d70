"""Mixture-controlled packing by deficit round robin over source queues.

Documents become ids; each source's documents stand in a queue, in a seeded order, cut into packets of at
most ``packet`` ids. In every round a source's deficit grows by its quantum, its share of a window of
``window`` ids, and the source sends packets while the deficit covers them; what is left is carried to the
next round. As all documents are there from the start, the round of a packet needs no simulation: it is the
first in which the credit of all rounds so far reaches the packet's end in its queue, ceil(end / quantum).
So the deficits that a window or a partition leaves behind are prefix sums, and tasks need not wait for
each other. The packets, in order of rounds, fill windows to the last id: a packet at a window's end is cut,
and its rest opens the next. Only the tail of all is shorter; it is cut into sequences whose lengths are
powers of two, so nothing is padded.

Targets are shares of ids by source: those of the table itself (all queues then end together), or given
weights (a queue that has run out leaves its share to the others).

Scale: ids are made once, written, and shuffled once, to meet their places; everything else moves numbers
only. Queues and rounds are dealt by range, and summed within tasks and then over tasks, so a source with a
third of all rows is as many tasks as others together. The table of sources is never collected.

Ids by words: the tokenizer never joins what ASCII white space parts, so each distinct word of a task is
encoded once and looked up afterwards; the table of words is emptied when it has grown to a bound.

Edge cases: a null text is an empty one and has its end id only; null sources are one source, the first;
rows that repeat, share an id or have none are documents of their own; ties in the order go by id and
content; very long texts are as many packets as they need; an empty table gives an empty result; a source
without a weight, or with one that is not positive, is an error. Other columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.llm._common import chunks, materialize, pack, running, small_batches, unpack

WINDOW, PACKET, END, SEED = 2048, 256, 1, "pack-1"
#: Words and characters of words beyond which a task forgets the ids of all words and learns them anew.
_KEPT_WORDS, _KEPT_CHARS = 1 << 19, 1 << 25
#: Text that a task works on at once, but for single longer ones.
_CHUNK_BYTES = 4 << 20
_ENCODED = "row long, doc_id long, source string, n long, mark long, ids binary"


#: Words whose ids are worked out without the tokenizer's own text steps: printable ASCII and the letters of
#: Latin-1, which normalisation only lowers, letter by letter, and which white space can't part.
_SIMPLE = r"[!-~À-ÖØ-öø-ÿ]+"
#: What the tokenizer splits lower-case words of this kind into.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+"


class _Words(dict):
    """Numbers of words; those met for the first time are listed in ``fresh``."""

    def __init__(self):
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.fresh.append(word)
        return n


class _Pieces(dict):
    """Ids of what words are split into."""

    def __init__(self, tokenize, spelt: dict[int, str]):
        self.tokenize, self.spelt = tokenize, spelt

    def __missing__(self, piece: str) -> tuple[int, ...]:
        self[piece] = found = tuple([t.id for t in self.tokenize(piece if piece.isascii() else piece.translate(self.spelt))])
        return found


@lru_cache(maxsize=1)
def _tokenizer(path: str):
    """Read once for all tasks of a worker."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class _Encoder:
    """Ids of texts by way of their words. The ids of all known words lie end to end in ``flat``."""

    def __init__(self, path: str, end: int):
        import re

        self.whole, self.end = _tokenizer(path), end
        self.simple, self.pieces = re.compile(_SIMPLE).fullmatch, re.compile(_SPLIT).findall
        # bytes as the model's vocabulary spells them: printable Latin-1 as it is, others from U+0100 on
        plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
        others = {b: i for i, b in enumerate(b for b in range(256) if b not in plain)}
        spelt = {b: chr(b if b in plain else 256 + others[b]) for b in range(256)}
        self.known = _Pieces(self.whole.model.tokenize, {c: "".join(spelt[b] for b in chr(c).encode()) for c in range(0xC0, 0x100)})
        self.forget()

    def forget(self) -> None:
        self.number, self.chars, self.flat, self.start = _Words(), 0, np.zeros(1 << 16, np.uint32), np.zeros(1, np.int64)
        self.known.clear()

    def learn(self) -> None:
        """Adds the ids of fresh words."""
        from itertools import chain

        made, slow, known = [], [], self.known
        for i, word in enumerate(self.number.fresh):
            if word.isascii() and word.isalpha():
                made.append(known[word.lower()])
            elif self.simple(word) and "<|" not in word:
                low = word.lower()
                made.append(known[low] if low.isalpha() else tuple(chain.from_iterable([known[p] for p in self.pieces(low)])))
            else:
                made.append(())
                slow.append(i)
        if slow:
            for i, x in zip(slow, self.whole.encode_batch_fast([self.number.fresh[i] for i in slow], add_special_tokens=False)):
                made[i] = x.ids
        sizes = np.fromiter(map(len, made), np.int64, len(made))
        used, total = int(self.start[-1]), int(sizes.sum())
        if used + total > len(self.flat):
            self.flat = np.concatenate((self.flat[:used], np.zeros(max(used, total), np.uint32)))
        self.flat[used : used + total] = np.fromiter(chain.from_iterable(made), np.uint32, total)
        self.start = np.concatenate((self.start, used + np.cumsum(sizes)))
        self.chars += sum(map(len, self.number.fresh))
        self.number.fresh.clear()

    def __call__(self, texts) -> list[np.ndarray]:
        """Ids of each text of an Arrow column. Each distinct word of it is looked up once."""
        import pyarrow.compute as pc

        if len(self.number) > _KEPT_WORDS or self.chars > _KEPT_CHARS:
            self.forget()
        split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        words = split.flatten().dictionary_encode()
        numbers = np.fromiter(map(self.number.__getitem__, words.dictionary.to_numpy(zero_copy_only=False).tolist()), np.int64, len(words.dictionary))
        if self.number.fresh:
            self.learn()
        at = numbers[words.indices.to_numpy()]
        n = self.start[at + 1] - self.start[at]
        stop = np.concatenate(([0], np.cumsum(n)))
        ids = self.flat[np.repeat(self.start[at] - stop[:-1], n) + np.arange(int(stop[-1]))]
        offsets = split.offsets.to_numpy()
        cuts = stop[offsets - offsets[0]]
        return [np.append(ids[a:b], np.uint32(self.end)) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]


def _encode(path: str, end: int):
    def run(batches):
        from zlib import crc32

        import pyarrow as pa

        encode = _Encoder(path, end)
        for part, _, _ in chunks(batches, limit=_CHUNK_BYTES):
            made = encode(part.column("text"))
            n = pa.array([len(x) for x in made], pa.int64())
            mark = pa.array([crc32(x.astype("<u4").tobytes()) for x in made], pa.int64())
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("row", "doc_id", "source")), n, mark, pa.array(map(pack, made), pa.binary())], ["row", "doc_id", "source", "n", "mark", "ids"])

    return run


def encode(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", source: str = "source", end: int = END) -> DataFrame:
    """row (a number), doc_id, source ("1" and its name, "0" for null), n, mark (CRC-32 of the ids), ids (packed)."""
    small_batches(docs.sparkSession)
    key = F.coalesce(F.concat(F.lit("1"), F.col(source).cast("string")), F.lit("0"))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).cast("long").alias("doc_id"), key.alias("source"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(_encode(tokenizer, end), _ENCODED)


def _places(batches):
    """Rows of (places, doc_id, source, n, ids) -> a row for each piece; neighbours in a sequence become one."""
    import pyarrow as pa

    names = ["doc_id", "source", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
    for whole in batches:
        for i in range(0, whole.num_rows, 64):
            batch = whole.slice(i, 64)
            lists = batch.column("places")
            of = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            start, size, seq, at = (x.to_numpy(zero_copy_only=False) for x in lists.flatten().flatten())
            order = np.lexsort((start, of))
            of, start, size, seq, at = (x[order] for x in (of, start, size, seq, at))
            new = np.ones(len(of), bool)
            new[1:] = (of[1:] != of[:-1]) | (seq[1:] != seq[:-1]) | (at[1:] != at[:-1] + size[:-1])
            first = np.flatnonzero(new)
            size = np.add.reduceat(size, first)
            of, start, seq, at = of[first], start[first], seq[first], at[first]
            ids = [unpack(x).astype("<u4").tobytes() for x in batch.column("ids").to_pylist()]
            cut = pa.array([ids[d][4 * a : 4 * (a + n)] for d, a, n in zip(of.tolist(), start.tolist(), size.tolist())], pa.binary())
            picked = pa.array(of)
            doc, source, n = (batch.column(c).take(picked) for c in ("doc_id", "source", "n"))
            yield pa.RecordBatch.from_arrays([doc, source, pa.array(start), pa.array(size), n, pa.array(seq), pa.array(at), cut], names)


def _cuts(window: int, total: int) -> Column:
    """Where the ids from ``pos`` to ``end`` are cut: at windows, and in the last one at its sequences."""
    first, last = F.floor(F.col("pos") / window) + 1, F.floor((F.col("end") - 1) / window)
    edges = F.when(first <= last, F.transform(F.sequence(first, last), lambda w: w * window)).otherwise(F.array().cast("array<bigint>"))
    inner = F.filter(F.array(*(F.lit(x).cast("long") for x in _tail(window, total)[1:])).cast("array<bigint>"), lambda x: (x > F.col("pos")) & (x < F.col("end")))
    return F.concat(F.array("pos"), edges, inner, F.array("end"))


def _tail(window: int, total: int) -> list[int]:
    """First places of the sequences behind the last whole window: one for each power of two in what is left."""
    at, starts = total - total % window, []
    for bit in reversed(range((total % window).bit_length())):
        if total % window >> bit & 1:
            starts.append(at)
            at += 1 << bit
    return starts


def pack_documents(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: DataFrame | None = None, window: int = WINDOW, packet: int = PACKET, end: int = END, seed: str = SEED) -> DataFrame:
    """The pieces of all documents, which fill their sequences without a gap: doc_id, source, start (ids of the
    document before it), length, doc_tokens, sequence_id, offset (in the sequence), ids (little-endian unsigned
    32-bit). ``weights``: (source, weight), targets instead of the table's own shares."""
    made = materialize(encode(docs, tokenizer, doc_id, text, source, end), "encoded")
    total = made.agg(F.sum("n")).first()[0] or 0
    if weights is None:
        about, weight, whole = None, F.col("whole"), float(total)
    else:
        key = F.coalesce(F.concat(F.lit("1"), F.col("source").cast("string")), F.lit("0"))
        named = weights.select(key.alias("source"), F.col("weight").cast("decimal(20,6)").alias("weight"))
        about = materialize(made.select("source").distinct().join(named, "source", "left"), "weights")
        short = about.agg(F.sum("weight").alias("all"), F.min_by("source", F.col("weight").isNotNull() & (F.col("weight") > 0)).alias("least"), F.bool_and(F.coalesce(F.col("weight") > 0, F.lit(False))).alias("good")).first()
        if short["good"] is False:
            raise ValueError(f"source {short['least'][1:] or None!r} has no positive weight")
        weight, whole = F.col("weight").cast("double"), float(short["all"] or 0)
    seeded = F.xxhash64(F.lit(seed), "doc_id").alias("h")
    queue = running(made.select("row", "source", "n", "mark", "doc_id", seeded), ["source"], ["h", "doc_id", "mark", "n"], "n", "queue", about)
    packets = queue.withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(packet).cast("long"))))
    packets = packets.withColumn("size", F.least(F.lit(packet).cast("long"), F.col("n") - F.col("start")))
    packets = packets.withColumn("upto", F.col("before") + F.col("start") + F.col("size"))
    packets = packets.select("row", "source", "start", "size", "upto", F.ceil(F.col("upto") / (weight * F.lit(window / max(whole, 1.0)))).alias("round"))
    served = running(packets, [], ["round", "source", "upto"], "size", "served")
    served = served.select("row", "start", F.col("before").alias("pos"), (F.col("before") + F.col("size")).alias("end"))
    cut = served.withColumn("cuts", _cuts(window, total)).withColumn("j", F.explode(F.sequence(F.lit(1), F.size("cuts") - 1)))
    cut = cut.select("row", (F.col("start") + F.col("cuts")[F.col("j") - 1] - F.col("pos")).alias("start"), F.col("cuts")[F.col("j") - 1].alias("lo"), F.col("cuts")[F.col("j")].alias("hi"))
    last = total - total % window
    tail = F.array(*(F.lit(x).cast("long") for x in _tail(window, total) or [last]))
    at = F.size(F.filter(tail, lambda x: x <= F.col("lo")))
    sequence = F.when(F.col("lo") < last, F.floor(F.col("lo") / window)).otherwise(F.lit(last // window).cast("long") + at - 1)
    offset = F.when(F.col("lo") < last, F.col("lo") % window).otherwise(F.col("lo") - F.element_at(tail, at))
    places = cut.select("row", F.struct("start", (F.col("hi") - F.col("lo")).alias("size"), sequence.alias("sequence"), offset.alias("offset")).alias("place"))
    places = places.groupBy("row").agg(F.collect_list("place").alias("places"))  # as many as the document has packets
    joined = made.join(places, "row").select("places", "doc_id", "source", "n", "ids")
    pieces = joined.mapInArrow(_places, "doc_id long, source string, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")
    return pieces.withColumn("source", F.when(F.col("source") != "0", F.substring("source", 2, 1 << 30)))


def digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    """The pieces with the CRC-32 of their ids in place of these."""
    pieces = pack_documents(docs, tokenizer)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "source")
