"""Byte-level BPE encoding and decoding by a global distinct-word shuffle.

Documents are gathered into blocks of bounded size. Each block explodes its pre-tokens into
(word, position) form: the distinct words, dealt out by a hash of the word, and the sequence of
word numbers by position. In the word shuffle every distinct word meets in one bucket and is
merged to ids once; the ids are joined back to the blocks that asked for it, and each block
reassembles its documents by position. A frequent word costs one entry a block, so no key is hot.

Edge cases: a null text is an empty one and has no ids; rows with equal or null ids are kept, one
result each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm._common import materialize, pack, partitions, squeeze, unpack, unsqueeze

#: Fixed: the white space of the pattern's ``\s``, the Unicode White_Space property.
SPACE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
BLOCK_CHARS = 16 << 20
_ROWS = "block long, kind int, bucket int, mark long, ids array<long>, lens binary, payload binary, extra binary"


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of base64 and rank pairs."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def plain_pattern(pattern: str) -> str:
    """``pattern`` with white space written out, as the tokenizer library reads it."""
    return pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"\S", f"[^{SPACE}]").replace(r"\s", f"[{SPACE}]")


def _explode(pattern: str, n_buckets: int, block_chars: int, words_only: bool):
    """The rows of each block: its distinct words by bucket, or its one row of word numbers by position.

    Within a bucket words keep the order in which the block has them first. ``mark`` sums checksums of
    the words by bucket, so that both kinds of row are known to be of one and the same block.
    """

    def run(batches):
        from collections import defaultdict
        from itertools import count
        from zlib import crc32

        import pyarrow as pa
        import regex
        from pyspark import TaskContext

        find = regex.compile(pattern).findall
        base = TaskContext.get().partitionId() << 32
        blocks = 0

        def flush(number, ids, parts):
            block = base + blocks
            encoded = [w.encode() for w in number]
            bucket = np.fromiter((crc32(w) % n_buckets for w in encoded), np.int64, len(encoded))
            order = np.argsort(bucket, kind="stable")
            edges = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
            dealt = [(b, [encoded[i] for i in order[edges[b] : edges[b + 1]].tolist()]) for b in np.unique(bucket).tolist()]
            if words_only:
                rows = [(block, 1, b, crc32(joined := b"".join(own)), None, pack(np.fromiter(map(len, own), np.uint32, len(own))), squeeze(joined), None) for b, own in dealt]
            else:
                flat = np.concatenate(parts).astype(np.int64)
                frequent = np.argsort(-np.bincount(flat, minlength=len(number)), kind="stable")
                rank = np.empty(len(number), np.uint32)
                rank[frequent] = np.arange(len(number))  # small numbers for frequent words pack well
                slot = np.empty(len(number), np.uint32)
                slot[order] = np.arange(len(number))
                mark = sum(crc32(b"".join(own)) for _, own in dealt)
                rows = [(block, 0, -1, mark, ids, pack(np.array([len(p) for p in parts], np.uint32)), pack(rank[flat]), pack(slot[frequent]))]
            return _batch(rows)

        number, ids, parts, chars = defaultdict(count().__next__), [], [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py() or ""
                found = find(text)
                ids.append(doc)
                if words_only:
                    number.update(dict.fromkeys(found))
                else:
                    parts.append(np.fromiter(map(number.__getitem__, found), np.uint32, len(found)))
                chars += len(text) + 16
                if chars >= block_chars:
                    yield from flush(number, ids, parts)
                    number, ids, parts, chars = defaultdict(count().__next__), [], [], 0
                    blocks += 1
        if ids:
            yield from flush(number, ids, parts)

    return run


def _batch(rows):
    import pyarrow as pa

    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary())
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["block", "kind", "bucket", "mark", "ids", "lens", "payload", "extra"])


def _merge(ranks):
    def run(batches):
        import tiktoken

        merge = tiktoken.Encoding("given", pat_str=r"[\s\S]+", mergeable_ranks=ranks.value, special_tokens={})._encode_single_piece
        now, known = None, {}
        for batch in batches:
            out = []
            for block, bucket, mark, lens, payload in zip(*(batch.column(c).to_pylist() for c in ("block", "bucket", "mark", "lens", "payload"))):
                if bucket != now:
                    now, known = bucket, {}
                data, at, found = unsqueeze(payload), 0, []
                for n in unpack(lens).tolist():
                    word = data[at : at + n]
                    at += n
                    got = known.get(word)
                    if got is None:
                        got = known[word] = merge(word)
                    found.append(got)
                out.append((block, 1, bucket, mark, None, pack(np.fromiter(map(len, found), np.uint32, len(found))), pack(np.array([i for g in found for i in g], np.uint32)), None))
            yield from _batch(out)

    return run


def _reassemble(batches):
    import pyarrow as pa

    docs, lens, words, slot, mark, counts, flat = None, None, None, None, 0, [], []

    def flush():
        n_ids = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        start = np.cumsum(n_ids) - n_ids
        ids = np.concatenate(flat) if flat else np.zeros(0, np.uint32)
        if mark or len(n_ids) != len(slot):
            raise RuntimeError("the documents came in another order when read again; pass stable=False")
        ends = np.cumsum(lens, dtype=np.int64)
        first = 0
        while first < len(docs):
            last = min(len(docs), max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + (1 << 18)))))
            lo, hi = int(ends[first - 1]) if first else 0, int(ends[last - 1])
            at = slot[words[lo:hi]].astype(np.int64)
            n = n_ids[at]
            stop = np.cumsum(n)
            picked = ids[np.repeat(start[at] - (stop - n), n) + np.arange(int(n.sum()))].astype("<u4")
            cut = np.concatenate(([0], stop))[ends[first:last] - lo]
            cut = np.concatenate(([0], cut))
            out = pa.array([picked[a:b].tobytes() for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(docs[first:last], pa.int64()), pa.array(np.diff(cut), pa.int64()), out], ["doc_id", "n_tokens", "ids"])
            first = last

    for batch in batches:
        for kind, check, own, n, payload, extra in zip(*(batch.column(c).to_pylist() for c in ("kind", "mark", "ids", "lens", "payload", "extra"))):
            if kind == 0:
                if docs is not None:
                    yield from flush()
                docs, lens, words, slot, mark, counts, flat = own, unpack(n), unpack(payload), unpack(extra), check, [], []
            else:
                mark -= check
                counts.append(unpack(n).astype(np.int64))
                flat.append(unpack(payload))
    if docs is not None:
        yield from flush()


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, doc_id: str = "doc_id", text: str = "text", block_chars: int = BLOCK_CHARS, stable: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids: the ids of each whole text as little-endian unsigned 32-bit integers.

    The documents are read twice, once for the words and once for their positions, which costs less
    disk than to keep either. ``stable``: they are read straight from files, so that both reads see
    the same rows in the same order; else they are first written to the shared folder.
    """
    spark = docs.sparkSession
    n = partitions(spark)
    table = spark.sparkContext.broadcast(ranks)  # of a fixed size: the vocabulary
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows = rows if stable else materialize(rows, "texts")
    exploded = lambda words_only: rows.mapInArrow(_explode(plain_pattern(pattern), 8 * n, block_chars, words_only), _ROWS)
    asked = exploded(True).repartition(n, "bucket").sortWithinPartitions("bucket")
    answered = asked.mapInArrow(_merge(table), _ROWS)
    back = exploded(False).unionByName(answered).repartition(n, "block").sortWithinPartitions("block", "kind", "bucket")
    return back.mapInArrow(_reassemble, "doc_id long, n_tokens long, ids binary")


def decode(encoded: DataFrame, ranks: dict[bytes, int], ids: str = "ids") -> DataFrame:
    """``encoded`` with ``decoded``: the bytes of each row's ids, looked up in the token-byte table (of a fixed size).

    An id outside the table is an error.
    """
    table = encoded.sparkSession.sparkContext.broadcast({v: k for k, v in ranks.items()})
    at = encoded.columns.index(ids)

    def run(batches):
        import pyarrow as pa

        look = table.value.__getitem__
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                out = [b"".join(map(look, np.frombuffer(x or b"", "<u4").tolist())) for x in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.binary())], [*part.schema.names, "decoded"])

    from pyspark.sql.types import BinaryType, StructField, StructType

    return encoded.mapInArrow(run, StructType([*encoded.schema.fields, StructField("decoded", BinaryType())]))


def digests(docs: DataFrame, ranks: dict[bytes, int], pattern: str, stable: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every text."""
    done = decode(encode(docs, ranks, pattern, stable=stable), ranks)
    return done.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
