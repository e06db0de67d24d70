"""Language-model scoring by a weighted backoff automaton.

The model holds every word, pair and triple of words of the training documents. P(w) = (c(w) - D) / N,
and tokens not known share D V / N as one outcome, as in the base score. Longer contexts are smoothed
towards shorter ones: P(w | h) = (c(h w) + K P(w | h')) / (c(h) + K), where h' is h without its first
word. K is set for each order so that the share given to shorter contexts over all training tokens
equals the share of n-grams seen once, after Good and Turing; contexts enter by powers of two of their counts.

States are the contexts: pairs, words (and the start of a document), and the root. A state has an arc
for each n-gram that goes on from it, and a failure arc of weight K / (c(h) + K) to the state of h'.
Reading a word follows failure arcs until a state has an arc for it, and leads to the longest pair or
word that ends there and is a state. A text is read left to right, once; the state is carried from
word to word and log-probabilities add up. Pieces of long texts are read side by side: each first
reads the two words before it, which is all that a state depends on.

The automaton of the corpus is never in one place. Documents are gathered into blocks of bounded
size; a block asks for the counts of its distinct words, pairs and triples, dealt by ranges of their
hashes, so no key is hot: a frequent one costs an entry a block. With the answers a block holds the
part of the automaton that its texts can reach. What is gathered grows with the corpus, uncut.

Tokens: words of ASCII white space (A-Z lowered), then one end for each document; the first word's
context is a start. Words are known by 64-bit hashes, pairs and triples by 56-bit ones: among M
n-grams one shares its hash with another with a probability of about M / 7e16 (3e9, those of 30 GB of
text: 4e-8), and then has the sum of both counts.

Edge cases: a null text is empty and has one token, its end; rows of one id are separate documents; a
null id belongs to training; without training documents every token is unknown with probability 1; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.llm._common import U64, chunks, materialize, mix64, pack, partitions, squeeze, unpack, unsqueeze, words

BLOCK_BYTES = 8 << 20
#: Tokens of a piece that is read side by side with others.
PIECE = 256
END, START = U64(0x5851F42D4C957F2D), U64(0x14057B7EF767814F)
_ROWS = "block long, kind int, bucket int, mark long, keys binary, a binary, b binary, ids array<long>, held binary"
_NAMES = [x.split()[0] for x in _ROWS.split(", ")]
SEQUENCE, WORDS, PAIRS, TRIPLES, FACTS = 0, 1, 2, 3, 9
_BITS = {WORDS: 64, PAIRS: 56, TRIPLES: 56}


def held_out(doc_id: Column, modulus: int = 7, remainder: int = 2) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % modulus == remainder, F.lit(False))


def pack64(array: np.ndarray) -> bytes:
    planes = np.ascontiguousarray(array, U64).view(np.uint8).reshape(-1, 8).T
    return squeeze(np.ascontiguousarray(planes).tobytes())


def unpack64(data: bytes) -> np.ndarray:
    raw = np.frombuffer(unsqueeze(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(8, -1).T).view(U64).ravel()


def _sorted_keys(keys: np.ndarray) -> bytes:
    return pack64(np.diff(keys, prepend=U64(0)))


def _read_keys(data: bytes) -> np.ndarray:
    return np.cumsum(unpack64(data), dtype=U64)


def _bucket(keys: np.ndarray, bits: int, n: int) -> np.ndarray:
    """Ranges of the key space; rises with the key."""
    return ((keys >> U64(bits - 32)) * U64(n) >> U64(32)).astype(np.int64)


def _batch(rows):
    import pyarrow as pa

    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.binary())
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], _NAMES)


class Block:
    """Documents as token numbers into a sorted list of distinct word hashes."""

    def __init__(self, keys, tokens, lengths, held, ids):
        self.keys, self.tokens, self.lengths, self.held, self.ids = keys, tokens, lengths, held, ids
        first = np.cumsum(lengths) - lengths
        self.first = first
        self.state = np.empty(len(tokens), np.int64)  # the context of each token: the word before, or the start
        self.state[1:] = tokens[:-1]
        self.state[first] = len(keys)
        contexts = np.append(keys, START)
        pair = mix64(contexts[self.state] * U64(0xC2B2AE3D27D4EB4F) + self.keys[tokens]) >> U64(8)
        self.pairs, at, self.arc = np.unique(pair, return_index=True, return_inverse=True)
        self.pair_state, self.pair_word = self.state[at], tokens[at]
        later = np.ones(len(tokens), bool)  # tokens with a pair before them
        later[first] = False
        self.later = np.flatnonzero(later)
        before = self.arc[self.later - 1]
        triple = mix64(self.pairs[before] * U64(0x9FB21C651E98DF25) + self.keys[tokens[self.later]]) >> U64(8)
        self.triples, at, self.long_arc = np.unique(triple, return_index=True, return_inverse=True)
        self.triple_state, self.triple_pair = before[at], self.arc[self.later[at]]
        self.training = np.repeat(~held, lengths)

    @classmethod
    def of(cls, hashes, counts, held, ids):
        ends = np.cumsum(counts)
        keys, tokens = np.unique(np.insert(hashes, ends, END), return_inverse=True)
        return cls(keys, tokens.astype(np.int64), counts + 1, held, ids)

    def asked(self):
        """(kind, distinct keys, occurrences of each in training documents)"""
        seen = {WORDS: (self.keys, self.tokens[self.training]), PAIRS: (self.pairs, self.arc[self.training]), TRIPLES: (self.triples, self.long_arc[self.training[self.later]])}
        return [(kind, keys, np.bincount(which, minlength=len(keys)).astype(U64)) for kind, (keys, which) in seen.items()]

    def requests(self, block, n):
        rows = []
        for kind, keys, counts in self.asked():
            buckets = _bucket(keys, _BITS[kind], n)
            for b in np.unique(buckets).tolist():
                lo, hi = np.searchsorted(buckets, [b, b + 1])
                rows.append((block, kind, b, int(keys[lo:hi].sum(dtype=U64).astype(np.int64)), _sorted_keys(keys[lo:hi]), pack64(counts[lo:hi]), None, None, None))
        return rows

    def row(self, block):
        frequent = np.argsort(-np.bincount(self.tokens, minlength=len(self.keys)), kind="stable")
        rank = np.empty(len(self.keys), np.uint32)
        rank[frequent] = np.arange(len(self.keys))
        mark = np.array([x.sum(dtype=U64) for x in (self.keys, self.pairs, self.triples)]).sum(dtype=U64)
        return (block, SEQUENCE, -1, int(mark.astype(np.int64)), _sorted_keys(self.keys), pack(rank[self.tokens]), pack(np.concatenate((self.lengths, frequent))), self.ids, self.held.tobytes())

    @classmethod
    def read(cls, keys, a, b, ids, held):
        keys, rest = _read_keys(keys), unpack(b).astype(np.int64)
        return cls(keys, rest[len(ids) :][unpack(a)], rest[: len(ids)], np.frombuffer(held, bool), ids)


def _blocks(n_buckets: int, block_bytes: int, sequences: bool):
    def run(batches):
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 32
        held, ids, parts, size, made = [], [], [], 0, 0

        def flush():
            block = Block.of(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), np.array(held, bool), ids)
            if sequences:
                yield from _batch([block.row(base + made)])
            else:
                rows = block.requests(base + made, n_buckets)
                for i in range(0, len(rows), 256):
                    yield from _batch(rows[i : i + 256])

        for rows, data, offsets in chunks(batches):
            parts.append(words(data, offsets))
            ids += rows.column("doc_id").to_pylist()
            held += rows.column("held_out").to_pylist()
            size += len(data) + 64 * rows.num_rows
            if size >= block_bytes:
                yield from flush()
                held, ids, parts, size, made = [], [], [], 0, made + 1
        if ids:
            yield from flush()

    return run


def _groups(batches):
    """(bucket, kind) with its rows; a bucket is a bounded share of the key space."""
    now, rows = None, []
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in _NAMES)):
            if (row[2], row[1]) != now:
                if rows:
                    yield now, rows
                now, rows = (row[2], row[1]), []
            rows.append(row)
    if rows:
        yield now, rows


def _count(batches):
    """Answers with the counts over all blocks, and the facts of a task: for each order, how many keys
    have a count of each power of two, the sums of these counts, and how many were seen twice."""
    facts = np.zeros((3, 129), np.int64)
    for (bucket, kind), rows in _groups(batches):
        keys = [_read_keys(r[4]) for r in rows]
        distinct, where = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.zeros(len(distinct), U64)
        np.add.at(total, where, np.concatenate([unpack64(r[5]) for r in rows]))
        seen = total[total > 0].astype(np.int64)
        power = np.frexp(seen.astype(np.float64))[1] - 1
        facts[kind - 1, :64] += np.bincount(power, minlength=64)[:64]
        np.add.at(facts[kind - 1], 64 + power, seen)
        facts[kind - 1, 128] += np.count_nonzero(seen == 2)
        answer, ends = total[where], np.cumsum([len(k) for k in keys])
        yield from _batch([(r[0], kind, bucket, r[3], None, pack64(answer[e - len(k) : e]), None, None, None) for r, k, e in zip(rows, keys, ends)])
    yield from _batch([(-1, FACTS, -1, 0, None, facts.tobytes(), None, None, None)])


def _smoothing(contexts: np.ndarray, once: int) -> float:
    """K with which the shorter contexts' share of all tokens is ``once``."""
    number, total = contexts[:64].astype(np.float64), contexts[64:128].astype(np.float64)
    mean = total[number > 0] / number[number > 0]
    low, high = 1e-3, 1e6
    for _ in range(60):
        k = (low * high) ** 0.5
        low, high = (k, high) if (total[number > 0] * k / (mean + k)).sum() < once else (low, k)
    return (low * high) ** 0.5


def _gathered(batches):
    """(Block, {kind: counts}) from rows in order of block, kind, bucket."""
    block, marks, parts = None, 0, {}

    def close():
        if marks & ((1 << 64) - 1):
            raise RuntimeError("the documents came in another order when read again; pass stable=False")
        return block, {k: np.concatenate(v).astype(np.float64) if v else np.zeros(0) for k, v in parts.items()}

    for batch in batches:
        for kind, mark, keys, a, b, ids, held in zip(*(batch.column(c).to_pylist() for c in ("kind", "mark", "keys", "a", "b", "ids", "held"))):
            if kind == SEQUENCE:
                if block is not None:
                    yield close()
                block, marks, parts = Block.read(keys, a, b, ids, held), mark, {WORDS: [], PAIRS: [], TRIPLES: []}
            else:
                marks -= mark
                parts[kind].append(unpack64(a))
    if block is not None:
        yield close()


class Automaton:
    """The part of the model that a block's texts can reach.

    State 0 is the root, then come the words, the start and the pairs. Arcs are sorted by state and
    word; ``suffix`` is where a state's failure arc leads, ``failure`` that arc's weight."""

    def __init__(self, block: Block, counts: dict, facts: dict):
        one, two, three = counts[WORDS], counts[PAIRS], counts[TRIPLES]
        n, k2, k3, words_ = facts["n"], facts["k2"], facts["k3"], len(block.keys)
        self.width = words_
        self.start = 1 + words_
        pair_base = 2 + words_
        # each training document has one start, as it has one end
        end = int(np.searchsorted(block.keys, END))
        times = np.append(one, one[end])
        p1 = np.where(one > 0, np.maximum(one - facts["d"], 1e-300), facts["d"] * facts["v"]) / n if n else np.ones(words_)
        p2 = (two + k2 * p1[block.pair_word]) / (times[block.pair_state] + k2)
        p3 = (three + k3 * p2[block.triple_pair]) / (two[block.triple_state] + k3)
        pair, triple = np.flatnonzero(two), np.flatnonzero(three)
        keys = np.concatenate((np.arange(words_), (1 + block.pair_state[pair]) * words_ + block.pair_word[pair], (pair_base + block.triple_state[triple]) * words_ + block.pair_word[block.triple_pair[triple]]))
        order = np.argsort(keys, kind="stable")
        self.keys = keys[order]
        self.weights = np.log10(np.concatenate((p1, p2[pair], p3[triple])))[order]
        self.targets = np.concatenate((np.where(one > 0, 1 + np.arange(words_), 0), pair_base + pair, pair_base + block.triple_pair[triple]))[order]
        self.failure = np.concatenate(([0.0], np.log10(k2 / (times + k2)), np.log10(k3 / (two + k3))))
        self.suffix = np.concatenate((np.zeros(pair_base, np.int64), 1 + block.pair_word))

    def read(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(log-probability, next state) of a word read in each state; the root has an arc for every word."""
        state, log, left = state.copy(), np.zeros(len(state)), np.arange(len(state))
        while len(left):
            key = state[left] * self.width + word[left]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key
            log[left[hit]] += self.weights[at[hit]]
            state[left[hit]] = self.targets[at[hit]]
            left = left[~hit]
            log[left] += self.failure[state[left]]
            state[left] = self.suffix[state[left]]
        return log, state

    def walk(self, tokens: np.ndarray, first: np.ndarray, lengths: np.ndarray, piece: int = PIECE) -> np.ndarray:
        """Log-probability of each token, all texts read left to right."""
        pieces = -(-lengths // piece)
        text = np.repeat(np.arange(len(lengths)), pieces)
        number = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = first[text] + number * piece
        size = np.minimum(begin + piece, (first + lengths)[text]) - begin + 2 * (number > 0)
        order = np.argsort(-size, kind="stable")
        begin, size, number = begin[order], size[order], number[order]
        at = begin - 2 * (number > 0)
        state = np.where(number > 0, 0, self.start)
        log = np.zeros(len(tokens))
        for step in range(int(size[0]) if len(size) else 0):
            live = int(np.searchsorted(-size, -step))
            where = at[:live] + step
            gained, state = self.read(state[:live], tokens[where])
            own = where >= begin[:live]
            log[where[own]] = gained[own]
        return log


def _score(facts: dict):
    def run(batches):
        import pyarrow as pa

        n, v = facts["n"], facts["v"]
        for block, counts in _gathered(batches):
            log = Automaton(block, counts, facts).walk(block.tokens, block.first, block.lengths)
            count = counts[WORDS]
            base = np.log10((count + 1) / (n + v + 1))[block.tokens]
            add = lambda x: np.add.reduceat(x, block.first)
            size = len(block.ids)
            yield pa.RecordBatch.from_arrays(
                [pa.array(block.ids, pa.int64()), pa.array(block.held), pa.array(block.lengths), pa.array(add((count > 0)[block.tokens].astype(np.int64))), pa.array(np.full(size, n, np.int64)), pa.array(add(base)), pa.array(add(log))],
                ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    return run


def score(docs: DataFrame, held: Column | None = None, doc_id: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES, stable: bool = False) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every text; ``held``
    marks the documents not to learn from. ``stable``: the documents are read straight from files, so
    that reading them twice gives the same rows in the same order; else they are written first."""
    spark = docs.sparkSession
    n = partitions(spark)
    buckets = 4 * n
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), (held_out(F.col(doc_id)) if held is None else held).alias("held_out"))
    rows = rows if stable else materialize(rows, "texts")
    asked = rows.mapInArrow(_blocks(buckets, block_bytes, False), _ROWS).repartition(n, "bucket").sortWithinPartitions("bucket", "kind")
    counted = materialize(asked.mapInArrow(_count, _ROWS), "counts")
    facts = np.zeros((3, 129), np.int64)
    for r in counted.where(F.col("kind") == FACTS).select("a").toLocalIterator():  # 3 KB a task
        facts += np.frombuffer(r.a, np.int64).reshape(3, 129)
    once, twice = int(facts[0, 0]), int(facts[0, 128])
    known = {"n": int(facts[0, 64:128].sum()), "v": int(facts[0, :64].sum()), "d": once / (once + 2 * twice) if once and twice else 0.5, "k2": _smoothing(facts[0], facts[1, 0]), "k3": _smoothing(facts[1], facts[2, 0])}
    texts = rows.mapInArrow(_blocks(buckets, block_bytes, True), _ROWS)
    answered = texts.unionByName(counted.where(F.col("kind") != FACTS)).repartition(n, "block").sortWithinPartitions("block", "kind", "bucket")
    return answered.mapInArrow(_score(known), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
