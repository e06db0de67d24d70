"""Near-duplicate classes by Order MinHash, verified by banded alignment.

Equal texts are collapsed first. Each different text gets ``slots`` sketches: under a seeded hash
the ``ell`` least occurrence-labelled runs of ``k`` words are taken and kept in text order, so a
slot of two texts agrees with probability about J ** ell at an ordered run overlap of J. Texts that
agree in a slot share a bucket and are candidates. Texts of at most ``short`` words, whose runs are too
few for that, have as many sketches again of one run each. An edit breaks at most two runs of two words
on either side, so scattered edits at 0.8 leave J at about 0.43: 40 slots miss such a pair with
probability about (1 - 0.17) ** 40 = 0.0006, and of short texts with less than 0.000001. A candidate pair is a link if its edit similarity
over words, 1 - distance / longer length, is at least ``threshold``; the distance is found by
diagonal-wise alignment in a band of ``threshold`` width, after a bag-of-words bound.

Candidates are worked off in three rounds, each between components that the rounds before have found.
First every text meets one text: of the least members of its buckets the one that it shares most
buckets with. What is left of a bucket is then tested in cells: a bucket of at most ``block`` texts is one;
a larger one, whose texts share a common passage, is split into blocks with a cell for each two of them,
and a pair that shares several of these is taken up in the one of least key only. So each text stands in as
many cells as its bucket has blocks. Where that would be more than ``wide``, members are dealt anew by
prefix filtering in its place: texts of ``threshold`` share a labelled word among their rarest ones, so each
of these words is a cell (split into blocks where it is large itself) and unlike texts with a common passage
no longer meet. Both ways find the same pairs. In the second round a cell passes on its pairs within reach if
they are at most ``FEW`` times as many as its texts, else nothing but its key. In the third, cells of such keys
are worked off where they are: each pair within reach is aligned in the cell of its least key, but those that
other links have joined by then, and a cell gives the links that join components, fewer than it has texts. So
no group gives a row for each of its pairs. Within reach are pairs whose lengths and signatures (parities of
hashed words, at most as many of which differ as words do) leave the threshold possible. All three bounds are
exact, so no pair that shares a bucket is lost. Signatures of n texts in one cell are compared in
n * n / 2 vectorised steps, in tasks of two blocks each: of buckets of at most ``wide`` blocks, and beyond
them only where so many texts share a word that is among the rarest fifth of each, and still are in two
components. Alignment compares words by 32-bit hashes, so two different words are taken for one with a
probability of 2 ** -32.

Words are runs without ASCII white space, lower-cased and stripped of ASCII punctuation at both ends
(kept where nothing else is left).

Edge cases: a null text is empty; texts without words are near copies only of equal texts; a text of
fewer than ``k`` words has one run of all its words; rows that repeat are copies; different texts under
one id are different texts; a class is named by its least id, so a class of rows without ids has a
null one; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.llm._common import U64, chunks, materialize, mix64, partitions, shingles, squeeze, unsqueeze, words
from colloquy.llm.components import connected_components

PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
THRESHOLD, K, ELL, SLOTS, BLOCK = 0.8, 2, 2, 40, 1024
#: Blocks of a bucket up to which its members meet block by block: as many cells for each text as rare words
#: of a text of some 300 words would be.
WIDE = 64
#: Texts of at most so many words have ``slots`` more sketches, of one run each.
SHORT = 40
#: Least and most bits of a signature; between them, four to eight for each word. Cells hold signatures
#: folded to ``CELL_BITS``, pairs are then held against the whole ones.
LEAST_BITS, CELL_BITS, MOST_BITS = 256, 1 << 12, 1 << 16
#: Pairs for each text that a cell gives in the second round at most, or else none; pairs looked at at once.
FEW, PORTION = 2, 50000
#: Runs of a text that are expected under the limit below which a slot looks for its least ones.
_SURVIVORS = 18
#: Hashed cells of the table of word frequencies that orders words by rarity: its size, whatever the corpus.
_RARITY_BITS = 16
#: Bits of the bitmap of texts whose words are wanted.
_WANTED_BITS = 24


def sketch(hashes: np.ndarray, counts: np.ndarray, k: int, ell: int, slots: int) -> np.ndarray:
    """(rows, slots) hashes of the text-ordered least runs; rows without words are 0."""
    runs, per_row = shingles(hashes, counts, k)
    out = np.zeros((len(counts), slots), U64)
    full = np.flatnonzero(per_row)
    if not len(full):
        return out
    size = per_row[full]
    group = np.repeat(np.arange(len(full)), size)
    # equal runs of a row are numbered in text order
    of_row = mix64(runs + mix64(group.astype(U64)))
    order = np.argsort(of_row, kind="stable")
    same = np.concatenate(([False], of_row[order][1:] == of_row[order][:-1]))
    at = np.arange(len(runs))
    nth = np.empty(len(runs), np.int64)
    nth[order] = at - np.maximum.accumulate(np.where(same, 0, at))
    labelled = mix64(runs + nth.astype(U64) * U64(0x9E3779B97F4A7C15))
    top = np.iinfo(U64).max
    # the least values of a row lie under its limit, or else the whole row is looked at
    limit = np.where(size > _SURVIVORS, np.minimum(_SURVIVORS / size, 0.99) * 2.0**64, 0).astype(U64)
    limit = np.repeat(np.where(size > _SURVIVORS, limit, top), size)
    value = np.empty_like(labelled)
    for s in range(slots):
        seed = mix64(np.array([s + 1], U64) * U64(0xA24BAED4963EE407))[0]
        np.multiply(labelled, seed | U64(1), out=value)
        hit = np.flatnonzero(value <= limit)
        few = np.bincount(group[hit], minlength=len(full)) < np.minimum(ell, size)
        if few.any():
            hit = np.flatnonzero((value <= limit) | few[group])
        row, v = group[hit], value[hit]
        starts = np.searchsorted(row, np.arange(len(full)))
        taken = []
        for _ in range(ell):
            least = np.minimum.reduceat(v, starts)
            found = np.flatnonzero(v == least[row])
            where = np.full(len(full), -1)
            where[row[found][::-1]] = hit[found][::-1]
            where[least == top] = -1
            taken.append(where)
            v[found] = top
        picked = np.sort(np.stack(taken), axis=0)
        key = np.full(len(full), seed)
        for p in picked:
            key = mix64(key * U64(0xFF51AFD7ED558CCD) + np.where(p >= 0, runs[p], U64(0)) + U64(1))
        out[full, s] = key
    return out


def labelled(found: np.ndarray) -> np.ndarray:
    """A 64-bit number for each word and its occurrence."""
    found = np.sort(found)
    at = np.arange(len(found))
    nth = at - np.maximum.accumulate(np.where(np.concatenate(([False], found[1:] == found[:-1])), 0, at)) if len(found) else at
    return mix64(found.astype(U64) + nth.astype(U64) * U64(0x9E3779B97F4A7C15))


def folded(found: bytes) -> bytes:
    """A signature folded to ``CELL_BITS`` at most."""
    if len(found) * 8 <= CELL_BITS:
        return found
    return np.bitwise_xor.reduce(np.frombuffer(found, np.uint8).reshape(-1, CELL_BITS // 8)).tobytes()


def signature(words: np.ndarray) -> bytes:
    """Parities of the counts of labelled words by hash. Texts of twice the length have twice the bits,
    and the upper half xor the lower is the signature of half the bits."""
    bits = LEAST_BITS
    while bits < min(4 * len(words), MOST_BITS):
        bits *= 2
    at = (labelled(words) & U64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


_TEXTS = "uid long, doc_id long, h1 long, h2 long, n_words long, words binary, signature binary, whole binary, keys array<long>"


def _sketches(k: int, ell: int, slots: int, short_words: int):
    def run(batches):
        import pyarrow as pa

        for rows, data, offsets in chunks(batches):
            hashes, counts = words(data, offsets, edge=PUNCTUATION.encode())
            found = sketch(hashes, counts, k, ell, slots).view(np.int64)
            ends = np.cumsum(counts)
            low = hashes.astype(np.uint32)
            each = [low[e - n : e] for e, n in zip(ends.tolist(), counts.tolist())]
            packed, signatures = [squeeze(x.tobytes()) for x in each], [signature(x) for x in each]
            whole = [x if len(x) * 8 > CELL_BITS else None for x in signatures]
            few = (counts > 0) & (counts <= short_words)
            single = np.zeros_like(found)
            single[few] = sketch(hashes[np.repeat(few, counts)], counts[few], k, 1, slots).view(np.int64)
            both = np.concatenate((found, single), 1)
            width = np.where(few, 2 * slots, np.where(counts > 0, slots, 0))
            keys = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(width))), pa.int32()), pa.array(both[np.arange(2 * slots) < width[:, None]]))
            plain = [rows.column(c) for c in ("uid", "doc_id", "h1", "h2")]
            yield pa.RecordBatch.from_arrays([*plain, pa.array(counts, pa.int64()), pa.array(packed, pa.binary()), pa.array(map(folded, signatures), pa.binary()), pa.array(whole, pa.binary()), keys], ["uid", "doc_id", "h1", "h2", "n_words", "words", "signature", "whole", "keys"])

    return run


def within(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """The edit distance of two word sequences if it is at most ``most``, else ``most + 1``.

    The alignment is computed column by column in a band of ``most`` on either side of the diagonal,
    the differences of a column as bits of one number (Myers 1999, in the band as by Hyyrö 2003).
    """
    shared = min(len(a), len(b))
    ahead = int(np.argmin(np.append(a[:shared] == b[:shared], False)))
    a, b = a[ahead:], b[ahead:]
    shared -= ahead
    behind = int(np.argmin(np.append(a[len(a) - shared :][::-1] == b[len(b) - shared :][::-1], False)))
    a, b = a[: len(a) - behind], b[: len(b) - behind]
    n, m = len(a), len(b)
    if abs(n - m) > most:
        return most + 1
    if not n or not m or not most:
        return min(max(n, m), most + 1)
    k = min(most, max(n, m))
    places: dict[int, list[int]] = {}
    for i, word in enumerate(a.tolist()):
        places.setdefault(word, []).append(i)
    match = {}
    for word, at in places.items():
        bits = 0
        for i in at:
            bits |= 1 << i
        match[word] = bits
    # bit t of a column j stands for row j - k + t
    full = (1 << (2 * k + 1)) - 1
    up, down, distance = full & ~((1 << k) - 1), 0, min(k, n)
    enough = 2 * k + m - n
    for j, word in enumerate(b.tolist(), 1):
        same = match.get(word, 0)
        if same:
            same = (same >> (j - k - 1) if j > k else same << (k + 1 - j)) & full
        level = (((same & up) + up) ^ up) | same | down
        right, left = (down | ~(level | up)) & full, level & up
        if j <= n - k:
            distance += not level >> (2 * k) & 1
            if distance > enough:
                return most + 1
        else:
            t = n - j + k
            distance += (right >> t & 1) - (left >> t & 1)
        level = (level & full) >> 1
        up, down = left | (full & ~(level | right)), level & right
    return min(distance, most + 1)


def similarity(a: np.ndarray, b: np.ndarray, threshold: float) -> float:
    """Edit similarity over words if at least ``threshold``, else 0."""
    longer = max(len(a), len(b))
    most = int(longer * (1 - threshold) + 1e-9)
    if abs(len(a) - len(b)) > most:
        return 0.0
    (ua, ca), (ub, cb) = np.unique(a, return_counts=True), np.unique(b, return_counts=True)
    at = np.minimum(np.searchsorted(ub, ua), len(ub) - 1)
    if longer - int(np.minimum(ca, np.where(ub[at] == ua, cb[at], 0)).sum()) > most:
        return 0.0
    d = within(a, b, most)
    return 1 - d / longer if d <= most else 0.0


def _verify(threshold: float):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            left, right = batch.column("wa"), batch.column("wb")
            keep, score, last, words_a = [], [], None, None
            for i in range(batch.num_rows):
                x = left[i].as_py()
                if x is not last and x != last:
                    last, words_a = x, np.frombuffer(unsqueeze(x), np.uint32)
                s = similarity(words_a, np.frombuffer(unsqueeze(right[i].as_py()), np.uint32), threshold)
                if s:
                    keep.append(i)
                    score.append(s)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("a").take(at), batch.column("b").take(at), pa.array(score, pa.float64())], ["a", "b", "similarity"])

    return run


def _bitmap(ids: DataFrame) -> np.ndarray:
    """Hashed cells of a bitmap of a fixed size, set where an id (of the columns of ``ids``) falls."""

    def mark(batches):
        import pyarrow as pa

        for batch in batches:
            cell = np.unique(np.concatenate([_cell_of(c.to_numpy()) for c in batch.columns]))
            at, first = np.unique(cell >> 6, return_index=True)
            bits = np.bitwise_or.reduceat(U64(1) << (cell & 63).astype(U64), first) if len(cell) else cell
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(bits.view(np.int64))], ["at", "bits"])

    # 2 ** (_WANTED_BITS - 6) numbers come back, whatever the corpus
    found = ids.mapInArrow(mark, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toPandas()
    out = np.zeros(1 << (_WANTED_BITS - 6), np.int64)
    out[found["at"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64)
    return out.view(U64)


def _cell_of(ids: np.ndarray) -> np.ndarray:
    return (mix64(ids.astype(np.int64).view(U64)) >> U64(64 - _WANTED_BITS)).astype(np.int64)


def _wanted(ids: DataFrame):
    """Keeps rows whose ``uid`` is one of the ids, and those that fall in a cell of the bitmap by chance."""
    wanted = _bitmap(ids)

    def keep(batches):
        import pyarrow as pa

        for batch in batches:
            cell = _cell_of(batch.column("uid").to_numpy())
            yield batch.filter(pa.array(wanted[cell >> 6] >> (cell & 63).astype(U64) & U64(1) == 1))

    return keep


def links_of(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """(a, b, similarity) of the pairs that the alignment accepts. The words of texts that stand in no
    pair are left out before the shuffle, but for those that fall in a cell of the bitmap by chance."""
    some = texts.select("uid", "words").mapInArrow(_wanted(pairs.select("a", "b")), "uid long, words binary")
    one, two = some.toDF("a", "wa"), some.toDF("b", "wb")
    ready = pairs.join(one, "a").join(two, "b").select("a", "b", "wa", "wb")
    return ready.mapInArrow(_verify(threshold), "a long, b long, similarity double")


def _reach(n1: np.ndarray, n2: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """For texts of so many words: edits that the threshold allows, and bits that may then differ."""
    longer = np.maximum(n1, n2)
    most = (longer * (1 - threshold) + 1e-9).astype(np.int64)
    return most, n1 + n2 - 2 * (longer - most)


def _within_reach(threshold: float):
    """Of rows (a, b, na, nb, sa, sb) the pairs whose lengths and signatures allow a link."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            na, nb = batch.column("na").to_numpy(), batch.column("nb").to_numpy()
            most, bits = _reach(na, nb, threshold)
            near = np.flatnonzero(np.abs(na - nb) <= most)
            at = pa.array(near)
            both = batch.column("sa").take(at).to_pylist() + batch.column("sb").take(at).to_pylist()
            places = np.arange(len(near))
            near = near[_differing(both, places, places + len(near)) <= bits[near]]
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(near)) for c in "ab"], ["a", "b"])

    return run


def _likely(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) that signatures leave within reach."""
    facts = [texts.select(F.col("uid").alias(x), F.col("n_words").alias(f"n{x}"), F.coalesce("whole", "signature").alias(f"s{x}")) for x in "ab"]
    return pairs.join(facts[0], "a").join(facts[1], "b").mapInArrow(_within_reach(threshold), "a long, b long")


def _differing(signatures: list[bytes], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For pairs (i, j), how many bits differ at the shorter signature's size."""
    size = np.array([len(x) for x in signatures], np.int64)
    out = np.zeros(len(i), np.int64)
    low = np.minimum(size[i], size[j])
    for w in np.unique(low).tolist():
        rows = np.flatnonzero(size >= w)
        place = np.zeros(len(size), np.int64)
        place[rows] = np.arange(len(rows))
        bits = np.stack([np.bitwise_xor.reduce(np.frombuffer(signatures[r], U64).reshape(-1, w // 8)) for r in rows.tolist()])
        for at in np.array_split(np.flatnonzero(low == w), max(1, int((low == w).sum()) // 10000)):
            out[at] = np.bitwise_count(bits[place[i[at]]] ^ bits[place[j[at]]]).sum(1, dtype=np.int64)
    return out


def _met_before(key: np.ndarray, large: list[frozenset | None], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of pairs (x, y) of rows whether their texts share a larger bucket of a lesser key than the rows'."""
    out = np.zeros(len(x), bool)
    for p, (i, j) in enumerate(zip(x.tolist(), y.tolist())):
        if large[i] and large[j]:
            out[p] = min(large[i] & large[j]) < key[i]
    return out


def _whole_cells(of):
    """``of`` over tables of whole cells, from rows in order of cells (key, i, j)."""

    def run(batches):
        import pyarrow as pa

        parts: list = []
        size, last = 0, None
        for batch in batches:
            # whole cells only: what may go on in the next batch is kept
            first = 0
            cell = np.stack([batch.column(c).to_numpy() for c in ("key", "i", "j")], 1) if batch.num_rows else np.zeros((0, 3), np.int64)
            if not len(cell):
                continue
            begins = np.flatnonzero((cell[1:] != cell[:-1]).any(1)) + 1
            if last is not None and (cell[0] != last).any():
                begins = np.concatenate(([0], begins))
            if len(begins) and size + batch.num_rows >= 2000:
                cut = int(begins[-1])
                parts.append(batch.slice(0, cut))
                yield from of(pa.Table.from_batches(parts).combine_chunks())
                parts, size, first = [], 0, cut
            parts.append(batch.slice(first))
            size += batch.num_rows - first
            last = cell[-1]
        if size:
            yield from of(pa.Table.from_batches(parts).combine_chunks())

    return run


def _open_pairs(rows, threshold: float, component: np.ndarray, over: np.ndarray):
    """(group, signatures) of a table of cells, and portions (x, y) of its pairs of rows whose lengths are within
    reach: of the two sides of a cell, or of all its rows where it is a block with itself. Pairs of one component and
    those of groups that are ``over`` are left out, as these arrays stand by then."""
    cell = np.stack([rows.column(c).to_numpy() for c in ("key", "i", "j")], 1)
    group = np.concatenate(([0], np.cumsum((cell[1:] != cell[:-1]).any(1))))
    side, n = rows.column("side").to_numpy(), rows.column("n_words").to_numpy()
    own = cell[:, 1] == cell[:, 2]

    def portions():
        seen: list[tuple] = []
        held = 0
        for off in range(1, len(group)):
            x = np.flatnonzero(group[off:] == group[:-off])
            if not len(x):
                break
            y = x + off
            good = (component[x] != component[y]) & ~over[group[x]] & (own[x] | (side[x] != side[y])) & (np.abs(n[x] - n[y]) <= _reach(n[x], n[y], threshold)[0])
            if good.any():
                seen.append((x[good], y[good]))
                held += int(good.sum())
            if held > PORTION:
                yield tuple(np.concatenate(part) for part in zip(*seen))
                seen.clear()
                held = 0
        if seen:
            yield tuple(np.concatenate(part) for part in zip(*seen))

    return group, portions()


def _cell_pairs(threshold: float):
    """Pairs within reach of rows (key, i, j, side, n_words, doc, component, large, signature) in order of
    cells, ``large`` being the larger buckets of a row's text (null: the cell is of another kind). A cell that has
    more than ``FEW`` times as many as rows gives none, but its key, in ``key``."""

    def of(rows):
        import pyarrow as pa

        key, n, doc, component = (rows.column(c).to_numpy() for c in ("key", "n_words", "doc", "component"))
        signatures = rows.column("signature").to_pylist()
        large = [x and frozenset(x) for x in rows.column("large").to_pylist()]
        over = np.zeros(len(key), bool)
        group, portions = _open_pairs(rows, threshold, component, over)
        most, count = FEW * np.bincount(group, minlength=len(key)), np.zeros(len(key), np.int64)
        kept = [np.zeros(0, np.int64)] * 2
        for x, y in portions:
            near = _differing(signatures, x, y) <= _reach(n[x], n[y], threshold)[1]
            x, y = x[near], y[near]
            once = ~_met_before(key, large, x, y)
            x, y = x[once], y[once]
            count += np.bincount(group[x], minlength=len(key))
            over |= count > most
            x, y = (np.concatenate(part) for part in zip(kept, (x, y)))
            left = ~over[group[x]]
            kept = [x[left], y[left]]
        x, y = (doc[side] for side in kept)
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.nulls(len(x), pa.int64())], ["a", "b", "key"])
        held = np.unique(key[over[group]])
        none = pa.nulls(len(held), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, pa.array(held)], ["a", "b", "key"])

    return _whole_cells(of)


def _slots_of(column) -> np.ndarray:
    """(rows, slots) keys of an Arrow column of lists; short lists are filled up with what no key is less than."""
    size = np.diff(column.offsets.to_numpy())
    out = np.full((len(size), max(size.max(initial=0), 1)), np.iinfo(np.int64).max)
    out[np.arange(out.shape[1]) < size[:, None]] = column.flatten().to_numpy()
    return out


def _shared_before(key: np.ndarray, keys: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of pairs (x, y) of rows whether their texts share a key (in the same slot of ``keys``) that is less than the rows'."""
    out = np.zeros(len(x), bool)
    for at in np.array_split(np.arange(len(x)), 1 + len(x) // 10000):
        out[at] = ((keys[x[at]] == keys[y[at]]) & (keys[x[at]] < key[x[at], None])).any(1)
    return out


def _cell_links(threshold: float):
    """Links that join the components of rows (key, i, j, side, n_words, doc, component, signature, keys, words) in order
    of cells, less than there are rows: all pairs whose least shared key is the cell's are aligned, the likest of a portion
    first, but those that are in one component by then."""

    def of(rows):
        import pyarrow as pa

        key, n, doc, component = (rows.column(c).to_numpy() for c in ("key", "n_words", "doc", "component"))
        component = component.copy()
        signatures, packed = rows.column("signature").to_pylist(), rows.column("words").to_pylist()
        keys = _slots_of(rows.column("keys").combine_chunks())
        _, portions = _open_pairs(rows, threshold, component, np.zeros(len(key), bool))
        ends = []
        for x, y in portions:
            bits = _differing(signatures, x, y)
            near = np.flatnonzero(bits <= _reach(n[x], n[y], threshold)[1])
            near = near[~_shared_before(key, keys, x[near], y[near])]
            near = near[np.argsort(bits[near], kind="stable")]
            for i, j in zip(x[near].tolist(), y[near].tolist()):
                if component[i] != component[j] and similarity(*(np.frombuffer(unsqueeze(packed[r]), np.uint32) for r in (i, j)), threshold):
                    ends.append((doc[i], doc[j]))
                    component[component == component[j]] = component[i]
        a, b = np.array(ends, np.int64).reshape(-1, 2).T
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return _whole_cells(of)


def _cells(members: DataFrame, block: int, only: DataFrame | None = None) -> DataFrame:
    """(key, i, j, side, doc, component, large) of the cells of all keys (of ``only``) that stand in two components:
    one cell for each two blocks of a key's members."""
    facts = members.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo < hi")
    if only is not None:
        facts = facts.join(only, "key", "left_semi")
    facts = facts.select("key", F.ceil(F.col("n") / block).cast("long").alias("blocks"))
    dealt = members.join(facts, "key").withColumn("own", F.pmod(F.xxhash64("doc", F.lit(7)), F.col("blocks")))
    cells = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return cells.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"), "doc", "component", "large")


def _in_order(cells: DataFrame, known: DataFrame) -> DataFrame:
    """Rows of cells with what is known of their texts, a cell in one task and together."""
    cells = cells.join(known.withColumnRenamed("uid", "doc"), "doc")
    return cells.repartition(partitions(cells.sparkSession), "key", "i", "j").sortWithinPartitions("key", "i", "j")


def _between(members: DataFrame, texts: DataFrame, threshold: float, block: int) -> DataFrame:
    """Pairs (a, b) within reach between the components of each key, cell by cell, and keys not done with."""
    cells = _in_order(_cells(members, block), texts.select("uid", "n_words", "signature"))
    cells = cells.select("key", "i", "j", "side", "n_words", "doc", "component", "large", "signature")
    return cells.mapInArrow(_cell_pairs(threshold), "a long, b long, key long").distinct()


def _joined(members: DataFrame, left: DataFrame, heads: DataFrame, texts: DataFrame, wide: DataFrame, threshold: float, block: int) -> DataFrame:
    """(a, b) of links that join the components of the keys of ``left``, cell by cell. ``wide``: (doc, key) of what is no cell."""
    cells = materialize(_cells(members, block, left).drop("large"), "left")
    keep, wanted = _wanted(cells.select("doc")), "uid long, n_words long, signature binary, keys array<long>"
    heads = heads.select("uid", "n_words", "signature", "keys").mapInArrow(keep, wanted)
    no_cell = wide.groupBy(F.col("doc").alias("uid")).agg(F.collect_set("key").alias("wide"))
    own = F.transform("keys", lambda k, at: F.when(F.array_contains("wide", k), F.xxhash64("uid", at)).otherwise(k))
    known = heads.join(no_cell, "uid", "left").select("uid", "n_words", "signature", F.when(F.col("wide").isNull(), F.col("keys")).otherwise(own).alias("keys"))
    known = known.join(texts.select("uid", "words").mapInArrow(keep, "uid long, words binary"), "uid")
    cells = _in_order(cells, known).select("key", "i", "j", "side", "n_words", "doc", "component", "signature", "keys", "words")
    return cells.mapInArrow(_cell_links(threshold), "a long, b long")


def _labelled_words(packed) -> np.ndarray:
    return labelled(np.frombuffer(unsqueeze(packed), np.uint32))


def _rarity(texts: DataFrame) -> np.ndarray:
    """How many words of ``texts`` fall in each of a fixed number of hashed cells."""

    def count(batches):
        import pyarrow as pa

        total = np.zeros(1 << _RARITY_BITS, np.int64)
        for batch in batches:
            for packed in batch.column("words").to_pylist():
                total += np.bincount((_labelled_words(packed) >> U64(64 - _RARITY_BITS)).astype(np.int64), minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["cell", "n"])

    # comes back as one row of the table's size
    summed = texts.select("words").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    out = np.zeros(1 << _RARITY_BITS, np.int64)
    found = summed.toPandas()
    out[found["cell"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    return out


def _rare_words(texts: DataFrame, threshold: float) -> DataFrame:
    """(key, doc) of the rarest labelled words of each text, so many that two texts within the threshold
    have one in common, whatever the order of rarity is."""
    rarity = _rarity(texts)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            keys, docs = [], []
            for uid, packed in zip(batch.column("uid").to_pylist(), batch.column("words").to_pylist()):
                found = _labelled_words(packed)
                order = np.lexsort((found, rarity[(found >> U64(64 - _RARITY_BITS)).astype(np.int64)]))
                prefix = found[order[: len(found) - int(np.ceil(len(found) * threshold - 1e-9)) + 1]]
                keys.append(prefix)
                docs.append(np.full(len(prefix), uid))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(docs))], ["key", "doc"])

    return texts.select("uid", "words").mapInArrow(run, "key long, doc long")


def _named(members: DataFrame, labels: DataFrame) -> DataFrame:
    return members.join(labels, F.col("doc") == F.col("node"), "left").drop("node").withColumn("component", F.coalesce("component", "doc"))


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, k: int = K, ell: int = ELL, slots: int = SLOTS, block: int = BLOCK, short: int = SHORT, wide: int = WIDE) -> tuple[DataFrame, DataFrame]:
    """(doc_id, h1, h2) of every row, and a row for each different text: h1, h2 (its hashes), copy_of
    (its least id), class_id (the least id of its class), first (whether it stands for its class)."""
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = rows.select("uid", "doc_id", *text_key(F.col("text")), "text")
    texts = materialize(rows.mapInArrow(_sketches(k, ell, slots, short), _TEXTS), "sketches")  # numbers of rows are fixed here
    firsts = materialize(texts.groupBy("h1", "h2").agg(F.min("uid").alias("node"), F.min("doc_id").alias("copy_of")), "firsts")
    heads = texts.join(firsts.select(F.col("node").alias("uid")), "uid", "left_semi").where("n_words > 0")
    heads = materialize(heads.select("uid", "n_words", "signature", "whole", "keys"), "heads")
    slot = heads.select(F.col("uid").alias("doc"), F.explode("keys").alias("key"))  # a slot's number is hashed into its key
    shared = slot.groupBy("key").agg(F.min("doc").alias("pivot"), F.count(F.lit(1)).alias("n")).where("n > 1")
    buckets = materialize(slot.join(shared, "key"), "buckets")
    # each text with the pivot that it shares most buckets with
    votes = buckets.where("doc != pivot").groupBy("doc", "pivot").agg(F.count(F.lit(1)).alias("n"))
    best = votes.groupBy("doc").agg(F.max(F.struct("n", (-F.col("pivot")).alias("p"))).alias("best")).select((-F.col("best.p")).alias("a"), F.col("doc").alias("b"))
    tested = materialize(_likely(best, heads, threshold), "pairs")
    labels = _relabel(None, materialize(links_of(tested, texts, threshold), "links"))
    # members of the widest buckets in two components are dealt by their rarest words, others stay by bucket
    open_ = _named(buckets.where(F.col("n") > wide * block).select("key", "doc"), labels)
    unsettled = open_.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key")
    dealt = materialize(open_.join(unsettled, "key", "left_semi").select("doc").distinct(), "dealt")
    rare = _rare_words(texts.join(dealt, F.col("uid") == F.col("doc"), "left_semi").select("uid", "words"), threshold)
    alone = F.lit(None).cast("array<long>").alias("large")
    larger = buckets.where((F.col("n") > block) & (F.col("n") <= wide * block)).groupBy("doc").agg(F.collect_set("key").alias("large"))
    larger = larger.select(F.explode("large").alias("key"), "doc", "large")
    members = materialize(buckets.where(F.col("n") <= block).select("key", "doc", alone).union(rare.select("key", "doc", alone)).union(larger), "members")
    found = materialize(_between(_named(members, labels), heads, threshold, block), "cells")
    fresh = found.where("a is not null").select("a", "b").distinct().join(tested, ["a", "b"], "left_anti")
    pairs = materialize(_likely(fresh, heads, threshold), "pairs")
    labels = _relabel(labels, materialize(links_of(pairs, texts, threshold), "links"))
    left = found.where("key is not null").select("key").distinct()
    if not left.isEmpty():
        wide_of = buckets.where(F.col("n") > wide * block).select("doc", "key")
        labels = _relabel(labels, materialize(_joined(_named(members, labels), left, heads, texts, wide_of, threshold, block), "links"))
    # names of classes: only texts with links have others than their own
    ranked = labels.join(firsts, "node").select("node", "component", "copy_of", F.struct(F.col("copy_of").isNull().alias("none"), "copy_of", "h1", "h2").alias("rank"))
    named = ranked.groupBy("component").agg(F.min("copy_of").alias("class_id"), F.min("rank").alias("least")).join(ranked, "component")
    named = named.select("node", "class_id", (F.col("rank") == F.col("least")).alias("first"))
    found = firsts.join(named, "node", "left").select("h1", "h2", "copy_of", F.coalesce("class_id", "copy_of").alias("class_id"), F.coalesce("first", F.lit(True)).alias("first"))
    return texts.select("doc_id", "h1", "h2"), found


def text_key(text: Column) -> list[Column]:
    """Two hashes of a text (null: empty) that tell texts apart."""
    full = F.coalesce(text.cast("string"), F.lit(""))
    return [F.xxhash64(full).alias("h1"), F.xxhash64(F.lit(7), full).alias("h2")]


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """doc_id, class_id (the least id of its class) and copy_of (the least id of an equal text), one row per row of ``docs``."""
    rows, found = classes(docs, **options)
    return rows.join(found, ["h1", "h2"]).select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("class_id")).alias("class_id"), F.when(F.col("doc_id").isNotNull(), F.col("copy_of")).alias("copy_of"))


def representatives(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row of ``docs`` for each class: of the row with the least id (one without an id only where no
    other is), the text with the least hash; of rows equal in both, the one with the least other columns' hash."""
    _, found = classes(docs, doc_id, text, **options)
    found = found.where("first").select("h1", "h2", F.col("copy_of").alias("least"))
    key = [*text_key(F.col(text)), F.col(doc_id).cast("long").alias("id")]
    marked = [F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in docs.columns if c != text]
    whole = docs.select(*key, F.struct(*docs.columns).alias("row"), F.xxhash64(*marked, F.lit(0)).alias("rest"))
    same = (whole["h1"] == found["h1"]) & (whole["h2"] == found["h2"]) & whole["id"].eqNullSafe(found["least"])
    kept = whole.join(found, same, "left_semi").groupBy("h1", "h2", "id").agg(F.min_by("row", "rest").alias("row"))
    return kept.select("row.*")


def _relabel(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """(node, component) after joining components by new links."""
    if labels is None:
        return materialize(connected_components(links), "labels")
    ends = links
    for end in ("a", "b"):
        names = labels.select(F.col("node").alias(end), F.col("component").alias(f"c{end}"))
        ends = ends.join(names, end, "left").withColumn(f"c{end}", F.coalesce(f"c{end}", end))
    merged = connected_components(ends.select("ca", "cb"), "ca", "cb").withColumnRenamed("node", "old").withColumnRenamed("component", "new")
    moved = labels.join(merged, F.col("component") == F.col("old"), "left").select("node", F.coalesce("new", "component").alias("component"))
    fresh = merged.join(labels, F.col("old") == F.col("node"), "left_anti").select(F.col("old").alias("node"), F.col("new").alias("component"))
    return materialize(moved.union(fresh), "labels")
