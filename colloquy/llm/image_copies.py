"""Local image descriptors: cropped, turned or edited copies among images.

Equal pixels are collapsed first. On two scales Harris corners are taken (the ``CORNERS`` strongest a
scale that are distinctive: at least half of their tests compare unequal values). Each corner is
turned to its intensity centroid, in steps of 10 degrees, and described by 256 comparisons of blurred
pixels within 8 pixels. Descriptors meet in six Hamming tables, keyed by each pair of their four
64-bit quarters, so two that differ in any two quarters still meet in one; those within ``MAX_BITS``
are matches. A match votes for the turn, scale and shift it implies, and images are linked by
``MIN_VOTES`` corners that agree in one cell of that space (shift cells of 8 pixels on four
overlapping grids). Classes are the connected components of links.

Images with the same corners are one from here on. Each first meets one image: of the least members of its
buckets the one that it shares most buckets with, if these are of ``MIN_VOTES`` corners. After that an image leaves its
fullest buckets, as many as hold fewer than ``MIN_VOTES`` of its corners: two that are linked share a key for
``MIN_VOTES`` corners each, so some two corners that vote for their link both stay in a bucket. What is left of a
bucket is a cell (larger ones are split into blocks with a cell for each two of them) and has a row for each
image and corner, with all corners and keys of the image. The two corners that meet imply a turn, a scale and a shift, so
the other voting corners share a key, have the same turn and scale in relation to their own one, and stand where that
shift puts them, but for the width of a vote's cell. Corners of a cell are met by key, relative turn and relative scale at
once, which leaves few unlike ones, and pairs of images with ``MIN_VOTES`` of them in place on both sides are tested in
full. A cell that has many of these (more than twice its rows, and than ``SMALL`` images can have) gives its rows
instead, and is tested whole: a task for each two blocks tests all pairs of different components and returns the links that
join components, at most one less than it has images. So all images that share a bucket and are linked are in one
class, and no bucket emits all its pairs. Links are counted within classes, all pairs, in cells of the same kind that
return one number for each image.

Images are binary portable graymaps or pixmaps (``P5``, ``P6``, one byte a sample; color is averaged).

Coordinates are of 32 bits, and scales are at most 127.

Edge cases: a null, unreadable or featureless image is alone but for equal bytes; null images are
alone; rows of one id are one image; a null id has a null class; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colloquy.llm._common import BATCH_BYTES, materialize, mix64, partitions, string_buffer
from colloquy.llm.components import connected_components
from colloquy.llm.order_minhash import _whole_cells

CORNERS, RADIUS, TURNS, MAX_BITS, MIN_VOTES, CELL, SMALL, BLOCK = (20, 12), 8, 36, 24, 6, 8, 32, 256


def decode(data: bytes | None) -> np.ndarray | None:
    """(height, width) gray values of a P5 or P6 image, None if it can't be read."""
    import re

    head = re.match(rb"P([56])\s+(?:#[^\n]*\n\s*)*(\d+)\s+(\d+)\s+(\d+)\s", data or b"")
    if not head:
        return None
    w, h, depth = int(head[2]), int(head[3]), 1 if head[1] == b"5" else 3
    raw = np.frombuffer(data, np.uint8, offset=head.end())
    if int(head[4]) > 255 or len(raw) < w * h * depth or not w * h:
        return None
    pixels = raw[: w * h * depth].reshape(h, w, depth)
    return pixels[..., 0] if depth == 1 else (pixels.astype(np.uint16).sum(2) // 3).astype(np.uint8)


def encode(pixels: np.ndarray) -> bytes:
    return b"P5 %d %d 255\n" % (pixels.shape[1], pixels.shape[0]) + np.ascontiguousarray(pixels, np.uint8).tobytes()


def picture(vector, size: int = 64, boxes: int = 28) -> np.ndarray:
    """A picture drawn from a vector: overlapping boxes whose places and grays follow from its values."""
    import zlib

    raw = np.asarray([0 if x is None else x for x in (vector if vector is not None else [])], np.float32).tobytes()
    draw = np.random.default_rng(zlib.crc32(raw))
    out = np.full((size, size), 128, np.uint8)
    x, y, w, h, gray = (draw.integers(*ends, boxes) for ends in ((-4, size), (-4, size), (6, size // 2), (6, size // 2), (20, 230)))
    for top, bottom, left, right, value in np.maximum(np.stack((y, y + h, x, x + w, gray), 1), 0).tolist():
        out[top:bottom, left:right] = value
    return out


def _box(a: np.ndarray, r: int) -> np.ndarray:
    """Sums over squares of side 2 r + 1 that lie within the last two axes."""
    for axis in (1, 2):
        n = a.shape[axis] - 2 * r
        at = [(slice(None),) * axis + (slice(d, d + n),) for d in range(2 * r + 1)]
        total = a[at[0]] + a[at[1]]
        for part in at[2:]:
            total += a[part]
        a = total
    return a


def pattern() -> np.ndarray:
    """(turns, 256, 2, 2) offsets of the compared points (dy, dx), turned by steps of 10 degrees."""
    draw = np.random.default_rng(7)
    points = []
    while len(points) < 512:
        p = draw.normal(0, RADIUS / 2, 2)
        if 1 < np.hypot(*p) < RADIUS - 0.5:
            points.append(p)
    base = np.array(points).reshape(256, 2, 2)
    out = np.empty((TURNS, 256, 2, 2), np.int64)
    for t in range(TURNS):
        c, s = np.cos(2 * np.pi * t / TURNS), np.sin(2 * np.pi * t / TURNS)
        y, x = base[..., 0], base[..., 1]
        out[t] = np.rint(np.round(np.stack((c * y + s * x, c * x - s * y), -1), 6))
    return out


def corners(images: np.ndarray, most: int, tests: np.ndarray):
    """(image, y, x, turn, descriptor as four 64-bit words) of the corners of equally large images."""
    n, h, w = images.shape
    empty = (np.zeros(0, np.int64),) * 4 + (np.zeros((0, 4), np.uint64),)
    margin = RADIUS + 2
    if h <= 2 * margin or w <= 2 * margin:
        return empty
    a = images.astype(np.int32)
    # strength is needed within the margin and one pixel around, so gradients two more
    e = margin - 3
    gy = a[:, e + 1 : h - e + 1, e : w - e] - a[:, e - 1 : h - e - 1, e : w - e]
    gx = a[:, e : h - e, e + 1 : w - e + 1] - a[:, e : h - e, e - 1 : w - e - 1]
    xx, yy, xy = (_box(p, 2).astype(np.float64) for p in (gx * gx, gy * gy, gx * gy))
    strength = xx * yy - xy * xy - 0.05 * (xx + yy) ** 2
    top = np.maximum(np.maximum(strength[:, :-2], strength[:, 1:-1]), strength[:, 2:])
    top = np.maximum(np.maximum(top[:, :, :-2], top[:, :, 1:-1]), top[:, :, 2:])
    inner = strength[:, 1:-1, 1:-1]
    image, y, x = np.nonzero((inner >= top) & (inner > 0))
    if not len(image):
        return empty
    # the strongest of each image, equal ones by place
    order = np.lexsort((-inner[image, y, x], image))
    begin = np.searchsorted(image, np.arange(n))
    order = order[np.arange(len(order)) - begin[image] < 2 * most]
    image, y, x = image[order], y[order] + margin, x[order] + margin
    span = np.arange(-RADIUS, RADIUS + 1)
    dy, dx = (g.ravel() for g in np.meshgrid(span, span, indexing="ij"))
    disc = np.hypot(dy, dx) <= RADIUS
    dy, dx = dy[disc], dx[disc]
    around = images.ravel()[((image * h + y) * w + x)[:, None] + (dy * w + dx)].astype(np.float32)
    # sums of integers under 2 ** 24 are exact
    angle = np.arctan2(*(around @ np.stack((dy, dx), 1).astype(np.float32)).astype(np.float64).T)
    turn = np.rint(angle / (2 * np.pi / TURNS)).astype(np.int64) % TURNS
    smooth = _box(images.astype(np.int16), 1).ravel()
    at = (tests[..., 0] * (w - 2) + tests[..., 1]).reshape(TURNS, -1)[turn] + ((image * (h - 2) + y - 1) * (w - 2) + x - 1)[:, None]
    seen = smooth[at]
    first, second = seen[:, ::2], seen[:, 1::2]
    order = np.flatnonzero(np.count_nonzero(first != second, axis=1) >= 128)
    begin = np.searchsorted(image[order], np.arange(n))
    order = order[np.arange(len(order)) - begin[image[order]] < most]
    words = np.packbits(first[order] < second[order], axis=1).view(">u8").astype(np.uint64)
    return image[order], y[order], x[order], turn[order], words


#: Images and pixels that are described at once.
IMAGES, PIXELS = 64, 1 << 20
_CORNER = "level: int, y: long, x: long, turn: long, q0: long, q1: long, q2: long, q3: long"


def _describe(corners_by_scale: tuple[int, ...]):
    def run(batches):
        import pyarrow as pa

        tests = pattern()
        for batch in batches:
            shapes: dict[tuple, list] = {}
            for i, data in enumerate(batch.column("image").to_pylist()):
                pixels = decode(data)
                if pixels is not None:
                    shapes.setdefault(pixels.shape, []).append((i, pixels))
            found: list = [np.zeros((0, 9), np.int64)]
            for (h, w), group in shapes.items():
                step = max(1, min(IMAGES, PIXELS // (h * w)))
                for first in range(0, len(group), step):
                    row = np.array([i for i, _ in group[first : first + step]])
                    images = np.stack([p for _, p in group[first : first + step]])
                    for level, most in enumerate(corners_by_scale):
                        if level:
                            a = images[:, : images.shape[1] // 2 * 2, : images.shape[2] // 2 * 2].astype(np.uint16)
                            images = ((a[:, ::2, ::2] + a[:, 1::2, ::2] + a[:, ::2, 1::2] + a[:, 1::2, 1::2]) // 4).astype(np.uint8)
                        image, y, x, turn, words = corners(images, most, tests)
                        found.append(np.column_stack((row[image], np.full(len(image), level), y << level, x << level, turn, words.view(np.int64))))
            flat = np.concatenate(found)
            flat = flat[np.lexsort(flat.T[::-1])]
            ends = np.concatenate(([0], np.cumsum(np.bincount(flat[:, 0], minlength=batch.num_rows))))
            fields = [pa.array(np.ascontiguousarray(v), kind) for v, kind in zip(flat.T[1:], (pa.int32(), *(pa.int64(),) * 7))]
            rows = pa.StructArray.from_arrays(fields, ["level", "y", "x", "turn", "q0", "q1", "q2", "q3"])
            yield pa.RecordBatch.from_arrays([batch.column("image_id"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows)], ["image_id", "corners"])

    return run


def _corner_lists(images: DataFrame, corners_by_scale: tuple[int, ...] = CORNERS) -> DataFrame:
    """image_id and its sorted corners of each row (image_id, image)."""
    return images.select(F.col("image_id").cast("long").alias("image_id"), "image").mapInArrow(_describe(corners_by_scale), f"image_id long, corners array<struct<{_CORNER}>>")


def describe(images: DataFrame, corners_by_scale: tuple[int, ...] = CORNERS) -> DataFrame:
    """A row for each corner of each image (image_id, image)."""
    return _corner_lists(images, corners_by_scale).select("image_id", F.inline("corners"))


def _agreeing(left: list[np.ndarray], right: list[np.ndarray], max_bits: int, min_votes: int) -> np.ndarray:
    """Of pairs of images, each a (corners, 8) array of level, y, x, turn and four quarters, whether enough corners agree."""
    out = np.zeros(len(left), bool)
    sizes = [np.array([len(x) for x in side], np.int64) for side in (left, right)]
    first = 0
    while first < len(left):
        # as many pairs at once as make about a million comparisons
        wide = [np.maximum.accumulate(n[first : first + 1000]) for n in sizes]
        count = max(1, int(np.searchsorted(wide[0] * wide[1] * np.arange(1, len(wide[0]) + 1), 1 << 20)))
        part = slice(first, first + count)
        padded = []
        for side, n, none in zip((left[part], right[part]), sizes, (-1, -2)):
            rows = np.full((len(side), int(n[part].max()), 8), none, np.int64)
            rows[np.arange(rows.shape[1]) < n[part][:, None]] = np.concatenate(side)
            padded.append(rows)
        a, b = padded
        # two quarters are equal by their lower halves first
        low_a, low_b = (np.ascontiguousarray(np.moveaxis(rows[:, :, 4:], 2, 0).astype(np.int32)) for rows in padded)
        alike = np.zeros((count := len(a), a.shape[1], b.shape[1]), np.int8)
        for x, y in zip(low_a, low_b):
            alike += x[:, :, None] == y[:, None, :]
        pair, i, j = np.nonzero(alike >= 2)
        differ = a[pair, i, 4:] ^ b[pair, j, 4:]
        near = (i < sizes[0][part][pair]) & (j < sizes[1][part][pair]) & ((differ == 0).sum(1) >= 2) & (np.bitwise_count(differ.view(np.uint64)).sum(1, dtype=np.int64) <= max_bits)
        pair, i, j = pair[near], i[near], j[near]
        # only pairs with enough matches can have enough that agree
        most = [np.bincount(np.unique(pair * alike.shape[d + 1] + at) // alike.shape[d + 1], minlength=count) for d, at in enumerate((i, j))]
        rich = (np.minimum(*most) >= min_votes)[pair]
        pair, i, j = pair[rich], i[rich], j[rich]
        if len(pair):
            (la, ya, xa, ta), (lb, yb, xb, tb) = a[pair, i, :4].T, b[pair, j, :4].T
            spin, zoom = (tb - ta) % TURNS, lb - la
            angle, scale = np.radians(spin * (360 / TURNS)), 2.0**zoom
            ty = yb - scale * (np.cos(angle) * ya + np.sin(angle) * xa)
            tx = xb - scale * (np.cos(angle) * xa - np.sin(angle) * ya)
            for g in range(4):
                cell = np.stack((pair, spin, zoom, np.floor((ty + CELL / 2 * (g // 2)) / CELL).astype(np.int64), np.floor((tx + CELL / 2 * (g % 2)) / CELL).astype(np.int64)), 1)
                cell, of = np.unique(cell, axis=0, return_inverse=True)
                votes = [np.bincount(np.unique(np.stack((of.ravel(), level, y, x), 1), axis=0)[:, 0], minlength=len(cell)) for level, y, x in ((la, ya, xa), (lb, yb, xb))]
                out[first + cell[np.minimum(*votes) >= min_votes, 0]] = True
        first += count
    return out


def _fields(column) -> np.ndarray:
    """An array (items, fields) of all items of an Arrow column of lists of structs of numbers."""
    return np.stack([x.to_numpy().astype(np.int64) for x in column.flatten().flatten()], 1)


def _lists_of(column) -> list[np.ndarray]:
    """An array (items, fields) for each list of structs of numbers of an Arrow column."""
    flat = _fields(column)
    ends = np.cumsum(np.diff(column.offsets.to_numpy()))
    return np.split(flat, ends[:-1]) if len(ends) else []


def _test_pairs(max_bits: int, min_votes: int):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            good = pa.array(_agreeing(_lists_of(batch.column("corners_a")), _lists_of(batch.column("corners_b")), max_bits, min_votes))
            yield batch.select(["a", "b"]).filter(good)

    return run


def _pairs_of(cell) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (x, y) of a cell's rows, x of the lesser node: of its two sides, or of all rows of one block, in strips."""
    side, node = cell.column("side").to_numpy(), cell.column("node").to_numpy()
    own = cell.column("i")[0].as_py() == cell.column("j")[0].as_py()
    for x in range(len(node)):
        y = np.arange(x + 1, len(node))
        y = y if own else y[side[y] != side[x]]
        if len(y):
            less = node[x] < node[y]
            yield np.where(less, x, y), np.where(less, y, x)


def _join_cell(max_bits: int, min_votes: int):
    """Links of a cell that join its components: all pairs are tested but those that are in one component by then."""

    def run(cell):
        import pyarrow as pa

        cell = cell.combine_chunks()
        node, corners = cell.column("node").to_numpy(), _lists_of(cell.column("corners").combine_chunks())
        component, known = cell.column("component").to_numpy().copy(), [_known(c) for c in corners]
        ends = []
        for x, y in _pairs_of(cell):
            open_ = component[x] != component[y]
            x, y = x[open_], y[open_]
            rich = _rich(known, x, y, min_votes)
            x, y = x[rich], y[rich]
            good = _agreeing([corners[i] for i in x], [corners[i] for i in y], max_bits, min_votes)
            for i, j in zip(x[good].tolist(), y[good].tolist()):
                if component[i] != component[j]:
                    ends.append((node[i], node[j]))
                    component[component == component[j]] = component[i]
        a, b = np.array(ends, np.int64).reshape(-1, 2).T
        return pa.table({"a": pa.array(a), "b": pa.array(b)})

    return run


def _count_links(max_bits: int, min_votes: int):
    """Of a cell's nodes, how many images they are linked to by the pairs of the cell."""

    def run(cell):
        import pyarrow as pa

        cell = cell.combine_chunks()
        images, corners = cell.column("images").to_numpy(), _lists_of(cell.column("corners").combine_chunks())
        links = np.zeros(len(images), np.int64)
        for x, y in _pairs_of(cell):
            good = _agreeing([corners[i] for i in x], [corners[i] for i in y], max_bits, min_votes)
            np.add.at(links, x[good], images[y[good]])
            np.add.at(links, y[good], images[x[good]])
        return pa.table({"node": cell.column("node"), "n": pa.array(links)})

    return run


def _flat(batch) -> tuple[np.ndarray, ...]:
    """(row, n, key, at, ...) of all keys of a batch of images with their keys."""
    fields = _fields(batch.column("keys"))
    return (np.repeat(np.arange(batch.num_rows), np.diff(batch.column("keys").offsets.to_numpy())), *fields.T)


def _kept(row: np.ndarray, n: np.ndarray, key: np.ndarray, at: np.ndarray, min_votes: int) -> np.ndarray:
    """Places of the keys that are left of each row without its fullest ones of less than ``min_votes`` corners."""
    order = np.lexsort((~key, -n, row))
    row, key, at = row[order], key[order], at[order]
    _, first = np.unique(row << 32 | at, return_index=True)
    count = np.cumsum(np.bincount(first, minlength=len(order)))
    begin = np.searchsorted(row, row)
    enough = count - count[begin] + 1 >= min_votes
    # a key is kept with all of its corners, or not at all
    run = np.cumsum(np.concatenate(([True], (key[1:] != key[:-1]) | (row[1:] != row[:-1]))))
    return order[np.isin(run, run[enough])]


def _rare_keys(min_votes: int):
    """Of images with their keys (node, keys: a list of n, key, at; n: how full the key is, at: the corner's number)
    the keys that are left without the fullest ones of less than ``min_votes`` corners."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            row, n, key, at = _flat(batch)[:4]
            if not len(row):
                continue
            left = _kept(row, n, key, at, min_votes)
            left = left[np.lexsort((key[left], row[left]))]
            row, key, n = row[left], key[left], n[left]
            new = np.concatenate(([True], (row[1:] != row[:-1]) | (key[1:] != key[:-1])))[: len(row)]
            row, key, n = row[new], key[new], n[new]
            yield pa.RecordBatch.from_arrays([pa.array(key), batch.column("node").take(pa.array(row)), pa.array(n)], ["key", "node", "n"])

    return run


def _pivots(min_votes: int):
    """Of images with their keys (n, key, at, pivot: the key's least node) the pivot that each shares most keys with, if these
    are of enough corners."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            node = batch.column("node").to_numpy()
            row, _, _, at, pivot = _flat(batch)
            other = pivot != node[row]
            order = np.flatnonzero(other)[np.lexsort((pivot[other], row[other]))]
            row, at, pivot = row[order], at[order], pivot[order]
            first = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (pivot[1:] != pivot[:-1])))[: len(row)])
            n = np.diff(np.append(first, len(row)))
            enough = np.bincount(np.unique(np.repeat(np.arange(len(first)), n) << 32 | at) >> 32, minlength=len(first)) >= min_votes
            first, n = first[enough], n[enough]
            first = first[np.lexsort((pivot[first], -n, row[first]))]
            _, best = np.unique(row[first], return_index=True)
            row, pivot = row[first[best]], pivot[first[best]]
            yield pa.RecordBatch.from_arrays([pa.array(pivot), pa.array(node[row])], ["a", "b"])

    return run


#: A corner in its image's row of a cell: its place, turn and scale, and how many keys it has.
_PLACE = np.dtype([("y", "<i4"), ("x", "<i4"), ("turn", "u1"), ("level", "i1"), ("keys", "u1")])


def _cell_rows(min_votes: int):
    """A row for each key that is left of an image and each corner that has it, with the image's corners and all of their
    keys (16 bits of each, in order of corners); ``own`` is the number of the row's corner among them."""

    def run(batches):
        import pyarrow as pa

        def packed(values, size):
            ends = np.concatenate(([0], np.cumsum(size))) * values.dtype.itemsize
            return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])

        for batch in batches:
            row, n, key, at = _flat(batch)[:4]
            if not len(row):
                continue
            places, begin = _fields(batch.column("places")), batch.column("places").offsets.to_numpy()
            order = np.lexsort((at, row))
            row, n, key, at = row[order], n[order], key[order], at[order]
            new = np.concatenate(([True], (row[1:] != row[:-1]) | (at[1:] != at[:-1])))
            corner, of = np.flatnonzero(new), np.cumsum(new) - 1
            level, y, x, turn = places[begin[row[corner]] - begin[0] + at[corner]].T
            place = np.zeros(len(corner), _PLACE)
            place["level"], place["y"], place["x"], place["turn"], place["keys"] = level, y, x, turn, np.bincount(of)
            left = _kept(row, n, key, at, min_votes)
            own = of - np.searchsorted(row[corner], row)
            corners, keys = (np.bincount(rows, minlength=batch.num_rows) for rows in (row[corner], row))
            of_row = {"node": batch.column("node"), "component": batch.column("component"), "places": packed(place, corners), "codes": packed(key.astype(np.uint16), keys)}
            size = np.cumsum((corners * _PLACE.itemsize + keys * 2)[row[left]])
            for part in np.split(left, np.searchsorted(size, np.arange(BATCH_BYTES, size[-1], BATCH_BYTES))) if len(left) else []:
                columns = {"key": pa.array(key[part]), "n": pa.array(n[part]), "own": pa.array(own[part].astype(np.int32))} | {c: values.take(pa.array(row[part])) for c, values in of_row.items()}
                yield pa.RecordBatch.from_pydict(columns)

    return run


def _known(corners: np.ndarray) -> bytes:
    """The keys of an image's corners, a 32-bit number for each: 26 bits of the key and the corner (none: it has more corners
    than these can number)."""
    if len(corners) > 64:
        return b""
    q = corners[:, 4:].astype(np.uint64)
    keys = [mix64(mix64(q[:, i] + np.uint64(10 * i + j)) + q[:, j]) for i in range(4) for j in range(i + 1, 4)]
    return np.concatenate([(k & np.uint64((1 << 26) - 1)) << np.uint64(6) | np.arange(len(q), dtype=np.uint64) for k in keys]).astype(np.uint32).tobytes()


def _rich(known: list[bytes], x: np.ndarray, y: np.ndarray, min_votes: int) -> np.ndarray:
    """Of pairs (x, y) of rows whether the keys that they share may stand for enough corners of both."""
    size = np.array([len(k) // 4 for k in known], np.int64)
    flat, start = np.frombuffer(b"".join(known), np.uint32).astype(np.int64), np.cumsum(size) - size
    sides = []
    for rows in (x, y):
        pair = np.repeat(np.arange(len(rows)), size[rows])
        own = flat[np.arange(len(pair)) + np.repeat(start[rows] - np.cumsum(size[rows]) + size[rows], size[rows])]
        sides.append((pair, own & 63, pair << 26 | own >> 6))
    good = np.ones(len(x), bool)
    for (pair, at, key), (_, _, other) in (sides, sides[::-1]):
        hit = np.isin(key, other)
        good &= np.bincount(np.unique(pair[hit] << 6 | at[hit]) >> 6, minlength=len(x)) >= min_votes
    return good | (size[x] == 0) | (size[y] == 0)


def _agreeing_rows(x: np.ndarray, y: np.ndarray, at_x: np.ndarray, at_y: np.ndarray, min_votes: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (x, y) that stand there with at least ``min_votes`` different corners of either side."""
    # most pairs have too few by any count
    pair = x << 32 | y
    slot = (pair.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(46)).astype(np.int64)
    some = (np.bincount(slot, minlength=1 << 18) >= min_votes)[slot]
    x, y, at_x, at_y = x[some], y[some], at_x[some], at_y[some]
    pair, of, n = np.unique(pair[some], return_inverse=True, return_counts=True)
    good = n >= min_votes
    for at in (at_x, at_y):
        held = good[of]
        if not held.any():
            return x[:0], y[:0]
        good = np.bincount(np.unique(of[held] * (at.max() + 1) + at[held]) // (at.max() + 1), minlength=len(pair)) >= min_votes
    return pair[good] >> 32, pair[good] & 0xFFFFFFFF


def _cell_pairs(min_votes: int, small: int, portion: int = 1 << 18):
    """Pairs of rows (key, i, j, side, node, component, own, places, codes) in order of cells that may be linked: by the turn,
    scale and shift that their own two corners imply, enough corners of both stand where a corner with the same key stands in
    the other. Of a cell that has more of them than twice its rows, and than ``small`` rows can have, only its rows: nodes a with the key."""

    def of(rows):
        import pyarrow as pa

        key, i, j, side, node, component = (rows.column(c).to_numpy() for c in ("key", "i", "j", "side", "node", "component"))
        own = rows.column("own").to_numpy().astype(np.int64)
        group = np.concatenate(([0], np.cumsum((key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]))))
        size = np.bincount(group)
        most = np.maximum(2 * size, np.minimum(size, small) ** 2)
        place, ends = string_buffer(rows.column("places").combine_chunks())
        place, ends = place.view(_PLACE), ends // _PLACE.itemsize
        codes = string_buffer(rows.column("codes").combine_chunks())[0].view(np.uint16)
        row = np.repeat(np.arange(len(key)), np.diff(ends))
        mine = (ends[:-1] + own)[row]
        turn, level = place["turn"].astype(np.int64), place["level"].astype(np.int64)
        own_turn, own_level = turn[mine], level[mine]
        dy, dx = (place[c].astype(np.float64) - place[c][mine] for c in "yx")
        # corners that agree with the own ones have one code: of the group, the key, and turn and scale in relation to the own corner's
        kind = mix64((group[row] << 16 | (turn - own_turn) % TURNS << 8 | level - own_level + 128).astype(np.uint64))
        corner = np.repeat(np.arange(len(place)), place["keys"])
        code = (np.repeat(kind, place["keys"]) ^ codes) * np.uint64(0x9E3779B97F4A7C15)
        # most stand alone
        bits = max(8, int(len(code)).bit_length() + 1)
        slot = (code >> np.uint64(64 - bits)).astype(np.int64)
        shared = np.flatnonzero((np.bincount(slot, minlength=1 << bits) > 1)[slot])
        code, corner = code[shared], corner[shared]
        order = np.argsort(code, kind="stable")
        code, corner = code[order], corner[order]
        begin = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1]))) if len(code) else np.zeros(0, np.int64)
        behind = np.repeat(np.append(begin, len(code))[1:], np.diff(np.append(begin, len(code)))) - np.arange(len(code)) - 1
        at, angle = row[corner], np.radians(np.arange(TURNS) * (360 / TURNS))
        cos, sin = np.cos(angle), np.sin(angle)
        # strips of rows that are the first of about ``portion`` pairs of corners
        strip = (np.cumsum(np.bincount(at, behind, minlength=len(key))) / portion).astype(np.int64)
        count, kept = np.zeros(len(size), np.int64), [(np.zeros(0, np.int64),) * 2]
        for k in np.unique(strip[at[behind > 0]]):
            p = np.flatnonzero((strip[at] == k) & (count <= most)[group[at]] & (behind > 0))
            a = np.repeat(p, behind[p])
            b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(behind[p]) - behind[p], behind[p])
            x, y = at[a], at[b]
            open_ = (component[x] != component[y]) & ((i[x] == j[x]) | (side[x] != side[y]))
            a, b, x, y = corner[a[open_]], corner[b[open_]], x[open_], y[open_]
            swap = node[x] > node[y]
            a, b, x, y = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, y, x), np.where(swap, x, y)
            spin, zoom = (own_turn[b] - own_turn[a]) % TURNS, 2.0 ** (own_level[b] - own_level[a])
            c, s = zoom * cos[spin], zoom * sin[spin]
            near = (np.abs(dy[b] - c * dy[a] - s * dx[a]) < CELL + 1e-6) & (np.abs(dx[b] - c * dx[a] + s * dy[a]) < CELL + 1e-6)
            x, y = _agreeing_rows(x[near], y[near], a[near], b[near], min_votes)
            kept.append((x, y))
            count += np.bincount(group[x], minlength=len(count))
        x, y = (np.concatenate(part) for part in zip(*kept))
        done = (count <= most)[group[x]]
        a, b = node[x[done]], node[y[done]]
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        new = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))[: len(a)]
        yield pa.RecordBatch.from_arrays([pa.array(a[new]), pa.array(b[new]), pa.nulls(int(new.sum()), pa.int64())], ["a", "b", "key"])
        held = (count > most)[group]
        yield pa.RecordBatch.from_arrays([pa.array(node[held]), pa.nulls(int(held.sum()), pa.int64()), pa.array(key[held])], ["a", "b", "key"])

    return _whole_cells(of)


def _cells(members: DataFrame, key: str, block: int) -> DataFrame:
    """``members`` once for each other block of their key: a cell (key, i, j) for each two blocks."""
    sizes = members.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / block).cast("long").alias("blocks"))
    return _dealt(members.join(sizes, key))


def _dealt(members: DataFrame) -> DataFrame:
    """``members`` once for each other of the ``blocks`` of their key."""
    dealt = members.withColumn("block", F.pmod(F.xxhash64("node", F.lit(7)), F.col("blocks")))
    cells = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return cells.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other"), "side": (F.col("block") > F.col("other")).cast("int")}).drop("block", "other", "blocks")


def links_of(described: DataFrame, max_bits: int = MAX_BITS, min_votes: int = MIN_VOTES, small: int = SMALL, block: int = BLOCK) -> DataFrame:
    """(image_id, component, n_links) of all images that have enough corners to be linked, from a row for each corner."""
    corner = F.struct("level", "y", "x", "turn", "q0", "q1", "q2", "q3")
    return _links(described.groupBy("image_id").agg(F.sort_array(F.collect_list(corner)).alias("corners")), max_bits, min_votes, small, block)


def _links(lists: DataFrame, max_bits: int = MAX_BITS, min_votes: int = MIN_VOTES, small: int = SMALL, block: int = BLOCK) -> DataFrame:
    """``links_of`` from a row for each image (image_id, corners: a sorted list)."""
    drawn = lists.where(F.size("corners") >= min_votes)
    drawn = materialize(drawn.select("image_id", F.xxhash64("corners").alias("h1"), F.xxhash64(F.lit(7), "corners").alias("h2"), "corners"), "drawn")
    # images with the same corners are one node
    nodes = materialize(drawn.groupBy("h1", "h2").agg(F.min("image_id").alias("node"), F.count(F.lit(1)).alias("images"), F.first("corners").alias("corners")), "nodes")
    tables = F.array(*(F.xxhash64(F.lit(10 * i + j), F.col("c")[f"q{i}"], F.col("c")[f"q{j}"]) for i in range(4) for j in range(i + 1, 4)))
    keyed = nodes.select("node", F.posexplode("corners").alias("at", "c")).select("node", "at", F.explode(tables).alias("key"))
    of_key = Window.partitionBy("key")
    met = keyed.withColumns({"n": F.count(F.lit(1)).over(of_key), "pivot": F.min("node").over(of_key), "last": F.max("node").over(of_key)}).where("pivot < last")
    met = met.groupBy("node").agg(F.collect_list(F.struct("n", "key", "at", "pivot")).alias("keys"))
    places = nodes.select("node", F.transform("corners", lambda c: F.struct(c["level"], c["y"], c["x"], c["turn"])).alias("places"))
    met = materialize(met.join(places, "node"), "buckets")

    def tested(pairs: DataFrame) -> DataFrame:
        sides = [nodes.select(F.col("node").alias(x), F.col("corners").alias(f"corners_{x}")) for x in "ab"]
        return pairs.join(sides[0], "a").join(sides[1], "b").mapInArrow(_test_pairs(max_bits, min_votes), "a long, b long")

    # each with the least member of a bucket that it shares most buckets with
    links = materialize(tested(met.select("node", "keys").mapInArrow(_pivots(min_votes), "a long, b long")), "links")
    labels = materialize(connected_components(links).withColumnRenamed("node", "of"), "labels")
    named = lambda rows: rows.join(labels, F.col("node") == F.col("of"), "left").withColumn("component", F.coalesce("component", "node")).drop("of")
    # what is left of a bucket is a cell, or several if it is large and stands in two components
    rare = met.select("node", "keys").mapInArrow(_rare_keys(min_votes), "key long, node long, n long")
    wide = 8 * block
    full = named(rare.where(F.col("n") > wide)).groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.min("component").alias("lo"), F.max("component").alias("hi"))
    full = materialize(full.where(f"lo = hi or rows > {wide}").select("key", F.when(F.col("lo") < F.col("hi"), F.ceil(F.col("rows") / wide)).otherwise(0).cast("long").alias("blocks")), "full")
    members = named(met).mapInArrow(_cell_rows(min_votes), "key long, n long, own int, node long, component long, places binary, codes binary")
    members = members.join(full, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).where("blocks > 0")
    cells = _dealt(members).select("key", "i", "j", "side", "node", "component", "own", "places", "codes")
    cells = cells.repartition(partitions(nodes.sparkSession), "key", "i", "j").sortWithinPartitions("key", "i", "j")
    found = materialize(cells.mapInArrow(_cell_pairs(min_votes, small), "a long, b long, key long"), "pairs")
    links = materialize(links.union(tested(found.where("key is null").select("a", "b").distinct())), "links")
    labels = materialize(connected_components(links).withColumnRenamed("node", "of"), "labels")
    left = found.where("key is not null").select("key", F.col("a").alias("node")).distinct()
    if not left.isEmpty():
        cells = _cells(materialize(named(left), "left"), "key", block).join(nodes, "node")
        joined = cells.groupBy("key", "i", "j").applyInArrow(_join_cell(max_bits, min_votes), "a long, b long")
        links = materialize(links.union(joined), "links")
        labels = materialize(connected_components(links).withColumnRenamed("node", "of"), "labels")
    # links lie within classes, so that each class counts its own
    linked = nodes.join(labels, F.col("node") == F.col("of")).drop("of")
    counted = _cells(linked, "component", block).groupBy("component", "i", "j").applyInArrow(_count_links(max_bits, min_votes), "node long, n long")
    counted = counted.groupBy("node").agg(F.sum("n").alias("n"))
    # a node links its own images if their corners stand on enough places
    places = F.size(F.array_distinct(F.transform("corners", lambda c: F.struct(c["level"], c["y"], c["x"]))))
    facts = named(nodes.select("node", "images", (places >= min_votes).alias("whole"))).join(counted, "node", "left")
    of_node = facts.select("node", "whole", "component", (F.coalesce("n", F.lit(0)) + F.when(F.col("whole"), F.col("images") - 1).otherwise(0)).alias("n_links"))
    out = drawn.select("image_id", "h1", "h2").join(nodes.select("h1", "h2", "node"), ["h1", "h2"]).join(of_node, "node")
    return out.select("image_id", F.when(F.col("whole"), F.col("component")).otherwise(F.col("image_id")).alias("component"), "n_links")


def copies(images: DataFrame, image_id: str = "image_id", image: str = "image", **options) -> DataFrame:
    """image_id, class_id (the least id of its class), copy_of (the least id of equal bytes), n_links
    (different images that its pixels are linked to), one row per row of ``images``."""
    rows = images.select(F.col(image_id).cast("long").alias("image_id"), F.col(image).cast("binary").alias("image"))
    named = F.coalesce(F.sha2("image", 256), F.concat(F.lit("none:"), F.coalesce(F.col("image_id").cast("string"), F.lit(""))))
    rows = materialize(rows.select("*", named.alias("h"), F.monotonically_increasing_id().alias("row")), "images")
    known = rows.where("image_id is not null")
    firsts = known.groupBy("h").agg(F.min(F.struct("image_id", "row")).alias("first")).select("h", F.col("first.image_id").alias("copy_of"), F.col("first.row").alias("lone"))
    # pixels are not shuffled unless there are many copies
    again = materialize(known.select("h", "row").join(firsts, "h").where("row <> lone").select("row"), "again")
    described = _corner_lists(known.join(again, "row", "left_anti"))
    if not firsts.groupBy("copy_of").count().where("count > 1").isEmpty():
        described = described.groupBy("image_id").agg(F.sort_array(F.flatten(F.collect_list("corners"))).alias("corners"))
    links = materialize(_links(described, **options), "classes").withColumnRenamed("image_id", "node")
    named = firsts.join(links, F.col("copy_of") == F.col("node"), "left").select("h", "copy_of", F.coalesce("component", "copy_of").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    out = rows.select("image_id", "h").join(named, "h", "left")
    known = F.col("image_id").isNotNull()
    return out.select("image_id", F.when(known, F.col("class_id")).alias("class_id"), F.when(known, F.col("copy_of")).alias("copy_of"), F.when(known, F.col("n_links")).otherwise(F.lit(0)).cast("long").alias("n_links"))


#: Edits of the pictures of vectors whose id is divisible by 100: variant number to what is done.
VARIANTS = ("as it is", "cropped", "brighter, with less contrast", "turned by 90 degrees")


def _draw(batches):
    import pyarrow as pa

    for batch in batches:
        ids, data = [], []
        for vec_id, vector in zip(batch.column("vec_id").to_pylist(), batch.column("embedding").to_pylist()):
            pixels = picture(vector)
            shown = [pixels]
            if vec_id is not None and vec_id % 100 == 0:
                cut = vec_id // 100 % 12
                shown += [pixels[cut : cut + 50, 12 - cut : 62 - cut], (pixels.astype(np.uint16) * 3 // 4 + 50).astype(np.uint8), np.rot90(pixels)]
            ids += [None if vec_id is None else 4 * vec_id + v for v in range(len(shown))]
            data += [encode(p) for p in shown]
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(data, pa.binary())], ["image_id", "image"])


def pictures(vectors: DataFrame) -> DataFrame:
    """image_id = 4 * vec_id + variant, image: a picture of each vector, and three edits of every 100th."""
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(_draw, "image_id long, image binary")
