import numpy as np

from colloquy.llm import image_copies as m
from colloquy.llm.queries import op6_image_copies


def test_edits_are_found_and_others_left_alone(spark, small):
    found = op6_image_copies(spark, small).collect()
    own = {r.vec_id: r.class_id for r in found if r.variant == 0}
    edits = [r for r in found if r.variant]
    assert sum(r.class_id == own[r.vec_id] for r in edits) >= 0.9 * len(edits)
    assert all(r.n_links == 0 for r in found if r.variant == 0 and r.vec_id % 100)


def test_odd_images(spark):
    draw = np.random.default_rng(2)
    flat, tiny = np.full((40, 40), 9, np.uint8), draw.integers(0, 255, (5, 5)).astype(np.uint8)
    shown = m.picture([1.0, 2.0], 96)
    color = b"P6 96 96 255\n" + np.repeat(shown[..., None], 3, 2).tobytes()
    rows = [(1, None), (2, b""), (3, b"no image"), (4, m.encode(flat)), (5, m.encode(flat)), (6, m.encode(tiny)), (7, m.encode(shown)), (8, color), (9, m.encode(shown[10:90, 5:85])), (7, m.encode(shown)), (None, m.encode(shown)), (10, None)]
    got = sorted(((r.image_id, r.class_id, r.copy_of) for r in m.copies(spark.createDataFrame(rows, "image_id long, image binary")).collect()), key=repr)
    want = [(1, 1, 1), (2, 2, 2), (3, 3, 3), (4, 4, 4), (5, 4, 4), (6, 6, 6), (7, 7, 7), (7, 7, 7), (8, 7, 8), (9, 7, 9), (10, 10, 10), (None, None, None)]
    assert got == sorted(want, key=repr)


def test_empty_table(spark):
    assert m.copies(spark.createDataFrame([], "image_id long, image binary")).count() == 0


def test_decode():
    assert m.decode(m.encode(np.arange(6, dtype=np.uint8).reshape(2, 3))).tolist() == [[0, 1, 2], [3, 4, 5]]
    assert m.decode(b"P5 9 9 255\nxx") is None


def test_all_links_of_large_buckets_are_found(spark):
    """All images have the same eight corners, and only two and two have them in the same places: 16, 3 or 20 pairs of
    blocks, and one class whose images have their corners in the same place."""
    draw = np.random.default_rng(4)
    quarters = draw.integers(-(2**62), 2**62, (8, 4)).tolist()
    rows = []
    for pair in range(40):
        places = draw.integers(0, 4000, (8, 2)).tolist()
        rows += [(2 * pair + k, 0, y + 3 * k, x, 0, *q) for k in range(2) for (y, x), q in zip(places, quarters)]
    rows += [(image, 0, 50 * t, 70 * t * t, 0, *q) for image in range(80, 85) for t, q in enumerate(quarters)]
    described = spark.createDataFrame(rows, "image_id long, level int, y long, x long, turn long, q0 long, q1 long, q2 long, q3 long")
    want = {i: (i - i % 2, 1) for i in range(80)} | {i: (80, 4) for i in range(80, 85)}
    for block in (256, 16):
        assert {r.image_id: (r.component, r.n_links) for r in m.links_of(described, block=block).collect()} == want
    # buckets that give their pairs find the same
    assert {r.image_id: (r.component, r.n_links) for r in m.links_of(described, small=100).collect()} == want


def test_images_leave_their_fullest_buckets_but_meet_in_the_rarest_shared_one():
    import pyarrow as pa

    # eight corners, of which the first five have the fullest keys; key 3 is in the sixth corner's
    keys = [{"n": 100 - at, "key": at, "at": at} for at in range(5)] + [{"n": 9, "key": 10 + at, "at": at} for at in range(5, 8)] + [{"n": 2, "key": 30, "at": 0}]
    kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("n", "key", "at")]))
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([keys, keys[:5]], kind)], ["node", "keys"])
    (found,) = m._rare_keys(6)(iter([batch]))
    # the sixth corner's fullest key is the first to stay; an image with five corners that meet any is left out
    assert found.to_pydict()["key"] == [15, 16, 17, 30] and set(found.to_pydict()["node"]) == {1}


def test_pairs_need_enough_corners_on_both_sides():
    known = lambda pairs: b"".join(np.uint32(key << 6 | at).tobytes() for key, at in pairs)
    rows = [known((k, k) for k in range(6)), known((k, 9 + k) for k in range(8)), known((k, 0) for k in range(6)), known((k, k) for k in range(1, 6)), b""]
    x, y = np.array([0, 0, 0, 3]), np.array([1, 2, 3, 4])
    assert m._rich(rows, x, y, 6).tolist() == [True, False, False, True]


def _drawn_again(draw, corners, spin, zoom, shift):
    """``corners`` turned by ``spin`` steps, scaled and shifted, each off by a pixel or two, with some bits of two quarters changed."""
    angle, out = np.radians(10 * spin), []
    for level, y, x, turn, *q in corners:
        q = list(q)
        for k in draw.choice(4, 2, replace=False):
            for bit in draw.integers(0, 62, draw.integers(0, 9)):
                q[k] ^= 1 << int(bit)
        to = 2.0**zoom * np.array([np.cos(angle) * y + np.sin(angle) * x, np.cos(angle) * x - np.sin(angle) * y]) + shift + draw.integers(-2, 3, 2)
        out.append((level + zoom, int(to[0]), int(to[1]), (turn + spin) % m.TURNS, *q))
    return out


def test_links_equal_those_of_all_pairs(spark):
    """Images of few kinds of corners, among them turned, scaled and shifted ones and crowds of equal corners, by all pairs."""
    draw = np.random.default_rng(11)
    pool = [[int(v) for v in draw.integers(-(2**62), 2**62, 4)] for _ in range(24)]
    images: list[list] = []
    for _ in range(70):
        kinds = draw.choice(24, draw.integers(6, 13))
        images.append([(int(draw.integers(0, 2)), int(draw.integers(0, 60)), int(draw.integers(0, 60)), int(draw.integers(0, 4)), *pool[k]) for k in kinds])
    for i in range(40):
        images.append(_drawn_again(draw, images[i % 25], int(draw.integers(0, 36)), int(draw.integers(0, 2)), draw.integers(-40, 40, 2)))
    for _ in range(12):  # equal corners next to each other
        at = draw.integers(0, 20, 2)
        images.append([(0, int(at[0] + draw.integers(0, 6)), int(at[1] + draw.integers(0, 6)), 3, *pool[draw.integers(0, 2)]) for _ in range(9)])
    lists = [np.array(sorted(set(c)), np.int64) for c in images]
    a, b = np.triu_indices(len(lists), 1)
    good = m._agreeing([lists[i] for i in a], [lists[i] for i in b], m.MAX_BITS, m.MIN_VOTES)
    assert 60 < good.sum() < len(a) // 4
    component, links = list(range(len(lists))), [0] * len(lists)
    for i, j in zip(a[good].tolist(), b[good].tolist()):
        links[i], links[j] = links[i] + 1, links[j] + 1
        component = [min(component[i], component[j]) if c in (component[i], component[j]) else c for c in component]
    places = [len({tuple(c) for c in rows[:, :3].tolist()}) for rows in lists]
    want = {i: (component[i] if n >= m.MIN_VOTES else i, links[i]) for i, n in enumerate(places) if len(lists[i]) >= m.MIN_VOTES}
    rows = [(i, *c) for i, found in enumerate(lists) for c in found.tolist()]
    described = spark.createDataFrame(rows, "image_id long, level int, y long, x long, turn long, q0 long, q1 long, q2 long, q3 long")
    for options in ({}, {"small": 0, "block": 2}):
        assert {r.image_id: (r.component, r.n_links) for r in m.links_of(described, **options).collect()} == want


def test_only_pairs_whose_corners_stand_alike_are_tested():
    """Forty images have the same eight corners, two and two in the same places: 20 of 780 pairs."""
    import pyarrow as pa

    draw = np.random.default_rng(5)
    keys = [{"n": 40, "key": 100 + at, "at": at} for at in range(8)]
    places = []
    for _ in range(20):
        own = [{"level": 0, "y": int(y), "x": int(x), "turn": int(t)} for y, x, t in draw.integers(0, 36, (8, 3)) * (9, 9, 1)]
        places += [own, [c | {"y": c["y"] + 5} for c in own]]
    kind, of = (pa.list_(pa.struct([(c, pa.int64()) for c in names])) for names in (("level", "y", "x", "turn"), ("n", "key", "at")))
    batch = pa.RecordBatch.from_arrays([pa.array(range(40)), pa.array(range(40)), pa.array([keys] * 40, of), pa.array(places, kind)], ["node", "component", "keys", "places"])
    rows = pa.Table.from_batches(m._cell_rows(6)(iter([batch]))).sort_by("key")
    # three of eight keys are left: the fullest five are not
    assert len(rows) == 120
    for name in ("i", "j", "side"):
        rows = rows.append_column(name, pa.array(np.zeros(len(rows), np.int64)))
    found = pa.Table.from_batches(m._cell_pairs(6, 32)(iter(rows.combine_chunks().to_batches()))).to_pydict()
    assert {*zip(found["a"], found["b"], found["key"])} == {(2 * k, 2 * k + 1, None) for k in range(20)}
    # a cell with more pairs than twice its rows gives its rows
    alike = batch.set_column(3, "places", pa.array([places[0]] * 40, kind))
    rows = pa.Table.from_batches(m._cell_rows(6)(iter([alike]))).sort_by("key")
    for name in ("i", "j", "side"):
        rows = rows.append_column(name, pa.array(np.zeros(len(rows), np.int64)))
    found = pa.Table.from_batches(m._cell_pairs(6, 4)(iter(rows.combine_chunks().to_batches()))).to_pydict()
    assert sorted(zip(found["key"], found["a"], found["b"])) == [(k, a, None) for k in (100, 101, 102) for a in range(40)]
