import random
from collections import Counter

import numpy as np
import pytest

from colloquy.llm import order_minhash as m
from colloquy.llm.components import connected_components

from .conftest import make, prose


def distance(a, b):
    before = list(range(len(b) + 1))
    for i, x in enumerate(a):
        now = [i + 1]
        for j, y in enumerate(b):
            now.append(min(before[j + 1] + 1, now[j] + 1, before[j] + (x != y)))
        before = now
    return before[-1]


def plain_distance(a, b):
    """The same, a row at a time."""
    steps = np.arange(len(b) + 1)
    row = steps.copy()
    for i, x in enumerate(a):
        best = np.minimum(row[1:] + 1, row[:-1] + (b != x))
        row = np.minimum.accumulate(np.concatenate(([i + 1], best)) - steps) + steps
    return int(row[-1])


def test_alignment_equals_brute_force():
    draw = random.Random(3)
    for _ in range(800):
        a = [draw.randrange(draw.choice([2, 40])) for _ in range(draw.randrange(25))]
        b = list(a)
        for _ in range(draw.randrange(7)):
            at = draw.randrange(len(b) + 1)
            b[at : at + draw.randrange(3)] = [draw.randrange(9) for _ in range(draw.randrange(3))]
        most = draw.randrange(10)
        assert m.within(np.array(a, np.uint32), np.array(b, np.uint32), most) == min(distance(a, b), most + 1)


def edited(text, every, seed):
    words = text.split(" ")
    for i in range(seed % every, len(words), every):
        words[i] = f"new{seed}n{i}"
    return " ".join(words)


def test_classes_of_planted_copies(spark):
    base = [prose(s, 120) for s in range(12)]
    texts = base + [edited(base[0], 30, s) for s in range(40)] + [base[1]] * 5 + [edited(base[2], 40, 1), base[3].upper(), base[4].replace(" ", ", ")]
    texts.append(base[5][: len(base[5]) // 2] + prose(99, 60))
    got = {r.doc_id: r for r in m.near_duplicates(make(spark, texts)).collect()}
    want = {i: i for i in range(12)} | {12 + i: 0 for i in range(40)} | {52 + i: 1 for i in range(5)} | {57: 2, 58: 3, 59: 4, 60: 60}
    assert {i: r.class_id for i, r in got.items()} == want
    assert all(got[52 + i].copy_of == 1 for i in range(5))


def test_brute_force_on_the_small_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = {r.doc_id: r.class_id for r in m.near_duplicates(docs).collect()}
    words = {r.doc_id: [w.strip(m.PUNCTUATION) or w for w in r.text.lower().split()] for r in docs.collect()}
    number = {w: i for i, w in enumerate({w for ws in words.values() for w in ws})}
    coded = {i: np.array([number[w] for w in ws], np.uint32) for i, ws in words.items()}
    parent = {i: i for i in coded}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(coded)
    near = []
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            longer = max(len(coded[a]), len(coded[b]))
            if (Counter(words[a]) & Counter(words[b])).total() >= 0.8 * longer and plain_distance(coded[a], coded[b]) <= 0.2 * longer + 1e-9:
                near.append((a, b))
                parent[max(top(a), top(b))] = min(top(a), top(b))
    # of all pairs of 0.8 or more, by a distance of its own, all but one in fifty share a class, and no others do
    assert len(near) > 20 and sum(got[a] == got[b] for a, b in near) >= 0.98 * len(near)
    assert all(top(a) == top(got[a]) for a in ids)


def test_recall_of_scattered_edits_at_each_level(spark):
    draw = random.Random(11)
    texts = []
    for level in (0.95, 0.9, 0.85, 0.81):
        for _ in range(60):
            base = [f"w{draw.randrange(100000)}" for _ in range(200)]
            copy = list(base)
            for at in draw.sample(range(200), round(200 * (1 - level))):
                copy[at] = f"x{draw.randrange(100000)}"
            texts += [" ".join(base), " ".join(copy)]
    got = {r.doc_id: r.class_id for r in m.near_duplicates(make(spark, texts)).collect()}
    for level in range(4):
        pairs = range(120 * level, 120 * level + 120, 2)
        assert sum(got[i + 1] == i for i in pairs) >= 59


def test_odd_rows(spark, odd):
    got = sorted(((r.doc_id, r.class_id, r.copy_of) for r in m.near_duplicates(odd).collect()), key=repr)
    assert got == sorted([(0, 0, 0), (1, 0, 0), (2, 2, 2), (3, 3, 3), (4, 3, 3), (5, 5, 5), (5, 5, 5), (7, 7, 7), (8, 8, 8), (None, None, None)], key=repr)


def test_empty_table(spark, none):
    assert m.near_duplicates(none).count() == 0


def test_components(spark):
    draw = random.Random(5)
    pairs = [(draw.randrange(300), draw.randrange(300)) for _ in range(150)] + [(i, i + 1) for i in range(400, 430)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    parent = {x: x for p in pairs for x in p}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[max(top(a), top(b))] = min(top(a), top(b))
    assert got == {x: top(x) for p in pairs if p[0] != p[1] for x in p}


@pytest.mark.parametrize("block, wide", [(1024, 64), (32, 64), (32, 1)])
def test_pairs_that_share_a_hot_passage_are_all_linked(spark, block, wide):
    # the passage fills most of every text, so that all texts share buckets
    passage = [f"passage{j}" for j in range(70)]
    texts = []
    for i in range(100):
        own = [f"own{i}n{j}" for j in range(30)]
        # no run of five own words is left whole
        texts += [" ".join(passage + own), " ".join(passage + [f"new{i}n{j}" if j % 5 == 2 else w for j, w in enumerate(own)])]
    got = {r.doc_id: r.class_id for r in m.near_duplicates(make(spark, texts), block=block, wide=wide).collect()}
    assert got == {i: i - i % 2 for i in range(200)}


def test_signatures_never_differ_in_more_bits_than_words():
    draw = random.Random(8)
    for n in (3, 90, 130, 300, 700, 3000):
        a = [draw.randrange(5000) for _ in range(n)]
        b = a[draw.randrange(1 + n // 5) :] + [draw.randrange(5000) for _ in range(n // 9)]
        both = [m.signature(np.array(x, np.uint32)) for x in (a, b)]
        counts = [np.bincount(x, minlength=5000) for x in (a, b)]  # of words, as of labelled words
        assert m._differing(both, np.array([0]), np.array([1]))[0] <= np.abs(counts[0] - counts[1]).sum()


def test_pairs_at_the_threshold_are_linked_at_every_length(spark):
    texts = []
    for i in range(240):
        n, every = [(5, 5), (8, 8), (12, 12), (100, 5)][i % 4]
        words = [f"own{i}n{j}" for j in range(n)]
        texts += [" ".join(words), " ".join(f"new{w}" if j % every == every // 2 else w for j, w in enumerate(words))]
    got = {r.doc_id: r.class_id for r in m.near_duplicates(make(spark, texts)).collect()}
    missed = [i // 2 % 4 for i, c in got.items() if c != i - i % 2]
    # slots are drawn: of long pairs one in 1700 is missed, of short ones none
    assert len(got) == 480 and all(kind == 3 for kind in missed) and len(missed) <= 1


def test_a_pair_is_taken_up_once_among_larger_buckets():
    large = [frozenset({1, 5, 9}), frozenset({5, 9}), None, frozenset({9})]
    x, y = np.array([0, 0, 2, 1]), np.array([1, 3, 1, 3])
    assert m._met_before(np.array([9, 9, 9, 9]), large, x, y).tolist() == [True, False, False, False]
    assert m._met_before(np.array([5, 5, 5, 5]), large, x[:1], y[:1]).tolist() == [False]


def test_rows_of_a_group_that_its_first_round_misses_grow_with_its_size(spark, monkeypatch):
    """The first text shares most buckets with each of 120 near copies, but is none: each is alone after the first round."""
    draw = random.Random(6)
    base = [f"w{j}" for j in range(100)]
    texts = [" ".join(base[:75] + [f"decoy{j}" for j in range(25)])]
    for i in range(120):
        copy = list(base)
        for at in draw.sample(range(75, 100), 8):
            copy[at] = f"new{i}n{at}"
        texts.append(" ".join(copy))
    pairs = []

    def counted(df, label, put=m.materialize):
        out = put(df, label)
        if label == "pairs":
            pairs.append(out.count())
        return out

    monkeypatch.setattr(m, "materialize", counted)
    got = {r.doc_id: r.class_id for r in m.near_duplicates(make(spark, texts)).collect()}
    assert got == {0: 0} | {i: 1 for i in range(1, 121)}
    assert sum(pairs) < 20 * 120  # of 7140 pairs


def test_a_group_gives_links_and_not_pairs_once_its_cells_are_left_over(spark, monkeypatch):
    """As above, with outsiders that are within reach of all others by their words, but not by their order."""
    draw = random.Random(8)
    base = [f"w{j}" for j in range(100)]
    texts = [" ".join(base[:75] + [f"decoy{j}" for j in range(25)])]
    for i in range(120):
        copy = list(base)
        for at in draw.sample(range(75, 100), 8):
            copy[at] = f"new{i}n{at}"
        texts.append(" ".join(copy))
    texts += [" ".join(base[:60] + base[80:] + base[60:80][:: -1 if i % 2 else 1] + [f"last{i}"]) for i in range(20)]
    rows = []

    def counted(df, label, put=m.materialize):
        out = put(df, label)
        if label in ("cells", "pairs", "links"):
            rows.append(out.count())
        return out

    monkeypatch.setattr(m, "materialize", counted)
    got = {r.doc_id: r.class_id for r in m.near_duplicates(make(spark, texts)).collect()}
    words = [np.unique(" ".join(texts).split(), return_inverse=True)[1][sum(len(t.split()) for t in texts[:i]) :][: len(t.split())] for i, t in enumerate(texts)]
    parent = list(range(len(texts)))

    def top(x):
        return x if parent[x] == x else top(parent[x])

    for i, a in enumerate(words):
        for j in range(i):
            if plain_distance(a, words[j]) <= 0.2 * max(len(a), len(words[j])) + 1e-9 and top(i) != top(j):
                parent[max(top(i), top(j))] = min(top(i), top(j))
    assert got == {i: top(i) for i in range(len(texts))}
    assert sum(rows) < 10 * len(texts)


def test_a_pair_is_aligned_in_the_cell_of_its_least_shared_key():
    top = np.iinfo(np.int64).max
    keys = np.array([[5, 9, top], [5, 9, 3], [7, 9, 3], [5, 2, top]])
    x, y = np.array([0, 1, 0, 0]), np.array([1, 2, 2, 3])
    assert m._shared_before(np.array([9, 9, 9, 9]), keys, x, y).tolist() == [True, True, False, True]
    assert m._shared_before(np.array([5, 5, 5, 5]), keys, x, y).tolist() == [False, True, False, False]
