import collections
import math
import re
import zlib

from pyspark.sql import functions as F

from colloquy.llm import lm_score
from colloquy.llm.queries import op5_lm_score

from .conftest import make, prose


def smoothing(contexts, once):
    """K with which the sum of c K / (c + K) over contexts, c being the mean of their power of two, is once."""
    groups = collections.defaultdict(list)
    for c in contexts.values():
        groups[c.bit_length()].append(c)
    low, high = 1e-3, 1e6
    for _ in range(200):
        k = math.sqrt(low * high)
        share = sum(sum(g) * k / (sum(g) / len(g) + k) for g in groups.values())
        low, high = (k, high) if share < once else (low, k)
    return k


def brute(texts, held):
    low = {c: c + 32 for c in range(65, 91)}
    words = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low)) + ["\0end"] for t in texts]
    one, two, three = collections.Counter(), collections.Counter(), collections.Counter()
    for w, h in zip(words, held):
        if not h:
            s = ["\0start"] + w
            one.update(w)
            two.update(zip(s, w))
            three.update(zip(s, w, w[1:]))
    n, v = sum(one.values()), len(one)
    singles = lambda c: sum(x == 1 for x in c.values())
    s1, s2 = singles(one), sum(x == 2 for x in one.values())
    d = s1 / (s1 + 2 * s2) if s1 and s2 else 0.5
    k2, k3 = smoothing(one, singles(two)), smoothing(two, singles(three))
    times = lambda h: one["\0end"] if h == "\0start" else one[h]

    def p(w, *h):
        if len(h) == 2:
            return (three[(*h, w)] + k3 * p(w, h[1])) / (two[h] + k3)
        if len(h) == 1:
            return (two[(*h, w)] + k2 * p(w)) / (times(h[0]) + k2)
        return ((one[w] - d) / n if one[w] else d * v / n) if n else 1.0

    out = []
    for w in words:
        s = ["\0start"] + w
        score = sum(math.log10(p(x, *s[max(0, i - 1) : i + 1])) for i, x in enumerate(w))
        base = sum(math.log10((one[x] + 1) / (n + v + 1)) for x in w)
        out.append((len(w), sum(one[x] > 0 for x in w), n, base, score))
    return out, (one, two, p)


def same(got, want):
    assert got[:3] == want[:3]
    assert all(math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9) for a, b in zip(got[3:], want[3:]))


def test_equals_brute_force_in_small_blocks(spark):
    texts = [prose(s % 7, 30 + s * 3, 60) for s in range(60)] + [prose(99, 1500, 80), prose(98, 511, 20), prose(97, 512, 20)] + ["Upper lower UPPER", None, ""]
    got = {r.doc_id: r for r in lm_score.score(make(spark, texts).repartition(4), block_bytes=2000).collect()}
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(texts))]
    want, _ = brute(texts, held)
    for i, w in enumerate(want):
        r = got[i]
        assert r.held_out == held[i]
        same((r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score), w)


def test_the_model_is_a_distribution():
    texts = [prose(s, 200, 30) for s in range(6)]
    _, (one, two, p) = brute(texts, [False] * 6)
    for h in [(), *((w,) for w in list(one)[:10]), *list(two)[:10]]:
        if "\0end" not in h:
            assert math.isclose(sum(p(w, *h) for w in one) + p("\0unknown", *h), 1)


def test_long_words_that_differ_are_told_apart(spark):
    """Words of a and b, 1,024 letters long, equal under every polynomial hash modulo 2^64."""
    bits = [bin(i).count("1") % 2 for i in range(1024)]
    one, other = ("".join("ab"[b ^ flip] for b in bits) for flip in (0, 1))
    got = {r.doc_id: r for r in lm_score.score(make(spark, [one, one, other]), held=F.col("doc_id") == 2).collect()}
    assert (got[0].n_known, got[2].n_known) == (2, 1)


def test_texts_seen_twice_score_apart(spark):
    texts = [prose(s, 150, 400) for s in range(40)]
    got = {r.doc_id: r.score / r.n_tokens for r in lm_score.score(make(spark, texts + texts[:8]), held=F.lit(False)).collect()}
    assert min(got[i] for i in range(8)) > max(got[i] for i in range(8, 40))


def test_held_out_texts_beat_the_base(spark, small):
    got = lm_score.score(spark.read.parquet(f"{small}/documents.parquet"), stable=True).where("held_out").collect()
    assert sum(r.score for r in got) > sum(r.base_score for r in got)


def test_odd_rows(spark, odd, none):
    got = sorted(((r.doc_id, r.n_tokens) for r in lm_score.score(odd).collect()), key=repr)
    assert [x for x in got if x[0] in (0, 1, 2, 3)] == [(0, 1), (1, 1), (2, 1), (3, 2)] and len(got) == odd.count()
    assert lm_score.score(none).count() == 0


def test_nothing_to_learn_from(spark):
    got = lm_score.score(make(spark, ["a b", "c"]), held=F.lit(True)).collect()
    assert [(r.n_known, r.train_tokens, r.score) for r in got] == [(0, 0, 0.0)] * 2


def test_the_query_equals_brute_force(spark, small):
    docs = sorted(spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect())
    got = {r.doc_id: r for r in op5_lm_score(spark, small).collect()}
    want, _ = brute([r.text for r in docs], [zlib.crc32(str(r.doc_id).encode()) % 7 == 2 for r in docs])
    for r, w in zip(docs, want):
        g = got[r.doc_id]
        same((g.n_tokens, g.n_known, g.train_tokens, g.base_score, g.score), w)
