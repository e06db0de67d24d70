import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from colloquy.llm import packing as pk
from colloquy.llm.queries import TOKENIZERS, op13_packing

from .conftest import make, prose

PATH = f"{TOKENIZERS}/word_bpe_49k.json"


def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def ids_of(texts):
    encode = tokenizer().encode
    return [encode(t or "", add_special_tokens=False).ids + [1] for t in texts]


def sequences(rows, window):
    """Each sequence's pieces in order, after a check that they leave no gap and that no id is padding."""
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append(r)
    for own in by.values():
        own.sort(key=lambda r: r.offset)
        at = 0
        for r in own:
            assert r.offset == at and r.length > 0
            at += r.length
        assert at == window or at < window and at & (at - 1) == 0
    return by


def simulate(queues, quanta, packet, window):
    """Deficit round robin, step by step: (source, document, start, length) in the order of service."""
    waiting = {s: [(d, a, min(packet, n - a)) for d, n in q for a in range(0, n, packet)] for s, q in sorted(queues.items())}
    deficit, served = dict.fromkeys(waiting, 0.0), []
    while any(waiting.values()):
        for s, queue in waiting.items():
            deficit[s] += quanta[s]
            while queue and queue[0][2] <= deficit[s] + 1e-9:
                served.append((s, *queue.pop(0)))
                deficit[s] -= served[-1][3]
    return served


@pytest.mark.parametrize("weights", [None, {"a": 3.0, "b": 1.0, "c": 0.5}])
def test_equals_round_robin(spark, weights):
    docs = make(spark, [prose(i, 3 + i * 7 % 90) for i in range(90)], sources=("a", "b", "c"))
    given = weights and spark.createDataFrame(list(weights.items()), "source string, weight double")
    rows = pk.pack_documents(docs, PATH, weights=given, window=64, packet=8).collect()
    by = sequences(rows, 64)
    line = [(r.source, r.doc_id, r.start, r.length) for s in sorted(by) for r in by[s]]
    order = defaultdict(list)  # the queues, as they were served
    for s, d, _, _ in line:
        if d not in [x for x, _ in order[s]]:
            order[s].append((d, {r.doc_id: r.doc_tokens for r in rows}[d]))
    size = {s: sum(n for _, n in q) for s, q in order.items()}
    share = weights or size
    quanta = {s: 64 * share[s] / sum(share.values()) for s in size}
    split = lambda pieces: [(s, d, a + i) for s, d, a, n in pieces for i in range(n)]
    assert split(line) == split(simulate(order, quanta, 8, 64))


def test_windows_keep_proportions(spark):
    docs = make(spark, [prose(i, 40) for i in range(400)], sources=("a",) * 5 + ("b", "b", None))
    rows = pk.pack_documents(docs, PATH, window=512, packet=16).collect()
    total = Counter()
    for r in rows:
        total[r.source] += r.length
    for own in sequences(rows, 512).values():
        if sum(r.length for r in own) == 512:
            part = Counter()
            for r in own:
                part[r.source] += r.length
            assert all(abs(part[s] / 512 - n / sum(total.values())) <= 3 * 16 / 512 for s, n in total.items())


def check(rows, docs):
    docs = docs.collect()
    want = Counter((d.doc_id, tuple(i)) for d, i in zip(docs, ids_of(d.text for d in docs)))
    found = defaultdict(list)
    for r in rows:
        found[r.doc_id, r.doc_tokens].append(r)
    for (doc, n), copies in Counter((d, len(i)) for (d, i), k in want.items() for _ in range(k)).items():
        assert sum(r.length for r in found[doc, n]) == copies * n
    # pieces of one document, or of copies, put together again
    for (doc, ids), copies in want.items():
        whole = np.array(ids, "<u4")
        for r in found[doc, len(ids)]:
            assert r.start + r.length <= len(ids)
        at = Counter(i for r in found[doc, len(ids)] if zlib.crc32(whole[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for i in range(r.start, r.start + r.length))
        assert all(at[i] >= copies for i in range(len(ids)))


def test_every_id_once(spark, small):
    rows = op13_packing(spark, small).collect()
    sequences(rows, 2048)
    check(rows, spark.read.parquet(f"{small}/documents.parquet"))
    assert sum(r.length for r in op13_packing(spark, small).collect()) == sum(r.length for r in rows)


def test_odd_rows(spark, odd, none):
    rows = pk.digests(odd, PATH).collect()
    sequences(rows, 2048)
    check(rows, odd)
    assert pk.digests(none, PATH).count() == 0


def test_words_alone_give_the_same_ids(spark):
    texts = ["a\x0bb\x0c c\x1cd", "é ́x  y z", "İSTANBUL ΣΑΣ ΌΔΟΣ", "x<|endoftext|>y <|startoftext|> '", "don't 12³ ___ \U0001f600\U0001f600", "ab" * 3000 + " tail", "\r\n \t ", "\x00"]
    docs = make(spark, texts)
    want = dict(enumerate(ids_of(texts)))
    got = {r.doc_id: pk.unpack(r.ids).tolist() for r in pk.encode(docs, PATH).collect()}
    assert got == want


def test_missing_weight_is_an_error(spark):
    docs = make(spark, ["a b", "c d"], sources=("a", "b"))
    with pytest.raises(ValueError, match="'b'"):
        pk.pack_documents(docs, PATH, weights=spark.createDataFrame([("a", 1.0)], "source string, weight double"))


def test_tasks_of_a_worker_share_the_tokenizer_but_not_its_words():
    import pyarrow as pa

    first, second = (pk._Encoder(PATH, 1) for _ in range(2))
    assert first.whole is second.whole
    texts = pa.array(["Ab ab AB's x-y ÀÉ don't", None])
    assert [x.tolist() for x in first(texts)] == [x.tolist() for x in second(texts)]
    assert first.known and first.known is not second.known
    for text, ids in zip(texts.to_pylist(), first(texts)):
        assert ids.tolist() == [*first.whole.encode(text or "", add_special_tokens=False).ids, 1]
