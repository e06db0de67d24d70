import hashlib
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from colloquy.llm import merkle as mk
from colloquy.llm.queries import op11_merkle_manifest

from .conftest import make, prose

LOWER = {c: c + 32 for c in range(65, 91)}


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    fields = (row.doc_id, row.source, row.lang, row.n_chars, text)
    return sha(*("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))


def climb(nodes, proofs):
    """The top node; ``proofs`` gets (left, right) of each level for each first node's index."""
    owners = [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        up, own = [], []
        for i in range(0, len(nodes), 8):
            run = nodes[i : i + 8]
            for j in range(len(run)):
                for o in owners[i + j]:
                    proofs[o].append(("".join(run[:j]), "".join(run[j + 1 :])))
            up.append(sha(*run))
            own.append([o for j in range(len(run)) for o in owners[i + j]])
        nodes, owners = up, own
    return nodes[0]


def brute(rows):
    by_lang = {}
    for r in rows:
        by_lang.setdefault(r.lang, []).append((r.doc_id is not None, r.doc_id or 0, leaf(r, r.text), r))
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    subroots, low = [], []
    for lang in langs:
        own = sorted(by_lang[lang], key=lambda x: x[:3])
        proofs = [[] for _ in own]
        subroots.append(climb([x[2] for x in own], proofs))
        low.append((own, proofs))
    tops = [[] for _ in langs]
    root = climb(subroots, tops)
    for (own, proofs), subroot, top in zip(low, subroots, tops):
        for (_, _, node, r), proof in zip(own, proofs):
            now = node
            if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 0 and r.text is not None:
                now = leaf(r, r.text.translate(LOWER))
            for left, right in proof + top:
                now = sha(left, now, right)
            yield r.doc_id, node, subroot, root, sha(*(x for pair in proof + top for x in pair)), now, now == root


def check(docs):
    got = [tuple(r) for r in mk.audit(docs).collect()]
    assert sorted(got, key=repr) == sorted(brute(docs.collect()), key=repr)
    return got


def test_three_tiers_and_many_groups(spark):
    """Blocks of one level and of three; a group with a lone leaf, one of a whole block, 70 small ones."""
    texts = [f"Text {i} " + "Ab" * (i % 5) for i in range(1300)]
    langs = ["en"] * 8 + [f"x{i}" for i in range(70)] + [None]
    got = check(make(spark, texts, langs=langs).unionByName(make(spark, ["Only"], langs=["zz"])))
    assert 0 < sum(not g[-1] for g in got) < len(got)


def test_levels_a_block_change_nothing(spark):
    docs = make(spark, [prose(i, 5) for i in range(600)], langs=("en",) * 9 + ("de",))
    found = []
    for levels in (1, 2, 5):
        leaves = docs.select("doc_id", "lang", mk.leaf(*(F.col(c) for c in mk.FIELDS)).alias("leaf"))
        found.append(sorted((r.at, r.g, r.node, r.proof, tuple(r.path), r.root) for r in mk.manifest(leaves, levels=levels).collect()))
    assert found[0] == found[1] == found[2] and len(found[0]) == 600


def test_odd_rows(spark, odd, none):
    check(odd)
    assert mk.audit(none).count() == 0


@pytest.mark.parametrize("n", [1, 8, 9, 64, 65])
def test_one_group(spark, n):
    check(make(spark, [f"T{i}" for i in range(n)]))


def test_query_equals_sql(spark, small):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{small}/documents.parquet'")
    got = sorted(tuple(r) for r in op11_merkle_manifest(spark, small).collect())
    assert got == sorted(con.execute(mk.ORACLE_SQL).fetchall())
