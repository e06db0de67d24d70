"""A Merkle manifest of a dataset by superblock reduction.

Every row is a leaf. Within a group leaves are numbered in order; a superblock holds ``fanout**levels``
consecutive ones, and one ``applyInPandas`` call collapses all its levels to the block's root. Block roots
are nodes of the same kind and are reduced in turn, until each group has one node; the nodes of all groups,
in order of the groups, are reduced likewise to the root. Proofs go the other way: a block's own (upper)
proof meets the block again, and every node's proof is its lower part within the block with that behind it.

H is the lowercase hex SHA-256 of its inputs one after another, digests as hex text. While a group has
several nodes, every ``fanout`` consecutive ones become their H, the last run of fewer too, even of one.

Scale: leaves are shuffled as digests, never as texts; a task holds blocks of 512 leaves, so a large group
is as many tasks as it needs, and rounds number log(rows) / log(512). Numbering deals rows by range.

Edge cases: nulls are fields of their own (``-``); null groups are one group, the first; leaves of one order
value are ordered by digest, null ones first; equal leaves are each a leaf; long texts are hashed in the
JVM, once; an empty table gives an empty result; columns that are no field are ignored.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.llm._common import materialize, running

FANOUT, LEVELS = 8, 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_NODES = "g string, at long, whole long, node string"
_PROVEN = "g string, at long, node string, proof string, path array<int>, subroot string, root string"


def digest(*nodes: Column) -> Column:
    return F.sha2(F.concat(*nodes), 256)


def leaf(*fields: Column) -> Column:
    """H of all fields: ``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    texts = [f.cast("string") for f in fields]
    return digest(*(F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts))


def _height(n: int, fanout: int) -> int:
    levels = 0
    while n > 1:
        n, levels = -(-n // fanout), levels + 1
    return levels


def _levels(nodes: list[str], levels: int, fanout: int) -> list[list[str]]:
    """The nodes and those of each level above."""
    from hashlib import sha256

    out = [nodes]
    for _ in range(levels):
        out.append([sha256("".join(out[-1][i : i + fanout]).encode()).hexdigest() for i in range(0, len(out[-1]), fanout)])
    return out


def _collapse(fanout: int, levels: int):
    """(g, block) -> the block's root, as a node of the next tier."""

    def run(key, block):
        whole = int(block["whole"].iloc[0])
        up = min(levels, _height(whole, fanout))
        root = _levels(block.sort_values("at")["node"].tolist(), up, fanout)[-1][0]
        for _ in range(up):
            whole = -(-whole // fanout)
        return pd.DataFrame({"g": [key[0]], "at": [key[1]], "whole": [whole], "node": [root]})

    return run


def _prove(fanout: int, levels: int, carry: list[str]):
    """Nodes of a block and the block's own proof -> the nodes with their proofs: lower part, then upper."""

    def run(key, block, above):
        block, over = block.sort_values("at"), above.iloc[0]
        up = min(levels, _height(int(block["whole"].iloc[0]), fanout))
        tiers = _levels(block["node"].tolist(), up, fanout)
        proofs, paths = [over["proof"]], [list(over["path"])]
        for tier in reversed(tiers[:-1]):
            runs = [tier[i : i + fanout] for i in range(0, len(tier), fanout)]
            proofs = ["".join(run[:j] + run[j + 1 :]) + proofs[i] for i, run in enumerate(runs) for j in range(len(run))]
            paths = [[j, len(run), *paths[i]] for i, run in enumerate(runs) for j in range(len(run))]
        out = {"g": key[0], "at": block["at"].to_numpy(), "node": tiers[0], "proof": proofs, "path": paths, "subroot": over["subroot"], "root": over["root"]}
        return pd.DataFrame(out | {c: block[c].to_numpy() for c in carry})

    return run


def _tiers(nodes: DataFrame, fanout: int, levels: int, label: str) -> list[DataFrame]:
    """``nodes`` (g, at, whole, node), the block roots of these, and so on to one node a group."""
    tiers, block = [nodes], fanout**levels
    left = nodes.agg(F.max("whole")).first()[0] or 0
    while left > 1:
        dealt = tiers[-1].select("g", F.col("at"), "whole", "node", F.floor(F.col("at") / block).alias("b"))
        tiers.append(materialize(dealt.groupBy("g", "b").applyInPandas(_collapse(fanout, levels), _NODES), f"{label}-{len(tiers)}"))
        left = -(-left // block)
    return tiers


def _descend(tiers: list[DataFrame], above: DataFrame, fanout: int, levels: int, carry: list[str]) -> DataFrame:
    """Proofs of the lowest tier's nodes, from those of the highest tier's (``above``, of the form _PROVEN)."""
    block = fanout**levels
    for tier in reversed(tiers[:-1]):
        own = carry if tier is tiers[0] else []
        extra = "".join(f", {c} {t}" for c, t in tier.select(*own).dtypes) if own else ""
        nodes = tier.withColumn("b", F.floor(F.col("at") / block))
        above = nodes.groupBy("g", "b").cogroup(above.groupBy("g", "at")).applyInPandas(_prove(fanout, levels, own), _PROVEN + extra)
    return above


def manifest(leaves: DataFrame, group: str = "lang", order: str = "doc_id", node: str = "leaf", carry: tuple[str, ...] = (), fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """Every leaf with its proof, its group's subroot and the root.

    Columns: g (the group as text behind "1", "0" for null), at (number in the group), node, proof (all
    siblings on the way up, from left to right and level by level), path (position and length of the run
    at each level), subroot, root, and those of ``carry``."""
    key = F.coalesce(F.concat(F.lit("1"), F.col(group).cast("string")), F.lit("0"))
    base = materialize(leaves.select(key.alias("g"), F.col(order).alias("_order"), F.col(node).alias("node"), *carry), "leaves")
    numbered = running(base, ["g"], ["_order", "node"], None, "leaves-ordered").select("g", F.col("before").alias("at"), "whole", "node", *carry)
    tiers = _tiers(numbered, fanout, levels, "nodes")
    subroots = tiers[-1].select(F.col("g").alias("name"), "node")
    groups = running(subroots.withColumn("g", F.lit("")), ["g"], ["name"], None, "subroots").select("g", F.col("before").alias("at"), "whole", "node", "name")
    upper = _tiers(groups, fanout, levels, "tops")
    top = upper[-1].select("g", "at", "node", F.lit("").alias("proof"), F.array().cast("array<int>").alias("path"), F.lit("").alias("subroot"), F.col("node").alias("root"), *(["name"] if len(upper) == 1 else []))
    proven = _descend(upper, top, fanout, levels, ["name"])
    heads = materialize(proven.select(F.col("name").alias("g"), F.lit(0).cast("long").alias("at"), "node", "proof", "path", F.col("node").alias("subroot"), "root"), "heads")
    if len(tiers) > 1:
        return _descend(tiers, heads, fanout, levels, list(carry))
    return tiers[0].join(heads.drop("at", "node"), "g").select("g", "at", "node", "proof", "path", "subroot", "root", *carry)


def fold(node: Column, proof: Column, path: Column) -> Column:
    """The root that a node and its proof lead to."""

    @F.pandas_udf("string")
    def run(node: pd.Series, proof: pd.Series, path: pd.Series) -> pd.Series:
        from hashlib import sha256

        def one(now, others, steps):
            first = 0
            for j, n in zip(steps[::2], steps[1::2]):
                left, last = first + 64 * j, first + 64 * (n - 1)
                now = sha256((others[first:left] + now + others[left:last]).encode()).hexdigest()
                first = last
            return now

        return pd.Series([one(*x) for x in zip(node, proof, path)], dtype=object)

    return run(node, proof, path)


def tampered(key: Column, text: Column) -> Column:
    """Texts of keys whose CRC-32 is divisible by 3 in lower case (A-Z only), others as they are."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.crc32(key.cast("string")) % 3 == 0, F.translate(text, upper, upper.lower())).otherwise(text)


def audit(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, and folded_root and verified of the table with tampered texts.
    The leaf of a tampered row is made from its tampered text in the scan that makes its own."""
    names = [F.col(c) for c in FIELDS]
    changed = tampered(F.col("doc_id"), F.col("text"))
    other = F.when(changed != F.col("text"), leaf(*names[:-1], changed))
    found = manifest(docs.select("doc_id", "lang", leaf(*names).alias("leaf"), other.alias("other")), carry=("doc_id", "other"))
    folded = found.withColumn("folded_root", fold(F.coalesce("other", "node"), F.col("proof"), F.col("path")))
    return folded.select("doc_id", F.col("node").alias("leaf"), "subroot", "root", F.sha2("proof", 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


#: CRC-32 by its bits, of the decimal digits of doc_id (null of null).
_CRC_SQL = """list_reduce(list_prepend(4294967295::bigint, [ascii(x)::bigint for x in string_split(doc_id::varchar, '')]),
  lambda c, b: list_reduce(list_prepend(xor(c, b), [0::bigint for k in range(8)]), lambda v, z: case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end)) """


def _sql(levels: int = 7, fanout: int = FANOUT) -> str:
    """The same rows by joins, a level at a time, for groups of up to ``fanout**levels`` leaves and as many groups."""
    field = lambda c: f"case when {c} is null then '-' else strlen({c}::varchar)::varchar || ':' || {c}::varchar end"
    whole = " || ".join(map(field, FIELDS))
    other = " || ".join(map(field, (*FIELDS[:-1], "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")))
    steps = []

    def reduce(name: str, up: int):
        """Tables name_j of nodes (g, i, n, h), name_s_j of the siblings of each, and name_j+1 of their parents."""
        for j in range(up):
            steps.append(f"{name}_r_{j} as (select g, i // {fanout} as p, any_value(n) as n, list(h order by i) as hs from {name}_{j} group by all)")
            steps.append(f"{name}_s_{j} as (select a.g, a.i, a.n > 1 as up, array_to_string(r.hs[1:a.i % {fanout}], '') as l, array_to_string(r.hs[a.i % {fanout} + 2:], '') as f from {name}_{j} a join {name}_r_{j} r on a.g is not distinct from r.g and r.p = a.i // {fanout})")
            steps.append(f"{name}_{j + 1} as (select g, p as i, (n + {fanout - 1}) // {fanout} as n, case when n > 1 then sha256(array_to_string(hs, '')) else hs[1] end as h from {name}_r_{j})")

    def climb(name: str, start: str, up: int):
        """From rows (d, g, i, t, proof): t folded with the siblings of each level."""
        steps.append(f"{name}_c_0 as ({start})")
        for j in range(up):
            steps.append(f"{name}_c_{j + 1} as (select c.* replace (c.i // {fanout} as i, case when s.up then sha256(s.l || c.t || s.f) else c.t end as t, c.proof || case when s.up then s.l || s.f else '' end as proof) from {name}_c_{j} c join {name}_s_{j} s on c.g is not distinct from s.g and c.i = s.i)")

    steps.append(f"leaves as (select doc_id, lang, sha256({whole}) as leaf, case when xor(crc, 4294967295) % 3 = 0 then sha256({other}) else sha256({whole}) end as t from (select *, {_CRC_SQL} as crc from documents))")
    steps.append("low_0 as (select lang as g, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as i, count(*) over (partition by lang) as n, leaf as h, t, doc_id from leaves)")
    reduce("low", levels)
    steps.append(f"top_0 as (select g as name, '' as g, row_number() over (order by g nulls first) - 1 as i, count(*) over () as n, h from low_{levels})")
    reduce("top", levels)
    climb("low", "select doc_id, g as lang, h as leaf, g, i, t, '' as proof from low_0", levels)
    climb("top", f"select c.doc_id, c.leaf, k.h as subroot, '' as g, k.i, c.t, c.proof from low_c_{levels} c join top_0 k on k.name is not distinct from c.lang", levels)
    return "with " + ",\n".join(steps) + f"""
select c.doc_id, c.leaf, c.subroot, r.h as root, sha256(c.proof) as proof_sha256, c.t as folded_root, c.t = r.h as verified from top_c_{levels} c, top_{levels} r"""


ORACLE_SQL = _sql()
