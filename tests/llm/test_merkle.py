"""Manifests against a tree built level by level over whole groups."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tessera.llm import merkle

from ..oracle import connection, same

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(values):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def tree(nodes, fanout):
    """(root, proof of each node as (siblings, places))."""
    proofs, at, level = [[] for _ in nodes], list(range(len(nodes))), nodes
    while len(level) > 1:
        for i, j in enumerate(at):
            first = j // fanout * fanout
            proofs[i].append((level[first:j], level[j + 1 : first + fanout]))
            at[i] = j // fanout
        level = [sha(*level[i : i + fanout]) for i in range(0, len(level), fanout)]
    return level[0], proofs


def brute(rows, fanout=16):
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    built = {}
    for s in names:
        members = sorted(groups[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        built[s] = (members, *tree([leaf(r) for r in members], fanout))
    root, upper = tree([built[s][1] for s in names], fanout)
    out = []
    for s, above in zip(names, upper, strict=True):
        members, subroot, proofs = built[s]
        for r, below in zip(members, proofs, strict=True):
            proof = below + above
            touched = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            node = leaf([*r[:4], None if r[4] is None else r[4].translate(LOWER)] if touched else r)
            for before, after in proof:
                node = sha(*before, node, *after)
            out.append((r[0], leaf(r), subroot, root, sha(*[x for before, after in proof for x in [*before, *after]]), node, node == root))
    return sorted(out, key=str)


def table_of(n, sources, seed=3):
    r = random.Random(seed)
    rows = [(r.randrange(-5, 4 * n), r.choice(sources), r.choice(["en", None]), r.choice([None, 3]), r.choice([None, "", "Ab é", "plain", "X" * r.randint(1, 40)])) for _ in range(n)]
    return rows + rows[:7] + [(None, sources[0], "en", 1, "no id"), (None, None, None, None, None), (2**60 + 1, "", "", 0, "big")]


#: One source with most rows, sources of one row, a null source, an empty name, names whose order differs by bytes.
HOT = ["hot"] * 30 + ["a", "B", "é", "z", None, ""]


@pytest.mark.parametrize(("n", "sources", "fanout", "levels"), [(1200, HOT, 16, 2), (300, HOT, 2, 3), (300, HOT, 3, 1), (40, [f"s{i}" for i in range(60)], 2, 1), (1, ["only"], 16, 2), (16, ["one"], 16, 2), (256, ["one"], 16, 2), (257, ["one"], 16, 2)])
def test_manifest_equals_a_plain_tree(spark, n, sources, fanout, levels):
    rows = table_of(n, sources) if n not in (1, 16, 256, 257) else [(i, sources[0], "en", i, f"Text {i}") for i in range(n)]
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, leaf string, part string").repartition(5)
    leaves = docs.select(
        F.col("source").alias("part"), "doc_id", merkle.leaf_of(*[F.col(c) for c in merkle.FIELDS]).alias("leaf"),
        F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, merkle.leaf_of(*[F.col(c) for c in merkle.FIELDS[:-1]], merkle.tampered(F.col("text")))).alias("claimed"),
        F.monotonically_increasing_id().alias("row"),
    )
    got = merkle.manifest(leaves, fanout, levels)
    got = sorted(((r.doc_id, r.leaf, r.subroot, r.root, sha(*r.siblings), r.folded_root, r.folded_root == r.root) for r in got.collect()), key=str)
    assert got == brute(rows, fanout)


def test_a_proof_folds_to_the_root_and_only_for_its_leaf(spark):
    leaves = spark.range(100).select(F.lit("s").alias("part"), F.col("id").alias("doc_id"), F.sha2(F.col("id").cast("string"), 256).alias("leaf"), F.lit(None).cast("string").alias("claimed"), F.col("id").alias("row"))
    rows = merkle.manifest(leaves, 4, 2).collect()
    assert len(rows) == 100
    for r in rows:
        assert merkle.fold(r.leaf, r.siblings, r.places, r.runs) == r.root
        assert merkle.fold(rows[r.doc_id - 1].leaf, r.siblings, r.places, r.runs) != r.root


def test_empty_table(spark):
    leaves = spark.createDataFrame([], "part string, doc_id long, leaf string, claimed string, row long")
    assert merkle.manifest(leaves).collect() == []


def test_registered_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(d.doc_id, d.source, d.lang, d.n_chars, d.text) for d in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted((tuple(r) for r in merkle.op13_superblocks(spark, sf).collect()), key=str)
    assert got == brute(docs)
    assert {r[-1] for r in got} == {True, False}


def test_sql_twin(spark, sf_dir):
    same(merkle.op13_superblocks(spark, sf_dir).toPandas(), connection(sf_dir).sql(merkle.ORACLE).df())
