"""Variants against all pairs of words, and the registered query against its SQL twin."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import variants

from ..oracle import connection, same


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(counts):
    out = {}
    for w, n in counts.items():
        near = [v for v in counts if one_edit(w, v)]
        best = min(near, key=lambda v: (-counts[v], v.encode()), default=None)
        form = best if best is not None and counts[best] >= 10 * n else None
        out[w] = [form, n, len(near), counts[form] if form else None]
    rows = set()
    for w, (form, *rest) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        rows.add((w, form, root, *rest))
    return rows


def got(df):
    return sorted(((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()), key=str)


def dense(seed):
    """Words over few letters, with runs, prefixes of each other, and counts that make chains."""
    r = random.Random(seed)
    words = {"".join(r.choice("abé") for _ in range(r.randint(1, 7))) for _ in range(400)} | {"a", "b", "a" * 50, "a" * 51, "a" * 49 + "b", "ab" * 400, "ab" * 399 + "a", "ab" * 200 + "c" + "ab" * 199 + "b"}
    return {w: int(10 ** r.uniform(0.4, 5)) for w in sorted(words)}


@pytest.mark.parametrize("seed", [1, 2])
def test_variants_equal_all_pairs(spark, seed):
    counts = dense(seed)
    df = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)
    assert got(variants.variants(df)) == sorted(brute(counts), key=str)


def test_each_pair_is_found_once(spark):
    counts = dense(3)
    words = spark.createDataFrame([(i, w, n) for i, (w, n) in enumerate(counts.items())], "wid long, word string, n long")
    found = [tuple(sorted((r.a_word, r.b_word))) for r in variants.pairs(words).collect()]
    want = [(a, b) for a in counts for b in counts if a < b and one_edit(a, b)]
    assert sorted(found) == sorted(want)


def test_places_are_hashes_of_prefixes():
    p = variants._places(pa.array(["abc", "", "abd", "éab"]))
    assert p["length"].tolist() == [3] * 4 + [0] + [3] * 8
    by = {}
    for w, i, x in zip(p["word"], p["i"], p["prefix"], strict=True):
        by.setdefault(int(x), set()).add(["abc", "", "abd", "éab"][w][:i])
    assert all(len(v) == 1 for v in by.values()) and len(by) == len({x for v in by.values() for x in v})
    assert np.array_equal(p["char"] == 0, p["i"] == p["length"])


def test_counts(spark):
    rows = [(1, "Letters letters LETTERS 中letters_x naïveté ÀB" + "É" * 7), (2, None), (3, ""), (None, "letters withoutid withoutid"), (4, "repeated repeated"), (4, "repeated repeated"), (5, "long " + "wordlike " * 20_000), (6, "a" * 5000 + " " + "a" * 5000), *[(i, f"Example number{i % 3} sampling") for i in range(10, 200)]]
    docs = spark.createDataFrame([(d, t, "clash", 1) for d, t in rows], "doc_id long, text string, word string, n int").repartition(4)
    want = Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.encode().lower().decode()
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            want[run] += 1
    want = {w: n for w, n in want.items() if len(w) >= 7 and n >= 2}
    counts = variants.count_words(docs)
    assert {r.word: r.n for r in counts.collect()} == want
    assert got(variants.variants(counts)) == sorted(brute(want), key=str)
    assert variants.variants(variants.count_words(docs.limit(0))).collect() == []


def test_sql_twin(spark, sf_dir):
    rows = variants.op11_errata(spark, sf_dir).toPandas()
    assert rows["form"].notna().sum() > 10
    same(rows, connection(sf_dir).sql(variants.ORACLE).df())
