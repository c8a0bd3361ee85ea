"""Spelling variants: pairs of words one edit apart, by errata tries, and the frequent form of each word.

The words' trie is cut into heavy paths: at each node the edge with most words below goes on, every other edge, and the
end of a word that goes on in others, is light. Two words part at one node, where at least one of them leaves by a light
edge; so it is enough to merge light subtrees, each word of which is in at most log2(words) of them. A light subtree is
merged at its node

* with the edge's character replaced by the heavy one, into the heavy subtree (a replaced character),
* with the character replaced by a blank, together with the node's other light subtrees (a replaced character),
* with the character skipped, into the node's whole subtree (a deleted character); only the last of a run of equal
  characters is skipped, as the others give the same word,
* behind the heavy character, into the heavy subtree, whose words skip that character (an inserted one).

Where terminals coincide, the words are one edit apart, and each pair is found exactly once. Nodes and terminals are
polynomial hashes of prefixes with their lengths: one number each, so the errata of a light edge follow from sums kept
with it, without strings. Merging is an equality join of terminals in Spark. Every pair found is then confirmed on its
words, so equal hashes of different prefixes cost time, never a result.

No row has all words of a subtree. Edge counts are summed in each batch first. The nodes of the first three depths, where
many words meet, are few, as the alphabet has 90 letters (at most 8,191): they are broadcast; joins below are dealt by
node and left to the skew join. Words that differ in one place from a blank's word are at most 90.

Null texts have no words, a null id counts as an empty string in the hash, rows of one id are separate documents, extra
columns are ignored, an empty table gives no rows. Words may be of any length.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _BASE, mix, powers, stage, table

#: Letters besides a to z, as a class of a pattern.
LETTERS = "a-zÀ-ÿ"
#: Entries of a task's own counts before they are handed on.
HELD = 200_000
#: Nodes of these depths are broadcast: at most 1 + 90 + 90 * 90.
SHALLOW = 2

# ---------------------------------------------------------------- words


def spoiled(run: str, base: int, every: int) -> str:
    """The run, or, where ``every`` divides its hash, the run without one code point."""
    h = zlib.crc32(run.encode(), base)
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def _counts(least: int, every: int):
    pattern = re.compile(f"[{LETTERS}]{{{least},}}")

    def flush(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    def run(batches):
        counts: Counter = Counter()
        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                base = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                for w, n in Counter(pattern.findall((text or "").encode().lower().decode())).items():
                    w = spoiled(w, base, every)
                    if len(w) >= least:
                        counts[w] += n
                if len(counts) > HELD:
                    yield flush(counts)
                    counts = Counter()
        yield flush(counts)

    return run


def count_words(docs: DataFrame, least: int = 7, at_least: int = 2, every: int = 31) -> DataFrame:
    """word, n: runs of letters, A to Z in lower case, of at least ``least`` code points and ``at_least`` occurrences; one
    code point is deleted where ``every`` divides the run's hash."""
    x = docs.select("doc_id", "text").mapInArrow(_counts(least, every), "word string, n long")
    return x.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= at_least)


# ---------------------------------------------------------------- the trie

_END = 0


def _value(chars: np.ndarray) -> np.ndarray:
    return mix((chars.astype(np.uint64) + np.uint64(1)) * _BASE)


def _places(words: pa.Array) -> dict[str, np.ndarray]:
    """A row for each place of each word, its end included: word, place i, char, next, sum of the prefix, of the word, length."""
    texts = words.to_pylist()
    length = np.fromiter(map(len, texts), np.int64, len(texts))
    chars = np.frombuffer("".join(t + "\0" for t in texts).encode("utf-32-le"), np.uint32)  # no word has a zero; it marks the end
    first = np.concatenate([[0], np.cumsum(length + 1)])[:-1]
    word = np.repeat(np.arange(len(texts)), length + 1)
    i = np.arange(len(chars)) - first[word]
    up, _ = powers(int(length.max(initial=0)) + 2)
    terms = np.where(chars == _END, np.uint64(0), _value(chars) * up[i])
    before = np.cumsum(terms) - terms
    prefix = before - before[first][word]
    return {"word": word, "i": i, "char": chars, "next": np.append(chars[1:], _END), "prefix": prefix, "total": prefix[first + length][word], "length": length[word]}


def _edges(batches):
    """prefix, i, char, n: words of a batch by node and edge."""
    for batch in batches:
        p = _places(batch.column("word"))
        key = np.rec.fromarrays([p["prefix"], p["i"], p["char"]])
        edge, n = np.unique(key, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(edge.f0.view(np.int64)), pa.array(edge.f1, pa.int32()), pa.array(edge.f2.astype(np.int32)), pa.array(n, pa.int64())], ["prefix", "i", "char", "n"])


def _slots(shallow: bool):
    def run(batches):
        for batch in batches:
            p = _places(batch.column("word"))
            at = np.flatnonzero((p["i"] <= SHALLOW) == shallow)
            ids = batch.column("wid").to_numpy()[p["word"][at]]
            longs, ints = [p[c][at].view(np.int64) for c in ("prefix", "total")], [p[c][at].astype(np.int32) for c in ("i", "char", "next", "length")]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids, *longs, *ints)], ["wid", "prefix", "total", "i", "char", "next", "length"])

    return run


_SLOTS = "wid long, prefix long, total long, i int, char int, next int, length int"


def _terminals(batches):
    for batch in batches:
        p = _places(batch.column("word"))
        at = np.flatnonzero(p["char"] == _END)
        yield pa.RecordBatch.from_arrays([batch.column("wid"), pa.array(p["total"][at].view(np.int64)), pa.array(p["length"][at].astype(np.int32))], ["other", "total", "length"])


def _errata(batches):
    """total, length, place, wid: terminals of light edges after their merges; place is -1 but for blanked characters."""
    down = np.uint64(pow(int(_BASE), -1, 1 << 64))
    for batch in batches:
        c = {n: batch.column(n).to_numpy() for n in batch.schema.names}
        prefix, total, i = c["prefix"].view(np.uint64), c["total"].view(np.uint64), c["i"].astype(np.int64)
        up, _ = powers(int(i.max(initial=0)) + 2)
        own, heavy = _value(c["char"]) * up[i], _value(c["heavy"]) * up[i]
        inner = c["char"] != _END
        skip = inner & (c["char"] != c["next"])
        after = total - prefix - own  # what follows the character
        merged = [
            (inner, total - own + heavy, c["length"], np.full(len(i), -1)),
            (inner, total - own, c["length"], i),
            (skip, prefix + after * down, c["length"] - 1, np.full(len(i), -1)),
            (np.ones(len(i), bool), prefix + heavy + (total - prefix) * _BASE, c["length"] + 1, np.full(len(i), -1)),
        ]
        columns = [np.concatenate([x[k][x[0]] for x in merged]) for k in (1, 2, 3)]
        ids = np.concatenate([c["wid"][x[0]] for x in merged])
        yield pa.RecordBatch.from_arrays([pa.array(columns[0].view(np.int64)), pa.array(columns[1].astype(np.int32)), pa.array(columns[2].astype(np.int32)), pa.array(ids)], ["total", "length", "place", "wid"])


def pairs(words: DataFrame) -> DataFrame:
    """a, b: ids of words one edit apart, each pair once; ``words``: a table of (wid, word, n)."""
    edges = words.select("word").mapInArrow(_edges, "prefix long, i int, char int, n long").groupBy("prefix", "i", "char").agg(F.sum("n").alias("n"))
    heavy = F.max(F.when(F.col("char") != _END, F.struct("n", "char")))["char"]
    forks = stage(edges.groupBy("prefix", "i").agg(heavy.alias("heavy"), F.count("*").alias("edges")).where("edges > 1").drop("edges"), "forks")
    slots = lambda shallow: words.select("wid", "word").mapInArrow(_slots(shallow), _SLOTS)
    light = slots(True).join(F.broadcast(forks.where(F.col("i") <= SHALLOW)), ["prefix", "i"]).unionByName(slots(False).join(forks.where(F.col("i") > SHALLOW), ["prefix", "i"]))
    merged = stage(light.where("char <> heavy").mapInArrow(_errata, "total long, length int, place int, wid long"), "errata")
    ends = words.select("wid", "word").mapInArrow(_terminals, "other long, total long, length int")
    found = merged.where("place < 0").join(ends, ["total", "length"]).select(F.col("wid").alias("a"), F.col("other").alias("b"))
    blank = merged.where("place >= 0")
    both = blank.join(blank.withColumnRenamed("wid", "other"), ["total", "length", "place"]).where("wid < other").select(F.col("wid").alias("a"), F.col("other").alias("b"))
    side = lambda s: words.select(F.col("wid").alias(s), F.col("word").alias(f"{s}_word"), F.col("n").alias(f"{s}_n"))
    x = found.union(both).join(side("a"), "a").join(side("b"), "b")
    return x.where(F.levenshtein("a_word", "b_word", 1) == 1)


def variants(counts: DataFrame, times: int = 10) -> DataFrame:
    """word, form, root, n, n_near, form_n for each row of ``counts`` (word, n; distinct words).

    A form is the near word of largest n, if that is at least ``times`` the word's own. Every step towards a root so
    multiplies n by ``times``; pointers are doubled until nothing changes, at most five times."""
    words = stage(counts.withColumn("wid", F.monotonically_increasing_id()), "words")
    near = stage(pairs(words), "near")
    half = lambda a, b: F.struct(F.col(a).alias("wid"), (-F.col(f"{b}_n")).alias("less"), F.col(f"{b}_word").alias("form"), F.col(b).alias("to"))
    x = near.select(F.explode(F.array(half("a", "b"), half("b", "a"))).alias("x")).select("x.*")
    best = x.groupBy("wid").agg(F.count("*").alias("n_near"), F.min(F.struct("less", "form", "to")).alias("best"))
    known = words.join(best, "wid", "left").withColumn("is_form", -F.col("best.less") >= times * F.col("n"))
    known = stage(known.select("wid", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), *[F.expr(f"CASE WHEN is_form THEN {v} END AS {c}") for c, v in (("form", "best.form"), ("form_n", "-best.less"), ("to", "best.to"))]), "forms")
    up, more = known.where("to IS NOT NULL").select("wid", "to"), 1
    while more:
        on = up.select(F.col("wid").alias("to"), F.col("to").alias("further"))
        both = stage(up.join(on, "to", "left").select("wid", F.coalesce("further", "to").alias("to"), F.col("further").isNotNull().alias("moved")), "roots")
        more, up = both.where("moved").limit(1).count(), both.select("wid", "to")
    roots = up.join(words.select(F.col("wid").alias("to"), F.col("word").alias("root")), "to").select("wid", "root")
    out = known.join(roots, "wid", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_errata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage(variants(count_words(table(spark, sf_dir, "documents"))), "variants")


#: DuckDB twin: crc32 byte by byte, words blanked and shortened at each place, roots by recursion.
ORACLE = r"""
WITH RECURSIVE runs AS (SELECT doc_id, run, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run FROM documents) WHERE length(run) >= 7 GROUP BY ALL),
b AS (SELECT *, coalesce(doc_id::VARCHAR, '') || ':' || run AS s, hex(encode(s)) AS x FROM runs),
h AS (SELECT *, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(strlen(s)), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT)), lambda a, c: list_reduce(list_prepend(xor(a, c), range(8)), lambda y, i: xor(y >> 1, 3988292384 * (y & 1))))) AS h FROM b),
w AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, sum(n)::BIGINT AS n FROM h GROUP BY 1 HAVING length(word) >= 7 AND sum(n) >= 2),
p AS (SELECT word, n, i, substr(word, 1, i - 1) AS l, substr(word, i + 1) AS r FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
d AS (SELECT DISTINCT p.word AS a, p.n AS an, w.word AS b, w.n AS bn FROM p JOIN w ON w.word = l || r),
near AS (SELECT x.word AS a, y.word AS b, y.n AS bn FROM p x JOIN p y ON x.l || '*' || x.r = y.l || '*' || y.r AND x.word <> y.word UNION ALL SELECT a, b, bn FROM d UNION ALL SELECT b, a, an FROM d),
best AS (SELECT a, count(*) AS n_near, first(b ORDER BY bn DESC, encode(b)) AS b, max(bn) AS bn FROM near GROUP BY a),
f AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN bn >= 10 * n THEN b END AS form, CASE WHEN bn >= 10 * n THEN bn END AS form_n FROM w LEFT JOIN best ON a = word),
up AS (SELECT word, word AS root, form AS further FROM f UNION ALL SELECT up.word, f.word, f.form FROM up JOIN f ON f.word = up.further)
SELECT f.word, f.form, up.root, f.n, f.n_near, f.form_n FROM f JOIN up ON up.word = f.word AND up.further IS NULL
"""
