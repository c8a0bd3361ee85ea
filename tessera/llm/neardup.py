"""MinHash near-dedup: SuperMinHash signatures, banding, exact verification, union-find grouping.

A document is the set of its distinct word shingles. SuperMinHash (Ertl, 2017) gives every element a random
permutation of the ranks 0..m-1; step j offers ``j + uniform`` to the j-th slot of the permutation, so ranks of one
element are correlated, the estimate has lower variance than MinHash, and a document stops as soon as every slot holds
less than j. Bands of the signature name candidate buckets; every link is confirmed on the full shingle sets.

Scale. Documents with equal sets form a class and only its smallest id goes on, so thousands of exact copies cost one
row. A bucket is not expanded into pairs: each member is compared with the bucket's smallest member (a star), links are
contracted to components, and members that stay outside their anchor's component are then compared with the members
around the same anchor that an exact bound on shared edits leaves (``_open_pairs``).
What is compared is exact: 100 * |A and B| >= percent * |A or B|.

Nulls and empty texts have an empty set and link with nothing. Texts shorter than a shingle have their whole word
sequence as their one element. Repeated rows of one id count as that id.
Rows without an id are left out; of different texts under one id the one with the smallest hash counts. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, components, drop_stage, lists, mix, one_text, prefilter, stage, table, text_slices

_STEP = np.uint64(0xD1342543DE82EF95)


def shingle_sets(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each document, and where each document's begin."""
    n, h = words.n, words.hash
    size = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
    first = np.concatenate([[0], np.cumsum(size)])
    doc = np.repeat(np.arange(len(n)), size)
    at = words.first[:-1][doc] + (np.arange(first[-1]) - first[doc])
    span = np.minimum(n, k)[doc]
    value = span.astype(np.uint64)
    for j in range(k):
        ok = span > j
        value[ok] = mix(value[ok] * _STEP + h[at[ok] + j])
    order = np.lexsort((value, doc))
    value = value[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    value, doc = value[new], doc[new]
    return value, np.searchsorted(doc, np.arange(len(n) + 1))


def superminhash(value: np.ndarray, first: np.ndarray, m: int) -> np.ndarray:
    """Signatures (documents x m) of sets given as ``value`` and ``first``; slots of empty sets keep the largest value."""
    n = len(first) - 1
    sig = np.full((n, m), np.uint64(0xFFFFFFFFFFFFFFFF))
    doc = np.repeat(np.arange(n), np.diff(first))
    rank = np.tile(np.arange(m, dtype=np.uint16 if m > 256 else np.uint8), (len(value), 1))
    row = np.arange(len(value))
    for j in range(m):
        if not len(row):
            break
        u = mix(value[row] + np.uint64((j + 1) * int(_STEP) % (1 << 64)))
        k = j + (((u & np.uint64(0xFFFFFFFF)) * np.uint64(m - j)) >> np.uint64(32)).astype(np.int64)
        slot = rank[row, k]
        rank[row, k] = rank[row, j]
        np.minimum.at(sig.reshape(-1), doc[row] * m + slot, np.uint64(j << 32) | (u >> np.uint64(32)))
        row = row[(sig.max(axis=1) >> np.uint64(32) > j)[doc[row]]]
    return sig


def _sketches(k: int, bands: int, rows: int):
    m = bands * rows

    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id")
            for at, to, data, offsets in text_slices(batch.column("text")):
                value, first = shingle_sets(Words(data, offsets, lower=True), k)
                size = np.diff(first)
                sig = superminhash(value, first, m)
                key = np.zeros((len(size), bands), np.uint64)
                for b in range(bands):
                    key[:, b] = np.uint64(b + 1)
                    for r in range(rows):
                        key[:, b] = mix(key[:, b] * _STEP + sig[:, b * rows + r])
                digest = [hashlib.blake2b(value[a:z].tobytes(), digest_size=16).digest() for a, z in zip(first[:-1], first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(at, to - at), pa.array(size, pa.int64()), pa.array(digest, pa.binary()), lists(key.reshape(-1).view(np.int64), np.arange(len(size) + 1) * bands, pa.int64())],
                    ["doc_id", "n_shingles", "digest", "keys"],
                )

    return run


def _sets(k: int):
    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id")
            for at, to, data, offsets in text_slices(batch.column("text")):
                value, first = shingle_sets(Words(data, offsets, lower=True), k)
                yield pa.RecordBatch.from_arrays([ids.slice(at, to - at), lists(value.view(np.int64), first, pa.int64())], ["doc_id", "elements"])

    return run


def _shared(batches):
    """Sizes of both sets of a pair and of what they share (elements are sorted as unsigned numbers)."""
    for batch in batches:
        x, y = batch.column("x"), batch.column("y")
        ox, oy = x.offsets.to_numpy(), y.offsets.to_numpy()
        vx, vy = x.values.to_numpy().view(np.uint64), y.values.to_numpy().view(np.uint64)
        both = np.zeros(batch.num_rows, np.int64)
        for i in range(batch.num_rows):
            a, b = vx[ox[i] : ox[i + 1]], vy[oy[i] : oy[i + 1]]
            if len(a) > len(b):
                a, b = b, a
            both[i] = (b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum()
        sizes = [pa.array(np.diff(o).astype(np.int64)) for o in (oy, ox)]
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), *sizes, pa.array(both)], ["a", "b", "na", "nb", "both"])


def _open_pairs(star: DataFrame, found: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) around one anchor that are in different components and may still be links.

    Around an anchor H of n elements let x lack d and add e elements, of which c occur in another document at all (those
    around such anchors). With s shared edits, x and y are a link if and only if
    (100 + p) * s >= p * (e + e') + 100 * (d + d') - (100 - p) * n, and s <= min(d, d') + min(c, c'). Private edits, as
    random copies have them, rule a member out by the best partner that its anchor has, without a look at its pairs.
    """
    t = 100 + percent
    place = lambda name: found.withColumnsRenamed({"node": name, "component": f"c{name}"})
    around = star.select("a", "b", F.col("na").alias("n"), (F.col("na") - F.col("both")).alias("d"), (F.col("nb") - F.col("both")).alias("e"), "both", "nb")
    around = around.join(place("a"), "a", "left").join(place("b"), "b", "left").withColumn("ca", F.coalesce("ca", "a")).withColumn("cb", F.coalesce("cb", "b"))
    mixed = around.groupBy("a").agg(F.max(F.col("ca") != F.col("cb")).alias("mixed")).where("mixed").select("a")
    around = stage(around.join(mixed, "a", "left_semi"), "around")
    ids = around.select(F.col("b").alias("doc_id")).union(around.select("a")).distinct()
    elements = prefilter(sets, "doc_id", ids).join(ids, "doc_id", "left_semi").select("doc_id", F.explode("elements").alias("element"))
    private = elements.groupBy("element").agg(F.count("*").alias("n"), F.min("doc_id").alias("b")).where("n = 1").groupBy("b").agg(F.count("*").alias("private"))
    x = around.join(private, "b", "left").withColumn("c", F.col("nb") - F.coalesce("private", F.lit(0)) - F.col("both"))
    x = x.withColumn("need", percent * F.col("e") + 100 * F.col("d") - (100 - percent) * F.col("n")).withColumn("gain", t * (F.col("d") + F.col("c")) - percent * F.col("e") - 100 * F.col("d"))
    x = stage(x.select("a", "b", "cb", "ca", "d", "c", "n", "need", "gain"), "edits")
    best = x.groupBy("a").agg(F.max("gain").alias("best"))
    odd = x.where("cb <> ca and gain >= -(n * " + str(100 - percent) + ")").join(best, "a").where("best >= need").select("a", F.col("b").alias("p"), F.col("cb").alias("pc"), F.col("d").alias("pd"), F.col("c").alias("pe"), F.col("need").alias("pn"))
    other = x.select("a", F.col("b").alias("q"), F.col("cb").alias("qc"), F.col("d").alias("qd"), F.col("c").alias("qe"), (F.col("need") + (100 - percent) * F.col("n")).alias("qn"))
    may = (F.col("pc") != F.col("qc")) & (t * (F.least("pd", "qd") + F.least("pe", "qe")) >= F.col("pn") + F.col("qn"))
    return odd.join(other, "a").where(may).select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct()


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, bands: int = 42, rows: int = 6) -> DataFrame:
    """doc_id, n_shingles, class_id, component_id, kept for each document id of ``docs`` (doc_id, text, ...).

    With 42 bands of 6 rows a pair at similarity 0.8 is missed with probability 3e-6, one at 0.85 with 1e-9.
    """
    docs = one_text(docs.select("doc_id", "text"))
    one = stage(docs.mapInArrow(_sketches(shingle, bands, rows), "doc_id long, n_shingles long, digest binary, keys array<long>"), "sketch")
    classes = one.where("n_shingles > 0").groupBy("digest").agg(F.min("doc_id").alias("class_id"))
    classes = stage(classes, "classes")
    reps = one.where("n_shingles > 0").join(classes.select(F.col("class_id").alias("doc_id")), "doc_id", "left_semi").select("doc_id", F.explode("keys").alias("key"))
    shared = stage(reps.groupBy("key").agg(F.min("doc_id").alias("anchor"), F.count("*").alias("n")).where("n > 1").select("key", "anchor"), "buckets")
    members = stage(prefilter(reps, "key", shared).join(shared, "key").distinct(), "members")

    wanted = stage(members.select("doc_id").distinct(), "wanted")
    sets = stage(prefilter(docs, "doc_id", wanted).join(wanted, "doc_id", "left_semi").mapInArrow(_sets(shingle), "doc_id long, elements array<long>").dropDuplicates(["doc_id"]), "sets")

    def compared(pairs: DataFrame, name: str) -> DataFrame:
        x, y = sets.select(F.col("doc_id").alias("b"), F.col("elements").alias("x")), sets.select(F.col("doc_id").alias("a"), F.col("elements").alias("y"))
        both = pairs.join(x, "b").join(y, "a").select("a", "b", "x", "y").mapInArrow(_shared, "a long, b long, na long, nb long, both long")
        return stage(both.withColumn("linked", 100 * F.col("both") >= percent * (F.col("na") + F.col("nb") - F.col("both"))), name)

    star = compared(members.where("doc_id <> anchor").select(F.col("anchor").alias("a"), F.col("doc_id").alias("b")).distinct(), "star")
    links = star.where("linked").select("a", "b")
    found = stage(components(links), "components")
    rest = compared(_open_pairs(star, found, sets, percent), "rest")
    if not rest.where("linked").isEmpty():
        found = stage(components(links.union(rest.where("linked").select("a", "b"))), "components")

    ids = one.select("doc_id", "n_shingles", "digest").dropDuplicates(["doc_id"]).join(classes, "digest", "left")
    out = ids.join(found.withColumnsRenamed({"node": "class_id"}), "class_id", "left")
    out = out.withColumn("component_id", F.coalesce("component", "class_id", "doc_id")).withColumn("class_id", F.coalesce("class_id", "doc_id"))
    out = stage(out.select("doc_id", "n_shingles", "class_id", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept")), "result")
    drop_stage(one, classes, shared, members, wanted, sets, star, rest)
    return out


def op5_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=4, percent=80)
