"""Substring dedup by seed and extend: every word inside a long passage that occurs earlier is removed.

Seeds. A window is ``length`` consecutive words of one document. Winnowing picks, in each window, the word k-gram with
the smallest hash; equal windows pick equal anchors at equal places, so two documents that share a window share an
anchor. Anchors that occur once are dropped by a join on their hashes.

Extension. Around every anchor that occurs again, the windows that picked it are fingerprinted to the left and right;
all occurrences of a fingerprint meet in one aggregate that keeps the earliest (doc_id, start), so a passage shared by
thousands of documents costs a row per occurrence and never a pair. Every other occurrence is a repeat. Overlapping
repeats of a document merge into maximal spans, and their words go.

Scale. Documents with equal word sequences are found first by their digests; all but the smallest id are repeats as a
whole and need no seeds. Texts are shuffled only for documents that hold a repeated anchor, after a Bloom filter of
fixed size. Fingerprints have 96 bits.

Nulls and empty texts have no words. A document shorter than a window loses nothing. Repeated rows of one id count
once. Rows without an id are left out; of different texts under one id the one with the smallest hash counts.
 Extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, drop_stage, lists, mix, one_text, prefilter, range_hash, stage, table, text_slices

_EMPTY = hashlib.sha256(b"").hexdigest()


def _windows(words: Words, length: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word of each window, its document, and the first word of the anchor it picks."""
    many = np.maximum(words.n - length + 1, 0)
    doc = np.repeat(np.arange(len(many)), many)
    if not len(doc):
        return doc, doc, doc
    before = np.concatenate([[0], np.cumsum(many)])
    start = words.first[:-1][doc] + np.arange(len(doc)) - before[doc]
    at = np.arange(len(words.hash) - k + 1)
    gram = range_hash(words.hash, at, at + k)
    lowest = np.lib.stride_tricks.sliding_window_view(gram, length - k + 1)[start].argmin(axis=1)
    return start, doc, start + lowest


def _anchors(length: int, k: int):
    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id")
            for at, to, data, offsets in text_slices(batch.column("text")):
                words = Words(data, offsets, lower=False)
                _, _, anchor = _windows(words, length, k)
                anchor = np.unique(anchor)
                cut = np.searchsorted(anchor, words.first)
                joined = [b" ".join(data[a:z].tobytes().split()) for a, z in zip(offsets[:-1], offsets[1:], strict=True)]
                sha = [hashlib.sha256(x).hexdigest() for x in joined]
                gram = range_hash(words.hash, anchor, anchor + k)
                place = anchor - words.first[:-1][np.repeat(np.arange(to - at), np.diff(cut))]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(at, to - at), pa.array(words.n, pa.int64()), pa.array(sha), lists(gram.view(np.int64), cut, pa.int64()), lists(place, cut, pa.int32())],
                    ["doc_id", "n_words", "sha", "gram", "place"],
                )

    return run


def _fingerprints(length: int, k: int):
    def run(batches):
        for batch in batches:
            ids, wanted = batch.column("doc_id").to_numpy(), batch.column("places")
            for at, to, data, offsets in text_slices(batch.column("text")):
                words = Words(data, offsets, lower=False)
                start, doc, anchor = _windows(words, length, k)
                seed = np.zeros(len(words.hash), bool)
                for i in range(at, to):
                    seed[words.first[i - at] + np.asarray(wanted[i].values)] = True
                keep = seed[anchor]
                start, doc = start[keep], doc[keep]
                check = range_hash(mix(words.hash + np.uint64(1)), start, start + length)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(range_hash(words.hash, start, start + length).view(np.int64)),
                        pa.array((check >> np.uint64(32)).astype(np.uint32).view(np.int32)),
                        pa.array(ids[at:to][doc], pa.int64()),
                        pa.array(start - words.first[:-1][doc], pa.int32()),
                    ],
                    ["print", "check", "doc_id", "start"],
                )

    return run


def _cut(length: int):
    def run(batches):
        for batch in batches:
            ids, texts, starts = batch.column("doc_id"), batch.column("text"), batch.column("starts")
            removed, sha, spans, kept = [], [], [], []
            for i in range(batch.num_rows):
                words = (texts[i].as_py() or "").encode().split()
                at = np.sort(np.asarray(starts[i].values))
                cover = np.zeros(len(words) + 1, np.int64)
                np.add.at(cover, at, 1)
                np.add.at(cover, at + length, -1)
                gone = np.cumsum(cover)[:-1] > 0
                text = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g])
                first = np.concatenate([[True], at[1:] > at[:-1] + length])
                last = np.concatenate([first[1:], [True]])
                spans.append([[int(a), int(z)] for a, z in zip(at[first], at[last] + length, strict=True)])
                removed.append(int(gone.sum()))
                sha.append(hashlib.sha256(text).hexdigest())
                kept.append(text.decode())
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(removed, pa.int64()), pa.array(sha, pa.string()), pa.array(spans, pa.list_(pa.list_(pa.int32()))), pa.array(kept, pa.string())],
                ["doc_id", "n_removed", "kept_sha256", "spans", "kept_text"],
            )

    return run


def repeated_passages(docs: DataFrame, length: int = 50, k: int = 6) -> tuple[DataFrame, DataFrame]:
    """(all, cut). all: doc_id, n_words, n_removed, kept_sha256 for every document. cut: doc_id, n_removed,
    kept_sha256, spans (maximal repeats as word offsets), kept_text for those that lose a part of their words."""
    if length < k:
        raise ValueError(f"a window of {length} words holds no anchor of {k} words")
    docs = one_text(docs.select("doc_id", "text"))
    plain = stage(docs.mapInArrow(_anchors(length, k), "doc_id long, n_words long, sha string, gram array<long>, place array<int>"), "anchors")
    ids = plain.select("doc_id", "n_words", "sha").dropDuplicates(["doc_id"])
    first = stage(ids.groupBy("sha").agg(F.min("doc_id").alias("first_id")), "first")
    seeds = plain.join(first.select(F.col("first_id").alias("doc_id")), "doc_id", "left_semi").select("doc_id", F.explode(F.arrays_zip("gram", "place")).alias("x"))
    seeds = seeds.select("doc_id", F.col("x.gram").alias("gram"), F.col("x.place").alias("place"))
    again = stage(seeds.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram"), "again")
    places = stage(prefilter(seeds, "gram", again, 1 << 19).join(again, "gram").groupBy("doc_id").agg(F.collect_set("place").alias("places")), "places")
    prints = prefilter(docs, "doc_id", places).join(places, "doc_id").mapInArrow(_fingerprints(length, k), "print long, check int, doc_id long, start int")
    prints = stage(prints, "prints")
    earliest = prints.groupBy("print", "check").agg(F.min(F.struct("doc_id", "start")).alias("f"), F.count("*").alias("n")).where("n > 1")
    earliest = stage(earliest.select("print", "check", F.col("f.doc_id").alias("fd"), F.col("f.start").alias("fs")), "earliest")
    repeats = prefilter(prints, "print", earliest, 1 << 19).join(earliest, ["print", "check"]).where("doc_id <> fd or start <> fs")
    starts = stage(repeats.groupBy("doc_id").agg(F.collect_set("start").alias("starts")), "starts")
    cut = prefilter(docs, "doc_id", starts).join(starts, "doc_id").mapInArrow(_cut(length), "doc_id long, n_removed long, kept_sha256 string, spans array<array<int>>, kept_text string")
    cut = stage(cut, "cut")
    out = ids.join(first, "sha").join(cut.select("doc_id", "n_removed", "kept_sha256").dropDuplicates(["doc_id"]), "doc_id", "left")
    whole = (F.col("doc_id") != F.col("first_id")) & (F.col("n_words") >= length)
    out = out.select(
        "doc_id",
        "n_words",
        F.when(whole, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(whole, _EMPTY).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    )
    out = stage(out, "passages")
    drop_stage(plain, first, again, places, prints, earliest, starts)
    return out, cut


def op9_seed_extend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"), length=20)[0]
