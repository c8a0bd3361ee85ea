"""Media columns with content-defined chunking: gear-hash cuts, deduplicated chunks, verified reconstruction.

A text becomes a payload (UTF-8, padded with spaces to a positive multiple of 192) inside an 8-bit mono PCM WAV file.
A rolling gear hash over the last 32 bytes cuts the file into chunks of 256 to 4096 bytes, on average about 1 KiB, so
equal passages give equal chunks wherever they stand. Chunks are named by their SHA-256. A join on digests gives every
chunk one owner, the smallest (doc_id, position) that has it, and only owners' bytes are stored. A media row is read
back by joining its ordered chunk list with the stored chunks; the result is verified against the digest of the file.

Scale. Cutting reads each text in its row; the digests that are shuffled are a few percent of the text. Equal files are
found first, by their digests, and stored and rebuilt once. Every file is stored in chunks and rebuilt by its ordered chunk
list. The distinct chunks of a file that shares none with a different file are laid out in one row with that list (a pack),
so they are joined without a shuffle; a Bloom filter of fixed size separates these files, so only texts of copies, of
repeated rows and of files that share chunks are shuffled, once, to the lists of what others own. A chunk that very many lists name is one row in the store; Spark splits that join's other side.

Nulls and empty texts are 192 spaces. Repeated rows (one id, one text) are stored once.
Rows without an id are left out; of different texts under one id the one with the smallest hash counts. Extra columns are ignored. An empty table
gives an empty store.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_stage, marked, mix, one_text, prefilter, stage, table
from .native import let

UNIT, RATE = 192, 8000
#: Compression level of the stored chunks.
STORE_LEVEL = 12
SMALLEST, LARGEST, MASK = 256, 4096, np.uint32(0xFF800000)
_GEAR = (mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(32)).astype(np.uint32)


def wav(payload: bytes) -> bytes:
    """An 8-bit mono PCM file whose samples are the payload."""
    n = len(payload)
    return b"RIFF" + struct.pack("<I", 36 + n) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8) + b"data" + struct.pack("<I", n) + payload


def samples(media: bytes) -> bytes:
    """The payload of such a file; checks what the header says."""
    head = struct.unpack("<4sI8sIHHIIHH4sI", media[:44])
    if head[0] != b"RIFF" or head[2] != b"WAVEfmt " or head[10] != b"data" or head[11] != len(media) - 44 or head[9] != 8:
        raise ValueError("not an 8-bit PCM file")
    return media[44:]


def media_of(text: str | None) -> bytes:
    raw = (text or "").encode()
    return wav(raw + b" " * (-len(raw) % UNIT if raw else UNIT))


def chunk_name(chunk: bytes) -> bytes:
    """The first 128 bits of a chunk's SHA-256. Whole files are named by all 256 and checked against them."""
    return hashlib.sha256(chunk).digest()[:16]


def gear(data: np.ndarray) -> np.ndarray:
    """Gear hash of the 32 bytes that end at each byte: h = (h << 1) + table[byte], by doubling the window."""
    h = _GEAR[data]
    for shift in (1, 2, 4, 8, 16):
        more = h.copy()
        more[shift:] += h[:-shift] << np.uint32(shift)
        h = more
    return h


def cut_points(media: bytes, candidates: np.ndarray) -> list[int]:
    """Ends of the chunks; candidates are ascending offsets after bytes where the hash is 0 under the mask."""
    out, at, n = [], 0, len(media)
    while n - at > SMALLEST:
        i = int(np.searchsorted(candidates, at + SMALLEST))
        end = int(candidates[i]) if i < len(candidates) else n
        end = min(end, at + LARGEST, n)
        if end == n:
            break
        out.append(end)
        at = end
    return [*out, n]


def chunked(texts: list[str | None]):
    """(media, chunk ends) of each text; hashes are taken over all at once."""
    files = [media_of(t) for t in texts]
    at = np.concatenate([[0], np.cumsum([len(f) for f in files])])
    hits = np.flatnonzero((gear(np.frombuffer(b"".join(files), np.uint8)) & MASK) == 0) + 1
    lo, hi = np.searchsorted(hits, at[:-1], "right"), np.searchsorted(hits, at[1:], "right")
    for f, a, x, y in zip(files, at[:-1], lo, hi, strict=True):
        yield f, cut_points(f, hits[x:y] - a)


def _parts(texts: list, most: int = 1 << 20):
    part, size, at = [], 0, 0
    for t in texts:
        part.append(t)
        size += len(t or "")
        if size > most:
            yield at, part
            at, part, size = at + len(part), [], 0
    if part:
        yield at, part


def _digests(batches):
    """doc_id, media (digest of the file), n_bytes, and the digests of its chunks in order."""
    for batch in batches:
        ids = batch.column("doc_id")
        for at, texts in _parts(batch.column("text").to_pylist()):
            media, size, names = [], [], []
            for t, (f, ends) in zip(texts, chunked(texts), strict=True):
                media.append(hashlib.sha256(f).digest())
                size.append(len((t or "").encode()))
                names.append([chunk_name(f[a:z]) for a, z in zip([0, *ends], ends, strict=False)])
            yield pa.RecordBatch.from_arrays([ids.slice(at, len(texts)), pa.array(media, pa.binary()), pa.array(size, pa.int64()), pa.array(names, pa.list_(pa.binary()))], ["doc_id", "media", "n_bytes", "chunks"])


def _packed(batches):
    """digest (of the file), chunks (digests in order), bytes (of its distinct chunks, by first place) of each text."""
    for batch in batches:
        names, lists, data = [], [], []
        for _, texts in _parts(batch.column("text").to_pylist()):
            for f, ends in chunked(texts):
                pieces = [f[a:z] for a, z in zip([0, *ends], ends, strict=False)]
                each = [chunk_name(x) for x in pieces]
                names.append(hashlib.sha256(f).digest())
                lists.append(each)
                data.append(list(dict(zip(each, pieces, strict=True)).values()))
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(lists, pa.list_(pa.binary())), pa.array(data, pa.list_(pa.binary()))], ["digest", "chunks", "bytes"])


def _stored(batches):
    """digest, bytes: the chunks of each text except those ``lent`` by other files."""
    for batch in batches:
        names, data = [], []
        lent = batch.column("lent").to_pylist()
        for at, texts in _parts(batch.column("text").to_pylist()):
            for skip, (f, ends) in zip(lent[at : at + len(texts)], chunked(texts), strict=True):
                skip, own = set(skip), set()
                for i, (a, z) in enumerate(zip([0, *ends], ends, strict=False)):
                    if i not in skip and (name := chunk_name(f[a:z])) not in own:
                        own.add(name)
                        names.append(name)
                        data.append(f[a:z])
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(data, pa.binary())], ["digest", "bytes"])


def _features(batches):
    """Verify files read back and describe them. Input: media (digest), parts (bytes in order)."""
    for batch in batches:
        rows: list[list] = [[] for _ in range(7)]
        for name, parts in zip(batch.column("media").to_pylist(), batch.column("parts").to_pylist(), strict=True):
            media = b"".join(parts)
            if hashlib.sha256(media).digest() != name:
                raise ValueError(f"media {name.hex()} does not read back")
            payload = samples(media)
            x = np.frombuffer(payload, np.uint8)
            count = np.bincount(x, minlength=256)
            p = count[count > 0] / len(x)
            crossing = int((np.diff((x >= 128).astype(np.int8)) != 0).sum())
            feature = f"pcm8;mean={x.mean():.6f};rms={np.sqrt(np.mean(x.astype(np.float64) ** 2)):.6f};entropy={-(p * np.log2(p)).sum():.6f};crossings={crossing};min={x.min()};max={x.max()}"
            for r, v in zip(rows, (name, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature), strict=True):
                r.append(v)
        kinds = (pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(rows, kinds, strict=True)], ["media", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])


_FEATURES = "media binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def store_media(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(index, packs, chunks). index: doc_id, media, n_bytes, chunks (digests in order), alone. packs: digest of a file,
    chunks, bytes of each distinct one; chunks: digest, bytes. A file that is ``alone`` (no chunk shared) is a pack, or in
    ``chunks`` if the filter took it for another; others are in ``chunks``."""
    docs = one_text(docs.select("doc_id", "text"))
    named = stage(docs.mapInArrow(_digests, "doc_id long, media binary, n_bytes long, chunks array<binary>"), "digests")
    files = stage(named.groupBy("media").agg(F.min("doc_id").alias("doc_id"), F.first("chunks").alias("chunks")), "files")
    each = files.select("doc_id", F.posexplode("chunks").alias("pos", "digest"))
    owners = each.groupBy("digest").agg(F.min(F.struct("doc_id", "pos")).alias("o"), F.max("doc_id").alias("last")).select("digest", "last", "o.*")
    shared = stage(owners.where("doc_id < last"), "shared")
    uses = stage(prefilter(each, "digest", shared, 1 << 19).join(shared.select("digest", F.col("doc_id").alias("owner"), F.col("pos").alias("at")), "digest").select("doc_id", "pos", ((F.col("doc_id") == F.col("owner")) & (F.col("pos") == F.col("at"))).alias("own")), "uses")
    sharing = uses.groupBy("doc_id").agg(F.collect_set(F.when(~F.col("own"), F.col("pos"))).alias("lent"))
    copies = named.join(files.select("doc_id"), "doc_id", "left_anti").select("doc_id", F.lit(None).cast("array<int>").alias("lent")).distinct()
    special = sharing.union(copies)
    again = named.groupBy("doc_id").agg(F.count("*").alias("_n")).where("_n > 1").select("doc_id").join(special.select("doc_id"), "doc_id", "left_anti")
    special = stage(special.union(again.select("doc_id", F.array().cast("array<int>"))), "special")
    mixed = files.join(sharing.select("doc_id"), "doc_id", "left_semi").select("media", F.lit(True).alias("_s"))
    index = stage(named.join(mixed, "media", "left").withColumn("alone", F.col("_s").isNull()).drop("_s"), "index")
    drop_stage(named, files, shared, uses)  # before chunks are written
    split = marked(docs, "doc_id", special, "_maybe", 1 << 19)
    none = F.array().cast("array<int>")
    some = split.where("_maybe").join(special.withColumn("_s", F.lit(1)), "doc_id", "left").dropDuplicates(["doc_id"]).select("text", F.when(F.col("_s").isNull(), 0).when(F.col("lent").isNull(), 1).otherwise(2).alias("part"), F.coalesce("lent", none).alias("lent"))
    most = split.where("not _maybe").select("text")
    packs = stage(most.mapInArrow(_packed, "digest binary, chunks array<binary>, bytes array<binary>"), "packs", STORE_LEVEL)
    stored = stage(some.where("part <> 1").select("text", "lent").mapInArrow(_stored, "digest binary, bytes binary"), "chunks", STORE_LEVEL)
    drop_stage(special)
    return index, packs, stored


def read_media(index: DataFrame, packs: DataFrame, chunks: DataFrame) -> DataFrame:
    """media, parts (bytes in order) of every distinct file, by its chunk list from the stored chunks."""
    lists = index.join(packs.select(F.col("digest").alias("media")), "media", "left_anti").groupBy("media").agg(F.first("chunks").alias("chunks"))
    wanted = lists.select("media", F.posexplode("chunks").alias("pos", "digest"))
    bytes_of = chunks.join(wanted.select("digest").distinct(), "digest", "left_semi")
    rebuilt = wanted.join(bytes_of, "digest").groupBy("media").agg(F.sort_array(F.collect_set(F.struct("pos", "bytes"))).alias("x"))
    rebuilt = rebuilt.select("media", F.transform("x", lambda p: p["bytes"]).alias("parts"))
    place = lambda names, c: (F.array_position(names, c) - 1).cast("int")
    local = let(F.array_distinct("chunks"), lambda names: F.transform("chunks", lambda c: F.get("bytes", place(names, c))))
    return packs.select(F.col("digest").alias("media"), local.alias("parts")).union(rebuilt)


def media_features(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, n_chunks, alone."""
    index, packs, chunks = store_media(docs)
    features = stage(read_media(index, packs, chunks).mapInArrow(_features, _FEATURES).dropDuplicates(["media"]), "features")
    out = index.dropDuplicates(["doc_id"]).join(features, "media")
    out = stage(out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", F.size("chunks").cast("long").alias("n_chunks"), "alone"), "media")
    return out


def op2_gear_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_features(table(spark, sf_dir, "documents"))
