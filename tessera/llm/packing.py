"""Harmonic packing of token sequences.

Capacity is divided by k = 1, 2, 3, ...: class k holds lengths of at most capacity / k, and its bins take exactly k
pieces. A bin never looks at lengths again, so classes fill independently and in parallel. A document longer than the
capacity gives full pieces first; its rest is cut where that saves padding, by a table over all rests that weighs
padding against ``cut_cost`` tokens for each further piece. From ``exact`` on, counts grow in steps of about 1/16.

Ranks within a class are running counts: a row number within (class, shard of doc_id), plus the counts of the shards
before, from a table of at most shards x classes rows. So each class has one unfinished bin in the whole table. The
pieces of unfinished bins, fewer than the sum of all k whatever the input, are packed first-fit by falling length.

Tokenising runs once in each task. Words recur, so a worker keeps token ids of the white-space separated strings it has
seen (at most ``CACHE``), as bytes, from task to task; new ones go to the tokenizer together. This equals encoding the text as a whole,
as the tokenizer's normaliser, splitter and special tokens do not look past white space. Where the tokenizer lower-cases and
cuts letters from all else, the new strings' letters go to its model alone (``_letters``). Pieces leave the worker as
(doc_id, start, length, crc32), so no ids are shuffled.

Nulls and empty texts are the end token alone. Rows without an id are packed like others; different texts under one id too. Repeated rows of one id are packed as further documents of that id,
told apart by ``copy``. Extra columns are ignored. An empty table gives no pieces.
"""

from __future__ import annotations

import json
import re
import zlib
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import stage, table

CACHE = 600_000
#: The steps before the model of a tokenizer that lower-cases, and cuts letters from all else; see _letters.
_LOWER_CASE = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_LETTERS_APART = [
    {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]
#: Letters of ASCII and Latin-1, which normal forms leave as they are, between marks that begin no contraction or special token.
_MARK = rb"[!-&(-/:;=>?@\[-`{-~]*"
_MARKED = re.compile(rb"(%s)((?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+)(%s)" % (_MARK, _MARK))
#: How ByteLevel writes those bytes of lower-case Latin-1 letters that it does not leave as they are.
_BYTE_LEVEL = tuple((chr(b), chr(256 + 33 + b - 127 if b < 161 else 256 + 33 + 34)) for b in (0x9F, 0xA0, 0xAD))


@cache
def class_counts(capacity: int, exact: int = 16) -> tuple[int, ...]:
    """Pieces in a bin, by class."""
    out, k = [], 1
    while k <= capacity:
        out.append(k)
        k += max(1, k // exact)
    return tuple(out)


@cache
def cut_table(capacity: int, cut_cost: int) -> tuple[np.ndarray, np.ndarray]:
    """For each rest r < capacity: length of its first piece (r: not cut), and the class of an uncut piece of that length."""
    counts = np.array(class_counts(capacity))
    slots = capacity // counts  # the longest piece of each class
    kind = np.array([int(np.flatnonzero(slots >= max(r, 1))[-1]) for r in range(capacity + 1)])
    waste = capacity / counts[kind] - np.arange(capacity + 1)
    cost, first = waste.copy(), np.arange(capacity + 1)
    for r in range(1, capacity + 1):
        at = slots[slots < r]
        if len(at):
            tries = cut_cost + waste[at] + cost[r - at]
            j = int(tries.argmin())
            if tries[j] < cost[r]:
                cost[r], first[r] = tries[j], at[j]
    return first, kind


def cuts(n: int, capacity: int, cut_cost: int) -> list[int]:
    first, _ = cut_table(capacity, cut_cost)
    out = [capacity] * (n // capacity)
    r = n % capacity
    while r:
        out.append(int(first[r]))
        r -= out[-1]
    return out


#: Token ids (as bytes) of strings that this worker process has met, by tokenizer; kept from task to task.
_KNOWN: dict[tuple[str, bool], dict[bytes, bytes]] = {}


@cache
def _letters(path: str):
    """The model alone of a tokenizer that lower-cases and cuts letters from all else, and which ids end a string; None for
    any other tokenizer. Without normaliser and splitter, letters take it about a third of the time."""
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, end = spec["model"], spec["model"].get("end_of_word_suffix")
    if not end or model["type"] != "BPE" or model.get("dropout") or (spec["normalizer"] or {}).get("normalizers") != _LOWER_CASE or (spec["pre_tokenizer"] or {}).get("pretokenizers") != _LETTERS_APART or any(t["content"][:1] != "<" for t in spec["added_tokens"]):
        return None
    ends = np.zeros(1 + max(model["vocab"].values()), bool)
    ends[[i for t, i in model["vocab"].items() if t.endswith(end)]] = True
    bare = {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "post_processor": None, "added_tokens": []}
    return Tokenizer.from_str(json.dumps(spec | bare)), ends


def _cut(words: list[bytes], ids: np.ndarray, ends: np.ndarray, skip: int) -> list[tuple[bytes, bytes]]:
    """Each of ``words`` with its ids: ``ends`` are the places after them, where ``skip`` ids stand between."""
    blob, ends = ids.tobytes(), (4 * ends).tolist()
    return [(w, blob[a:b]) for w, a, b in zip(words, [0, *[e + 4 * skip for e in ends[:-1]]], ends, strict=True)]


def _encode_letters(light, words: list[bytes]) -> dict[bytes, bytes]:
    """Token ids of strings of letters (``_MARKED``), by the model alone."""
    tok, last = light
    out: dict[bytes, bytes] = {}
    for i in range(0, len(words), 1000):
        part = words[i : i + 1000]
        text = b" ".join(part).decode().lower().encode().decode("latin-1")
        for byte, mapped in _BYTE_LEVEL:
            text = text.replace(byte, mapped)
        ids = np.array(tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        out.update(_cut(part, ids, np.flatnonzero(last[ids]) + 1, 0))
    return out


def _encode(tok, light, words: list[bytes], special_as_text: bool, known: dict[bytes, bytes]) -> dict[bytes, bytes]:
    """Token ids of each string. Strings are encoded together with a special token between them, which cuts the text
    before it is normalised and split, so each is encoded as if alone. With ``light`` (of ``_letters``) letters go to the
    model alone, and marks before and after them have their own ids, as the splitter cuts between them."""
    out: dict[bytes, bytes] = {}
    whole: list[tuple[bytes, bytes, bytes, bytes]] = []
    if light:
        found = [m.group(0, 1, 2, 3) if m else None for m in map(_MARKED.fullmatch, words)]
        whole = [m for m in found if m]
        words = list({w for w, m in zip(words, found, strict=True) if not m}.union([m[1] for m in whole], [m[3] for m in whole]) - {b""})
        letters = {m[2] for m in whole}
        out = {w: known[w] for w in letters if w in known}
        out.update(_encode_letters(light, list(letters.difference(out))))
    specials = {} if special_as_text else {t.content: i for i, t in tok.get_added_tokens_decoder().items() if t.special}
    if specials:
        mark, mark_id = next(iter(specials.items()))
        plain = [w for w in words if b"<" not in w]
        for i in range(0, len(plain), 200):
            part = plain[i : i + 200]
            ids = np.array(tok.encode_batch_fast([mark.join([w.decode() for w in part])], add_special_tokens=False)[0].ids, "<u4")
            out.update(_cut(part, ids, np.append(np.flatnonzero(ids == mark_id), len(ids)), 1))
        words = [w for w in words if b"<" in w]
    for i in range(0, len(words), 5_000):
        part = words[i : i + 5_000]
        for w, x in zip(part, tok.encode_batch_fast([w.decode() for w in part], add_special_tokens=False), strict=True):
            out[w] = np.array(x.ids, "<u4").tobytes()
    none = {b"": b""}
    out.update([(w, none.get(a, out.get(a)) + out[m] + none.get(z, out.get(z))) for w, a, m, z in whole if a or z])
    return out


def _lower(text: bytes) -> bytes:
    """``text`` with A-Z lower-cased, unless special tokens or accents that follow a letter (U+0300 to U+037F) may be in it;
    some of those join only a small letter."""
    return text if b"<" in text or b"\xcc" in text or b"\xcd" in text else text.lower()


def _pieces(path: str, end_id: int, capacity: int, cut_cost: int, special_as_text: bool):
    def run(batches):
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.encode_special_tokens = special_as_text
        light = _letters(path)
        known = _KNOWN.setdefault((path, special_as_text), {})
        _, kind = cut_table(capacity, cut_cost)
        end = end_id.to_bytes(4, "little")
        for batch in batches:
            texts = [b"" if t is None else t.encode() for t in batch.column("text").to_pylist()]
            ids = batch.column("doc_id").to_pylist()
            rows: list[list] = [[], [], [], [], [], []]
            at = 0
            while at < len(texts):
                to, size = at, 0
                while to < len(texts) and (to == at or size + len(texts[to]) < 1 << 22):
                    size += len(texts[to])
                    to += 1
                words = [(_lower(t) if light else t).split() for t in texts[at:to]]
                flat = list(chain.from_iterable(words))
                found = list(map(known.get, flat))
                gaps = [i for i, x in enumerate(found) if x is None]
                if gaps:
                    new = _encode(tok, light, list({flat[i] for i in gaps}), special_as_text, known)
                    for i in gaps:
                        found[i] = new[flat[i]]
                    if len(known) + len(new) <= CACHE:  # what was met first is most of what comes again
                        known.update(new)
                first = 0
                for doc, ws in zip(ids[at:to], words, strict=True):
                    blob = b"".join(found[first : first + len(ws)]) + end
                    first += len(ws)
                    n, start = len(blob) // 4, 0
                    for length in cuts(n, capacity, cut_cost):
                        for r, v in zip(rows, (doc, start, length, zlib.crc32(blob[4 * start : 4 * (start + length)]), n, int(kind[length])), strict=True):
                            r.append(v)
                        start += length
                at = to
            yield pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(rows, _PIECE_TYPES, strict=True)], _PIECE_NAMES)

    return run


_PIECE_NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "class"]
_PIECE_TYPES = [pa.int64()] * 5 + [pa.int32()]
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, class int"


def _first_fit(capacity: int):
    """Bins of the few pieces that fill no bin of their class: first-fit by falling length."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("copy", "ascending")])
        room: list[int] = []
        bins = []
        for n in rows.column("length").to_pylist():
            b = next((b for b, r in enumerate(room) if r >= n), len(room))
            if b == len(room):
                room.append(capacity)
            room[b] -= n
            bins.append(b)
        return rows.append_column("bin", pa.array(bins, pa.int64()))

    return run


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = 4096, cut_cost: int = 16, shards: int = 256, special_as_text: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, copy, class_count (0: mixed) for each piece."""
    docs = docs.select("doc_id", "text")
    pieces = docs.mapInArrow(_pieces(tokenizer, end_id, capacity, cut_cost, special_as_text), _PIECES)
    pieces = stage(pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "start"), F.lit(shards)).cast("int")), "pieces")
    order = Window.partitionBy("class", "shard").orderBy("doc_id", "start", "ids_crc32")
    ranked = pieces.withColumn("rank", F.row_number().over(order) - 1).withColumn("copy", F.row_number().over(order.partitionBy("class", "shard", "doc_id", "start").orderBy("ids_crc32")) - 1)
    counts = class_counts(capacity)
    k = F.get(F.array(*[F.lit(c) for c in counts]), F.col("class"))
    sizes = stage(pieces.groupBy("class", "shard").agg(F.count("*").alias("n")), "sizes")  # at most shards x classes rows
    before = sizes.select("class", "shard", (F.sum("n").over(Window.partitionBy("class").orderBy("shard")) - F.col("n")).alias("before"))
    whole = sizes.groupBy("class").agg(F.sum("n").alias("total")).withColumn("full", F.expr(f"total div element_at(array({','.join(map(str, counts))}), class + 1)"))
    whole = whole.withColumn("base", F.sum("full").over(Window.orderBy("class")) - F.col("full"))  # a row for each class
    known = before.join(whole, "class")
    x = ranked.join(F.broadcast(known), ["class", "shard"]).withColumn("place", F.col("before") + F.col("rank")).withColumn("k", k.cast("long"))
    x = stage(x.withColumn("bin", F.expr("place div k")), "placed")
    keep = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "copy"]
    full = x.where("bin < full").select(*keep, (F.col("base") + F.col("bin")).alias("sequence_id"), "k")
    after = whole.agg(F.coalesce(F.sum("full"), F.lit(0)).alias("n"))
    schema = T.StructType([*x.select(*keep).schema.fields, T.StructField("bin", T.LongType())])
    rest = x.where("bin >= full").select(*keep).groupBy().applyInArrow(_first_fit(capacity), schema)
    rest = rest.withColumn("sequence_id", F.col("bin") + after.scalar()).select(*keep, "sequence_id", F.lit(0).cast("long").alias("k"))
    rows = full.union(rest)
    inside = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "doc_id", "start", "copy")
    out = rows.withColumn("offset", F.sum("length").over(inside) - F.col("length")).select(*keep[:5], "sequence_id", "offset", "copy", F.col("k").alias("class_count"))
    out = stage(out, "packed")
    return out


def public_tokenizer(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op6_harmonic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizer())
