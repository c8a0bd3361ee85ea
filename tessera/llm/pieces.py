"""Encoding and decoding with merge-type subword vocabularies, by a score-ordered agenda.

A text's symbols are first its characters. The agenda holds the adjacent symbol pairs whose concatenation is a piece, the
best score first and, among equals, the leftmost. The best pair becomes one symbol, which forms new pairs with its two
neighbours. What is left is looked up, and characters outside the vocabulary become their UTF-8 bytes' pieces. For long
parts the agenda is a heap; for those of at most ``SCANNED`` characters a list that is scanned, which is faster there.

No merge crosses a place that no piece spans, so a text is cut there and each part has its own agenda: between a blank
and what comes before it, between a letter and a mark that follows no letter in any piece, and around characters that
occur in no piece of two or more characters. The cuts come from the vocabulary itself; one with pieces that span a blank
from its left is not cut at blanks. Parts recur, and so do the words between single blanks, so a worker keeps the ids of
those it has met (at most ``CACHE`` of each, short ones), from task to task. This is a store of results: any part outside
it gets an agenda of its own.

Every batch is also encoded by the sentencepiece library, and ``agrees`` tells for each row whether all ids are equal.
Decoding is the library's.

Nulls and empty texts have the end id alone. Rows without an id and repeated rows stay as they are, extra columns are
ignored, an empty table gives an empty result.
"""

from __future__ import annotations

import re
from array import array
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lists, stage, table

CACHE = 2_000_000
#: Longer parts are not kept.
CACHED_LENGTH = 64
SCANNED = 24
#: What a normaliser would change: blanks at the ends and doubled, an accent, a ligature.
_PROBE = " a  Bé ﬁ "
BLANK = "▁"


def _class(chars: set[str]) -> str:
    """A character class, with ranges of neighbouring code points."""
    points = set(map(ord, chars))
    starts, ends = sorted(p for p in points if p - 1 not in points), sorted(p for p in points if p + 1 not in points)
    return "[" + "".join(re.escape(chr(a)) if a == b else f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in zip(starts, ends, strict=True)) + "]"


class Vocabulary:
    """Scores and ids of a merge-type vocabulary with byte pieces, read through the library."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        scores: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        self.bytes = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if not all(sp.is_byte(i) for i in self.bytes):
            raise ValueError("the vocabulary has no byte pieces")
        for i in range(sp.get_piece_size()):
            if sp.is_unused(i):
                raise ValueError("vocabularies with unused pieces are not supported")
            if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)):
                self.ids[sp.id_to_piece(i)] = i
                scores[sp.id_to_piece(i)] = sp.get_score(i)
        if sp.decode(sp.encode(_PROBE)) != _PROBE:
            raise ValueError("vocabularies that normalise texts are not supported")
        self.end = array("i", [sp.eos_id()]).tobytes()
        order = {score: r for r, score in enumerate(sorted(set(scores.values()), reverse=True))}
        self.ranks = {p: order[score] for p, score in scores.items()}  # equal scores, equal ranks
        long = [p for p in self.ids if len(p) > 1]
        pairs = {(p[i], p[i + 1]) for p in long for i in range(len(p) - 1)}
        inner = {c for pair in pairs for c in pair} - {BLANK}
        letters = {c for c in inner if c.isalpha()}
        apart = {b for b in inner - letters if not any((a, b) in pairs for a in letters)}
        blank = f"[ {BLANK}]"  # both are the same symbol
        self.cut_at_blanks = not any(b == BLANK and a != BLANK for a, b in pairs)
        if not self.cut_at_blanks:
            pattern = f"{_class(inner | {BLANK, ' '})}++"
        else:
            pattern = f"{blank}*+{_class(letters)}++(?!{_class(inner - apart)})|{blank}*+{_class(inner)}++|{blank}++"
        self.part = re.compile(f"{pattern}|.", re.DOTALL)

    def parts(self, text: str) -> list[str]:
        return self.part.findall(" " + text) if text else []

    def agenda(self, part: str) -> tuple[int, ...]:
        """Ids of a part: its best adjacent pair, the leftmost of equals, is merged until none is a piece."""
        part = part.replace(" ", BLANK)
        symbols = self.scanned(part) if len(part) <= SCANNED else self.heaped(part)
        out: list[int] = []
        for symbol in symbols:
            piece = self.ids.get(symbol)
            if piece is not None:
                out.append(piece)
            else:
                out += [self.bytes[b] for b in symbol.encode()]
        return tuple(out)

    def scanned(self, part: str) -> list[str]:
        """The agenda of a short part is a list in the order of the pairs; the best one is looked up in it."""
        symbols, rank, none = list(part), self.ranks.get, len(self.ranks)
        agenda = [rank(a + b, none) for a, b in zip(symbols, symbols[1:], strict=False)]
        while agenda and (best := min(agenda)) < none:
            i = agenda.index(best)
            symbols[i] += symbols.pop(i + 1)
            del agenda[i]
            if i < len(agenda):
                agenda[i] = rank(symbols[i] + symbols[i + 1], none)
            if i:
                agenda[i - 1] = rank(symbols[i - 1] + symbols[i], none)
        return symbols

    def heaped(self, part: str) -> list[str]:
        """The agenda is a heap. An entry is one number: rank of the merged piece, then place of its first symbol, then its
        end; entries whose symbols have changed meanwhile are passed over."""
        n, rank = len(part), self.ranks.get
        bits = n.bit_length()
        low = (1 << bits) - 1
        end = list(range(1, n + 1))  # symbol at i is part[i:end[i]]; 0: merged into the one before
        before = list(range(-1, n))
        heap = [(r << bits | i) << bits | i + 2 for i in range(n - 1) if (r := rank(part[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            entry = heappop(heap)
            to, i = entry & low, entry >> bits & low
            j = end[i]
            if not j or j >= n or end[j] != to:
                continue
            end[i], end[j] = to, 0
            if to < n:
                before[to] = i
                if (r := rank(part[i : end[to]])) is not None:
                    heappush(heap, (r << bits | i) << bits | end[to])
            if i and (r := rank(part[before[i] : to])) is not None:
                heappush(heap, (r << bits | before[i]) << bits | to)
        return [part[i:j] for i, j in enumerate(end) if j]


class Store:
    """Ids, as bytes, of the parts and of the words (with a blank before them) that a worker has met."""

    def __init__(self) -> None:
        self.parts: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}


#: Vocabularies, and what this worker process has met.
_LOADED: dict[str, Vocabulary] = {}
_KNOWN: dict[str, Store] = {}


def vocabulary(path: str) -> Vocabulary:
    if path not in _LOADED:
        _LOADED[path] = Vocabulary(path)
    return _LOADED[path]


def _of_parts(parts: list[str], v: Vocabulary, known: dict[str, bytes]) -> bytes:
    found = list(map(known.get, parts))
    for at in [at for at, ids in enumerate(found) if ids is None]:
        found[at] = array("i", v.agenda(parts[at])).tobytes()
        if len(parts[at]) <= CACHED_LENGTH and len(known) < CACHE:
            known[parts[at]] = found[at]
    return b"".join(found)


def packed(text: str, v: Vocabulary, store: Store) -> bytes:
    """The ids of a text, its end id included, as 32-bit numbers."""
    words = text.split(" ")
    if "" in words or BLANK in text or not v.cut_at_blanks:
        return _of_parts(v.parts(text), v, store.parts) + v.end
    found = list(map(store.words.get, words))  # one blank before each word
    try:
        return b"".join(found) + v.end
    except TypeError:  # some words have not been met
        for at in [at for at, ids in enumerate(found) if ids is None]:
            found[at] = _of_parts(v.parts(words[at]), v, store.parts)
            if len(words[at]) <= CACHED_LENGTH and len(store.words) < CACHE:
                store.words[words[at]] = found[at]
        return b"".join(found) + v.end


def ids_of(text: str, v: Vocabulary, store: Store) -> list[int]:
    return array("i", packed(text, v, store)).tolist()


def _encoded(path: str, most: int = 1 << 22):
    def run(batches):
        v, store = vocabulary(path), _KNOWN.setdefault(path, Store())
        decode = v.library.DecodeIds
        for batch in batches:
            texts = ["" if t is None else t for t in batch.column("text").to_pylist()]
            at = 0
            while at < len(texts):  # about ``most`` characters at a time
                to, size = at, 0
                while to < len(texts) and (to == at or size + len(texts[to]) < most):
                    size += len(texts[to])
                    to += 1
                ids = [packed(t, v, store) for t in texts[at:to]]
                theirs = v.library.encode(texts[at:to], add_eos=True, num_threads=1)
                agrees = [a == array("i", b).tobytes() for a, b in zip(ids, theirs, strict=True)]
                decoded = [decode(b if ok else array("i", a).tolist()) for a, b, ok in zip(ids, theirs, agrees, strict=True)]
                first = np.cumsum([0, *map(len, ids)]) // 4
                columns = [batch.column("doc_id").slice(at, to - at), lists(np.frombuffer(b"".join(ids), np.int32), first, pa.int32()), pa.array(decoded, pa.string()), pa.array(agrees, pa.bool_())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "decoded", "agrees"])
                at = to

    return run


def encode(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, ids (with the end id), decoded, agrees (with the library) for each row."""
    return docs.select("doc_id", "text").mapInArrow(_encoded(model), "doc_id long, ids array<int>, decoded string, agrees boolean")


def op12_agenda(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    x = encode(table(spark, sf_dir, "documents"), str(public_tokenizers.path("piece_bpe_32k.model")))
    digests = x.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"), "agrees",
    )
    return stage(digests, "pieces")
