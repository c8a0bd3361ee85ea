"""LM scoring by a subword lattice: the marginal probability of a document over all segmentations.

A document is its words, each with a word end, and one document end. A word is spelled by a lattice of arcs:

* pieces of an existing subword vocabulary (word-initial pieces, then continuing ones, then a stop); characters that no
  piece holds are spelled by byte pieces;
* one arc for a whole word that the training texts have.

A forward recursion over positions sums all paths, for all words of one length at once (in log space where words are very long or improbable). The pieces' weights come from the scores of the existing
vocabulary. This file's scores are negative ranks, not logarithms, so a score s weighs 1 / (10 - s), as frequencies fall
with rank. What pieces have to spell is words that training texts lack, so their weights are adapted to how the words that
they have would be spelled: expectation steps over the distinct training words, the last over all of them alike (those
before it, over a few sixteenths, only choose where it starts), with the scores' weights as ``prior_count``
pseudo-counts. The whole-word arc has weight (c - D) / N, and the D * V / N that this leaves over all words weighs the piece
arcs (absolute discounting, D = n1 / (n1 + 2 n2) from words seen once and twice). All weights sum to at most 1, so scores are log probabilities.

Words recur within a document. The words of a document are drawn from a Dirichlet-multinomial (Polya urn) that has the
lattice as its base: the i-th word has probability (a * lattice + earlier occurrences in the document) / (a + i), with
a = ``concentration``. The product does not depend on the order of words, so counts of each word are enough; a very large
``concentration`` gives the lattice alone.

Documents are of classes (languages, where ``group`` names that column): a latent class is drawn first, and each class has
its own word counts, smoothed with the common lattice by ``reserve`` times its number of words as pseudo-counts. The score
sums over classes, so it does not look at the class of the document that it scores. The classes are the
``CLASSES`` - 1 values with the most training documents and one for all others and nulls.

Scale. Word counts are partial sums in each task, then one aggregate; the lattice runs once for each distinct word, not
for each occurrence. The most frequent words, at most ``frequent``, are looked up in a broadcast table; for the
others, (doc_id, word, count) rows are joined with the word table by a shuffle. Expected counts of pieces are summed in
each task and are at most a row for each piece and task.

Nulls and empty texts are a document end alone. Repeated rows of one id are scored once, and counted as often as they
occur; of different texts under one id the one with the smallest hash is scored, all are counted. Rows without an id
belong to neither side and are left out. Extra columns are ignored. An empty table gives no rows; without training texts every known count is 0 and the
prior spells all words.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable
from functools import cache
from itertools import compress, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_stage, lists, mix, one_text, stage, table
from .native import let

#: The document end in word tables; white space is never part of a word.
END = "\n"
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
LN10 = math.log(10.0)
CLASSES = 8
#: Sixteenths of the distinct words in each expectation step; the last step takes all.
STEPS = ((0, 0), (1, 2), (0, 15))
#: Words of up to so many characters are spelled many at once, with probabilities times e ** (SCALE * length); one with a
#: total under ``LEAST`` is spelled again in log space.
LONGEST, SCALE, LEAST = 64, 3.0, 1e-200
#: Words that are spelled at once.
MANY = 20_000
_BASE = np.uint64(0x9E3779B97F4A7C15)


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 7 == 2


# ---------------------------------------------------------------- vocabulary


def _prefixed(weights: dict[str, float], more: float) -> dict[str, float | None]:
    """The weights plus ``more``, and None for proper prefixes of pieces that are no pieces: a walk stops where both end."""
    out: dict[str, float | None] = {}
    for p in weights:
        for j in range(1, len(p)):
            out.setdefault(p[:j], None)
    out.update({p: w + more for p, w in weights.items()})
    return out


def _log_sum(terms: list[float]) -> float:
    if len(terms) == 1:
        return terms[0]
    top = max(terms)
    return top + math.log(sum([math.exp(t - top) for t in terms]))


class Arcs:
    """The pieces of a table by 64-bit hashes of their characters, to look up many substrings at once."""

    def __init__(self, table: dict[str, float | None]):
        names = [p for p, w in table.items() if w is not None]
        keys = np.zeros(len(names), np.uint64)
        for n, at in _by_length(names).items():
            for c in _characters([names[i] for i in at], n).T:
                keys[at] = keys[at] * _BASE + c
        order = np.argsort(keys)
        self.keys, self.names = keys[order], [names[i] for i in order]
        self.weights = np.append(np.exp(np.array([table[n] for n in self.names]) + [SCALE * len(n) for n in self.names]), 0.0)
        self.longest = max(map(len, names))
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self.keys >> np.uint64(44)] = True

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Index of the piece with each hash, -1 for none (the last weight, which is 0)."""
        out = np.full(hashes.shape, -1, np.int64)
        at = np.nonzero(self.maybe[hashes >> np.uint64(44)])
        some = hashes[at]
        found = np.minimum(np.searchsorted(self.keys, some), len(self.keys) - 1)
        out[at] = np.where(self.keys[found] == some, found, -1)
        return out


def _by_length(words: list[str]) -> dict[int, np.ndarray]:
    """Places of the words of each length."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(sizes, kind="stable")
    kinds, first = np.unique(sizes[order], return_index=True)
    return dict(zip(kinds.tolist(), np.split(order, first[1:]), strict=True)) if len(words) else {}


def _characters(words: list[str], n: int) -> np.ndarray:
    """(word, position) of mixed code points; all words have length ``n``."""
    return mix(_codes(words, n).astype(np.uint64) + np.uint64(1))


def _codes(words: list[str], n: int) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), n)


class Pieces:
    """Log weights of word-initial (``head``) and continuing (``tail``) pieces; bytes are the last 256 ids of each."""

    def __init__(self, heads: list[str], tails: list[str], head: np.ndarray, tail: np.ndarray, stop: float):
        self.heads, self.tails = heads, tails
        self.head, self.tail = dict(zip(heads, head.tolist(), strict=True)), dict(zip(tails, tail.tolist(), strict=True))
        self.stop, self.go = math.log(stop), math.log1p(-stop)
        self.first, self.next = _prefixed(self.head, 0.0), _prefixed(self.tail, self.go)
        self.arcs: tuple[Arcs, Arcs] | None = None  # built where they are used

    def spelled_byte(self, c: str, first: bool) -> float:
        """Log weight of a character that no piece holds, by its bytes."""
        keys = [f"<{b:02X}>" for b in c.encode()]
        return (self.head[keys[0]] if first else self.tail[keys[0]] + self.go) + sum(self.tail[k] + self.go for k in keys[1:])

    def log_probability(self, word: str) -> float:
        """Log-space forward recursion over the positions of a word."""
        n = len(word)
        terms: list[list[float]] = [[] for _ in range(n + 1)]
        table, at, missing = self.first, 0.0, -1.0
        for i in range(n):
            if i:
                if not terms[i]:
                    continue
                at, table = _log_sum(terms[i]), self.next
            for j in range(i + 1, n + 1):
                w = table.get(word[i:j], missing)
                if w is missing:
                    break
                if w is not None:
                    terms[j].append(at + w)
            if table.get(word[i]) is None:
                terms[i + 1].append(at + self.spelled_byte(word[i], i == 0))
        return _log_sum(terms[n]) + self.stop

    def _lattice(self, words: list[str], n: int):
        """Arcs of words of length ``n``, for each length l: index of the piece and weight (times e ** (SCALE * l)) by word
        and position; and where a character is spelled by its bytes."""
        if self.arcs is None:
            self.arcs = Arcs(self.first), Arcs(self.next)
        head, tail = self.arcs
        chars, codes = _characters(words, n), _codes(words, n)
        hashes, found, weights, spelled = np.zeros_like(chars), [], [], None
        for size in range(1, min(n, max(head.longest, tail.longest)) + 1):
            hashes = hashes[:, : n - size + 1] * _BASE + chars[:, size - 1 :]
            ids = np.concatenate([head.find(hashes[:, :1]), tail.find(hashes[:, 1:])], axis=1)
            w = np.concatenate([head.weights[ids[:, :1]], tail.weights[ids[:, 1:]]], axis=1)
            if size == 1:
                spelled = ids < 0
                for first, at in ((True, np.s_[:, :1]), (False, np.s_[:, 1:])):
                    unknown, which = np.unique(codes[at][spelled[at]], return_inverse=True)
                    w[at][spelled[at]] = np.exp(np.array([self.spelled_byte(chr(c), first) + SCALE for c in unknown.tolist()]))[which]
            found.append(ids)
            weights.append(w)
        return found, weights, spelled, codes

    @staticmethod
    def _forward(weights: list[np.ndarray]) -> np.ndarray:
        """Forward recursion of many words of one length at once: (word, position)."""
        rows, n = weights[0].shape
        ending = np.zeros((rows, n + 1, len(weights)))  # arcs by the position where they end
        for k, w in enumerate(weights):
            ending[:, k + 1 :, k] = w
        alpha = np.zeros((rows, n + 1))
        alpha[:, 0] = 1.0
        for j in range(1, n + 1):
            m = min(j, len(weights))
            alpha[:, j] = np.einsum("bm,bm->b", alpha[:, j - m : j][:, ::-1], ending[:, j, :m])
        return alpha

    def log_probabilities(self, words: list[str]) -> np.ndarray:
        """``log_probability`` of each word, those of one length together; very long and very improbable words one by one."""
        out = np.zeros(len(words))
        for n, at in _by_length(words).items():
            total = np.zeros(len(at))
            if 0 < n <= LONGEST:
                total = self._forward(self._lattice([words[i] for i in at], n)[1])[:, n]
            good = total > LEAST
            out[at[good]] = np.log(total[good]) - SCALE * n + self.stop
            for i in at[~good].tolist():
                out[i] = self.log_probability(words[i])
        return out

    def all_expected(self, words: list[str], heads: dict[str, float], tails: dict[str, float]) -> None:
        """``expected`` of all words, those of one length together."""
        for n, at in _by_length(words).items():
            if not 0 < n <= LONGEST:
                for i in at.tolist():
                    self.expected(words[i], heads, tails)
                continue
            mine = [words[i] for i in at]
            found, weights, spelled, codes = self._lattice(mine, n)
            alpha = self._forward(weights)
            total = alpha[:, n].copy()
            good = total > LEAST
            for i in np.flatnonzero(~good).tolist():
                self.expected(mine[i], heads, tails)
            total[~good] = math.inf  # adds nothing below
            starting = np.zeros((len(mine), n, len(weights)))
            for k, w in enumerate(weights):
                starting[:, : n - k, k] = w
            beta = np.zeros((len(mine), n + 1))
            beta[:, n] = 1.0
            for i in range(n - 1, -1, -1):
                m = min(n - i, len(weights))
                beta[:, i] = np.einsum("bm,bm->b", beta[:, i + 1 : i + 1 + m], starting[:, i, :m])
            for k, (ids, w) in enumerate(zip(found, weights, strict=True)):
                use = alpha[:, : n - k] * w * beta[:, k + 1 :] / total[:, None]
                use[use <= math.exp(-14.0)] = 0.0
                for arcs, part, out in ((self.arcs[0], np.s_[:, :1], heads), (self.arcs[1], np.s_[:, 1:], tails)):
                    some = (use[part] > 0) & (ids[part] >= 0)
                    pieces, which = np.unique(ids[part][some], return_inverse=True)
                    for p, v in zip(pieces.tolist(), np.bincount(which, use[part][some]).tolist(), strict=True):
                        out[arcs.names[p]] = out.get(arcs.names[p], 0.0) + v
                    if k == 0:
                        some = (use[part] > 0) & spelled[part]
                        unknown, which = np.unique(codes[part][some], return_inverse=True)
                        for c, v in zip(unknown.tolist(), np.bincount(which, use[part][some]).tolist(), strict=True):
                            for b, byte in enumerate(chr(c).encode()):
                                to, key = (heads if out is heads and b == 0 else tails), f"<{byte:02X}>"
                                to[key] = to.get(key, 0.0) + v

    def expected(self, word: str, heads: dict[str, float], tails: dict[str, float]) -> None:
        """Add the expected use of each piece in spelling ``word`` (forward and backward recursions)."""
        n = len(word)
        terms: list[list[float]] = [[] for _ in range(n + 1)]
        arcs: list[list[tuple[int, float, str]]] = [[] for _ in range(n)]
        alpha = [0.0] * (n + 1)
        table, missing = self.first, -1.0
        for i in range(n):
            if i:
                if not terms[i]:
                    continue
                alpha[i], table = _log_sum(terms[i]), self.next
            at, mine = alpha[i], arcs[i]
            for j in range(i + 1, n + 1):
                p = word[i:j]
                w = table.get(p, missing)
                if w is missing:
                    break
                if w is not None:
                    terms[j].append(at + w)
                    mine.append((j, w, p))
            if table.get(word[i]) is None:
                w = self.spelled_byte(word[i], i == 0)
                terms[i + 1].append(at + w)
                mine.append((i + 1, w, ""))
        total = _log_sum(terms[n])
        beta: list[float | None] = [None] * n + [0.0]
        exp = math.exp
        for i in range(n - 1, -1, -1):
            ahead = [(w + beta[j], p) for j, w, p in arcs[i] if beta[j] is not None]
            if not ahead:
                continue
            beta[i] = _log_sum([v for v, _ in ahead])
            at, out = alpha[i] - total, tails if i else heads
            for v, p in ahead:
                if v + at > -14.0:
                    use = exp(v + at)
                    if p:
                        out[p] = out.get(p, 0.0) + use
                    else:
                        for k, byte in enumerate(word[i].encode()):
                            to, key = (heads if i == 0 and k == 0 else tails), f"<{byte:02X}>"
                            to[key] = to.get(key, 0.0) + use


@cache
def vocabulary(path: str) -> tuple[tuple[str, float], ...]:
    """(piece, score) of a sentencepiece model, best score first."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = [(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
    return tuple(sorted(rows, key=lambda r: -r[1]))


def prior_pieces(path: str) -> Pieces:
    """Weights 1 / (10 - score) of the vocabulary's pieces, lower-cased; bytes share a thousandth."""
    heads: dict[str, float] = {}
    tails: dict[str, float] = {}
    for piece, score in vocabulary(path):
        body = piece.removeprefix("▁").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        if not body or "▁" in body:
            continue
        to = heads if piece.startswith("▁") else tails
        to[body] = to.get(body, 0.0) + 1 / (10 - score)
    for x in tails:  # single characters may start a word as well
        if len(x) == 1:
            heads.setdefault(x, 1e-4)
    out = []
    for x in (heads, tails):
        total = sum(x.values())
        names = [*x, *(f"<{b:02X}>" for b in range(256))]
        weight = np.concatenate([np.array(list(x.values())) / total * 0.999, np.full(256, 0.001 / 256)])
        out += [names, np.log(weight)]
    return Pieces(out[0], out[2], out[1], out[3], 0.3)


def fitted_pieces(prior: Pieces, counts: dict[tuple[bool, str], float], words: float, prior_count: float) -> Pieces:
    out = []
    for names, weights, first in ((prior.heads, prior.head, True), (prior.tails, prior.tail, False)):
        c = np.array([counts.get((first, n), 0.0) for n in names]) + prior_count * np.exp([weights[n] for n in names])
        out += [names, np.log(c / c.sum())]
    continued = sum(v for (first, _), v in counts.items() if not first)
    return Pieces(out[0], out[2], out[1], out[3], (words + 3.0) / (words + continued + 10.0))


# ---------------------------------------------------------------- tasks


def _words(text: bytes | None) -> list[bytes]:
    return text.translate(_LOWER).split() if text else []


def _texts(batch: pa.RecordBatch) -> list[bytes | None]:
    return batch.column("text").cast(pa.binary()).to_pylist()


def _strings(words: list[bytes]) -> pa.Array:
    return pa.array(words, pa.binary()).cast(pa.string())


def _gathered(batches, rows: int = MANY):
    """The batches put together to at least ``rows`` rows each, but for the last."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, n = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _count(classes: int):
    """word, class, n_train, n (partial sums of a task; written out when there are many)."""

    def rows(counters: list[Counter]):
        for k, counter in enumerate(counters):
            keys, counts = list(counter), list(counter.values())
            for i in range(0, len(keys), 50_000):
                n = pa.array(counts[i : i + 50_000], pa.int64())
                kind = pa.array(np.full(len(n), min(k, classes - 1), np.int32))
                train = n if k < classes else pa.array(np.zeros(len(n), np.int64))
                yield pa.RecordBatch.from_arrays([_strings(keys[i : i + 50_000]), kind, train, n], ["word", "class", "n_train", "n"])

    def run(batches):
        counters = [Counter() for _ in range(classes + 1)]  # the last one: held-out documents
        for batch in batches:
            for text, out, k in zip(_texts(batch), *[batch.column(c).to_pylist() for c in ("held_out", "class")], strict=True):
                words = _words(text)
                words.append(END.encode())
                counters[classes if out else k].update(words)
            if sum(map(len, counters)) > 700_000:
                yield from rows(counters)
                counters = [Counter() for _ in range(classes + 1)]
        yield from rows(counters)

    return run


def _expect(prior: Pieces):
    def run(batches):
        heads, tails, n = {}, {}, 0
        for some in _gathered(batches):
            prior.all_expected(some.column("word").to_pylist(), heads, tails)
            n += some.num_rows
        flat = [(True, k, v) for k, v in heads.items()] + [(False, k, v) for k, v in tails.items()] + [(True, "", float(n))]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in flat], t) for i, t in enumerate((pa.bool_(), pa.string(), pa.float64()))], ["head", "piece", "use"])

    return run


def urn(logs: np.ndarray, times: np.ndarray, concentration: float) -> np.ndarray:
    """log10 of the urn's numerators by class: words (rows of ``logs``) that occur ``times`` each."""
    more = times > 1
    n = times[more] - 1
    later = np.arange(1, n.sum() + 1) - np.repeat(np.cumsum(n) - n, n)  # 1..n for each word
    drawn = concentration * np.repeat(10.0 ** logs[more], n, axis=0) + later[:, None]
    return logs.sum(axis=0) + len(logs) * math.log10(concentration) + np.log10(drawn).sum(axis=0)


def urn_total(n: int, concentration: float) -> float:
    """log10 of the urn's denominators over ``n`` words."""
    return (math.lgamma(concentration + n) - math.lgamma(concentration)) / LN10


def _spell(pieces: Pieces, discount: float, total: float, types: float, by_class: list[tuple[float, float]]):
    """log10 probabilities of each word by class: whole-word arc and piece arcs, smoothing the counts of the class.
    ``by_class`` has the training words and the pseudo-counts of each class."""
    size, pseudo = np.array(by_class, float).T
    size = np.where(size > 0, size, 0.0)
    share = np.log10(np.where(size > 0, pseudo, 1.0)) - np.log10(np.where(size > 0, size + pseudo, 1.0))

    def run(batches):
        left = discount * types / total if total else 1.0
        for some in _gathered(batches):
            words, c = some.column("word").to_pylist(), some.column("n_train").to_numpy()
            ends = np.array([w == END for w in words], bool)
            with np.errstate(divide="ignore"):
                whole = np.log(np.maximum(c - discount, 0.0) / total if total else np.zeros(len(c)))
                spelled = math.log(left) + pieces.log_probabilities(words) if left > 0 else np.full(len(c), -np.inf)
            spelled[ends] = -np.inf
            out = np.logaddexp(whole, spelled) / LN10
            out[out == -np.inf] = -300.0
            logs = out[:, None] + share
            counts = some.column("counts").flatten().to_numpy().reshape(logs.shape)
            own = counts > 0
            logs[own] = np.log10((counts / np.maximum(size + pseudo, 1.0))[own] + 10.0 ** logs[own])
            yield pa.RecordBatch.from_arrays([some.column("word"), some.column("n_train"), some.column("n"), lists(logs.ravel(), np.arange(len(logs) + 1) * len(size), pa.float64())], ["word", "n_train", "n", "logs"])

    return run


def _score(frequent: Callable[[], tuple[dict[bytes, int], np.ndarray, np.ndarray, np.ndarray]], concentration: float):
    """For each document: its rows of infrequent words, and one row (word null) of sums over frequent ones."""

    def run(batches):
        place, base, score, seen = frequent()
        for batch in batches:
            ids, out = batch.column("doc_id").to_pylist(), ([], [], [], [], [], [])
            for doc, text in zip(ids, _texts(batch), strict=True):
                words = _words(text)
                words.append(END.encode())
                counts = Counter(words)
                at = np.fromiter(map(place.get, counts, repeat(-1)), np.int64, len(counts))
                times = np.fromiter(counts.values(), np.int64, len(counts))
                rare = at < 0
                kinds, more = at[~rare], times[~rare]
                value = urn(score[kinds], more, concentration) - urn_total(len(words), concentration)
                names, n = list(compress(counts, rare.tolist())), times[rare].tolist()
                each = lambda v: repeat(v, len(names))  # noqa: B023, E731
                for o, v, last in zip(out, (each(doc), names, n, each(0.0), each(None), each(0)), (doc, None, len(words), float((base[kinds] * more).sum()), value, int(more[seen[kinds]].sum())), strict=True):
                    o.extend(v)
                    o.append(last)
            types = (pa.int64(), pa.binary(), pa.int64(), pa.float64(), pa.list_(pa.float64()), pa.int64())
            columns = [pa.array(o, t) for o, t in zip(out, types, strict=True)]
            columns[1] = columns[1].cast(pa.string())
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "word", "n", "base", "score", "hits"])

    return run


def lattice_scores(docs: DataFrame, vocabulary_path: str, frequent: int = 100_000, prior_count: float = 1000.0, concentration: float = 1500.0, group: str | None = None, reserve: float = 0.7) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10) for each document id."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"), (F.col(group).cast("string") if group else F.lit(None).cast("string")).alias("class")).where(F.col("doc_id").isNotNull())
    largest = docs.where("not held_out and class is not null").groupBy("class").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "class").limit(CLASSES - 1)
    found = largest.collect()
    classes = len(found) + 1
    index = F.lit(classes - 1)
    for k, r in enumerate(found):
        index = F.when(F.col("class") == r["class"], k).otherwise(index)
    docs = docs.withColumn("class", index)
    sums = [F.sum(F.when(F.col("class") == k, F.col("n_train")).otherwise(0)) for k in range(classes)]
    counted = docs.mapInArrow(_count(classes), "word string, class int, n_train long, n long").groupBy("word").agg(F.sum("n_train").alias("n_train"), F.sum("n").alias("n"), F.array(*sums).alias("counts"))
    counted = stage(counted, "words")
    size = counted.where("n_train > 0").agg(F.coalesce(F.sum("n_train"), F.lit(0)), F.count("*"), F.coalesce(F.sum((F.col("n_train") == 1).cast("long")), F.lit(0)), F.coalesce(F.sum((F.col("n_train") == 2).cast("long")), F.lit(0))).first()
    total, types, once, twice = size
    own = [F.get("counts", F.lit(k)) for k in range(classes)]
    row = counted.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(f"n{k}") for k, c in enumerate(own)], *[F.count_if(c > 0).alias(f"v{k}") for k, c in enumerate(own)]).first()
    by_class = [(float(row[k]), reserve * float(row[classes + k])) for k in range(classes)]
    discount = min(0.95, max(0.1, once / (once + 2 * twice))) if once + twice else 0.5

    prior = prior_pieces(vocabulary_path)
    spelled = counted.where(F.expr("n_train > 0") & (F.col("word") != END)).select("word")
    slot = F.pmod(F.xxhash64("word"), F.lit(16))
    pieces = prior
    for low, high in STEPS:
        used = spelled.where(slot.between(low, high)).mapInArrow(_expect(pieces), "head boolean, piece string, use double").groupBy("head", "piece").agg(F.sum("use").alias("use"))
        uses = {(r.head, r.piece): r.use for r in used.collect()}  # at most a row for each piece
        n_words = uses.pop((True, ""), 0.0)
        pieces = fitted_pieces(prior, uses, n_words, prior_count)
    words = stage(counted.mapInArrow(_spell(pieces, discount, float(total), float(types), by_class), "word string, n_train long, n long, logs array<double>"), "spelled")
    drop_stage(counted)

    floor = math.log10(total + types + 1)
    grade = F.floor(F.log2("n") * 16).cast("int")  # by growing count; at most 1024 grades
    least, sofar = None, 0
    for r in words.groupBy(grade.alias("grade")).agg(F.count("*").alias("words")).orderBy(F.desc("grade")).collect():
        sofar += r["words"]
        if sofar > frequent:
            break
        least = r["grade"]
    top = words.where(grade >= least) if least is not None else words.limit(0)
    rows = top.select("word", "n_train", "logs").toPandas()  # at most ``frequent`` rows
    packed = spark.sparkContext.broadcast((rows["word"].tolist(), rows["n_train"].to_numpy(), np.array(rows["logs"].tolist(), float).reshape(len(rows), classes)))

    def known() -> tuple[dict[bytes, int], np.ndarray, np.ndarray, np.ndarray]:
        names, counts, logs = packed.value
        return {w.encode(): i for i, w in enumerate(names)}, np.log10(counts + 1.0) - floor, logs, counts > 0

    parts = stage(one_text(docs.select("doc_id", "text")).mapInArrow(_score(known, concentration), "doc_id long, word string, n long, base double, score array<double>, hits long"), "parts")
    rare = parts.where("word is not null").join(words.select("word", "n_train", "logs"), "word")

    def value(log: Column) -> Column:
        again = F.aggregate(F.sequence(F.lit(1), F.col("n").cast("int") - 1), F.lit(0.0), lambda s, j: s + F.log10(concentration * F.pow(F.lit(10.0), log) + j))
        return log + math.log10(concentration) + F.when(F.col("n") > 1, again).otherwise(0.0)

    rare = rare.groupBy("doc_id").agg(
        F.sum(F.col("n") * (F.log10(F.col("n_train") + 1.0) - floor)).alias("rare_base"), *[F.sum(value(F.get("logs", F.lit(k)))).alias(f"rare_{k}") for k in range(classes)], F.sum(F.when(F.col("n_train") > 0, F.col("n")).otherwise(0)).alias("rare_hits")
    )
    once_each = parts.where("word is null").groupBy("doc_id").agg(*[F.max(c).alias(c) for c in ("n", "base", "score", "hits")], F.count("*").alias("copies"))
    out = once_each.join(rare, "doc_id", "left")
    each = lambda c, zero: F.coalesce(F.col(c) / F.col("copies"), F.lit(zero))
    members = [*[r["n"] for r in found], 0]
    terms = [math.log10((n + 1) / (sum(members) + classes)) + F.get("score", F.lit(k)) + each(f"rare_{k}", 0.0) for k, n in enumerate(members)]
    marginal = let(F.array(*terms), lambda x: let(F.array_max(x), lambda top: top + F.log10(F.aggregate(x, F.lit(0.0), lambda s, v: s + F.pow(F.lit(10.0), v - top)))))
    out = out.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        F.col("n").alias("n_tokens"),
        (F.col("hits") + each("rare_hits", 0.0)).cast("long").alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("base") + each("rare_base", 0.0)).alias("base_score"),
        marginal.alias("score"),
    )
    out = stage(out, "scores")
    drop_stage(words, parts)
    return out


def op1_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return lattice_scores(table(spark, sf_dir, "documents"), str(public_tokenizers.path("piece_bpe_32k.model")), group="lang")
