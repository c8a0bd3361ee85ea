"""Agenda encoding against the sentencepiece library and against a plain search for the best pair."""

from __future__ import annotations

import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece

from tessera.llm import pieces

MODEL = str(public_tokenizers.path("piece_bpe_32k.model"))
ALPHABET = "ab  \n\t▁é中😀<0x0A>th er in\x00\xad  --==..,'s"


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def texts():
    r = random.Random(7)
    return ["", " ", "  ", "▁", "a ▁ b", "<s> </s> <unk>", "a" * 3000, "é" * 500 + " " * 70, *["".join(r.choice(ALPHABET) for _ in range(r.randint(1, 60))) for _ in range(1500)]]


def test_agenda_equals_the_library(library):
    v, known = pieces.vocabulary(MODEL), pieces.Store()
    for t in texts():
        assert pieces.ids_of(t, v, known) == library.encode(t, add_eos=True), t
        assert pieces.ids_of(t, v, known) == pieces.ids_of(t, v, pieces.Store()), t


def test_agenda_merges_the_best_leftmost_pair():
    v = pieces.vocabulary(MODEL)
    for t in texts()[8:400]:
        for part in (p.replace(" ", pieces.BLANK) for p in v.parts(t)):
            symbols = list(part)
            while True:
                ranks = [(v.ranks.get(a + b), i) for i, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False)) if a + b in v.ranks]
                if not ranks:
                    break
                _, i = min(ranks)
                symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
            want = [j for s in symbols for j in ([v.ids[s]] if s in v.ids else [v.bytes[b] for b in s.encode()])]
            assert list(v.agenda(part)) == want
            assert v.scanned(part) == v.heaped(part) == symbols


def test_a_full_store_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(pieces, "CACHE", 3)
    v, known = pieces.vocabulary(MODEL), pieces.Store()
    for t in texts()[:100]:
        assert pieces.ids_of(t, v, known) == library.encode(t, add_eos=True)
    assert len(known.parts) == len(known.words) == 3


def test_rows(spark, library):
    rows = [(1, None), (2, ""), (2, "twice under one id"), (3, "the same row"), (3, "the same row"), (None, "no id"), (4, "long text, " * 30_000), (5, "tab\tand ﬁ 中")]
    docs = spark.createDataFrame([(d, t, "x", True) for d, t in rows], "doc_id long, text string, ids string, agrees boolean").repartition(2)
    got = sorted(((r.doc_id, r.ids, r.decoded, r.agrees) for r in pieces.encode(docs, MODEL).collect()), key=str)
    want = sorted(((d, i := library.encode(t or "", add_eos=True), library.decode(i), True) for d, t in rows), key=str)
    assert got == want
    assert pieces.encode(docs.limit(0), MODEL).count() == 0


def test_registered_query(spark, library):
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in pieces.op12_agenda(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = library.encode(d.text or "", add_eos=True)
        r = got[d.doc_id]
        assert r.agrees and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
