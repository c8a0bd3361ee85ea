"""The corpus operators against brute force on a small table with nulls, empty and long texts, copies and odd columns."""

from __future__ import annotations

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import chunks, common, html, lattice, mixing, neardup, packing, quality, secrets, substring, urls

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def corpus() -> list[tuple[int, str | None]]:
    r = random.Random(5)
    words = ["".join(r.choice(["th", "er", "on", "é", "an", "ß", "in"]) for _ in range(r.randint(1, 4))) for _ in range(300)]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    shared = text(60)
    docs: list[str | None] = [text(r.randint(5, 120)) for _ in range(24)]
    base = docs[3] = text(100)
    docs += [base, base, base.upper().replace("É", "é"), f"{base} tail", f"head words {base}"]
    for i in range(12):  # near copies with edits
        w = base.split()
        for _ in range(1 + i % 4):
            w[r.randrange(len(w))] = f"edit{i}"
        docs.append(" ".join(w))
    docs += [f"{text(20)}\n{shared} {text(10)}" for _ in range(5)]
    docs += [None, "", " \t\n", "one", "two words", "a b c", "a b c", "tab\tand\x0bother\x0c blanks\r\nhere " * 9]
    docs += [text(4000), ("again and again the same " * 40).strip(), "### $$$ %%% &&& " * 30]
    docs += [
        'x password = "hunter2secret" y AKIA' + "ABCDEFGHIJ234567 z", "token: secret: abcdefgh é 0123456789abcdef01234567 deadbeef",
        f"key {hashlib.sha256(b'x').hexdigest()} q7Xz9LmP2vR8kTn4WcY6bD3f and 😀 api_key='A1b2C3d4' AKIA123", "<|endoftext|> is a marker",
    ]
    return list(enumerate(docs))


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    # clashing extra columns, and one row twice
    data = [(d, t, "en", "s", 0, 0.0, "x") for d, t in [*rows, rows[3]]]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, score double, key string").repartition(3).cache()


@pytest.fixture(scope="module")
def labels(spark, rows):
    return spark.createDataFrame([(d, 0 if t and "###" in t else 1, int(d % 9 == 0), "x") for d, t in rows if d % 2 == 0 or (t and "###" in t)], "doc_id long, quality int, toxic int, text string")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def words(text: str | None, lower: bool = False) -> list[str]:
    text = text or ""
    return WORD.findall(text.translate(LOWER) if lower else text)


def test_near_duplicates(docs, rows, empty):
    k = 4
    sets = {}
    for d, t in rows:
        w = words(t, True)
        sets[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = 0
    for a, b in itertools.combinations(sets, 2):
        i, u = len(sets[a] & sets[b]), len(sets[a] | sets[b])
        if u and 100 * i >= 80 * u:
            links += 1
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    assert links > 20
    got = {r.doc_id: r for r in neardup.near_duplicates(docs, shingle=k).collect()}
    assert {d: (len(sets[d]), find(d), find(d) == d) for d in sets} == {d: (r.n_shingles, r.component_id, r.kept) for d, r in got.items()}
    assert neardup.near_duplicates(empty, shingle=k).count() == 0


def test_superminhash_estimates_similarity():
    r = np.random.default_rng(1)
    a = r.integers(0, 2**63, 400).astype(np.uint64)
    b = np.concatenate([a[:300], r.integers(0, 2**63, 100).astype(np.uint64)])
    sig = neardup.superminhash(np.concatenate([a, b]), np.array([0, 400, 800]), 252)
    assert abs((sig[0] == sig[1]).mean() - 300 / 500) < 0.08
    assert all(sorted(set((s >> np.uint64(32)).tolist()))[0] == 0 for s in sig)
    alone = neardup.superminhash(a[:3], np.array([0, 3, 3]), 16)
    assert (alone[0] < np.uint64(16) << np.uint64(32)).all() and (alone[1] == np.uint64(2**64 - 1)).all()


def test_components_of_a_long_path(spark):
    n = 40
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in common.components(edges).collect()}
    assert got == {**{i: 0 for i in range(n + 1)}, 100: 100, 101: 100}


def test_repeated_passages(docs, rows, empty):
    seen, want, texts = set(), {}, {}
    for d, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for i in range(len(w) - 19):
            key = tuple(w[i : i + 20])
            if key in seen:
                gone[i : i + 20] = [True] * 20
            seen.add(key)
        texts[d] = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        want[d] = (len(w), sum(gone), hashlib.sha256(texts[d].encode()).hexdigest())
    assert sum(v[1] for v in want.values()) > 300
    every, cut = substring.repeated_passages(docs, length=20)
    assert want == {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in every.collect()}
    for r in cut.collect():
        assert r.kept_text == texts[r.doc_id]
        assert sum(b - a for a, b in r.spans) == r.n_removed and all(b - a >= 20 for a, b in r.spans)
    assert substring.repeated_passages(empty, length=20)[0].count() == 0
    with pytest.raises(ValueError):
        substring.repeated_passages(docs, length=3)


def test_secret_spans(docs, rows, empty):
    assign = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    got = {r.doc_id: r for r in secrets.secret_spans(docs).collect()}
    for d, t in rows:
        t = t or ""
        r = got[d]
        assert [tuple(s) for s in r.assign] == [m.span() for m in assign.finditer(t) if len(m[1]) >= 6]
        assert [tuple(s) for s in r.access] == [m.span() for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        assert [tuple(s) for s in r.hex] == [m.span() for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    clean = {r.doc_id: r.text for r in secrets.redact(docs).collect()}
    for d, t in rows:
        spans = sorted(itertools.chain(got[d].assign, got[d].access, got[d].hex, got[d].random))
        if not spans:
            assert clean[d] == t
        else:
            assert not any(t[a:z] in clean[d] for a, z in spans)
    assert secrets.secret_spans(empty).count() == 0


KEY = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


def battery(run):
    """The three tests of a run in plain Python."""
    body = run.rstrip("=")
    symbols = next(a for a, shape in secrets.ENCODINGS if re.fullmatch(shape, body))
    x, a = np.array([symbols.index(c) for c in body], float), len(symbols)
    n = len(x)
    tail = lambda z: 1 / (1 + math.exp(min(max(1.5976 * z + 0.070566 * z**3, -700), 700)))
    two = lambda z: min(2 * tail(abs(z)), 1.0)
    chi = max(sum(v * v for v in collections.Counter(body).values()) * a / n - n, 0)
    z = ((chi / (a - 1)) ** (1 / 3) - (1 - 2 / (9 * (a - 1)))) / math.sqrt(2 / (9 * (a - 1)))
    side = 2 * x >= a
    mean = 2 * side.sum() * (n - side.sum()) / n + 1
    runs = (1 + (side[1:] != side[:-1]).sum() - mean) / math.sqrt(max((mean - 1) * (mean - 2) / (n - 1), 1e-9))
    c = x - x.mean()
    lag = (c[1:] * c[:-1]).sum() / (c * c).sum() * math.sqrt(n) if (c * c).sum() else math.sqrt(n)
    h = -sum(math.log(max(p, 1e-300)) for p in (tail(z), two(runs), two(lag)))
    return math.exp(-h) * (1 + h + h * h / 2)


def test_battery_equals_plain_python(spark):
    r = random.Random(2)
    written = ["thethethethethethethe1the2", "aaaaaaaaaaaaaaaaaaaaaaaa1", "abcabcabcabcabcabcabcabc1", "someveryordinarywords", "CamelCaseNameOfAThing2"]
    noise = ["".join(r.choice(KEY) for _ in range(40)) for _ in range(20)] + ["".join(r.choice("0123456789ABCDEF") for _ in range(32)), "aGVsbG8gd29ybGQ_-x9Qz=="]
    df = spark.createDataFrame([(x,) for x in written + noise], "r string")
    p = [v[0] for v in df.select(secrets._battery(F.col("r"))).collect()]
    assert p == pytest.approx([battery(x) for x in written + noise], rel=1e-6, abs=1e-12)
    assert max(p[:3]) < 1e-3 and np.median(p[5:]) > 0.05


def test_false_secrets_are_controlled_by_length(spark):
    """Planted keys outside base spans are added, written names of the same shapes are not; limits equal a plain loop."""
    r = random.Random(4)
    words = ["the", "other", "value", "order", "on", "that", "reader", "title", "entry", "tree", "state", "in", "data", "there"]
    prose = lambda n: " ".join(r.choice(words) for _ in range(n)) + ". "
    keys, names, data = {}, {}, []
    for i in range(700):
        text, n = prose(r.randint(60, 90)), r.choice([24, 28, 36, 44, 52])
        if i % 7 == 0:
            keys[i] = "".join(r.choice(KEY if i % 2 else "0123456789ABCDEF") for _ in range(n))
            text += f"see {keys[i]} there"
        elif i % 7 == 1:
            name = "".join(r.choice(words).title() for _ in range(12))[:n]
            names[i] = name if i % 2 else name.lower()
            text += f"see {names[i]} there"
        data.append((i, text))
    d = spark.createDataFrame(data, "doc_id long, text string")
    text = dict(data)
    got = {x.doc_id: [text[x.doc_id][a:z] for a, z in x.random] for x in secrets.secret_spans(d).collect()}
    assert np.mean([keys[i] in got[i] for i in keys]) > 0.8
    false = sum(any(w not in keys.values() for w in v) for v in got.values())
    assert false <= 0.1 * len(keys)
    tested = [(t.family, t.cell, t.start >= 0) for row in secrets._found(d).select("tested").collect() for t in row.tested]
    want = {}
    for f in {x[0] for x in tested}:
        runs, decoys = ([c for g, c, own in tested if g == f and own == k] for k in (True, False))
        good = [c for c in sorted({*runs, *decoys}) if sum(x <= c for x in runs) and (sum(x <= c for x in decoys) + 1) * len(runs) <= 0.05 * sum(x <= c for x in runs) * (len(decoys) + 1)]
        want[f] = max(good, default=-1)
    assert secrets._limits(secrets._found(d), 0.05).first()[0] == want
    none = secrets.secret_spans(d.where("doc_id % 7 <> 0"))  # only names: nothing is added
    assert none.where(F.size("random") > 0).count() <= 2


def test_spans_are_placed_in_long_texts(spark):
    t = "é " + " ".join(f"{i:024x}" for i in range(2000))
    d = spark.createDataFrame([(1, t), (None, f"token = {'ab12' * 6}"), (1, "a second text, secret: hunter2hunter2")], "doc_id long, text string")
    got = {x.doc_id: [tuple(s) for s in x.hex] for x in secrets.secret_spans(d).where(F.size("hex") > 0).collect()}
    assert got[1] == [m.span() for m in re.finditer(secrets.HEX, t)] and got[None] == [(8, 32)]
    clean = [x.text for x in secrets.redact(d.withColumn("_spans", F.lit(1)).withColumn("key", F.lit(2))).orderBy("text").collect()]
    assert clean[:2] == ["[secret]", "a second text, [secret]"] and clean[2].startswith("é [secret] [secret]")


def test_quality_rules(docs, rows, labels, empty):
    got = {r.doc_id: r for r in quality.quality_rules(docs, labels, buckets=1 << 12).collect()}
    for d, t in rows:
        t, w = t or "", words(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        where = collections.defaultdict(list)
        for i in range(len(w) - 4):
            where[tuple(w[i : i + 5])].append(i)
        covered = {j for v in where.values() if len(v) > 1 for i in v for j in range(i, i + 5)}
        r = got[d]
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t))
        assert (r.n_dup_lines, r.n_repeat_words) == (len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(w) < 10 or 100 * len(covered) > 20 * len(w))
        assert not (r.base_failed and r.kept)
    junk = next(d for d, t in rows if t and "###" in t)
    assert got[junk].score < min(r.score for d, r in got.items() if d < 24)
    kept = {r.doc_id for r in quality.quality_filter(docs, labels, buckets=1 << 12).collect()}
    assert kept == {d for d, r in got.items() if r.kept}
    assert quality.quality_rules(empty, labels).count() == 0
    assert quality.quality_rules(docs, labels.limit(0)).where("score <> 0").count() == 0


def test_mixing_meets_its_targets(spark, labels, docs, empty):
    r = random.Random(1)
    good, bad, odd = ([f"{p}{i}" for i in range(40)] for p in ("good", "bad", "odd"))
    data, marks = [], []
    for i in range(300):
        q, x = (0, 0) if i % 5 == 0 else (1, 1) if i % 5 == 1 else (1, 0)
        own = odd if q == 0 else bad if x else good
        data.append((i, " ".join(r.choice(own if r.random() < 0.7 else good + bad + odd) for _ in range(r.randint(5, 60)))))
        if i % 2:
            marks.append((i, q, x))
    d = spark.createDataFrame(data, "doc_id long, text string")
    m = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    weights = {"low": 0.1, "toxic": 0.1, "clean": 0.8}
    x = mixing.mixing_rates(d, m, weights).toPandas()
    assert (x.rate >= 0).all() and np.allclose(x[list(mixing.DOMAINS)].sum(axis=1), 1)
    totals = np.array([(x.n_tokens * x[k] * x.rate).sum() for k in mixing.DOMAINS])
    assert np.allclose(totals, np.array([weights[k] for k in mixing.DOMAINS]) * x.n_tokens.sum(), rtol=1e-4)
    held = x[x.doc_id % 2 == 0]
    truth = np.where(held.doc_id % 5 == 0, 0, np.where(held.doc_id % 5 == 1, 1, 2))
    assert (held[list(mixing.DOMAINS)].to_numpy().argmax(axis=1) == truth).mean() > 0.9
    kept = {r.doc_id for r in mixing.mixture(d, m, {"low": 0.01, "toxic": 0.01, "clean": 0.98}).collect()}
    share = lambda k: np.mean([i in kept for i in range(300) if k(i)])
    assert share(lambda i: i % 5 > 1) > 0.9 and share(lambda i: i % 5 < 2) < 0.3
    assert mixing.mixing_rates(docs, labels, weights).count() == docs.count()
    assert mixing.mixing_rates(empty, labels, weights).count() == 0


def projected(n, p, targets, most, steps=4000):
    """Plain projected gradient descent from 1, many small steps."""
    r, size = np.ones(len(n)), 1 / np.linalg.eigvalsh((n[:, None] * p).T @ p)[-1]
    for _ in range(steps):
        r = np.clip(r - size * p @ ((n * r) @ p - targets), 0, most)
    return r


def test_thinning_is_fitted_within_its_bounds(spark, sf_dir):
    """The corpus has a little of the toxic domain in every clean text, so rates up to 1 cannot meet the targets."""
    d, m = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    weights = {"low": 0.005, "toxic": 0.005, "clean": 0.99}
    members = common.stage(mixing.posteriors(d, m), "members")
    fitted, targets = mixing.fit_rates(members, weights, "clean")
    x = fitted.toPandas()
    p, n, rate = x[list(mixing.DOMAINS)].to_numpy(), x.n_tokens.to_numpy(float), x.rate.to_numpy()
    assert x.rate.between(0, 1).all()
    realised, best = (n * rate) @ p, (n * projected(n, p, targets, 1.0)) @ p
    assert np.allclose(realised, best, atol=2e-3 * n.sum())
    assert np.linalg.norm(realised - targets) < 1.002 * np.linalg.norm(best - targets) < np.linalg.norm(n @ p - targets)
    assert realised[2] > 0.95 * targets[2] and realised[0] < 1.5 * targets[0]
    kept = {r.doc_id for r in mixing.mixture(d, m, weights).select("doc_id").collect()}
    inside = x.doc_id.isin(kept).to_numpy()
    assert np.allclose((n * inside) @ p, realised, atol=0.02 * n.sum())  # what is drawn has the fitted totals
    marks = {r.doc_id: (r.quality, r.toxic) for r in m.where("quality is not null").collect()}
    share = lambda ok: np.mean([i in kept for i in x.doc_id if i in marks and ok(*marks[i])])
    assert share(lambda q, t: q == 1 and t != 1) > 0.97 and share(lambda q, t: q == 0) < 0.4


def test_posteriors_are_those_of_naive_bayes(docs, rows, labels):
    """Against a loop over words; no two words of the fixture share one of the many buckets."""
    got = {r.doc_id: r for r in mixing.posteriors(docs, labels, buckets=1 << 15).collect()}
    kinds = {r.doc_id: 0 if r.quality == 0 else 1 if r.toxic else 2 for r in labels.collect()}
    counts = [collections.Counter() for _ in range(3)]
    for d, t in [*rows, rows[3]]:
        if d in kinds:
            counts[kinds[d]].update(words(t))
    sizes = [sum(c.values()) + (1 << 15) for c in counts]
    prior = [math.log((sum(k == i for k in kinds.values()) + 1) / (len(kinds) + 3)) for i in range(3)]
    close = 0
    for d, t in rows:
        w = words(t)
        logs = [prior[i] + min(len(w), 12) / max(len(w), 1) * sum(math.log((counts[i][x] + 1) / sizes[i]) for x in w) for i in range(3)]
        p = np.exp(np.array(logs) - max(logs))
        close += np.allclose([got[d].low, got[d].toxic, got[d].clean], p / p.sum(), atol=0.02)
        assert got[d].n_tokens == len(w)
    assert close > 0.95 * len(rows)


def test_mixing_with_odd_rows(spark, docs, labels):
    more = spark.createDataFrame([(None, "no id", 1, 2), (7, "another text of an id", 3, 4), (8, None, 5, 6)], "doc_id long, text string, _maybe int, rate int")
    base = docs.select("doc_id", "text", F.lit(0).alias("_maybe"), F.lit(0).alias("rate")).union(more)
    clash = labels.union(labels.selectExpr("doc_id", "1 - quality", "1 - toxic", "text"))  # contradictory labels: the worse ones count
    out = mixing.mixture(base, clash, {"low": 0.005, "toxic": 0.005, "clean": 0.99})
    assert out.columns == base.columns and out.where("doc_id is null").count() == 1
    x = mixing.mixing_rates(base, clash, mixing.WEIGHTS).toPandas()
    assert len(x) == base.count() and np.isfinite(x.rate).all()


def test_letters_are_encoded_by_the_model_alone(tmp_path):
    """Nearly all new strings are letters with marks; the whole tokenizer would spend most of the time on them."""
    import json

    from tokenizers import Tokenizer

    path = packing.public_tokenizer()
    whole = Tokenizer.from_file(path)
    asked: list[str] = []

    class Asked:
        get_added_tokens_decoder = whole.get_added_tokens_decoder

        def encode_batch_fast(self, texts, **options):
            asked.extend(texts)
            return whole.encode_batch_fast(texts, **options)

    letters = ["word", "Word.", "\u00c9TRANGE\u00c0\u00df!!", "(na\u00efve)", "a", "Z,", '"\u00ff\u00fe"', "\u00e0\u00ed\u00a0".strip(), "x" * 300 + "."]
    others = ["don't", "'sab", "a.b", "x1", "12,5", "na\u00d7ve", "\u03a3\u0391\u03a3", "h\u0331", "H\u0331", "\u0130", "<|endoftext|>", "<|ENDOFTEXT|>", "a<|endoftext|>b", "\u4e2d\u6587", "...", "e\u0301t\u00e9", "\u212a", "k\u0345."]
    for as_text in (False, True):
        whole.encode_special_tokens = as_text
        asked.clear()
        words = [w.encode() for w in letters + others]
        got = packing._encode(Asked(), packing._letters(path), words, as_text, {b"word": b"known"})
        assert got.pop(b"word") == b"known"
        for w in letters[1:] + others:
            assert np.frombuffer(got[w.encode()], "<u4").tolist() == whole.encode(w, add_special_tokens=False).ids, w
        assert not [t for t in asked for w in letters if len(w) > 1 and w.strip('().,!"') in t]
    whole.encode_special_tokens = False
    for t in ("Ab H\u0331 C", "\u00c9a <|ENDOFTEXT|> B", "\u0130 \u03a3\u0391\u03a3 I\u0307"):
        ids = [np.array(whole.encode(x, add_special_tokens=False).ids) for x in (t, packing._lower(t.encode()).decode())]
        assert (ids[0] == ids[1]).all(), t
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    spec["normalizer"] = {"type": "NFC"}
    (tmp_path / "other.json").write_text(json.dumps(spec), encoding="utf-8")
    assert packing._letters(str(tmp_path / "other.json")) is None


def test_packing(docs, rows, empty):
    from tokenizers import Tokenizer

    path = packing.public_tokenizer()
    tok = Tokenizer.from_file(path)
    pieces = packing.pack(docs, path, capacity=256).collect()
    by = collections.defaultdict(list)
    for p in pieces:
        by[p.doc_id, p.copy].append(p)
    for d, t in rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        blob, at = np.array(ids, "<u4").tobytes(), 0
        for p in sorted(by[d, 0], key=lambda p: p.start):
            assert (p.start, p.doc_tokens) == (at, len(ids)) and 0 < p.length <= 256
            assert p.ids_crc32 == zlib.crc32(blob[4 * at : 4 * (at + p.length)])
            at += p.length
        assert at == len(ids)
    assert (3, 1) in by and (4, 1) not in by  # the repeated row is packed as well
    bins = collections.defaultdict(list)
    for p in pieces:
        bins[p.sequence_id].append((p.offset, p.length, p.class_count))
    assert sorted(bins) == list(range(len(bins)))
    for b in bins.values():
        at = 0
        for offset, length, _ in sorted(b):
            assert offset == at
            at += length
        assert at <= 256
        assert b[0][2] in (0, len(b))  # full bins have their class's count
    assert packing.pack(empty, path).count() == 0


def test_cut_table_never_pads_more_than_whole_pieces():
    first, kind = packing.cut_table(4096, 16)
    counts = np.array(packing.class_counts(4096))
    waste = 4096 / counts[kind] - np.arange(4097)
    for r in (1, 5, 100, 1366, 2049, 3000, 4095):
        parts = packing.cuts(r, 4096, 16)
        assert sum(parts) == r
        assert sum(waste[p] for p in parts) <= waste[r] + 1e-9


def test_lattice(docs, rows, empty):
    import public_tokenizers

    path = str(public_tokenizers.path("piece_bpe_32k.model"))
    got = {r.doc_id: r for r in lattice.lattice_scores(docs, path, frequent=50, group="lang").collect()}
    tokens = {d: [*words(t, True), "\n"] for d, t in rows}
    train = collections.Counter()
    for d, t in [*rows, rows[3]]:
        if zlib.crc32(str(d).encode()) % 7 != 2:
            train.update(tokens[d])
    n, v = sum(train.values()), len(train)
    for d, w in tokens.items():
        r = got[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (zlib.crc32(str(d).encode()) % 7 == 2, len(w), sum(train[x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((train[x] + 1) / (n + v + 1)) for x in w))
        assert r.score < 0
    few = {r.doc_id: r.score for r in lattice.lattice_scores(docs, path, frequent=3, group="lang").collect()}
    assert few == pytest.approx({d: r.score for d, r in got.items()})  # both ways of looking up words give one score
    assert lattice.lattice_scores(empty, path).count() == 0


def test_score_sums_all_segmentations_and_classes(spark, monkeypatch):
    """The whole score on small documents: every spelling of every word enumerated, words drawn one by one from the urn."""
    import public_tokenizers

    monkeypatch.setattr(lattice, "STEPS", ((0, 15),))
    path, weight, concentration, reserve = str(public_tokenizers.path("piece_bpe_32k.model")), 50.0, 7.0, 0.7
    r = random.Random(8)
    known = [["ab", "the", "cat", "hat"], ["la", "cote", "le", "the"]]
    data = [(i, " ".join(r.choice(known[i % 2]) for _ in range(r.randint(1, 9))) + (" Xyz" if i == 4 else ""), ("en", "fr")[i % 2]) for i in range(24)] + [(24, None, None), (25, "", "en")]
    got = {x.doc_id: x for x in lattice.lattice_scores(spark.createDataFrame(data, "doc_id long, text string, lang string"), path, frequent=3, prior_count=weight, concentration=concentration, group="lang", reserve=reserve).collect()}
    prior = lattice.prior_pieces(path)

    def spellings(word, head, tail, stop):
        """(weight, pieces) of every segmentation."""
        for cut in itertools.product([0, 1], repeat=len(word) - 1):
            at = [0, *(i + 1 for i, c in enumerate(cut) if c), len(word)]
            parts = [word[a:z] for a, z in zip(at, at[1:], strict=False)]
            if parts[0] in head and all(x in tail for x in parts[1:]):
                w = math.exp(head[parts[0]] + sum(tail[x] for x in parts[1:])) * (1 - stop) ** (len(parts) - 1) * stop
                yield w, parts

    train = [(words(t, True), g) for d, t, g in data if zlib.crc32(str(d).encode()) % 7 != 2]
    counts = collections.Counter(w for ws, _ in train for w in [*ws, "\n"])
    heads, tails, continued = collections.Counter(), collections.Counter(), 0.0
    types = [w for w in counts if w != "\n"]
    for word in types:
        every = list(spellings(word, prior.head, prior.tail, 0.3))
        total = sum(w for w, _ in every)
        for w, parts in every:
            heads[parts[0]] += w / total
            tails.update({x: parts[1:].count(x) * w / total for x in set(parts[1:])})
            continued += (len(parts) - 1) * w / total
    fitted = []
    for old, uses in ((prior.head, heads), (prior.tail, tails)):
        c = {k: uses[k] + weight * math.exp(v) for k, v in old.items()}
        fitted.append({k: math.log(v / sum(c.values())) for k, v in c.items()})
    stop = (len(types) + 3.0) / (len(types) + continued + 10.0)
    once, twice, total = sum(c == 1 for c in counts.values()), sum(c == 2 for c in counts.values()), sum(counts.values())
    discount = min(0.95, max(0.1, once / (once + 2 * twice))) if once + twice else 0.5

    def lattice_p(word):
        spelled = sum(w for w, _ in spellings(word, *fitted, stop)) if word != "\n" else 0.0
        return max(counts[word] - discount, 0) / total + discount * len(counts) / total * spelled

    members = collections.Counter(g for _, g in train if g)
    order = [*sorted(members, key=lambda g: (-members[g], g)), None]
    own = {g: collections.Counter(w for ws, x in train for w in [*ws, "\n"] if x == g) for g in order}
    for d, t, _ in data:
        drawn, p = [*words(t, True), "\n"], 0.0
        for g in order:
            size, pseudo = sum(own[g].values()), reserve * len(own[g])
            one, seen = (members[g] + 1 if g else 1) / (sum(members.values()) + len(order)), collections.Counter()
            for i, w in enumerate(drawn):
                base = (own[g][w] + pseudo * lattice_p(w)) / (size + pseudo) if size else lattice_p(w)
                one *= (concentration * base + seen[w]) / (concentration + i)
                seen[w] += 1
            p += one
        assert got[d].score == pytest.approx(math.log10(p), rel=1e-6), (d, t)


def test_urn_equals_drawing_word_by_word():
    p = {"a": 0.5, "b": 0.2, "c": 1e-320}
    drawn, want, seen = "abacaccb", 0.0, collections.Counter()
    for i, w in enumerate(drawn):
        want += math.log10((30 * p[w] + seen[w]) / (30 + i)) if seen[w] or w != "c" else math.log10(30) - 320 - math.log10(30 + i)
        seen[w] += 1
    logs = np.array([[math.log10(0.5)], [math.log10(0.2)], [-320.0]])
    got = lattice.urn(logs, np.array([seen[w] for w in p]), 30.0)[0] - lattice.urn_total(len(drawn), 30.0)
    assert got == pytest.approx(want)
    assert lattice.urn(np.zeros((0, 2)), np.zeros(0, int), 30.0).tolist() == [0.0, 0.0]


def test_lattice_sums_all_segmentations():
    heads, tails = ["a", "ab", "abc", *(f"<{b:02X}>" for b in range(256))], ["b", "c", "bc", *(f"<{b:02X}>" for b in range(256))]
    h = np.log(np.r_[np.full(3, 0.3), np.full(256, 0.1 / 256)])
    p = lattice.Pieces(heads, tails, h, h, 0.4)
    go = 0.6 * 0.3
    want = 0.4 * 0.3 * (1 + go + go + go * go)  # abc, ab c, a bc, a b c
    assert math.exp(p.log_probability("abc")) == pytest.approx(want)
    use_h, use_t = {}, {}
    p.expected("abc", use_h, use_t)
    assert sum(use_h.values()) == pytest.approx(1.0)
    assert use_h["abc"] == pytest.approx(0.4 * 0.3 / want)
    assert math.isfinite(p.log_probability("éa" * 2000))


def test_words_spelled_at_once_equal_the_recursions():
    import public_tokenizers

    p = lattice.prior_pieces(str(public_tokenizers.path("piece_bpe_32k.model")))
    r = random.Random(7)
    words = ["the", "internationalisation", "ärger", "zz9", "\u4e2d\u6587", "\U0001f600", "a", "é" * 90, "\U0001f600" * 60, "-" * 64, "<00>"]
    words += ["".join(r.choice("etaoinshrdlu\u00e9\u0416\u20ac") for _ in range(r.randint(1, 30))) for _ in range(300)]
    assert p.log_probabilities(words) == pytest.approx([p.log_probability(w) for w in words], rel=1e-12)
    want, got = ({}, {}), ({}, {})
    for w in words:
        p.expected(w, *want)
    p.all_expected(words, *got)
    for x, y in zip(want, got, strict=True):
        keys = sorted(set(x) | set(y))
        assert [y.get(k, 0.0) for k in keys] == pytest.approx([x.get(k, 0.0) for k in keys], rel=1e-9, abs=1e-6)
    assert p.log_probabilities([]).tolist() == []


def test_media_round_trip(docs, rows, empty):
    index, packs, stored = chunks.store_media(docs)
    files = {r.media: b"".join(r.parts) for r in chunks.read_media(index, packs, stored).collect()}
    names = {r.doc_id: r for r in index.collect()}
    digests = [r.digest for r in stored.select("digest").collect()]
    for d, t in rows:
        raw = (t or "").encode()
        payload = raw + b" " * (-len(raw) % 192 if raw else 192)
        media = files[names[d].media]
        assert chunks.samples(media) == payload and hashlib.sha256(media).digest() == names[d].media
    assert len(digests) > len(set(digests)) * 0.9
    assert stored.count() + packs.count() < sum(len(r.chunks) for r in names.values())
    got = {r.doc_id: r for r in chunks.media_features(docs).collect()}
    assert got[3].feature == got[24].feature and got[3].payload_bytes % 192 == 0
    assert chunks.media_features(empty).count() == 0


def test_every_file_is_stored_in_chunks(docs):
    long = "".join(f"line {i} of a text that is long enough for several chunks\n" for i in range(900))
    again = docs.sparkSession.createDataFrame([(10_000, "x" * 30_000), (10_001, long)], "doc_id long, text string")  # one file repeats a chunk
    index, packs, stored = chunks.store_media(docs.select("doc_id", "text").union(again))
    lists = {r.media: r.chunks for r in index.collect()}
    laid = packs.collect()
    assert any(len(r.chunks) > 3 for r in laid) and any(len(r.bytes) < len(r.chunks) for r in laid)
    for r in laid:
        assert r.chunks == lists[r.digest] and [chunks.chunk_name(b) for b in r.bytes] == list(dict.fromkeys(r.chunks))
    assert all(chunks.chunk_name(r.bytes) == r.digest for r in stored.collect())
    files = {r.media: b"".join(r.parts) for r in chunks.read_media(index, packs, stored).collect()}
    assert files.keys() == lists.keys() and all(hashlib.sha256(f).digest() == m for m, f in files.items())
    # chunks of a file that only the filter took for a sharing one are in the store; it is rebuilt from there
    moved = packs.select(F.explode(F.arrays_zip(F.array_distinct("chunks").alias("digest"), "bytes")).alias("x")).select("x.digest", "x.bytes")
    files = {r.media: b"".join(r.parts) for r in chunks.read_media(index, packs.limit(0), stored.union(moved)).collect()}
    assert files.keys() == lists.keys() and all(hashlib.sha256(f).digest() == m for m, f in files.items())


def test_repeated_rows_are_stored_once(spark, rows):
    twice = [*rows, *rows[:20], *rows[:5], rows[3]]
    d = spark.createDataFrame(twice, "doc_id long, text string").repartition(4)
    index, packs, stored = chunks.store_media(d)
    names = [bytes(r.digest) for r in packs.select("digest").collect()]
    held = [bytes(r.digest) for r in stored.select("digest").collect()]
    assert len(names) == len(set(names)) and len(held) == len(set(held))
    whole = {bytes(r.media): b"".join(bytes(x) for x in r.parts) for r in chunks.read_media(index, packs, stored).collect()}
    assert all(hashlib.sha256(v).digest() == k for k, v in whole.items())
    assert set(whole) == {bytes(r.media) for r in index.select("media").collect()}


def test_chunks_move_with_their_content():
    r = random.Random(1)
    text = "".join(r.choice("abcdefgh ") for _ in range(30_000))
    names = lambda t: {chunks.chunk_name(f[a:z]) for f, e in chunks.chunked([t]) for a, z in zip([0, *e], e, strict=False)}
    a, b = names(text), names("shifted " + text)
    assert len(a & b) > 0.8 * len(a)
    h = chunks.gear(np.frombuffer(text.encode(), np.uint8))
    slow = 0
    for c in text.encode()[:100]:
        slow = ((slow << 1) + int(chunks._GEAR[c])) & 0xFFFFFFFF
    assert int(h[99]) == slow


def test_urls(spark):
    u = ["http://A.example.net/en/x", "https://b.net", "https://b.net/", "http://x.example.com/de/", "http://c.org/fr/q?x#y", "http://www.spam.org/p/?utm_source=a&k=1", "http://spam.org/p?k=1#z", "http://c.org/other", None, "no host", "", "http://evilexample.com/de/"]
    pages = spark.createDataFrame([(i, x, "clash") for i, x in enumerate(u)], "page_id long, url string, canonical string")
    listed = urls.junk_list(pages)
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.url_verdicts(pages, listed).collect()}
    assert got == {
        0: ("a.example.net", "/en/x", "example.net/en/", "allow"), 1: ("b.net", "", None, "allow"), 2: ("b.net", "/", "net/", "block"), 3: ("x.example.com", "/de/", "example.com/de/", "block"),
        4: ("c.org", "/fr/q", "org/fr/", "allow"), 5: ("www.spam.org", "/p/", None, "block"), 6: ("spam.org", "/p", None, "block"), 7: ("c.org", "/other", None, "allow"),
        8: ("", "", None, "allow"), 9: ("", "", None, "allow"), 10: ("", "", None, "allow"), 11: ("evilexample.com", "/de/", None, "allow"),
    }
    many = urls.listed_pages(pages.select("page_id", urls.canonical(F.col("url")).alias("canonical")), listed, most_blocks=16)
    assert {r.page_id for r in many.where("listed").collect()} == {5, 6}
    assert urls.url_verdicts(pages.limit(0), listed).count() == 0


def test_html(spark):
    menu = "<nav><ul><li>Home<li>News</ul></nav>"
    page = f"<html><head><title>T</title><style>p{{}}</style></head><body>{menu}<article><h1>A &amp; B</h1><p>Some <b>bold</b>text<br>next<p>caf&eacute;&nbsp;x<script>var t='</p>'</script><div class='ad-box'>Buy</div><section id=comments>Hi</section></article><footer>End</footer></body>"
    open_ = "<body><div class='sidebar'>Side</div><div>subscribe to our very nice little letter today for free</div><p>{} unique text stays here</p></body>"
    data = [(0, "http://h/1", page), (1, "http://h/2", open_.format("one two")), (2, "http://h/3", open_.format("three four")), (3, "http://other/3", None), (4, None, ""), (5, "http://h/5", "<article>cut <b"), (1, "http://h/2", open_.format("one two"))]
    pages = spark.createDataFrame(data, "page_id long, url string, html string")
    got = {r.page_id: (r.text, r.n_chars) for r in html.main_text(pages).collect()}
    assert got[0] == ("A & B Some boldtext next café x", 31)
    assert got[1][0] == "one two unique text stays here" and got[2][0] == "three four unique text stays here"
    assert got[3] == ("", 0) and got[4] == ("", 0) and got[5][0] == "cut"
    assert html.main_text(pages.limit(0)).count() == 0


def test_layout_names_do_not_empty_an_article():
    text = lambda page: [t for t, z in html.blocks_of(page) if z == html.main_zone(html.blocks_of(page))]
    for page in (
        '<div class="has-sidebar"><article>The text</article></div>', '<main class="page-header-image"><p>The text</main>',
        '<div class="share-enabled"><article>The text<div class="ad-box">Buy</div></article></div>', '<article class="post has-comments banner"><p>The text</article><aside><article>Other</article></aside>',
        '<article>The text</article><div class="related"><article>Teaser</article></div>', '<main>The text<section id="comments"><article>I agree</article></section></main>',
        '<main>The text</main><article class="comment-7">I agree</article>',
    ):
        assert text(page) == ["The text"], page
    assert html.main_zone(html.blocks_of("<div class=sidebar>x</div><p>y")) is None


def covered_by_suffix_array(streams, shortest):
    """Tokens of each page that lie in a repeat across pages: sorted suffixes, common prefixes of neighbours by page."""
    suffixes = sorted((tuple(s[i:]), page, i) for page, s in streams.items() for i in range(len(s)))
    common_prefix = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    out = {page: set() for page in streams}
    for at, (suffix, page, i) in enumerate(suffixes):
        for step in (1, -1):
            k, run = at + step, 10**9
            while 0 <= k < len(suffixes):  # the nearest suffix of another page
                run = min(run, common_prefix(suffix, suffixes[k][0]))
                if suffixes[k][1] != page:
                    break
                k += step
            else:
                continue
            if run >= shortest:
                out[page] |= set(range(i, i + run))
    return out


def test_repeats_across_pages_equal_a_suffix_array(spark):
    r = random.Random(3)
    names = [f"w{i}" for i in range(40)]
    line = lambda n: " ".join(r.choice(names) for _ in range(n))
    shared = [line(n) for n in (9, 12, 30, 7)]
    data, streams = [], collections.defaultdict(dict)
    for i in range(24):
        host = f"h{i % 3}"
        blocks = [f"{line(r.randint(3, 15))} {r.choice(shared)} {line(2)}" if r.random() < 0.7 else line(r.randint(9, 20)) for _ in range(4)]
        data.append((i, f"http://{host}/{i}", "".join(f"<p>{b}</p>" for b in blocks)))
        streams[host][i] = [w for b in blocks for w in b.split()]
    pages = spark.createDataFrame([*data, data[0], (None, "http://h0/x", "<p>no id</p>"), (90, None, f"<p>{shared[2]}</p>")], "page_id long, url string, html string")
    got = {x.page_id: x for x in html.main_text(pages).collect()}
    removed = 0
    for host in streams:
        cover = covered_by_suffix_array(streams[host], 8)
        for page, tokens in streams[host].items():
            assert got[page].text.split() == [w for i, w in enumerate(tokens) if i not in cover[page]]
            assert got[page].n_repeated == len(cover[page])
            removed += len(cover[page])
    assert removed > 100
    assert got[90].text == shared[2] and got[None].text == "no id"


def test_suffixes_are_sorted_by_their_common_prefixes(spark):
    """Each suffix that another page repeats has a place in the array and the length of its longest common block there."""
    r = random.Random(5)
    line = lambda n: [f"w{r.randrange(60)}" for _ in range(n)]
    shared = [line(n) for n in (8, 19, 40)]
    texts = {i: [w for _ in range(3) for w in [*line(r.randint(1, 6)), *r.choice(shared)]] for i in range(8)}
    pages = spark.createDataFrame([(i, "http://h/", "<p>" + " ".join(t)) for i, t in [*texts.items(), (0, texts[0])]], "page_id long, host string, html string")
    suffixes = pages.mapInArrow(html._streams(4), "key long, page_id long, stream long, place int, judged boolean")
    got = html.suffix_array(suffixes, 4).orderBy("path", "page_id", "place").collect()
    prefix = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    want = {}
    for i, t in texts.items():
        for p in range(len(t)):
            most = max(prefix(t[p:], u[q:]) for j, u in texts.items() if j != i for q in range(len(u)))
            if most >= 4:
                want[i, p] = max(4 * 2**k for k in range(8) if 4 * 2**k <= most)
    assert {(x.page_id, x.place): x.shared for x in got} == want and len(got) == len(want) and max(want.values()) == 32
    for n in (4, 8, 16, 32):  # suffixes with one prefix stand together
        heads = [tuple(texts[x.page_id][x.place : x.place + n]) for x in got if x.shared >= n]
        assert len(list(itertools.groupby(heads))) == len(set(heads))


def test_text_statistics_equal_python(spark):
    texts = ["", " ", "a b", "\t\x0b\x0c\r\n", "x\u00a0y\u2003z #*$%&|<>^ \U0001f600", "one\n\none\n \x0b\none\n", "a b c d e " * 3, "a b c d e f a b c d e\u0085q", "\\ [ ] ^ -"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "doc_id long, text string")
    got = {x.doc_id: x for x in quality.quality_rules(rows, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()}
    for i, t in enumerate([*texts, ""]):
        words = WORD.findall(t)
        windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
        lines = [x for x in t.split("\n") if WORD.search(x)]
        twice = {k + j for k, w in enumerate(windows) if windows.count(w) > 1 for j in range(5)}
        want = (len(words), sum(map(len, words)), sum(c in quality.SYMBOLS for c in t), len(lines) - len(set(lines)), len(twice))
        assert got[i][1:6] == want, t


def test_quality_threshold_comes_from_held_out_labels(spark, sf_dir):
    d, m = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    x = quality.quality_rules(d, m).toPandas()
    marks = m.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic")).toPandas()
    x = x.merge(marks, on="doc_id", how="left")
    clean, low = x[(x.quality == 1) & (x.toxic == 0) & ~x.base_failed], x[(x.quality == 0) & ~x.base_failed]
    assert clean.kept.mean() > 0.98 and low.kept.mean() < 0.6
    junk = x.n_symbols > 0.02 * x.word_chars
    fresh = x[x.quality.isna() & ~junk & ~x.base_failed]
    assert fresh.kept.mean() > 0.9  # about a twelfth of them is of low quality without symbols
    few = quality.quality_rules(d, m.limit(5)).where("not base_failed and not kept").count()
    assert few == 0
    fixed = quality.quality_rules(d, m, threshold=1e9)
    assert fixed.where("kept").count() == 0


def test_junk_list_has_every_family(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    listed = urls.junk_list(pages)
    assert {r.family for r in listed.select("family").distinct().collect()} == set(urls.JUNK_FAMILIES)
    got = urls.url_verdicts(pages, listed)
    junk = F.col("host").rlike("|".join(rf"(^|\.){f}" for f in urls.JUNK_FAMILIES))
    assert got.where(junk & F.col("rule").isNull() & (F.col("verdict") != "block")).count() == 0
    assert got.where(~junk & F.col("rule").isNull() & (F.col("verdict") != "allow")).count() == 0


def test_list_from_a_file(spark, tmp_path):
    (tmp_path / "list.txt").write_text("# junk\nhttp://www.a.com/x/?utm_source=1\n\nb.org/y\n")
    assert {r.canonical for r in urls.read_list(spark, str(tmp_path / "list.txt")).collect()} == {"a.com/x", "b.org/y"}


@pytest.fixture(scope="module")
def odd(spark):
    """Ids without a value, different texts under one id, nulls, and a text that both have."""
    long = " ".join(f"word{i}" for i in range(60))
    return spark.createDataFrame([(None, long), (None, None), (1, long), (1, "another text"), (2, None), (2, ""), (3, long), (3, long)], "doc_id long, text string")


def test_odd_ids(odd, rows):
    texts = {r.doc_id: r.text for r in common.one_text(odd).dropDuplicates(["doc_id"]).collect()}
    assert set(texts) == {1, 2, 3} and common.one_text(odd.where("doc_id = 3")).count() == 2
    near = {r.doc_id: r for r in neardup.near_duplicates(odd, shingle=4).collect()}
    assert set(near) == {1, 2, 3} and near[2].n_shingles == 0
    assert near[3].component_id == (1 if texts[1] != "another text" else 3)
    cut = {r.doc_id: r for r in substring.repeated_passages(odd, length=20)[0].collect()}
    assert set(cut) == {1, 2, 3} and cut[1].n_words == len(words(texts[1])) and cut[1].n_removed == 0
    media = {r.doc_id: r for r in chunks.media_features(odd).collect()}
    assert set(media) == {1, 2, 3} and media[1].n_bytes == len(texts[1])


def test_rows_without_an_id_are_packed(odd):
    pieces = packing.pack(odd, packing.public_tokenizer(), capacity=64).collect()
    assert sum(p.doc_tokens for p in pieces if p.start == 0) == sum(p.length for p in pieces)
    assert sum(p.start == 0 for p in pieces) == odd.count() and sum(p.doc_id is None and p.start == 0 for p in pieces) == 2


def test_media_columns_of_the_contract(docs, rows):
    got = {r.doc_id: r for r in chunks.media_features(docs).collect()}
    assert len(got) == len(rows)
    for d, t in rows:
        raw = (t or "").encode()
        payload = raw + b" " * (-len(raw) % 192 if raw else 192)
        media = chunks.wav(payload)
        x, r = np.frombuffer(payload, np.uint8), got[d]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
        assert r.feature.startswith(f"pcm8;mean={x.mean():.6f};rms={math.sqrt((x.astype(float) ** 2).mean()):.6f};") and r.feature.endswith(f"min={x.min()};max={x.max()}")


def test_pipeline_keeps_what_it_should(spark, tmp_path):
    import corpus_pipeline as cp

    sf = "/root/testdata/sf0.001"
    docs = cp.table(spark, sf, "documents")
    before = {r.doc_id: r for r in docs.collect()}
    for name, function in cp.STAGES[:-1]:
        out = common.stage(function(spark, docs, sf), "test")
        assert out.columns == cp.COLUMNS
        after = {r.doc_id for r in out.collect()}
        assert after and after <= set(before)
        docs = out
    for r in docs.collect():
        assert len(r.text) == r.n_chars
    pieces = cp.packing(spark, docs, sf)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.select("doc_id").collect()}


def test_pipeline_with_odd_rows(spark, docs, labels, tmp_path):
    """Nulls, no ids, repeated rows, two texts under one id, columns whose names the stages use; then an empty table."""
    import corpus_pipeline as cp

    odd = spark.createDataFrame([(None, "a text without an id " * 9), (7, "another text of an id that is there " * 9), (9001, None), (9002, ""), (None, None)], "doc_id long, text string")
    base = docs.select("doc_id", "text").union(docs.select("doc_id", "text")).unionByName(odd)
    more = base.withColumns({"lang": F.lit(None).cast("string"), "source": F.lit("s"), "n_chars": F.lit(None).cast("long"), "rate": F.lit(1), "_ratios": F.lit("x"), "_limit": F.lit(2.0), "_maybe": F.lit(True), "spans": F.lit("y")})
    more.write.parquet(str(tmp_path / "a" / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "a" / "labels.parquet"))
    pieces = cp.run(spark, str(tmp_path / "a")).toPandas()
    kept = set(pieces.doc_id.dropna().astype(int))
    assert kept and not kept & {9001, 9002}
    sequences = pieces.groupby("sequence_id").length.sum()
    assert (sequences <= 4096).all() and (pieces.groupby("sequence_id").offset.min() == 0).all()
    more.limit(0).write.parquet(str(tmp_path / "b" / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "b" / "labels.parquet"))
    assert cp.run(spark, str(tmp_path / "b")).count() == 0
    more.write.parquet(str(tmp_path / "c" / "documents.parquet"))
    labels.limit(0).write.parquet(str(tmp_path / "c" / "labels.parquet"))
    assert cp.run(spark, str(tmp_path / "c")).count() > 0  # without labels nothing but the base rules rejects


def test_all_trusted_documents_count(spark):
    """More trusted documents than any sample would hold: each is in the target counts or held out, and quantiles are of all."""
    labels = spark.range(30_000).selectExpr("id AS doc_id", "1 AS quality", "0 AS toxic")
    good = quality._trusted(labels)
    assert good.count() == 30_000 and 0.4 < good.where("held").count() / 30_000 < 0.6
    values = np.random.default_rng(2).normal(-1, 0.5, 20_001)
    q = quality._quantiles(spark.createDataFrame([(float(v),) for v in values] + [(None,)], "score double"), 0.5, quality.TAIL).first()
    assert q.n == 20_001 and np.allclose([q.q0, q.q1], np.quantile(values, [0.5, quality.TAIL]), atol=2 * quality.CELL)
    none = quality._quantiles(spark.createDataFrame([], "score double"), 0.5).first()
    assert none.n == 0 and none.q0 is None
