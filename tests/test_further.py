"""Regions, policies, grounded phrases and image headers: published examples and plain loops."""

from __future__ import annotations

import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import assign as A
from tessera.operators import metrics as E
from tessera.operators import policies as PL
from tessera.operators import sampling as S
from tessera.operators.matching import overlaps
from tessera.plans import convert as CV
from tessera.plans import views
from tessera.queries import QUERIES
from tessera.sources import annotations as N
from tessera.sources import images as IM

XY = "x1 double, y1 double, x2 double, y2 double"


def boxes(spark, rows, head):
    return spark.createDataFrame([(*r[: len(r) - 4], *map(float, r[-4:])) for r in rows], f"{head}, {XY}")


# ---------------------------------------------------------------- regions


def sets(spark, gts):
    priors = boxes(spark, [(i, 0, 0, *b) for i, b in enumerate([(0, 0, 10, 10), (10, 10, 20, 20), (5, 5, 15, 15), (32, 32, 38, 42)])], "prior_id long, image_id long, level int")
    gt = boxes(spark, [(i, 0, 2 + i, *b) for i, b in enumerate(gts)], "gt_id long, image_id long, label long")
    return priors, gt, spark.createDataFrame([(0, 256, 256)], "image_id long, width int, height int")


def test_published_regions(spark):
    """Four priors on one level of 64 x 64 cells, two boxes: the first prior has the first box, others are background."""
    priors, gt, images = sets(spark, [(0, 0, 10, 9), (0, 10, 10, 19)])
    got = {r.prior_id: (r.gt_id, r.state) for r in A.region(priors, gt, images, [1], [(64, 64)], 10, 0.5, 0.8).collect()}
    assert got == {0: (0, 1), 1: (None, 0), 2: (None, 0), 3: (None, 0)}
    got = {r.state for r in A.region(priors, gt.limit(0), images, [1], [(64, 64)], 10, 0.5).collect()}
    assert got == {0}
    assert A.region(priors.limit(0), gt, images, [1], [(64, 64)], 10, 0.5).collect() == []


def test_regions_on_neighbour_levels_and_borders(spark):
    """A box of side 64 fits level 1 of strides 8, 16, 32 at scale 4: ignored on levels 0 and 2, a later box wins."""
    strides, sizes = [8, 16, 32], [(16, 16), (8, 8), (4, 4)]
    rows, k = [], 0
    for level, (s, (r, c)) in enumerate(zip(strides, sizes, strict=True)):
        for y in range(r):
            for x in range(c):
                rows.append((k, 0, level, x * s - 2 * s, y * s - 2 * s, x * s + 2 * s, y * s + 2 * s))
                k += 1
    priors = boxes(spark, rows, "prior_id long, image_id long, level int")
    gts = [(32, 32, 96, 96), (48, 32, 112, 96)]
    _, gt, images = sets(spark, gts)
    images = images.withColumn("width", F.lit(128)).withColumn("height", F.lit(128))
    got = {r.prior_id: (r.gt_id, r.state) for r in A.region(priors, gt, images, strides, sizes, 4).collect()}
    half = lambda v: float(round(v))  # noqa: E731  (half to even)

    def span(b, share, stride):
        r = (1 - share) / 2
        return [half(((1 - r) * p + r * q) / stride) for p, q in ((b[0], b[2]), (b[1], b[3]), (b[2], b[0]), (b[3], b[1]))]

    for k, _, level, x1, y1, x2, y2 in rows:
        s = strides[level]
        x, y = (x1 + x2) / 2 / s, (y1 + y2) / 2 / s
        state = (None, 0)
        for i, b in enumerate(gts):
            if level == 1:
                a = span(b, 0.5, s)
                if a[0] <= x <= a[2] and a[1] <= y <= a[3]:
                    state = (None, -1)
                a = span(b, 0.2, s)
                if a[0] <= x <= a[2] and a[1] <= y <= a[3]:
                    state = (i, 1)
        if level != 1 and any(a[0] <= x <= a[2] and a[1] <= y <= a[3] for a in (span(b, 0.5, s) for b in gts)):
            state = (None, -1)
        if x1 < 0 or y1 < 0 or x2 >= 128 or y2 >= 128:
            state = (None, -1)
        assert got[k] == state, (k, level, x, y)


# ---------------------------------------------------------------- policies


def test_published_magnitudes(spark):
    levels = spark.createDataFrame([("ShearX", 4.0), ("ShearY", 0.0), ("Rotate", 10.0), ("TranslateX", 5.0), ("Color", 9.0)], "kind string, level double")
    got = {r.kind: r.m for r in levels.select("kind", PL.magnitude(F.col("kind"), F.col("level"), F.lit(0.5)).alias("m")).collect()}
    assert got == {"ShearX": 12.0, "ShearY": 0.0, "Rotate": 30.0, "TranslateX": 0.1, "Color": 0.0}
    assert len(PL.LEARNED) == 25 and all(len(p) == 2 for p in PL.LEARNED) and len(set(PL.SPACE)) == 15


def corners_after(b, step, w, h):
    m, points = step.magnitude, [(b[0], b[1]), (b[2], b[1]), (b[2], b[3]), (b[0], b[3])]
    t, c, s, cx, cy = math.tan(math.radians(m)), math.cos(math.radians(m)), math.sin(math.radians(m)), (w - 1) / 2, (h - 1) / 2
    move = {
        "ShearX": lambda x, y: (x + t * y, y),
        "ShearY": lambda x, y: (x, y + t * x),
        "Rotate": lambda x, y: (cx + c * (x - cx) - s * (y - cy), cy + s * (x - cx) + c * (y - cy)),
        "TranslateX": lambda x, y: (x + int(w * m), y),
        "TranslateY": lambda x, y: (x, y + int(h * m)),
    }.get(step.kind)
    if move is None:
        return b
    xs, ys = zip(*[move(*p) for p in points], strict=True)
    return [min(max(v, 0), e) for v, e in ((min(xs), w), (min(ys), h), (max(xs), w), (max(ys), h))]


@pytest.mark.parametrize("kind", ["learned", "random"])
def test_boxes_are_folded_over_the_steps_taken(spark, kind):
    r = random.Random(4)
    rows = [(i, i % 60, 320, 200 + i % 3, (x := r.uniform(0, 250)), (y := r.uniform(0, 150)), x + r.uniform(1, 60), y + r.uniform(1, 40)) for i in range(240)]
    df = boxes(spark, rows, "event_id long, image_id long, width int, height int")
    got = (PL.auto_augment(df, seed=3) if kind == "learned" else PL.rand_augment(df, count=3, seed=3)).collect()
    assert len(got) == len(rows)
    steps = {}
    for g in got:
        assert steps.setdefault(g.image_id, g.steps) == g.steps  # one draw for an image
        b = list(rows[g.event_id][-4:])
        for s in g.steps:
            b = corners_after(b, s, g.width, g.height)
        assert [g.x1, g.y1, g.x2, g.y2] == pytest.approx(b, abs=1e-6)
    signs = {math.copysign(1, s.magnitude) for x in steps.values() for s in x if s.magnitude}
    assert signs == {1.0, -1.0} and len({tuple(s.kind for s in x) for x in steps.values()}) > 10
    if kind == "random":
        assert all(len({s.kind for s in x}) == 3 for x in steps.values())
    again = (PL.auto_augment(df.repartition(7), seed=3) if kind == "learned" else PL.rand_augment(df.repartition(7), count=3, seed=3)).collect()
    assert sorted(again, key=str) == sorted(got, key=str)


# ---------------------------------------------------------------- grounded phrases


def test_adjacent_spans_are_one_phrase(spark):
    caption = "a red-brown fox on the moss"
    cases = {
        0: ([[2, 5], [6, 11], [12, 15]], ["red", "brown fox"]),  # only a blank joins, not a hyphen
        1: ([[19, 22], [0, 1], [2, 5]], ["a red", "the"]),  # sorted first
        2: ([[12, 15], [16, 18], [23, 27]], ["fox on", "moss"]),
        3: ([[0, 1], [12, 15]], ["a", "fox"]),
        4: ([], []),
        5: ([[0, 1], [0, 5]], ["a", "a red"]),
    }
    rows = [(k, s, caption) for k, (s, _) in cases.items()]
    got = {r.k: r.p for r in spark.createDataFrame(rows, "k int, s array<array<int>>, c string").select("k", CV.phrases_of(F.col("s"), F.col("c")).alias("p")).collect()}
    assert got == {k: p for k, (_, p) in cases.items()}


def test_regions_with_the_same_phrase_are_joined(spark):
    images = spark.createDataFrame([(1, "two dogs and a cat", 100, 50), (2, "nothing", 100, 50)], "image_id long, caption string, width int, height int")
    dogs, cat = [[0, 3], [4, 8]], [[15, 18]]
    rows = [
        (1, 1, [10.0, 10.0, 200.0, 20.0], 5.0, 0, dogs), (1, 2, [0.0, 0.0, 4.0, 4.0], 5.0, 0, cat), (1, 3, [5.0, 5.0, 8.0, 90.0], 5.0, 0, dogs),
        (1, 4, [100.0, 0.0, 4.0, 4.0], 5.0, 0, cat), (1, 5, [1.0, 1.0, 4.0, 4.0], 0.0, 0, cat), (1, 6, [1.0, 1.0, 4.0, 4.0], 5.0, 1, cat), (1, 7, [1.0, 1.0, 0.5, 4.0], 5.0, 0, cat),
        (2, 8, [1.0, 1.0, 1.0, 9.0], 5.0, 0, [[0, 7]]),
    ]
    a = spark.createDataFrame(rows, "image_id long, ann_id long, bbox array<double>, area double, crowd int, tokens_positive array<array<int>>")
    got = {r.key: (list(r.phrase), [list(b) for b in r.boxes], [list(s) for s in r.tokens_positive]) for r in CV.grounded(a, images).collect()}
    assert got == {"two dogs": (["two dogs"], [[10, 10, 100, 30], [5, 5, 13, 50]], dogs), "cat": (["cat"], [[0, 0, 4, 4]], cat)}


# ---------------------------------------------------------------- image headers


def jpeg(w, h, *segments, frame=0xC0, end=b"\xff\xd9"):
    body = b"".join(b"\xff" + bytes([m]) + struct.pack(">H", len(d) + 2) + d for m, d in segments)
    return b"\xff\xd8" + body + b"\xff\xff" + bytes([frame]) + struct.pack(">HBHHB", 11, 8, h, w, 1) + b"\x01\x11\x00" + end


def exif(order, turn):
    i = "<" if order == b"II" else ">"
    return (0xE1, b"Exif\0\0" + order + struct.pack(i + "HI", 42, 8) + struct.pack(i + "H", 2) + struct.pack(i + "HHIHH", 0x010F, 2, 1, 0, 0) + struct.pack(i + "HHIHH", 0x0112, 3, 1, turn, 0))


def test_sizes_from_headers(spark, tmp_path):
    png = b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + struct.pack(">II", 640, 480)
    files = {
        "a.png": (png, (640, 480)),
        "b.jpg": (jpeg(321, 123, (0xE0, b"JFIF\0" + bytes(9)), (0xDB, bytes(65))), (321, 123)),
        "progressive.jpg": (jpeg(70_00, 5, (0xC4, bytes(20)), frame=0xC2), (7000, 5)),
        "turned.jpg": (jpeg(300, 200, exif(b"MM", 6)), (200, 300)),
        "little.jpg": (jpeg(300, 200, exif(b"II", 8)), (200, 300)),
        "upright.jpg": (jpeg(300, 200, exif(b"II", 3)), (300, 200)),
        "bad-exif.jpg": (jpeg(300, 200, (0xE1, b"Exif\0\0MM\0")), (300, 200)),
        "c.gif": (b"GIF89a" + struct.pack("<HH", 12, 34), (12, 34)),
        "d.bmp": (b"BM" + bytes(12) + struct.pack("<Iii", 40, 99, -77), (99, 77)),
        "cut.png": (png[:18], (None, None)),
        "cut.jpg": (jpeg(321, 123)[:9], (None, None)),
        "no-frame.jpg": (b"\xff\xd8\xff\xda" + bytes(40), (None, None)),
        "text.txt": (b"not an image", (None, None)),
    }
    (tmp_path / "deep").mkdir()
    for i, (name, (data, _)) in enumerate(files.items()):
        (tmp_path / ("deep" if i % 2 else ".") / name).write_bytes(data)
    got = {r.file_name: (r.width, r.height) for r in IM.read_image_sizes(spark, str(tmp_path)).collect()}
    assert got == {name: size for name, (_, size) in files.items()}
    assert {r.file_name for r in IM.read_image_sizes(spark, str(tmp_path), "*.png").collect()} == {"a.png", "cut.png"}
    (tmp_path / "empty.jpg").write_bytes(b"")
    assert IM.read_image_sizes(spark, str(tmp_path)).count() == len(files) and IM.size_of(b"") is None
    (tmp_path / "list.csv").write_text("ImageID,LabelName\nx1,/m/1\nx1,/m/2\nx2,/m/1\n")
    assert {r.file_name for r in IM.names_in_csv(spark, str(tmp_path / "list.csv")).collect()} == {"x1.jpg", "x2.jpg"}


# ---------------------------------------------------------------- draws and hierarchies


def test_draws_of_negative_ids(spark):
    ids = [*range(-50, 50), -(2**62), 2**62]
    got = [r.u for r in spark.createDataFrame([(i,) for i in ids], "id long").select(S.draw(3, "id").alias("u")).collect()]
    assert all(0 <= u < 1 for u in got) and len(set(got)) > 95


def test_weighted_draws_with_many_rows(spark):
    """Weights from 0 to 3 over 5,000 rows: expected counts, rows of weight 0 never, and the same draws as a plain search."""
    rows = spark.range(5000).select("id", (F.col("id") % 4).cast("double").alias("w"))
    got = {r.draw: r.id for r in S.with_replacement(rows, F.col("w"), 3000, "id").collect()}
    assert sorted(got) == list(range(3000)) and all(i % 4 for i in got.values())
    share = sum(1 for i in got.values() if i % 4 == 3) / 3000
    assert abs(share - 0.5) < 0.04


def test_a_class_without_a_parent_is_a_root(spark):
    e = spark.createDataFrame([("dog", "animal"), ("cat", "animal"), ("animal", None), ("rock", None), ("puppy", "dog")], "child string, parent string")
    got = {(r.child, r.ancestor) for r in N.ancestors(e).collect()}
    assert got == {("dog", "dog"), ("dog", "animal"), ("cat", "cat"), ("cat", "animal"), ("animal", "animal"), ("rock", "rock"), ("puppy", "puppy"), ("puppy", "dog"), ("puppy", "animal")}


# ---------------------------------------------------------------- measures over images

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    return views.detections(spark, SF).toPandas(), views.ground_truth(spark, SF).toPandas()


C = ["x1", "y1", "x2", "y2"]


def test_crowd_matches(spark, tables):
    det, gt = tables
    want = {}
    for image, d in det.groupby("image_id"):
        g = gt[gt.image_id == image]
        real, out = g[g.ignored == 0], g[g.ignored != 0]
        taken = set()
        for r in d.sort_values(["score", "det_id"], ascending=[False, True]).itertuples():
            b = np.array([[r.x1, r.y1, r.x2, r.y2]])
            best, at = 0.5, None
            for k in real.sort_values("gt_id").itertuples():
                v = overlaps(b, np.array([[k.x1, k.y1, k.x2, k.y2]]))[0, 0]
                if k.gt_id not in taken and v > best:
                    best, at = v, k.gt_id
            if at is not None:
                taken.add(at)
                want[r.det_id] = 1
                continue
            inter = [max(0, min(r.x2, k.x2) - max(r.x1, k.x1)) * max(0, min(r.y2, k.y2) - max(r.y1, k.y1)) for k in out.itertuples()]
            if not any(i / ((r.x2 - r.x1) * (r.y2 - r.y1)) > 0.5 for i in inter):
                want[r.det_id] = 0
    assert {r.det_id: r.tp for r in QUERIES["crowd_matches"](spark, SF).collect()} == want
    assert set(want.values()) == {0, 1} and len(want) < len(det)


def test_grounded_f1(spark):
    """Four expressions: all found, one of two found, rightly and wrongly nothing said of none, and one missed."""
    far = lambda k: (100.0 * k, 0.0, 100.0 * k + 50, 50.0)
    gt = boxes(spark, [(1, 1, 0, *far(0)), (1, 2, 0, *far(1)), (2, 3, 0, *far(0)), (2, 4, 0, *far(1)), (3, 5, 1, 0, 0, 0, 0), (4, 6, 1, 0, 0, 0, 0), (5, 7, 0, *far(0))], "image_id long, gt_id long, no_target int")
    pred = boxes(spark, [(1, 1, 0.9, *far(0)), (1, 2, 0.7, *far(1)), (1, 3, 0.69, *far(2)), (2, 4, 0.9, *far(0)), (2, 5, 0.9, *far(0)), (4, 6, 0.8, *far(0)), (5, 7, 0.1, *far(0))], "image_id long, pred_id long, score double")
    got = E.grounded_f1(pred, gt).first()
    assert (got.f1_score, got.t_acc, got.n_acc) == (pytest.approx(2 / 5), pytest.approx(2 / 3), pytest.approx(1 / 2))
    assert E.grounded_f1(pred, gt, least_f1=0.5).first().f1_score == pytest.approx(3 / 5)  # the second has 1 of 2 and 1 of 2
    none = E.grounded_f1(pred, gt.limit(0)).first()
    assert none.f1_score is None or none.f1_score == 0


def test_grounded_f1_takes_the_nearest_pairs_first(spark, tables):
    det, gt = tables
    good = cases = 0
    for image, g in gt.groupby("image_id"):
        d = det[(det.image_id == image) & (det.score >= 0.7) & ((image % 14 != 0) | (det.score < 0.7))]
        cases += 1
        if image % 7 == 0:
            good += not len(d)
            continue
        o = overlaps(d[C].to_numpy(), g[C].to_numpy()) if len(d) else np.zeros((0, len(g)))
        tp = 0
        while o.size and o.max() >= 0.5:
            i, j = np.unravel_index(o.argmax(), o.shape)
            o[i], o[:, j], tp = -1, -1, tp + 1
        good += 2 * tp / (len(d) + len(g)) >= 0.4
    assert QUERIES["grounded_f1"](spark, SF).first().f1_score == pytest.approx(good / cases, abs=1e-8)
    assert 0 < good < cases


def test_splits_are_means_of_their_classes(spark):
    by_class = {r.label: (r.map, r.map_50) for r in QUERIES["coco_by_class"](spark, SF).collect()}
    got = {r.split: (r.ap, r.ap50) for r in QUERIES["split_summary"](spark, SF).collect()}
    for split, labels in (("seen", (0, 1, 2)), ("new", (3, 4))):
        have = [by_class[k] for k in labels if k in by_class]
        assert got[split] == pytest.approx(tuple(np.mean(have, axis=0)), abs=1e-7)


def test_frames_are_dealt_evenly(spark):
    f = spark.range(10).selectExpr("id % 3 AS video_id", "id AS frame_id")
    got = S.shuffled_frames(f, 4, seed=1).collect()
    assert len(got) == 12 and len({(r.video_id, r.frame_id) for r in got}) == 10 and len({(r.worker, r.place) for r in got}) == 12
    few = S.shuffled_frames(f.limit(2), 5, seed=1).collect()
    assert {(r.worker, r.place) for r in few} == {(w, 0) for w in range(5)}
    runs = {r.video_id: r.worker for r in S.frames_in_order(spark.range(8).selectExpr("id AS video_id", "0 AS frame_id"), 3).collect()}
    assert [runs[v] for v in range(8)] == [0, 0, 0, 1, 1, 1, 2, 2]
    assert {r.worker for r in S.frames_in_order(spark.range(2).selectExpr("id AS video_id", "0 AS frame_id"), 3).collect()} == {0, 1}
