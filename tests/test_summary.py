"""Summaries against published values and a plain dense implementation."""

from __future__ import annotations

import numpy as np
import pytest

from tessera.operators import metrics, summary, tracking
from tessera.operators.matching import overlaps

COLS = "x1 double, y1 double, x2 double, y2 double"
BOXES = [(50, 60, 70, 80), (100, 120, 130, 150), (150, 160, 190, 200), (250, 260, 350, 360)]
NAMES = ["map", "map_50", "map_75", "map_s", "map_m", "map_l"]


def perfect(spark):
    labels, scores = (0, 0, 1, 0), (1.0, 0.98, 0.96, 0.95)
    gt = spark.createDataFrame([(i, 0, c, 0, *map(float, b)) for i, (c, b) in enumerate(zip(labels, BOXES, strict=True))], f"gt_id long, image_id long, label long, ignored int, {COLS}")
    det = spark.createDataFrame([(i, 0, c, s, *map(float, b)) for i, (c, s, b) in enumerate(zip(labels, scores, BOXES, strict=True))], f"det_id long, image_id long, label long, score double, {COLS}")
    return det, gt


def test_identical_boxes(spark):
    det, gt = perfect(spark)
    r = summary.coco_summary(det, gt).first()
    assert [r[n] for n in NAMES] == pytest.approx([1.0] * 6)
    assert (r.ar_1, r.ar_10, r.ar_100) == pytest.approx(((1 / 3 + 1) / 2, 1.0, 1.0))
    images = spark.createDataFrame([(0, [], [])], "image_id long, negative array<long>, not_exhaustive array<long>")
    kinds = spark.createDataFrame([(0, "c"), (1, "f")], "label long, frequency string")
    r = summary.lvis_summary(det, gt, images, kinds).first()
    assert [r[n] for n in ("ap", "ap50", "ap75", "aps", "apm", "apl", "apc", "apf")] == pytest.approx([1.0] * 8) and r.apr == -1.0
    none = summary.coco_summary(det, gt.limit(0)).first()
    assert none.map == -1.0 and summary.coco_summary(det.limit(0), gt).first().map == 0.0


def dense(det, gt, areas, most, per_unit=True, lenient=frozenset()):
    """(map by class, threshold and area; recall) by loops over all pairs. Rows: (id, unit, label, score, ignored, crowd, box)."""
    out = {}
    for a, (low, high) in enumerate(areas):
        for label in {g[2] for g in gt}:
            size = lambda b: (b[2] - b[0]) * (b[3] - b[1])
            n = sum(g[2] == label and not g[4] and not g[5] and low <= size(g[6]) <= high for g in gt)
            if not n:
                continue
            for t in range(10):
                rows, hits = [], 0
                for unit in {d[1] for d in det} | {g[1] for g in gt}:
                    ds = sorted([d for d in det if d[1] == unit and d[2] == label], key=lambda d: (-d[3], d[0]))[:most]
                    gs = sorted([g for g in gt if g[1] == unit and g[2] == label], key=lambda g: (bool(g[4] or g[5] or not low <= size(g[6]) <= high), g[0]))
                    skip = [bool(g[4] or g[5] or not low <= size(g[6]) <= high) for g in gs]
                    taken = set()
                    for d in ds:
                        best, m = min(0.5 + 0.05 * t, 1 - 1e-10), -1
                        for j, g in enumerate(gs):
                            if j in taken and not g[5]:
                                continue
                            if m > -1 and not skip[m] and skip[j]:
                                break
                            o = overlaps(np.array([d[6]], float), np.array([g[6]], float), np.array([bool(g[5])]))[0, 0]
                            if o >= best:
                                best, m = o, j
                        if m >= 0:
                            taken.add(m)
                            if not skip[m]:
                                rows.append((-d[3], d[0], 1))
                        elif low <= size(d[6]) <= high and (unit, label) not in lenient:
                            rows.append((-d[3], d[0], 0))
                rows.sort()
                tp = np.cumsum([r[2] for r in rows]) if rows else np.zeros(0)
                fp = np.cumsum([1 - r[2] for r in rows]) if rows else np.zeros(0)
                rc, pr = tp / n, tp / np.maximum(tp + fp, 1)
                out[label, t, a] = (np.mean([pr[rc >= r].max() if (rc >= r).any() else 0.0 for r in np.linspace(0, 1, 101)]), rc.max() if len(rc) else 0.0)
    return out


def random_rows(seed):
    r = np.random.default_rng(seed)
    gt, det = [], []
    for i in range(90):
        x, y, s = r.integers(0, 150), r.integers(0, 150), int(r.choice([12, 28, 50, 70, 120]))
        box = (float(x), float(y), float(x + s), float(y + s))
        gt.append((i, int(r.integers(0, 6)), int(r.integers(0, 3)), 0.0, int(r.random() < 0.1), int(r.random() < 0.1), box))
        for _ in range(int(r.integers(0, 3))):
            d = r.integers(-4, 5, 4)
            det.append((len(det), gt[-1][1], gt[-1][2] if r.random() < 0.9 else 0, float(np.round(r.random(), 2)), 0, 0, tuple(float(v) for v in np.array(box) + d * s / 50)))
    return gt, det


def frames_of(spark, gt, det):
    g = spark.createDataFrame([(*r[:3], r[4], r[5], *r[6]) for r in gt], f"gt_id long, image_id long, label long, ignored int, crowd int, {COLS}")
    d = spark.createDataFrame([(*r[:4], *r[6]) for r in det], f"det_id long, image_id long, label long, score double, {COLS}")
    return g, d


def test_coco_summary_equals_loops(spark):
    gt, det = random_rows(1)
    g, d = frames_of(spark, gt, det)
    for most in (100, 3):
        r = summary.coco_summary(d, g, (1, 2, most)).first()
        want = dense(det, gt, summary.AREAS, most)
        mean = lambda k, ok: np.mean([v[k] for key, v in want.items() if ok(*key)] or [-1.0])
        assert r.map == pytest.approx(mean(0, lambda c, t, a: a == 0)) and 0.1 < r.map < 0.99
        assert r.map_50 == pytest.approx(mean(0, lambda c, t, a: a == 0 and t == 0)) and r.map_75 == pytest.approx(mean(0, lambda c, t, a: a == 0 and t == 5))
        assert [r.map_s, r.map_m, r.map_l] == pytest.approx([mean(0, lambda c, t, a, k=k: a == k) for k in (1, 2, 3)])
        assert [r[f"ar_{most}"], r.ar_s, r.ar_m, r.ar_l] == pytest.approx([mean(1, lambda c, t, a, k=k: a == k) for k in range(4)])
    rows = {x.label: x.map for x in summary.coco_summary(d, g, by_class=True).collect()}
    want = dense(det, gt, summary.AREAS, 100)
    assert rows == pytest.approx({c: np.mean([want[c, t, 0][0] for t in range(10)]) for c in rows})


def test_lvis_summary_equals_loops(spark):
    gt, det = random_rows(2)
    gt = [(*g[:5], 0, g[6]) for g in gt]
    g, d = frames_of(spark, gt, det)
    images = spark.createDataFrame([(i, [2] if i % 2 else [], [0] if i < 2 else []) for i in range(6)], "image_id long, negative array<long>, not_exhaustive array<long>")
    kinds = spark.createDataFrame([(0, "r"), (1, "c"), (2, "c")], "label long, frequency string")
    has = {(x[1], x[2]) for x in gt} | {(i, 2) for i in range(1, 6, 2)}
    judged = [x for x in det if (x[1], x[2]) in has]
    want = dense(judged, gt, summary.AREAS, None, lenient={(0, 0), (1, 0)})
    r = summary.lvis_summary(d, g, images, kinds).first()
    mean = lambda ok: np.mean([v[0] for key, v in want.items() if ok(*key)] or [-1.0])
    assert [r.ap, r.ap50, r.ap75, r.aps] == pytest.approx([mean(lambda c, t, a: a == 0), mean(lambda c, t, a: a == 0 and t == 0), mean(lambda c, t, a: a == 0 and t == 5), mean(lambda c, t, a: a == 1)])
    assert [r.apr, r.apc, r.apf] == pytest.approx([mean(lambda c, t, a: a == 0 and c == 0), mean(lambda c, t, a: a == 0 and c > 0), -1.0])
    few = sorted(det, key=lambda x: (-x[3], x[0]))
    best = [x for c in range(3) for x in [y for y in few if y[2] == c][:7]]
    assert {x.det_id for x in summary._top_of_class(d, 7, cells=4).collect()} == {x[0] for x in best}
    fixed = summary.lvis_summary(d, g, images, kinds, most=None, most_in_class=7).first()
    want = dense([x for x in best if (x[1], x[2]) in has], gt, summary.AREAS, None, lenient={(0, 0), (1, 0)})
    assert fixed.ap == pytest.approx(mean(lambda c, t, a: a == 0))


def test_video_summary(spark):
    box = (100.0, 100.0, 150.0, 150.0)
    rows = [(1, 1, 0, 0, 1.0, *box), (1, 1, 0, 1, 1.0, *box), (2, 2, 0, 0, 1.0, *box)]
    t = spark.createDataFrame(rows, f"video_id long, track_id long, label long, frame_id long, score double, {COLS}")
    r = summary.video_summary(t, t).first()
    assert [r[n] for n in NAMES] == pytest.approx([1.0, 1.0, 1.0, 1.0, -1.0, -1.0])
    half = summary.video_summary(t.where("frame_id = 0"), t).first()  # video 1: half of the frames, IoU 0.5
    assert half.map_50 == pytest.approx(1.0) and half.map_75 == pytest.approx(51 / 101)


def test_higher_order_accuracy(spark):
    g = [(0, f, i, 0.0, 0.0, 100.0, 100.0) for f in (0, 1) for i in (1, 2)]
    p = [(0, f, i, 0.0, 0.0, 100.0, h) for f in (0, 1) for i, h in ((1, 100.0), (2, 40.0))]
    schema = f"video_id long, frame_id long, track_id long, {COLS}"
    r = tracking.higher_order_accuracy(spark.createDataFrame(p, schema), spark.createDataFrame(g, schema)).first()
    assert r.hota == pytest.approx(0.755, abs=1e-3)
    same = tracking.higher_order_accuracy(spark.createDataFrame(g[:1], schema), spark.createDataFrame(g[:1], schema)).first()
    assert (same.hota, same.deta, same.assa) == (1.0, 1.0, 1.0)
    swapped = [(0, f, 1 if f else 2, *b[3:]) for f, b in enumerate(g[:2])]
    one = [(0, f, 1, *b[3:]) for f, b in enumerate(g[:2])]
    r = tracking.higher_order_accuracy(spark.createDataFrame(swapped, schema), spark.createDataFrame(one, schema)).first()
    assert (r.deta, r.assa) == pytest.approx((1.0, 0.5))


def test_jaccard_index(spark):
    b = [(1330, 317, 418, 1338), (792, 24, 723, 2017), (693, 291, 307, 894), (522, 290, 285, 826), (728, 336, 175, 602), (92, 337, 267, 681)]
    rows = [(0, 1.0, 0, float(x), float(y), float(x + w), float(y + h)) for x, y, w, h in b]
    t = spark.createDataFrame(rows, f"image_id long, score double, ignored int, {COLS}")
    assert metrics.jaccard_index(t, t).first().ji == pytest.approx(1.0, abs=1e-4)
    # two images: one with a false box in an ignored region, one where a low score is wrong
    det = [(1, 0.9, 0, 0.0, 0.0, 10.0, 10.0), (1, 0.9, 0, 52.0, 52.0, 58.0, 58.0), (2, 0.9, 0, 0.0, 0.0, 10.0, 10.0), (2, 0.15, 0, 30.0, 30.0, 40.0, 40.0)]
    gt = [(1, 1.0, 0, 0.0, 0.0, 10.0, 10.0), (1, 1.0, 1, 50.0, 50.0, 60.0, 60.0), (2, 1.0, 0, 0.0, 0.0, 10.0, 10.0)]
    ji = lambda s: metrics.jaccard_index(spark.createDataFrame(det, t.schema), spark.createDataFrame(gt, t.schema), scores=s).first().ji
    assert ji((0.0,)) == pytest.approx(0.75, abs=1e-4) and ji((0.0, 0.2)) == pytest.approx(1.0, abs=1e-4)


def test_maximum_matching_beats_greedy():
    near = np.array([[True, True], [True, False]])
    assert len(metrics._most_pairs(near)) == 2


def test_rows_are_not_multiplied_by_ranges_and_thresholds(spark):
    """A detection stays one row, with bits for 4 ranges and 10 thresholds, and is not sorted once for each."""
    gt, det = random_rows(5)
    g, d = frames_of(spark, gt, det)
    x = summary.evaluate(*summary._image_tables(d, g))
    assert x.count() == x.select("det_id").distinct().count() == len(det)
    assert dict(x.dtypes)["tp"] == "bigint"


def test_cells_go_on_from_batch_to_batch(spark):
    """All scores are equal, so that a class is one cell, in batches of 7 rows."""
    gt, det = random_rows(6)
    det = [(*r[:3], 0.5, *r[4:]) for r in det]
    g, d = frames_of(spark, gt, det)
    want = dense(det, gt, summary.AREAS, 100)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "7")
    try:
        matched = summary.evaluate(*summary._image_tables(d, g))
        counts = summary._counted(summary._image_tables(d, g)[1], summary.AREAS)
        rows = summary.precisions(matched, counts).collect()
    finally:
        spark.conf.set(key, before)
    assert len(rows) == len(want) and any(0.05 < r.ap < 0.95 for r in rows)
    assert {(r.label, r.t, r.area): r.ap for r in rows} == pytest.approx({k: v[0] for k, v in want.items()})
