"""Registered queries that no SQL twin expresses, against plain loops over the smallest tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from tessera.operators.matching import overlaps
from tessera.plans import views
from tessera.queries import QUERIES

SF = "/root/testdata/sf0.001"
C = ["x1", "y1", "x2", "y2"]


@pytest.fixture(scope="module")
def tables(spark):
    return views.detections(spark, SF).toPandas(), views.ground_truth(spark, SF).toPandas()


def by_score(d):
    return d.sort_values(["score", "det_id"], ascending=[False, True])


def ap_of(rows, n):
    """Area under the precision envelope; rows (score, det_id, tp, fp)."""
    rows = sorted(rows, key=lambda r: (-r[0], r[1]))
    tp, fp = np.cumsum([r[2] for r in rows]), np.cumsum([r[3] for r in rows])
    if not len(rows) or not n:
        return 0.0
    pr = np.where(tp + fp > 0, tp / np.maximum(tp + fp, 1), 0.0)
    rc = tp / n
    area = 0.0
    for i in range(len(rows)):
        area += (rc[i] - (rc[i - 1] if i else 0.0)) * pr[i:].max()
    return area


def default_hits(det, gt, threshold):
    """{det_id: (tp, fp)}: each detection on its best ground truth, the first by score on it."""
    out = {}
    for (image, label), d in det.groupby(["image_id", "label"]):
        g = gt[(gt.image_id == image) & (gt.label == label)].sort_values(["ignored", "gt_id"])
        taken = set()
        for r in by_score(d).itertuples():
            o = overlaps(np.array([[r.x1, r.y1, r.x2, r.y2]]), g[C].to_numpy())[0] if len(g) else np.zeros(0)
            j = int(o.argmax()) if len(o) else -1
            if j < 0 or o[j] < threshold:
                out[r.det_id] = (0, 1)
            elif g.ignored.iloc[j]:
                out[r.det_id] = (0, 0)
            else:
                out[r.det_id] = (0, 1) if j in taken else (1, 0)
                taken.add(j)
    return out


def test_soft_suppression(spark, tables):
    det, _ = tables
    got = {r.det_id: r.score for r in QUERIES["soft_suppression"](spark, SF).collect()}
    want = {}
    for _, d in det.groupby(["image_id", "label"]):
        left = {r.det_id: [r.score, np.array([[r.x1, r.y1, r.x2, r.y2]])] for r in d.itertuples()}
        while left:
            i = min(left, key=lambda k: (-left[k][0], k))
            score, box = left.pop(i)
            want[i] = score
            for k in list(left):
                left[k][0] *= np.exp(-(overlaps(box, left[k][1])[0, 0] ** 2) / 0.5)
                if left[k][0] <= 1e-3:
                    del left[k]
    assert got == pytest.approx(want, abs=1e-8)


def test_weighted_fusion(spark, tables):
    det, _ = tables
    got = sorted((r.image_id, r.label, r.members, r.score, r.x1, r.y2) for r in QUERIES["weighted_fusion"](spark, SF).collect())
    want = []
    for (image, label), d in det.groupby(["image_id", "label"]):
        w = np.where(d.det_id % 2 == 0, 2.0, 1.0)
        d = d.assign(w=w, s=d.score * w).sort_values(["s", "det_id"], ascending=[False, True])
        clusters = []
        for r in d.itertuples():
            box = np.array([r.x1, r.y1, r.x2, r.y2])
            o = [overlaps(box[None], c["box"][None])[0, 0] for c in clusters]
            if o and max(o) > 0.55:
                c = clusters[int(np.argmax(o))]
                c["in"].append((r.s, box))
                total = sum(s for s, _ in c["in"])
                c["box"] = sum(s * b for s, b in c["in"]) / total
            else:
                clusters.append({"in": [(r.s, box)], "box": box})
        for c in clusters:
            n = len(c["in"])
            want.append((image, label, n, np.mean([s for s, _ in c["in"]]) * min(2, n) / 3.0, c["box"][0], c["box"][3]))
    assert len(got) == len(want)
    np.testing.assert_allclose(np.array(got, float), np.array(sorted(want), float), atol=2e-6)


def test_free_greedy_matching(spark, tables):
    """Own thresholds for small boxes, each ground truth once, those that count first."""
    det, gt = tables
    hits = {}
    for (image, label), d in det.groupby(["image_id", "label"]):
        g = gt[(gt.image_id == image) & (gt.label == label)].sort_values(["ignored", "gt_id"])
        box = g[C].to_numpy() - 1.0
        w, h = box[:, 2] - box[:, 0], box[:, 3] - box[:, 1]
        need = np.minimum(w * h / ((w + 10) * (h + 10)), 0.5)
        taken = set()
        for r in by_score(d).itertuples():
            o = overlaps(np.array([[r.x1, r.y1, r.x2, r.y2]]), box)[0] if len(g) else []
            free = [(o[j], -j) for j in range(len(g)) if j not in taken and o[j] >= need[j]]
            if free:
                j = -max(free)[1]
                taken.add(j)
                hits[r.det_id] = (int(not g.ignored.iloc[j]), 0)
            else:
                hits[r.det_id] = (0, 1)
    for r in QUERIES["map_imagenet"](spark, SF).collect():
        rows = [(d.score, d.det_id, *hits[d.det_id]) for d in det[det.label == r.label].itertuples()]
        n = int(((gt.label == r.label) & (gt.ignored == 0)).sum())
        assert (r.num_gts, r.ap) == (n, pytest.approx(ap_of(rows, n), abs=1e-6))


def test_group_matching(spark, tables):
    det, gt = tables
    single, group = gt[gt.group_of == 0].assign(ignored=0), gt[gt.group_of == 1]
    first, rows = default_hits(det, single, 0.5), {}
    best = {}
    for r in det.itertuples():
        if first[r.det_id][0]:
            rows[r.det_id] = (1, 0)
            continue
        g = group[(group.image_id == r.image_id) & (group.label == r.label)].sort_values("gt_id")
        inter = np.clip(np.minimum(r.x2, g.x2) - np.maximum(r.x1, g.x1), 0, None) * np.clip(np.minimum(r.y2, g.y2) - np.maximum(r.y1, g.y1), 0, None)
        part = (inter / ((r.x2 - r.x1) * (r.y2 - r.y1))).to_numpy()
        if len(part) and part.max() >= 0.5:
            best.setdefault(int(g.gt_id.iloc[int(part.argmax())]), []).append((r.score, -r.det_id))
        else:
            rows[r.det_id] = first[r.det_id]
    for found in best.values():
        rows[-max(found)[1]] = (1, 0)
    for r in QUERIES["map_openimages"](spark, SF).collect():
        own = [(d.score, d.det_id, *rows[d.det_id]) for d in det[det.label == r.label].itertuples() if d.det_id in rows]
        n = int((gt.label == r.label).sum())
        assert (r.num_gts, r.ap) == (n, pytest.approx(ap_of(own, n), abs=1e-6))


def test_proposal_recall(spark, tables):
    det, gt = tables
    found = {5: [], 20: [], 100: []}
    for image, g in gt[gt.ignored == 0].groupby("image_id"):
        d = by_score(det[det.image_id == image])
        for top, out in found.items():
            o = overlaps(g[C].to_numpy(), d.head(top)[C].to_numpy()) if len(d) else np.zeros((len(g), 0))
            for _ in range(len(g)):
                if not o.size:
                    out.append(0.0)
                    continue
                i, j = np.unravel_index(int(o.argmax()), o.shape)
                out.append(max(o[i, j], 0.0))
                o[i, :], o[:, j] = -1, -1
    got = {(r.top, r.threshold): r.recall for r in QUERIES["proposal_recall"](spark, SF).collect()}
    assert got == pytest.approx({(k, t): np.mean(np.array(v) >= t) for k, v in found.items() for t in (0.5, 0.6, 0.7, 0.8)}, abs=1e-8)


def test_image_scores_and_error_steps(spark, tables):
    det, gt = tables
    hits = {t: default_hits(det, gt, t) for t in (0.75, 0.5, 0.1)}
    scores = {}
    for image, g in gt.groupby("image_id"):
        d = det[det.image_id == image]
        aps = [ap_of([(r.score, r.det_id, *hits[0.5][r.det_id]) for r in d[d.label == c].itertuples()], n) for c in g.label.unique() if (n := int(((g.label == c) & (g.ignored == 0)).sum()))]
        if aps:
            scores[image] = np.mean(aps)
    got = QUERIES["image_scores"](spark, SF).toPandas()
    want = sorted(scores, key=lambda i: (-round(scores[i], 9), i))[:20]
    assert got[got.part == "best"].sort_values(["score", "image_id"], ascending=[False, True]).image_id.tolist() == want
    assert dict(zip(got.image_id, got.score, strict=True)) == pytest.approx({i: scores[i] for i in got.image_id}, abs=1e-8)
    other, kin = set(), set()
    for r in det.itertuples():
        g = gt[(gt.image_id == r.image_id) & (gt.label != r.label)]
        o = overlaps(np.array([[r.x1, r.y1, r.x2, r.y2]]), g[C].to_numpy())[0] if len(g) else np.zeros(0)
        near = g[o >= 0.1]
        other |= {r.det_id} if len(near) else set()
        kin |= {r.det_id} if (near.label % 2 == r.label % 2).any() else set()
    forgiven = {"C75": (0.75, set()), "C50": (0.5, set()), "Loc": (0.1, set()), "Sim": (0.1, kin), "Oth": (0.1, other), "BG": (0.1, set(det.det_id))}
    rows = QUERIES["error_steps"](spark, SF).collect()
    assert len(rows) == 30
    for r in rows:
        t, skip = forgiven[r.step]
        own = [(d.score, d.det_id, hits[t][d.det_id][0], 0 if d.det_id in skip else hits[t][d.det_id][1]) for d in det[det.label == r.label].itertuples()]
        assert r.ap == pytest.approx(ap_of(own, int(((gt.label == r.label) & (gt.ignored == 0)).sum())), abs=1e-8), (r.step, r.label)


def test_cluster_sizes(spark):
    b = views.boxes(spark, SF).toPandas()
    w, h = (b.x2 - b.x1).to_numpy(), (b.y2 - b.y1).to_numpy()
    pick = lambda v, q: np.sort(v)[max(0, int(np.ceil(q * len(v))) - 1)]
    centres = np.array([(pick(w, (i + 0.5) / 5), pick(h, (i + 0.5) / 5)) for i in range(5)])
    for _ in range(10):
        inter = np.minimum(w[:, None], centres[:, 0]) * np.minimum(h[:, None], centres[:, 1])
        near = (inter / ((w * h)[:, None] + centres.prod(1) - inter)).argmax(1)
        new = np.array([(w[near == i].mean(), h[near == i].mean()) if (near == i).any() else centres[i] for i in range(5)])
        if np.allclose(new, centres, atol=0, rtol=0):
            break
        centres = new
    want = sorted(map(tuple, centres), key=lambda c: c[0] * c[1])
    got = QUERIES["cluster_sizes"](spark, SF).toPandas().sort_values("cluster")
    np.testing.assert_allclose(got[["width", "height"]].to_numpy(), np.array(want), atol=1e-5)


def test_summaries_of_the_test_views(spark, tables):
    from tessera.operators import summary

    from .test_summary import dense

    det, gt = tables
    d = [(r.det_id, r.image_id, r.label, r.score, 0, 0, (r.x1, r.y1, r.x2, r.y2)) for r in det.itertuples()]
    g = [(r.gt_id, r.image_id, r.label, 0.0, r.ignored, 0, (r.x1, r.y1, r.x2, r.y2)) for r in gt.itertuples()]
    want = dense(d, g, summary.AREAS, 100)
    got = QUERIES["coco_by_class"](spark, SF).toPandas()
    assert isinstance(got, pd.DataFrame)
    assert dict(zip(got.label, got["map"], strict=True)) == pytest.approx({c: np.mean([want[c, t, 0][0] for t in range(10)]) for c in got.label}, abs=1e-8)
