"""Assignment of ground truth to priors (candidate boxes or points) of the same image.

``priors``: prior_id, image_id, corners (and level, score by label where needed); ``gt``: gt_id, image_id, label, corners.
Results have a row for each prior: gt_id (null: background), state (1 positive, 0 background, -1 ignored). Set-based rules
are windows over the join on image_id; the one-to-one rules solve an assignment problem for each image.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.boxes import EPS, Box, giou, iof, iou
from .groups import walk_groups

CORNERS = ("x1", "y1", "x2", "y2")
INF = 100_000_000.0


def _p() -> Box:
    return Box.named("p_")


def _g() -> Box:
    return Box.named("g_")


def crossed(priors: DataFrame, gt: DataFrame) -> DataFrame:
    """Every prior with every ground truth of its image, and their IoU."""
    p = priors.withColumnsRenamed({c: f"p_{c}" for c in CORNERS})
    g = gt.select("gt_id", "image_id", F.col("label").alias("gt_label"), *[F.col(c).alias(f"g_{c}") for c in CORNERS], *[c for c in ("ignored",) if c in gt.columns])
    return p.join(g, "image_id").withColumn("iou", iou(_p(), _g()))


def _states(priors: DataFrame, positive: DataFrame, ignored: DataFrame | None = None) -> DataFrame:
    out = priors.select("prior_id", "image_id").join(positive.select("prior_id", "gt_id"), "prior_id", "left")
    state = F.when(F.col("gt_id").isNotNull(), 1).otherwise(0)
    if ignored is not None:
        out = out.join(ignored.select("prior_id", F.lit(1).alias("_skip")), "prior_id", "left")
        state = F.when(F.col("_skip") == 1, -1).otherwise(state)
        out = out.withColumn("gt_id", F.when(F.col("_skip").isNull(), F.col("gt_id")))
    return out.select("prior_id", "image_id", "gt_id", state.alias("state"))


def _one(x: DataFrame, *order: Column) -> DataFrame:
    """The first row of each prior."""
    return x.withColumn("_n", F.row_number().over(Window.partitionBy("prior_id").orderBy(*order))).where("_n = 1").drop("_n")


def max_iou(priors: DataFrame, gt: DataFrame, positive: float = 0.5, negative: float = 0.4, least: float = 0.0, all_best: bool = True, rescue: bool = True, ignore_over: float = -1, approximations: DataFrame | None = None) -> DataFrame:
    """Best ground truth over ``positive``; background under ``negative``; between them ignored. Each ground truth also
    claims its best priors over ``least`` (the later ground truth wins). Priors covered by ignored boxes are ignored.

    ``approximations`` (prior_id, image_id, corners): several boxes that stand for a prior; its IoU is then the greatest of
    theirs, while ignored boxes still meet the prior itself."""
    g, skip = gt, None
    if "ignored" in gt.columns:
        g, skip = gt.where("ignored = 0"), gt.where("ignored = 1")
    x = crossed(priors, g)
    if approximations is not None:
        x = crossed(approximations, g).groupBy("prior_id", "gt_id").agg(F.max("iou").alias("iou"))
    best = _one(x, F.desc("iou"), F.col("gt_id")).select("prior_id", F.col("gt_id").alias("best"), F.col("iou").alias("best_iou"))
    top = x.withColumn("_most", F.max("iou").over(Window.partitionBy("gt_id")))
    claims = top.where((F.col("_most") >= least) & (F.col("iou") == F.col("_most")))
    if not all_best:
        claims = claims.withColumn("_k", F.row_number().over(Window.partitionBy("gt_id").orderBy("prior_id"))).where("_k = 1")
    claims = claims.groupBy("prior_id").agg(F.max("gt_id").alias("claim"))
    out = priors.select("prior_id", "image_id").join(best, "prior_id", "left").join(claims, "prior_id", "left")
    base = F.when(F.col("best_iou") >= positive, 1).when(F.coalesce("best_iou", F.lit(0.0)) < negative, 0).otherwise(-1)
    claimed = F.col("claim").isNotNull() & F.lit(rescue)
    state, gt_id = F.when(claimed, 1).otherwise(base), F.when(claimed, F.col("claim")).when(base == 1, F.col("best"))
    out = out.select("prior_id", "image_id", gt_id.alias("gt_id"), state.alias("state"))
    if skip is not None and ignore_over > 0:
        s = crossed(priors, skip).withColumn("part", iof(_p(), _g())).groupBy("prior_id").agg(F.max("part").alias("part")).where(F.col("part") > ignore_over)
        out = out.join(s, "prior_id", "left").select("prior_id", "image_id", F.when(F.col("part").isNull(), F.col("gt_id")).alias("gt_id"), F.when(F.col("part").isNotNull(), -1).otherwise(F.col("state")).alias("state"))
    return out


def _center_inside(margin: float = 0.01) -> Column:
    px, py = _p().center
    return F.least(px - _g().x1, py - _g().y1, _g().x2 - px, _g().y2 - py) > margin


#: Pairs of an image that are looked at in one step.
_STEP = 1 << 20
_NEAR = "prior_id long, gt_id long, iou double, d double"


def _nearest(k: int, distance: Callable[[np.ndarray, np.ndarray], np.ndarray], pick: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray] | None, step: int):
    """Pairs of each ground truth with its k nearest priors on each level, as ``_NEAR``; ties by the prior's id."""

    def run(table: pa.Table, groups: list[tuple[int, int]]) -> pa.Table:
        boxes = np.stack([table.column(c).to_numpy() for c in CORNERS], axis=1)
        side, level, ids = (table.column(c).to_numpy() for c in ("side", "level", "id"))
        out: list[tuple[np.ndarray, ...]] = []
        for start, end in groups:
            cut = start + int(np.searchsorted(side[start:end], 1))
            g, p = boxes[start:cut], boxes[cut:end]
            if not len(g) or not len(p):
                continue
            edges = [0, *(np.flatnonzero(np.diff(level[cut:end])) + 1).tolist(), len(p)]
            for at in range(0, len(g), max(1, step // len(p))):
                some = g[at : at + max(1, step // len(p))]
                d = distance(some, p)
                near = np.concatenate([x + np.argsort(d[:, x:y], axis=1, kind="stable")[:, :k] for x, y in zip(edges, edges[1:], strict=False)], axis=1)
                o = paired_overlaps(p[near], some[:, None])
                i, j = np.nonzero(np.ones(near.shape, bool) if pick is None else pick(some[:, None], p[near], o))
                to = near[i, j]
                out.append((ids[cut + to], ids[start + at + i], o[i, j], d[i, to]))
        columns = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, t) for t in (np.int64, np.int64, float, float)]
        return pa.table(dict(zip(("prior_id", "gt_id", "iou", "d"), columns, strict=True)))

    return run


def nearest(priors: DataFrame, gt: DataFrame, k: int, distance: Callable[[np.ndarray, np.ndarray], np.ndarray], pick: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """prior_id, gt_id, iou, d: the k priors of each level that are nearest to each ground truth of their image.

    Boxes are shuffled, not pairs: an image's boxes, which a camera frame bounds, meet in one task, some ground truths at a
    time. ``pick`` (ground truth, priors, IoU of its pairs) may leave out pairs."""
    corners = [F.col(c).cast("double") for c in CORNERS]
    level = F.col("level").cast("long") if "level" in priors.columns else F.lit(0).cast("long")
    rows = gt.select("image_id", F.lit(0).alias("side"), F.lit(0).cast("long").alias("level"), F.col("gt_id").cast("long").alias("id"), *corners)
    rows = rows.union(priors.select("image_id", F.lit(1), level, F.col("prior_id").cast("long"), *corners)).where(F.col("image_id").isNotNull())
    return walk_groups(rows, ["image_id"], ["side", "level", "id"], _nearest(k, distance, pick, _STEP), _NEAR)


def paired_overlaps(a: np.ndarray, b: np.ndarray, eps: float = EPS) -> np.ndarray:
    """IoU of boxes of one shape."""
    w = np.minimum(a[..., 2], b[..., 2]) - np.maximum(a[..., 0], b[..., 0])
    h = np.minimum(a[..., 3], b[..., 3]) - np.maximum(a[..., 1], b[..., 1])
    inter = np.maximum(w, 0.0) * np.maximum(h, 0.0)
    one, two = ((x[..., 2] - x[..., 0]) * (x[..., 3] - x[..., 1]) for x in (a, b))
    return inter / np.maximum(one + two - inter, eps)


def _centers(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (b[..., 0] + b[..., 2]) / 2, (b[..., 1] + b[..., 3]) / 2


def _straight(g: np.ndarray, p: np.ndarray) -> np.ndarray:
    (gx, gy), (px, py) = _centers(g), _centers(p)
    return np.sqrt((px - gx[:, None]) ** 2 + (py - gy[:, None]) ** 2)


def _over_spread(g: np.ndarray, p: np.ndarray, o: np.ndarray) -> np.ndarray:
    """IoU at least mean + deviation, summed in the order of the candidates, and the prior's centre inside."""
    total, mean, spread = np.zeros(len(o)), np.zeros(len(o)), np.zeros(len(o))
    for n in range(o.shape[1]):
        delta = o[:, n] - mean
        total, mean = total + o[:, n], mean + delta / (n + 1)
        spread += delta * (delta - delta / (n + 1))
    limit = total / o.shape[1] + (np.sqrt(spread / (o.shape[1] - 1)) if o.shape[1] > 1 else 0.0)
    px, py = _centers(p)
    inside = np.minimum(np.minimum(px - g[..., 0], py - g[..., 1]), np.minimum(g[..., 2] - px, g[..., 3] - py)) > 0.01
    return (o >= limit[:, None]) & inside


def atss(priors: DataFrame, gt: DataFrame, k: int = 9) -> DataFrame:
    """k priors with the nearest centres on each level are candidates; those over mean + deviation of the candidates' IoU,
    with their centre inside, are positive; a prior goes to the ground truth with the largest IoU."""
    x = nearest(priors, gt, k, _straight, _over_spread)
    return _states(priors, _one(x, F.desc("iou"), F.col("gt_id")))


def dynamic_k(x: DataFrame, priors: DataFrame, top: int) -> DataFrame:
    """Each ground truth takes its k cheapest priors, k being the whole part of its ``top`` largest IoUs (at least 1); a
    prior wanted by several goes to the cheapest. ``x``: prior_id, gt_id, iou, cost."""
    by_iou = F.row_number().over(Window.partitionBy("gt_id").orderBy(F.desc("iou"), "prior_id"))
    ks = x.withColumn("_n", by_iou).where(F.col("_n") <= top).groupBy("gt_id").agg(F.greatest(F.floor(F.round(F.sum("iou"), 9)), F.lit(1)).alias("k"))
    x = x.join(ks, "gt_id").withColumn("_c", F.row_number().over(Window.partitionBy("gt_id").orderBy("cost", "prior_id"))).where("_c <= k")
    return _states(priors, _one(x, F.col("cost"), F.col("gt_id")))


def sim_ota(priors: DataFrame, gt: DataFrame, radius: float = 2.5, top: int = 10, iou_weight: float = 3.0, label_weight: float = 1.0, eps: float = 1e-7) -> DataFrame:
    """Cost: cross entropy of the score against the IoU-free label, -ln IoU, and a large term off the centre region.

    ``priors`` need stride and score (probability of the prior's label, ``label``)."""
    (px, py), (gx, gy) = _p().center, _g().center
    x = crossed(priors, gt)
    r = radius * F.col("stride")
    in_box = F.least(px - _g().x1, py - _g().y1, _g().x2 - px, _g().y2 - py) > 0
    in_center = (F.abs(px - gx) < r) & (F.abs(py - gy) < r)
    x = x.where(in_box | in_center)
    s = F.least(F.greatest(F.when(F.col("label") == F.col("gt_label"), F.col("score")).otherwise(1 - F.col("score")), F.lit(1e-6)), F.lit(1 - 1e-6))
    cost = -F.ln(s) * label_weight - F.ln(F.col("iou") + eps) * iou_weight + F.when(in_box & in_center, 0.0).otherwise(INF)
    return dynamic_k(x.withColumn("cost", F.round(cost, 9)), priors, top)


def soft_label(priors: DataFrame, gt: DataFrame, radius: float = 3.0, top: int = 13, iou_weight: float = 3.0, eps: float = 1e-7) -> DataFrame:
    """Cost: soft cross entropy of all class scores, -ln IoU, and 10 to the distance of the centres in strides past ``radius``.

    ``priors``: prior_id, image_id, px, py, stride, logits (array by class) and the decoded box. The label of a pair is the ground truth's
    class with the pair's IoU as target, and each class weighs by the squared distance of its probability from the target.
    Only priors whose point lies in some ground truth take part; they are candidates of every ground truth of their image."""
    x = crossed(priors, gt)
    inside = F.least(F.col("px") - _g().x1, F.col("py") - _g().y1, _g().x2 - F.col("px"), _g().y2 - F.col("py")) > 0
    x = x.withColumn("_some", F.max(inside).over(Window.partitionBy("prior_id"))).where("_some")
    gx, gy = _g().center
    far = F.sqrt((F.col("px") - gx) ** 2 + (F.col("py") - gy) ** 2) / F.col("stride")

    def part(z: Column, k: Column) -> Column:
        target = F.when(k == F.col("gt_label"), F.col("iou")).otherwise(0.0)
        entropy = F.greatest(z, F.lit(0.0)) - z * target + F.log1p(F.exp(-F.abs(z)))
        return entropy * (target - 1 / (1 + F.exp(-z))) ** 2

    label = F.aggregate(F.transform("logits", part), F.lit(0.0), lambda a, v: a + v)
    cost = label - F.ln(F.col("iou") + eps) * iou_weight + F.pow(F.lit(10.0), far - radius)
    return dynamic_k(x.withColumn("cost", F.round(cost, 9)), priors, top)


def task_aligned(priors: DataFrame, gt: DataFrame, top: int = 13, alpha: float = 1.0, beta: float = 6.0) -> DataFrame:
    """score ** alpha * iou ** beta; the ``top`` of each ground truth with a positive value and their centre inside."""
    s = F.when(F.col("label") == F.col("gt_label"), F.col("score")).otherwise(0.0)
    x = crossed(priors, gt).withColumn("_m", F.pow(s, F.lit(float(alpha))) * F.pow(F.col("iou"), F.lit(float(beta))))
    x = x.withColumn("_n", F.row_number().over(Window.partitionBy("gt_id").orderBy(F.desc("_m"), "prior_id"))).where((F.col("_n") <= top) & (F.col("_m") > 0) & _center_inside())
    return _states(priors, _one(x, F.desc("iou"), F.col("gt_id")))


def center_region(priors: DataFrame, gt: DataFrame, positive_scale: float = 0.2, negative_scale: float = 0.5, least: float = 0.01) -> DataFrame:
    """Positive: centre strictly inside the ground truth and enough of the prior in its core; the smallest ground truth
    wins. Priors that touch a shadow only (the ground truth scaled by ``negative_scale``) are ignored."""
    px, py = _p().center
    core, shadow = _g().resize(positive_scale, positive_scale), _g().resize(negative_scale, negative_scale)
    inside = (px > _g().x1) & (px < _g().x2) & (py > _g().y1) & (py < _g().y2)
    x = crossed(priors, gt).withColumn("_core", iof(_p(), core)).withColumn("_shadow", iof(_p(), shadow)).withColumn("_in", inside)
    hit = _one(x.where(F.col("_in") & (F.col("_core") > least)), _g().area, F.col("gt_id"))
    grey = x.where(F.col("_shadow") > least).select("prior_id").distinct().join(hit.select("prior_id"), "prior_id", "left_anti")
    return _states(priors, hit, grey)


def grid(priors: DataFrame, gt: DataFrame, positive: float = 0.5, negative: float = 0.4, least: float = 0.0, all_best: bool = True) -> DataFrame:
    """Only priors that are ``responsible`` (boolean; the cell of a ground truth's centre) become positive: by IoU over
    ``positive``, or as the best responsible ones of a ground truth over ``least``. Background is what overlaps nothing
    by more than ``negative``; the rest is ignored."""
    g = gt.where("ignored = 0") if "ignored" in gt.columns else gt
    x = crossed(priors, g)
    most = x.groupBy("prior_id").agg(F.max("iou").alias("_most"))
    own = x.where("responsible")
    best = _one(own, F.desc("iou"), F.col("gt_id")).where(F.col("iou") > positive).select("prior_id", F.col("gt_id").alias("best"))
    w = Window.partitionBy("gt_id")
    claims = own.withColumn("_top", F.max("iou").over(w)).where((F.col("_top") > least) & (F.col("iou") == F.col("_top")))
    if not all_best:
        claims = claims.withColumn("_k", F.row_number().over(w.orderBy("prior_id"))).where("_k = 1")
    claims = claims.groupBy("prior_id").agg(F.max("gt_id").alias("claim"))
    out = priors.select("prior_id", "image_id").join(most, "prior_id", "left").join(best, "prior_id", "left").join(claims, "prior_id", "left")
    gt_id = F.coalesce("claim", "best")
    state = F.when(gt_id.isNotNull(), 1).when(F.coalesce("_most", F.lit(0.0)) <= negative, 0).otherwise(-1)
    return out.select("prior_id", "image_id", gt_id.alias("gt_id"), state.alias("state"))


def nearest_points(points: DataFrame, gt: DataFrame, scale: float = 4.0, count: int = 3) -> DataFrame:
    """Points (prior_id, image_id, level, x, y): each ground truth takes the nearest ``count`` of its level, in units of its
    size; a point keeps its nearest ground truth. Level: whole part of the mean log2 of width and height over ``scale``."""
    b = Box.named("g_")
    span = points.select(F.min("level").alias("lo"), F.max("level").alias("hi"))
    g = gt.select("gt_id", "image_id", *[F.col(c).alias(f"g_{c}") for c in CORNERS])
    lv = ((F.log2(b.width / scale) + F.log2(b.height / scale)) / 2).cast("int")
    g = g.withColumn("level", F.least(F.greatest(lv, span.select("lo").scalar()), span.select("hi").scalar()))
    gx, gy = b.center
    x = points.join(g, ["image_id", "level"]).withColumn("_d", F.sqrt(((F.col("x") - gx) / b.width) ** 2 + ((F.col("y") - gy) / b.height) ** 2))
    x = x.withColumn("_n", F.row_number().over(Window.partitionBy("gt_id").orderBy("_d", "prior_id"))).where(F.col("_n") <= count)
    return _states(points, _one(x, F.col("_d"), F.col("gt_id")))


def uniform(priors: DataFrame, gt: DataFrame, times: int = 4, negative_over: float = 0.7, positive_under: float = 0.15) -> DataFrame:
    """``times`` nearest priors of each ground truth by L1 of (centre, size). Other priors that overlap a ground truth over
    ``negative_over`` are ignored, and so are taken ones under ``positive_under``. A prior taken twice goes to the nearest."""
    d = sum([F.abs(a - b) for a, b in zip(_p().as_cxcywh(), _g().as_cxcywh(), strict=True)], F.lit(0.0))
    x = crossed(priors, gt).withColumn("_d", d)
    near = x.withColumn("_n", F.row_number().over(Window.partitionBy("gt_id").orderBy("_d", "prior_id"))).where(F.col("_n") <= times)
    hit = _one(near, F.col("_d"), F.col("gt_id"))
    most = x.groupBy("prior_id").agg(F.max("iou").alias("most"))
    weak = hit.where(F.col("iou") < positive_under).select("prior_id")
    grey = most.where(F.col("most") > negative_over).select("prior_id").join(hit.select("prior_id"), "prior_id", "left_anti")
    return _states(priors, hit, weak.union(grey))


def several(priors: DataFrame, gt: DataFrame, count: int = 2, positive: float = 0.5) -> DataFrame:
    """prior_id, rank, gt_id, state for the ``count`` best ground truths of each prior."""
    x = crossed(priors, gt)
    x = x.withColumn("rank", F.row_number().over(Window.partitionBy("prior_id").orderBy(F.desc("iou"), "gt_id"))).where(F.col("rank") <= count)
    return x.select("prior_id", "rank", "gt_id", F.when(F.col("iou") >= positive, 1).otherwise(0).alias("state"))


# ---------------------------------------------------------------- costs and one-to-one matching


def l1_cost(width: Column | float, height: Column | float, weight: float = 1.0) -> Column:
    w, h = (v if isinstance(v, Column) else F.lit(float(v)) for v in (width, height))
    return weight * (F.abs(_p().x1 - _g().x1) / w + F.abs(_p().y1 - _g().y1) / h + F.abs(_p().x2 - _g().x2) / w + F.abs(_p().y2 - _g().y2) / h)


def overlap_cost(mode: str = "giou", weight: float = 1.0) -> Column:
    return -weight * (giou(_p(), _g()) if mode == "giou" else iou(_p(), _g()))


def focal_cost(logit: Column, alpha: float = 0.25, gamma: float = 2.0, eps: float = 1e-12, weight: float = 1.0) -> Column:
    p = 1 / (1 + F.exp(-logit))
    negative = -F.ln(1 - p + eps) * (1 - alpha) * F.pow(p, F.lit(gamma))
    positive = -F.ln(p + eps) * alpha * F.pow(1 - p, F.lit(gamma))
    return weight * (positive - negative)


def softmax_cost(logits: Column, label: Column, weight: float = 1.0) -> Column:
    total = F.aggregate(logits, F.lit(0.0), lambda s, v: s + F.exp(v))
    return -weight * F.exp(F.get(logits, label)) / total


def dice_cost(p: Column, g: Column, eps: float = 1e-3, weight: float = 1.0, naive: bool = True) -> Column:
    """Of two arrays of mask values."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    both = total(F.zip_with(p, g, lambda a, b: a * b))
    below = total(p) + total(g) if naive else total(F.transform(p, lambda v: v * v)) + total(F.transform(g, lambda v: v * v))
    return weight * (1 - (2 * both + eps) / (below + eps))


def solve(cost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of an assignment of least total cost (shortest augmenting paths)."""
    cost = np.asarray(cost, float)
    if not cost.size:
        return np.zeros(0, int), np.zeros(0, int)
    turned = cost.shape[0] > cost.shape[1]
    a = cost.T if turned else cost
    match = (_paths_of_few if a.size <= FEW else _paths)(a)
    cols = np.flatnonzero(match[1:])
    rows = match[1:][cols] - 1
    order = np.argsort(rows)
    rows, cols = rows[order], cols[order]
    return (cols, rows) if turned else (rows, cols)


#: Cells up to which plain numbers are faster than arrays.
FEW = 1024


def _paths(a: np.ndarray) -> np.ndarray:
    """Of each column (from 1) its row (from 1), 0: none."""
    n, m = a.shape
    u, v, match = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, used, way = np.full(m + 1, np.inf), np.zeros(m + 1, bool), np.zeros(m + 1, int)
        while True:
            used[j0] = True
            i0 = match[j0]
            free = np.flatnonzero(~used[1:]) + 1
            cur = a[i0 - 1, free - 1] - u[i0] - v[free]
            better = cur < least[free]
            least[free[better]], way[free[better]] = cur[better], j0
            j1 = int(free[least[free].argmin()])
            delta = least[j1]
            u[match[used]] += delta
            v[used] -= delta
            least[~used] -= delta
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            j1 = way[j0]
            match[j0] = match[j1]
            j0 = j1
    return match


def _paths_of_few(a: np.ndarray) -> np.ndarray:
    """``_paths`` step by step on plain numbers, with the same sums in the same order."""
    (n, m), rows = a.shape, a.tolist()
    u, v, match = [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, way, used, free = [math.inf] * (m + 1), [0] * (m + 1), [], list(range(1, m + 1))
        while True:
            used.append(j0)
            i0 = match[j0]
            row, ui = rows[i0 - 1], u[i0]
            delta, j1 = math.inf, free[0]
            for j in free:
                cur = row[j - 1] - ui - v[j]
                if cur < least[j]:
                    least[j], way[j] = cur, j0
                if least[j] < delta:
                    delta, j1 = least[j], j
            if delta:
                for j in used:
                    u[match[j]] += delta
                    v[j] -= delta
                for j in free:
                    least[j] -= delta
            free.remove(j1)
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            j1 = way[j0]
            match[j0] = match[j1]
            j0 = j1
    return np.array(match)


def pair_edges(edges: list[list[tuple[float, int]]]) -> dict[int, int]:
    """Pairs {column: row} of least total cost, where each row has its (cost, column) in a list, a row or a column may stay
    alone at cost 0, and nothing else can be paired: shortest augmenting paths that walk only over what there is."""
    owner: dict[int, int] = {}  # column: row, ...
    held: dict[int, int] = {}  # ... row: column
    paid: dict[int, float] = {}  # column: cost of its pair
    price: dict[int, float] = {}
    for i, own in enumerate(edges):
        best, at = 0.0, -1
        for c, j in own:
            d = c - price[j] if j in price else c
            if d < best:
                best, at, raw = d, j, c
        if at < 0:
            continue
        if at not in owner:
            owner[at], held[i], paid[at] = i, at, raw
            continue
        reach: dict[int, float] = {}
        came: dict[int, tuple[int, float]] = {}
        done: dict[int, float] = {}
        least, last = 0.0, -1  # what it costs that a row stays alone, and the column that it has now (-1: row i)
        r, base = i, 0.0
        while True:
            for c, j in edges[r]:
                if j not in done:
                    d = base + c - price.get(j, 0.0)
                    if d < reach.get(j, math.inf):
                        reach[j], came[j] = d, (r, c)
            end, at = least, -1
            for j, d in reach.items():
                if d < end and j not in done:
                    end, at = d, j
            if at < 0 or at not in owner:
                break
            done[at], r = end, owner[at]
            base = end - paid[at] + price.get(at, 0.0)
            if base < least:
                least, last = base, at
        for j, d in done.items():
            price[j] = price.get(j, 0.0) + d - end
        if at < 0 and last >= 0:
            at = last
            del held[owner[last]]
        while at >= 0:  # columns of the path pass to the rows that they were reached from
            r, c = came[at]
            owner[at], paid[at] = r, c
            held[r], at = at, held.get(r, -1)
    return owner


def _one_to_one(repeat: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        table = pdf.pivot(index="prior_id", columns="gt_id", values="cost")
        times = max(1, min(repeat, len(table) // max(1, table.shape[1])))
        rows, cols = solve(np.tile(table.to_numpy(), (1, times)))
        return pd.DataFrame({"prior_id": table.index.to_numpy()[rows], "gt_id": table.columns.to_numpy()[cols % table.shape[1]], "cost": np.tile(table.to_numpy(), (1, times))[rows, cols]})

    return run


def hungarian(priors: DataFrame, gt: DataFrame, cost: Column, repeat: int = 1) -> DataFrame:
    """One-to-one (or one ground truth to ``repeat`` priors) assignment of least cost in each image: prior_id, gt_id, cost.

    ``cost`` is an expression over ``crossed``. A group holds the candidate pairs of one image."""
    x = crossed(priors, gt).select("image_id", "prior_id", "gt_id", cost.alias("cost"))
    return x.groupBy("image_id").applyInPandas(_one_to_one(repeat), "prior_id long, gt_id long, cost double")


def region(priors: DataFrame, gt: DataFrame, images: DataFrame, strides: Sequence[int], sizes: Sequence[tuple[int, int]], scale: float, centre: float = 0.2, ignore: float = 0.5, border: float = 0) -> DataFrame:
    """Ground truth by the cells of its middle part on the level that fits its size.

    ``priors`` have a level and lie on grids of ``strides`` with ``sizes`` (rows, columns); ``scale``: side of the smallest
    prior in strides; ``images``: image_id, width, height. Priors whose centre is in the middle part (``centre``) of a box
    on its level are positive, those in a wider part (``ignore``) are ignored, on the levels beside it too; a later ground truth wins over an
    earlier one on its level. Priors off the image by more than ``border`` are ignored. An image without ground truth has
    background only. A box is turned into the cells of its wider part, at most a few per level but for the last, and meets
    priors by (image, level, cell): no prior is compared with all boxes."""
    last = len(strides) - 1
    at = lambda values, level: F.get(F.array(*[F.lit(float(v)) for v in values]), level)
    b = Box.named()
    fit = F.floor(F.log2(F.sqrt(b.width * b.height)) - F.log2(F.lit(float(scale * strides[0]))) + 0.5)
    g = gt.withColumn("own", F.least(F.greatest(fit, F.lit(0)), F.lit(last)).cast("int"))
    g = g.withColumn("level", F.explode(F.filter(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.col("own") + d), lambda v: (v >= 0) & (v <= last))))

    def part(share: float, name: str) -> list[Column]:
        r = (1 - share) / 2
        stride, rows, columns = at(strides, F.col("level")), at([s[0] for s in sizes], F.col("level")), at([s[1] for s in sizes], F.col("level"))
        edges = [F.bround((1 - r) * (p / stride) + r * (q / stride)) for p, q in ((b.x1, b.x2), (b.y1, b.y2), (b.x2, b.x1), (b.y2, b.y1))]
        return [F.least(F.greatest(v, F.lit(0.0)), m).alias(f"{name}{k}") for k, (v, m) in enumerate(zip(edges, (columns, rows, columns, rows), strict=True))]

    g = g.select("image_id", "gt_id", "own", "level", *part(ignore, "w"), *part(centre, "m")).where("w0 <= w2 and w1 <= w3")
    cells = g.withColumn("cx", F.explode(F.expr("sequence(cast(w0 as long), cast(w2 as long))"))).withColumn("cy", F.explode(F.expr("sequence(cast(w1 as long), cast(w3 as long))")))
    p = Box.named()
    x, y = (p.center[i] / at(strides, F.col("level")) for i in (0, 1))
    placed = priors.withColumn("_x", x).withColumn("_y", y).withColumn("cx", F.floor("_x")).withColumn("cy", F.floor("_y"))
    met = placed.select("prior_id", "image_id", "level", "_x", "_y", "cx", "cy").join(cells, ["image_id", "level", "cx", "cy"]).where("_x between w0 and w2 and _y between w1 and w3")
    middle = F.expr("_x between m0 and m2 and _y between m1 and m3")
    here = F.max(F.when(F.col("own") == F.col("level"), F.struct("gt_id", middle.alias("middle"))))
    of = met.groupBy("prior_id").agg(here.alias("here"), F.max(F.col("own") != F.col("level")).alias("beside"))
    some = gt.select("image_id").distinct().withColumn("some", F.lit(True))
    out = priors.join(of, "prior_id", "left").join(some, "image_id", "left").join(images.select("image_id", "width", "height"), "image_id")
    off = (p.x1 < -border) | (p.y1 < -border) | (p.x2 >= F.col("width") + border) | (p.y2 >= F.col("height") + border) if border >= 0 else F.lit(False)
    skip = F.col("some") & (off | F.coalesce("beside", F.lit(False)))
    state = F.when(skip, -1).when(F.col("here.middle"), 1).when(F.col("here").isNotNull(), -1).otherwise(0)
    return out.select("prior_id", "image_id", F.when(state == 1, F.col("here.gt_id")).alias("gt_id"), state.alias("state"))
