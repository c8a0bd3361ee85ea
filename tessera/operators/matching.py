"""Matching detections to ground truth, and average precision, as joins, windows and aggregates.

Inputs have one row for each box: ``gt`` (gt_id, image_id, label, x1, y1, x2, y2, ignored) and ``det`` (det_id, image_id,
label, score, x1, y1, x2, y2). Ties are broken by ids. Joins have the image and label as equality keys, so they are hash
joins; windows are partitioned by detection, ground truth or class.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.boxes import Box, iou
from .groups import walk_groups


def _both() -> tuple[Box, Box]:
    return Box.named("d_"), Box.named("g_")


def pairs(det: DataFrame, gt: DataFrame, extra: float = 0.0, by_label: bool = True) -> DataFrame:
    """Each detection with every ground truth of its image (and label), and their IoU."""
    corners = ("x1", "y1", "x2", "y2")
    d = det.withColumnsRenamed({c: f"d_{c}" for c in corners})
    g = gt.withColumnsRenamed({c: f"g_{c}" for c in corners})
    keys = ["image_id", "label"] if by_label else ["image_id"]
    g = g if by_label else g.withColumnRenamed("label", "gt_label")
    return d.join(g, keys).withColumn("iou", iou(*_both(), extra=extra))


def match_default(det: DataFrame, gt: DataFrame, threshold: float = 0.5, area: tuple[float, float] | None = None, extra: float = 0.0) -> DataFrame:
    """``det`` with tp and fp. A detection goes to the ground truth it overlaps most; the first by score on a ground
    truth is true, later ones are false, and those on ignored ones (or outside ``area``) are neither."""
    best = Window.partitionBy("det_id").orderBy(F.desc("iou"), "ignored", "gt_id")
    top = pairs(det, gt, extra).withColumn("_n", F.row_number().over(best)).where("_n = 1").select("det_id", "gt_id", "iou", "ignored", *[f"g_{c}" for c in ("x1", "y1", "x2", "y2")])
    hit = F.coalesce(F.col("iou") >= threshold, F.lit(False))
    skip = F.col("ignored") == 1
    size = Box.named().width, Box.named().height
    here = F.lit(True)
    if area is not None:
        g = Box.named("g_")
        inside = lambda b: ((b.width + extra) * (b.height + extra) >= area[0]) & ((b.width + extra) * (b.height + extra) < area[1])
        skip = skip | ~inside(g)
        here = ((size[0] + extra) * (size[1] + extra) >= area[0]) & ((size[0] + extra) * (size[1] + extra) < area[1])
    first = Window.partitionBy(F.when(hit, F.col("gt_id")), F.when(~hit, F.col("det_id"))).orderBy(F.desc("score"), "det_id")
    x = det.join(top, "det_id", "left").withColumn("_first", F.row_number().over(first))
    tp = hit & ~skip & (F.col("_first") == 1)
    fp = (hit & ~skip & (F.col("_first") > 1)) | (~hit & here)
    return x.select(*det.columns, F.when(tp, 1).otherwise(0).alias("tp"), F.when(fp, 1).otherwise(0).alias("fp"))


def running(matched: DataFrame, by: list[str], cells: int = 1024) -> DataFrame:
    """``matched`` with ``cum_tp`` and ``cum_fp`` from the best score down, and the score cell ``cell``.

    Sums of score cells are added up in a table of classes x cells rows, and rows only within their cell, so no task
    holds a class as a whole.
    """
    x = matched.withColumn("cell", F.floor(F.col("score") * cells).cast("long"))
    before = Window.partitionBy(*by).orderBy(F.desc("cell")).rowsBetween(Window.unboundedPreceding, -1)
    sums = x.groupBy(*by, "cell").agg(F.sum("tp").alias("_t"), F.sum("fp").alias("_f"))
    sums = sums.select(*by, "cell", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(n) for c, n in (("_t", "_bt"), ("_f", "_bf"))])
    upto = Window.partitionBy(*by, "cell").orderBy(F.desc("score"), "det_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = x.join(sums, [*by, "cell"])
    return x.withColumn("cum_tp", F.col("_bt") + F.sum("tp").over(upto)).withColumn("cum_fp", F.col("_bf") + F.sum("fp").over(upto)).drop("_bt", "_bf")


def average_precision(matched: DataFrame, counts: DataFrame, by: list[str], mode: str = "area") -> DataFrame:
    """``by``, num_gts, num_dets, recall, ap. ``counts``: ``by``, num_gts. ``mode``: ``area`` or ``11points``."""
    if mode not in ("area", "11points"):
        raise ValueError(f"unknown mode {mode!r}")
    x = running(matched, by).join(counts, by).withColumn("_r", F.coalesce(F.try_divide("cum_tp", "num_gts"), F.lit(0.0)))
    x = x.withColumn("_p", F.coalesce(F.try_divide(F.col("cum_tp"), F.col("cum_tp") + F.col("cum_fp")), F.lit(0.0)))
    if mode == "area":
        later = Window.partitionBy(*by).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
        tops = x.groupBy(*by, "cell").agg(F.max("_p").alias("_top")).select(*by, "cell", F.coalesce(F.max("_top").over(later), F.lit(0.0)).alias("_later"))
        below = Window.partitionBy(*by, "cell").orderBy(F.desc("score"), "det_id").rowsBetween(Window.currentRow, Window.unboundedFollowing)
        x = x.join(tops, [*by, "cell"]).withColumn("_e", F.greatest(F.max("_p").over(below), F.col("_later")))
        ap = F.sum(F.coalesce(F.try_divide("tp", "num_gts"), F.lit(0.0)) * F.col("_e"))
    else:
        ap = sum([F.coalesce(F.max(F.when(F.col("_r") >= t / 10, F.col("_p"))), F.lit(0.0)) for t in range(11)], F.lit(0.0)) / 11
    found = x.groupBy(*by).agg(F.count("*").alias("num_dets"), F.max("_r").alias("recall"), ap.alias("ap"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return counts.join(found, by, "left").select(*by, "num_gts", zero("num_dets").alias("num_dets"), F.coalesce("recall", F.lit(0.0)).alias("recall"), F.coalesce("ap", F.lit(0.0)).alias("ap"))


def map_table(det: DataFrame, gt: DataFrame, threshold: float = 0.5, mode: str = "area", area: tuple[float, float] | None = None, extra: float = 0.0) -> DataFrame:
    """label, num_gts, num_dets, recall, ap for each class that has detections or ground truth."""
    g = Box.named()
    valid = F.col("ignored") == 0
    if area is not None:
        size = (g.width + extra) * (g.height + extra)
        valid = valid & (size >= area[0]) & (size < area[1])
    counts = gt.groupBy("label").agg(F.sum(valid.cast("int")).alias("num_gts"))
    counts = counts.join(det.select("label").distinct(), "label", "full").select("label", F.coalesce("num_gts", F.lit(0)).alias("num_gts"))
    return average_precision(match_default(det, gt, threshold, area, extra), counts, ["label"], mode)


def mean_ap(aps: DataFrame) -> DataFrame:
    """One row: mean of ap over classes with ground truth."""
    return aps.agg(F.coalesce(F.avg(F.when(F.col("num_gts") > 0, F.col("ap"))), F.lit(0.0)).alias("mean_ap"))


# ---------------------------------------------------------------- matching that depends on order


def _greedy(rule: str, threshold: float):
    """Greedy matching of one image and class; ``rule``: ``free`` (best free ground truth over its own threshold, which
    shrinks for small boxes) or ``coco`` (not ignored first, crowds matched again, later wins equal IoU). Rows of a group:
    detections, the best first, then ground truth, the ignored last."""

    def choice(o: np.ndarray, may: np.ndarray, ign: np.ndarray) -> int:
        """The ground truth that a detection goes to; -1: none."""
        if rule == "coco":
            may = may & ~ign if (may & ~ign).any() else may
            return len(o) - 1 - int(np.where(may, o, -1.0)[::-1].argmax())
        return int(np.where(may, o, -1.0).argmax())

    def run(table: pa.Table, groups: list[tuple[int, int]]) -> pa.Table:
        boxes = np.stack([table.column(c).to_numpy() for c in ("x1", "y1", "x2", "y2")], axis=1).astype(float)
        ids, side, ignored, crowds = (table.column(c).to_numpy() for c in ("id", "side", "ignored", "crowd"))
        dets = np.flatnonzero(side == 0)
        tp, fp, to = np.zeros(len(ids), np.int32), np.zeros(len(ids), np.int32), np.full(len(ids), -1, np.int64)
        for start, end in groups:
            cut = start + int(np.searchsorted(side[start:end], 1))
            db, gb = boxes[start:cut], boxes[cut:end]
            if not len(db):
                continue
            fp[start:cut] = 1
            if not len(gb):
                continue
            ign, crowd = ignored[cut:end].astype(bool), crowds[cut:end].astype(bool)
            o = overlaps(db, gb - (1.0 if rule == "free" else 0.0), crowd if rule == "coco" else None)
            w, h = gb[:, 2] - gb[:, 0], gb[:, 3] - gb[:, 1]
            need = np.minimum(w * h / ((w + 10) * (h + 10)), threshold) if rule == "free" else np.full(len(gb), min(threshold, 1 - 1e-10))
            over = o >= need[None]
            again = crowd & (rule == "coco")
            free = np.ones(len(gb), bool)
            for i in np.flatnonzero(over.any(1)).tolist():
                may = over[i] & (free | again)
                if may.any():
                    m = choice(o[i], may, ign)
                    free[m] = False
                    to[start + i], tp[start + i], fp[start + i] = ids[cut + m], not ign[m], 0
        return pa.table({"det_id": ids[dets], "tp": tp[dets], "fp": fp[dets], "gt_id": to[dets]})

    return run


def overlaps(a: np.ndarray, b: np.ndarray, crowd: np.ndarray | None = None, eps: float = 1e-6) -> np.ndarray:
    """IoU matrix; for crowd columns the detection's area is the denominator."""
    w = np.minimum(a[:, None, 2], b[None, :, 2]) - np.maximum(a[:, None, 0], b[None, :, 0])
    h = np.minimum(a[:, None, 3], b[None, :, 3]) - np.maximum(a[:, None, 1], b[None, :, 1])
    inter = np.clip(w, 0, None) * np.clip(h, 0, None)
    aa, ab = (a[:, 2] - a[:, 0]) * (a[:, 3] - a[:, 1]), (b[:, 2] - b[:, 0]) * (b[:, 3] - b[:, 1])
    union = aa[:, None] + ab[None] - inter
    if crowd is not None:
        union = np.where(crowd[None], aa[:, None], union)
    return inter / np.maximum(union, eps)


def _sides(det: DataFrame, gt: DataFrame) -> DataFrame:
    corners = ["x1", "y1", "x2", "y2"]
    d = det.select("image_id", "label", F.lit(0).alias("side"), F.col("det_id").alias("id"), "score", F.lit(0).alias("ignored"), F.lit(0).alias("crowd"), *corners)
    crowd = F.col("crowd") if "crowd" in gt.columns else F.lit(0)
    g = gt.select("image_id", "label", F.lit(1).alias("side"), F.col("gt_id").alias("id"), F.lit(0.0).alias("score"), F.col("ignored").cast("int"), crowd.cast("int").alias("crowd"), *corners)
    return d.unionByName(g)


def match_greedy(det: DataFrame, gt: DataFrame, rule: str, threshold: float = 0.5) -> DataFrame:
    """``det`` with tp, fp and the matched gt_id (-1: none), by a greedy walk over each image and class.

    A group holds the boxes of one class in one image, which a camera frame bounds.
    """
    if rule not in ("free", "coco"):
        raise ValueError(f"unknown rule {rule!r}")
    done = walk_groups(_sides(det, gt), ["image_id", "label"], ["side", "ignored", F.desc("score"), "id"], _greedy(rule, threshold), "det_id long, tp int, fp int, gt_id long")
    return det.join(done, "det_id")


def match_groups(det: DataFrame, gt: DataFrame, iou_threshold: float = 0.5, ioa_threshold: float = 0.5) -> DataFrame:
    """Detections against single boxes first; those left over go to group-of boxes by intersection over their own area,
    and each group counts once with its best detection. Adds tp and fp; absorbed detections are dropped."""
    single, group = gt.where("group_of = 0").withColumn("ignored", F.lit(0)), gt.where("group_of = 1")
    first = match_default(det, single, iou_threshold)
    done, left = first.where("tp = 1"), first.where("tp = 0")
    p = pairs(left.drop("tp", "fp"), group)
    d, g = _both()
    inter = F.greatest(F.least(d.x2, g.x2) - F.greatest(d.x1, g.x1), F.lit(0.0)) * F.greatest(F.least(d.y2, g.y2) - F.greatest(d.y1, g.y1), F.lit(0.0))
    p = p.withColumn("ioa", inter / F.greatest(d.area, F.lit(1e-6))).where(F.col("ioa") >= ioa_threshold)
    best = p.withColumn("_n", F.row_number().over(Window.partitionBy("det_id").orderBy(F.desc("ioa"), "gt_id"))).where("_n = 1").select("det_id", "gt_id", "score")
    top = best.groupBy("gt_id").agg(F.max_by("det_id", F.struct("score", -F.col("det_id"))).alias("det_id"))
    absorbed = left.join(best.select("det_id"), "det_id", "left_anti")
    pooled = left.join(top.select("det_id"), "det_id", "left_semi").withColumn("tp", F.lit(1)).withColumn("fp", F.lit(0))
    return done.unionByName(absorbed).unionByName(pooled.select(done.columns))


def label_counts(gt: DataFrame, valid: Column | None = None) -> DataFrame:
    return gt.groupBy("label").agg(F.sum((valid if valid is not None else F.lit(True)).cast("int")).alias("num_gts"))
