"""Suppression and fusion of overlapping detections.

Set-based forms (fast and matrix suppression) are joins of an image's and class's detections with each other and two
aggregates. Forms that depend on order (greedy and soft suppression, weighted fusion) walk one image and class at a time;
a camera frame bounds the group.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.boxes import Box, iou
from .groups import walk_groups
from .matching import overlaps

CORNERS = ("x1", "y1", "x2", "y2")


def ranked(det: DataFrame, by: Sequence[str], top: int | None = None, name: str = "rank") -> DataFrame:
    """``det`` with its rank by score within ``by`` (from 1); with ``top`` only the first ones."""
    out = det.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "det_id")))
    return out.where(F.col(name) <= top) if top is not None and top > 0 else out


def filter_topk(det: DataFrame, score_threshold: float, top: int, by: Sequence[str] = ("image_id",)) -> DataFrame:
    """Detections with score over the threshold, the ``top`` best of each group."""
    return ranked(det.where(F.col("score") > score_threshold), by, top).drop("rank")


def _higher(det: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pairs of a detection (right) and one of higher rank (left, ``h_``) in its group, with IoU."""
    left = det.select(*keys, *[F.col(c).alias(f"h_{c}") for c in (*CORNERS, "rank", "det_id")])
    right = det.select(*keys, "det_id", "rank", "score", *[F.col(c).alias(f"l_{c}") for c in CORNERS])
    return left.join(right, list(keys)).where("h_rank < rank").withColumn("iou", iou(Box.named("h_"), Box.named("l_")))


def fast_suppression(det: DataFrame, iou_threshold: float = 0.5, score_threshold: float = 0.05, top: int = 200, most: int = -1) -> DataFrame:
    """Keeps a detection if no better one of its class, suppressed or not, overlaps it more than the threshold."""
    x = ranked(det, ["image_id", "label"], top)
    worst = _higher(x, ["image_id", "label"]).groupBy("det_id").agg(F.max("iou").alias("most"))
    x = x.join(worst, "det_id", "left").where((F.coalesce("most", F.lit(0.0)) <= iou_threshold) & (F.col("score") > score_threshold)).drop("most", "rank")
    return ranked(x, ["image_id"], most).drop("rank")


def matrix_suppression(det: DataFrame, kernel: str = "gaussian", sigma: float = 2.0, pre: int = -1, most: int = -1, threshold: float = -1) -> DataFrame:
    """Scores decayed by overlaps with better detections of the class, relative to what those suffered themselves."""
    if kernel not in ("gaussian", "linear"):
        raise ValueError(f"unknown kernel {kernel!r}")
    x = ranked(det, ["image_id"], pre)
    p = _higher(x, ["image_id", "label"])
    own = p.groupBy("det_id").agg(F.max("iou").alias("own")).withColumnRenamed("det_id", "h_det_id")
    p = p.join(own, "h_det_id", "left").withColumn("own", F.coalesce("own", F.lit(0.0)))
    decay = F.exp(-sigma * (F.col("iou") ** 2 - F.col("own") ** 2)) if kernel == "gaussian" else F.try_divide(1 - F.col("iou"), 1 - F.col("own"))
    low = p.groupBy("det_id").agg(F.min(decay).alias("decay"))
    x = x.join(low, "det_id", "left").withColumn("score", F.col("score") * F.least(F.coalesce("decay", F.lit(1.0)), F.lit(1.0))).drop("decay", "rank")
    x = x.where(F.col("score") >= threshold) if threshold > 0 else x
    return ranked(x, ["image_id"], most).drop("rank")


def _walk(iou_threshold: float, soft: float | None, low: float):
    def run(table: pa.Table, groups: list[tuple[int, int]]) -> pa.Table:
        boxes, scores = np.stack([table.column(c).to_numpy() for c in CORNERS], axis=1).astype(float), table.column("score").to_numpy().copy()
        kept: list[int] = []
        for start, end in groups:
            o = overlaps(boxes[start:end], boxes[start:end])
            if soft is None:  # the rows are sorted, the best first
                alive = np.ones(end - start, bool)
                for i in range(end - start):
                    if alive[i]:
                        kept.append(start + i)
                        alive[i + 1 :] &= o[i, i + 1 :] <= iou_threshold
                continue
            own, alive = scores[start:end], np.ones(end - start, bool)
            while alive.any():
                i = int(np.where(alive, own, -np.inf).argmax())
                alive[i] = False
                kept.append(start + i)
                own[alive] *= np.exp(-(o[i][alive] ** 2) / soft)
                alive &= own > low
        out = table.take(pa.array(kept, pa.int64()))
        at = table.column_names.index("score")
        return out.set_column(at, "score", pa.array(scores[kept], table.schema.field("score").type))

    return run


def greedy_suppression(det: DataFrame, iou_threshold: float = 0.5, score_threshold: float = 0.0, most: int = -1, by_label: bool = True, soft_sigma: float | None = None) -> DataFrame:
    """Best first; each kept detection removes (or with ``soft_sigma`` decays) those it overlaps more than the threshold.
    Scores have to pass a ``score_threshold`` over 0; at 0 none is asked for, and a score of 0 takes part."""
    x = det.where(F.col("score") > score_threshold) if score_threshold > 0 else det
    keys = ["image_id", "label"] if by_label else ["image_id"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in x.schema.fields)
    out = walk_groups(x, keys, [F.desc("score"), "det_id"], _walk(iou_threshold, soft_sigma, max(score_threshold, 1e-3)), schema)
    return ranked(out, ["image_id"], most).drop("rank")


def multiclass_suppression(scores: DataFrame, score_threshold: float, iou_threshold: float, most: int = -1, factor: str | None = None) -> DataFrame:
    """``scores`` (det_id, image_id, corners, scores array by class): one row for each class over the threshold, times
    the ``factor`` column after that, then greedy suppression within classes and the ``most`` best of an image."""
    x = scores.select("*", F.posexplode("scores").alias("label", "score")).drop("scores").where(F.col("score") > score_threshold)
    if factor:
        x = x.withColumn("score", F.col("score") * F.col(factor))
    return greedy_suppression(x, iou_threshold, most=most)


def prefilter_sources(det: DataFrame, threshold: float = 0.0, weights: dict[int, float] | None = None) -> DataFrame:
    """Rows over the score threshold with corners in order and some area; scores weighted by ``source``."""
    b = Box.named()
    x = det.where(F.col("score") >= threshold)
    x = x.select(*[c for c in det.columns if c not in CORNERS], F.least(b.x1, b.x2).alias("x1"), F.least(b.y1, b.y2).alias("y1"), F.greatest(b.x1, b.x2).alias("x2"), F.greatest(b.y1, b.y2).alias("y2"))
    x = x.where((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1")) > 0)
    if weights:
        w = F.lit(None).cast("double")
        for source, weight in weights.items():
            w = F.when(F.col("source") == source, float(weight)).otherwise(w)
        return x.withColumn("weight", F.coalesce(w, F.lit(1.0)))
    return x.withColumn("weight", F.lit(1.0))


def _fuse(iou_threshold: float, mode: str, total: float, sources: int, overflow: bool):
    def confidence(s: np.ndarray, w: np.ndarray, most: float) -> float:
        if mode == "box_and_model_avg":
            return s.sum() / w.sum() * min(w.sum(), total) / total
        if mode == "absent_model_aware_avg":
            return s.sum() / (w.sum() + max(total - w.sum(), 0.0))
        return s.max() / most if mode == "max" else s.mean() * (len(s) if overflow else min(sources, len(s))) / total

    def run(table: pa.Table, spans: list[tuple[int, int]]) -> pa.Table:
        """Rows of a group come best first; a cluster keeps its weighted sums, so a member is added once."""
        boxes, every_s, every_w = np.stack([table.column(c).to_numpy() for c in CORNERS], axis=1).astype(float), table.column("_s").to_numpy(), table.column("weight").to_numpy()
        out, first = [], []
        for start, end in spans:
            own, s, w = boxes[start:end], every_s[start:end], every_w[start:end]
            groups: list[list[int]] = []
            fused, sums, mass = np.zeros((8, 4)), np.zeros((8, 4)), np.zeros(8)
            for i in range(end - start):
                n = len(groups)
                o = overlaps(own[i : i + 1], fused[:n])[0] if n else np.zeros(0)
                j = int(o.argmax()) if n else -1
                if j < 0 or not o[j] > iou_threshold:
                    if n == len(fused):
                        fused, sums, mass = np.concatenate([fused, fused]), np.concatenate([sums, sums]), np.concatenate([mass, mass])
                    groups.append([i])
                    fused[n], sums[n], mass[n] = own[i], own[i] * s[i], s[i]
                    continue
                groups[j].append(i)
                sums[j] += own[i] * s[i]
                mass[j] += s[i]
                fused[j] = sums[j] / mass[j]
            most = w.max()
            out += [[*box, confidence(s[m], w[m], most), len(m)] for box, m in zip(fused.tolist(), groups, strict=False)]
            first += [start] * len(groups)
        rows = pd.DataFrame(out, columns=[*CORNERS, "score", "members"])
        at = pa.array(first, pa.int64())
        return pa.table({**{c: rows[c].to_numpy() for c in (*CORNERS, "score")}, "members": rows["members"].to_numpy(np.int64), **{c: table.column(c).take(at).cast(pa.int64()) for c in ("image_id", "label")}})

    return run


def weighted_fusion(det: DataFrame, iou_threshold: float = 0.55, threshold: float = 0.0, weights: dict[int, float] | None = None, mode: str = "avg", sources: int | None = None, overflow: bool = False) -> DataFrame:
    """Detections of several sources joined to clusters with score-weighted mean boxes: image_id, label, corners, score,
    members. ``mode``: avg, max, box_and_model_avg or absent_model_aware_avg."""
    if mode not in ("avg", "max", "box_and_model_avg", "absent_model_aware_avg"):
        raise ValueError(f"unknown mode {mode!r}")
    n = sources if sources is not None else len(weights or {}) or 1
    total = float(sum(weights.values())) if weights else float(n)
    x = prefilter_sources(det, threshold, weights)
    schema = "x1 double, y1 double, x2 double, y2 double, score double, members long, image_id long, label long"
    x = x.withColumn("_s", F.col("score") * F.col("weight")).select("image_id", "label", "det_id", *[F.col(c).cast("double").alias(c) for c in CORNERS], "weight", "_s")
    return walk_groups(x, ["image_id", "label"], [F.desc("_s"), "det_id"], _fuse(iou_threshold, mode, total, n, overflow), schema)


def mean_of_views(views: DataFrame) -> DataFrame:
    """Mean box and score of each detection over the augmented views it was seen in (already mapped back)."""
    return views.groupBy("image_id", "det_id").agg(*[F.avg(c).alias(c) for c in (*CORNERS, "score")])


def shift_tiles(det: DataFrame, offset_x: str = "offset_x", offset_y: str = "offset_y") -> DataFrame:
    """Detections of image tiles in the coordinates of the whole image."""
    b = Box.named().translate(F.col(offset_x), F.col(offset_y))
    return det.withColumns(dict(zip(CORNERS, b.corners, strict=True))).drop(offset_x, offset_y)


def merge_tiles(det: DataFrame, iou_threshold: float = 0.5) -> DataFrame:
    return greedy_suppression(shift_tiles(det), iou_threshold)


def topk_cells(heat: DataFrame, k: int, height: int, width: int) -> DataFrame:
    """``heat`` (image_id, cell, score), cells flattened as (class, y, x): the k best with class, y and x."""
    order = Window.partitionBy("image_id").orderBy(F.desc("score"), "cell")
    x = heat.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return x.select("image_id", "rank", "score", F.expr(f"cell div {height * width}").alias("label"), F.expr(f"(cell % {height * width}) div {width}").alias("y"), F.expr(f"cell % {width}").alias("x"))


def local_maxima(heat: DataFrame, kernel: int = 3) -> DataFrame:
    """Cells (image_id, label, y, x, score) that no cell of their kernel window exceeds."""
    r = kernel // 2
    around = heat.select("image_id", "label", F.explode(F.sequence(F.col("y") - r, F.col("y") + r)).alias("y"), "x", "score")
    around = around.select("image_id", "label", "y", F.explode(F.sequence(F.col("x") - r, F.col("x") + r)).alias("x"), "score")
    best = around.groupBy("image_id", "label", "y", "x").agg(F.max("score").alias("best"))
    return heat.join(best, ["image_id", "label", "y", "x"]).where("score = best").drop("best")
