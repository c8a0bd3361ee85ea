"""Anchor and point grids as generated tables. Order: anchor fastest, then x, then y."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .boxes import Box


def base_anchors(size: float, scales: Sequence[float], ratios: Sequence[float], center: tuple[float, float] = (0.0, 0.0), scale_major: bool = True) -> list[tuple[float, float, float, float]]:
    """Anchors of one cell: width size * scale / sqrt(ratio), height size * scale * sqrt(ratio)."""
    roots = [math.sqrt(r) for r in ratios]
    wh = [(size * s / r, size * s * r) for r in roots for s in scales] if scale_major else [(size * s / r, size * s * r) for s in scales for r in roots]
    return [(center[0] - w / 2, center[1] - h / 2, center[0] + w / 2, center[1] + h / 2) for w, h in wh]


def octave_scales(base: float, per_octave: int) -> list[float]:
    return [base * 2 ** (i / per_octave) for i in range(per_octave)]


def legacy_anchors(size: float, scales: Sequence[float], ratios: Sequence[float]) -> list[tuple[float, float, float, float]]:
    """The older convention: centred on (size - 1) / 2, corners rounded, widths count pixels."""
    c = (size - 1) / 2
    return [tuple(float(round(v)) for v in (c - (w - 1) / 2, c - (h - 1) / 2, c + (w - 1) / 2, c + (h - 1) / 2)) for w, h in ((size * s / math.sqrt(r), size * s * math.sqrt(r)) for r in ratios for s in scales)]


def explicit_anchors(sizes: Sequence[tuple[float, float]], center: tuple[float, float]) -> list[tuple[float, float, float, float]]:
    """Anchors of given (width, height)."""
    return [(center[0] - w / 2, center[1] - h / 2, center[0] + w / 2, center[1] + h / 2) for w, h in sizes]


def point_grid(spark: SparkSession, height: int, width: int, stride: float, offset: float = 0.0, level: int = 0) -> DataFrame:
    """level, point_id, x, y, stride."""
    n = spark.range(height * width)
    return n.select(F.lit(level).alias("level"), F.col("id").alias("point_id"), ((F.col("id") % width + offset) * stride).alias("x"), ((F.expr(f"id div {width}") + offset) * stride).alias("y"), F.lit(float(stride)).alias("stride"))


def anchor_grid(spark: SparkSession, anchors: Sequence[tuple[float, float, float, float]], height: int, width: int, stride: float, level: int = 0) -> DataFrame:
    """level, prior_id, x1, y1, x2, y2 of every anchor of every cell."""
    k = len(anchors)
    n = spark.range(height * width * k)
    cell = F.expr(f"id div {k}")
    a = F.array(*[F.struct(*[F.lit(float(v)).alias(c) for v, c in zip(b, ("x1", "y1", "x2", "y2"), strict=True)]) for b in anchors])
    box = Box.of(F.get(a, (F.col("id") % k).cast("int"))).translate((cell % width) * float(stride), F.expr(f"(id div {k}) div {width}") * float(stride))
    return n.select(F.lit(level).alias("level"), F.col("id").alias("prior_id"), *box.columns())


def levels(grids: Sequence[DataFrame]) -> DataFrame:
    """Grids of several levels as one table; ids count on from level to level."""
    out, shift = None, 0
    for g in grids:
        name = "prior_id" if "prior_id" in g.columns else "point_id"
        size = g.count()
        g = g.withColumn(name, F.col(name) + shift)
        out = g if out is None else out.unionByName(g)
        shift += size
    return out


def inside_flags(prior: Box, valid: Column, height: float, width: float, border: float = 0) -> Column:
    """Valid priors that lie in the image up to ``border``; all valid ones if the border is negative."""
    if border < 0:
        return valid
    return valid & (prior.x1 >= -border) & (prior.y1 >= -border) & (prior.x2 < width + border) & (prior.y2 < height + border)


def center_part(box: Box, ratio: float, size: tuple[int, int] | None = None) -> list[Column]:
    """Corners moved to the centre by ``ratio``, rounded half to even, clamped to a map of ``size`` (height, width)."""
    r = float(ratio)
    out = [F.bround((1 - r) * a + r * b) for a, b in ((box.x1, box.x2), (box.y1, box.y2), (box.x2, box.x1), (box.y2, box.y1))]
    if size:
        most = (size[1], size[0], size[1], size[0])
        out = [F.least(F.greatest(v, F.lit(0.0)), F.lit(float(m))) for v, m in zip(out, most, strict=True)]
    return out
