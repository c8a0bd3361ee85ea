"""Masks: polygons as arrays of flat coordinates, bitmaps as column-major run lengths (background first)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def polygon_area(polygon: Column) -> Column:
    """Shoelace area of [x0, y0, x1, y1, ...]."""
    n = (F.size(polygon) / 2).cast("int")
    at = lambda i, k: F.get(polygon, ((i % n) * 2 + k).cast("int"))
    twice = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0.0), lambda s, i: s + at(i, 0) * at(i + 1, 1) - at(i + 1, 0) * at(i, 1))
    return F.when(n >= 3, F.abs(twice) / 2).otherwise(0.0)


def polygons_area(polygons: Column) -> Column:
    return F.aggregate(F.transform(polygons, polygon_area), F.lit(0.0), lambda s, v: s + v)


def polygons_box(polygons: Column) -> Column:
    """Struct of the smallest box around all vertices."""
    flat = F.flatten(polygons)
    xs, ys = F.filter(flat, lambda v, i: i % 2 == 0), F.filter(flat, lambda v, i: i % 2 == 1)
    return F.struct(F.array_min(xs).alias("x1"), F.array_min(ys).alias("y1"), F.array_max(xs).alias("x2"), F.array_max(ys).alias("y2"))


def valid_polygon(polygon: Column) -> Column:
    return (F.size(polygon) % 2 == 0) & (F.size(polygon) >= 6)


def map_vertices(polygons: Column, width: float, height: float, fx, fy) -> Column:
    """Polygons with fx(x, y), fy(x, y) applied to each vertex, clipped to the canvas."""

    def one(p: Column) -> Column:
        x = lambda i: F.get(p, (i - i % 2).cast("int"))
        y = lambda i: F.get(p, (i - i % 2 + 1).cast("int"))
        inside = lambda v, most: F.least(F.greatest(v, F.lit(0.0)), F.lit(float(most)))
        return F.transform(p, lambda v, i: F.when(i % 2 == 0, inside(fx(x(i), y(i)), width)).otherwise(inside(fy(x(i), y(i)), height)))

    return F.transform(polygons, one)


def run_area(counts: Column) -> Column:
    """Foreground pixels of run lengths."""
    return F.aggregate(F.filter(counts, lambda v, i: i % 2 == 1), F.lit(0).cast("long"), lambda s, v: s + v)


def run_rows(counts: Column) -> Column:
    """(start, length) of the foreground runs, to be exploded and joined by pixel ranges."""
    starts = F.transform(counts, lambda v, i: F.aggregate(F.slice(counts, 1, i), F.lit(0).cast("long"), lambda s, w: s + w))
    pairs = F.arrays_zip(starts.alias("start"), counts.alias("length"))
    return F.filter(pairs, lambda p, i: (i % 2 == 1) & (p["length"] > 0))


# numpy side, for grouped functions and tests


def encode_runs(bitmap: np.ndarray) -> list[int]:
    """Column-major run lengths of a 0/1 array, background first."""
    flat = np.asarray(bitmap, bool).flatten(order="F")
    if not len(flat):
        return []
    edges = np.flatnonzero(np.diff(flat)) + 1
    runs = np.diff(np.concatenate([[0], edges, [len(flat)]])).tolist()
    return [0, *runs] if flat[0] else runs


def decode_runs(counts: list[int], height: int, width: int) -> np.ndarray:
    values = np.repeat(np.arange(len(counts)) % 2, counts)
    return values.reshape((height, width), order="F").astype(np.uint8)


def fill_polygon(polygon: list[float], height: int, width: int) -> np.ndarray:
    """Pixels whose centre is inside (even-odd rule)."""
    p = np.asarray(polygon, float).reshape(-1, 2)
    ys, xs = np.mgrid[0:height, 0:width] + 0.5
    inside = np.zeros((height, width), bool)
    for (x0, y0), (x1, y1) in zip(p, np.roll(p, -1, axis=0), strict=True):
        cross = (y0 > ys) != (y1 > ys)
        with np.errstate(divide="ignore", invalid="ignore"):
            inside ^= cross & (xs < (x1 - x0) * (ys - y0) / (y1 - y0) + x0)
    return inside.astype(np.uint8)


def bitmap_box(bitmap: np.ndarray) -> list[float]:
    """[x1, y1, x2, y2] with exclusive ends; zeros if there are no pixels."""
    ys, xs = np.nonzero(bitmap)
    return [float(xs.min()), float(ys.min()), float(xs.max() + 1), float(ys.max() + 1)] if len(xs) else [0.0] * 4


def rasterise(frame: pd.DataFrame) -> pd.DataFrame:
    """For mapInPandas: polygons, height, width to counts."""
    out = []
    for polygons, h, w in zip(frame["polygons"], frame["height"], frame["width"], strict=True):
        bitmap = np.zeros((h, w), np.uint8)
        for p in polygons:
            bitmap |= fill_polygon(p, h, w)
        out.append(encode_runs(bitmap))
    return frame.drop(columns=["polygons"]).assign(counts=out)
