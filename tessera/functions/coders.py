"""Box coders: encode a box against a prior, and back."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .boxes import Box

ZERO, ONE = (0.0,) * 4, (1.0,) * 4


def encode_delta(prior: Box, box: Box, means=ZERO, stds=ONE, extra: float = 0.0) -> list[Column]:
    """Centre shift by prior size and log size ratio, normalised; ``extra`` = 1: the older convention."""
    pw, ph, gw, gh = prior.width + extra, prior.height + extra, box.width + extra, box.height + extra
    (px, py), (gx, gy) = prior.center, box.center
    raw = [(gx - px) / pw, (gy - py) / ph, F.ln(gw / pw), F.ln(gh / ph)]
    return [(d - float(m)) / float(s) for d, m, s in zip(raw, means, stds, strict=True)]


def decode_delta(prior: Box, delta: list[Column], means=ZERO, stds=ONE, size: tuple | None = None, ratio_clip: float = 16 / 1000, center_clamp: float | None = None, extra: float = 0.0) -> Box:
    """Inverse of ``encode_delta``. Log sizes are clamped to +-|ln(ratio_clip)|; with ``center_clamp`` (pixels) the centre
    shift is clamped and only large sizes are; ``size`` (height, width) clips the result."""
    dx, dy, dw, dh = [d * float(s) + float(m) for d, m, s in zip(delta, means, stds, strict=True)]
    most = abs(math.log(ratio_clip))
    pw, ph = prior.width + extra, prior.height + extra
    px, py = prior.center
    sx, sy = pw * dx, ph * dy
    if center_clamp is not None:
        sx, sy = [F.least(F.greatest(v, F.lit(-float(center_clamp))), F.lit(float(center_clamp))) for v in (sx, sy)]
        dw, dh = F.least(dw, F.lit(most)), F.least(dh, F.lit(most))
    else:
        dw, dh = [F.least(F.greatest(v, F.lit(-most)), F.lit(most)) for v in (dw, dh)]
    w, h = pw * F.exp(dw), ph * F.exp(dh)
    cx, cy = px + sx, py + sy
    out = Box(cx - w / 2 + extra / 2, cy - h / 2 + extra / 2, cx + w / 2 - extra / 2, cy + h / 2 - extra / 2)
    return out.clip(size[1] - extra, size[0] - extra) if size else out


def encode_sides(prior: Box, box: Box, normalizer: float = 4.0) -> list[Column]:
    """Top, bottom, left, right distances of the prior's centre by its size and ``normalizer``."""
    cx, cy = prior.center
    n = float(normalizer)
    return [(cy - box.y1) / prior.height / n, (box.y2 - cy) / prior.height / n, (cx - box.x1) / prior.width / n, (box.x2 - cx) / prior.width / n]


def decode_sides(prior: Box, sides: list[Column], normalizer: float = 4.0, size: tuple | None = None) -> Box:
    cx, cy = prior.center
    top, bottom, left, right = [s * float(normalizer) for s in sides]
    out = Box(cx - left * prior.width, cy - top * prior.height, cx + right * prior.width, cy + bottom * prior.height)
    return out.clip(size[1], size[0]) if size else out


def encode_cell(prior: Box, box: Box, stride: Column | float, eps: float = 1e-6) -> list[Column]:
    """Centre offset within a grid cell, clamped to [eps, 1 - eps], and log size ratio."""
    (px, py), (gx, gy) = prior.center, box.center
    s = stride if isinstance(stride, Column) else F.lit(float(stride))
    clamp = lambda v: F.least(F.greatest(v, F.lit(eps)), F.lit(1 - eps))
    log = lambda a, b: F.ln(F.greatest(a / b, F.lit(eps)))
    return [clamp((gx - px) / s + 0.5), clamp((gy - py) / s + 0.5), log(box.width, prior.width), log(box.height, prior.height)]


def decode_cell(prior: Box, code: list[Column], stride: Column | float) -> Box:
    s = stride if isinstance(stride, Column) else F.lit(float(stride))
    px, py = prior.center
    cx, cy = px + (code[0] - 0.5) * s, py + (code[1] - 0.5) * s
    w, h = prior.width / 2 * F.exp(code[2]), prior.height / 2 * F.exp(code[3])
    return Box(cx - w, cy - h, cx + w, cy + h)


def encode_distance(x: Column, y: Column, box: Box, most: float | None = None, eps: float = 0.1) -> list[Column]:
    return box.distances_from(x, y, most, eps)


def decode_distance(x: Column, y: Column, code: list[Column], size: tuple | None = None) -> Box:
    return Box.from_distances(x, y, *code, size=size)


def _bucket_edges(prior: Box, buckets: int, scale: float) -> tuple[Box, Column, Column]:
    """The prior stretched by ``scale``, and its bucket width and height."""
    (cx, cy), w, h = prior.center, prior.width * scale, prior.height * scale
    return Box(cx - w / 2, cy - h / 2, cx + w / 2, cy + h / 2), w / buckets, h / buckets


def encode_buckets(prior: Box, box: Box, buckets: int = 14, scale: float = 3.0) -> dict[str, Column]:
    """For each side of a box: the bucket of the stretched prior that it is nearest to, counted from its own side, and
    the offset from that bucket's centre in buckets. ``l``, ``r``, ``t``, ``d`` and ``l_offset`` ... ``d_offset``."""
    p, bw, bh = _bucket_edges(prior, buckets, scale)
    half = -(-buckets // 2)
    out = {}
    for name, edge, side, step, sign in (("l", p.x1, box.x1, bw, 1), ("r", p.x2, box.x2, bw, -1), ("t", p.y1, box.y1, bh, 1), ("d", p.y2, box.y2, bh, -1)):
        place = sign * (side - edge) / step - 0.5
        k = F.least(F.greatest(F.ceil(place - 0.5), F.lit(0)), F.lit(half - 1)).cast("int")  # of two equally near ones the first
        out[name], out[f"{name}_offset"] = k, place - k
    return out


def decode_buckets(prior: Box, code: dict[str, Column], buckets: int = 14, scale: float = 3.0, size: tuple | None = None) -> Box:
    """Inverse of ``encode_buckets``; ``size`` (height, width) clips."""
    p, bw, bh = _bucket_edges(prior, buckets, scale)
    at = lambda n, edge, step, sign: edge + sign * (code[n] + 0.5 + code[f"{n}_offset"]) * step
    out = Box(at("l", p.x1, bw, 1), at("t", p.y1, bh, 1), at("r", p.x2, bw, -1), at("d", p.y2, bh, -1))
    return out.clip(size[1], size[0]) if size else out
