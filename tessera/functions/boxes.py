"""Box functions as column expressions. A box is ``Box(x1, y1, x2, y2)`` of columns; nothing here leaves the JVM."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Type of a box inside a nested column.
BOX_TYPE = T.StructType([T.StructField(n, T.DoubleType()) for n in ("x1", "y1", "x2", "y2")])
EPS = 1e-6


def _num(v: Column | float) -> Column:
    return v if isinstance(v, Column) else F.lit(float(v))


@dataclass(frozen=True)
class Box:
    """Corners of an axis-aligned box."""

    x1: Column
    y1: Column
    x2: Column
    y2: Column

    @classmethod
    def of(cls, column: str | Column) -> Box:
        """From a struct column with fields x1, y1, x2, y2."""
        c = F.col(column) if isinstance(column, str) else column
        return cls(c["x1"], c["y1"], c["x2"], c["y2"])

    @classmethod
    def named(cls, prefix: str = "") -> Box:
        """From four columns."""
        return cls(*[F.col(prefix + n) for n in ("x1", "y1", "x2", "y2")])

    @classmethod
    def xywh(cls, x: Column, y: Column, w: Column, h: Column) -> Box:
        return cls(x, y, x + w, y + h)

    @classmethod
    def cxcywh(cls, cx: Column, cy: Column, w: Column, h: Column) -> Box:
        return cls(cx - w / 2, cy - h / 2, cx + w / 2, cy + h / 2)

    @classmethod
    def cxcyah(cls, cx: Column, cy: Column, ratio: Column, h: Column) -> Box:
        return cls.cxcywh(cx, cy, ratio * h, h)

    @property
    def width(self) -> Column:
        return self.x2 - self.x1

    @property
    def height(self) -> Column:
        return self.y2 - self.y1

    @property
    def area(self) -> Column:
        return self.width * self.height

    @property
    def center(self) -> tuple[Column, Column]:
        return (self.x1 + self.x2) / 2, (self.y1 + self.y2) / 2

    @property
    def corners(self) -> tuple[Column, Column, Column, Column]:
        return self.x1, self.y1, self.x2, self.y2

    def struct(self) -> Column:
        return F.struct(*[c.cast("double").alias(n) for n, c in zip(("x1", "y1", "x2", "y2"), self.corners, strict=True)])

    def columns(self, prefix: str = "") -> list[Column]:
        return [c.alias(prefix + n) for n, c in zip(("x1", "y1", "x2", "y2"), self.corners, strict=True)]

    def as_xywh(self) -> list[Column]:
        return [self.x1, self.y1, self.width, self.height]

    def as_cxcywh(self) -> list[Column]:
        return [*self.center, self.width, self.height]

    def as_cxcyah(self) -> list[Column]:
        """Centre, ratio w / h (null for boxes without height), height."""
        return [*self.center, F.try_divide(self.width, self.height), self.height]

    def corner_points(self) -> Column:
        """The four corners, clockwise from the top left."""
        return F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in ((self.x1, self.y1), (self.x2, self.y1), (self.x2, self.y2), (self.x1, self.y2))])

    # moving and scaling

    def translate(self, dx, dy) -> Box:
        return Box(self.x1 + _num(dx), self.y1 + _num(dy), self.x2 + _num(dx), self.y2 + _num(dy))

    def scale(self, sx, sy) -> Box:
        """About the origin."""
        return Box(self.x1 * _num(sx), self.y1 * _num(sy), self.x2 * _num(sx), self.y2 * _num(sy))

    def resize(self, sx, sy) -> Box:
        """About the centre."""
        cx, cy = self.center
        return Box.cxcywh(cx, cy, self.width * _num(sx), self.height * _num(sy))

    def clip(self, width, height) -> Box:
        """Into [0, width] x [0, height]."""
        x = lambda v: F.least(F.greatest(v, F.lit(0.0)), _num(width))
        y = lambda v: F.least(F.greatest(v, F.lit(0.0)), _num(height))
        return Box(x(self.x1), y(self.y1), x(self.x2), y(self.y2))

    def flip(self, width, height, direction: str = "horizontal") -> Box:
        """``horizontal``, ``vertical`` or ``diagonal`` (both) mirror image on a canvas."""
        if direction not in ("horizontal", "vertical", "diagonal"):
            raise ValueError(f"unknown direction {direction!r}")
        out = self
        if direction != "vertical":
            out = Box(_num(width) - out.x2, out.y1, _num(width) - out.x1, out.y2)
        if direction != "horizontal":
            out = Box(out.x1, _num(height) - out.y2, out.x2, _num(height) - out.y1)
        return out

    def map(self, width, height, sx, sy, direction: str | None = None) -> Box:
        """Scale, then flip on the scaled canvas."""
        out = self.scale(sx, sy)
        return out.flip(width, height, direction) if direction else out

    def map_back(self, width, height, sx, sy, direction: str | None = None) -> Box:
        """The inverse of ``map``."""
        out = self.flip(width, height, direction) if direction else self
        return Box(out.x1 / _num(sx), out.y1 / _num(sy), out.x2 / _num(sx), out.y2 / _num(sy))

    def around(self, points: list[tuple[Column, Column]]) -> Box:
        xs, ys = [p[0] for p in points], [p[1] for p in points]
        return Box(F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys))

    def _points(self) -> list[tuple[Column, Column]]:
        return [(self.x1, self.y1), (self.x2, self.y1), (self.x2, self.y2), (self.x1, self.y2)]

    def project(self, matrix: list[list[float]], size: tuple | None = None) -> Box:
        """Bounding box of the corners under a homography; clipped to ``size`` (height, width) if given."""
        (a, b, c), (d, e, f), (g, h, i) = matrix
        points = []
        for x, y in self._points():
            w = x * float(g) + y * float(h) + float(i)
            points.append(((x * float(a) + y * float(b) + float(c)) / w, (x * float(d) + y * float(e) + float(f)) / w))
        out = self.around(points)
        return out.clip(size[1], size[0]) if size else out

    def rotate(self, cx, cy, degrees: float) -> Box:
        """Bounding box of the corners turned clockwise (y points down) about a point."""
        t = F.radians(_num(degrees))
        turn = lambda x, y: (_num(cx) + (x - _num(cx)) * F.cos(t) - (y - _num(cy)) * F.sin(t), _num(cy) + (x - _num(cx)) * F.sin(t) + (y - _num(cy)) * F.cos(t))
        return self.around([turn(x, y) for x, y in self._points()])

    # predicates

    def overlaps_canvas(self, width, height) -> Column:
        """Some of the box lies strictly inside the canvas."""
        return (self.x1 < _num(width)) & (self.x2 > 0) & (self.y1 < _num(height)) & (self.y2 > 0)

    def is_inside(self, width, height, all_inside: bool = False, border: float = 0) -> Column:
        if all_inside:
            return (self.x1 >= -border) & (self.y1 >= -border) & (self.x2 < _num(width) + border) & (self.y2 < _num(height) + border)
        return (self.x1 < _num(width) + border) & (self.y1 < _num(height) + border) & (self.x2 > -border) & (self.y2 > -border)

    def holds(self, x: Column, y: Column) -> Column:
        """The point lies in the box or on its edge."""
        return x.between(self.x1, self.x2) & y.between(self.y1, self.y2)

    # distances

    def distances_from(self, x: Column, y: Column, most: float | None = None, eps: float = 0.1) -> list[Column]:
        """Left, top, right, bottom distances of a point; clamped to [0, most - eps] if ``most`` is given."""
        out = [x - self.x1, y - self.y1, self.x2 - x, self.y2 - y]
        return [F.least(F.greatest(d, F.lit(0.0)), F.lit(most - eps)) for d in out] if most is not None else out

    @classmethod
    def from_distances(cls, x: Column, y: Column, left: Column, top: Column, right: Column, bottom: Column, size: tuple | None = None) -> Box:
        out = cls(x - left, y - top, x + right, y + bottom)
        return out.clip(size[1], size[0]) if size else out


def intersection(a: Box, b: Box, extra: float = 0.0) -> Column:
    w = F.least(a.x2, b.x2) - F.greatest(a.x1, b.x1) + extra
    h = F.least(a.y2, b.y2) - F.greatest(a.y1, b.y1) + extra
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def _areas(a: Box, b: Box, extra: float) -> tuple[Column, Column]:
    return (a.width + extra) * (a.height + extra), (b.width + extra) * (b.height + extra)


def iou(a: Box, b: Box, eps: float = EPS, extra: float = 0.0) -> Column:
    """Intersection over union; ``extra`` = 1 counts pixels as the older convention does."""
    inter = intersection(a, b, extra)
    one, two = _areas(a, b, extra)
    return inter / F.greatest(one + two - inter, F.lit(eps))


def iof(a: Box, b: Box, eps: float = EPS, extra: float = 0.0) -> Column:
    """Intersection over the area of ``a``."""
    return intersection(a, b, extra) / F.greatest(_areas(a, b, extra)[0], F.lit(eps))


def giou(a: Box, b: Box, eps: float = EPS) -> Column:
    inter = intersection(a, b)
    one, two = _areas(a, b, 0.0)
    union = F.greatest(one + two - inter, F.lit(eps))
    hull = (F.greatest(a.x2, b.x2) - F.least(a.x1, b.x1)) * (F.greatest(a.y2, b.y2) - F.least(a.y1, b.y1))
    hull = F.greatest(hull, F.lit(eps))
    return inter / union - (hull - union) / hull


OVERLAPS: dict[str, Callable[..., Column]] = {"iou": iou, "iof": iof, "giou": giou}


def overlap(a: Box, b: Box, mode: str = "iou", **options) -> Column:
    if mode not in OVERLAPS:
        raise ValueError(f"unknown mode {mode!r}")
    return OVERLAPS[mode](a, b, **options)


# ---------------------------------------------------------------- registry of box kinds

#: Constructors of boxes from four columns, by name of the layout.
KINDS: dict[str, Callable[..., Box]] = {"xyxy": Box, "xywh": Box.xywh, "cxcywh": Box.cxcywh, "cxcyah": Box.cxcyah}
_WRITERS: dict[str, Callable[[Box], list[Column]]] = {"xyxy": lambda b: list(b.corners), "xywh": Box.as_xywh, "cxcywh": Box.as_cxcywh, "cxcyah": Box.as_cxcyah}


def register_kind(name: str, read: Callable[..., Box], write: Callable[[Box], list[Column]], replace: bool = False) -> None:
    """Add a layout to ``convert``."""
    if name in KINDS and not replace:
        raise KeyError(f"{name!r} is registered already")
    KINDS[name], _WRITERS[name] = read, write


def convert(columns: list[Column], source: str, target: str) -> list[Column]:
    """Four columns in one layout as four columns in another."""
    if source not in KINDS or target not in _WRITERS:
        raise KeyError(f"no conversion from {source!r} to {target!r}")
    return _WRITERS[target](KINDS[source](*columns))


def gaussian_radius(height: Column, width: Column, overlap_: float) -> Column:
    """Largest corner shift in each of three cases that keeps the IoU at ``overlap_``, the least of them."""
    o = float(overlap_)
    s, p = height + width, height * width
    r1 = (s - F.sqrt(s * s - 4 * p * (1 - o) / (1 + o))) / 2
    r2 = (2 * s - F.sqrt(4 * s * s - 16 * (1 - o) * p)) / 8
    r3 = (-2 * o * s + F.sqrt(4 * o * o * s * s - 16 * o * (o - 1) * p)) / (8 * o)
    return F.least(r1, r2, r3)
