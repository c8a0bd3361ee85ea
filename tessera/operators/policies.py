"""Augmentation policies as data: which steps an image gets is drawn from its id, and its boxes are folded over them.

A step is (operation, probability, level). The level, 0 to 10, or a draw where it is None, gives a magnitude between 0 and the
operation's greatest one, rounded to one decimal, and its sign is drawn. Geometric operations move the boxes; others leave them as they
are, and stand in ``steps`` for whoever changes the pixels. Everything is one projection: no join and no shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.boxes import Box
from .sampling import draw_of

Step = tuple[str, float, int | None]
CORNERS = ("x1", "y1", "x2", "y2")
#: Greatest magnitudes (degrees, degrees, degrees, share of the width, share of the height).
GREATEST = {"ShearX": 30.0, "ShearY": 30.0, "Rotate": 30.0, "TranslateX": 0.1, "TranslateY": 0.1}
#: Operations of the random search space.
SPACE = (
    "AutoContrast", "Equalize", "Invert", "Rotate", "Posterize", "Solarize", "SolarizeAdd", "Color", "Contrast", "Brightness",
    "Sharpness", "ShearX", "ShearY", "TranslateX", "TranslateY",
)
#: The published learned policies.
LEARNED: tuple[tuple[Step, ...], ...] = (
    (("Equalize", 0.8, 1), ("ShearY", 0.8, 4)),
    (("Color", 0.4, 9), ("Equalize", 0.6, 3)),
    (("Color", 0.4, 1), ("Rotate", 0.6, 8)),
    (("Solarize", 0.8, 3), ("Equalize", 0.4, 7)),
    (("Solarize", 0.4, 2), ("Solarize", 0.6, 2)),
    (("Color", 0.2, 0), ("Equalize", 0.8, 8)),
    (("Equalize", 0.4, 8), ("SolarizeAdd", 0.8, 3)),
    (("ShearX", 0.2, 9), ("Rotate", 0.6, 8)),
    (("Color", 0.6, 1), ("Equalize", 1.0, 2)),
    (("Invert", 0.4, 9), ("Rotate", 0.6, 0)),
    (("Equalize", 1.0, 9), ("ShearY", 0.6, 3)),
    (("Color", 0.4, 7), ("Equalize", 0.6, 0)),
    (("Posterize", 0.4, 6), ("AutoContrast", 0.4, 7)),
    (("Solarize", 0.6, 8), ("Color", 0.6, 9)),
    (("Solarize", 0.2, 4), ("Rotate", 0.8, 9)),
    (("Rotate", 1.0, 7), ("TranslateY", 0.8, 9)),
    (("ShearX", 0.0, 0), ("Solarize", 0.8, 4)),
    (("ShearY", 0.8, 0), ("Color", 0.6, 4)),
    (("Color", 1.0, 0), ("Rotate", 0.6, 2)),
    (("Equalize", 0.8, 4), ("Equalize", 0.0, 8)),
    (("Equalize", 1.0, 4), ("AutoContrast", 0.6, 2)),
    (("ShearY", 0.4, 7), ("SolarizeAdd", 0.6, 7)),
    (("Posterize", 0.8, 2), ("Solarize", 0.6, 10)),
    (("Solarize", 0.6, 8), ("Equalize", 0.6, 1)),
    (("Color", 0.8, 6), ("Rotate", 0.4, 5)),
)


def magnitude(kind: Column, level: Column, drawn: Column) -> Column:
    """Magnitude of a level, or of a draw in [0, 1) where the level is null; 0 for operations that move nothing."""
    most = F.lit(0.0)
    for name, m in GREATEST.items():
        most = F.when(kind == name, m).otherwise(most)
    return F.round(F.coalesce(level / 10, drawn) * most, 1)


def _literal(steps: Sequence[Step]) -> Column:
    return F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(float(p)).alias("probability"), F.lit(v).cast("double").alias("level")) for k, p, v in steps])


def _drawn(steps: Column, seed: int) -> Column:
    """(kind, magnitude) of the steps that are taken; draws by image and place in the list."""

    def one(s: Column, i: Column) -> Column:
        u = lambda k: draw_of(seed + k, F.col("image_id"), i.cast("long"))
        m = magnitude(s["kind"], s["level"], u(2))
        return F.struct(s["kind"].alias("kind"), F.when(u(3) > 0.5, -m).otherwise(m).alias("magnitude"), (u(1) <= s["probability"]).alias("taken"))

    return F.filter(F.transform(steps, one), lambda s: s["taken"])


def _moved(b: Column, s: Column) -> Column:
    """A box after one step, on the canvas (width, height)."""
    box, m = Box(*[b[c] for c in CORNERS]), s["magnitude"]
    w, h, shear = F.col("width"), F.col("height"), F.tan(F.radians(m))
    points = box._points()
    ways = {
        "ShearX": box.around([(x + shear * y, y) for x, y in points]),
        "ShearY": box.around([(x, y + shear * x) for x, y in points]),
        "Rotate": box.rotate((w - 1) * 0.5, (h - 1) * 0.5, m),
        "TranslateX": box.translate((w * m).cast("int"), 0.0),
        "TranslateY": box.translate(0.0, (h * m).cast("int")),
    }
    out = b
    for kind, new in ways.items():
        out = F.when(s["kind"] == kind, F.struct(*[v.alias(c) for v, c in zip(new.clip(w, h).corners, CORNERS, strict=True)])).otherwise(out)
    return out


def _folded(boxes: DataFrame, steps: Column, seed: int) -> DataFrame:
    x = boxes.withColumn("steps", _drawn(steps, seed))
    start = F.struct(*[F.col(c).cast("double").alias(c) for c in CORNERS])
    x = x.withColumn("_box", F.aggregate("steps", start, _moved))
    return x.withColumns({c: F.col(f"_box.{c}") for c in CORNERS} | {"steps": F.transform("steps", lambda s: s.dropFields("taken"))}).drop("_box")


def auto_augment(boxes: DataFrame, policies: Sequence[Sequence[Step]] = LEARNED, seed: int = 0) -> DataFrame:
    """Boxes (image_id, corners, width, height) of each image after one drawn policy, and the steps taken."""
    every = F.array(*[_literal(p) for p in policies])
    return _folded(boxes, F.get(every, F.floor(draw_of(seed, F.col("image_id")) * len(policies)).cast("int")), seed)


def rand_augment(boxes: DataFrame, space: Sequence[str] = SPACE, count: int = 2, seed: int = 0) -> DataFrame:
    """Boxes of each image after ``count`` different operations of the space, in drawn order, of drawn magnitude."""
    keyed = F.transform(_literal([(k, 1.0, None) for k in space]), lambda s, i: F.struct(draw_of(seed, F.col("image_id"), i.cast("long")).alias("u"), i.alias("i"), s["kind"].alias("kind"), s["probability"].alias("probability"), s["level"].alias("level")))
    return _folded(boxes, F.slice(F.array_sort(keyed), 1, count), seed)
