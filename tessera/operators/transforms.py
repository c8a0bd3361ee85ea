"""Geometric transforms of image and box tables. Boxes are rows (image_id, corners, ...) with their canvas (width, height)
beside them; random decisions are draws from hashes of ids, so the same seed gives the same result anywhere."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.boxes import Box, iou
from .sampling import draw, draw_of

CORNERS = ("x1", "y1", "x2", "y2")


def _with(df: DataFrame, box: Box, **more: Column) -> DataFrame:
    return df.withColumns(dict(zip(CORNERS, box.corners, strict=True)) | more)


def filter_boxes(boxes: DataFrame, least_width: float = 1, least_height: float = 1, least_area: float | None = None, drop_empty: bool = True) -> tuple[DataFrame, str]:
    """Boxes wider and higher than the least sizes (strictly), and the rule for images that lose all: dropped or kept."""
    b = Box.named()
    keep = (b.width > least_width) & (b.height > least_height)
    if least_area is not None:
        keep = keep & (F.coalesce("mask_area", F.lit(0)) >= least_area)
    return boxes.where(keep), "dropped" if drop_empty else "kept"


def fit_scale(width: Column, height: Column, long_edge: float, short_edge: float) -> Column:
    """Largest scale with long and short edge within their limits."""
    return F.least(long_edge / F.greatest(width, height), short_edge / F.least(width, height))


def rescaled(width: Column, height: Column, scale: Column, truncate: bool = True) -> tuple[Column, Column]:
    """New size; truncated, or rounded half up."""
    f = (lambda v: v.cast("int")) if truncate else (lambda v: F.floor(v + 0.5).cast("int"))
    return f(width * scale), f(height * scale)


def resize(boxes: DataFrame, long_edge: float, short_edge: float, clip: bool = True) -> DataFrame:
    w, h = rescaled(F.col("width"), F.col("height"), fit_scale(F.col("width"), F.col("height"), long_edge, short_edge), truncate=False)
    x = boxes.withColumn("_w", w).withColumn("_h", h)
    b = Box.named().scale(F.col("_w") / F.col("width"), F.col("_h") / F.col("height"))
    b = b.clip(F.col("_w"), F.col("_h")) if clip else b
    return _with(x, b).withColumn("width", F.col("_w")).withColumn("height", F.col("_h")).drop("_w", "_h")


def resize_shortest(boxes: DataFrame, edge: float, most: float | None = None) -> DataFrame:
    """Short edge to ``edge`` unless the long one then exceeds ``most``; sizes rounded half up."""
    w, h = F.col("width"), F.col("height")
    s = edge / F.least(w, h)
    s = F.least(s, most / F.greatest(w, h)) if most else s
    nw, nh = rescaled(w, h, s, truncate=False)
    x = boxes.withColumn("_w", nw).withColumn("_h", nh)
    b = Box.named().scale(F.col("_w") / w, F.col("_h") / h)
    return _with(x, b).withColumn("width", F.col("_w")).withColumn("height", F.col("_h")).drop("_w", "_h")


def flip(boxes: DataFrame, probability: float = 0.5, direction: str = "horizontal", seed: int = 0, shift: float = 0.0) -> DataFrame:
    """Images flipped with some probability; ``shift`` moves flipped boxes back along x (an older pixel convention)."""
    f = Box.named().flip(F.col("width"), F.col("height"), direction)
    f = f.translate(-shift, 0) if shift and direction == "horizontal" else f
    go = draw(seed, "image_id") < probability
    x = boxes.withColumn("flipped", go)
    return x.select(*[c for c in x.columns if c not in CORNERS], *[F.when(F.col("flipped"), n).otherwise(F.col(c)).alias(c) for c, n in zip(CORNERS, f.corners, strict=True)])


def crop(boxes: DataFrame, left: Column | float, top: Column | float, width: float, height: float, clip: bool = True, allow_empty: bool = False) -> DataFrame:
    """Boxes on a crop of the canvas; those off it go, and with them images left without any (unless ``allow_empty``)."""
    l, t = (v if isinstance(v, Column) else F.lit(float(v)) for v in (left, top))
    b = Box.named().translate(-l, -t)
    c = b.clip(width, height) if clip else b
    x = _with(boxes.withColumn("_in", b.overlaps_canvas(width, height)), c)
    x = x.where("_in") if not allow_empty else x.withColumn("valid", F.col("_in"))
    return x.drop("_in").withColumn("width", F.lit(width)).withColumn("height", F.lit(height))


def shift(boxes: DataFrame, most: int = 32, least: float = 1, probability: float = 0.5, seed: int = 0) -> DataFrame:
    """Images moved by up to ``most`` pixels; boxes that stay larger than ``least``. An image that would lose all stays as it was."""
    dx = F.floor(draw(seed, "image_id") * (2 * most + 1)) - most
    dy = F.floor(draw(seed + 1, "image_id") * (2 * most + 1)) - most
    b = Box.named().translate(dx, dy).clip(F.col("width"), F.col("height"))
    x = boxes.withColumn("_go", draw(seed + 2, "image_id") < probability).withColumn("_b", b.struct())
    m = Box.of("_b")
    x = x.withColumn("_ok", (m.width > least) & (m.height > least)).withColumn("_any", F.max("_ok").over(Window.partitionBy("image_id")))
    moved = F.col("_go") & F.col("_any")
    x = x.where(~moved | F.col("_ok"))
    return x.select(*[c for c in boxes.columns if c not in CORNERS], *[F.when(moved, n).otherwise(F.col(c)).alias(c) for c, n in zip(CORNERS, m.corners, strict=True)])


def expand(boxes: DataFrame, ratio: float, seed: int = 0) -> DataFrame:
    """Images placed on a canvas ``ratio`` times as large."""
    w, h = (F.col("width") * ratio).cast("int"), (F.col("height") * ratio).cast("int")
    x = boxes.withColumn("_l", F.floor(draw(seed, "image_id") * (w - F.col("width") + 1))).withColumn("_t", F.floor(draw(seed + 1, "image_id") * (h - F.col("height") + 1)))
    return _with(x, Box.named().translate(F.col("_l"), F.col("_t"))).withColumn("width", w).withColumn("height", h).drop("_l", "_t")


def pad(boxes: DataFrame, size: tuple[int, int] | None = None, divisor: int = 1, square: bool = False) -> DataFrame:
    """Canvases of at least ``size`` (width, height), or square ones, and multiples of ``divisor``; boxes stay."""
    w, h = F.col("width"), F.col("height")
    if square:
        w = h = F.greatest(w, h)
    if size is not None:
        w, h = F.greatest(w, F.lit(size[0])), F.greatest(h, F.lit(size[1]))
    up = lambda v: (F.ceil(v / divisor) * divisor).cast("int")
    return boxes.withColumns({"width": up(w), "height": up(h)})


def iou_crop(boxes: DataFrame, least: Sequence[float] = (0.1, 0.3, 0.5, 0.7, 0.9), smallest: float = 0.3, tries: int = 50, seed: int = 0) -> DataFrame:
    """Images cropped to a drawn patch that overlaps every box by at least a drawn IoU, and holds some box's centre.

    Each image draws one of: no crop, one of ``least``, no bound. Of its ``tries`` drawn patches (sides of at least
    ``smallest`` of the image, sides' ratio within 2) the first that fits is taken; without any the image stays. Boxes
    whose centre lies outside the patch go, the others are clipped.
    """
    images = boxes.groupBy("image_id").agg(F.max("width").alias("_w"), F.max("height").alias("_h"))
    bounds = [F.lit(2.0), *[F.lit(float(v)) for v in least], F.lit(0.0)]  # 2: no crop
    x = images.withColumn("_least", F.get(F.array(*bounds), F.floor(draw(seed, "image_id") * len(bounds)).cast("int"))).where("_least <= 1")
    x = x.withColumn("try", F.explode(F.sequence(F.lit(1), F.lit(tries))))
    side = lambda k, full: full * (smallest + (1 - smallest) * draw(seed + k, "image_id", "try"))
    x = x.withColumn("_nw", side(1, F.col("_w"))).withColumn("_nh", side(2, F.col("_h"))).where((F.col("_nh") / F.col("_nw") >= 0.5) & (F.col("_nh") / F.col("_nw") <= 2))
    x = x.withColumn("_l", draw(seed + 3, "image_id", "try") * (F.col("_w") - F.col("_nw"))).withColumn("_t", draw(seed + 4, "image_id", "try") * (F.col("_h") - F.col("_nh")))
    corners = (F.floor("_l"), F.floor("_t"), F.floor(F.col("_l") + F.col("_nw")), F.floor(F.col("_t") + F.col("_nh")))
    x = x.select("image_id", "try", "_least", *[c.cast("double").alias(f"_p{n}") for c, n in zip(corners, CORNERS, strict=True)])
    b, p = Box.named(), Box.named("_p")
    cx, cy = b.center
    inside = (cx > p.x1) & (cy > p.y1) & (cx < p.x2) & (cy < p.y2)
    tested = x.join(boxes, "image_id").groupBy("image_id", "try", *[f"_p{n}" for n in CORNERS]).agg(F.min(iou(p, b)).alias("_min"), F.max(inside).alias("_some"), F.max("_least").alias("_least"))
    chosen = tested.where((F.col("_min") >= F.col("_least")) & F.col("_some")).groupBy("image_id").agg(F.min(F.struct("try", *[f"_p{n}" for n in CORNERS])).alias("_c")).select("image_id", "_c.*").drop("try")
    y = boxes.join(chosen, "image_id", "left").where(F.col("_px1").isNull() | inside)
    cut, go = b.translate(-p.x1, -p.y1).clip(p.width, p.height), F.col("_px1").isNotNull()
    keep = [c for c in boxes.columns if c not in (*CORNERS, "width", "height")]
    sizes = [F.when(go, n.cast("int")).otherwise(F.col(c)).alias(c) for c, n in (("width", p.width), ("height", p.height))]
    return y.select(*keep, *[F.when(go, n).otherwise(F.col(c)).alias(c) for c, n in zip(CORNERS, cut.corners, strict=True)], *sizes)


def partners(images: DataFrame, count: int, seed: int = 0) -> DataFrame:
    """image_id, place (1 to ``count``), partner: drawn images, the same for the same seed. Images are numbered densely."""
    shard = F.pmod("image_id", F.lit(256))
    x = images.select("image_id", "width", "height", shard.alias("s")).withColumn("_r", F.row_number().over(Window.partitionBy("s").orderBy("image_id")) - 1)
    before = x.groupBy("s").agg(F.count("*").alias("n"))
    before = before.select("s", (F.sum("n").over(Window.orderBy("s")) - F.col("n")).alias("b"), F.sum("n").over(Window.partitionBy()).alias("total"))  # 256 rows
    x = x.join(F.broadcast(before), "s").select("image_id", "width", "height", (F.col("b") + F.col("_r")).alias("i"), "total")
    want = x.select("image_id", "total", F.explode(F.sequence(F.lit(1), F.lit(count))).alias("place")).withColumn("i", F.floor(draw(seed, "image_id", "place") * F.col("total")))
    other = x.select("i", F.col("image_id").alias("partner"), F.col("width").alias("partner_width"), F.col("height").alias("partner_height"))
    return want.join(other, "i").select("image_id", "place", "partner", "partner_width", "partner_height")


def mosaic(boxes: DataFrame, images: DataFrame, size: int = 640, seed: int = 0) -> DataFrame:
    """Boxes of four images on a canvas of twice ``size``, one in each quadrant round the middle; clipped, empty ones go."""
    four = images.select("image_id", F.lit(0).alias("place"), F.col("image_id").alias("partner"), F.col("width").alias("partner_width"), F.col("height").alias("partner_height")).unionByName(partners(images, 3, seed))
    s = F.least(size / F.col("partner_height"), size / F.col("partner_width"))
    w, h = (F.col("partner_width") * s).cast("int"), (F.col("partner_height") * s).cast("int")
    left, top = F.col("place") % 2 == 0, F.col("place") < 2
    four = four.withColumn("_s", s).withColumn("_x", F.when(left, size - w).otherwise(F.lit(size))).withColumn("_y", F.when(top, size - h).otherwise(F.lit(size)))
    x = four.join(boxes.drop("width", "height").withColumnRenamed("image_id", "partner"), "partner")
    b = Box.named().scale(F.col("_s"), F.col("_s")).translate(F.col("_x"), F.col("_y")).clip(2 * size, 2 * size)
    x = _with(x, b).where((F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1")))
    return x.drop("_s", "_x", "_y", "partner_width", "partner_height").withColumn("width", F.lit(2 * size)).withColumn("height", F.lit(2 * size))


def mixup(boxes: DataFrame, images: DataFrame, seed: int = 0) -> DataFrame:
    """An image's boxes and those of a drawn partner, scaled into its canvas."""
    p = partners(images, 1, seed).join(images, "image_id").withColumn("_s", F.least(F.col("width") / F.col("partner_width"), F.col("height") / F.col("partner_height")))
    other = p.select("image_id", "partner", "_s").join(boxes.drop("width", "height").withColumnRenamed("image_id", "partner"), "partner")
    other = _with(other, Box.named().scale(F.col("_s"), F.col("_s"))).drop("_s", "partner").withColumn("mixed", F.lit(1))
    return boxes.drop("width", "height").withColumn("mixed", F.lit(0)).unionByName(other)


def affine(boxes: DataFrame, matrix: list[list[float]], width: float, height: float) -> DataFrame:
    """Corners projected, boxed again, clipped; boxes off the canvas go."""
    b = Box.named().project(matrix)
    x = _with(boxes.withColumn("_in", b.overlaps_canvas(width, height)), b.clip(width, height))
    return x.where("_in").drop("_in")


def _inner_border(border: int, size: Column) -> Column:
    """``border`` halved until twice of it is less than the size."""
    k = 2.0 * border / size
    return F.floor(border / F.pow(F.lit(2.0), F.ceil(F.log2(F.ceil(k))) + (k == F.floor(k)).cast("int")))


def centre_crop_pad(boxes: DataFrame, images: DataFrame, size: tuple[int, int], ratios: Sequence[float] = (0.9, 1.0, 1.1), border: int = 128, tries: int = 50, rounds: int = 4, seed: int = 0) -> DataFrame:
    """Boxes on a canvas of ``size`` (width, height) times a drawn ratio, whose middle lies on a drawn point of the image.

    The point keeps a border from the image's edges. Of at most ``rounds`` ratios with ``tries`` points each the first is
    taken under which some box has its centre in the part of the image on the canvas; other boxes go, and those that stay
    are moved and clipped. An image without such a point keeps its boxes and its canvas. ``images``: image_id, width,
    height. An image's box centres are one array, so nothing but the boxes is shuffled."""
    b = Box.named()
    cx, cy = b.center
    centres = boxes.groupBy("image_id").agg(F.collect_list(F.struct(cx.alias("x"), cy.alias("y"))).alias("_c"))
    x = images.select("image_id", "width", "height").join(centres, "image_id")
    w, h = F.col("width"), F.col("height")

    def attempt(k: Column) -> Column:
        u = lambda j, v: draw_of(seed + j, F.col("image_id"), v.cast("long"))
        ratio = F.get(F.array(*[F.lit(float(r)) for r in ratios]), F.floor(u(0, F.floor(k / tries)) * len(ratios)).cast("int"))
        point = [_inner_border(border, s) + F.floor(u(j, k) * (s - 2 * _inner_border(border, s))) for j, s in ((1, w), (2, h))]
        return F.struct(*[c.cast("long").alias(n) for n, c in (("nw", size[0] * ratio), ("nh", size[1] * ratio), ("px", point[0]), ("py", point[1]))])

    def shown(a: Column, c: Column) -> Column:
        """The point ``c`` is in the part of the image on the canvas."""
        near = lambda at, p, s, full: (at > F.greatest(F.lit(0), p - F.floor(s / 2))) & (at < F.least(p + F.floor(s / 2), full))
        return near(c["x"], a["px"], a["nw"], w) & near(c["y"], a["py"], a["nh"], h)

    all_tries = F.transform(F.sequence(F.lit(0), F.lit(tries * rounds - 1)), attempt)
    found = F.get(F.filter(all_tries, lambda a: F.exists("_c", lambda c: shown(a, c))), F.lit(0))
    y = boxes.drop("width", "height").join(x.select("image_id", "width", "height", found.alias("_a")), "image_id")
    a = F.col("_a")
    y = y.where(a.isNull() | shown(a, F.struct(cx.alias("x"), cy.alias("y"))))
    new = b.translate(F.floor(a["nw"] / 2) - a["px"], F.floor(a["nh"] / 2) - a["py"]).clip(a["nw"], a["nh"])
    y = y.withColumns({f"_{c}": F.when(a.isNull(), F.col(c)).otherwise(v) for c, v in zip(CORNERS, new.corners, strict=True)})
    y = y.withColumns({"width": F.coalesce(a["nw"], w.cast("long")), "height": F.coalesce(a["nh"], h.cast("long"))} | {c: F.col(f"_{c}") for c in CORNERS})
    return y.where(Box.named().is_inside(F.col("width"), F.col("height"))).drop("_a", *[f"_{c}" for c in CORNERS])


def centre_pad(boxes: DataFrame, low_bits: int | None = 127, divisor: int | None = None, more: int = 0) -> DataFrame:
    """Boxes on a larger canvas with the same middle: sizes with all ``low_bits`` set, plus ``more``, or, with ``divisor``,
    its next multiples."""
    grown = lambda s: (F.ceil(F.col(s) / divisor) * divisor) if divisor else (F.col(s).cast("long").bitwiseOR(F.lit(low_bits)) + more)
    x = boxes.withColumn("_w", grown("width")).withColumn("_h", grown("height"))
    shift = lambda new, old: F.floor(F.col(new) / 2) - F.floor(F.col(old) / 2)
    x = _with(x, Box.named().translate(shift("_w", "width"), shift("_h", "height")))
    return x.withColumn("width", F.col("_w")).withColumn("height", F.col("_h")).drop("_w", "_h")
