"""Box functions, matching and average precision."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ...functions import boxes as B
from ...functions import coders as C
from ...operators import matching as M
from .. import views
from .registry import query

IOU = "greatest(least(d.x2, g.x2) - greatest(d.x1, g.x1), 0) * greatest(least(d.y2, g.y2) - greatest(d.y1, g.y1), 0)"
_IOU_SQL = """, p AS (
  SELECT d.det_id, g.gt_id, d.image_id, d.label, d.score, g.ignored, d.x1 AS dx1, d.y1 AS dy1, d.x2 AS dx2, d.y2 AS dy2, g.x1 AS gx1, g.y1 AS gy1, g.x2 AS gx2, g.y2 AS gy2,
         greatest(least(d.x2, g.x2) - greatest(d.x1, g.x1) + {e}, 0) * greatest(least(d.y2, g.y2) - greatest(d.y1, g.y1) + {e}, 0) AS inter,
         (d.x2 - d.x1 + {e}) * (d.y2 - d.y1 + {e}) AS da, (g.x2 - g.x1 + {e}) * (g.y2 - g.y1 + {e}) AS ga
  FROM det d JOIN gt g ON d.image_id = g.image_id AND d.label = g.label
)"""


def pair_sql(extra: int = 0) -> str:
    return _IOU_SQL.format(e=extra)


@query(
    "box_overlaps",
    pair_sql()
    + """, h AS (SELECT *, greatest(da + ga - inter, 0.000001) AS uni, (greatest(dx2, gx2) - least(dx1, gx1)) * (greatest(dy2, gy2) - least(dy1, gy1)) AS hull FROM p)
SELECT det_id, gt_id, round(inter / uni, 9) AS iou, round(inter / greatest(da, 0.000001), 9) AS iof, round(inter / uni - (hull - uni) / hull, 9) AS giou FROM h""",
)
def box_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = M.pairs(views.detections(spark, sf_dir), views.ground_truth(spark, sf_dir))
    d, g = B.Box.named("d_"), B.Box.named("g_")
    return p.select("det_id", "gt_id", *[F.round(B.overlap(d, g, m), 9).alias(m) for m in B.OVERLAPS])


@query("box_overlaps_legacy", pair_sql(1) + " SELECT det_id, gt_id, round(inter / greatest(da + ga - inter, 0.000001), 9) AS iou FROM p")
def box_overlaps_legacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.pairs(views.detections(spark, sf_dir), views.ground_truth(spark, sf_dir), extra=1.0).select("det_id", "gt_id", F.round("iou", 9).alias("iou"))


@query(
    "box_conversions",
    """ SELECT event_id, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy, x2 - x1 AS w, y2 - y1 AS h, round((x2 - x1) / (y2 - y1), 9) AS ratio,
  x1 AS bx1, y1 AS by1, x2 AS bx2, y2 AS by2, (x2 - x1) * (y2 - y1) AS area FROM box""",
)
def box_conversions(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = B.Box.named()
    cx, cy, w, h = B.convert(list(b.corners), "xyxy", "cxcywh")
    back = B.convert([cx, cy, w, h], "cxcywh", "xyxy")
    return views.boxes(spark, sf_dir).select(
        "event_id", cx.alias("cx"), cy.alias("cy"), w.alias("w"), h.alias("h"), F.round(b.as_cxcyah()[2], 9).alias("ratio"), *[c.alias(n) for n, c in zip(("bx1", "by1", "bx2", "by2"), back, strict=True)], b.area.alias("area")
    )


@query(
    "box_flips",
    """ SELECT event_id, 400 - x2 AS hx1, 400 - x1 AS hx2, 300 - y2 AS vy1, 300 - y1 AS vy2, 400 - x2 AS dx1, 300 - y2 AS dy1, 400 - x1 AS dx2, 300 - y1 AS dy2 FROM box""",
)
def box_flips(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = B.Box.named()
    h, v, d = (b.flip(400, 300, x) for x in ("horizontal", "vertical", "diagonal"))
    return views.boxes(spark, sf_dir).select("event_id", h.x1.alias("hx1"), h.x2.alias("hx2"), v.y1.alias("vy1"), v.y2.alias("vy2"), *d.columns("d"))


@query(
    "box_mapping",
    """ SELECT event_id, 800 - x2 * 2 AS mx1, y1 * 1.5 AS my1, 800 - x1 * 2 AS mx2, y2 * 1.5 AS my2, x1 AS rx1, y1 AS ry1, x2 AS rx2, y2 AS ry2 FROM box""",
)
def box_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = B.Box.named().map(800, 450, 2, 1.5, "horizontal")
    return views.boxes(spark, sf_dir).select("event_id", *m.columns("m"), *m.map_back(800, 450, 2, 1.5, "horizontal").columns("r"))


@query(
    "box_clip_translate_scale",
    """ SELECT event_id, least(greatest(x1 - 30, 0), 200) AS cx1, least(greatest(y1 - 20, 0), 150) AS cy1, least(greatest(x2 - 30, 0), 200) AS cx2, least(greatest(y2 - 20, 0), 150) AS cy2,
  x1 * 0.5 AS sx1, y1 * 0.25 AS sy1, x2 * 0.5 AS sx2, y2 * 0.25 AS sy2,
  (x1 + x2) / 2 - (x2 - x1) AS zx1, (y1 + y2) / 2 - (y2 - y1) AS zy1, (x1 + x2) / 2 + (x2 - x1) AS zx2, (y1 + y2) / 2 + (y2 - y1) AS zy2 FROM box""",
)
def box_clip_translate_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = B.Box.named()
    return views.boxes(spark, sf_dir).select("event_id", *b.translate(-30, -20).clip(200, 150).columns("c"), *b.scale(0.5, 0.25).columns("s"), *b.resize(2, 2).columns("z"))


@query(
    "box_inside",
    """ SELECT event_id, x1 < 200 AND x2 > 0 AND y1 < 150 AND y2 > 0 AS on_canvas, x1 >= -5 AND y1 >= -5 AND x2 < 205 AND y2 < 155 AS all_inside,
  120 BETWEEN x1 AND x2 AND 60 BETWEEN y1 AND y2 AS holds_point FROM box""",
)
def box_inside(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = B.Box.named()
    return views.boxes(spark, sf_dir).select("event_id", b.overlaps_canvas(200, 150).alias("on_canvas"), b.is_inside(200, 150, all_inside=True, border=5).alias("all_inside"), b.holds(F.lit(120), F.lit(60)).alias("holds_point"))


@query(
    "box_distances",
    """ SELECT event_id, 150 - x1 AS l, 90 - y1 AS t, x2 - 150 AS r, y2 - 90 AS b, least(greatest(150 - x1, 0), 63.9) AS cl, least(greatest(90 - y1, 0), 63.9) AS ct, x1, y1, x2, y2 FROM box""",
)
def box_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, x, y = B.Box.named(), F.lit(150.0), F.lit(90.0)
    l, t, r, bottom = b.distances_from(x, y)
    near = b.distances_from(x, y, most=64, eps=0.1)
    return views.boxes(spark, sf_dir).select("event_id", l.alias("l"), t.alias("t"), r.alias("r"), bottom.alias("b"), near[0].alias("cl"), near[1].alias("ct"), *B.Box.from_distances(x, y, l, t, r, bottom).columns())


@query(
    "box_project_rotate",
    """, c AS (SELECT event_id, unnest([[x1, y1], [x2, y1], [x2, y2], [x1, y2]]) AS p FROM box),
q AS (SELECT event_id, 1.2 * p[1] + 0.1 * p[2] + 5 AS hx, 0.05 * p[1] + 0.9 * p[2] - 3 AS hy, 0.0001 * p[1] + 0.0002 * p[2] + 1 AS w,
  150 + (p[1] - 150) * cos(radians(30)) - (p[2] - 100) * sin(radians(30)) AS rx, 100 + (p[1] - 150) * sin(radians(30)) + (p[2] - 100) * cos(radians(30)) AS ry FROM c)
SELECT event_id, round(min(hx / w), 6) AS px1, round(min(hy / w), 6) AS py1, round(max(hx / w), 6) AS px2, round(max(hy / w), 6) AS py2,
  round(min(rx), 6) AS rx1, round(min(ry), 6) AS ry1, round(max(rx), 6) AS rx2, round(max(ry), 6) AS ry2 FROM q GROUP BY event_id""",
)
def box_project_rotate(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = B.Box.named()
    p, r = b.project([[1.2, 0.1, 5], [0.05, 0.9, -3], [0.0001, 0.0002, 1]]), b.rotate(150, 100, 30)
    return views.boxes(spark, sf_dir).select("event_id", *[F.round(c, 6).alias(f"p{n}") for n, c in zip(("x1", "y1", "x2", "y2"), p.corners, strict=True)], *[F.round(c, 6).alias(f"r{n}") for n, c in zip(("x1", "y1", "x2", "y2"), r.corners, strict=True)])


@query(
    "delta_coder",
    pair_sql()
    + """, e AS (SELECT det_id, gt_id, dx1, dy1, dx2, dy2, gx1, gy1, gx2, gy2, (((gx1 + gx2) - (dx1 + dx2)) / 2 / (dx2 - dx1)) / 0.1 AS a, (((gy1 + gy2) - (dy1 + dy2)) / 2 / (dy2 - dy1)) / 0.1 AS b,
  ln((gx2 - gx1) / (dx2 - dx1)) / 0.2 AS c, ln((gy2 - gy1) / (dy2 - dy1)) / 0.2 AS d FROM p)
SELECT det_id, gt_id, round(a, 6) AS dx, round(b, 6) AS dy, round(c, 6) AS dw, round(d, 6) AS dh, round(gx1, 6) AS x1, round(gy1, 6) AS y1, round(gx2, 6) AS x2, round(gy2, 6) AS y2 FROM e""",
)
def delta_coder(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = M.pairs(views.detections(spark, sf_dir), views.ground_truth(spark, sf_dir))
    d, g, std = B.Box.named("d_"), B.Box.named("g_"), (0.1, 0.1, 0.2, 0.2)
    code = C.encode_delta(d, g, stds=std)
    back = C.decode_delta(d, code, stds=std)
    return p.select("det_id", "gt_id", *[F.round(c, 6).alias(n) for n, c in zip(("dx", "dy", "dw", "dh", "x1", "y1", "x2", "y2"), [*code, *back.corners], strict=True)])


@query(
    "side_and_cell_coders",
    pair_sql()
    + """ SELECT det_id, gt_id, round(((dy1 + dy2) / 2 - gy1) / (dy2 - dy1) / 4, 9) AS top, round((gx2 - (dx1 + dx2) / 2) / (dx2 - dx1) / 4, 9) AS "right",
  round(least(greatest(((gx1 + gx2) - (dx1 + dx2)) / 2 / 32 + 0.5, 0.000001), 0.999999), 9) AS cell_x, round(ln((gx2 - gx1) / (dx2 - dx1)), 9) AS cell_w, round(gx1, 6) AS side_x1 FROM p""",
)
def side_and_cell_coders(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = M.pairs(views.detections(spark, sf_dir), views.ground_truth(spark, sf_dir))
    d, g = B.Box.named("d_"), B.Box.named("g_")
    sides, cell = C.encode_sides(d, g), C.encode_cell(d, g, 32)
    out = {"top": sides[0], "right": sides[3], "cell_x": cell[0], "cell_w": cell[2]}
    return p.select("det_id", "gt_id", *[F.round(v, 9).alias(k) for k, v in out.items()], F.round(C.decode_sides(d, sides).x1, 6).alias("side_x1"))


def ap_sql(extra: int = 0, threshold: float = 0.5, mode: str = "area", area: tuple[int, int] | None = None, columns: str = "label, num_gts, num_dets, round(recall, 9) AS recall, round(ap, 9) AS ap") -> str:
    inside = lambda a: f"{a} >= {area[0]} AND {a} < {area[1]}" if area else "TRUE"
    size = f"(x2 - x1 + {extra}) * (y2 - y1 + {extra})"
    ap = "sum((r - coalesce(lr, 0)) * e)" if mode == "area" else "(" + " + ".join(f"coalesce(max(CASE WHEN r >= CAST({t / 10} AS DOUBLE) THEN pr END), 0)" for t in range(11)) + ") / 11"
    return (
        pair_sql(extra)
        + f""", m AS (SELECT * FROM (SELECT *, inter / greatest(da + ga - inter, 0.000001) AS iou, row_number() OVER (PARTITION BY det_id ORDER BY inter / greatest(da + ga - inter, 0.000001) DESC, ignored, gt_id) AS n FROM p) WHERE n = 1),
f AS (SELECT d.*, coalesce(m.iou >= {threshold}, FALSE) AS hit, m.gt_id, coalesce(m.ignored = 1 OR NOT ({inside("m.ga")}), FALSE) AS skip, {inside(size.replace("x", "d.x").replace("y", "d.y"))} AS here FROM det d LEFT JOIN m USING (det_id)),
o AS (SELECT *, row_number() OVER (PARTITION BY CASE WHEN hit THEN gt_id END, CASE WHEN NOT hit THEN det_id END ORDER BY score DESC, det_id) AS k FROM f),
t AS (SELECT *, CASE WHEN hit AND NOT skip AND k = 1 THEN 1 ELSE 0 END AS tp, CASE WHEN (hit AND NOT skip AND k > 1) OR (NOT hit AND here) THEN 1 ELSE 0 END AS fp FROM o),
c AS (SELECT label, sum(CASE WHEN ignored = 0 AND ({inside(size)}) THEN 1 ELSE 0 END) AS num_gts FROM gt GROUP BY label),
s AS (SELECT t.label, num_gts, score, det_id, sum(tp) OVER w AS a, sum(fp) OVER w AS b FROM t JOIN c USING (label) WINDOW w AS (PARTITION BY t.label ORDER BY score DESC, det_id ROWS UNBOUNDED PRECEDING)),
v AS (SELECT *, CASE WHEN num_gts > 0 THEN CAST(a AS DOUBLE) / num_gts ELSE 0 END AS r, CASE WHEN a + b > 0 THEN CAST(a AS DOUBLE) / (a + b) ELSE 0 END AS pr FROM s),
x AS (SELECT *, max(pr) OVER (PARTITION BY label ORDER BY score DESC, det_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS e, lag(r) OVER (PARTITION BY label ORDER BY score DESC, det_id) AS lr FROM v),
z AS (SELECT label, min(num_gts) AS num_gts, count(*) AS num_dets, max(r) AS recall, {ap} AS ap FROM x GROUP BY label)
SELECT {columns} FROM z"""
    )


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("recall", F.round("recall", 9)).withColumn("ap", F.round("ap", 9))


def _tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return views.detections(spark, sf_dir), views.ground_truth(spark, sf_dir)


@query("map_area", ap_sql())
def map_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(M.map_table(*_tables(spark, sf_dir)))


@query("map_voc_11points", ap_sql(extra=1, mode="11points"))
def map_voc_11points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(M.map_table(*_tables(spark, sf_dir), mode="11points", extra=1.0))


@query("map_scale_range", ap_sql(area=(8000, 9216)))
def map_scale_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(M.map_table(*_tables(spark, sf_dir), area=(8000, 9216)))


@query("map_strict", ap_sql(threshold=0.75))
def map_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(M.map_table(*_tables(spark, sf_dir), threshold=0.75))


@query("mean_ap", ap_sql(columns="round(avg(CASE WHEN num_gts > 0 THEN ap END), 9) AS mean_ap"))
def mean_ap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.mean_ap(M.map_table(*_tables(spark, sf_dir))).select(F.round("mean_ap", 9).alias("mean_ap"))


@query("map_imagenet")
def map_imagenet(spark: SparkSession, sf_dir: str) -> DataFrame:
    det, gt = _tables(spark, sf_dir)
    return _rounded(M.average_precision(M.match_greedy(det, gt, "free").drop("gt_id"), M.label_counts(gt, F.col("ignored") == 0), ["label"]))


@query("map_openimages")
def map_openimages(spark: SparkSession, sf_dir: str) -> DataFrame:
    det, gt = _tables(spark, sf_dir)
    return _rounded(M.average_precision(M.match_groups(det, gt), M.label_counts(gt), ["label"]))
