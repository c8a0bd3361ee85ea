"""Priors, assignment and sampling. Priors of the test views are the detections; the stride of all is 32."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ...functions import priors as PR
from ...operators import assign as A
from ...operators import sampling as S
from .. import views
from .registry import query

X = """, x AS (SELECT d.det_id AS prior_id, g.gt_id, d.image_id, d.label, g.label AS gl, d.score, d.x1 AS dx1, d.y1 AS dy1, d.x2 AS dx2, d.y2 AS dy2, g.x1 AS gx1, g.y1 AS gy1, g.x2 AS gx2, g.y2 AS gy2, g.ignored,
  i / greatest((d.x2 - d.x1) * (d.y2 - d.y1) + (g.x2 - g.x1) * (g.y2 - g.y1) - i, 0.000001) AS iou, (d.x1 + d.x2) / 2 AS px, (d.y1 + d.y2) / 2 AS py, (g.x1 + g.x2) / 2 AS gx, (g.y1 + g.y2) / 2 AS gy
  FROM det d JOIN gt g ON d.image_id = g.image_id, LATERAL (SELECT greatest(least(d.x2, g.x2) - greatest(d.x1, g.x1), 0) * greatest(least(d.y2, g.y2) - greatest(d.y1, g.y1), 0) AS i))"""
_STATE = """ SELECT d.det_id AS prior_id, d.image_id, w.gt_id, CASE WHEN w.gt_id IS NULL THEN 0 ELSE 1 END AS state FROM det d LEFT JOIN w ON w.prior_id = d.det_id"""
_INSIDE = "least(px - gx1, py - gy1, gx2 - px, gy2 - py)"


def _sets(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    d = views.detections(spark, sf_dir).withColumnRenamed("det_id", "prior_id").withColumn("stride", F.lit(32.0))
    return d, views.ground_truth(spark, sf_dir)


@query("anchor_grid", """ SELECT CAST(i AS BIGINT) AS prior_id, round(-b.w / 2 + ((i // 3) % 5) * 16, 6) AS x1, round(-b.h / 2 + (i // 15) * 16, 6) AS y1, round(b.w / 2 + ((i // 3) % 5) * 16, 6) AS x2, round(b.h / 2 + (i // 15) * 16, 6) AS y2
FROM range(60) t(i) JOIN (VALUES (0, 32 / sqrt(0.5), 32 * sqrt(0.5)), (1, 32.0, 32.0), (2, 32 / sqrt(2.0), 32 * sqrt(2.0))) b(k, w, h) ON i % 3 = b.k""")
def anchor_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = PR.anchor_grid(spark, PR.base_anchors(16, [2.0], [0.5, 1.0, 2.0]), 4, 5, 16)
    return g.select("prior_id", *[F.round(c, 6).alias(c) for c in ("x1", "y1", "x2", "y2")])


@query("point_grid", " SELECT CAST(i AS BIGINT) AS point_id, (i % 6 + 0.5) * 8 AS x, (i // 6 + 0.5) * 8 AS y FROM range(24) t(i)", with_views=False)
def point_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return PR.point_grid(spark, 4, 6, 8, 0.5).select("point_id", "x", "y")


_MAX_IOU = X + """, z AS (SELECT * FROM x WHERE ignored = 0),
b AS (SELECT prior_id, arg_max(gt_id, (iou, -gt_id)) AS best, max(iou) AS m FROM z GROUP BY prior_id),
c AS (SELECT prior_id, max(gt_id) AS claim FROM (SELECT *, max(iou) OVER (PARTITION BY gt_id) AS mx FROM z) WHERE iou = mx AND mx >= 0.3 GROUP BY prior_id),
a AS (SELECT d.det_id AS prior_id, d.image_id, CASE WHEN claim IS NOT NULL THEN claim WHEN m >= 0.6 THEN best END AS gt_id, CASE WHEN claim IS NOT NULL THEN 1 WHEN m >= 0.6 THEN 1 WHEN coalesce(m, 0) < 0.4 THEN 0 ELSE -1 END AS state
  FROM det d LEFT JOIN b ON b.prior_id = d.det_id LEFT JOIN c ON c.prior_id = d.det_id)"""
_DRAWN = S.draw_sql(0, "image_id", "prior_id")


@query("assign_max_iou", X + """, z AS (SELECT * FROM x WHERE ignored = 0),
b AS (SELECT prior_id, arg_max(gt_id, (iou, -gt_id)) AS best, max(iou) AS m FROM z GROUP BY prior_id),
c AS (SELECT prior_id, max(gt_id) AS claim FROM (SELECT *, max(iou) OVER (PARTITION BY gt_id) AS mx FROM z) WHERE iou = mx AND mx >= 0.3 GROUP BY prior_id),
s AS (SELECT prior_id, max(i / ((dx2 - dx1) * (dy2 - dy1))) AS part FROM (SELECT *, greatest(least(dx2, gx2) - greatest(dx1, gx1), 0) * greatest(least(dy2, gy2) - greatest(dy1, gy1), 0) AS i FROM x WHERE ignored = 1) GROUP BY prior_id),
o AS (SELECT d.det_id AS prior_id, d.image_id, CASE WHEN claim IS NOT NULL THEN claim WHEN m >= 0.6 THEN best END AS gt_id, CASE WHEN claim IS NOT NULL THEN 1 WHEN m >= 0.6 THEN 1 WHEN coalesce(m, 0) < 0.4 THEN 0 ELSE -1 END AS state, part
  FROM det d LEFT JOIN b ON b.prior_id = d.det_id LEFT JOIN c ON c.prior_id = d.det_id LEFT JOIN s ON s.prior_id = d.det_id)
SELECT prior_id, image_id, CASE WHEN part > 0.8 THEN NULL ELSE gt_id END AS gt_id, CASE WHEN part > 0.8 THEN -1 ELSE state END AS state FROM o""")
def assign_max_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, g = _sets(spark, sf_dir)
    return A.max_iou(p, g, 0.6, 0.4, 0.3, ignore_over=0.8)


@query("assign_atss", X + f""", n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY gt_id ORDER BY sqrt((px - gx) ** 2 + (py - gy) ** 2), prior_id) AS k FROM x) WHERE k <= 9),
t AS (SELECT *, avg(iou) OVER (PARTITION BY gt_id) + coalesce(stddev_samp(iou) OVER (PARTITION BY gt_id), 0) AS t FROM n),
w AS (SELECT prior_id, arg_max(gt_id, (iou, -gt_id)) AS gt_id FROM t WHERE iou >= t AND {_INSIDE} > 0.01 GROUP BY prior_id)""" + _STATE)
def assign_atss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.atss(*_sets(spark, sf_dir))


@query("assign_grid", X + """, r AS (SELECT *, prior_id % 3 > 0 AS ok FROM x WHERE ignored = 0), m AS (SELECT prior_id, max(iou) AS most FROM r GROUP BY 1),
b AS (SELECT prior_id, arg_max(gt_id, (iou, -gt_id)) AS best, max(iou) AS mx FROM r WHERE ok GROUP BY prior_id),
c AS (SELECT prior_id, max(gt_id) AS claim FROM (SELECT *, max(iou) OVER (PARTITION BY gt_id) AS top FROM r WHERE ok) WHERE iou = top AND top > 0.2 GROUP BY prior_id)
SELECT d.det_id AS prior_id, d.image_id, coalesce(claim, CASE WHEN mx > 0.6 THEN best END) AS gt_id, CASE WHEN claim IS NOT NULL OR mx > 0.6 THEN 1 WHEN coalesce(most, 0) <= 0.4 THEN 0 ELSE -1 END AS state
FROM det d LEFT JOIN m ON m.prior_id = d.det_id LEFT JOIN b ON b.prior_id = d.det_id LEFT JOIN c ON c.prior_id = d.det_id""")
def assign_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, g = _sets(spark, sf_dir)
    return A.grid(p.withColumn("responsible", F.col("prior_id") % 3 > 0), g, 0.6, 0.4, 0.2)


@query("assign_sim_ota", X + f""", c AS (SELECT *, {_INSIDE} > 0 AS ib, abs(px - gx) < 80 AND abs(py - gy) < 80 AS ic FROM x),
q AS (SELECT *, round(-ln(least(greatest(CASE WHEN label = gl THEN score ELSE 1 - score END, 0.000001), 0.999999)) - ln(iou + 0.0000001) * 3 + CASE WHEN ib AND ic THEN 0 ELSE 100000000 END, 9) AS cost FROM c WHERE ib OR ic),
k AS (SELECT gt_id, greatest(floor(round(sum(iou), 9)), 1) AS k FROM (SELECT *, row_number() OVER (PARTITION BY gt_id ORDER BY iou DESC, prior_id) AS r FROM q) WHERE r <= 10 GROUP BY gt_id),
w AS (SELECT prior_id, arg_min(gt_id, (cost, gt_id)) AS gt_id FROM (SELECT q.*, k.k, row_number() OVER (PARTITION BY q.gt_id ORDER BY cost, prior_id) AS r FROM q JOIN k ON k.gt_id = q.gt_id) WHERE r <= k GROUP BY prior_id)""" + _STATE)
def assign_sim_ota(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.sim_ota(*_sets(spark, sf_dir))


@query("assign_task_aligned", X + f""", m AS (SELECT *, CASE WHEN label = gl THEN score ELSE 0 END * pow(iou, 6) AS m FROM x),
r AS (SELECT *, row_number() OVER (PARTITION BY gt_id ORDER BY m DESC, prior_id) AS n FROM m),
w AS (SELECT prior_id, arg_max(gt_id, (iou, -gt_id)) AS gt_id FROM r WHERE n <= 13 AND m > 0 AND {_INSIDE} > 0.01 GROUP BY prior_id)""" + _STATE)
def assign_task_aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.task_aligned(*_sets(spark, sf_dir))


@query("assign_uniform", X + """, y AS (SELECT *, abs(px - gx) + abs(py - gy) + abs((dx2 - dx1) - (gx2 - gx1)) + abs((dy2 - dy1) - (gy2 - gy1)) AS d FROM x),
n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY gt_id ORDER BY d, prior_id) AS k FROM y) WHERE k <= 4),
h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY prior_id ORDER BY d, gt_id) AS f FROM n) WHERE f = 1),
m AS (SELECT prior_id, max(iou) AS most FROM x GROUP BY 1)
SELECT d.det_id AS prior_id, d.image_id, CASE WHEN h.iou >= 0.15 THEN h.gt_id END AS gt_id, CASE WHEN h.gt_id IS NOT NULL THEN CASE WHEN h.iou < 0.15 THEN -1 ELSE 1 END WHEN most > 0.7 THEN -1 ELSE 0 END AS state
FROM det d LEFT JOIN h ON h.prior_id = d.det_id LEFT JOIN m ON m.prior_id = d.det_id""")
def assign_uniform(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.uniform(*_sets(spark, sf_dir))


_PART = "greatest(least(dx2, gx + {r} * (gx2 - gx1)) - greatest(dx1, gx - {r} * (gx2 - gx1)), 0) * greatest(least(dy2, gy + {r} * (gy2 - gy1)) - greatest(dy1, gy - {r} * (gy2 - gy1)), 0) / greatest((dx2 - dx1) * (dy2 - dy1), 0.000001)"


@query("assign_center_region", X + f""", z AS (SELECT *, {_PART.format(r=0.1)} AS core, {_PART.format(r=0.25)} AS shadow FROM x),
h AS (SELECT prior_id, arg_min(gt_id, ((gx2 - gx1) * (gy2 - gy1), gt_id)) AS gt_id FROM z WHERE px > gx1 AND px < gx2 AND py > gy1 AND py < gy2 AND core > 0.01 GROUP BY 1)
SELECT d.det_id AS prior_id, d.image_id, h.gt_id, CASE WHEN h.gt_id IS NOT NULL THEN 1 WHEN EXISTS (SELECT 1 FROM z WHERE z.prior_id = d.det_id AND shadow > 0.01) THEN -1 ELSE 0 END AS state FROM det d LEFT JOIN h ON h.prior_id = d.det_id""")
def assign_center_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.center_region(*_sets(spark, sf_dir))


@query("assign_several", X + " SELECT prior_id, rank, gt_id, CASE WHEN iou >= 0.5 THEN 1 ELSE 0 END AS state FROM (SELECT *, row_number() OVER (PARTITION BY prior_id ORDER BY iou DESC, gt_id) AS rank FROM x) WHERE rank <= 2")
def assign_several(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.several(*_sets(spark, sf_dir))


@query("assign_hungarian")
def assign_hungarian(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, g = _sets(spark, sf_dir)
    out = A.hungarian(p, g, 5 * A.l1_cost(400.0, 300.0) + A.overlap_cost("giou", 2.0))
    return out.groupBy("gt_id").agg(F.count("*").alias("n"), F.round(F.sum("cost"), 6).alias("cost"))


@query("batches_by_aspect", """, v AS (SELECT event_id, CASE WHEN x2 - x1 < y2 - y1 THEN 0 ELSE 1 END AS bucket, row_number() OVER (PARTITION BY CASE WHEN x2 - x1 < y2 - y1 THEN 0 ELSE 1 END ORDER BY event_id) - 1 AS i FROM box)
SELECT event_id, bucket, CAST(i // 16 AS BIGINT) AS batch, CAST(i % 16 AS INTEGER) AS place FROM v""")
def batches_by_aspect(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = views.boxes(spark, sf_dir).select("event_id", (F.col("x2") - F.col("x1")).alias("width"), (F.col("y2") - F.col("y1")).alias("height")).withColumn("bucket", S.aspect())
    return S.batches(b, 16, ["bucket"], ["event_id"]).select("event_id", "bucket", "batch", "place")


@query("sample_per_source", """, r AS (SELECT event_id, label, row_number() OVER (PARTITION BY label ORDER BY """ + S.draw_sql(3, "event_id") + """, event_id) AS r FROM box)
SELECT event_id, label FROM r WHERE label = 0 OR (label = 1 AND r <= 50) OR (label = 2 AND r <= 10)""")
def sample_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.per_source(views.boxes(spark, sf_dir).select("event_id", "label"), {0: -1, 1: 50, 2: 10}, "label", "event_id", seed=3)


@query("sample_with_replacement", f""", w AS (SELECT event_id, sum(score) OVER (ORDER BY event_id % 256, event_id) AS hi, score, sum(score) OVER () AS total FROM box), d AS (SELECT {S.draw_sql(0, 'i')} AS u FROM range(2000) t(i))
SELECT event_id, count(*) AS n FROM d JOIN w ON u >= (hi - score) / total AND u < hi / total GROUP BY event_id""")
def sample_with_replacement(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = views.boxes(spark, sf_dir)
    return S.with_replacement(b, F.col("score"), 2000, "event_id").groupBy("event_id").agg(F.count("*").alias("n"))


@query("sample_class_aware", f""", p AS (SELECT DISTINCT label, image_id FROM gt), x AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {S.draw_sql(0, 'image_id', 'label')}, image_id) - 1 AS i, count(*) OVER (PARTITION BY label) AS n FROM p),
c AS (SELECT label, row_number() OVER (ORDER BY {S.draw_sql(0, 'label')}, label) - 1 AS c, count(*) OVER () AS k FROM (SELECT DISTINCT label FROM gt))
SELECT d AS draw, x.label, image_id FROM range(1000) t(d) JOIN c ON d % k = c.c JOIN x ON x.label = c.label AND (d // k) % x.n = x.i""")
def sample_class_aware(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.class_aware(views.ground_truth(spark, sf_dir), 1000)


@query("reference_frames", f"""WITH f AS (SELECT user_id AS video_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_id FROM events),
p AS (SELECT f.video_id, f.frame_id, r.frame_id AS ref_id FROM f JOIN f r ON r.video_id = f.video_id AND r.frame_id <> f.frame_id AND abs(r.frame_id - f.frame_id) <= 5),
k AS (SELECT *, row_number() OVER (PARTITION BY video_id, frame_id ORDER BY {S.draw_sql(0, 'video_id', 'frame_id', 'ref_id')}, ref_id) AS k FROM p)
SELECT video_id, frame_id, string_agg(ref_id, ',' ORDER BY ref_id) AS refs FROM k WHERE k <= 2 GROUP BY ALL""", with_views=False)
def reference_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.reference_frames(views.frames(spark, sf_dir), 5, 2).withColumn("refs", F.array_join(F.col("refs").cast("array<string>"), ","))


@query("sample_candidates", _MAX_IOU + f""", r AS (SELECT *, row_number() OVER (PARTITION BY image_id, state ORDER BY {_DRAWN}, prior_id) AS r FROM a WHERE state >= 0), n AS (SELECT image_id, count(*) AS p FROM r WHERE state = 1 AND r <= 8 GROUP BY 1)
SELECT prior_id, image_id, gt_id, state FROM r LEFT JOIN n USING (image_id) WHERE CASE WHEN state = 1 THEN r <= 8 ELSE r <= least(32 - coalesce(p, 0), 3 * greatest(coalesce(p, 0), 1)) END""")
def sample_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, g = _sets(spark, sf_dir)
    return S.positives_and_negatives(A.max_iou(p, g, 0.6, 0.4, 0.3), 32, 0.25, 3).select("prior_id", "image_id", "gt_id", "state")


@query("sample_balanced_instances", _MAX_IOU + f""", i AS (SELECT *, row_number() OVER (PARTITION BY gt_id ORDER BY {_DRAWN}, prior_id) AS i FROM a WHERE state = 1)
SELECT prior_id, image_id, gt_id, state FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY i, {_DRAWN}, prior_id) AS r FROM i) WHERE r <= 8""")
def sample_balanced_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, g = _sets(spark, sf_dir)
    return S.balanced_by_instance(A.max_iou(p, g, 0.6, 0.4, 0.3), 8)


_LEVELS = ((16, 14, 20), (32, 7, 10), (64, 4, 5))  # stride, rows, columns
_GRID = """, im AS (SELECT DISTINCT image_id, 300 + image_id % 41 AS width, 220 + image_id % 37 AS height FROM box), lv AS (SELECT * FROM (VALUES (0, 0, 280, 16, 14, 20), (1, 280, 350, 32, 7, 10), (2, 350, 370, 64, 4, 5)) v(level, lo, hi, stride, r, c)),
pr AS (SELECT im.*, image_id * 1000 + k AS prior_id, level, stride, r, c, (k - lo) % c AS x, (k - lo) // c AS y FROM im, range(370) t(k) JOIN lv ON k >= lo AND k < hi)"""


@query("assign_region", _GRID + """, g AS (SELECT gt.*, least(greatest(floor(log2(sqrt((x2 - x1) * (y2 - y1))) - log2(64.0::DOUBLE) + 0.5), 0), 2) AS own FROM gt),
e AS (SELECT g.image_id, gt_id, own, lv.*, f, least(greatest(round_even((1 - f) * (x1 / stride) + f * (x2 / stride), 0), 0), c) AS a1, least(greatest(round_even((1 - f) * (y1 / stride) + f * (y2 / stride), 0), 0), r) AS b1, least(greatest(round_even((1 - f) * (x2 / stride) + f * (x1 / stride), 0), 0), c) AS a2, least(greatest(round_even((1 - f) * (y2 / stride) + f * (y1 / stride), 0), 0), r) AS b2
  FROM g JOIN lv ON abs(level - own) <= 1, (VALUES (0.25::DOUBLE), (0.4::DOUBLE)) p(f)),
h AS (SELECT prior_id, gt_id, own = e.level AS here, f = 0.4 AS middle FROM pr JOIN e ON e.image_id = pr.image_id AND e.level = pr.level AND x BETWEEN a1 AND a2 AND y BETWEEN b1 AND b2),
w AS (SELECT prior_id, max(gt_id) FILTER (here AND NOT middle) AS top, bool_or(NOT here AND NOT middle) AS beside FROM h GROUP BY 1), o AS (SELECT pr.*, top, EXISTS (SELECT 1 FROM gt WHERE gt.image_id = pr.image_id) AND (coalesce(beside, false) OR x * stride - 2 * stride < 0 OR y * stride - 2 * stride < 0 OR x * stride + 2 * stride >= width OR y * stride + 2 * stride >= height) AS skip, EXISTS (SELECT 1 FROM h WHERE h.prior_id = pr.prior_id AND h.gt_id = top AND here AND middle) AS hit FROM pr LEFT JOIN w USING (prior_id))
SELECT prior_id, image_id, CASE WHEN NOT skip AND hit THEN top END AS gt_id, CASE WHEN skip THEN -1 WHEN hit THEN 1 WHEN top IS NOT NULL THEN -1 ELSE 0 END AS state FROM o""")
def assign_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = views.boxes(spark, sf_dir).select("image_id").distinct().withColumn("width", 300 + F.col("image_id") % 41).withColumn("height", 220 + F.col("image_id") % 37)
    cells = [f"transform(sequence(0, {r * c - 1}), i -> named_struct('level', {k}, 'cx', i % {c}, 'cy', i div {c}, 'stride', {s}))" for k, (s, r, c) in enumerate(_LEVELS)]
    p = images.select("image_id", F.posexplode(F.expr(f"concat({', '.join(cells)})")).alias("k", "c"))
    edge = lambda n, sign: (F.col(f"c.c{n}") * F.col("c.stride") + sign * 2 * F.col("c.stride")).cast("double")
    p = p.select("image_id", (F.col("image_id") * 1000 + F.col("k")).alias("prior_id"), F.col("c.level").alias("level"), edge("x", -1).alias("x1"), edge("y", -1).alias("y1"), edge("x", 1).alias("x2"), edge("y", 1).alias("y2"))
    return A.region(p, views.ground_truth(spark, sf_dir), images, [s for s, _, _ in _LEVELS], [(r, c) for _, r, c in _LEVELS], 4)


@query("assign_approximations", """, a AS (SELECT det_id AS prior_id, image_id, x1 + dx AS x1, y1, x2 + dx + grow AS x2, y2 + grow AS y2 FROM det, (VALUES (-9, 0), (0, 6), (7, -4)) v(dx, grow)),
o AS (SELECT a.prior_id, g.gt_id, greatest(least(a.x2, g.x2) - greatest(a.x1, g.x1), 0) * greatest(least(a.y2, g.y2) - greatest(a.y1, g.y1), 0) AS i, (a.x2 - a.x1) * (a.y2 - a.y1) + (g.x2 - g.x1) * (g.y2 - g.y1) AS s FROM a JOIN gt g ON a.image_id = g.image_id WHERE ignored = 0),
z AS (SELECT prior_id, gt_id, max(i / greatest(s - i, 0.000001)) AS iou FROM o GROUP BY ALL), b AS (SELECT prior_id, arg_max(gt_id, (iou, -gt_id)) AS best, max(iou) AS m FROM z GROUP BY prior_id),
c AS (SELECT prior_id, max(gt_id) AS claim FROM (SELECT *, max(iou) OVER (PARTITION BY gt_id) AS mx FROM z) WHERE iou = mx AND mx >= 0.3 GROUP BY prior_id)
SELECT d.det_id AS prior_id, d.image_id, CASE WHEN claim IS NOT NULL THEN claim WHEN m >= 0.6 THEN best END AS gt_id, CASE WHEN claim IS NOT NULL THEN 1 WHEN m >= 0.6 THEN 1 WHEN coalesce(m, 0) < 0.4 THEN 0 ELSE -1 END AS state FROM det d LEFT JOIN b ON b.prior_id = d.det_id LEFT JOIN c ON c.prior_id = d.det_id""")
def assign_approximations(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, g = _sets(spark, sf_dir)
    three = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(grow).alias("grow")) for dx, grow in ((-9, 0), (0, 6), (7, -4))]))
    a = p.select("*", three.alias("v")).select("prior_id", "image_id", (F.col("x1") + F.col("v.dx")).alias("x1"), "y1", (F.col("x2") + F.col("v.dx") + F.col("v.grow")).alias("x2"), (F.col("y2") + F.col("v.grow")).alias("y2"))
    return A.max_iou(p, g, 0.6, 0.4, 0.3, approximations=a)


@query("assign_soft_label", X + """, c AS (SELECT *, max(CASE WHEN least(px - gx1, py - gy1, gx2 - px, gy2 - py) > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY prior_id) AS hit FROM x),
e AS (SELECT c.*, k, ((prior_id * 7 + k * 13) % 11 - 5) * 0.4::DOUBLE AS z, CASE WHEN k = gl THEN iou ELSE 0 END AS y FROM c, range(5) r(k) WHERE hit = 1),
s AS (SELECT prior_id, gt_id, any_value(iou) AS iou, any_value(sqrt((px - gx) ** 2 + (py - gy) ** 2) / 32) AS far, sum((greatest(z, 0) - z * y + ln(1 + exp(-abs(z)))) * (y - 1 / (1 + exp(-z))) ** 2) AS l FROM e GROUP BY ALL),
q AS (SELECT *, round(l - ln(iou + 0.0000001::DOUBLE) * 3 + pow(10.0::DOUBLE, far - 3), 9) AS cost FROM s), k AS (SELECT gt_id, greatest(floor(round(sum(iou), 9)), 1) AS k FROM (SELECT *, row_number() OVER (PARTITION BY gt_id ORDER BY iou DESC, prior_id) AS r FROM q) WHERE r <= 13 GROUP BY gt_id),
w AS (SELECT prior_id, arg_min(gt_id, (cost, gt_id)) AS gt_id FROM (SELECT q.*, k.k, row_number() OVER (PARTITION BY q.gt_id ORDER BY cost, prior_id) AS r FROM q JOIN k ON k.gt_id = q.gt_id) WHERE r <= k GROUP BY prior_id)""" + _STATE)
def assign_soft_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, g = _sets(spark, sf_dir)
    logits = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda k: ((F.col("prior_id") * 7 + k * 13) % 11 - 5) * 0.4)
    p = p.withColumns({"px": (F.col("x1") + F.col("x2")) / 2, "py": (F.col("y1") + F.col("y2")) / 2, "logits": logits})
    return A.soft_label(p, g)


@query("grouped_batches", f""", r AS (SELECT event_id, label % 3 AS source, CASE WHEN x2 - x1 < y2 - y1 THEN 0 ELSE 1 END AS grp FROM box), x AS (SELECT *, row_number() OVER (PARTITION BY grp, source ORDER BY {S.draw_sql(4, 'event_id')}, event_id) - 1 AS i, count(*) OVER (PARTITION BY grp, source) AS n FROM r),
g AS (SELECT grp, count(*) AS s FROM r GROUP BY 1), h AS (SELECT grp, s, sum(s) OVER (ORDER BY grp) AS hi, sum(s) OVER () AS total FROM g), b AS (SELECT b AS batch, grp, row_number() OVER (PARTITION BY grp ORDER BY b) - 1 AS t FROM range(400) v(b) JOIN h ON {S.draw_sql(5, 'b')} * total >= hi - s AND {S.draw_sql(5, 'b')} * total < hi),
w AS (SELECT b.*, source, c, place FROM b, (VALUES (0, 3), (1, 2)) k(source, c), range(3) p(place) WHERE place < c) SELECT batch, w.grp AS "group", w.source, CAST(place AS INTEGER) AS place, event_id FROM w JOIN x ON x.grp = w.grp AND x.source = w.source AND x.i = (t * c + place) % x.n""")
def grouped_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = views.boxes(spark, sf_dir)
    rows = b.select("event_id", (F.col("label") % 3).alias("source"), F.when(F.col("x2") - F.col("x1") < F.col("y2") - F.col("y1"), 0).otherwise(1).alias("group"))
    return S.grouped_batches(rows, {0: 3, 1: 2, 2: 0}, 400, "source", "group", "event_id", seed=4)


_FR = "WITH f AS (SELECT user_id AS video_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_id FROM events)"


@query("shuffled_frames", _FR + f""", n AS (SELECT *, row_number() OVER (ORDER BY {S.draw_sql(9, 'video_id', 'frame_id')}, video_id, frame_id) - 1 AS i, count(*) OVER () AS n FROM f), a AS (SELECT *, CAST(ceil(n / 7) * 7 AS BIGINT) AS total FROM n)
SELECT video_id, frame_id, j % 7 AS worker, j // 7 AS place FROM (SELECT *, unnest([i, i + n]) AS j FROM a) WHERE j < total""", with_views=False)
def shuffled_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.shuffled_frames(views.frames(spark, sf_dir), 7, seed=9)


@query("frames_in_order", _FR + """, v AS (SELECT video_id, row_number() OVER (ORDER BY video_id) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT video_id FROM f)),
w AS (SELECT video_id, CASE WHEN i < (n % 7) * (n // 7 + 1) THEN i // (n // 7 + 1) ELSE n % 7 + (i - (n % 7) * (n // 7 + 1)) // greatest(n // 7, 1) END AS worker FROM v) SELECT f.video_id, frame_id, worker FROM f JOIN w USING (video_id)""", with_views=False)
def frames_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.frames_in_order(views.frames(spark, sf_dir), 7)
