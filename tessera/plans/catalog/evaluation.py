"""Metrics and suppression."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ...operators import matching as M
from ...operators import metrics as E
from ...operators import summary as Y
from ...operators import suppress as S
from .. import views
from .detection import ap_sql, pair_sql
from .registry import query

_RANK = "row_number() OVER (PARTITION BY image_id, label ORDER BY score DESC, det_id)"
_HIGHER = """, r AS (SELECT *, {rank} AS rank FROM det),
h AS (SELECT l.det_id, l.rank, h.det_id AS h_id, i / greatest(u - i, 0.000001) AS iou FROM (
  SELECT a.det_id AS hid, b.det_id AS lid, greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0) AS i,
    (a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) AS u FROM r a JOIN r b ON a.image_id = b.image_id AND a.label = b.label AND a.rank < b.rank
) q JOIN r h ON h.det_id = q.hid JOIN r l ON l.det_id = q.lid)"""


def _det(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.detections(spark, sf_dir)


def _gt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.ground_truth(spark, sf_dir)


@query(
    "fast_suppression",
    _HIGHER.format(rank=_RANK)
    + """, m AS (SELECT det_id, max(iou) AS most FROM h WHERE rank <= 40 GROUP BY det_id),
k AS (SELECT r.* FROM r LEFT JOIN m USING (det_id) WHERE r.rank <= 40 AND coalesce(most, 0) <= 0.6 AND score > 0.05)
SELECT det_id, image_id, label, score FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, det_id) AS n FROM k) WHERE n <= 12""",
)
def fast_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.fast_suppression(_det(spark, sf_dir), 0.6, 0.05, 40, 12).select("det_id", "image_id", "label", "score")


def _matrix_sql(decay: str) -> str:
    return (
        _HIGHER.format(rank="row_number() OVER (PARTITION BY image_id ORDER BY score DESC, det_id)")
        + f""", o AS (SELECT det_id, max(iou) AS own FROM h GROUP BY det_id),
d AS (SELECT h.det_id, min({decay}) AS decay FROM (SELECT h.*, coalesce(o.own, 0) AS own FROM h LEFT JOIN o ON h.h_id = o.det_id) h GROUP BY h.det_id)
SELECT det.det_id, image_id, label, round(score * least(coalesce(decay, 1), 1), 9) AS score FROM det LEFT JOIN d USING (det_id)"""
    )


@query("matrix_suppression_gaussian", _matrix_sql("exp(-2.0 * (iou * iou - own * own))"))
def matrix_suppression_gaussian(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.matrix_suppression(_det(spark, sf_dir)).select("det_id", "image_id", "label", F.round("score", 9).alias("score"))


@query("matrix_suppression_linear", _matrix_sql("CASE WHEN own < 1 THEN (1 - iou) / (1 - own) END"))
def matrix_suppression_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.matrix_suppression(_det(spark, sf_dir), kernel="linear").select("det_id", "image_id", "label", F.round("score", 9).alias("score"))


@query("filter_topk", " SELECT det_id, image_id, label, score FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, det_id) AS n FROM det WHERE score > 0.2) WHERE n <= 10")
def filter_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.filter_topk(_det(spark, sf_dir), 0.2, 10).select("det_id", "image_id", "label", "score")


@query("topk_per_class", " SELECT det_id, label, score FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, det_id) AS n FROM det) WHERE n <= 100")
def topk_per_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.ranked(_det(spark, sf_dir), ["label"], 100).select("det_id", "label", "score")


@query("greedy_suppression", """, l AS (SELECT image_id, label, list([{'det_id': det_id, 'score': score, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}] ORDER BY score DESC, det_id) AS l FROM det GROUP BY ALL),
k AS (SELECT image_id, label, unnest(list_reduce(l, lambda a, x: CASE WHEN len(list_filter(a, lambda k: list_transform([greatest(least(k.x2, x[1].x2) - greatest(k.x1, x[1].x1), 0) * greatest(least(k.y2, x[1].y2) - greatest(k.y1, x[1].y1), 0)],
  lambda i: i / greatest((k.x2 - k.x1) * (k.y2 - k.y1) + (x[1].x2 - x[1].x1) * (x[1].y2 - x[1].y1) - i, 0.000001))[1] > 0.5)) > 0 THEN a ELSE list_concat(a, x) END)) AS d FROM l) SELECT d.det_id AS det_id, image_id, label, d.score AS score FROM k""")
def greedy_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.greedy_suppression(_det(spark, sf_dir), 0.5).select("det_id", "image_id", "label", "score")


@query("soft_suppression")
def soft_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.greedy_suppression(_det(spark, sf_dir), 0.5, soft_sigma=0.5).select("det_id", "image_id", "label", F.round("score", 9).alias("score"))


@query("weighted_fusion")
def weighted_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    det = _det(spark, sf_dir).withColumn("source", F.col("det_id") % 2)
    return S.weighted_fusion(det, weights={0: 2.0, 1: 1.0}).select("image_id", "label", *[F.round(c, 6).alias(c) for c in (*S.CORNERS, "score")], "members")


@query(
    "mean_of_views",
    """, v AS (SELECT image_id, det_id, x1, y1, x2, y2, score FROM det UNION ALL SELECT image_id, det_id, x1 + 2, y1, x2 + 2, y2, score / 2 FROM det)
SELECT image_id, det_id, round(avg(x1), 9) AS x1, round(avg(y1), 9) AS y1, round(avg(x2), 9) AS x2, round(avg(y2), 9) AS y2, round(avg(score), 9) AS score FROM v GROUP BY ALL""",
)
def mean_of_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    det = _det(spark, sf_dir)
    from ...functions.boxes import Box

    moved = Box.named().flip(400, 300).translate(-2, 0).flip(400, 300)
    other = det.select("image_id", "det_id", *moved.columns(), (F.col("score") / 2).alias("score"))
    out = S.mean_of_views(det.select("image_id", "det_id", *S.CORNERS, "score").unionByName(other))
    return out.select("image_id", "det_id", *[F.round(c, 9).alias(c) for c in (*S.CORNERS, "score")])


@query(
    "heatmap_peaks",
    """, c AS (SELECT image_id, label, CAST(floor(y1 / 10) AS BIGINT) AS y, CAST(floor(x1 / 10) AS BIGINT) AS x, max(score) AS score FROM det GROUP BY ALL)
SELECT a.image_id, a.label, a.y, a.x, a.score FROM c a WHERE NOT EXISTS (SELECT 1 FROM c b WHERE a.image_id = b.image_id AND a.label = b.label AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 AND b.score > a.score)""",
)
def heatmap_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _det(spark, sf_dir).groupBy("image_id", "label", F.floor(F.col("y1") / 10).alias("y"), F.floor(F.col("x1") / 10).alias("x")).agg(F.max("score").alias("score"))
    return S.local_maxima(cells)


@query("proposal_recall")
def proposal_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.proposal_recall(_det(spark, sf_dir), _gt(spark, sf_dir), (5, 20, 100), (0.5, 0.6, 0.7, 0.8)).withColumn("recall", F.round("recall", 9))


_JOINT = """, j AS (SELECT user_id AS image_id, (event_id * 7) % 6 AS gt_id, CASE WHEN (event_id * 13) % 10 < 7 THEN (event_id * 7) % 6 + 10 ELSE 10 + event_id % 6 END AS pred_id, count(*) * 10 AS n FROM events GROUP BY ALL)"""


def _joint(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = views.table(spark, sf_dir, "events")
    return e.groupBy(F.col("user_id").alias("image_id"), F.expr("(event_id * 7) % 6").alias("gt_id"), F.expr("CASE WHEN (event_id * 13) % 10 < 7 THEN (event_id * 7) % 6 + 10 ELSE 10 + event_id % 6 END").alias("pred_id")).agg((F.count("*") * 10).alias("n"))


_PQ = (
    _JOINT
    + """, g AS (SELECT image_id, gt_id, gt_id % 3 AS category, CASE WHEN gt_id = 5 THEN 1 ELSE 0 END AS crowd, sum(n) AS ga FROM j WHERE gt_id <> 0 GROUP BY ALL),
q AS (SELECT image_id, pred_id, (pred_id - 10) % 3 AS category, sum(n) AS pa, sum(CASE WHEN gt_id = 0 THEN n ELSE 0 END) AS vo FROM j GROUP BY image_id, pred_id),
m AS (SELECT j.image_id, j.gt_id, j.pred_id, g.category, CAST(n AS DOUBLE) / (pa + ga - n - vo) AS iou FROM j JOIN g USING (image_id, gt_id) JOIN q ON q.image_id = j.image_id AND q.pred_id = j.pred_id AND q.category = g.category WHERE crowd = 0 AND CAST(n AS DOUBLE) / (pa + ga - n - vo) > 0.5),
tp AS (SELECT category, count(*) AS tp, sum(iou) AS s FROM m GROUP BY 1),
fn AS (SELECT category, count(*) AS fn FROM g WHERE crowd = 0 AND NOT EXISTS (SELECT 1 FROM m WHERE m.image_id = g.image_id AND m.gt_id = g.gt_id) GROUP BY 1),
cr AS (SELECT j.image_id, j.pred_id, g.category, sum(n) AS oc FROM j JOIN g USING (image_id, gt_id) WHERE crowd = 1 GROUP BY ALL),
fp AS (SELECT q.category, count(*) AS fp FROM q LEFT JOIN cr ON cr.image_id = q.image_id AND cr.pred_id = q.pred_id AND cr.category = q.category
  WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.image_id = q.image_id AND m.pred_id = q.pred_id) AND CAST(vo + coalesce(oc, 0) AS DOUBLE) / pa <= 0.5 GROUP BY 1),
a AS (SELECT DISTINCT category FROM g UNION SELECT DISTINCT category FROM q)
SELECT category, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(fn, 0) AS fn, round(coalesce(s, 0), 6) AS sum_iou FROM a LEFT JOIN tp USING (category) LEFT JOIN fp USING (category) LEFT JOIN fn USING (category)"""
)


@query("panoptic_quality", _PQ)
def panoptic_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = _joint(spark, sf_dir)
    gt = j.where("gt_id <> 0").select("image_id", "gt_id", F.expr("gt_id % 3").alias("category"), F.expr("CASE WHEN gt_id = 5 THEN 1 ELSE 0 END").alias("crowd")).distinct()
    pred = j.select("image_id", "pred_id", F.expr("(pred_id - 10) % 3").alias("category")).distinct()
    return E.panoptic_quality(j, gt, pred).withColumn("sum_iou", F.round("sum_iou", 6))


_SEG = _JOINT + """, l AS (SELECT gt_id AS g, pred_id - 10 AS p, sum(n) AS n FROM j WHERE gt_id <> 5 GROUP BY ALL),
s AS (SELECT label, coalesce(i, 0) AS i, coalesce(ga, 0) AS ga, coalesce(pa, 0) AS pa FROM (SELECT g AS label, sum(n) AS ga FROM l GROUP BY 1) FULL JOIN (SELECT p AS label, sum(n) AS pa FROM l GROUP BY 1) USING (label) LEFT JOIN (SELECT g AS label, sum(n) AS i FROM l WHERE g = p GROUP BY 1) USING (label))"""


@query("segmentation_scores", _SEG + """ SELECT label, round(i / nullif(ga + pa - i, 0), 9) AS iou, round(i / nullif(ga, 0), 9) AS acc, round(2 * i / nullif(ga + pa, 0), 9) AS dice FROM s""")
def segmentation_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = _joint(spark, sf_dir).select(F.col("gt_id").alias("gt"), (F.col("pred_id") - 10).alias("pred"), "n")
    return E.segmentation_scores(j, ignore=5).select("label", *[F.round(c, 9).alias(c) for c in ("iou", "acc", "dice")])


@query("reid", """WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings), d AS (SELECT a.vec_id, a.label = b.label AS same, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.x, b.x), a.label <> b.label, b.vec_id) AS place FROM e a JOIN e b ON a.vec_id <> b.vec_id),
p AS (SELECT vec_id, place, row_number() OVER (PARTITION BY vec_id ORDER BY place) AS i FROM d WHERE same), q AS (SELECT vec_id, avg(i / place) AS ap, min(place) AS first FROM p GROUP BY 1)
SELECT round(avg(ap), 3) AS map, round(avg(CASE WHEN first <= 1 THEN 1.0 ELSE 0.0 END), 3) AS r1, round(avg(CASE WHEN first <= 5 THEN 1.0 ELSE 0.0 END), 3) AS r5, round(avg(CASE WHEN first <= 10 THEN 1.0 ELSE 0.0 END), 3) AS r10 FROM q""", with_views=False)
def reid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.reid(views.table(spark, sf_dir, "embeddings"))


_MATCHED = ap_sql(columns="1 AS one").rsplit("SELECT 1 AS one", 1)[0]


@query("trapezoid_ap", _MATCHED + """, y AS (SELECT tp, sum(tp) OVER w AS a, sum(fp) OVER w AS b, row_number() OVER w AS i FROM t WINDOW w AS (ORDER BY score DESC, det_id ROWS UNBOUNDED PRECEDING)),
n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM gt WHERE ignored = 0),
u AS (SELECT i, a / n AS r, CASE WHEN a + b > 0 THEN CAST(a AS DOUBLE) / (a + b) ELSE 0 END AS p, a + b AS k FROM y, n),
v2 AS (SELECT (r - lag(r) OVER (ORDER BY i)) * (p + lag(p) OVER (ORDER BY i)) / 2 AS s, lag(k) OVER (ORDER BY i) AS pk FROM u)
SELECT round(sum(CASE WHEN pk > 0 THEN s ELSE 0 END), 9) AS ap FROM v2""")
def trapezoid_ap(spark: SparkSession, sf_dir: str) -> DataFrame:
    det, gt = _det(spark, sf_dir), _gt(spark, sf_dir)
    total = gt.where("ignored = 0").agg(F.count("*")).scalar()
    return E.trapezoid_ap(M.match_default(det, gt), total).select(F.round("ap", 9).alias("ap"))


@query("miss_rate", _MATCHED + """, y AS (SELECT sum(tp) OVER w AS a, sum(fp) OVER w AS b, row_number() OVER w AS i FROM t WINDOW w AS (ORDER BY score DESC, det_id ROWS UNBOUNDED PRECEDING)),
u AS (SELECT i, b / (SELECT CAST(count(DISTINCT image_id) AS DOUBLE) FROM gt) AS fppi, 1 - a / (SELECT CAST(count(*) AS DOUBLE) FROM gt WHERE ignored = 0) AS miss FROM y),
ref AS (SELECT unnest([0.01, 0.0178, 0.0316, 0.0562, 0.1, 0.1778, 0.3162, 0.5623, 1.0]) AS ref),
e AS (SELECT ref, coalesce(arg_min(miss, i) FILTER (fppi >= CAST(ref AS DOUBLE)), arg_max(miss, i)) AS miss FROM u, ref GROUP BY ref)
SELECT round(exp(avg(ln(miss))), 9) AS mr FROM e""")
def miss_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    det, gt = _det(spark, sf_dir), _gt(spark, sf_dir)
    total, images = gt.where("ignored = 0").agg(F.count("*")).scalar(), gt.agg(F.count_distinct("image_id")).scalar()
    return E.miss_rate(M.match_default(det, gt), total, images).select(F.round("mr", 9).alias("mr"))


@query("topk_recall", pair_sql() + """, d2 AS (SELECT det_id, row_number() OVER (PARTITION BY image_id, label ORDER BY score DESC, det_id) AS rank FROM det),
k AS (SELECT unnest([1, 5, 10]) AS k), b AS (SELECT p.image_id, p.label, k, max(inter / greatest(da + ga - inter, 0.000001)) AS iou FROM p JOIN d2 USING (det_id), k WHERE rank <= k GROUP BY ALL),
ph AS (SELECT DISTINCT image_id, label, k FROM gt, k)
SELECT k, count(*) AS n, round(avg(CASE WHEN coalesce(iou, 0) >= 0.5 THEN 1.0 ELSE 0.0 END), 9) AS recall FROM ph LEFT JOIN b USING (image_id, label, k) GROUP BY k""")
def topk_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.topk_recall(_det(spark, sf_dir), _gt(spark, sf_dir)).withColumn("recall", F.round("recall", 9))


@query("referring_segmentation", pair_sql() + " SELECT round(100 * sum(inter) / sum(da + ga - inter), 6) AS c_iou, round(100 * avg(inter / (da + ga - inter)), 6) AS m_iou FROM p")
def referring_segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = E.box_intersections(_det(spark, sf_dir), _gt(spark, sf_dir))
    return E.referring_segmentation(x).select(F.round("c_iou", 6).alias("c_iou"), F.round("m_iou", 6).alias("m_iou"))


@query("confusion_matrix", """, a AS (SELECT d.det_id, g.gt_id, d.label AS dl, g.label AS gl, greatest(least(d.x2, g.x2) - greatest(d.x1, g.x1), 0) * greatest(least(d.y2, g.y2) - greatest(d.y1, g.y1), 0) AS i,
  (d.x2 - d.x1) * (d.y2 - d.y1) + (g.x2 - g.x1) * (g.y2 - g.y1) AS s FROM det d JOIN gt g ON d.image_id = g.image_id WHERE d.score >= 0.3),
h AS (SELECT * FROM a WHERE i / greatest(s - i, 0.000001) >= 0.5),
u AS (SELECT gl AS gt_label, dl AS pred_label FROM h UNION ALL SELECT 5, label FROM det WHERE score >= 0.3 AND det_id NOT IN (SELECT det_id FROM h) UNION ALL SELECT label, 5 FROM gt WHERE gt_id NOT IN (SELECT gt_id FROM h WHERE gl = dl)),
c AS (SELECT gt_label, pred_label, count(*) AS n FROM u GROUP BY ALL)
SELECT gt_label, pred_label, n, round(100.0 * n / sum(n) OVER (PARTITION BY gt_label), 6) AS percent FROM c""")
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.confusion(_det(spark, sf_dir), _gt(spark, sf_dir), 5, 0.3).withColumn("percent", F.round("percent", 6))


@query("occluded_recall", pair_sql() + " SELECT round(100.0 * count(DISTINCT CASE WHEN score >= 0.3 AND inter / greatest(da + ga - inter, 0.000001) >= 0.75 THEN gt_id END) / (SELECT count(*) FROM gt), 6) AS recall FROM p")
def occluded_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.occluded_recall(_det(spark, sf_dir), _gt(spark, sf_dir)).select(F.round("recall", 6).alias("recall"))


@query("robustness", """, r AS (SELECT event_id % 16 AS corruption, (event_id * 31) % 6 AS severity, label AS metric, avg(score) AS value FROM box GROUP BY ALL)
SELECT metric, round(max(CASE WHEN severity = 0 THEN value END), 9) AS p, round(sum(CASE WHEN severity > 0 AND corruption < 15 THEN value ELSE 0 END) / 75, 9) AS mpc,
  round(sum(CASE WHEN severity > 0 AND corruption < 15 THEN value ELSE 0 END) / 75 / max(CASE WHEN severity = 0 THEN value END), 9) AS rpc FROM r GROUP BY metric""")
def robustness(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = views.boxes(spark, sf_dir)
    r = b.groupBy(F.expr("event_id % 16").alias("corruption"), F.expr("(event_id * 31) % 6").alias("severity"), F.col("label").alias("metric")).agg(F.avg("score").alias("value"))
    return E.robustness(r).select("metric", *[F.round(c, 9).alias(c) for c in ("p", "mpc", "rpc")])


_VALUES = ("map", "map_50", "map_75", "map_s", "map_m", "map_l", "ar_1", "ar_10", "ar_100", "ar_s", "ar_m", "ar_l")


def _coco_sql(sizes: str) -> str:
    """Greedy matching of images and labels as a fold over detections, for every threshold ``t`` and range ``a`` of ``sizes``
    (rows of a, low, high): up to ``z`` (label, a, t, ap) and ``y`` (label, a, t, r_1, r_10, r_100)."""
    state = "'taken': []::BIGINT[], 'rows': []::STRUCT(det_id BIGINT, score DOUBLE, place BIGINT, tp INTEGER, fp INTEGER)[]"
    return f""", sz AS (SELECT * FROM (VALUES {sizes}) v(a, low, high)), d AS (SELECT *, (x2 - x1) * (y2 - y1) AS area, row_number() OVER (PARTITION BY image_id, label ORDER BY score DESC, det_id) - 1 AS r FROM det QUALIFY r < 100),
g AS (SELECT *, (x2 - x1) * (y2 - y1) AS area, row_number() OVER (PARTITION BY image_id, label ORDER BY gt_id) AS j FROM gt), n AS (SELECT label, a, count(*) AS n FROM g JOIN sz ON area BETWEEN low AND high WHERE ignored = 0 GROUP BY ALL),
o AS (SELECT d.det_id, g.j, g.ignored, g.area, greatest(least(d.x2, g.x2) - greatest(d.x1, g.x1), 0) * greatest(least(d.y2, g.y2) - greatest(d.y1, g.y1), 0) AS i, d.area + g.area AS s FROM d JOIN g USING (image_id, label)),
p AS (SELECT det_id, a, list({{'j': j, 'v': i / greatest(s - i, 0.000001), 's': CASE WHEN ignored = 1 OR area < low OR area > high THEN 1 ELSE 0 END}}) AS cand FROM o, sz WHERE i / greatest(s - i, 0.000001) >= 0.5 GROUP BY ALL),
e AS (SELECT image_id, label, a, t, list({{{state}, 'cand': coalesce(cand, []), 'det_id': d.det_id, 'score': score, 'place': r, 'off': area < low OR area > high, 'least': least(0.5::DOUBLE + 0.05::DOUBLE * t, 1 - 1e-10)}} ORDER BY r) AS l FROM d CROSS JOIN sz LEFT JOIN p USING (det_id, a), range(10) k(t) GROUP BY ALL),
f AS (SELECT label, a, t, unnest(list_reduce(list_prepend({{{state}, 'cand': l[1].cand, 'det_id': 0::BIGINT, 'score': 0::DOUBLE, 'place': 0::BIGINT, 'off': false, 'least': 0::DOUBLE}}, l), lambda acc, x:
  list_transform([list_sort(list_transform(list_filter(x.cand, lambda k: k.v >= x.least AND NOT list_contains(acc.taken, k.j)), lambda k: {{'s': -k.s, 'v': k.v, 'j': k.j}}), 'DESC')[1]], lambda b: {{'taken': CASE WHEN b IS NULL THEN acc.taken ELSE list_append(acc.taken, b.j) END,
  'rows': list_append(acc.rows, {{'det_id': x.det_id, 'score': x.score, 'place': x.place, 'tp': CASE WHEN b.s = 0 THEN 1 ELSE 0 END::INTEGER, 'fp': CASE WHEN b IS NULL AND NOT x.off THEN 1 ELSE 0 END::INTEGER}}), 'cand': x.cand, 'det_id': x.det_id, 'score': x.score, 'place': x.place, 'off': x.off, 'least': x.least}})[1]).rows, recursive := true) FROM e),
c AS (SELECT label, a, t, sum(tp) OVER w AS ct, sum(fp) OVER w AS cf FROM f WHERE tp + fp > 0 WINDOW w AS (PARTITION BY label, a, t ORDER BY score DESC, det_id)),
h AS (SELECT label, a, t, i, coalesce(max(ct / (ct + cf)) FILTER (ct / n >= CASE WHEN i = 100 THEN 1 ELSE i * 0.01::DOUBLE END), 0) AS p FROM c JOIN n USING (label, a), range(101) r(i) GROUP BY ALL), m AS (SELECT label, a, t, avg(p) AS ap FROM h GROUP BY ALL),
z AS (SELECT label, a, t, coalesce(ap, 0) AS ap FROM n CROSS JOIN range(10) k(t) LEFT JOIN m USING (label, a, t)), q AS (SELECT label, a, t, sum(tp) FILTER (place < 1) AS s1, sum(tp) FILTER (place < 10) AS s10, sum(tp) AS s100 FROM f GROUP BY ALL),
y AS (SELECT label, a, t, coalesce(s1, 0) / n AS r_1, coalesce(s10, 0) / n AS r_10, coalesce(s100, 0) / n AS r_100 FROM n CROSS JOIN range(10) k(t) LEFT JOIN q USING (label, a, t))"""


_ALL = "(0, 0::DOUBLE, 1e10)"
_RANGES = _ALL + ", (1, 0, 1024), (2, 1024, 9216), (3, 9216, 1e10)"
_SUMMARY = ", ".join(
    f"round(coalesce((SELECT avg({v}) FROM {t} WHERE {w}), -1), 9) AS {n}"
    for n, v, t, w in (
        ("map", "ap", "z", "a = 0"), ("map_50", "ap", "z", "a = 0 AND t = 0"), ("map_75", "ap", "z", "a = 0 AND t = 5"), ("map_s", "ap", "z", "a = 1"), ("map_m", "ap", "z", "a = 2"), ("map_l", "ap", "z", "a = 3"),
        ("ar_1", "r_1", "y", "a = 0"), ("ar_10", "r_10", "y", "a = 0"), ("ar_100", "r_100", "y", "a = 0"), ("ar_s", "r_100", "y", "a = 1"), ("ar_m", "r_100", "y", "a = 2"), ("ar_l", "r_100", "y", "a = 3"),
    )
)


@query("coco_summary", _coco_sql(_RANGES) + f" SELECT {_SUMMARY}")
def coco_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Y.coco_summary(_det(spark, sf_dir), _gt(spark, sf_dir)).select(*[F.round(n, 9).alias(n) for n in _VALUES])


@query("coco_by_class", _coco_sql(_ALL) + " SELECT label, round(avg(ap), 9) AS map, round(max(ap) FILTER (t = 0), 9) AS map_50, round(max(ap) FILTER (t = 5), 9) AS map_75 FROM z GROUP BY label")
def coco_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Y.coco_summary(_det(spark, sf_dir), _gt(spark, sf_dir), by_class=True).select("label", *[F.round(n, 9).alias(n) for n in _VALUES[:3]])


@query("lvis_summary")
def lvis_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = _gt(spark, sf_dir).select("image_id").distinct().selectExpr("image_id", "array(image_id % 5) AS negative", "CASE WHEN image_id % 3 = 0 THEN array((image_id + 1) % 5) ELSE array() END AS not_exhaustive")
    kinds = spark.createDataFrame([(0, "r"), (1, "c"), (2, "c"), (3, "f"), (4, "f")], "label long, frequency string")
    x = Y.lvis_summary(_det(spark, sf_dir), _gt(spark, sf_dir), images, kinds)
    return x.select(*[F.round(n, 9).alias(n) for n in x.columns])


@query("jaccard_index")
def jaccard_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.jaccard_index(_det(spark, sf_dir), _gt(spark, sf_dir)).select(F.round("ji", 9).alias("ji"))


@query("split_summary", _coco_sql(_ALL) + " SELECT CASE WHEN label < 3 THEN 'seen' ELSE 'new' END AS split, round(avg(ap), 9) AS ap, round(avg(ap) FILTER (t = 0), 9) AS ap50 FROM z GROUP BY 1")
def split_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes 0 to 2 as seen ones, 3 and 4 as new ones."""
    d, g = _det(spark, sf_dir), _gt(spark, sf_dir)
    splits = g.select("label").distinct().withColumn("split", F.when(F.col("label") < 3, "seen").otherwise("new"))
    return Y.split_summary(d, g, splits).select("split", F.round("ap", 9).alias("ap"), F.round("ap50", 9).alias("ap50"))


@query("grounded_f1")
def grounded_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An expression for each image; every seventh has no target."""
    gt = _gt(spark, sf_dir).withColumn("no_target", F.when(F.col("image_id") % 7 == 0, 1).otherwise(0))
    pred = _det(spark, sf_dir).withColumnRenamed("det_id", "pred_id").where("image_id % 14 <> 0 OR score < 0.7")
    x = E.grounded_f1(pred, gt, least_score=0.7, least_f1=0.4)
    return x.select(*[F.round(c, 9).alias(c) for c in x.columns])


@query("crowd_matches")
def crowd_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.crowd_matches(_det(spark, sf_dir), _gt(spark, sf_dir)).select("det_id", "image_id", "tp")
