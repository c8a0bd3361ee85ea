"""Run-length masks: overlaps, instance scores, panoptic fusion, copy and paste. Twins work on single positions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ...operators import metrics as E
from ...operators import runs as RL
from ...operators import transforms as R
from ...operators.sampling import draw_sql
from .. import views
from .registry import query

#: Masks of the views: boxes on a grid of 8, ragged at the top, on canvases of 42 columns and 32 rows.
HEIGHT, SIZE = 32, 42 * 32

_PX = """, cx AS (SELECT *, unnest(range(CAST(floor(x1 / 8) AS BIGINT), CAST(floor(x2 / 8) AS BIGINT))) AS x FROM box),
px AS (SELECT *, x * 32 + unnest(range(CAST(floor(y1 / 8) AS BIGINT) + (x + event_id) % 3, CAST(floor(y2 / 8) AS BIGINT))) AS p FROM cx)"""


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, image_id, label, k, ignored, group_of, score, x, start, end: one run for each column of a mask."""
    b = views.boxes(spark, sf_dir).withColumn("x", F.explode(F.expr("sequence(cast(floor(x1 / 8) AS bigint), cast(floor(x2 / 8) AS bigint) - 1)")))
    top, low = F.expr("cast(floor(y1 / 8) AS bigint) + (x + event_id) % 3"), F.expr("cast(floor(y2 / 8) AS bigint)")
    return b.withColumn("start", F.col("x") * HEIGHT + top).withColumn("end", F.col("x") * HEIGHT + low).drop("x1", "y1", "x2", "y2", "gx", "gy")


def _sizes(runs: DataFrame) -> DataFrame:
    return runs.select("image_id").distinct().select("image_id", F.lit(SIZE).cast("long").alias("size"), F.lit(HEIGHT).cast("long").alias("height"))


@query("mask_overlaps", _PX + " SELECT d.image_id, d.event_id AS det_id, g.event_id AS gt_id, count(*) AS n FROM px d JOIN px g ON d.image_id = g.image_id AND d.p = g.p AND d.label = g.label WHERE d.k = 1 AND g.k = 0 GROUP BY ALL")
def mask_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _runs(spark, sf_dir)
    side = lambda k, name: r.where(f"k = {k}").select("image_id", F.col("event_id").alias(name), F.col("label").alias(f"{name}_label"), "start", "end")
    x = RL.shared(side(1, "det_id"), side(0, "gt_id"), ["image_id", "det_id", "gt_id", "det_id_label", "gt_id_label"])
    return x.where("det_id_label = gt_id_label").select("image_id", "det_id", "gt_id", "n")


@query("mask_boxes", _PX + " SELECT image_id, event_id, count(*) AS area, CAST(min(p // 32) AS DOUBLE) AS x1, CAST(min(p % 32) AS DOUBLE) AS y1, CAST(max(p // 32) + 1 AS DOUBLE) AS x2, CAST(max(p % 32) + 1 AS DOUBLE) AS y2 FROM px GROUP BY ALL")
def mask_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return RL.boxes_of(_runs(spark, sf_dir), ["image_id", "event_id"], F.lit(HEIGHT))


@query("instance_precision", _PX + """, gp AS (SELECT image_id, p, min(event_id) AS gt_id FROM px WHERE k = 0 GROUP BY ALL), g AS (SELECT gp.image_id, gt_id, b.label, b.ignored, b.group_of, count(*) AS ga FROM gp JOIN box b ON b.event_id = gt_id GROUP BY ALL),
d AS (SELECT image_id, event_id AS pred_id, label, score, count(*) AS pa FROM px WHERE k <> 0 GROUP BY ALL),
on_void AS (SELECT px.event_id AS pred_id, count(*) AS v FROM px JOIN gp USING (image_id, p) JOIN g USING (image_id, gt_id) WHERE px.k <> 0 AND g.group_of = 1 GROUP BY ALL),
i AS (SELECT px.event_id AS pred_id, gt_id, count(*) AS n FROM px JOIN gp USING (image_id, p) JOIN g USING (image_id, gt_id) WHERE px.k <> 0 AND g.group_of = 0 AND g.label = px.label GROUP BY ALL),
m AS (SELECT i.*, d.label, d.score, n / (pa + ga - n) AS iou, ignored = 0 AND ga >= 60 AS valid FROM i JOIN d USING (pred_id) JOIN g USING (gt_id)), l AS (SELECT t, 0.5::DOUBLE + 0.05::DOUBLE * t AS least FROM range(10) r(t)),
o AS (SELECT m.*, t, row_number() OVER (PARTITION BY t, gt_id ORDER BY score DESC, pred_id) AS place FROM m, l WHERE iou > least),
s AS (SELECT d.*, (coalesce(v, 0) + coalesce((SELECT sum(n) FROM m WHERE m.pred_id = d.pred_id AND NOT valid), 0)) / pa AS skipped FROM d LEFT JOIN on_void USING (pred_id)),
r AS (SELECT label, t, score, CASE WHEN place = 1 THEN 1 ELSE 0 END AS tp FROM o WHERE valid UNION ALL SELECT label, t, score, 0 FROM s, l WHERE skipped <= least AND NOT EXISTS (SELECT 1 FROM o WHERE o.pred_id = s.pred_id AND o.t = l.t)),
u AS (SELECT label, t, score, sum(tp) AS tp, count(*) AS n FROM r GROUP BY ALL), c AS (SELECT *, sum(tp) OVER w AS ct, sum(n) OVER w AS cn FROM u WINDOW w AS (PARTITION BY label, t ORDER BY score DESC)),
a AS (SELECT label, t, sum(tp * (ct / cn + CASE WHEN cn = n THEN 1 ELSE (ct - tp) / (cn - n) END) / 2) AS area FROM c GROUP BY ALL), n AS (SELECT label, count(*) AS num_gts FROM g WHERE group_of = 0 AND ignored = 0 AND ga >= 60 GROUP BY 1)
SELECT label, round(least, 6) AS threshold, num_gts, round(coalesce(area, 0) / num_gts, 6) AS ap FROM n CROSS JOIN l LEFT JOIN a USING (label, t)""")
def instance_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _runs(spark, sf_dir)
    top = RL.on_top(r.where("k = 0"), [F.col("event_id")], ["event_id", "label", "ignored", "group_of"])  # one owner a position
    gt = top.where("group_of = 0").select("image_id", F.col("event_id").alias("gt_id"), "label", F.col("ignored").alias("crowd"), "start", "end")
    pred = r.where("k <> 0").select("image_id", F.col("event_id").alias("pred_id"), "label", "score", "start", "end")
    x = RL.instance_precision(pred, gt, top.where("group_of = 1"), least=60)
    return x.select("label", F.round("threshold", 6).alias("threshold"), "num_gts", F.round("ap", 6).alias("ap"))


@query("fuse_panoptic")
def fuse_panoptic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Things of labels 0 to 2 over stuff of labels 3 and 4, then how good the result is against the ground truth."""
    r = _runs(spark, sf_dir)
    stuff = lambda x: RL.stacked(x.where("label > 2"), [F.col("event_id")], ["label"])
    things = lambda x: x.where("label < 3").select("image_id", F.col("event_id").alias("mask_id"), "label", "score", "start", "end")
    fuse = lambda x: RL.fuse_panoptic(things(x), stuff(x), _sizes(r), least_stuff=60, fill=True)
    pred, gt = fuse(r.where("k <> 0")).withColumnRenamed("segment_id", "pred_id"), fuse(r.where("k = 0")).withColumnRenamed("segment_id", "gt_id")
    joint = RL.shared(gt, pred, ["image_id", "gt_id", "pred_id"])
    # void is dropped after the sums, so that all readers of ``joint`` share its shuffle
    kinds = lambda name: joint.groupBy("image_id", name).agg(F.sum("n").alias("n"), F.max(name).alias("_k")).where("n > 0 AND _k <> 255").select("image_id", name, (F.col(name) % RL.OFFSET).alias("category"))
    return E.panoptic_quality(joint, kinds("gt_id").withColumn("crowd", F.lit(0)), kinds("pred_id"), void=255).withColumn("sum_iou", F.round("sum_iou", 6))


@query("fuse_queries", _PX + """, q AS (SELECT image_id, event_id, label, score, p, CAST((event_id * 13 + x * 7) % 10 AS DOUBLE) / 10 + 0.05 AS pr FROM px WHERE k <> 0 AND score > 0.3), im AS (SELECT image_id, min(event_id) AS f FROM q GROUP BY 1),
a AS (SELECT image_id, event_id, label, score, p, pr FROM q UNION ALL SELECT im.image_id, f, b.label, b.score, p, 0 FROM im JOIN box b ON b.event_id = f, range(1344) r(p)),
w AS (SELECT image_id, p, first(event_id ORDER BY score * pr DESC, event_id) AS event_id FROM a GROUP BY ALL), o AS (SELECT event_id, count(*) AS own FROM q WHERE pr >= 0.5 GROUP BY 1),
k AS (SELECT w.image_id, event_id, b.label, count(*) AS area FROM w JOIN box b USING (event_id) GROUP BY ALL), n AS (SELECT k.* FROM k JOIN o USING (event_id) WHERE area / own >= 0.4),
s AS (SELECT event_id, CASE WHEN label < 3 THEN label + 1000 * sum(CASE WHEN label < 3 THEN 1 ELSE 0 END) OVER (PARTITION BY image_id ORDER BY event_id) ELSE label END AS segment_id FROM n),
e AS (SELECT image_id, coalesce(segment_id, 255) AS segment_id FROM w LEFT JOIN s USING (event_id) UNION ALL SELECT image_id, 255 FROM (SELECT DISTINCT image_id FROM box) i, range(1344) WHERE NOT EXISTS (SELECT 1 FROM im WHERE im.image_id = i.image_id))
SELECT image_id, CAST(segment_id AS BIGINT) AS segment_id, count(*) AS area FROM e GROUP BY ALL""")
def fuse_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _runs(spark, sf_dir)
    parts = r.where("k <> 0").select("image_id", F.col("event_id").alias("mask_id"), "label", "score", "start", "end", F.expr("cast((event_id * 13 + x * 7) % 10 AS double) / 10 + 0.05").alias("p"))
    x = RL.fuse_queries(parts, _sizes(r), things=3, least_score=0.3, least_share=0.4)
    return x.groupBy("image_id", "segment_id").agg(F.sum(F.col("end") - F.col("start")).alias("area"))


@query("copy_paste", _PX + f""", m AS (SELECT image_id, event_id, label, min(p // 32) AS x1, min(p % 32) AS y1, max(p // 32) + 1 AS x2, max(p % 32) + 1 AS y2 FROM px WHERE k = 0 GROUP BY ALL),
im AS (SELECT image_id, row_number() OVER (ORDER BY image_id % 256, image_id) - 1 AS i, count(*) OVER () AS total FROM (SELECT DISTINCT image_id FROM box)), pt AS (SELECT a.image_id, o.image_id AS partner FROM (SELECT *, floor({draw_sql(0, 'image_id', '1')} * total) AS at FROM im) a JOIN im o ON o.i = a.at),
o AS (SELECT pt.image_id, partner, m.event_id, m.label, x1, y1, x2, y2, count(*) OVER (PARTITION BY pt.image_id) AS n FROM pt JOIN m ON m.image_id = partner), h AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY {draw_sql(6, 'image_id', 'event_id')}, event_id) AS r, floor({draw_sql(5, 'image_id')} * least(n + 1, 100)) AS most FROM o),
new AS (SELECT * FROM h WHERE r <= most), cov AS (SELECT DISTINCT new.image_id, px.p FROM new JOIN px ON px.event_id = new.event_id), t AS (SELECT DISTINCT image_id FROM new),
u AS (SELECT px.image_id, px.event_id, count(*) AS area, min(p // 32) AS x1, min(p % 32) AS y1, max(p // 32) + 1 AS x2, max(p % 32) + 1 AS y2 FROM px WHERE k = 0 AND NOT EXISTS (SELECT 1 FROM cov WHERE cov.image_id = px.image_id AND cov.p = px.p) GROUP BY ALL),
v AS (SELECT m.image_id, m.event_id, m.label, coalesce(u.area, 0) AS area, coalesce(u.x1, 0) AS x1, coalesce(u.y1, 0) AS y1, coalesce(u.x2, 0) AS x2, coalesce(u.y2, 0) AS y2, greatest(abs(m.x1 - coalesce(u.x1, 0)), abs(m.y1 - coalesce(u.y1, 0)), abs(m.x2 - coalesce(u.x2, 0)), abs(m.y2 - coalesce(u.y2, 0))) AS moved FROM m LEFT JOIN u USING (image_id, event_id)),
x AS (SELECT image_id, image_id AS source_id, event_id, label, 0 AS pasted, x1, y1, x2, y2 FROM v WHERE moved <= 2 OR area > 60 OR image_id NOT IN (SELECT image_id FROM t) UNION ALL SELECT image_id, partner, event_id, label, 1, x1, y1, x2, y2 FROM new)
SELECT image_id, source_id, event_id AS instance_id, label, pasted, CAST(x1 AS DOUBLE) AS x1, CAST(y1 AS DOUBLE) AS y1, CAST(x2 AS DOUBLE) AS x2, CAST(y2 AS DOUBLE) AS y2 FROM x""")
def copy_paste(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _runs(spark, sf_dir).withColumnRenamed("event_id", "instance_id")
    own = r.where("k = 0")
    instances = RL.boxes_of(own, ["image_id", "instance_id", "label"], F.lit(HEIGHT)).drop("area")
    sizes = _sizes(r)
    partners = R.partners(sizes.withColumns({"width": F.lit(42), "height": F.lit(HEIGHT)}), 1).select("image_id", "partner")
    return RL.copy_paste(instances, own.select("image_id", "instance_id", "start", "end"), partners, sizes, box_shift=2, least_area=60, seed=5)[0]
