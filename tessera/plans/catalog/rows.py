"""Cleaning, transforms, text, unions and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ...functions import text as TX
from ...operators import policies as PL
from ...operators import transforms as R
from ...sources import annotations as N
from ...sources import images as IM
from ...operators import prepare as PP
from ...operators.sampling import draw_sql
from .. import convert as CV
from .. import views
from .registry import query

_IMG = """, img AS (SELECT DISTINCT image_id, 300 + image_id % 41 AS width, 220 + image_id % 37 AS height FROM box),
b AS (SELECT box.*, width, height FROM box JOIN img USING (image_id))"""


def _images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.boxes(spark, sf_dir).select("image_id").distinct().withColumn("width", 300 + F.col("image_id") % 41).withColumn("height", 220 + F.col("image_id") % 37)


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.boxes(spark, sf_dir).join(_images(spark, sf_dir), "image_id")


@query("clean_annotations", _IMG + """ SELECT event_id AS id, image_id, label, x1 - 60 AS x1, y1 - 40 AS y1, x2 - 60 AS x2, y2 - 40 AS y2, CASE WHEN event_id % 11 = 0 THEN 1 ELSE 0 END AS ignored FROM b
WHERE event_id % 13 <> 0 AND label <> 4 AND greatest(0, least(x2 - 60, width) - greatest(x1 - 60, 0)) * greatest(0, least(y2 - 40, height) - greatest(y1 - 40, 0)) > 0 AND event_id % 17 <> 0""")
def clean_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = views.boxes(spark, sf_dir)
    ann = b.select(
        F.col("event_id").alias("id"), "image_id", F.col("label").alias("category_id"), F.expr("array(x1 - 60, y1 - 40, x2 - x1, y2 - y1)").alias("bbox"),
        F.expr("CASE WHEN event_id % 17 = 0 THEN 0.0 ELSE (x2 - x1) * (y2 - y1) END").alias("area"), F.expr("CASE WHEN event_id % 11 = 0 THEN '1' ELSE '0' END").alias("iscrowd"), F.expr("CASE WHEN event_id % 13 = 0 THEN 1 ELSE 0 END").alias("ignore"),
    )
    labels = spark.range(4).select(F.col("id").alias("category_id"), F.col("id").alias("label"))
    return N.clean(ann, _images(spark, sf_dir).withColumnRenamed("image_id", "id"), labels).drop("area")


@query("filter_images", _IMG + " SELECT image_id AS id, width, height FROM img WHERE least(width, height) >= 230 AND EXISTS (SELECT 1 FROM box WHERE box.image_id = img.image_id AND label = 2 AND k = 0)")
def filter_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    ann = views.boxes(spark, sf_dir).where("k = 0").select("image_id", F.col("label").alias("category_id"))
    return N.filter_images(_images(spark, sf_dir).withColumnRenamed("image_id", "id"), ann, spark.range(2, 3).select(F.col("id").alias("category_id")), 230)


@query("filter_boxes", " SELECT event_id, image_id FROM box WHERE x2 - x1 > 90 AND y2 - y1 > 88")
def filter_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.filter_boxes(views.boxes(spark, sf_dir), 90, 88)[0].select("event_id", "image_id")


@query("resize", _IMG + """, s AS (SELECT *, least(1333.0 / greatest(width, height), 800.0 / least(width, height)) AS s FROM b), t AS (SELECT *, floor(width * s + 0.5) AS w, floor(height * s + 0.5) AS h FROM s)
SELECT event_id, round(least(greatest(x1 * w / width, 0), w), 6) AS x1, round(least(greatest(y2 * h / height, 0), h), 6) AS y2, CAST(w AS INTEGER) AS width, CAST(h AS INTEGER) AS height FROM t""")
def resize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.resize(_boxes(spark, sf_dir), 1333, 800).select("event_id", F.round("x1", 6).alias("x1"), F.round("y2", 6).alias("y2"), "width", "height")


@query("resize_shortest", _IMG + """, s AS (SELECT *, least(300.0 / least(width, height), 420.0 / greatest(width, height)) AS s FROM b), t AS (SELECT *, floor(width * s + 0.5) AS w, floor(height * s + 0.5) AS h FROM s)
SELECT event_id, round(x2 * w / width, 6) AS x2, CAST(w AS INTEGER) AS width, CAST(h AS INTEGER) AS height FROM t""")
def resize_shortest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.resize_shortest(_boxes(spark, sf_dir), 300, 420).select("event_id", F.round("x2", 6).alias("x2"), "width", "height")


_D = draw_sql(5, "image_id")


@query("random_flip", _IMG + f""" SELECT event_id, {_D} < 0.5 AS flipped, CASE WHEN {_D} < 0.5 THEN width - x2 ELSE x1 END AS x1, CASE WHEN {_D} < 0.5 THEN width - x1 ELSE x2 END AS x2, y1, y2 FROM b""")
def random_flip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.flip(_boxes(spark, sf_dir), seed=5).select("event_id", "flipped", "x1", "x2", "y1", "y2")


@query("crop", " SELECT event_id, least(greatest(x1 - 50, 0), 150) AS x1, least(greatest(y1 - 30, 0), 120) AS y1, least(greatest(x2 - 50, 0), 150) AS x2, least(greatest(y2 - 30, 0), 120) AS y2 FROM box WHERE x1 - 50 < 150 AND x2 - 50 > 0 AND y1 - 30 < 120 AND y2 - 30 > 0")
def crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.crop(views.boxes(spark, sf_dir), 50, 30, 150, 120).select("event_id", "x1", "y1", "x2", "y2")


@query("random_shift", _IMG + f""", m AS (SELECT *, floor({draw_sql(2, 'image_id')} * 65) - 32 AS dx, floor({draw_sql(3, 'image_id')} * 65) - 32 AS dy, {draw_sql(4, 'image_id')} < 0.5 AS go FROM b),
c AS (SELECT *, least(greatest(x1 + dx, 0), width) AS a1, least(greatest(y1 + dy, 0), height) AS b1, least(greatest(x2 + dx, 0), width) AS a2, least(greatest(y2 + dy, 0), height) AS b2 FROM m),
o AS (SELECT *, a2 - a1 > 1 AND b2 - b1 > 1 AS ok FROM c), n AS (SELECT *, go AND bool_or(ok) OVER (PARTITION BY image_id) AS moved FROM o)
SELECT event_id, CASE WHEN moved THEN a1 ELSE x1 END AS x1, CASE WHEN moved THEN b1 ELSE y1 END AS y1, CASE WHEN moved THEN a2 ELSE x2 END AS x2, CASE WHEN moved THEN b2 ELSE y2 END AS y2 FROM n WHERE NOT moved OR ok""")
def random_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.shift(_boxes(spark, sf_dir), seed=2).select("event_id", "x1", "y1", "x2", "y2")


@query("expand", _IMG + f""", w AS (SELECT *, CAST(floor(width * 2.5) AS BIGINT) AS w, CAST(floor(height * 2.5) AS BIGINT) AS h FROM b)
SELECT event_id, x1 + floor({draw_sql(1, 'image_id')} * (w - width + 1)) AS x1, y1 + floor({draw_sql(2, 'image_id')} * (h - height + 1)) AS y1, w AS width, h AS height FROM w""")
def expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.expand(_boxes(spark, sf_dir), 2.5, seed=1).select("event_id", "x1", "y1", "width", "height")


_NUMBERED = _IMG + ", num AS (SELECT *, row_number() OVER (ORDER BY image_id % 256, image_id) - 1 AS i, count(*) OVER () AS total FROM img)"


@query("mosaic", _NUMBERED + f""", f AS (SELECT image_id, 0 AS place, image_id AS partner, width AS w, height AS h FROM num UNION ALL SELECT a.image_id, place, o.image_id, o.width, o.height FROM (SELECT *, floor({draw_sql(0, 'image_id', 'place')} * total) AS at FROM num, range(1, 4) t(place)) a JOIN num o ON o.i = a.at),
s AS (SELECT *, least(640.0::DOUBLE / h, 640.0::DOUBLE / w) AS s FROM f), q AS (SELECT image_id, partner, s, CASE WHEN place % 2 = 0 THEN 640 - CAST(floor(w * s) AS BIGINT) ELSE 640 END AS x, CASE WHEN place < 2 THEN 640 - CAST(floor(h * s) AS BIGINT) ELSE 640 END AS y FROM s),
m AS (SELECT q.image_id, least(greatest(x1 * s + x, 0), 1280) AS x1, least(greatest(y1 * s + y, 0), 1280) AS y1, least(greatest(x2 * s + x, 0), 1280) AS x2, least(greatest(y2 * s + y, 0), 1280) AS y2 FROM q JOIN box ON box.image_id = q.partner)
SELECT image_id, count(*) AS n, round(sum(x1), 3) AS x1 FROM m WHERE x2 > x1 AND y2 > y1 GROUP BY image_id""")
def mosaic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.mosaic(views.boxes(spark, sf_dir), _images(spark, sf_dir)).groupBy("image_id").agg(F.count("*").alias("n"), F.round(F.sum("x1"), 3).alias("x1"))


@query("pad", _IMG + " SELECT event_id, x1, CAST(ceil(greatest(width, 310) / 32.0) * 32 AS INTEGER) AS width, CAST(ceil(greatest(height, 240) / 32.0) * 32 AS INTEGER) AS height FROM b")
def pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.pad(_boxes(spark, sf_dir), (310, 240), 32).select("event_id", "x1", "width", "height")


_SIDE = "* (0.3 + 0.7 * {draw})"


@query("iou_crop", _IMG + f""", s AS (SELECT *, [2, 0.1, 0.3, 0.5, 0.7, 0.9, 0][CAST(floor({draw_sql(3, 'image_id')} * 7) AS BIGINT) + 1] AS least FROM img), t AS (SELECT *, width {_SIDE.format(draw=draw_sql(4, 'image_id', 'k'))} AS nw, height {_SIDE.format(draw=draw_sql(5, 'image_id', 'k'))} AS nh FROM s, range(1, 51) r(k) WHERE least <= 1),
o AS (SELECT *, {draw_sql(6, 'image_id', 'k')} * (width - nw) AS l, {draw_sql(7, 'image_id', 'k')} * (height - nh) AS t FROM t WHERE nh / nw BETWEEN 0.5 AND 2), p AS (SELECT image_id, k, least, floor(l) AS a1, floor(t) AS b1, floor(l + nw) AS a2, floor(t + nh) AS b2 FROM o),
j AS (SELECT p.*, (x1 + x2) / 2 > a1 AND (y1 + y2) / 2 > b1 AND (x1 + x2) / 2 < a2 AND (y1 + y2) / 2 < b2 AS inside, greatest(least(a2, x2) - greatest(a1, x1), 0) * greatest(least(b2, y2) - greatest(b1, y1), 0) AS i, (a2 - a1) * (b2 - b1) + (x2 - x1) * (y2 - y1) AS u FROM p JOIN box USING (image_id)),
g AS (SELECT image_id, k, a1, b1, a2, b2 FROM j GROUP BY ALL HAVING min(i / greatest(u - i, 0.000001)) >= max(least) AND bool_or(inside)), c AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY k) = 1),
y AS (SELECT b.*, a1, b1, a2, b2 FROM b LEFT JOIN c USING (image_id) WHERE a1 IS NULL OR ((x1 + x2) / 2 > a1 AND (y1 + y2) / 2 > b1 AND (x1 + x2) / 2 < a2 AND (y1 + y2) / 2 < b2))
SELECT event_id, CASE WHEN a1 IS NULL THEN x1 ELSE greatest(x1 - a1, 0) END AS x1, CASE WHEN a1 IS NULL THEN y2 ELSE least(y2 - b1, b2 - b1) END AS y2, CAST(coalesce(a2 - a1, width) AS INTEGER) AS width, CAST(coalesce(b2 - b1, height) AS INTEGER) AS height FROM y""")
def iou_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.iou_crop(_boxes(spark, sf_dir), seed=3).select("event_id", "x1", "y2", "width", "height")


@query("caption_labels", f""", c AS (SELECT i AS label, 'class ' || i AS name, i + 2 AS tokens FROM range(9) t(i)), own AS (SELECT DISTINCT image_id, label FROM box), im AS (SELECT DISTINCT image_id, CASE WHEN {draw_sql(5, 'image_id')} < 0.5 THEN 6 ELSE floor({draw_sql(6, 'image_id')} * 6) + 1 END AS n FROM own),
x AS (SELECT im.*, c.*, EXISTS (SELECT 1 FROM own WHERE own.image_id = im.image_id AND own.label = c.label) AS has, {draw_sql(7, 'image_id', 'label')} AS u, row_number() OVER (PARTITION BY image_id ORDER BY {draw_sql(8, 'image_id', 'label')}, label) AS r FROM im, c),
p AS (SELECT *, sum(tokens) OVER (PARTITION BY image_id ORDER BY u, label) AS used FROM x WHERE has), l AS (SELECT image_id, coalesce(min(used) FILTER (used > 12), max(used)) AS used FROM p GROUP BY 1),
n AS (SELECT *, sum(tokens) OVER (PARTITION BY image_id ORDER BY r) AS used FROM x WHERE NOT has AND r <= n), a AS (SELECT image_id, 0 AS part, row_number() OVER (PARTITION BY image_id ORDER BY u, label) AS k, name FROM p WHERE used <= 12 UNION ALL SELECT n.image_id, 1, r, name FROM n JOIN l USING (image_id) WHERE n.used < 12 - l.used)
SELECT im.image_id, coalesce((SELECT string_agg(name, '. ' ORDER BY part, k) FROM a WHERE a.image_id = im.image_id), '') || '.' AS caption FROM im""")
def caption_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = spark.range(9).select(F.col("id").alias("label"), F.concat(F.lit("class "), F.col("id")).alias("name"), (F.col("id") + 2).alias("tokens"))
    return PP.caption_labels(views.boxes(spark, sf_dir), classes, 12, 6, 0.5, seed=5).select("image_id", "caption")


@query("packed_inputs", """, i AS (SELECT DISTINCT image_id FROM box)
SELECT image_id, coalesce(string_agg(label, ',' ORDER BY gt_id) FILTER (ignored = 0), '') AS gt, count(*) FILTER (ignored = 1) AS n_ignored, CAST(300 + image_id % 41 AS BIGINT) AS width FROM i LEFT JOIN gt USING (image_id) GROUP BY image_id""")
def packed_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = PP.packed(_images(spark, sf_dir), views.ground_truth(spark, sf_dir))
    labels = F.transform("gt_instances", lambda v: v["label"].cast("string"))
    return x.select("image_id", F.array_join(labels, ",").alias("gt"), F.size("ignored_instances").cast("long").alias("n_ignored"), F.col("metainfo.width").cast("long").alias("width"))


@query("mixup", _NUMBERED + f""", c AS (SELECT image_id, count(*) AS n FROM box GROUP BY 1), a AS (SELECT image_id, floor({draw_sql(0, 'image_id', '1')} * total) AS at FROM num)
SELECT a.image_id, c.n + p.n AS n, p.n AS mixed FROM a JOIN num o ON o.i = a.at JOIN c ON c.image_id = a.image_id JOIN c p ON p.image_id = o.image_id""")
def mixup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.mixup(views.boxes(spark, sf_dir), _images(spark, sf_dir)).groupBy("image_id").agg(F.count("*").alias("n"), F.sum("mixed").alias("mixed"))


@query("affine", """, c AS (SELECT event_id, unnest([[x1, y1], [x2, y1], [x2, y2], [x1, y2]]) AS p FROM box), q AS (SELECT event_id, 0.8 * p[1] - 0.2 * p[2] + 12 AS x, 0.2 * p[1] + 0.8 * p[2] - 7 AS y FROM c),
m AS (SELECT event_id, min(x) AS x1, min(y) AS y1, max(x) AS x2, max(y) AS y2 FROM q GROUP BY 1)
SELECT event_id, round(least(greatest(x1, 0), 200), 6) AS x1, round(least(greatest(y1, 0), 150), 6) AS y1, round(least(greatest(x2, 0), 200), 6) AS x2, round(least(greatest(y2, 0), 150), 6) AS y2 FROM m WHERE x1 < 200 AND x2 > 0 AND y1 < 150 AND y2 > 0""")
def affine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.affine(views.boxes(spark, sf_dir), [[0.8, -0.2, 12], [0.2, 0.8, -7], [0, 0, 1]], 200, 150).select("event_id", *[F.round(c, 6).alias(c) for c in ("x1", "y1", "x2", "y2")])


@query("clean_names", r"""SELECT c_custkey, lower(replace(replace(regexp_replace(c_mktsegment || '_(x) y_' || c_name || ' (z)', '\(.*\)', ''), '_', ' '), '  ', ' ')) AS name FROM customer""", with_views=False)
def clean_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = views.table(spark, sf_dir, "customer")
    return c.select("c_custkey", TX.clean_name(F.concat("c_mktsegment", F.lit("_(x) y_"), "c_name", F.lit(" (z)"))).alias("name"))


@query("caption_spans", """, n AS (SELECT image_id, list(DISTINCT 'class ' || label ORDER BY 'class ' || label) AS names FROM box GROUP BY image_id), u AS (SELECT image_id, array_to_string(names, '. ') || '.' AS caption, unnest(names) AS name FROM n)
SELECT image_id, caption, name, strpos(caption, name) - 1 AS "start", strpos(caption, name) - 1 + length(name) AS "end" FROM u""")
def caption_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = views.boxes(spark, sf_dir).groupBy("image_id").agg(F.array_sort(F.collect_set(F.concat(F.lit("class "), "label"))).alias("names"))
    x = n.select("image_id", TX.caption_of(F.col("names")).alias("caption"), F.explode(F.arrays_zip("names", TX.caption_spans(F.col("names")).alias("spans"))).alias("z"))
    return x.select("image_id", "caption", F.col("z.names").alias("name"), F.get("z.spans", F.lit(0)).cast("long").alias("start"), F.get("z.spans", F.lit(1)).cast("long").alias("end"))


@query("word_buckets", """SELECT CASE WHEN n <= 3 THEN '0-3' WHEN n <= 6 THEN '4-6' WHEN n <= 9 THEN '7-9' ELSE '10+' END AS bucket, count(*) AS n_texts FROM (SELECT len(string_split(text, ' ')) AS n FROM conversations) GROUP BY 1""", with_views=False)
def word_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "conversations").groupBy(TX.word_bucket(F.col("text")).alias("bucket")).agg(F.count("*").alias("n_texts"))


@query("union_sources", "SELECT 'orders' AS source_id, o_orderkey AS row_id, o_custkey AS c_custkey FROM orders UNION ALL SELECT 'customer', c_custkey, c_custkey FROM customer", with_views=False)
def union_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = views.table(spark, sf_dir, "orders").select(F.lit("orders").alias("source_id"), F.col("o_orderkey").alias("row_id"), F.col("o_custkey").alias("c_custkey"))
    return o.unionByName(views.table(spark, sf_dir, "customer").select(F.lit("customer").alias("source_id"), F.col("c_custkey").alias("row_id"), "c_custkey"))


@query("class_hierarchy", """WITH RECURSIVE e AS (SELECT n_nationkey AS child, CASE WHEN n_nationkey > 0 THEN CAST(floor(n_nationkey / 2) AS INTEGER) END AS parent FROM nation),
up(child, ancestor) AS (SELECT n_nationkey, n_nationkey FROM nation UNION ALL SELECT up.child, e.parent FROM up JOIN e ON up.ancestor = e.child WHERE e.parent IS NOT NULL) SELECT DISTINCT child, ancestor FROM up""", with_views=False)
def class_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    parent = F.when(F.col("n_nationkey") > 0, F.floor(F.col("n_nationkey") / 2)).cast("int")  # the first nation is the root
    e = views.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("child"), parent.alias("parent"))
    return N.ancestors(e)


@query("coco_result_rows", " SELECT image_id, det_id, x1 AS x, y1 AS y, x2 - x1 AS w, y2 - y1 AS h, score, label AS category_id FROM det")
def coco_result_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = N.coco_rows(views.detections(spark, sf_dir), keep=["det_id"])
    return r.select("image_id", "det_id", *[F.get("bbox", F.lit(i)).alias(n) for i, n in enumerate("xywh")], "score", "category_id")


@query("coco_annotation_ids", " SELECT gt_id, row_number() OVER (ORDER BY image_id, gt_id) AS id, (x2 - x1) * (y2 - y1) AS area FROM gt")
def coco_annotation_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    gt = views.ground_truth(spark, sf_dir)
    a = N.coco_annotations(gt).select("id", "image_id", "area")
    from pyspark.sql.window import Window

    i = gt.select("gt_id", "image_id", F.row_number().over(Window.partitionBy("image_id").orderBy("gt_id")).alias("r"))
    a = a.withColumn("r", F.row_number().over(Window.partitionBy("image_id").orderBy("id")))
    return a.join(i, ["image_id", "r"]).select("gt_id", "id", "area")


def _policy_sql(choice: str, steps: int, seed: int) -> str:
    """Boxes folded over ``steps`` steps; ``choice``: common table expressions up to ``s`` (image_id, i, kind, probability, level)."""
    most = "CASE kind " + " ".join(f"WHEN '{k}' THEN {m}::DOUBLE" for k, m in PL.GREATEST.items()) + " ELSE 0 END"
    u = lambda k: draw_sql(seed + k, "image_id", "i")
    out = [choice, f"m AS (SELECT image_id, i, kind, {u(1)} <= probability AS taken, round(coalesce(level / 10, {u(2)}) * {most}, 1) * CASE WHEN {u(3)} > 0.5 THEN -1 ELSE 1 END AS m FROM s)", "f0 AS (SELECT b.event_id, b.image_id, b.width, b.height, b.x1, b.y1, b.x2, b.y2, '' AS steps FROM b)"]
    for i in range(steps):
        t, c, z = "tan(radians(m))", "cos(radians(m))", "sin(radians(m))"
        turn = [(f"((width - 1) * 0.5 + ({x} - (width - 1) * 0.5) * {c} - ({y} - (height - 1) * 0.5) * {z})", f"((height - 1) * 0.5 + ({x} - (width - 1) * 0.5) * {z} + ({y} - (height - 1) * 0.5) * {c})") for x in ("x1", "x2") for y in ("y1", "y2")]
        new = {}
        for side, pick in ((1, "least"), (2, "greatest")):
            x, y = f"x{side}", f"y{side}"
            new[x] = f"CASE kind WHEN 'ShearX' THEN {x} + {pick}({t} * y1, {t} * y2) WHEN 'Rotate' THEN {pick}({', '.join(p for p, _ in turn)}) WHEN 'TranslateX' THEN {x} + trunc(width * m) ELSE {x} END"
            new[y] = f"CASE kind WHEN 'ShearY' THEN {y} + {pick}({t} * x1, {t} * x2) WHEN 'Rotate' THEN {pick}({', '.join(q for _, q in turn)}) WHEN 'TranslateY' THEN {y} + trunc(height * m) ELSE {y} END"
        moved = ", ".join(f"CASE WHEN kind IN ({', '.join(repr(k) for k in PL.GREATEST)}) THEN least(greatest({v}, 0), {'width' if n[0] == 'x' else 'height'}) ELSE {n} END AS {n}" for n, v in new.items())
        out.append(f"f{i + 1} AS (SELECT event_id, f.image_id, width, height, {moved}, CASE WHEN kind IS NULL THEN steps ELSE steps || kind || ',' END AS steps FROM f{i} f LEFT JOIN m ON m.image_id = f.image_id AND m.i = {i} AND taken)")
    return ", ".join(out) + f" SELECT event_id, steps, round(x1, 4) AS x1, round(y1, 4) AS y1, round(x2, 4) AS x2, round(y2, 4) AS y2 FROM f{steps}"


def _policy_rows(x: DataFrame) -> DataFrame:
    names = F.aggregate("steps", F.lit(""), lambda s, v: F.concat(s, v["kind"], F.lit(",")))
    return x.select("event_id", names.alias("steps"), *[F.round(c, 4).alias(c) for c in ("x1", "y1", "x2", "y2")])


_LEARNED = ", ".join(f"({p}, {i}, '{k}', {q}, {v})" for p, steps in enumerate(PL.LEARNED) for i, (k, q, v) in enumerate(steps))
_SPACE = ", ".join(f"({i}, '{k}')" for i, k in enumerate(PL.SPACE))


@query("auto_augment", _IMG + _policy_sql(f", pol AS (SELECT * FROM (VALUES {_LEARNED}) v(p, i, kind, probability, level)), s AS (SELECT image_id, i, kind, probability, CAST(level AS DOUBLE) AS level FROM img JOIN pol ON p = floor({draw_sql(11, 'image_id')} * {len(PL.LEARNED)}))", 2, 11))
def auto_augment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _policy_rows(PL.auto_augment(_boxes(spark, sf_dir), seed=11))


@query("rand_augment", _IMG + _policy_sql(f", sp AS (SELECT * FROM (VALUES {_SPACE}) v(k, kind)), s AS (SELECT image_id, row_number() OVER (PARTITION BY image_id ORDER BY {draw_sql(12, 'image_id', 'k')}, k) - 1 AS i, kind, 1.0::DOUBLE AS probability, NULL::DOUBLE AS level FROM img, sp QUALIFY i < 3)", 3, 12))
def rand_augment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _policy_rows(PL.rand_augment(_boxes(spark, sf_dir), count=3, seed=12))


@query("grounded_phrases", """WITH t AS (SELECT doc_id, text, unnest(string_split(text, ' ')) AS word, generate_subscripts(string_split(text, ' '), 1) - 1 AS pos FROM documents), w AS (SELECT *, sum(length(word) + 1) OVER (PARTITION BY doc_id ORDER BY pos) - length(word) - 1 AS start FROM t),
a AS (SELECT doc_id, pos // 8 AS ann_id, word, start, start + length(word) AS stop FROM w WHERE word <> '' AND pos % 8 NOT IN (2, 6)), f AS (SELECT *, CASE WHEN lag(stop) OVER o + 1 = start THEN 0 ELSE 1 END AS begins FROM a WINDOW o AS (PARTITION BY doc_id, ann_id ORDER BY start)),
g AS (SELECT *, sum(begins) OVER (PARTITION BY doc_id, ann_id ORDER BY start) AS g FROM f), h AS (SELECT doc_id, ann_id, g, string_agg(word, ' ' ORDER BY start) AS phrase, min(start) AS start FROM g GROUP BY ALL),
k AS (SELECT doc_id, ann_id, string_agg(phrase, ' ' ORDER BY start) AS key, count(*) AS n, min(start) AS start FROM h GROUP BY ALL), b AS (SELECT *, (ann_id * 13) % 120 - 5 AS x, (ann_id * 7) % 90 - 5 AS y, (ann_id % 6) * 4 AS bw, (ann_id % 5) * 4 AS bh FROM k)
SELECT doc_id AS image_id, key, first(n ORDER BY ann_id) AS n_phrases, CAST(first(start ORDER BY ann_id) AS BIGINT) AS start, count(*) AS n_boxes, CAST(sum(least(x + bw, 100)) AS DOUBLE) AS right_edges FROM b
WHERE bw >= 1 AND bh >= 1 AND least(x + bw, 100) > greatest(x, 0) AND least(y + bh, 80) > greatest(y, 0) GROUP BY doc_id, key""", with_views=False)
def grounded_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captions are whole documents; an annotation has six of each eight words as spans."""
    from pyspark.sql.window import Window

    d = views.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("image_id"), F.col("text").alias("caption"))
    w = d.select("image_id", F.posexplode(F.split("caption", " ", -1)).alias("pos", "word"))
    start = F.sum(F.length("word") + 1).over(Window.partitionBy("image_id").orderBy("pos")) - F.length("word") - 1
    w = w.withColumn("start", start.cast("int")).where("word <> '' AND pos % 8 NOT IN (2, 6)")
    n = F.expr("pos div 8")
    a = w.groupBy("image_id", n.alias("ann_id")).agg(F.collect_list(F.array("start", F.col("start") + F.length("word"))).alias("tokens_positive"))
    a = a.withColumn("bbox", F.expr("array((ann_id * 13) % 120 - 5, (ann_id * 7) % 90 - 5, (ann_id % 6) * 4, (ann_id % 5) * 4)").cast("array<double>")).withColumn("crowd", F.lit(0)).withColumn("area", F.lit(1.0))
    x = CV.grounded(a, d.withColumns({"width": F.lit(100), "height": F.lit(80)}))
    return x.select("image_id", "key", F.size("phrase").cast("long").alias("n_phrases"), F.expr("cast(tokens_positive[0][0] as bigint)").alias("start"), F.size("boxes").cast("long").alias("n_boxes"), F.aggregate("boxes", F.lit(0.0), lambda s, b: s + b[2]).alias("right_edges"))


@query("image_sizes", " SELECT event_id, CASE WHEN event_id % 5 < 4 THEN CAST(300 + event_id % 41 AS INTEGER) END AS width, CASE WHEN event_id % 5 < 4 THEN CAST(220 + event_id % 37 AS INTEGER) END AS height FROM box")
def image_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers of PNG, JPEG (plain and turned) and GIF files, and files that break off, written in place."""
    w, h = 300 + F.col("event_id") % 41, 220 + F.col("event_id") % 37
    wide = lambda v, digits: F.lpad(F.hex(v), digits, "0")
    little = lambda v: F.concat(F.substring(wide(v, 4), 3, 2), F.substring(wide(v, 4), 1, 2))
    exif = "FFE1001E" + "457869660000" + "4D4D002A00000008" + "0001" + "011200030000000100060000" + "0000"
    frame = lambda a, b: F.concat(F.lit("FFC0001108"), wide(b, 4), wide(a, 4), F.lit("03012200021101031101"))
    forms = [
        F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), wide(w, 8), wide(h, 8), F.lit("0806000000")),
        F.concat(F.lit("FFD8FFE00010" + "00" * 14), frame(w, h)),
        F.concat(F.lit("FFD8" + exif), frame(h, w)),
        F.concat(F.lit("474946383961"), little(w), little(h)),
        F.lit("FFD8FFE00010"),
    ]
    content = F.unhex(F.get(F.array(*forms), (F.col("event_id") % 5).cast("int")))
    return IM.with_sizes(views.boxes(spark, sf_dir).select("event_id", content.alias("content")))


def _border_sql(size: str) -> str:
    return f"floor(60 / pow(2.0::DOUBLE, ceil(log2(ceil(120.0::DOUBLE / {size}))) + CASE WHEN 120.0::DOUBLE / {size} = floor(120.0::DOUBLE / {size}) THEN 1 ELSE 0 END))"


@query("centre_crop_pad", _IMG + f""", t AS (SELECT img.*, k, [0.3::DOUBLE, 0.4::DOUBLE, 0.6::DOUBLE][CAST(floor({draw_sql(21, 'image_id', '(k // 3)')} * 3) AS BIGINT) + 1] AS r, {_border_sql('width')} AS bw, {_border_sql('height')} AS bh FROM img, range(12) v(k)),
a AS (SELECT *, CAST(trunc(200 * r) AS BIGINT) AS nw, CAST(trunc(160 * r) AS BIGINT) AS nh, CAST(bw + floor({draw_sql(22, 'image_id', 'k')} * (width - 2 * bw)) AS BIGINT) AS px, CAST(bh + floor({draw_sql(23, 'image_id', 'k')} * (height - 2 * bh)) AS BIGINT) AS py FROM t),
s AS (SELECT b.event_id, b.image_id, b.x1, b.y1, b.x2, b.y2, a.k, a.nw, a.nh, a.px, a.py, (b.x1 + b.x2) / 2 > greatest(0, px - nw // 2) AND (b.x1 + b.x2) / 2 < least(px + nw // 2, a.width) AND (b.y1 + b.y2) / 2 > greatest(0, py - nh // 2) AND (b.y1 + b.y2) / 2 < least(py + nh // 2, a.height) AS shown FROM b JOIN a USING (image_id)),
f AS (SELECT image_id, min(k) AS k FROM s WHERE shown GROUP BY 1), m AS (SELECT event_id, least(greatest(x1 + nw // 2 - px, 0), nw) AS x1, least(greatest(y1 + nh // 2 - py, 0), nh) AS y1, least(greatest(x2 + nw // 2 - px, 0), nw) AS x2, least(greatest(y2 + nh // 2 - py, 0), nh) AS y2, nw AS width, nh AS height FROM s JOIN f USING (image_id, k) WHERE shown
  UNION ALL SELECT event_id, x1, y1, x2, y2, CAST(width AS BIGINT), CAST(height AS BIGINT) FROM b WHERE image_id NOT IN (SELECT image_id FROM f)) SELECT * FROM m WHERE x1 < width AND y1 < height AND x2 > 0 AND y2 > 0""")
def centre_crop_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = R.centre_crop_pad(views.boxes(spark, sf_dir), _images(spark, sf_dir), (200, 160), (0.3, 0.4, 0.6), border=60, tries=3, rounds=4, seed=21)
    return x.select("event_id", "x1", "y1", "x2", "y2", "width", "height")


@query("centre_pad", _IMG + " SELECT event_id, x1 + (width | 127) // 2 - width // 2 AS x1, y2 + (height | 127) // 2 - height // 2 AS y2, CAST(width | 127 AS BIGINT) AS width, CAST(height | 127 AS BIGINT) AS height FROM b")
def centre_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.centre_pad(_boxes(spark, sf_dir)).select("event_id", "x1", "y2", "width", "height")
