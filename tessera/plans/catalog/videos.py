"""Tracks, masks, analysis and conversions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ...functions import masks as MK
from ...operators import summary as Y
from ...operators import trackers as TT
from ...operators import tracking as T
from ...operators.sampling import draw_sql
from .. import analyze as AN
from .. import convert as CV
from .. import views
from .registry import query

_TR = """, e AS (SELECT event_id, user_id AS video_id, event_id % 3 AS track_id, event_id // 500 * 4 + (event_id * 7) % 4 AS frame_id FROM events),
tr AS (SELECT video_id, track_id, frame_id, CAST(min(event_id) % 300 AS DOUBLE) AS x1, CAST(min(event_id) % 200 AS DOUBLE) AS y1, CAST(min(event_id) % 300 + 50 AS DOUBLE) AS x2, CAST(min(event_id) % 200 + 80 AS DOUBLE) AS y2, 0.9 AS score FROM e GROUP BY ALL)"""


def _tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = views.table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("video_id"), F.expr("event_id % 3").alias("track_id"), F.expr("event_id div 500 * 4 + (event_id * 7) % 4").alias("frame_id"))
    m = F.min("event_id")
    return e.groupBy("video_id", "track_id", "frame_id").agg((m % 300).cast("double").alias("x1"), (m % 200).cast("double").alias("y1"), (m % 300 + 50).cast("double").alias("x2"), (m % 200 + 80).cast("double").alias("y2"), F.lit(0.9).alias("score"))


@query("interpolate_tracks", _TR + """, n AS (SELECT *, count(*) OVER (PARTITION BY video_id, track_id) AS n, lead(frame_id) OVER w AS nf, lead(x1) OVER w AS nx1, lead(y1) OVER w AS ny1, lead(x2) OVER w AS nx2, lead(y2) OVER w AS ny2 FROM tr WINDOW w AS (PARTITION BY video_id, track_id ORDER BY frame_id)),
g AS (SELECT *, unnest(range(frame_id + 1, nf)) AS f FROM n WHERE n > 5 AND nf - frame_id > 1 AND nf - frame_id < 20)
SELECT video_id, track_id, frame_id, round(x1, 6) AS x1, round(y1, 6) AS y1, round(x2, 6) AS x2, round(y2, 6) AS y2, CAST(score AS DOUBLE) AS score, 0 AS filled FROM n WHERE n > 2
UNION ALL SELECT video_id, track_id, f, round(x1 + (nx1 - x1) * (f - frame_id) / (nf - frame_id), 6), round(y1 + (ny1 - y1) * (f - frame_id) / (nf - frame_id), 6), round(x2 + (nx2 - x2) * (f - frame_id) / (nf - frame_id), 6), round(y2 + (ny2 - y2) * (f - frame_id) / (nf - frame_id), 6), 1.0, 1 FROM g""")
def interpolate_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = T.interpolate(_tracks(spark, sf_dir))
    return x.select("video_id", "track_id", "frame_id", *[F.round(c, 6).alias(c) for c in T.CORNERS], "score", "filled")


@query("link_tracks", _TR + """, b AS (SELECT video_id, track_id, min(frame_id) AS sf, max(frame_id) AS ef, arg_min((x1 + x2) / 2, frame_id) AS sx, arg_min((y1 + y2) / 2, frame_id) AS sy, arg_max((x1 + x2) / 2, frame_id) AS ex, arg_max((y1 + y2) / 2, frame_id) AS ey FROM (SELECT video_id, track_id * 1000 + frame_id // 30 AS track_id, frame_id, x1, y1, x2, y2 FROM tr) GROUP BY ALL)
SELECT a.video_id, a.track_id AS first, c.track_id AS second, c.sf - a.ef AS gap, round(sqrt((c.sx - a.ex) ** 2 + (c.sy - a.ey) ** 2), 6) AS distance FROM b a JOIN b c ON a.video_id = c.video_id AND a.track_id <> c.track_id WHERE c.sf - a.ef > 0 AND c.sf - a.ef < 60 AND sqrt((c.sx - a.ex) ** 2 + (c.sy - a.ey) ** 2) < 150""")
def link_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _tracks(spark, sf_dir).withColumn("track_id", F.expr("track_id * 1000 + frame_id div 30"))  # tracks that break off
    return T.link_candidates(t, (0, 60), 150).withColumn("distance", F.round("distance", 6))


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = views.boxes(spark, sf_dir)
    return b.select(F.expr("image_id % 20").alias("video_id"), F.expr("event_id div 200").alias("frame_id"), F.col("event_id").alias("det_id"), F.lit(0).cast("long").alias("label"), F.expr("0.5 + score / 2").alias("score"), *T.CORNERS)


@query("track_videos")
def track_videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.track(_frames(spark, sf_dir)).select("video_id", "frame_id", "det_id", "track_id")


def _looks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames with an appearance vector each: detections take the vectors in turn, by their object."""
    e = views.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("object"), "embedding")
    many = e.agg(F.count("*").alias("n"))
    f = _frames(spark, sf_dir).crossJoin(F.broadcast(many))  # one row
    return f.withColumn("object", F.expr("(video_id * 7 + det_id % 6) % n")).join(e, "object").drop("object", "n")


_IDS = ("video_id", "frame_id", "det_id", "track_id")


@query("track_by_observations")
def track_by_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TT.walk_together(_frames(spark, sf_dir), TT.ObservationTracker()).select(*_IDS)


@query("track_by_appearance")
def track_by_appearance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TT.walk(_looks(spark, sf_dir), lambda _: TT.AppearanceTracker()).select(*_IDS)


@query("track_by_motion")
def track_by_motion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TT.walk(_looks(spark, sf_dir), lambda _: TT.AppearanceTracker.plain()).select(*_IDS)


@query("track_by_similarity")
def track_by_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TT.walk(_looks(spark, sf_dir), lambda _: TT.SimilarityTracker()).select(*_IDS)


@query("track_by_weights")
def track_by_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TT.walk(_looks(spark, sf_dir), lambda _: TT.WeightedTracker()).select(*_IDS)


@query("tracker_search")
def tracker_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _frames(spark, sf_dir)
    gt = f.withColumn("track_id", F.col("det_id") % 7).dropDuplicates(["video_id", "frame_id", "track_id"])
    settings = {f"start {s} match {m}": (lambda s=s, m=m: TT.ObservationTracker(start=s, match=m)) for s in (0.6, 0.8) for m in (0.1, 0.3)}
    x = TT.search(f, gt, settings)
    return x.select("setting", "tp", "fp", "fn", "switches", "idtp", F.round("mota", 6).alias("mota"), F.round("idf1", 6).alias("idf1"), "place")


@query("tracking_scores")
def tracking_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _frames(spark, sf_dir)
    gt = f.withColumn("track_id", F.col("det_id") % 7).dropDuplicates(["video_id", "frame_id", "track_id"])
    pred = T.track(f).where("track_id >= 0")
    return T.tracking_scores(pred, gt).select("tp", "fp", "fn", "switches", "idtp", F.round("mota", 6).alias("mota"), F.round("idf1", 6).alias("idf1"))


@query("higher_order_accuracy")
def higher_order_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _frames(spark, sf_dir)
    gt = f.withColumn("track_id", F.col("det_id") % 7).dropDuplicates(["video_id", "frame_id", "track_id"])
    x = T.higher_order_accuracy(T.track(f).where("track_id >= 0"), gt)
    return x.select(*[F.round(n, 6).alias(n) for n in x.columns])


@query("video_summary")
def video_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _tracks(spark, sf_dir).withColumn("label", F.col("track_id"))
    x = Y.video_summary(t.where("frame_id % 4 <> 3").withColumn("x2", F.col("x2") + F.col("video_id") % 7), t)
    return x.select(*[F.round(n, 9).alias(n) for n in x.columns])


_UNIT = "SELECT vec_id, [v / sqrt(list_dot_product(e, e)) FOR v IN e] AS u FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)"


@query("embedding_similarity", f"""WITH n AS ({_UNIT}), p AS (SELECT a.vec_id AS a_id, b.vec_id AS b_id, round(list_dot_product(a.u, b.u), 6) AS cosine FROM n a JOIN n b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id)
SELECT a_id, count(*) AS n, max(cosine) AS most, round(sum(cosine), 3) AS total FROM p GROUP BY a_id""", with_views=False)
def embedding_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set: ids divisible by 100, against all rows."""
    e = views.table(spark, sf_dir, "embeddings")
    x = T.similarities(e.where("vec_id % 100 = 0"), e).where("a_id <> b_id").withColumn("cosine", F.round("cosine", 6))
    return x.groupBy("a_id").agg(F.count("*").alias("n"), F.max("cosine").alias("most"), F.round(F.sum("cosine"), 3).alias("total"))


@query("polygon_areas", """ SELECT event_id,
  abs(x1 * y1 - x2 * y1 + x2 * (y2 + 5) - x2 * y1 + x2 * y2 - (x1 + 9) * (y2 + 5) + (x1 + 9) * y1 - x1 * y2) / 2 AS area, x1 AS bx1, y2 + 5 AS by2 FROM box""")
def polygon_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = views.boxes(spark, sf_dir).withColumn("p", F.expr("array(x1, y1, x2, y1, x2, y2 + 5, x1 + 9, y2)"))
    box = MK.polygons_box(F.array("p"))
    return b.select("event_id", MK.polygon_area(F.col("p")).alias("area"), box["x1"].alias("bx1"), box["y2"].alias("by2"))


@query("run_length_areas", " SELECT event_id, (event_id % 7 + 1) + (event_id % 3) AS area FROM box")
def run_length_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = views.boxes(spark, sf_dir)
    runs = F.array(F.col("event_id") % 5, F.col("event_id") % 7 + 1, F.lit(4).cast("long"), F.col("event_id") % 3)
    return b.select("event_id", MK.run_area(runs).alias("area"))


@query("epoch_times", """SELECT arg_max(epoch, t) AS slowest, round(max(t), 9) AS slowest_time, arg_min(epoch, t) AS fastest, round(min(t), 9) AS fastest_time, round(avg(t), 9) AS mean_time, round(stddev_pop(t), 9) AS std_time
FROM (SELECT user_id AS epoch, avg(value) AS t FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events) WHERE i > 1 GROUP BY user_id)""", with_views=False)
def epoch_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = views.table(spark, sf_dir, "events").select(F.col("user_id").alias("epoch"), F.col("event_id").alias("step"), F.col("value").alias("time"))
    x = AN.epoch_times(e)
    return x.select("slowest", "fastest", *[F.round(c, 9).alias(c) for c in ("slowest_time", "fastest_time", "mean_time", "std_time")])


@query("image_scores")
def image_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return AN.best_and_worst(AN.image_scores(views.detections(spark, sf_dir), views.ground_truth(spark, sf_dir)), 20).withColumn("score", F.round("score", 9))


@query("area_groups", """, a AS (SELECT (x2 - x1) * (y2 - y1) AS a FROM gt WHERE ignored = 0), p AS (SELECT 'all' AS part FROM a UNION ALL SELECT CASE WHEN a < 7500 THEN 'small' WHEN a < 9216 THEN 'medium' ELSE 'large' END FROM a) SELECT part, count(*) AS n FROM p GROUP BY part""")
def area_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return AN.area_groups(views.ground_truth(spark, sf_dir), (0, 7500, 9216, 1e10))


@query("area_histogram", """, v AS (SELECT sqrt((x2 - x1) * (y2 - y1)) AS v FROM gt), e AS (SELECT min(v) AS lo, max(v) AS hi FROM v) SELECT CAST(least(floor((v - lo) / (hi - lo) * 100), 99) AS INTEGER) AS bin, count(*) AS n FROM v, e GROUP BY 1""")
def area_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return AN.area_histogram(views.ground_truth(spark, sf_dir))


@query("error_steps")
def error_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = spark.range(5).select(F.col("id").alias("label"), (F.col("id") % 2).alias("family"))
    return AN.error_steps(views.detections(spark, sf_dir), views.ground_truth(spark, sf_dir), groups).withColumn("ap", F.round("ap", 9))


@query("cluster_sizes")
def cluster_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return AN.cluster_sizes(views.boxes(spark, sf_dir), 5).select("cluster", F.round("width", 6).alias("width"), F.round("height", 6).alias("height"))


@query("split_share", f" SELECT DISTINCT image_id, {draw_sql(1, 'image_id')} < 0.3 AS labelled FROM box")
def split_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return CV.split_share(views.boxes(spark, sf_dir).select("image_id").distinct(), 30, fold=1)


@query("without_ids", " SELECT DISTINCT image_id FROM det EXCEPT SELECT image_id FROM gt WHERE label = 3 AND ignored = 1")
def without_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return CV.without(views.detections(spark, sf_dir), views.ground_truth(spark, sf_dir).where("label = 3 AND ignored = 1"))


@query("mot_to_video", _TR + """, m AS (SELECT *, max(frame_id) OVER (PARTITION BY video_id) AS mx FROM tr), h AS (SELECT * FROM m WHERE frame_id <= floor(mx / 2.0) + 1),
f AS (SELECT video_id, track_id, min(frame_id) AS f FROM h GROUP BY ALL), s AS (SELECT video_id, track_id, row_number() OVER (ORDER BY video_id, f, track_id) - 1 AS global_id FROM f)
SELECT h.video_id, h.track_id AS instance_id, h.frame_id - 1 AS frame_id, global_id FROM h JOIN s ON s.video_id = h.video_id AND s.track_id = h.track_id""")
def mot_to_video(spark: SparkSession, sf_dir: str) -> DataFrame:
    return CV.mot_to_video(_tracks(spark, sf_dir).withColumnRenamed("track_id", "instance_id"), "first").select("video_id", "instance_id", "frame_id", "global_id")


@query("phrase_groups", " SELECT image_id, label AS phrase, count(*) AS n FROM gt GROUP BY ALL")
def phrase_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return CV.phrase_groups(views.ground_truth(spark, sf_dir).withColumnRenamed("label", "phrase")).select("image_id", "phrase", F.size("boxes").cast("long").alias("n"))
