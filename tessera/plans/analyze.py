"""Offline analysis of logs, results and annotations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.boxes import Box
from ..operators import matching as M


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """JSON-lines logs as (file, line, epoch, step, metric, value); metric names with ``/`` are validation values."""
    x = spark.read.text(path).select(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("line"), F.from_json("value", "map<string,string>").alias("m"))
    x = x.select("file", "line", F.try_element_at("m", F.lit("epoch")).cast("int").alias("epoch"), F.try_element_at("m", F.lit("step")).cast("int").alias("step"), F.explode("m").alias("metric", "v"))
    return x.select("file", "line", "epoch", "step", "metric", F.expr("try_cast(v AS double)").alias("value"), F.contains("metric", F.lit("/")).alias("validation")).where("value is not null and metric not in ('epoch', 'step')")


def epoch_times(times: DataFrame, with_first: bool = False) -> DataFrame:
    """One row: slowest, fastest epoch, their mean times, mean and deviation. ``times``: epoch, step, time."""
    x = times.withColumn("_i", F.row_number().over(Window.partitionBy("epoch").orderBy("step")))
    x = x if with_first else x.where("_i > 1")
    e = x.groupBy("epoch").agg(F.avg("time").alias("t"))
    return e.agg(F.max_by("epoch", "t").alias("slowest"), F.max("t").alias("slowest_time"), F.min_by("epoch", "t").alias("fastest"), F.min("t").alias("fastest_time"), F.avg("t").alias("mean_time"), F.stddev_pop("t").alias("std_time"))


def image_scores(det: DataFrame, gt: DataFrame, threshold: float = 0.5) -> DataFrame:
    """image_id, score: mean average precision of each image on its own."""
    m = M.match_default(det, gt, threshold)
    counts = gt.groupBy("image_id", "label").agg(F.sum((F.col("ignored") == 0).cast("int")).alias("num_gts"))
    aps = M.average_precision(m, counts, ["image_id", "label"])
    return aps.where("num_gts > 0").groupBy("image_id").agg(F.avg("ap").alias("score"))


def best_and_worst(scores: DataFrame, n: int) -> DataFrame:
    """The ``n`` best and worst images: part, image_id, score."""
    best = scores.orderBy(F.desc("score"), "image_id").limit(n).select(F.lit("best").alias("part"), "image_id", "score")
    return best.unionByName(scores.orderBy("score", "image_id").limit(n).select(F.lit("worst").alias("part"), "image_id", "score"))


def area_groups(gt: DataFrame, edges: Sequence[float] = (0, 1024, 9216, 1e10), names: Sequence[str] = ("small", "medium", "large")) -> DataFrame:
    """part, n: ground truths that are not ignored, by area, and all."""
    a = Box.named().area
    part = F.lit(None).cast("string")
    for lo, hi, name in zip(edges[:-1], edges[1:], names, strict=True):
        part = F.when((a >= lo) & (a < hi), name).otherwise(part)
    x = gt.where("ignored = 0").select(F.explode(F.array(F.lit("all"), part)).alias("part"))
    return x.where("part is not null").groupBy("part").agg(F.count("*").alias("n"))


def area_histogram(gt: DataFrame, bins: int = 100) -> DataFrame:
    """bin, n: histogram of the square roots of areas between their least and largest."""
    x = gt.select(F.sqrt(Box.named().area).alias("v"))
    ends = x.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    lo, hi = ends.select("lo").scalar(), ends.select("hi").scalar()
    b = F.least(F.floor((F.col("v") - F.col("lo")) / F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-12)) * bins), F.lit(bins - 1))
    return x.withColumn("lo", lo).withColumn("hi", hi).groupBy(b.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def error_steps(det: DataFrame, gt: DataFrame, groups: DataFrame) -> DataFrame:
    """label, step, ap: AP at 0.75, 0.5, 0.1 (localisation forgiven), with similar classes' and then with any other
    ground truth forgiven, and without false positives on background. ``groups``: label, family."""
    order = ["C75", "C50", "Loc", "Sim", "Oth", "BG"]
    out = []
    for name, t in (("C75", 0.75), ("C50", 0.5), ("Loc", 0.1)):
        out.append(M.map_table(det, gt, t).select("label", F.lit(name).alias("step"), "ap"))
    counts = M.label_counts(gt, F.col("ignored") == 0)
    base = M.match_default(det, gt, 0.1)
    kin = groups.select("label", "family")
    near = M.pairs(det, gt, by_label=False).where("iou >= 0.1 and label <> gt_label").select("det_id", "label", "gt_label")
    near = near.join(kin, "label").join(kin.withColumnsRenamed({"label": "gt_label", "family": "gt_family"}), "gt_label")
    seen = near.groupBy("det_id").agg(F.max((F.col("family") == F.col("gt_family")).cast("int")).alias("kin"), F.lit(1).alias("other"))
    x = base.join(seen, "det_id", "left")
    forgive = {"Sim": F.coalesce("kin", F.lit(0)) == 1, "Oth": F.coalesce("other", F.lit(0)) == 1, "BG": F.lit(True)}
    for name, rule in forgive.items():
        out.append(M.average_precision(x.withColumn("fp", F.when(rule, 0).otherwise(F.col("fp"))).drop("kin", "other"), counts, ["label"]).select("label", F.lit(name).alias("step"), "ap"))
    table = out[0]
    for part in out[1:]:
        table = table.unionByName(part)
    return table.where(F.col("step").isin(order))


def cluster_sizes(boxes: DataFrame, k: int, rounds: int = 10) -> DataFrame:
    """cluster, width, height: k-means of box sizes with distance 1 - IoU, started from quantiles of the area.

    The k centres are the only state on the driver; a round is one aggregate of the boxes."""
    b = Box.named()
    x = boxes.select(b.width.alias("w"), b.height.alias("h"))
    marks = [(i + 0.5) / k for i in range(k)]
    q = x.agg(F.percentile_approx("w", marks, 10000).alias("w"), F.percentile_approx("h", marks, 10000).alias("h")).first()
    centres = list(zip(q["w"], q["h"], strict=True))
    for _ in range(rounds):
        sims = []
        for i, (cw, ch) in enumerate(centres):
            inter = F.least("w", F.lit(cw)) * F.least("h", F.lit(ch))
            sims.append(F.struct((inter / (F.col("w") * F.col("h") + cw * ch - inter)).alias("s"), F.lit(-i).alias("i")))
        rows = x.select((-F.greatest(*sims)["i"]).alias("c"), "w", "h").groupBy("c").agg(F.avg("w").alias("w"), F.avg("h").alias("h")).collect()
        new = list(centres)
        for r in rows:
            new[r["c"]] = (r["w"], r["h"])
        if new == centres:
            break
        centres = new
    return boxes.sparkSession.createDataFrame([(i, float(w), float(h)) for i, (w, h) in enumerate(sorted(centres, key=lambda c: c[0] * c[1]))], "cluster int, width double, height double")
