"""Rows as training inputs: nested instances, packed inputs, clips, branches, caption labels, triplets.

Groups are the boxes of one image or the frames of one video. Class tables are small by definition (one row a class) and
are read as one array, so an image meets all classes within its row.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .sampling import draw, draw_of

CORNERS = ("x1", "y1", "x2", "y2")


def instances(images: DataFrame, boxes: DataFrame, order: str = "gt_id", more: Sequence[str] = ()) -> DataFrame:
    """``images`` with arrays bboxes, labels, ignore_flags (and ``more`` columns) of their boxes in ``order``; images
    without boxes have empty ones."""
    fields = {"bboxes": F.array(*CORNERS), "labels": F.col("label"), "ignore_flags": F.col("ignored") == 1} | {c: F.col(c) for c in more}
    per = boxes.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), *[v.alias(k) for k, v in fields.items()]))).alias("_i"))
    x = images.join(per, "image_id", "left")
    each = lambda k: F.coalesce(F.transform("_i", lambda v: v[k]), F.array())
    return x.select(*images.columns, *[each(k).alias(k) for k in fields])


def packed(images: DataFrame, boxes: DataFrame, order: str = "gt_id", meta: Sequence[str] = ("image_id", "width", "height")) -> DataFrame:
    """image_id, gt_instances and ignored_instances (arrays of box and label), and ``meta`` as one struct."""
    x = instances(images, boxes, order)
    zipped = F.arrays_zip("bboxes", "labels", "ignore_flags")
    part = lambda ignored: F.transform(F.filter(zipped, lambda v: v["ignore_flags"] == ignored), lambda v: F.struct(v["bboxes"].alias("bbox"), v["labels"].alias("label")))
    return x.select("image_id", part(False).alias("gt_instances"), part(True).alias("ignored_instances"), F.struct(*meta).alias("metainfo"))


def clips(frames: DataFrame, refs: DataFrame | None = None, count: int | None = None, stride: int = 1) -> DataFrame:
    """Samples of frames (video_id, frame_id): video_id, key_frame, frames.

    With ``refs`` (video_id, frame_id, refs; see ``sampling.reference_frames``) a sample is a key frame with its
    references, in order. With ``count``, a video's frames in runs of ``count`` with steps of ``stride``. With neither, a
    sample is a video.
    """
    if refs is not None:
        return refs.select("video_id", F.col("frame_id").alias("key_frame"), F.array_sort(F.array_union(F.array("frame_id"), "refs")).alias("frames"))
    x = frames.select("video_id", "frame_id").withColumn("n", F.row_number().over(Window.partitionBy("video_id").orderBy("frame_id")) - 1)
    run = F.lit(0) if count is None else F.floor(F.col("n") / (count * stride)) * stride + F.col("n") % stride
    x = x.groupBy("video_id", run.alias("_run")).agg(F.sort_array(F.collect_list("frame_id")).alias("frames"))
    return x.select("video_id", F.get("frames", F.lit(0)).alias("key_frame"), "frames")


def branches(rows: DataFrame, views: Mapping[str, Column]) -> DataFrame:
    """``rows`` once for each view whose condition holds, with its name as ``branch``."""
    named = F.array(*[F.when(condition, F.lit(name)) for name, condition in views.items()])
    return rows.withColumn("branch", F.explode(F.filter(named, lambda v: v.isNotNull())))


def caption_labels(boxes: DataFrame, classes: DataFrame, most_tokens: int = 256, negatives: int = 85, full_share: float = 0.5, seed: int = 0) -> DataFrame:
    """image_id, caption, labels: classes named in an image's caption, in order; a box's new label is its place there.

    ``classes`` (label, name, tokens) is the class table. Present classes come first, in drawn order, while their tokens
    fit ``most_tokens``. Then some of up to ``negatives`` drawn classes that are not present: all of them for a drawn
    ``full_share`` of images, else a drawn number, while they leave room.
    """
    table = classes.agg(F.array_sort(F.collect_list(F.struct(F.col("label").cast("long").alias("label"), "name", F.col("tokens").cast("long").alias("tokens")))).alias("c"))  # a row for each class
    x = boxes.groupBy("image_id").agg(F.collect_set(F.col("label").cast("long")).alias("own")).withColumn("_c", table.scalar())
    shuffled = lambda k: F.transform(F.array_sort(F.transform("_c", lambda c: F.struct(draw_of(seed + k, F.col("image_id"), c["label"]).alias("u"), c.alias("c")))), lambda v: v["c"])
    full = F.least(F.lit(negatives), F.size("_c"))
    few = F.floor(draw(seed + 1, "image_id") * F.greatest(full, F.lit(1))) + 1
    n = F.when(draw(seed, "image_id") < full_share, full).otherwise(few).cast("int")

    def fitting(names: Column, room: Column, strict: bool) -> Column:
        """The first ones that fit: kept, and their tokens."""
        start = F.struct(F.array().cast("array<struct<label:bigint,name:string,tokens:bigint>>").alias("kept"), F.lit(0).cast("long").alias("used"), F.lit(True).alias("go"))

        def step(acc: Column, c: Column) -> Column:
            used = acc["used"] + c["tokens"]
            go = acc["go"] & ((used < room) if strict else (used <= room))
            return F.struct(F.when(go, F.concat(acc["kept"], F.array(c))).otherwise(acc["kept"]).alias("kept"), F.when(acc["go"], used).otherwise(acc["used"]).alias("used"), go.alias("go"))

        return F.aggregate(names, start, step)

    x = x.withColumn("_p", fitting(F.filter(shuffled(2), lambda c: F.array_contains("own", c["label"])), F.lit(most_tokens), False))
    drawn = F.filter(F.slice(shuffled(3), F.lit(1), n), lambda c: ~F.array_contains("own", c["label"]))
    x = x.withColumn("_n", fitting(drawn, most_tokens - F.col("_p.used"), True))
    all_ = F.concat("_p.kept", "_n.kept")
    return x.select("image_id", F.concat(F.array_join(F.transform(all_, lambda c: c["name"]), ". "), F.lit(".")).alias("caption"), F.transform(all_, lambda c: c["label"]).alias("labels"))


def triplets(rows: DataFrame, ids: int = 8, per_id: int = 4, seed: int = 0, shards: int = 256) -> DataFrame:
    """anchor, place, person, crop: for each crop (crop_id, person_id) of ``rows`` a batch of ``ids`` x ``per_id`` crops.

    The first person is the anchor's, the others are drawn among the rest without repeats; crops of a person are drawn
    with repeats. People and crops are numbered densely, so a draw is a number and a join.
    """
    from .sampling import numbered

    people = rows.select("person_id").distinct()
    n = people.count()
    if n < ids:
        raise ValueError(f"{n} people do not give {ids} different ones")
    people = numbered(people, ["person_id"], "who", shards=shards)
    crops = numbered(rows.select("crop_id", "person_id"), ["crop_id"], "which", ["person_id"], shards=shards)
    size = crops.groupBy("person_id").agg(F.count("*").alias("_n"))
    x = rows.select(F.col("crop_id").alias("anchor"), "person_id").join(people, "person_id")
    # other people: steps round the circle of all of them, each at least 1 and all different, so none comes twice
    gap = lambda k: F.floor(draw_of(seed, F.col("anchor"), F.lit(k)) * ((n - 1) // max(1, ids - 1)))
    steps = F.array(F.lit(0).cast("long"), *[(gap(k) + 1 + (k - 1) * ((n - 1) // max(1, ids - 1))).cast("long") for k in range(1, ids)])
    x = x.select("anchor", "who", F.posexplode(steps).alias("k", "step")).withColumn("who", (F.col("who") + F.col("step")) % n)
    x = x.join(people.join(size, "person_id"), "who").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(per_id - 1))))
    x = x.withColumn("place", F.col("k") * per_id + F.col("i"))
    x = x.withColumn("which", F.floor(draw(seed + 1, "anchor", "place") * F.col("_n")))
    return x.join(crops, ["person_id", "which"]).select("anchor", "place", F.col("person_id").alias("person"), F.col("crop_id").alias("crop"))
