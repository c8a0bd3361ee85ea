"""Conversions between annotation layouts and splits of them, over the tables of ``tessera.sources.annotations``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.boxes import Box
from ..operators.sampling import draw, numbered


def to_odvg(images: DataFrame, cleaned: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each image: file_name, height, width, detection.instances (bbox, label, category); crowds go."""
    box = F.array(*[F.round(c, 2) for c in Box.named().corners])
    x = cleaned.where("ignored = 0").join(labels.select("label", "name"), "label")
    arrays = x.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("id", box.alias("bbox"), "label", F.col("name").alias("category")))).alias("i"))
    arrays = arrays.select("image_id", F.struct(F.transform("i", lambda r: F.struct(r["bbox"].alias("bbox"), r["label"].alias("label"), r["category"].alias("category"))).alias("instances")).alias("detection"))
    return images.join(arrays, images["id"] == arrays["image_id"], "left").select("id", "file_name", "height", "width", "detection")


def keep_categories(images: DataFrame, annotations: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Annotations of the wanted categories (category_id) and the images that have any."""
    a = annotations.join(wanted, "category_id", "left_semi")
    return images.join(a.select(F.col("image_id").alias("id")).distinct(), "id", "left_semi"), a


def drop_rare(annotations: DataFrame, categories: DataFrame, rare: str = "r") -> DataFrame:
    """Annotations without those of rare categories."""
    return annotations.join(categories.where(F.col("frequency") == rare).select(F.col("id").alias("category_id")), "category_id", "left_anti")


def rename_categories(categories: DataFrame, names: DataFrame) -> DataFrame:
    """Categories with names replaced where ``names`` (id, new_name) has them."""
    return categories.join(names, "id", "left").withColumn("name", F.coalesce("new_name", "name")).drop("new_name")


def without(ids: DataFrame, *others: DataFrame, key: str = "image_id") -> DataFrame:
    """Distinct ids that none of the other tables has."""
    out = ids.select(key).distinct()
    for o in others:
        out = out.join(o.select(key).distinct(), key, "left_anti")
    return out


def phrase_groups(regions: DataFrame) -> DataFrame:
    """Regions (image_id, phrase, corners) grouped by phrase: image_id, phrase, boxes. Images with boxes of at most a pixel only go."""
    b = Box.named()
    x = regions.withColumn("_ok", (b.width > 1) & (b.height > 1)).withColumn("_any", F.max("_ok").over(Window.partitionBy("image_id"))).where("_any and _ok")
    return x.groupBy("image_id", "phrase").agg(F.sort_array(F.collect_list(F.array(*b.corners))).alias("boxes"))


def mot_to_video(rows: DataFrame, half: str | None = None) -> DataFrame:
    """MOT rows (video_id, frame_id, instance_id, corners) with frames from 0, a global instance number in order of first
    appearance, and optionally only the first or second half of each video (the middle frame is in the first)."""
    n = F.max("frame_id").over(Window.partitionBy("video_id"))
    x = rows.withColumn("_cut", F.floor(n / 2) + 1)
    if half is not None:
        x = x.where(F.col("frame_id") <= F.col("_cut")) if half == "first" else x.where(F.col("frame_id") > F.col("_cut"))
    seen = x.groupBy("video_id", "instance_id").agg(F.min("frame_id").alias("f"))
    ids = numbered(seen, ["video_id", "f", "instance_id"], "global_id").select("video_id", "instance_id", "global_id")
    return x.join(ids, ["video_id", "instance_id"]).withColumn("frame_id", F.col("frame_id") - 1).drop("_cut")


def reid_split(rows: DataFrame, least: int, most: int, train_share: float = 0.8) -> DataFrame:
    """Crops (person_id, frame_id, ...) of people with at least ``least`` of them, at most ``most`` each, with ``part``:
    the first people by id are for training."""
    w = Window.partitionBy("person_id")
    x = rows.withColumn("_n", F.count("*").over(w)).where(F.col("_n") >= least).withColumn("_r", F.row_number().over(w.orderBy("frame_id"))).where(F.col("_r") <= most)
    people = x.select("person_id").distinct()
    last = people.agg(F.greatest(F.count("*") - 1, F.lit(1))).scalar()
    people = numbered(people, ["person_id"], "_i").select("person_id", (F.col("_i") / last).alias("_p"))
    return x.join(people, "person_id").withColumn("part", F.when(F.col("_p") < train_share, "train").otherwise("val")).drop("_n", "_r", "_p")


def split_share(images: DataFrame, percent: float, key: str = "image_id", fold: int = 0) -> DataFrame:
    """``images`` with ``labelled``: a drawn share, the same for the same fold."""
    return images.withColumn("labelled", draw(fold, key) < percent / 100)


def sample_images(images: DataFrame, n: int, key: str = "image_id", seed: int = 0) -> DataFrame:
    """``n`` drawn images."""
    return images.orderBy(draw(seed, key), key).limit(n)


def frames_of_videos(videos: DataFrame) -> DataFrame:
    """Per-video arrays (video_id, instance_id, label, boxes: array of boxes, null where absent) as rows of frames."""
    x = videos.select("video_id", "instance_id", "label", F.posexplode("boxes").alias("frame_id", "b")).where("b is not null")
    return x.select("video_id", "frame_id", "instance_id", "label", *Box.xywh(*[F.get("b", F.lit(i)) for i in range(4)]).columns())


def column_union(tables: Sequence[DataFrame], names: Sequence[str]) -> DataFrame:
    """All rows of the tables with ``source_id``; columns that a table lacks are null."""
    out = None
    for name, t in zip(names, tables, strict=True):
        t = t.withColumn("source_id", F.lit(name))
        out = t if out is None else out.unionByName(t, allowMissingColumns=True)
    return out


def phrases_of(spans: Column, caption: Column) -> Column:
    """Phrases of an annotation from its character spans [[start, end], ...]: sorted by start, a span that begins one
    character, a blank, after the end of the one before goes on with its phrase; others begin a new one."""
    low, high = F.array_min(F.transform(spans, lambda s: s[0])), F.array_max(F.transform(spans, lambda s: s[1]))
    pairs = F.array_sort(F.transform(spans, lambda s, i: F.struct(s[0].alias("start"), i.alias("i"), s[1].alias("end"))))
    begin = F.struct(F.array().cast("array<string>").alias("all"), F.lit(None).cast("string").alias("open"), F.lit(-10).alias("end"))

    def take(part: Column, done: Column, s: Column) -> Column:
        text = F.substring(part, s["start"] - low + 1, s["end"] - s["start"])
        goes_on = (done["end"] + 1 == s["start"]) & (F.substring(part, s["start"] - low, F.lit(1)) == " ")
        closed = F.when(done["open"].isNull(), done["all"]).otherwise(F.concat(done["all"], F.array(done["open"])))
        return F.struct(F.when(goes_on, done["all"]).otherwise(closed).alias("all"), F.when(goes_on, F.concat(done["open"], F.lit(" "), text)).otherwise(text).alias("open"), s["end"].cast("int").alias("end"))

    # a long caption is passed once, up to the last span; what the spans are cut from is as long as they reach
    whole = lambda part: F.aggregate(pairs, begin, lambda done, s: take(part, done, s), lambda d: F.when(d["open"].isNull(), d["all"]).otherwise(F.concat(d["all"], F.array(d["open"]))))
    return F.get(F.transform(F.array(F.substring(caption, low + 1, high - low)), whole), F.lit(0))


def grounded(annotations: DataFrame, images: DataFrame) -> DataFrame:
    """image_id, key, phrase (array), tokens_positive, boxes: annotations of an image that share their phrases, as one region.

    ``annotations``: image_id, ann_id, bbox [x, y, w, h], area, crowd, tokens_positive; ``images``: image_id, caption, width,
    height. Images whose boxes all have a side of at most 1 are left out; so are crowds, boxes off the canvas, of a side
    under 1 or without area. Boxes are cut at the right and lower edge, and stand in the order of ann_id; the spans are the
    first annotation's."""
    x, y, w, h = (F.get("bbox", F.lit(i)) for i in range(4))
    sound = (w > 1) & (h > 1)
    a = annotations.where("crowd = 0").withColumn("_any", F.max(sound).over(Window.partitionBy("image_id"))).where("_any").drop("_any")
    a = a.join(images.select("image_id", "caption", "width", "height"), "image_id")
    inside = (F.least(x + w, F.col("width")) > F.greatest(x, F.lit(0))) & (F.least(y + h, F.col("height")) > F.greatest(y, F.lit(0)))
    a = a.where(inside & (F.col("area") > 0) & (w >= 1) & (h >= 1))
    box = F.array(x, y, F.least(x + w, F.col("width").cast("double")), F.least(y + h, F.col("height").cast("double")))
    a = a.select("image_id", "ann_id", "tokens_positive", box.alias("box"), phrases_of(F.col("tokens_positive"), F.col("caption")).alias("phrase"))
    a = a.withColumn("key", F.array_join("phrase", " "))
    first = F.min(F.struct("ann_id", "phrase", F.array_sort("tokens_positive").alias("tokens_positive")))
    out = a.groupBy("image_id", "key").agg(first.alias("f"), F.sort_array(F.collect_list(F.struct("ann_id", "box"))).alias("b"))
    return out.select("image_id", "key", "f.phrase", "f.tokens_positive", F.transform("b", lambda v: v["box"]).alias("boxes"))
