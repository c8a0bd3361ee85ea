"""Readers of annotation formats into exploded tables, the cleaning rules of each, and writers.

Tables: images (image_id string, file_name, width, height), annotations (ann_id, image_id, category_id, corners x1..y2,
area, crowd, ignored, segmentation), categories (category_id, name, label). File order is kept in ``pos`` columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.boxes import Box
from ..operators.sampling import numbered

_D, _L, _S, _I = T.DoubleType(), T.LongType(), T.StringType(), T.IntegerType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


COCO = _struct(
    images=T.ArrayType(_struct(id=_L, file_name=_S, width=_I, height=_I, coco_url=_S, caption=_S, data_source=_S, video_id=_L, frame_id=_L, mot_frame_id=_L, neg_category_ids=T.ArrayType(_L), not_exhaustive_category_ids=T.ArrayType(_L))),
    annotations=T.ArrayType(_struct(id=_L, image_id=_L, category_id=_L, bbox=T.ArrayType(_D), area=_D, iscrowd=_S, ignore=_I, score=_D, segmentation=_S, video_id=_L, instance_id=_L, visibility=_D, mot_instance_id=_L, mot_conf=_D, caption=_S, tokens_positive=T.ArrayType(T.ArrayType(_I)))),
    categories=T.ArrayType(_struct(id=_L, name=_S, supercategory=_S, frequency=_S)),
    videos=T.ArrayType(_struct(id=_L, name=_S, fps=_D, width=_I, height=_I)),
)


def read_coco(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Tables of a COCO or COCO-VID file: images, annotations, categories, videos, in file order (``pos``)."""
    whole = spark.read.schema(COCO).json(path, multiLine=True)
    return {name: whole.select(F.posexplode(name).alias("pos", "r")).select("pos", "r.*") for name in COCO.names}


def require_unique(df: DataFrame, *keys: str) -> DataFrame:
    """``df``; raises if a key occurs twice."""
    twice = df.groupBy(*keys).count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"{keys} occur more than once: {twice[0][:-1]}")
    return df


def labels_of(categories: DataFrame, names: Sequence[str] | None = None, by_id: bool = False) -> DataFrame:
    """category_id, name, label: dense labels of the wanted names, in file order or by id."""
    x = categories.where(F.col("name").isin(list(names))) if names is not None else categories
    order = Window.orderBy("id" if by_id else "pos")  # a row for each category
    return x.select(F.col("id").alias("category_id"), "name", (F.row_number().over(order) - 1).alias("label"))


def clean(annotations: DataFrame, images: DataFrame, labels: DataFrame) -> DataFrame:
    """Annotations as boxes: those marked ignore, outside the image, without area or under a pixel, or of other
    categories go. Corners are not clipped. Crowds stay and are ``ignored``."""
    b = [F.get("bbox", F.lit(i)) for i in range(4)]
    x = annotations.join(images.select(F.col("id").alias("image_id"), "width", "height"), "image_id").join(labels, "category_id")
    box = Box.xywh(*b)
    w = F.greatest(F.lit(0.0), F.least(box.x2, F.col("width")) - F.greatest(box.x1, F.lit(0.0)))
    h = F.greatest(F.lit(0.0), F.least(box.y2, F.col("height")) - F.greatest(box.y1, F.lit(0.0)))
    x = x.where((F.coalesce("ignore", F.lit(0)) == 0) & (w * h > 0) & (F.coalesce("area", b[2] * b[3]) > 0) & (b[2] >= 1) & (b[3] >= 1))
    crowd = F.coalesce(F.lower("iscrowd").isin("1", "true", "1.0"), F.lit(False)).cast("int")
    keep = [c for c in ("id", "image_id", "label", "area", "segmentation", "video_id", "instance_id", "visibility") if c in x.columns]
    return x.select(*keep, *box.columns(), crowd.alias("ignored"))


def filter_images(images: DataFrame, annotations: DataFrame, labels: DataFrame, least_size: int = 0, empty: bool = False) -> DataFrame:
    """Images with a raw annotation of a wanted category (also one that cleaning drops) and both sides at least so long."""
    x = images.where(F.least("width", "height") >= least_size)
    if empty:
        return x
    some = annotations.join(labels, "category_id").select(F.col("image_id").alias("id")).distinct()
    return x.join(some, "id", "left_semi")


def drop_all_ignored(images: DataFrame, cleaned: DataFrame) -> DataFrame:
    """Images with an instance that is not ignored."""
    return images.join(cleaned.where("ignored = 0").select(F.col("image_id").alias("id")).distinct(), "id", "left_semi")


def nested(images: DataFrame, cleaned: DataFrame) -> DataFrame:
    """One row for each image with its instances as an array, ordered by annotation id."""
    fields = [F.col(c) for c in ("id", "label", "ignored", "x1", "y1", "x2", "y2")]
    arrays = cleaned.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("instances"))
    x = images.join(arrays, F.col("id") == F.col("image_id"), "left").drop("image_id")
    return x.withColumn("instances", F.coalesce("instances", F.array().cast(arrays.schema["instances"].dataType)))


VOC = _struct(
    filename=_S, folder=_S, size=_struct(width=_I, height=_I, depth=_I),
    object=T.ArrayType(_struct(name=_S, difficult=_I, truncated=_I, pose=_S, bndbox=_struct(xmin=_S, ymin=_S, xmax=_S, ymax=_S))),
)


def read_voc(spark: SparkSession, path: str, names: Sequence[str], minus_one: bool = True, least_size: float | None = None) -> DataFrame:
    """image_id, width, height, label, corners, ignored from VOC or WIDER XML files; unknown classes go."""
    x = spark.read.format("xml").option("rowTag", "annotation").schema(VOC).load(path)
    x = x.select(F.regexp_replace("filename", r"\.[^.]*$", "").alias("image_id"), "size.width", "size.height", F.posexplode("object").alias("pos", "o"))
    label = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("o.name")) - 1
    shift = 1.0 if minus_one else 0.0
    c = [F.col(f"o.bndbox.{n}").cast("double").cast("int") - shift for n in ("xmin", "ymin", "xmax", "ymax")]
    small = (F.least(c[2] - c[0], c[3] - c[1]) < least_size) if least_size is not None else F.lit(False)
    ignored = ((F.coalesce("o.difficult", F.lit(0)) != 0) | small).cast("int")
    return x.where(label >= 0).select("image_id", "width", "height", "pos", label.cast("int").alias("label"), *Box(*c).columns(), ignored.alias("ignored"))


CROWD_HUMAN = _struct(ID=_S, gtboxes=T.ArrayType(_struct(tag=_S, hbox=T.ArrayType(_I), vbox=T.ArrayType(_I), fbox=T.ArrayType(_I), extra=_struct(box_id=_I, occ=_I, ignore=_I), head_attr=_struct(ignore=_I, occ=_I, unsure=_I))))


def read_crowdhuman(spark: SparkSession, path: str, sizes: DataFrame | None = None) -> DataFrame:
    """image_id, pos, label (0 person, -1 mask), ignored, corners of the full box; with ``sizes`` (image_id, height, width)."""
    x = spark.read.schema(CROWD_HUMAN).json(path).select(F.col("ID").alias("image_id"), F.posexplode("gtboxes").alias("pos", "g"))
    known = (F.col("g.tag") == "person") & (F.coalesce("g.extra.ignore", F.lit(0)) == 0)
    box = Box.xywh(*[F.get("g.fbox", F.lit(i)).cast("double") for i in range(4)])
    x = x.select("image_id", "pos", F.when(known, 0).otherwise(-1).alias("label"), F.when(known, 0).otherwise(1).alias("ignored"), *box.columns())
    return x.join(sizes, "image_id", "left") if sizes is not None else x


ODVG = _struct(
    filename=_S, height=_I, width=_I,
    detection=_struct(instances=T.ArrayType(_struct(bbox=T.ArrayType(_D), label=_I, category=_S))),
    grounding=_struct(caption=_S, regions=T.ArrayType(_struct(bbox=_S, phrase=_S, tokens_positive=T.ArrayType(T.ArrayType(_I))))),
)


def read_odvg(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(objects, phrases) of a JSON-lines file. A region's boxes are a list, also where the file has a single box."""
    x = spark.read.schema(ODVG).json(path)
    objects = x.select("filename", F.posexplode("detection.instances").alias("pos", "i")).select("filename", "pos", "i.label", "i.category", *Box(*[F.get("i.bbox", F.lit(k)) for k in range(4)]).columns())
    regions = x.select("filename", "grounding.caption", F.posexplode("grounding.regions").alias("pos", "r"))
    many = F.coalesce(F.from_json("r.bbox", "array<array<double>>"), F.array(F.from_json("r.bbox", "array<double>")))
    many = F.when(F.startswith(F.regexp_replace("r.bbox", r"\s", ""), F.lit("[[")), F.from_json("r.bbox", "array<array<double>>")).otherwise(F.array(F.from_json("r.bbox", "array<double>")))
    phrases = regions.select("filename", "caption", "pos", "r.phrase", "r.tokens_positive", many.alias("boxes"))
    return objects, phrases


def read_openimages(spark: SparkSession, path: str, sizes: DataFrame, names: DataFrame) -> DataFrame:
    """image_id, label, corners in pixels, group_of, occluded. ``sizes``: image_id, width, height; ``names``: label_id, label."""
    x = spark.read.option("header", True).csv(path)
    c = [F.col(n).cast("double") for n in ("XMin", "YMin", "XMax", "YMax")]
    x = x.withColumnRenamed("ImageID", "image_id").withColumnRenamed("LabelName", "label_id").join(names, "label_id").join(sizes, "image_id")
    box = Box(*c).scale(F.col("width"), F.col("height"))
    return x.select("image_id", "label", *box.columns(), F.col("IsGroupOf").cast("int").alias("group_of"), F.col("IsOccluded").cast("int").alias("occluded"))


def read_image_labels(spark: SparkSession, path: str, names: DataFrame) -> DataFrame:
    """image_id, labels: array of (label, confidence)."""
    x = spark.read.option("header", True).csv(path).withColumnRenamed("ImageID", "image_id").withColumnRenamed("LabelName", "label_id").join(names, "label_id")
    return x.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("label", F.col("Confidence").cast("double").alias("confidence")))).alias("labels"))


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Challenge text: blocks of a file name, a line, a count and rows ``label x1 y1 x2 y2 group``. Labels start at 0."""
    x = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"(?m)^#[^\n]*\n")).alias("block", "t"))
    x = x.select("block", F.filter(F.split("t", "\n"), lambda s: F.trim(s) != "").alias("l")).where(F.size("l") >= 2)
    rows = x.select(F.get("l", F.lit(0)).alias("file_name"), F.posexplode(F.filter("l", lambda s: s.rlike(r"^\s*\d+(\s+\S+){4,}"))).alias("pos", "r"))
    f = F.split(F.trim("r"), r"\s+")
    return rows.select("file_name", "pos", (F.get(f, F.lit(0)).cast("int") - 1).alias("label"), *Box(*[F.get(f, F.lit(i)).cast("double") for i in range(1, 5)]).columns(), F.get(f, F.lit(5)).cast("int").alias("group_of"))


def ancestors(edges: DataFrame) -> DataFrame:
    """Reflexive transitive closure (child, ancestor) of (child, parent) edges of a class hierarchy; a root has
    no edge, or one with a null parent."""
    spark = edges.sparkSession
    edges.createOrReplaceTempView("_tessera_edges")
    return spark.sql("""
        WITH RECURSIVE up(child, ancestor) AS (
          SELECT child, child FROM (SELECT child FROM _tessera_edges UNION SELECT parent FROM _tessera_edges WHERE parent IS NOT NULL)
          UNION ALL
          SELECT up.child, e.parent FROM up JOIN _tessera_edges e ON up.ancestor = e.child WHERE e.parent IS NOT NULL
        ) SELECT DISTINCT child, ancestor FROM up""")


def expand_labels(boxes: DataFrame, closure: DataFrame) -> DataFrame:
    """Every box once for each ancestor of its class (itself included)."""
    return boxes.withColumnRenamed("label", "child").join(closure, "child").withColumnRenamed("ancestor", "label").drop("child")


MOT_GT = ("frame_id", "instance_id", "x", "y", "w", "h", "conf", "category_id", "visibility")


def read_mot(spark: SparkSession, path: str) -> DataFrame:
    """frame_id, instance_id, corners, conf, category_id, visibility of a MOT text file."""
    x = spark.read.schema(", ".join(f"{n} double" for n in MOT_GT)).csv(path)
    box = Box.xywh(*[F.col(c) for c in "xywh"])
    return x.select(F.col("frame_id").cast("long"), F.col("instance_id").cast("long"), *box.columns(), "conf", F.col("category_id").cast("int"), "visibility")


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """path, label of a space-separated list."""
    return spark.read.schema("path string, label int").csv(path, sep=" ")


def list_images(spark: SparkSession, path: str, suffix: str = ".jpg") -> DataFrame:
    """file of every image under a folder, with its segmentation map's name, in order of the paths; contents are not read."""
    x = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").load(path)
    return x.select("path", F.regexp_replace("path", f"{suffix.replace('.', '[.]')}$", ".png").alias("map_path"), "length")


def read_references(refs: DataFrame, annotations: DataFrame, images: DataFrame, mode: str = "original") -> DataFrame:
    """Referring expressions: image_id, file_name, text(s), corners. ``mode``: original (all, lower-cased), concat or first."""
    x = refs.join(annotations, "ann_id").join(images, "image_id")
    low = F.transform("sentences", lambda s: F.lower(F.trim(s)))
    text = {"original": low, "concat": F.array(F.array_join(low, "")), "first": F.slice(low, 1, 1)}[mode]
    return x.select("ref_id", "image_id", "file_name", text.alias("text"), *Box.xywh(*[F.get("bbox", F.lit(i)) for i in range(4)]).columns())


def join_proposals(images: DataFrame, proposals: DataFrame) -> DataFrame:
    """Images with their proposals, found by ``folder/file`` of the path; raises if one has none."""
    key = F.concat_ws("/", F.element_at(F.split("path", "/"), -2), F.element_at(F.split("path", "/"), -1))
    x = images.withColumn("key", key).join(proposals, "key", "left")
    missing = x.where("proposals IS NULL").select("key").limit(1).collect()
    if missing:
        raise KeyError(missing[0][0])
    return x


# ---------------------------------------------------------------- writers


def coco_rows(det: DataFrame, categories: Column | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Detections as COCO result rows: image_id, bbox (xywh), score, category_id; columns of ``keep`` come first."""
    b = Box.named()
    return det.select(*keep, "image_id", F.array(*b.as_xywh()).alias("bbox"), "score", (categories if categories is not None else F.col("label")).alias("category_id"))


def coco_annotations(gt: DataFrame) -> DataFrame:
    """Ground truth as COCO annotation rows with ids from 1; the area is that of the box."""
    b = Box.named()
    x = numbered(gt, ["image_id", "gt_id"], "id").withColumn("id", F.col("id") + 1)
    return x.select("id", "image_id", F.col("label").alias("category_id"), F.array(*b.as_xywh()).alias("bbox"), b.area.alias("area"), F.col("ignored").alias("iscrowd"))


def write_lines(df: DataFrame, path: str) -> None:
    """One JSON object in each line."""
    df.write.mode("overwrite").json(path)


def mot_lines(tracks: DataFrame) -> DataFrame:
    """``value``: MOT text rows of (frame_id, track_id, corners, score); frames count from 1."""
    b = Box.named()
    return tracks.select(F.format_string("%d,%d,%.3f,%.3f,%.3f,%.3f,%.3f,-1,-1,-1", F.col("frame_id") + 1, "track_id", b.x1, b.y1, b.width, b.height, "score").alias("value"))


def prediction_rows(det: DataFrame) -> DataFrame:
    """image_id, json: labels, scores and boxes of an image as one JSON object, best first."""
    x = det.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("o"), "det_id", "label", "score", F.array("x1", "y1", "x2", "y2").alias("b")))).alias("d"))
    return x.select("image_id", F.to_json(F.struct(F.transform("d", lambda r: r["label"]).alias("labels"), F.transform("d", lambda r: r["score"]).alias("scores"), F.transform("d", lambda r: r["b"]).alias("bboxes"))).alias("json"))
