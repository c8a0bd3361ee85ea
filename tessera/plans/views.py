"""Detection tables derived from the test tables: one set of expressions for Spark and for DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BASE = {
    "event_id": "event_id",
    "image_id": "user_id",
    "label": "event_id % 5",
    "k": "event_id % 3",
    "gx": "((event_id * 7919) % 10007) % 3",
    "gy": "((event_id * 104729) % 20011) % 2",
    "ignored": "CASE WHEN (event_id * 524287) % 7 = 0 THEN 1 ELSE 0 END",
    "group_of": "CASE WHEN (event_id * 524287) % 11 = 0 THEN 1 ELSE 0 END",
    "score": "CAST((event_id * 7907) % 100003 AS DOUBLE) / 100003",
}
CORNERS = {
    "x1": "CAST(gx * 100 + (event_id * 31) % 17 AS DOUBLE)",
    "y1": "CAST(gy * 100 + (event_id * 17) % 13 AS DOUBLE)",
    "x2": "CAST(gx * 100 + (event_id * 31) % 17 + 80 + (event_id * 13) % 23 AS DOUBLE)",
    "y2": "CAST(gy * 100 + (event_id * 17) % 13 + 80 + (event_id * 11) % 19 AS DOUBLE)",
}
_BOX_COLUMNS = ["event_id", "image_id", "label", "k", "ignored", "group_of", "score"]

#: Common table expressions ``gt`` and ``det`` for DuckDB.
SQL = f"""
base AS (SELECT {", ".join(f"{v} AS {k}" for k, v in BASE.items())} FROM events),
box AS (SELECT {", ".join(_BOX_COLUMNS)}, {", ".join(f"{v} AS {k}" for k, v in CORNERS.items())} FROM base),
gt AS (SELECT event_id AS gt_id, image_id, label, ignored, group_of, x1, y1, x2, y2 FROM box WHERE k = 0),
det AS (SELECT event_id AS det_id, image_id, label, score, x1, y1, x2, y2 FROM box WHERE k <> 0)
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, image_id, label, k, ignored, group_of, score, x1, y1, x2, y2."""
    base = table(spark, sf_dir, "events").selectExpr(*[f"{v} AS {k}" for k, v in BASE.items()])
    return base.selectExpr(*_BOX_COLUMNS, *[f"{v} AS {k}" for k, v in CORNERS.items()])


def ground_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boxes(spark, sf_dir).where("k = 0").selectExpr("event_id AS gt_id", "image_id", "label", "ignored", "group_of", "x1", "y1", "x2", "y2")


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boxes(spark, sf_dir).where("k <> 0").selectExpr("event_id AS det_id", "image_id", "label", "score", "x1", "y1", "x2", "y2")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Track views: video_id, frame_id, track_id and a box for each event."""
    from pyspark.sql.window import Window

    e = table(spark, sf_dir, "events")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select("event_id", F.col("user_id").alias("video_id"), (F.row_number().over(order) - 1).alias("frame_id"))
