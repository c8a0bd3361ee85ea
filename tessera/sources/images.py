"""Sizes of image files from their headers; nothing is decoded.

PNG, GIF and BMP have the size at a fixed place. In a JPEG the segments are walked up to the frame header; an orientation in its
Exif segment that turns the image by a quarter swaps width and height, as decoders do. Anything else, and files that break
off before their size, have null sizes.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Markers of frame headers; markers without a length.
_FRAMES = frozenset(range(0xC0, 0xD0)) - {0xC4, 0xC8, 0xCC}
_BARE = frozenset((0x01, *range(0xD0, 0xD9)))
_ORIENTATION = 0x0112


def _turned(exif: bytes) -> bool:
    """An orientation of 5 to 8 in the first directory of an Exif segment."""
    if exif[:6] != b"Exif\0\0" or exif[6:8] not in (b"II", b"MM"):
        return False
    order, tiff = "<" if exif[6:8] == b"II" else ">", exif[6:]
    (at,) = struct.unpack_from(order + "I", tiff, 4)
    (n,) = struct.unpack_from(order + "H", tiff, at)
    for i in range(n):
        tag, _, _, value = struct.unpack_from(order + "HHIH", tiff, at + 2 + 12 * i)
        if tag == _ORIENTATION:
            return 5 <= value <= 8
    return False


def _jpeg(data: bytes) -> tuple[int, int] | None:
    at, turned = 2, False
    while True:
        while data[at] != 0xFF:
            at += 1
        while data[at] == 0xFF:
            at += 1
        marker = data[at]
        at += 1
        if marker in _BARE:
            continue
        if marker in (0xD9, 0xDA):  # pixels or the end before any frame header
            return None
        (length,) = struct.unpack_from(">H", data, at)
        if marker in _FRAMES:
            height, width = struct.unpack_from(">HH", data, at + 3)
            return (height, width) if turned else (width, height)
        if marker == 0xE1:
            try:
                turned = turned or _turned(data[at + 2 : at + length])
            except struct.error:
                pass
        at += length


def size_of(data: bytes | None) -> tuple[int, int] | None:
    """(width, height), or None."""
    try:
        if not data:
            return None
        if data[:8] == b"\x89PNG\r\n\x1a\n" and data[12:16] == b"IHDR":
            return struct.unpack_from(">II", data, 16)
        if data[:6] in (b"GIF87a", b"GIF89a"):
            return struct.unpack_from("<HH", data, 6)
        if data[:2] == b"BM":
            width, height = struct.unpack_from("<ii", data, 18)
            return width, abs(height)  # a negative height: rows from the top
        return _jpeg(data) if data[:2] == b"\xff\xd8" else None
    except (struct.error, IndexError):
        return None


def _sized(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [size_of(v.as_buffer().to_pybytes() if v.is_valid else None) or (None, None) for v in batch.column("content")]
            columns = [pa.array([s[k] for s in sizes], pa.int32()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], *columns], [*names, "width", "height"])

    return run


def with_sizes(files: DataFrame) -> DataFrame:
    """``files`` with width and height in place of the binary column ``content``."""
    keep = [f for f in files.schema.fields if f.name != "content"]
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in keep] + ["width int", "height int"])
    return files.mapInArrow(_sized([f.name for f in keep]), schema)


def read_image_sizes(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, file_name, width, height of every file below ``path`` whose name matches ``pattern``. Empty files,
    which Spark's file sources pass over, are not in it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return with_sizes(files.select("path", F.substring_index("path", "/", -1).alias("file_name"), "content"))


def names_in_csv(spark: SparkSession, path: str, suffix: str = ".jpg") -> DataFrame:
    """file_name of each image named in the first column of a CSV file with a header, once."""
    x = spark.read.option("header", True).csv(path)
    return x.select(F.concat(F.col(f"`{x.columns[0]}`"), F.lit(suffix)).alias("file_name")).distinct()
