"""Text of class names, captions and phrases as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_name(name: Column) -> Column:
    """Without what stands in brackets (from the first to the last), ``_`` as space, double spaces single, lower case."""
    x = F.regexp_replace(name, r"\(.*\)", "")
    return F.lower(F.replace(F.replace(x, F.lit("_"), F.lit(" ")), F.lit("  "), F.lit(" ")))


def span_text(caption: Column, spans: Column, glue: str = " ") -> Column:
    """Text of character spans [[start, end), ...] of a caption."""
    return F.array_join(F.transform(spans, lambda s: F.substring(caption, F.get(s, F.lit(0)) + 1, F.get(s, F.lit(1)) - F.get(s, F.lit(0)))), glue)


def dense_ids(ids: Column) -> Column:
    """Each id replaced by its place among the sorted distinct ids of the array."""
    return F.transform(ids, lambda v: F.array_position(F.array_sort(F.array_distinct(ids)), v).cast("int") - 1)


def caption_of(names: Column, glue: str = ". ") -> Column:
    """Names joined to a caption that ends with the glue's first character."""
    return F.concat(F.array_join(names, glue), F.lit(glue[:1]))


def caption_spans(names: Column, glue: str = ". ") -> Column:
    """Character span [start, end) of each name in ``caption_of``."""
    n = len(glue)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<int>>").alias("out"))
    step = lambda acc, s: F.struct((acc["at"] + F.length(s) + n).alias("at"), F.concat(acc["out"], F.array(F.array(acc["at"], acc["at"] + F.length(s)))).alias("out"))
    return F.aggregate(names, start, step, lambda acc: acc["out"])


def merged_spans(spans: Column, gap: int = 1) -> Column:
    """Spans in order, joined where the next starts at most ``gap`` characters after the last end."""
    none = F.array().cast("array<array<int>>")

    def step(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        joined = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.array(F.get(last, F.lit(0)), F.greatest(F.get(last, F.lit(1)), F.get(s, F.lit(1))))))
        near = (F.size(acc) > 0) & (F.get(s, F.lit(0)) <= F.get(F.get(acc, F.size(acc) - 1), F.lit(1)) + gap)
        return F.when(near, joined).otherwise(F.concat(acc, F.array(s)))

    return F.aggregate(F.array_sort(spans), none, lambda acc, s: F.when(F.size(acc) == 0, F.array(s)).otherwise(step(acc, s)))


def word_bucket(name: Column) -> Column:
    """Bucket by number of words: 0-3, 4-6, 7-9, 10+."""
    n = F.size(F.split(name, " "))
    return F.when(n <= 3, "0-3").when(n <= 6, "4-6").when(n <= 9, "7-9").otherwise("10+")


def image_id_of(file_name: Column) -> Column:
    """The number after the last ``_`` of a file's stem."""
    return F.element_at(F.split(F.regexp_replace(file_name, r"\.[^.]*$", ""), "_"), -1).cast("long")


def lvis_file_name(file_name: Column, coco_url: Column, host: str = "http://images.cocodataset.org/") -> Column:
    """Names that start with ``COCO`` keep their last 16 characters; without a name the URL's path is taken."""
    return F.coalesce(F.when(F.startswith(file_name, F.lit("COCO")), F.right(file_name, F.lit(16))).otherwise(file_name), F.replace(coco_url, F.lit(host), F.lit("")))
