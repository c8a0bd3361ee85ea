"""Column expressions on texts that stay in the JVM; ``let`` evaluates an array once where a lambda reads it often."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` bound to a lambda variable, so that inner lambdas do not compute it again."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: ``common.BLANKS`` as a character class.
BLANK = r" \t\n\x0B\f\r"


def parts_of(text: Column) -> Column:
    """What stands between the blanks of a text (null: empty), empty parts as well: one more than there are blanks."""
    return F.split(F.coalesce(text, F.lit("")), f"[{BLANK}]")


def words_of(text: Column) -> Column:
    """Words of a text (null: none)."""
    return F.array_remove(parts_of(text), "")


def hashes_of(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def windows_of(hashes: Column, k: int) -> Column:
    """Hash of every k consecutive elements."""
    all_places = F.transform(hashes, lambda h, i: F.xxhash64(h, *[F.get(hashes, i + j) for j in range(1, k)]))
    return F.slice(all_places, F.lit(1), F.greatest(F.size(hashes) - (k - 1), F.lit(0)))


def bucket_of(h: Column, buckets: int) -> Column:
    """Bucket of a hash; ``buckets`` is a power of two."""
    return h.bitwiseAND(F.lit(buckets - 1)).cast("int")


def buckets_of(hashes: Column, buckets: int) -> Column:
    """Buckets of all single words and word pairs."""
    return F.concat(F.transform(hashes, lambda h: bucket_of(h, buckets)), F.transform(windows_of(hashes, 2), lambda h: bucket_of(h, buckets)))


def summed(hashes: Column, table: Column, buckets: int, pairs: Column | None = None) -> Column:
    """Sum of a table's values over the buckets of all single words and word pairs (``pairs``: their hashes, if at hand)."""
    last = F.size(hashes) - 1
    hash_of = lambda h, i: F.xxhash64(h, F.get(hashes, i + 1)) if pairs is None else F.get(pairs, i)
    pair = lambda h, i: F.when(i < last, F.get(table, bucket_of(hash_of(h, i), buckets))).otherwise(0.0)
    both = F.transform(hashes, lambda h, i: F.get(table, bucket_of(h, buckets)) + pair(h, i))
    return F.aggregate(both, F.lit(0.0), lambda s, v: s + v)


def filled(counts: DataFrame, buckets: int, value: Column, name: str) -> DataFrame:
    """One row with an array of ``value`` for buckets 0, 1, ...; counts lacks buckets that never occur."""
    grid = counts.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    full = grid.join(F.broadcast(counts), "bucket", "left")  # at most a row for each bucket
    return full.select("bucket", value.alias("v")).agg(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "v"))), lambda x: x["v"]).alias(name))
