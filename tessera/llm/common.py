"""What the corpus operators share: stage tables, a bounded pre-join filter, connected components, word arrays."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of other characters than these (space, tab, line feed, vertical tab, form feed, return).
BLANKS = " \t\n\x0b\f\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- stage tables

#: Rows of texts that go to a Python worker at once; texts are long.
BATCH_ROWS = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Where it is unset and Spark runs in one process (tests),
    a new temporary one; on a cluster that is an error, as executors do not share such folders."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


#: Spark's own setting: a finished write deletes the shuffle files that only it has read.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stage(df: DataFrame, name: str, level: int = 3) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it again: lineage ends here, on shared storage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera/{name}-{uuid.uuid4().hex}"
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = {k: spark.conf.get(k) for k in (rows, CLEANUP)}
    spark.conf.set(rows, str(min(int(before[rows]) if int(before[rows]) > 0 else BATCH_ROWS, BATCH_ROWS)))
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", level).parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    out = spark.read.schema(df.schema).parquet(path)
    out._tessera_path = path
    return out


def drop_stage(*frames: DataFrame) -> None:
    """Delete stage tables that no later stage reads; only for tables whose successors are tables themselves."""
    for df in frames:
        spark, path = df.sparkSession, df._tessera_path
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


# ---------------------------------------------------------------- bounded pre-join filter


def prefilter(big: DataFrame, key: str, keys: DataFrame, words: int = 1 << 18) -> DataFrame:
    """Rows of ``big`` whose ``key`` may occur in ``keys``: a blocked Bloom filter of at most ``words`` longs.

    The filter's size is fixed by the parameter, so broadcasting it is safe at any input size. It keeps every row with
    a match and some without; an exact join has to follow. With very many keys it only filters less.
    """
    maybe = free_name(big, "maybe")
    return marked(big, key, keys, maybe, words).where(F.col(maybe)).drop(maybe)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have (names are compared without case, as Spark does)."""
    taken = {c.lower() for c in df.columns}
    name = f"_{name}"
    while name.lower() in taken:
        name = f"_{name}"
    return name


def marked(big: DataFrame, key: str, keys: DataFrame, maybe: str, words: int = 1 << 18) -> DataFrame:
    """``big`` with a boolean column ``maybe``: false where ``key`` is certainly not in ``keys``."""
    at, word = free_name(big, "slot"), free_name(big, "word")
    h = F.xxhash64(F.col(key))
    slot = F.pmod(h, F.lit(words)).cast("int")
    bits = F.lit(0).cast("long")
    for shift in (20, 26, 32, 38):
        bits = bits.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, shift).bitwiseAND(F.lit(63)).cast("int")))
    filt = keys.select(slot.alias(at), bits.alias("bits")).groupBy(at).agg(F.bit_or("bits").alias(word))
    out = big.withColumn(at, slot).join(F.broadcast(filt), at, "left")
    return out.withColumn(maybe, F.coalesce(F.col(word).bitwiseAND(bits) == bits, F.lit(False))).drop(at, word)


def without(df: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """Rows of ``df`` whose ``key`` is not in the one column of ``gone``; only rows that may be in it are shuffled.
    Rows with a null key stay."""
    maybe = free_name(df, "maybe")
    split = marked(df, key, gone, maybe)
    kept = split.where(F.col(maybe)).join(gone, key, "left_anti").select(split.columns)
    return split.where(~F.col(maybe)).union(kept).drop(maybe)


def one_text(docs: DataFrame) -> DataFrame:
    """``docs`` without rows that have no id; of different texts under one id only the one with the smallest hash."""
    docs = docs.where(F.col("doc_id").isNotNull())
    h = F.xxhash64(F.coalesce("text", F.lit("")))
    seen = docs.select("doc_id", h.alias("h")).groupBy("doc_id").agg(F.min("h").alias("low"), F.max("h").alias("high"))
    clash = stage(seen.where("low < high").select("doc_id", "low"), "clash")
    if clash.isEmpty():
        return docs
    maybe, low = free_name(docs, "maybe"), free_name(docs, "low")
    split = marked(docs, "doc_id", clash, maybe)
    some = split.where(F.col(maybe)).join(clash.withColumnRenamed("low", low), "doc_id", "left").where(F.col(low).isNull() | (F.col(low) == h))
    return split.where(~F.col(maybe)).select(docs.columns).union(some.select(docs.columns))


# ---------------------------------------------------------------- connected components


def components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """(node, component): each node of ``edges`` (a, b) with the smallest node it is connected to.

    Alternating large-star and small-star rounds (union-find by contraction). Every round is two aggregates and two
    joins over edges only, its result a table; rounds grow with the logarithm of the longest path.
    """
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    e = stage(e, name)
    mark = _mark(e)
    while mark[0]:
        both = e.union(e.select("b", "a"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x"))
        small = small.select("x.*").where("a <> b").distinct()
        new = stage(small, name)
        now = _mark(new)
        drop_stage(e)
        e = new
        if now == mark:
            break
        mark = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _mark(e: DataFrame) -> tuple:
    x = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return (x[0], x[1])


# ---------------------------------------------------------------- words of Arrow text columns

_SPACE = np.zeros(256, bool)
_SPACE[[ord(c) for c in BLANKS]] = True
_AS_IS = np.arange(256, dtype=np.uint8)
_LOWER = _AS_IS.copy()
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the splitmix64 constants)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        size = max(n, 1 << 20)
        for key, base in (("up", int(_BASE)), ("down", pow(int(_BASE), -1, 1 << 64))):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _POWERS[key] = np.cumprod(x)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def range_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of values[start:end] for each pair, by prefix sums of a polynomial modulo 2**64."""
    up, down = powers(len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[:-1], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


class Words:
    """Words of a slice of documents: byte ``start`` and ``end`` in ``data``, and ``hash``; document i has words first[i]:first[i + 1]."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool):
        blank = _SPACE[data]
        n = len(data)
        before, after = np.ones(n, bool), np.ones(n, bool)
        before[1:], after[:-1] = blank[:-1], blank[1:]
        inner = offsets[(offsets > 0) & (offsets < n)]
        before[inner], after[inner - 1] = True, True
        self.start, self.end = np.flatnonzero(~blank & before), np.flatnonzero(~blank & after) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.n = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(offsets) - 1), self.n)
        self.hash = range_hash(_BYTE[(_LOWER if lower else _AS_IS)[data]], self.start, self.end) if n else np.zeros(0, np.uint64)


def text_slices(column: pa.Array, most: int = 1 << 19):
    """Cut an Arrow text column (null: empty) into row ranges of about ``most`` bytes: (from, to, bytes, offsets)."""
    column = column.cast(pa.large_string()).fill_null("")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    raw = column.buffers()
    offsets = np.frombuffer(raw[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(raw[2], np.uint8) if raw[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def lists(values: np.ndarray, first: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(values, kind))


def count_of(condition: Column) -> Column:
    return F.sum(F.when(condition, 1).otherwise(0))
