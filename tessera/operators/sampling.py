"""Sampling of rows, batches and candidates. Draws are hashes of ids and a seed: the same rows at any partitioning."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


#: Draws are computed modulo this prime, so there are as many different ones.
PRIME = 2**31 - 1


def draw(seed: int, *keys: str) -> Column:
    """``draw_of`` columns by name."""
    return draw_of(seed, *[F.col(k) for k in keys])


def draw_of(seed: int, *keys: Column) -> Column:
    """A number in [0, 1) from keys, by arithmetic that SQL engines share (``draw_sql``): no engine's own hash.

    The square between the two linear steps keeps equal steps of a key from giving equal steps of the draw.
    """
    x = F.lit(seed).cast("long")
    for k in keys:
        x = (x * 31 + F.pmod(k, F.lit(PRIME))) % PRIME
    y = (x * 48_271 + 104_729) % PRIME
    z = (y * y % PRIME + x) % PRIME
    return (z * 69_621 + 7_919) % PRIME / float(PRIME)


def draw_sql(seed: int, *keys: str) -> str:
    """``draw`` as SQL text."""
    x = str(seed)
    for k in keys:
        x = f"(({x}) * CAST(31 AS BIGINT) + (CAST({k} AS BIGINT) % {PRIME} + {PRIME}) % {PRIME}) % {PRIME}"
    y = f"(({x}) * 48271 + 104729) % {PRIME}"
    return f"((((({y}) * ({y})) % {PRIME} + {x}) % {PRIME} * 69621 + 7919) % {PRIME} / CAST({PRIME} AS DOUBLE))"


def numbered(rows: DataFrame, order: Sequence[str], name: str, by: Sequence[str] = (), shards: int = 256) -> DataFrame:
    """``rows`` with a dense number from 0 in ``order`` (within ``by``), without one task for all of a group.

    The first column of ``order``, a number, is cut at ``shards`` approximate quantiles; rows are numbered within a shard, and shards
    begin at the counts of those before them (a table of at most groups x shards rows). Rows that tie in that column are
    one shard.
    """
    key = order[0]
    cuts = rows.agg(F.percentile_approx(key, F.array(*[F.lit(i / shards) for i in range(1, shards)]), 10_000).alias("c")).first()["c"] or []
    shard = F.lit(0)
    if cuts:
        shard = F.expr(_bisected("_k", sorted(set(cuts))))
    x = rows.withColumn("_k", F.col(key)).withColumn("_s", shard).drop("_k")
    counts = x.groupBy(*by, "_s").agg(F.count("*").alias("_c"))
    before = counts.select(*by, "_s", (F.sum("_c").over(Window.partitionBy(*by).orderBy("_s")) - F.col("_c")).alias("_b"))
    x = x.withColumn("_r", F.row_number().over(Window.partitionBy(*by, "_s").orderBy(*order)) - 1)
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in (*by, "_s")]
    joined = x.alias("l").join(before.alias("r"), reduce(Column.__and__, same))
    return joined.select(*[F.col(f"l.{c}") for c in rows.columns], (F.col("r._b") + F.col("l._r")).alias(name))


def _bisected(key: str, cuts: list) -> str:
    """SQL for the number of ``cuts`` that are at most ``key``, by halving."""
    if not cuts:
        return "0"

    def part(lo: int, hi: int) -> str:
        if lo == hi:
            return str(lo)
        mid = (lo + hi) // 2
        return f"CASE WHEN {key} < {cuts[mid]!r} THEN {part(lo, mid)} ELSE {part(mid + 1, hi)} END"

    return part(0, len(cuts))


def batches(rows: DataFrame, size: int, by: Sequence[str], order: Sequence[str], drop_last: bool = False) -> DataFrame:
    """``rows`` with batch (0-based within ``by``) and place; with ``drop_last`` rows of unfilled batches go."""
    i = F.col("_i")
    out = numbered(rows, order, "_i", by).withColumn("batch", F.floor(i / size)).withColumn("place", i % size).drop("_i")
    if drop_last:
        n = F.count("*").over(Window.partitionBy(*by, "batch"))
        out = out.withColumn("_n", n).where(F.col("_n") == size).drop("_n")
    return out


def aspect(width: str = "width", height: str = "height") -> Column:
    """0 for images wider than high, else 1."""
    return F.when(F.col(width) < F.col(height), 0).otherwise(1)


def per_source(rows: DataFrame, sizes: dict, source: str, key: str, seed: int = 0) -> DataFrame:
    """At most ``sizes[source]`` rows of each source (-1: all), by draws."""
    n = F.create_map(*[F.lit(v) for kv in sizes.items() for v in kv])
    x = numbered(rows.withColumn("_d", draw(seed, key)), ["_d", key], "_r", [source]).drop("_d")
    out = x.withColumn("_k", F.try_element_at(n, F.col(source)))
    return out.where((F.col("_k") < 0) | (F.col("_r") < F.col("_k"))).drop("_k", "_r")


def with_replacement(rows: DataFrame, weight: Column, n: int, key: str, seed: int = 0) -> DataFrame:
    """``n`` rows drawn with probability by ``weight``: draw, key. Draws meet the cumulative weights by cells of [0, 1), as
    many as there are draws, so a draw meets the few rows of its cell: (rows + draws) pairs in all on average."""
    total, cells = rows.agg(F.sum(weight).alias("t")), max(n, 1024)
    x = rows.select(key, weight.alias("w"), F.pmod(F.col(key), F.lit(256)).alias("shard"))
    shard = x.groupBy("shard").agg(F.sum("w").alias("s"))
    shard = shard.select("shard", (F.sum("s").over(Window.orderBy("shard")) - F.col("s")).alias("b"))  # 256 rows
    upto = Window.partitionBy("shard").orderBy(key)
    x = x.join(F.broadcast(shard), "shard").withColumn("hi", (F.col("b") + F.sum("w").over(upto)) / total.scalar())
    x = x.withColumn("lo", F.col("hi") - F.col("w") / total.scalar())
    x = x.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") * cells), F.floor(F.col("hi") * cells))))
    d = rows.sparkSession.range(n).select(F.col("id").alias("draw"), draw(seed, "id").alias("u"))
    d = d.withColumn("cell", F.floor(F.col("u") * cells))
    return d.join(x, "cell").where("u >= lo and u < hi").select("draw", key)


def class_aware(labels: DataFrame, n: int, key: str = "image_id", label: str = "label", seed: int = 0) -> DataFrame:
    """``n`` draws that go round the classes and, within a class, round its images in drawn order: draw, label, key."""
    x = labels.select(label, key).distinct()
    sizes = x.groupBy(label).agg(F.count("*").alias("_n"))
    x = numbered(x.withColumn("_d", draw(seed, key, label)), ["_d", key], "_i", [label])
    classes = x.select(label).distinct()
    classes = classes.withColumn("_c", F.row_number().over(Window.orderBy(draw(seed, label), label)) - 1)  # a row for each class
    k = classes.agg(F.count("*")).scalar()
    d = labels.sparkSession.range(n).select(F.col("id").alias("draw")).withColumn("_k", k)
    d = d.select("draw", (F.col("draw") % F.col("_k")).cast("int").alias("_c"), F.floor(F.col("draw") / F.col("_k")).alias("_t")).join(classes, "_c")
    return d.join(sizes, label).withColumn("_i", F.col("_t") % F.col("_n")).join(x.select(label, key, "_i"), [label, "_i"]).select("draw", label, key)


def reference_frames(frames: DataFrame, reach: int, count: int, seed: int = 0) -> DataFrame:
    """For each frame (video_id, frame_id): ``count`` other frames of its video within ``reach``, in order."""
    f, r = frames.select("video_id", "frame_id"), frames.select("video_id", F.col("frame_id").alias("ref_id"))
    near = f.select("*", F.explode(F.sequence(F.col("frame_id") - reach, F.col("frame_id") + reach)).alias("ref_id")).where("ref_id <> frame_id").join(r, ["video_id", "ref_id"])
    rank = F.row_number().over(Window.partitionBy("video_id", "frame_id").orderBy(draw(seed, "video_id", "frame_id", "ref_id"), "ref_id"))
    return near.withColumn("_r", rank).where(F.col("_r") <= count).groupBy("video_id", "frame_id").agg(F.sort_array(F.collect_list("ref_id")).alias("refs"))


def positives_and_negatives(assigned: DataFrame, n: int, share: float, most_negatives: float = -1, seed: int = 0) -> DataFrame:
    """``n`` assigned priors of each image: at most ``share`` positive, the rest background (at most ``most_negatives``
    for each positive), drawn without replacement."""
    quota = int(n * share)
    rank = F.row_number().over(Window.partitionBy("image_id", "state").orderBy(draw(seed, "image_id", "prior_id"), "prior_id"))
    x = assigned.where("state >= 0").withColumn("_r", rank)
    pos = x.where((F.col("state") == 1) & (F.col("_r") <= quota))
    counts = pos.groupBy("image_id").agg(F.count("*").alias("_p"))
    room = n - F.coalesce("_p", F.lit(0))
    if most_negatives >= 0:
        room = F.least(room, (most_negatives * F.greatest(F.coalesce("_p", F.lit(0)), F.lit(1))).cast("long"))
    neg = x.where("state = 0").join(counts, "image_id", "left").where(F.col("_r") <= room).drop("_p")
    return pos.unionByName(neg).drop("_r")


def balanced_by_instance(assigned: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """``n`` positives of each image, about the same number for each ground truth: ranks within ground truths first."""
    order = draw(seed, "image_id", "prior_id")
    x = assigned.where("state = 1").withColumn("_i", F.row_number().over(Window.partitionBy("gt_id").orderBy(order, "prior_id")))
    x = x.withColumn("_r", F.row_number().over(Window.partitionBy("image_id").orderBy("_i", order, "prior_id")))
    return x.where(F.col("_r") <= n).drop("_i", "_r")


def balanced_by_overlap(background: DataFrame, n: int, bins: int = 3, most: float = 0.5, seed: int = 0) -> DataFrame:
    """``n`` background priors (with ``iou``) of each image, spread over IoU bins: ranks within bins first."""
    order = draw(seed, "image_id", "prior_id")
    x = background.withColumn("_b", F.least(F.floor(F.col("iou") / most * bins), F.lit(bins - 1)))
    x = x.withColumn("_i", F.row_number().over(Window.partitionBy("image_id", "_b").orderBy(order, "prior_id")))
    x = x.withColumn("_r", F.row_number().over(Window.partitionBy("image_id").orderBy("_i", order, "prior_id")))
    return x.where(F.col("_r") <= n).drop("_b", "_i", "_r")


def grouped_batches(rows: DataFrame, counts: dict, n: int, source: str, group: str, key: str, seed: int = 0) -> DataFrame:
    """batch, ``group``, ``source``, place, ``key``: ``n`` batches, each of one group, drawn by the groups' sizes, with
    ``counts[source]`` rows of each source. A group's batches go round each source's rows of that group in drawn order."""
    x = numbered(rows.withColumn("_d", draw(seed, key)), ["_d", key], "_i", [group, source]).select(source, group, key, "_i")
    sizes = rows.groupBy(group, source).agg(F.count("*").alias("_n"))
    whole = sizes.groupBy(group).agg(F.sum("_n").alias("_s"))
    whole = whole.select(group, F.sum("_s").over(Window.orderBy(group)).alias("_hi"), "_s", F.sum("_s").over(Window.partitionBy()).alias("_all"))  # a row for each group
    b = rows.sparkSession.range(n).select(F.col("id").alias("batch")).withColumn("_u", draw(seed + 1, "batch"))
    b = b.join(F.broadcast(whole), (F.col("_u") * F.col("_all") >= F.col("_hi") - F.col("_s")) & (F.col("_u") * F.col("_all") < F.col("_hi"))).select("batch", group)
    b = numbered(b, ["batch"], "_t", [group])
    wanted = F.explode(F.array(*[F.struct(F.lit(s).alias("s"), F.lit(c).alias("c")) for s, c in counts.items() if c > 0]))
    b = b.select("*", wanted.alias("w")).select("batch", group, "_t", F.col("w.s").alias(source), F.col("w.c").alias("_c"))
    b = b.select("*", F.explode(F.sequence(F.lit(0), F.col("_c") - 1)).alias("place")).join(sizes, [group, source])
    b = b.withColumn("_i", (F.col("_t") * F.col("_c") + F.col("place")) % F.col("_n"))
    return b.join(x, [group, source, "_i"]).select("batch", group, source, "place", key)


def shuffled_frames(frames: DataFrame, workers: int, seed: int = 0) -> DataFrame:
    """video_id, frame_id, worker, place: all frames in drawn order, dealt round to ``workers``; the first ones come again
    at the end, so that all workers get as many."""
    x = numbered(frames.select("video_id", "frame_id").withColumn("_d", draw(seed, "video_id", "frame_id")), ["_d", "video_id", "frame_id"], "_i").drop("_d")
    total = x.agg(F.count("*")).scalar()
    x = x.withColumn("_n", total).withColumn("_all", F.ceil(F.col("_n") / workers) * workers)
    again = F.expr("filter(transform(sequence(0, cast(_all div _n as int)), k -> _i + k * _n), i -> i < _all)")
    x = x.select("video_id", "frame_id", F.explode(again).alias("_i"))
    return x.select("video_id", "frame_id", (F.col("_i") % workers).alias("worker"), F.floor(F.col("_i") / workers).alias("place"))


def frames_in_order(frames: DataFrame, workers: int) -> DataFrame:
    """video_id, frame_id, worker: whole videos in order, in ``workers`` runs whose numbers of videos differ by at most one."""
    v = numbered(frames.select("video_id").distinct(), ["video_id"], "_i")
    n = v.agg(F.count("*")).scalar()
    v = v.withColumn("_n", n).withColumn("_q", F.floor(F.col("_n") / workers)).withColumn("_r", F.col("_n") % workers)
    long = F.col("_r") * (F.col("_q") + 1)  # the first runs have one more
    worker = F.when(F.col("_i") < long, F.floor(F.col("_i") / (F.col("_q") + 1))).otherwise(F.col("_r") + F.floor((F.col("_i") - long) / F.greatest("_q", F.lit(1))))
    return frames.select("video_id", "frame_id").join(v.select("video_id", worker.alias("worker")), "video_id")
