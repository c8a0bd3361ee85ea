"""Summaries over IoU thresholds, size ranges and detections per unit: the twelve COCO values, LVIS and video instances.

A unit is an image or a video. Units and labels are matched apart, each by a greedy walk over its own boxes, which a
camera frame or a clip bounds; IoUs are computed before by a join, and only pairs over the lowest threshold go into the
walk. The walk's results are a row for each detection, with a bit for each size range and threshold. These rows are dealt by
class and score cell once, and read there twice: for sums of cells, from which each cell learns what came before it, and for
the curves. Both reads pass over sorted Arrow batches, so no task holds a class or a cell as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.boxes import Box, iou
from .groups import walk_groups

THRESHOLDS = tuple(0.5 + 0.05 * i for i in range(10))
#: Size ranges by area: all, small, medium, large; images and videos.
AREAS = ((0.0, 1e10), (0.0, 32.0**2), (32.0**2, 96.0**2), (96.0**2, 1e10))
VIDEO_AREAS = ((0.0, 1e10), (0.0, 128.0**2), (128.0**2, 256.0**2), (256.0**2, 1e10))
_DET, _GT, _PAIR, _LENIENT = 0, 1, 2, 3
#: ``tp`` and ``fp``: bit area * len(THRESHOLDS) + t.
_MATCHED = "label long, det_id long, score double, place int, tp long, fp long"


def _find(rows: np.ndarray, ids: np.ndarray, group: np.ndarray, other: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each (``others``, ``other``): the place in ``rows`` with this group and id, and whether there is one."""
    known, code = np.unique(np.concatenate([ids[rows], other]), return_inverse=True)
    key = np.concatenate([group[rows], others]) * len(known) + code
    order = np.argsort(key[: len(rows)], kind="stable")
    own, key = key[: len(rows)][order], key[len(rows) :]
    at = np.searchsorted(own, key)
    if not len(own):
        return at, np.zeros(len(key), bool)
    at = np.minimum(at, len(own) - 1)
    return order[at], own[at] == key


def _matched(of: np.ndarray, to: np.ndarray, value: np.ndarray, place: np.ndarray, crowd: np.ndarray, skip: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Greedy matching of many units and labels at every size range and threshold at once: (hit, counted) of each detection.

    Pairs: detection ``of`` overlaps ground truth ``to`` by ``value``. ``place`` of each detection in its unit and label:
    those of one place belong to different ones, and so are matched in one step. ``skip``: (ground truth, range). At each
    range and threshold a detection takes, of what is free (crowds always are), what counts before what does not, then the
    greatest overlap, then the last."""
    n, areas = skip.shape
    taken = np.zeros((n, areas, len(limits)), bool)
    hit, counted = np.zeros((len(place), areas, len(limits)), bool), np.zeros((len(place), areas, len(limits)), bool)
    if not len(of):
        return hit, counted
    order = np.lexsort((to, value, of, place[of]))
    of, to, value = of[order], to[order], value[order]
    steps = np.flatnonzero(np.diff(place[of], prepend=-1))
    for start, end in zip(steps, [*steps[1:], len(of)], strict=True):
        d, j = of[start:end], to[start:end]
        first = np.flatnonzero(np.diff(d, prepend=-1))
        length = np.diff(first, append=len(d))
        at = np.repeat(first, length)
        free = (value[start:end, None, None] >= limits) & (crowd[j][:, None, None] | ~taken[j])
        rank = np.where(free, ((np.arange(len(d)) - at)[:, None] + np.repeat(length, length)[:, None] * ~skip[j])[:, :, None], -1)
        best = np.maximum.reduceat(rank, first, axis=0)
        i, a, t = np.nonzero(best >= 0)
        best = j[first[i] + best[i, a, t] % length[i]]
        taken[best, a, t] = True
        hit[d[first[i]], a, t] = True
        counted[d[first[i]], a, t] = ~skip[best, a]
    return hit, counted


def _walk(thresholds: Sequence[float], areas: Sequence[tuple[float, float]], most: int | None):
    """Matched detections of units and labels, as ``_MATCHED``."""
    limits, lows, highs = np.minimum(np.array(thresholds), 1 - 1e-10), np.array([a for a, _ in areas]), np.array([b for _, b in areas])
    weights = np.left_shift(np.int64(1), np.arange(len(areas) * len(limits)))
    outside = lambda size: (size[:, None] < lows) | (size[:, None] > highs)
    bits = lambda x: (x.reshape(len(x), len(weights)) * weights).sum(axis=1)

    def run(table: pa.Table, groups: list[tuple[int, int]]) -> pa.Table:
        c = {n: table.column(n).to_numpy() for n in ("label", "side", "id", "other", "value", "area", "crowd", "ignored")}
        starts = np.array([a for a, _ in groups])
        group = np.repeat(np.arange(len(groups)), [b - a for a, b in groups])
        place = np.arange(len(group)) - starts[group]  # detections come first, the best before others
        d = np.flatnonzero((c["side"] == _DET) & (place < (most if most is not None else len(group))))
        g, p = np.flatnonzero(c["side"] == _GT), np.flatnonzero(c["side"] == _PAIR)
        crowd = c["crowd"][g] == 1
        skip = outside(c["area"][g]) | (crowd | (c["ignored"][g] == 1))[:, None]
        of, known = _find(d, c["id"], group, c["id"][p], group[p])
        to, there = _find(g, c["id"], group, c["other"][p], group[p])
        known &= there
        hit, counted = _matched(of[known], to[known], c["value"][p[known]], place[d], crowd, skip, limits)
        off = outside(c["area"][d]) | np.isin(group[d], group[c["side"] == _LENIENT])[:, None]
        columns = [c["label"][d], c["id"][d], c["value"][d], place[d].astype(np.int32), bits(counted), bits(~hit & ~off[:, :, None])]
        return pa.table(dict(zip([f.split()[0] for f in _MATCHED.split(", ")], columns, strict=True)))

    return run


def _counted(gt: DataFrame, areas: Sequence[tuple[float, float]]) -> DataFrame:
    """label, area, num_gts of ground truth that counts."""
    ok = lambda low, high: (F.col("ignored") == 0) & (F.col("crowd") == 0) & (F.col("area") >= low) & (F.col("area") <= high)
    sums = gt.groupBy("label").agg(F.array(*[F.sum(ok(low, high).cast("int")) for low, high in areas]).alias("n"))
    return sums.select("label", F.posexplode("n").alias("area", "num_gts")).where("num_gts > 0")


def evaluate(det: DataFrame, gt: DataFrame, near: DataFrame, areas=AREAS, most: int | None = 100, lenient: DataFrame | None = None) -> DataFrame:
    """Matched detections: label, det_id, score, place (within unit and label), and tp and fp, a bit for each of ``areas`` and threshold.

    ``det`` (unit, label, det_id, score, area), ``gt`` (unit, label, gt_id, area, ignored, crowd), ``near`` (unit, label,
    det_id, gt_id, iou). ``lenient`` (unit, label): there unmatched detections count as nothing.
    """
    if len(areas) * len(THRESHOLDS) > 63:
        raise ValueError("tp and fp have room for six size ranges")
    zero, none = F.lit(0), F.lit(0).cast("long")
    rows = [
        det.select("unit", F.col("label").cast("long"), F.lit(_DET).alias("side"), F.col("det_id").alias("id"), none.alias("other"), F.col("score").cast("double").alias("value"), F.col("area").cast("double"), zero.alias("crowd"), zero.alias("ignored"), zero.alias("lenient")),
        gt.select("unit", F.col("label").cast("long"), F.lit(_GT), "gt_id", none, F.lit(0.0), F.col("area").cast("double"), F.col("crowd").cast("int"), F.col("ignored").cast("int"), zero),
        near.where(F.col("iou") >= THRESHOLDS[0]).select("unit", F.col("label").cast("long"), F.lit(_PAIR), "det_id", "gt_id", "iou", F.lit(0.0), zero, zero, zero),
    ]
    if lenient is not None:
        rows.append(lenient.select("unit", F.col("label").cast("long"), F.lit(_LENIENT), none, none, F.lit(0.0), F.lit(0.0), zero, zero, F.lit(1)))
    order = ["side", F.desc("value"), "id"]  # detections by score, ground truth by id
    return walk_groups(reduce(DataFrame.union, rows), ["unit", "label"], order, _walk(THRESHOLDS, areas, most), _MATCHED)


def _steps(counts: DataFrame) -> DataFrame:
    """``counts`` for each threshold."""
    return counts.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(len(THRESHOLDS) - 1))))


def _by_cell(matched: DataFrame, cells: int = 1024) -> DataFrame:
    """``matched`` dealt by class and score cell; every reader takes all columns, so that Spark deals the rows once."""
    return matched.select("label", F.floor(F.col("score") * cells).cast("long").alias("cell"), "det_id", "score", "place", "tp", "fp").repartition("label", "cell")


def _in_cell() -> list:
    return ["label", "cell", F.desc("score"), "det_id"]


def _bits(x: np.ndarray, width: int) -> np.ndarray:
    return (x[:, None] >> np.arange(width)) & 1


def _new(*keys: np.ndarray) -> np.ndarray:
    """Where a row's keys are not those of the row before."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return np.flatnonzero(new)


def _lists(x: np.ndarray) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(x.ravel().astype(np.int64)), x.shape[1]).cast(pa.list_(pa.int64()))


def sums(matched: DataFrame, areas: int = len(AREAS), most: Sequence[int] = ()) -> DataFrame:
    """label, cell, score and det_id of a cell's best detection, n_tp and n_fp (arrays over ranges and thresholds), and
    n_first: n_tp of the first m detections of a unit, for each m of ``most``. A cell may have several rows."""
    width = areas * len(THRESHOLDS)
    names = ["label", "cell", "score", "det_id", "n_tp", "n_fp", "n_first"]

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            c = {n: batch.column(n).to_numpy() for n in ("label", "cell", "score", "det_id", "place", "tp", "fp")}
            at = _new(c["label"], c["cell"])
            tp = _bits(c["tp"], width)
            add = lambda x: np.add.reduceat(x, at, axis=0)
            first = np.concatenate([np.zeros((len(at), 0), np.int64), *[add(tp * (c["place"] < m)[:, None]) for m in most]], axis=1)  # noqa: B023
            arrays = [*[pa.array(c[n][at]) for n in names[:4]], _lists(add(tp)), _lists(add(_bits(c["fp"], width))), _lists(first) if most else pa.array([[]] * len(at), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, names)

    schema = "label long, cell long, score double, det_id long, n_tp array<long>, n_fp array<long>, n_first array<long>"
    return _by_cell(matched).sortWithinPartitions(*_in_cell()).mapInArrow(added, schema)


def _before(width: int):
    """For each class and cell, its best detection and the sums of all better cells."""

    def run(table: pa.Table, groups: list[tuple[int, int]]) -> pa.Table:
        c = {n: table.column(n).to_numpy() for n in ("label", "cell", "det_id")}
        own = [np.stack(table.column(n).to_numpy(zero_copy_only=False)).reshape(-1, width) for n in ("n_tp", "n_fp")]
        at = _new(c["label"], c["cell"])
        starts = np.searchsorted(at, [a for a, _ in groups])
        own = [np.add.reduceat(x, at, axis=0) for x in own]
        out = []
        for x in own:
            before = np.cumsum(x, axis=0) - x
            out.append(before - np.repeat(before[starts], np.diff([*starts, len(at)]), axis=0))
        return pa.table({"label": c["label"][at], "cell": c["cell"][at], "best": c["det_id"][at], "b_tp": _lists(out[0]), "b_fp": _lists(out[1])})

    return run


def _curves(areas: int):
    """label, area, t, k, p: the greatest precision among detections that reach the first k recalls and no more."""
    steps = len(THRESHOLDS)
    width = areas * steps

    def reached(i: np.ndarray, rc: np.ndarray) -> np.ndarray:
        # recall i / 100 is reached if i * 0.01 <= recall, in floating point; the last is exactly 1
        return np.where(i >= 100, 1.0, i * 0.01) <= rc

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total, num = None, [np.zeros(width, np.int64)] * 2, np.zeros(areas, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            c = {n: batch.column(n).to_numpy() for n in ("label", "cell", "tp", "fp")}
            at = _new(c["label"], c["cell"])
            on = now == (c["label"][0], c["cell"][0])  # the cell goes on
            given = [batch.column(n).take(pa.array(at[1:] if on else at)).flatten().to_numpy().reshape(-1, w) for n, w in (("b_tp", width), ("b_fp", width), ("num_gts", areas))]
            before = [np.concatenate([x[None], y]) if on else y for x, y in zip([*total, num], given, strict=True)]
            length = np.diff(at, append=batch.num_rows)
            own = [_bits(c[n], width) for n in ("tp", "fp")]
            cum = []
            for x, b in zip(own, before[:2], strict=True):
                s = np.cumsum(x, axis=0)
                cum.append(s + np.repeat(b - (s[at] - x[at]), length, axis=0))
            now, total, num = (c["label"][-1], c["cell"][-1]), [x[-1] for x in cum], before[2][-1]
            row, j = np.nonzero(own[0])  # between true ones precision only falls
            n = np.repeat(before[2], length, axis=0)[row, j // steps]
            row, j, n = row[n > 0], j[n > 0], n[n > 0]
            tp, fp = cum[0][row, j], cum[1][row, j]
            rc, pr = tp / n, tp / (tp + fp)
            k = np.floor(rc * 100).astype(np.int64)
            k = np.where((k < 100) & reached(k + 1, rc), k + 2, np.where(reached(k, rc), k + 1, k))
            label = c["label"][row]
            order = np.lexsort((k, j, label))
            if not len(order):
                continue
            label, j, k, pr = label[order], j[order], k[order], pr[order]
            first = _new(label, j, k)
            arrays = [label[first], (j[first] // steps).astype(np.int32), (j[first] % steps).astype(np.int32), k[first].astype(np.int32), np.maximum.reduceat(pr, first)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], ["label", "area", "t", "k", "p"])

    return run


def precisions(matched: DataFrame, counts: DataFrame, added: DataFrame | None = None, areas: int = len(AREAS)) -> DataFrame:
    """label, area, t (index of the threshold), ap: mean of the precision envelope at recalls 0, 0.01, ..., 1.
    ``added``: ``sums`` of ``matched``, if at hand."""
    added = sums(matched, areas) if added is None else added
    before = walk_groups(added, ["label"], [F.desc("cell"), F.desc("score"), "det_id"], _before(areas * len(THRESHOLDS)), "label long, cell long, best long, b_tp array<long>, b_fp array<long>")
    nums = counts.groupBy(F.col("label").cast("long").alias("label")).agg(F.array(*[F.coalesce(F.sum(F.when(F.col("area") == i, F.col("num_gts"))), F.lit(0)).cast("long") for i in range(areas)]).alias("num_gts"))
    before = before.join(nums, "label")  # a row for each class and cell
    x = _by_cell(matched).join(before, ["label", "cell"])
    best = F.col("det_id") == F.col("best")  # only a cell's first row brings what was before
    x = x.select("label", "cell", "det_id", "score", "place", "tp", "fp", *[F.when(best, F.col(c)).alias(c) for c in ("b_tp", "b_fp", "num_gts")])
    x = x.sortWithinPartitions(*_in_cell()).mapInArrow(_curves(areas), "label long, area int, t int, k int, p double")
    by = ["label", "area", "t"]
    tops = x.groupBy(*by, "k").agg(F.max("p").alias("p")).where("k > 0")  # at most 101 rows each
    w = Window.partitionBy(*by).orderBy("k")
    tops = tops.withColumn("top", F.max("p").over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing))).withColumn("n", F.col("k") - F.coalesce(F.lag("k").over(w), F.lit(0)))
    ap = tops.groupBy(*by).agg((F.sum(F.col("top") * F.col("n")) / 101).alias("ap"))
    return _steps(counts).join(ap, by, "left").select(*by, F.coalesce("ap", F.lit(0.0)).alias("ap"))


def recalls(added: DataFrame, counts: DataFrame, most: Sequence[int], areas: int = len(AREAS)) -> DataFrame:
    """label, area, t, and r_m for each m of ``most``: recall of the first m detections of each unit; ``added``: ``sums``."""
    steps = len(THRESHOLDS)
    width = areas * steps
    x = added.select("label", F.posexplode("n_first").alias("i", "n")).withColumn("j", F.col("i") % width)
    total = x.groupBy("label", F.floor(F.col("j") / steps).cast("int").alias("area"), (F.col("j") % steps).alias("t")).agg(*[F.sum(F.when(F.floor(F.col("i") / width) == i, F.col("n"))).alias(f"s_{m}") for i, m in enumerate(most)])
    x = _steps(counts).join(total, ["label", "area", "t"], "left")
    return x.select("label", "area", "t", *[(F.coalesce(f"s_{m}", F.lit(0)) / F.col("num_gts")).alias(f"r_{m}") for m in most])


def _mean(value: Column, where: Column) -> Column:
    """Mean over classes and thresholds, -1 without any."""
    return F.coalesce(F.avg(F.when(where, value)), F.lit(-1.0))


def _image_tables(det: DataFrame, gt: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    b = Box.named()
    own = lambda t: F.col("area") if "area" in t.columns else b.area
    flag = lambda t, c: F.col(c) if c in t.columns else F.lit(0)
    d = det.select(F.col("image_id").alias("unit"), "label", "det_id", "score", b.area.alias("area"), *[F.col(c).alias(f"d_{c}") for c in ("x1", "y1", "x2", "y2")])
    g = gt.select(F.col("image_id").alias("unit"), "label", "gt_id", own(gt).alias("area"), flag(gt, "ignored").alias("ignored"), flag(gt, "crowd").alias("crowd"), *[F.col(c).alias(f"g_{c}") for c in ("x1", "y1", "x2", "y2")])
    p, q = Box.named("d_"), Box.named("g_")
    inter = F.greatest(F.least(p.x2, q.x2) - F.greatest(p.x1, q.x1), F.lit(0.0)) * F.greatest(F.least(p.y2, q.y2) - F.greatest(p.y1, q.y1), F.lit(0.0))
    value = F.when(F.col("crowd") == 1, inter / F.greatest(p.area, F.lit(1e-12))).otherwise(iou(p, q))
    return d, g, d.drop("area").join(g.drop("area"), ["unit", "label"]).select("unit", "label", "det_id", "gt_id", value.alias("iou"))


def _summary(ap: DataFrame, ar: DataFrame, most: Sequence[int]) -> DataFrame:
    area, t = F.col("area"), F.col("t")
    names = ("map", "map_50", "map_75", "map_s", "map_m", "map_l")
    which = [area == 0, (area == 0) & (t == 0), (area == 0) & (t == 5), *[area == i for i in (1, 2, 3)]]
    left = ap.agg(*[_mean(F.col("ap"), w).alias(n) for n, w in zip(names, which, strict=True)])
    last = f"r_{most[-1]}"
    right = ar.agg(*[_mean(F.col(f"r_{m}"), area == 0).alias(f"ar_{m}") for m in most], *[_mean(F.col(last), area == i).alias(f"ar_{s}") for i, s in ((1, "s"), (2, "m"), (3, "l"))])
    return left.withColumn("_r", right.select(F.struct("*")).scalar()).select("*", "_r.*").drop("_r")


def coco_summary(det: DataFrame, gt: DataFrame, most: Sequence[int] = (1, 10, 100), by_class: bool = False) -> DataFrame:
    """One row: map, map_50, map_75, map_s, map_m, map_l, ar_1, ar_10, ar_100, ar_s, ar_m, ar_l (-1: no ground truth).

    ``det`` and ``gt`` as for ``matching``; ``gt`` may have ``crowd`` and ``area`` (of its mask). ``by_class``: label, map,
    map_50, map_75 instead.
    """
    d, g, near = _image_tables(det, gt)
    matched, counts = evaluate(d, g, near, most=most[-1]), _counted(g, AREAS)
    added = sums(matched, most=() if by_class else most)
    ap = precisions(matched, counts, added)
    if by_class:
        t = F.col("t")
        return ap.where("area = 0").groupBy("label").agg(F.avg("ap").alias("map"), F.max(F.when(t == 0, F.col("ap"))).alias("map_50"), F.max(F.when(t == 5, F.col("ap"))).alias("map_75"))
    return _summary(ap, recalls(added, counts, most), most)


def split_summary(det: DataFrame, gt: DataFrame, splits: DataFrame, most: Sequence[int] = (1, 10, 100)) -> DataFrame:
    """split, ap, ap50: means over the classes with ground truth of each split (label, split), such as seen and new
    classes, or expressions by length; -1 without any."""
    d, g, near = _image_tables(det, gt)
    ap = precisions(evaluate(d, g, near, areas=AREAS[:1], most=most[-1]), _counted(g, AREAS[:1]), areas=1)
    x = splits.join(ap, "label", "left")  # a row for each class, split and threshold
    some = F.col("ap").isNotNull()
    return x.groupBy("split").agg(_mean(F.col("ap"), some).alias("ap"), _mean(F.col("ap"), some & (F.col("t") == 0)).alias("ap50"))


def lvis_summary(det: DataFrame, gt: DataFrame, images: DataFrame, frequency: DataFrame, most: int | None = 300, most_in_class: int | None = None) -> DataFrame:
    """One row: ap, ap50, ap75, aps, apm, apl, and apr, apc, apf by ``frequency`` (label, frequency: r, c or f).

    ``images`` (image_id, negative, not_exhaustive: arrays of labels). A class is judged on images that have it or are
    known not to; where it is not annotated exhaustively, unmatched detections count as nothing. ``most`` detections of an
    image over all classes; with ``most_in_class`` (then ``most`` is usually None) those of a class over all images.
    """
    x = det
    if most is not None:
        x = x.withColumn("_n", F.row_number().over(Window.partitionBy("image_id").orderBy(F.desc("score"), "det_id"))).where(F.col("_n") <= most).drop("_n")
    if most_in_class is not None:
        x = _top_of_class(x, most_in_class)
    judged = gt.select("image_id", "label").union(images.select("image_id", F.explode("negative"))).distinct()
    d, g, near = _image_tables(x.join(judged, ["image_id", "label"], "left_semi"), gt)
    lenient = images.select(F.col("image_id").alias("unit"), F.explode("not_exhaustive").alias("label")).distinct()
    lenient = lenient.join(d.select("unit", "label").distinct(), ["unit", "label"], "left_semi")
    counts = _counted(g, AREAS)
    ap = precisions(evaluate(d, g, near, most=None, lenient=lenient), counts).join(frequency, "label", "left")  # a row for each class
    area, t = F.col("area"), F.col("t")
    which = {"ap": area == 0, "ap50": (area == 0) & (t == 0), "ap75": (area == 0) & (t == 5), "aps": area == 1, "apm": area == 2, "apl": area == 3}
    which |= {f"ap{f}": (area == 0) & (F.col("frequency") == f) for f in ("r", "c", "f")}
    return ap.agg(*[_mean(F.col("ap"), w).alias(n) for n, w in which.items()])


def _top_of_class(det: DataFrame, most: int, cells: int = 1024) -> DataFrame:
    """The ``most`` best detections of each class. Cells of scores are counted first; only the cell that the limit falls
    in is ranked."""
    cell = F.floor(F.col("score") * cells).cast("long")
    counts = det.groupBy("label", cell.alias("_cell")).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("label").orderBy(F.desc("_cell")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("label", "_cell", before.alias("_before"), "n").where(F.col("_before") < most)
    x = det.withColumn("_cell", cell).join(counts, ["label", "_cell"])
    whole = x.where(F.col("_before") + F.col("n") <= most)
    rank = F.row_number().over(Window.partitionBy("label").orderBy(F.desc("score"), "det_id"))
    part = x.where(F.col("_before") + F.col("n") > most).withColumn("_r", rank).where(F.col("_before") + F.col("_r") <= most)
    return whole.select(det.columns).union(part.select(det.columns))


def video_summary(pred: DataFrame, gt: DataFrame, most: Sequence[int] = (1, 10, 100)) -> DataFrame:
    """The values of ``coco_summary`` for tracks (video_id, track_id, label, frame_id, corners; ``pred`` with score).

    The IoU of two tracks is the sum of intersections over the sum of unions of all their frames; a track's size is its
    mean area. ``track_id`` is unique within a video; equal scores are ranked by a hash of both ids. The score of a predicted track is its mean.
    """
    b = Box.named()

    def tracks(t: DataFrame, name: str, *more: Column) -> DataFrame:
        return t.groupBy(F.col("video_id").alias("unit"), "label", F.xxhash64("video_id", "track_id").alias(name)).agg(F.avg(b.area).alias("area"), F.sum(b.area).alias("total"), *more)

    d = tracks(pred, "det_id", F.avg("score").alias("score"))
    g = tracks(gt, "gt_id").withColumn("ignored", F.lit(0)).withColumn("crowd", F.lit(0))
    frame = ["video_id", "frame_id", "label"]
    p = pred.select(*frame, F.xxhash64("video_id", "track_id").alias("det_id"), *[F.col(c).alias(f"d_{c}") for c in ("x1", "y1", "x2", "y2")])
    q = gt.select(*frame, F.xxhash64("video_id", "track_id").alias("gt_id"), *[F.col(c).alias(f"g_{c}") for c in ("x1", "y1", "x2", "y2")])
    u, v = Box.named("d_"), Box.named("g_")
    inter = F.greatest(F.least(u.x2, v.x2) - F.greatest(u.x1, v.x1), F.lit(0.0)) * F.greatest(F.least(u.y2, v.y2) - F.greatest(u.y1, v.y1), F.lit(0.0))
    met = p.join(q, frame).groupBy(F.col("video_id").alias("unit"), "label", "det_id", "gt_id").agg(F.sum(inter).alias("inter"))
    met = met.join(d.select("unit", "label", "det_id", F.col("total").alias("d_total")), ["unit", "label", "det_id"]).join(g.select("unit", "label", "gt_id", F.col("total").alias("g_total")), ["unit", "label", "gt_id"])
    near = met.select("unit", "label", "det_id", "gt_id", (F.col("inter") / (F.col("d_total") + F.col("g_total") - F.col("inter"))).alias("iou"))
    matched, counts = evaluate(d, g, near, areas=VIDEO_AREAS, most=most[-1]), _counted(g, VIDEO_AREAS)
    added = sums(matched, len(VIDEO_AREAS), most)
    return _summary(precisions(matched, counts, added, len(VIDEO_AREAS)), recalls(added, counts, most, len(VIDEO_AREAS)), most)
