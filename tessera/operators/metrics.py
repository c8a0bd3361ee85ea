"""Metrics over tables of ground truth and predictions."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.boxes import Box, intersection, iou
from .groups import dealt, walk_groups
from .matching import overlaps, pairs, running
from .suppress import ranked

#: False positives per image at which miss rates are averaged.
MISS_RATE_POINTS = (0.01, 0.0178, 0.0316, 0.0562, 0.1, 0.1778, 0.3162, 0.5623, 1.0)


def _best_pairs(counts: Sequence[int]):
    """For one image: IoU of each ground truth when the best remaining pair is taken out again and again."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        g = pdf[pdf["side"] == 1].sort_values("id")
        d = pdf[pdf["side"] == 0].sort_values(["score", "id"], ascending=[False, True])
        corners = ["x1", "y1", "x2", "y2"]
        rows = []
        for n in counts:
            o = overlaps(g[corners].to_numpy(), d[corners].to_numpy()[:n])
            for _ in range(len(g)):
                if not o.size:
                    rows.append((n, 0.0))
                    continue
                i, j = np.unravel_index(o.argmax(), o.shape)
                rows.append((n, float(o[i, j])))
                o[i, :] = -1
                o[:, j] = -1
        return pd.DataFrame(rows, columns=["top", "iou"])

    return run


def proposal_recall(det: DataFrame, gt: DataFrame, counts: Sequence[int] = (100, 300, 1000), thresholds: Sequence[float] = (0.5,)) -> DataFrame:
    """top, threshold, recall: proposals of an image against its ground truth, without classes."""
    corners = ["x1", "y1", "x2", "y2"]
    d = ranked(det, ["image_id"], max(counts)).select("image_id", F.lit(0).alias("side"), F.col("det_id").alias("id"), "score", *corners)
    g = gt.where("ignored = 0").select("image_id", F.lit(1).alias("side"), F.col("gt_id").alias("id"), F.lit(0.0).alias("score"), *corners)
    x = d.unionByName(g).groupBy("image_id").applyInPandas(_best_pairs(list(counts)), "top int, iou double")
    x = x.select("top", "iou", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold"))
    return x.groupBy("top", "threshold").agg(F.avg((F.col("iou") >= F.col("threshold")).cast("double")).alias("recall"))


def panoptic_quality(joint: DataFrame, gt: DataFrame, pred: DataFrame, void: int = 0) -> DataFrame:
    """category, tp, fp, fn, sum_iou. ``joint``: image_id, gt_id, pred_id, n (pixels or runs summed); ``gt``: image_id,
    gt_id, category, crowd; ``pred``: image_id, pred_id, category. A pair of one category matches over IoU 0.5, void not
    counted; predictions mostly on void or on a crowd of their category are not false."""
    j = joint.groupBy("image_id", "gt_id", "pred_id").agg(F.sum("n").alias("n"))
    g_area = j.groupBy("image_id", "gt_id").agg(F.sum("n").alias("gt_area"))
    on_void = F.sum(F.when(F.col("gt_id") == void, F.col("n")).otherwise(0))
    p_area = j.groupBy("image_id", "pred_id").agg(F.sum("n").alias("pred_area"), on_void.alias("on_void"))
    g, p = gt.join(g_area, ["image_id", "gt_id"]), pred.join(p_area, ["image_id", "pred_id"])
    m = j.join(g.where("crowd = 0"), ["image_id", "gt_id"]).join(p.withColumnRenamed("category", "pred_category"), ["image_id", "pred_id"]).where("category = pred_category")
    m = m.withColumn("iou", F.col("n") / (F.col("pred_area") + F.col("gt_area") - F.col("n") - F.col("on_void"))).where("iou > 0.5")
    tp = m.groupBy("category").agg(F.count("*").alias("tp"), F.sum("iou").alias("sum_iou"))
    fn = g.where("crowd = 0").join(m.select("image_id", "gt_id"), ["image_id", "gt_id"], "left_anti").groupBy("category").agg(F.count("*").alias("fn"))
    crowd = j.join(g.where("crowd = 1").select("image_id", "gt_id", "category"), ["image_id", "gt_id"]).groupBy("image_id", "pred_id", "category").agg(F.max_by("n", "gt_id").alias("on_crowd"))
    left = p.join(m.select("image_id", "pred_id"), ["image_id", "pred_id"], "left_anti").join(crowd, ["image_id", "pred_id", "category"], "left")
    fp = left.where((F.col("on_void") + F.coalesce("on_crowd", F.lit(0))) / F.col("pred_area") <= 0.5).groupBy("category").agg(F.count("*").alias("fp"))
    names = g.select("category").union(p.select("category")).distinct()
    out = names.join(tp, "category", "left").join(fp, "category", "left").join(fn, "category", "left")
    return out.select("category", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("tp", "fp", "fn")], F.coalesce("sum_iou", F.lit(0.0)).alias("sum_iou"))


def panoptic_summary(stats: DataFrame, things: Column) -> DataFrame:
    """part (All, Things, Stuff), pq, sq, rq, categories: means over categories that occur, times 100."""
    x = stats.where("tp + fp + fn > 0").withColumn("_d", F.col("tp") + F.col("fp") / 2 + F.col("fn") / 2)
    x = x.withColumn("pq", F.col("sum_iou") / F.col("_d")).withColumn("sq", F.coalesce(F.try_divide("sum_iou", "tp"), F.lit(0.0))).withColumn("rq", F.col("tp") / F.col("_d"))
    x = x.withColumn("part", F.explode(F.array(F.lit("All"), F.when(things, "Things").otherwise("Stuff"))))
    return x.groupBy("part").agg(*[(100 * F.avg(c)).alias(c) for c in ("pq", "sq", "rq")], F.count("*").alias("categories"))


def segmentation_scores(joint: DataFrame, ignore: int = 255, beta: float = 1.0) -> DataFrame:
    """label, iou, acc, dice, precision, recall, fscore (null where undefined). ``joint``: gt, pred, n."""
    x = joint.where(F.col("gt") != ignore)
    both = x.where("gt = pred").groupBy(F.col("gt").alias("label")).agg(F.sum("n").alias("i"))
    g, p = x.groupBy(F.col("gt").alias("label")).agg(F.sum("n").alias("g")), x.groupBy(F.col("pred").alias("label")).agg(F.sum("n").alias("p"))
    x = g.join(p, "label", "full").join(both, "label", "left").select("label", *[F.coalesce(c, F.lit(0)).alias(c) for c in "gpi"])
    prec, rec = F.try_divide(F.col("i"), F.col("p")), F.try_divide(F.col("i"), F.col("g"))
    x = x.withColumn("precision", prec).withColumn("recall", rec)
    f = F.try_divide((1 + beta**2) * F.col("precision") * F.col("recall"), beta**2 * F.col("precision") + F.col("recall"))
    return x.select("label", F.try_divide(F.col("i"), F.col("g") + F.col("p") - F.col("i")).alias("iou"), F.col("recall").alias("acc"), F.try_divide(2 * F.col("i"), F.col("g") + F.col("p")).alias("dice"), "precision", "recall", f.alias("fscore"))


def segmentation_summary(joint: DataFrame, ignore: int = 255) -> DataFrame:
    """One row: all-pixel accuracy and means over labels, times 100."""
    x = joint.where(F.col("gt") != ignore)
    overall = x.agg(F.try_divide(F.sum(F.when(F.col("gt") == F.col("pred"), F.col("n")).otherwise(0)), F.sum("n")).alias("a"))
    s = segmentation_scores(joint, ignore).agg(*[F.avg(c).alias(c) for c in ("iou", "acc", "dice", "fscore")])
    return s.select(F.round(100 * overall.scalar(), 2).alias("a_acc"), *[F.round(100 * F.col(c), 2).alias(f"m_{c}") for c in ("iou", "acc", "dice", "fscore")])


#: Distances nearer than this are one: sums of squares may differ in their last bits.
NEAR = 1e-9


#: Positives, with a distance and a count each, that a block of queries may have in all (16 bytes each).
POSITIVES = 1 << 23
#: Rows of the gallery that a block of queries is compared with at once, and most queries of a block.
AT_ONCE, QUERIES = 1 << 14, 512


#: Stands for a null label, which equals none.
NO_LABEL = -(1 << 63)


def _packed(rows: int, kind: type):
    """Rows of a gallery as blocks of at most ``rows``: ids, labels and vectors as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                ids, labels = (part.column(c).cast(pa.int64()).fill_null(NO_LABEL).to_numpy() for c in ("vec_id", "label"))
                x = part.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(kind)
                yield pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in (ids, labels, x)], ["ids", "labels", "x"])

    return run


def _apart(q: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of ``q`` and ``k``: by products where their rounding is far below ``NEAR``, else by
    differences."""
    a, b = (q**2).sum(1), (k**2).sum(1)
    if len(k) and (a.max() + b.max()) * q.shape[1] * 1e-15 < NEAR:
        return np.maximum(a[:, None] + b[None] - 2 * (q @ k.T), 0)
    return np.stack([((k - v) ** 2).sum(1) for v in q])


def _places(kind: type):
    """ap and the place of the first positive of each query of a block, whose rows meet the gallery twice: at first its own
    label's rows give the positives' distances, then those of other labels are counted. A task holds one block of queries, the
    distances of their positives, and some blocks of the gallery."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, seen, total = None, 0, 0
        ids = x = far = nearer = None
        found: list[list[np.ndarray]] = []
        waiting: list[tuple[np.ndarray, np.ndarray]] = []

        def done() -> pa.RecordBatch:
            some = [i for i, f in enumerate(far) if len(f)]
            places = [np.arange(1, len(far[i]) + 1) + nearer[i] for i in some]
            ap = [float((np.arange(1, len(p) + 1) / p).mean()) for p in places]
            return pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(ap, pa.float64()), pa.array([int(p[0]) for p in places], pa.int64())], ["vec_id", "ap", "first"])

        def compare(turn: int) -> None:
            """Queries with the rows of the gallery that wait: many at once, as a look at all positives follows."""
            if waiting:
                other, y = (np.concatenate(v) for v in zip(*waiting, strict=True))
                waiting.clear()
                for at in range(0, len(ids), 64):
                    for j, d in enumerate(_apart(x[at : at + 64], y), at):
                        if turn == 0:
                            found[j].append(d[other != ids[j]])
                        elif len(far[j]):
                            d.sort()
                            nearer[j] += np.searchsorted(d, far[j])

        def finished() -> None:
            if now is not None and seen != total:
                raise RuntimeError(f"a block of queries met {seen} of {total} rows")

        for batch in batches:
            c = {n: batch.column(n) for n in batch.schema.names}
            for i in range(batch.num_rows):
                key = tuple(c[n][i].as_py() for n in ("label", "q_block", "turn"))
                if key != now:
                    finished()
                    if now is not None and now[2] == 1:
                        yield done()
                    now, seen, total = key, 0, c["total"][i].as_py()
                    if key[2] == 0:
                        ids = np.array(c["q_ids"][i].as_py(), np.int64)
                        x = c["q"][i].values.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(ids), -1)
                        found = [[] for _ in ids]
                    else:
                        far = [np.sort(np.concatenate(f)) - NEAR if f else np.zeros(0) for f in found]
                        nearer, found = [np.zeros(len(f), np.int64) for f in far], []
                other, labels = (np.frombuffer(c[n][i].as_buffer(), np.int64) for n in ("ids", "labels"))
                y = np.frombuffer(c["x"][i].as_buffer(), kind).reshape(len(other), -1)
                seen += len(other)
                own = labels == key[0]
                take = own if key[2] == 0 else ~own
                if take.any():
                    waiting.append((other[take], y[take].astype(float)))
                if seen == total or sum(len(v) for v, _ in waiting) >= AT_ONCE:
                    compare(key[2])
        finished()
        if now is not None:
            yield done()

    return run


#: Cells of equal width that squared distances are counted in, rows of the gallery that are compared and counted at once, and at most so
#: many queries of a block (8 bytes for each of their cells).
CELLS, COUNTED, COUNTING = 1 << 15, 1 << 16, 256
#: Queries and rows whose distances are computed in one product: they stay in the cache.
TILE = 64, 1 << 9


class _Counted:
    """A block of queries while the gallery passes: of each query its positives and the others counted by cells of distance, the nearest
    positive, and the ``most`` nearest others. A task holds these and ``COUNTED`` rows of the gallery of each kind.

    Positives are counted ``NEAR`` nearer than they are, as at equal distances they come first. So an other of a lower cell is nearer than
    a positive, one of a higher cell is not, and only the order within a cell is not known."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, longest: float, most: int) -> None:
        a, n = (x**2).sum(1), len(ids)
        widest = (np.sqrt(a.max()) + np.sqrt(longest)) ** 2 + 2 * NEAR
        scale = (CELLS - 3) / widest
        # products that are not exact enough, or cells that are too narrow, tell nothing
        self.known = bool((a.max() + longest) * (x.shape[1] + 2) * 1e-15 < NEAR and NEAR * scale < 0.5)
        self.ids, self.seen, self.waiting = ids, 0, {True: [], False: []}
        other = np.hstack([-2 * scale * x, scale * a[:, None] + 1, np.full((n, 1), scale)])  # times (row, 1, its square): the cell
        own = other.copy()
        own[:, -2] -= NEAR * scale
        self.sides = {True: own, False: other}
        self.cells = {k: np.zeros((n, CELLS), np.int32) for k in (True, False)}
        self.nearest, self.least = np.full(n, float(CELLS)), np.full((n, most), np.inf)

    def add(self, own: bool, ids: np.ndarray, x: np.ndarray) -> None:
        self.waiting[own].append((ids, x))
        if sum(len(v) for v, _ in self.waiting[own]) >= COUNTED:
            self.count(own)

    def count(self, own: bool) -> None:
        if not self.waiting[own]:
            return
        ids, rows = (np.concatenate(v) for v in zip(*self.waiting[own], strict=True))
        self.waiting[own], sides = [], self.sides[own]
        x = np.ones((len(ids), rows.shape[1] + 2))
        x[:, :-2] = rows
        x[:, -1] = np.einsum("ij,ij->i", x[:, :-2], x[:, :-2])
        of = np.zeros((TILE[0], len(ids)), np.int32)
        self_q = self_at = np.zeros(0, int)
        if own:  # a query is no positive of its own
            order = np.argsort(ids, kind="stable")
            first, last = (np.searchsorted(ids, self.ids, side, sorter=order) for side in ("left", "right"))
            self_q = np.repeat(np.arange(len(self.ids)), last - first)
            self_at = order[np.concatenate([np.arange(a, b) for a, b in zip(first.tolist(), last.tolist(), strict=True)]).astype(int)]
        for q in range(0, len(self.ids), TILE[0]):
            some = slice(q, q + TILE[0])
            n = len(self.ids[some])
            for at in range(0, len(ids), TILE[1]):
                d = sides[some] @ x[at : at + TILE[1]].T
                if own:
                    hit = (self_q >= q) & (self_q < q + n) & (self_at >= at) & (self_at < at + TILE[1])
                    d[self_q[hit] - q, self_at[hit] - at] = CELLS
                    np.minimum(self.nearest[some], d.min(axis=1), out=self.nearest[some])
                else:
                    nearer = d < self.least[some, -1:]
                    for j in np.flatnonzero(nearer.any(axis=1)).tolist():
                        self.least[q + j] = np.sort(np.concatenate([self.least[q + j], d[j, nearer[j]]]))[: self.least.shape[1]]
                of[:n, at : at + TILE[1]] = d
            for j in range(n):
                self.cells[own][q + j] += np.bincount(of[j], minlength=CELLS + 1)[:CELLS].astype(np.int32)

    def bounds(self) -> pa.RecordBatch:
        """Least and greatest ap of each query with a positive, and the place of the first one as far as ``most``."""
        for own in (True, False):
            self.count(own)
        out = []
        for own, others, nearest, least in zip(self.cells[True], self.cells[False], self.nearest, self.least, strict=True):
            used = np.flatnonzero(own)
            if not len(used):
                continue
            to = np.cumsum(others, dtype=np.int64)[used]
            i = np.arange(1, int(own[used].sum()) + 1)
            below, upto = (np.repeat(v, own[used]) for v in (to - others[used], to))
            out.append(((i / (i + upto)).mean() if self.known else 0.0, (i / (i + below)).mean() if self.known else 1.0, int(np.count_nonzero(least < nearest)) + 1))
        lo, hi, first = zip(*out, strict=True) if out else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(lo, pa.float64()), pa.array(hi, pa.float64()), pa.array(first, pa.int64())], ["lo", "hi", "first"])


def _bounds(kind: type, most: int):
    """What ``_Counted`` tells of each block of queries, whose rows meet the gallery once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, block, total = None, None, 0
        for batch in batches:
            c = {n: batch.column(n) for n in batch.schema.names}
            for i in range(batch.num_rows):
                key = c["label"][i].as_py(), c["q_block"][i].as_py()
                if key != now:
                    if block is not None:
                        raise RuntimeError(f"a block of queries met {block.seen} of {total} rows")
                    now, total = key, c["total"][i].as_py()
                    ids = np.array(c["q_ids"][i].as_py(), np.int64)
                    block = _Counted(ids, c["q"][i].values.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(ids), -1), c["longest"][i].as_py(), most)
                other, labels = (np.frombuffer(c[n][i].as_buffer(), np.int64) for n in ("ids", "labels"))
                x = np.frombuffer(c["x"][i].as_buffer(), kind).reshape(len(other), -1)
                own = labels == key[0]
                for side in (True, False):
                    if (own == side).any():
                        block.add(side, other[own == side], x[own == side])
                block.seen += len(other)
                if block.seen == total:
                    yield block.bounds()
                    block = None
        if block is not None:
            raise RuntimeError(f"a block of queries met {block.seen} of {total} rows")

    return run


def reid(features: DataFrame, block: int = 2048, ranks: Sequence[int] = (1, 5, 10)) -> DataFrame:
    """One row: mAP and cumulative match at ``ranks`` of every row (vec_id, label, embedding) against all others.

    All rows are compared with all, by definition of the measure, and no pair leaves its task. Queries are dealt in blocks of
    one label; the gallery is read again for each task, in blocks of ``block`` rows, not shuffled. What is shuffled is thus each row
    once, and a row for each query. At equal distances rows of the query's label come first.

    Distances are counted by cells, which bounds each query's ap; the matches at ``ranks`` are exact. Where both bounds of the mean
    round to the same number, that is the mAP. Where they do not, all distances are put in order, in blocks of at most about
    ``QUERIES`` rows and ``POSITIVES`` positives in all: the least that a task can hold is then one query with the distances of its
    positives.
    """
    x = features.select("vec_id", "label", "embedding")
    kind = np.float32 if features.schema["embedding"].dataType.elementType.simpleString() == "float" else np.float64
    square = F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v.cast("double") * v)
    n = x.groupBy("label").agg(F.count("*").alias("_n"), F.max(square).alias("_longest"))
    gallery = x.coalesce(1).mapInArrow(_packed(block, kind), "ids binary, labels binary, x binary")

    def blocks(of: DataFrame, rows: Column) -> DataFrame:
        q = of.where("label is not null").join(n.drop("_longest"), "label").withColumn("q_block", F.pmod(F.xxhash64("vec_id", "label"), F.ceil(F.col("_n") / rows).cast("long")))
        q = dealt(q, ["label", "q_block"]).groupBy("label", "q_block").agg(F.collect_list(F.struct("vec_id", "embedding")).alias("b"))
        q = q.select("label", "q_block", F.transform("b", lambda v: v["vec_id"]).alias("q_ids"), F.transform("b", lambda v: v["embedding"]).alias("q"))
        return q.withColumn("total", n.agg(F.sum("_n")).scalar())

    def met(q: DataFrame) -> DataFrame:  # a task's queries pass its reading of the gallery one after the other
        return q.crossJoin(gallery.hint("shuffle_replicate_nl"))

    counting = blocks(x, F.lit(min(block, COUNTING))).withColumn("longest", n.agg(F.max("_longest")).scalar())
    per = met(counting).mapInArrow(_bounds(kind, max(ranks)), "lo double, hi double, first long")
    lo, hi = F.round(F.avg("lo") - 1e-12, 3), F.round(F.avg("hi") + 1e-12, 3)  # sums of many are not exact
    found = per.agg(F.struct(lo.alias("map"), lo.eqNullSafe(hi).alias("known"), *[F.round(F.avg((F.col("first") <= r).cast("double")), 3).alias(f"r{r}") for r in ranks]).alias("s")).scalar()
    rest = blocks(x.where(~found["known"]), F.greatest(F.least(F.floor(F.lit(POSITIVES) / F.col("_n")), F.lit(min(block, QUERIES))), F.lit(1)))
    rest = rest.withColumn("turn", F.explode(F.array(F.lit(0), F.lit(1)))).sortWithinPartitions("label", "q_block", "turn")
    exact = met(rest).mapInArrow(_places(kind), "vec_id long, ap double, first long").agg(F.round(F.avg("ap"), 3).alias("exact"))
    return exact.select(F.coalesce("exact", found["map"]).alias("map"), *[found[f"r{r}"].alias(f"r{r}") for r in ranks])


def _column(v: int | Column) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def trapezoid_ap(matched: DataFrame, total: int | Column) -> DataFrame:
    """One row ``ap``: area under precision over recall by trapezoids between consecutive detections.

    The step from recall 0 to the first detection is not counted (published numbers depend on it).
    """
    x = running(matched.withColumn("_all", F.lit(0)), ["_all"])
    a, b, t = F.col("cum_tp"), F.col("cum_fp"), _column(total)
    a0, b0 = a - F.col("tp"), b - F.col("fp")
    ratio = lambda u, v: F.coalesce(F.try_divide(u, u + v), F.lit(0.0))
    step = F.when(a0 + b0 > 0, F.col("tp") / t * (ratio(a, b) + ratio(a0, b0)) / 2).otherwise(0.0)
    return x.agg(F.coalesce(F.sum(step), F.lit(0.0)).alias("ap"))


def miss_rate(matched: DataFrame, total: int | Column, images: int | Column, points: Sequence[float] = MISS_RATE_POINTS) -> DataFrame:
    """One row ``mr``: geometric mean of miss rates at reference false positives per image: that of the first detection
    which reaches the reference, or else of the last one."""
    x = running(matched.withColumn("_all", F.lit(0)), ["_all"])
    x = x.select((F.col("cum_fp") / _column(images)).alias("fppi"), (1 - F.col("cum_tp") / _column(total)).alias("miss"), "score", "det_id")
    order = F.struct(-F.col("score"), "det_id")
    least = [F.coalesce(F.min_by("miss", F.when(F.col("fppi") >= p, order)), F.max_by("miss", order)).alias(f"m{i}") for i, p in enumerate(points)]
    x = x.agg(*least).select(F.explode(F.array(*[f"m{i}" for i in range(len(points))])).alias("miss"))
    none = F.max((F.col("miss") <= 0).cast("int")) == 1
    return x.agg(F.when(none, 0.0).otherwise(F.exp(F.avg(F.ln(F.greatest("miss", F.lit(1e-300)))))).alias("mr"))


def topk_recall(det: DataFrame, gt: DataFrame, ks: Sequence[int] = (1, 5, 10), threshold: float = 0.5) -> DataFrame:
    """k, n, recall: share of (image, label) phrases with a ground truth that one of the first k detections overlaps."""
    d = ranked(det, ["image_id", "label"], max(ks))
    best = pairs(d, gt).select("image_id", "label", "rank", "iou", F.explode(F.array(*[F.lit(k) for k in ks])).alias("k")).where("rank <= k").groupBy("image_id", "label", "k").agg(F.max("iou").alias("iou"))
    phrases = gt.select("image_id", "label").distinct().withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks])))
    x = phrases.join(best, ["image_id", "label", "k"], "left")
    return x.groupBy("k").agg(F.count("*").alias("n"), F.avg((F.coalesce("iou", F.lit(0.0)) >= threshold).cast("double")).alias("recall"))


def referring_segmentation(areas: DataFrame) -> DataFrame:
    """One row: cumulative and mean IoU times 100 of rows (inter, uni); 0 / 0 counts as 0."""
    return areas.agg((100 * F.try_divide(F.sum("inter"), F.sum("uni"))).alias("c_iou"), (100 * F.avg(F.coalesce(F.try_divide("inter", "uni"), F.lit(0.0)))).alias("m_iou"))


def confusion(det: DataFrame, gt: DataFrame, background: int, score_threshold: float = 0.0, threshold: float = 0.5) -> DataFrame:
    """gt_label, pred_label, n, percent of the row. Every overlapped ground truth counts; a detection without one is
    background taken for its class, a ground truth without a detection of its class is its class taken for background."""
    d = det.where(F.col("score") >= score_threshold)
    p = pairs(d, gt, by_label=False).where(F.col("iou") >= threshold)
    hits = p.select(F.col("gt_label"), F.col("label").alias("pred_label"))
    ghosts = d.join(p.select("det_id").distinct(), "det_id", "left_anti").select(F.lit(background).cast("long").alias("gt_label"), F.col("label").alias("pred_label"))
    missed = gt.join(p.where("gt_label = label").select("gt_id").distinct(), "gt_id", "left_anti").select(F.col("label").alias("gt_label"), F.lit(background).cast("long").alias("pred_label"))
    n = hits.union(ghosts).union(missed).groupBy("gt_label", "pred_label").agg(F.count("*").alias("n"))
    return n.withColumn("percent", 100 * F.col("n") / F.sum("n").over(Window.partitionBy("gt_label")))


def occluded_recall(det: DataFrame, gt: DataFrame, score_threshold: float = 0.3, threshold: float = 0.75) -> DataFrame:
    """One row: share times 100 of ground truths that some detection of their class covers at both thresholds."""
    hit = pairs(det.where(F.col("score") >= score_threshold), gt).where(F.col("iou") >= threshold).select("gt_id").distinct().withColumn("hit", F.lit(1))
    return gt.join(hit, "gt_id", "left").agg((100 * F.avg(F.coalesce("hit", F.lit(0)))).alias("recall"))


def robustness(results: DataFrame, clean: int = 0, benchmark: Sequence[int] = tuple(range(15))) -> DataFrame:
    """metric, p, mpc, rpc. ``results``: corruption, severity, metric, value. The mean is over the whole grid of the
    benchmark's corruptions and severities 1 to 5; absent cells count as 0, as the published protocol does."""
    p = F.max(F.when(F.col("severity") == clean, F.col("value")))
    cells = F.sum(F.when((F.col("severity") > 0) & F.col("corruption").isin(list(benchmark)), F.col("value")).otherwise(0.0))
    x = results.groupBy("metric").agg(p.alias("p"), (cells / (5.0 * len(benchmark))).alias("mpc"))
    return x.withColumn("rpc", F.try_divide("mpc", "p"))


def box_intersections(det: DataFrame, gt: DataFrame) -> DataFrame:
    """Rows (det_id, gt_id, inter, uni) of one image and label."""
    d, g = Box.named("d_"), Box.named("g_")
    return pairs(det, gt).select("det_id", "gt_id", intersection(d, g).alias("inter"), (d.area + g.area - intersection(d, g)).alias("uni"))


JACCARD_SCORES = tuple(i / 10 for i in range(10))


def _growing_pairs(near: np.ndarray, upto: Sequence[int]) -> Iterator[dict[int, int]]:
    """Maximum matchings of columns to the first ``upto`` (not falling) rows of a boolean table, by augmenting paths."""
    row_of: dict[int, int] = {}
    of = [np.flatnonzero(r).tolist() for r in near]

    def found(start: int) -> bool:
        """Looks for a path from a row to a column without one, depth first, and turns it."""
        seen: set[int] = set()
        way, at = [start], [iter(of[start])]
        taken: list[int] = []
        while way:
            j = next((j for j in at[-1] if j not in seen), None)
            if j is None:
                way.pop(), at.pop()
                if taken:
                    taken.pop()
                continue
            seen.add(j)
            taken.append(j)
            if j not in row_of:
                for i, c in zip(way, taken, strict=True):
                    row_of[c] = i
                return True
            way.append(row_of[j])
            at.append(iter(of[row_of[j]]))
        return False

    done = 0
    for n in upto:
        for i in range(done, n):
            found(i)
        done = n
        yield row_of


def _most_pairs(near: np.ndarray) -> dict[int, int]:
    """A maximum matching of columns to rows of a boolean table."""
    return next(_growing_pairs(near, [len(near)]))


def _jaccard(threshold: float, scores: Sequence[float]):
    def share(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of each box of ``a`` the largest share that lies in a box of ``b``."""
        if not len(a) or not len(b):
            return np.zeros(len(a))
        w = np.clip(np.minimum(a[:, None, 2:], b[None, :, 2:]) - np.maximum(a[:, None, :2], b[None, :, :2]), 0, None)
        return (w.prod(2) / np.maximum((a[:, 2:] - a[:, :2]).prod(1), 1e-6)[:, None]).max(1)

    def run(table: pa.Table, groups: list[tuple[int, int]]) -> pa.Table:
        """Detections of an image come best first, so those over a threshold are its first ones, and a matching of them is
        the start of that of more."""
        boxes = np.stack([table.column(c).to_numpy() for c in ("x1", "y1", "x2", "y2")], axis=1).astype(float)
        side, ignored, every = (table.column(c).to_numpy() for c in ("side", "ignored", "score"))
        falling, rows = sorted(scores, reverse=True), []
        for start, end in groups:
            cut = start + int(np.searchsorted(side[start:end], 1))
            det, gt, kind, score = boxes[start:cut], boxes[cut:end], ignored[cut:end], every[start:cut]
            real, out = gt[kind == 0], gt[kind != 0]
            det_out, real_out = share(det, out) > threshold, share(real, out) > threshold
            upto = [int((score > s).sum()) for s in falling]
            for s, n_det, row_of in zip(falling, upto, _growing_pairs(overlaps(det, real) >= threshold, upto), strict=True):
                free_d, free_g = np.ones(n_det, bool), np.ones(len(real), bool)
                free_d[list(row_of.values())], free_g[list(row_of)] = False, False
                m, n, k = len(real) - int((real_out & free_g).sum()), n_det - int((det_out[:n_det] & free_d).sum()), len(row_of)
                rows.append((float(s), k, m, n, k / (m + n - k + 1e-6)))
        return pa.table(dict(zip(("threshold", "k", "m", "n", "ratio"), map(pa.array, zip(*rows, strict=True)), strict=True)))

    return run


def jaccard_index(det: DataFrame, gt: DataFrame, threshold: float = 0.5, scores: Sequence[float] = JACCARD_SCORES) -> DataFrame:
    """One row ``ji``: the best score threshold's mean over images of matched boxes over all boxes of both sides.

    Per image a maximum one-to-one matching at ``threshold``; unmatched boxes that lie in ignored regions do not count.
    Images without any counted box are left out of the mean. A group holds the boxes of one image.
    """
    corners = ["x1", "y1", "x2", "y2"]
    x = det.select("image_id", F.lit(0).alias("side"), "score", F.lit(0).alias("ignored"), *corners)
    x = x.union(gt.select("image_id", F.lit(1), F.lit(0.0), F.col("ignored").cast("int"), *corners))
    per = walk_groups(x, ["image_id"], ["side", F.desc("score"), *corners], _jaccard(threshold, scores), "threshold double, k long, m long, n long, ratio double")
    means = per.groupBy("threshold").agg((F.sum("ratio") / F.greatest(F.sum(((F.col("m") != 0) | (F.col("n") != 0)).cast("int")), F.lit(1))).alias("mean"))
    return means.agg(F.coalesce(F.max("mean"), F.lit(0.0)).alias("ji"))


def _nearest_first(table: pa.Table, groups: list[tuple[int, int]]) -> pa.Table:
    """How many pairs of each image are left when each, the nearest first, takes both its boxes out."""
    pred, gt = table.column("pred_id").to_numpy(), table.column("gt_id").to_numpy()
    images, hits = table.column("image_id").take(pa.array([a for a, _ in groups], pa.int64())), []
    for a, b in groups:
        used, seen = set(), set()
        for p, g in zip(pred[a:b].tolist(), gt[a:b].tolist(), strict=True):
            if p not in used and g not in seen:
                used.add(p)
                seen.add(g)
        hits.append(len(used))
    return pa.Table.from_arrays([images, pa.array(hits, pa.int64())], ["image_id", "tp"])


def grounded_f1(pred: DataFrame, gt: DataFrame, threshold: float = 0.5, least_score: float = 0.7, least_f1: float = 1.0) -> DataFrame:
    """One row: f1_score (share of expressions whose F1 is at least ``least_f1``), t_acc and n_acc (share of those with and
    without a target that were told from the others).

    An expression is an image_id. ``pred``: image_id, pred_id, score, corners; ``gt``: image_id, gt_id, corners and
    no_target (1: a row that says that there is nothing to find). Boxes are paired by overlap, the greatest first."""
    p = pred.where(F.col("score") >= least_score)
    a, b = Box.named("p_"), Box.named()
    wanted = gt.groupBy("image_id").agg(F.count("*").alias("n_gt"), F.max("no_target").alias("none"))
    named = p.select("image_id", "pred_id", *[F.col(c).alias(f"p_{c}") for c in ("x1", "y1", "x2", "y2")])
    near = named.join(gt.where("no_target = 0"), "image_id").withColumn("iou", iou(a, b)).where(F.col("iou") >= threshold)
    tp = walk_groups(near.select("image_id", "iou", "pred_id", "gt_id"), ["image_id"], [F.desc("iou"), "pred_id", "gt_id"], _nearest_first, "image_id long, tp long")
    found = p.groupBy("image_id").agg(F.count("*").alias("n_pred"))
    x = wanted.join(found, "image_id", "left").join(tp, "image_id", "left").na.fill(0, ["n_pred", "tp"])
    some = F.col("n_pred") > 0
    f1 = F.when(F.col("none") == 1, F.when(some, 0.0).otherwise(1.0)).otherwise(2 * F.col("tp") / (F.col("n_pred") + F.col("n_gt")))
    share = lambda hit, of: F.try_divide(F.sum(hit.cast("int")), F.sum(of.cast("int")))
    target = F.col("none") == 0
    return x.agg((F.sum((f1 >= least_f1).cast("int")) / F.greatest(F.count("*"), F.lit(1))).alias("f1_score"), share(target & some, target).alias("t_acc"), share(~target & ~some, ~target).alias("n_acc"))


def _crowd_walk(threshold: float):
    def run(table: pa.Table, groups: list[tuple[int, int]]) -> pa.Table:
        side, real = table.column("side").to_numpy(), table.column("real").to_numpy() == 1
        boxes = np.stack([table.column(c).to_numpy() for c in ("x1", "y1", "x2", "y2")], axis=1)
        kept, hits = [], []
        for a, b in groups:
            cut = a + int(np.searchsorted(side[a:b], 1))
            d, g = boxes[a:cut], boxes[cut:b]
            n = int(real[cut:b].sum())  # those that count come first
            o = overlaps(d, g[:n])
            w = np.clip(np.minimum(d[:, None, 2:], g[None, n:, 2:]) - np.maximum(d[:, None, :2], g[None, n:, :2]), 0, None)
            under = (w.prod(2) / np.maximum((d[:, 2:] - d[:, :2]).prod(1), 1e-6)[:, None] > threshold).any(1)
            free = np.ones(n, bool)
            for i in range(len(d)):
                j = int(np.where(free, o[i], -1.0).argmax()) if n else -1
                hit = j >= 0 and free[j] and o[i, j] > threshold
                if hit:
                    free[j] = False
                elif under[i]:
                    continue
                kept.append(a + i)
                hits.append(int(hit))
        out = table.select(["det_id", "image_id", "score"]).take(pa.array(kept, pa.int64()))
        return out.append_column("tp", pa.array(hits, pa.int32()))

    return run


def crowd_matches(det: DataFrame, gt: DataFrame, threshold: float = 0.5) -> DataFrame:
    """det_id, image_id, score, tp: detections of images, the best first, each on the free ground truth that it overlaps
    most by more than ``threshold``. One that finds none and of which more than ``threshold`` lies in an ignored box is left
    out. ``gt``: image_id, gt_id, corners, ignored."""
    corners = ["x1", "y1", "x2", "y2"]
    d = det.select("image_id", F.lit(0).alias("side"), F.lit(0).alias("real"), "det_id", "score", *corners)
    g = gt.select("image_id", F.lit(1), (F.col("ignored") == 0).cast("int"), "gt_id", F.lit(0.0), *corners)
    return walk_groups(d.union(g), ["image_id"], ["side", F.desc("real"), F.desc("score"), "det_id"], _crowd_walk(threshold), "det_id long, image_id long, score double, tp int")
