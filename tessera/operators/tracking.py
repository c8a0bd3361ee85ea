"""Tracking by keyed state over frames, repair of tracks, and tracking metrics.

A video's frames are walked in order as batches pass (or, in ``tessera.streaming``, by state between batches).
``Tracker`` holds what a video needs: Kalman states of its live tracks, bounded by the objects on screen.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .assign import pair_edges, solve
from .groups import walk_frames
from .matching import overlaps

CORNERS = ("x1", "y1", "x2", "y2")
#: A cost that no sum of others reaches.
NEVER = 1e6
#: 95 % quantiles of chi-squared with 1 to 9 degrees of freedom.
CHI2_95 = (3.8415, 5.9915, 7.8147, 9.4877, 11.070, 12.592, 14.067, 15.507, 16.919)


_DIAGONAL = np.arange(8)


class Kalman:
    """Constant velocity over (centre x, centre y, ratio, height) and their speeds; noise grows with the height."""

    position, velocity = 1 / 20, 1 / 160

    def start(self, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p, v = self.position * z[3], self.velocity * z[3]
        return np.concatenate([z, np.zeros(4)]), np.diag(np.square([2 * p, 2 * p, 1e-2, 2 * p, 10 * v, 10 * v, 1e-5, 10 * v]))

    def predict(self, m: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next state of one track, or of a stack of them: positions take on their speeds."""
        noise = np.empty_like(m)
        noise[..., :4], noise[..., 4:] = self.position * m[..., 3:4], self.velocity * m[..., 3:4]
        noise[..., 2], noise[..., 6] = 1e-2, 1e-5
        m, c = m.copy(), c.copy()
        m[..., :4] += m[..., 4:]
        c[..., :4, :] += c[..., 4:, :]
        c[..., :, :4] += c[..., :, 4:]
        c[..., _DIAGONAL[:8], _DIAGONAL[:8]] += noise * noise
        return m, c

    def predict_all(self, tracks: list[dict]) -> None:
        """Moves the states of many tracks at once."""
        if tracks:
            for t, m, c in zip(tracks, *self.predict(np.array([t["m"] for t in tracks]), np.array([t["c"] for t in tracks])), strict=True):
                t["m"], t["c"] = m, c

    def project(self, m: np.ndarray, c: np.ndarray, confidence: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        noise = np.repeat(self.position * m[..., 3:4], 4, axis=-1)
        noise[..., 2] = 1e-1
        noise *= 1 - confidence
        zc = c[..., :4, :4].copy()
        zc[..., _DIAGONAL[:4], _DIAGONAL[:4]] += noise * noise
        return m[..., :4], zc

    def update(self, m: np.ndarray, c: np.ndarray, z: np.ndarray, confidence: float | np.ndarray = 0.0) -> tuple[np.ndarray, np.ndarray]:
        """The state after an observation, of one track or of a stack of them (``confidence`` then may be a column)."""
        zm, zc = self.project(m, c, confidence)
        gain = np.swapaxes(np.linalg.solve(zc, c[..., :4, :]), -1, -2)
        return m + (gain @ (z - zm)[..., None])[..., 0], c - gain @ zc @ np.swapaxes(gain, -1, -2)

    def update_all(self, tracks: list[dict], zs: np.ndarray, confidence: float | np.ndarray = 0.0) -> None:
        """Corrects the states of many tracks at once."""
        if tracks:
            for t, m, c in zip(tracks, *self.update(np.array([t["m"] for t in tracks]), np.array([t["c"] for t in tracks]), zs, confidence), strict=True):
                t["m"], t["c"] = m, c

    def gate(self, m: np.ndarray, c: np.ndarray, zs: np.ndarray, center_only: bool = False) -> np.ndarray:
        """Squared Mahalanobis distances of observations from one track, or from each of a stack of them."""
        zm, zc = self.project(m, c)
        k = 2 if center_only else 4
        low = np.linalg.cholesky(zc[..., :k, :k])
        d = np.linalg.solve(low, np.swapaxes(zs[:, :k] - zm[..., None, :k], -1, -2))
        return (d * d).sum(-2)


def to_state(b: np.ndarray) -> np.ndarray:
    w, h = b[..., 2] - b[..., 0], b[..., 3] - b[..., 1]
    return np.stack([(b[..., 0] + b[..., 2]) / 2, (b[..., 1] + b[..., 3]) / 2, w / np.maximum(h, 1e-9), h], axis=-1)


def to_box(z: np.ndarray) -> np.ndarray:
    w, h = z[..., 2] * z[..., 3], z[..., 3]
    return np.stack([z[..., 0] - w / 2, z[..., 1] - h / 2, z[..., 0] + w / 2, z[..., 1] + h / 2], axis=-1)


@dataclass
class Rules:
    """high, low: score bands (strictly over); start: score that opens a track; match: least IoU in the high, tentative and
    low stage; tentative: hits that confirm a track; keep: frames that a lost track lives; weigh: IoU times score."""

    high: float = 0.6
    low: float = 0.1
    start: float = 0.7
    match: tuple[float, float, float] = (0.1, 0.3, 0.5)
    tentative: int = 3
    keep: int = 30
    weigh: bool = True


@dataclass
class Tracker:
    """Two-band association of one video: confident detections first, then tentative tracks, then weak detections."""

    rules: Rules = field(default_factory=Rules)
    tracks: dict[int, dict] = field(default_factory=dict)
    next_id: int = 0
    last_frame: int = -1
    kalman: Kalman = field(default_factory=Kalman)

    def _stage(self, ids: list[int], boxes: np.ndarray, labels: np.ndarray, scores: np.ndarray, least: float, weigh: bool) -> list[tuple[int, int]]:
        if not ids or not len(boxes):
            return []
        o = overlaps(to_box(np.array([self.tracks[i]["m"] for i in ids])), boxes)
        o = o * scores[None] if weigh else o
        o = np.where(np.array([self.tracks[i]["label"] for i in ids])[:, None] == labels[None], o, 0.0)
        cost = np.where(o >= least, 1 - o, 1e6)
        return [(ids[r], int(c)) for r, c in zip(*solve(cost), strict=True) if cost[r, c] < 1e6]

    def step(self, frame: int, boxes: np.ndarray, labels: np.ndarray, scores: np.ndarray, embeds: np.ndarray | None = None) -> np.ndarray:
        """Track id of each detection of a frame (-1: none); appearances are not looked at. Frames not after the last one are late and get no ids."""
        out = np.full(len(boxes), -1, np.int64)
        if frame <= self.last_frame:
            return out
        self.last_frame = frame
        r = self.rules
        for t in self.tracks.values():
            if t["last"] < frame - 1:
                t["m"][7] = 0.0
        self.kalman.predict_all(list(self.tracks.values()))
        sure, weak = np.flatnonzero(scores > r.high), np.flatnonzero((scores > r.low) & (scores <= r.high))
        confirmed = [i for i, t in self.tracks.items() if t["sure"]]
        open_ = [i for i, t in self.tracks.items() if not t["sure"]]
        pairs = [(i, sure[c]) for i, c in self._stage(confirmed, boxes[sure], labels[sure], scores[sure], r.match[0], r.weigh)]
        taken = {d for _, d in pairs}
        left = np.array([d for d in sure if d not in taken], int)
        pairs += [(i, left[c]) for i, c in self._stage(open_, boxes[left], labels[left], scores[left], r.match[1], r.weigh)]
        met = {i for i, _ in pairs}
        rest = [i for i in confirmed if i not in met and self.tracks[i]["last"] == frame - 1]
        pairs += [(i, weak[c]) for i, c in self._stage(rest, boxes[weak], labels[weak], scores[weak], r.match[2], False)]
        self.kalman.update_all([self.tracks[i] for i, _ in pairs], to_state(boxes[[d for _, d in pairs]]))
        for i, d in pairs:
            t = self.tracks[i]
            t["last"], t["hits"] = frame, t["hits"] + 1
            t["sure"] = t["sure"] or t["hits"] >= r.tentative
            out[d] = i
        for d in sure:
            if out[d] < 0 and scores[d] > r.start:
                m, c = self.kalman.start(to_state(boxes[d]))
                self.tracks[self.next_id] = {"m": m, "c": c, "label": labels[d], "last": frame, "hits": 1, "sure": self.next_id == 0 or frame == 0}
                out[d] = self.next_id
                self.next_id += 1
        self.tracks = {i: t for i, t in self.tracks.items() if frame - t["last"] < r.keep and (t["sure"] or t["last"] == frame)}
        return out


def track(det: DataFrame, rules: Rules | None = None) -> DataFrame:
    """``det`` (video_id, frame_id, det_id, label, score, corners) with track_id (-1: not tracked)."""
    from .trackers import walk

    own = rules or Rules()
    return walk(det, lambda _: Tracker(own))


def interpolate(tracks: DataFrame, least_frames: int = 5, most_gap: int = 20, shortest: int = 2) -> DataFrame:
    """Tracks of more than ``shortest`` frames, with gaps under ``most_gap`` filled by straight lines (score 1) where the
    track has more than ``least_frames``."""
    w = Window.partitionBy("video_id", "track_id").orderBy("frame_id")
    n = F.count("*").over(Window.partitionBy("video_id", "track_id"))
    x = tracks.withColumn("_n", n).where(F.col("_n") > shortest)
    x = x.withColumn("_next", F.lead("frame_id").over(w)).withColumns({f"_{c}": F.lead(c).over(w) for c in CORNERS})
    gap = F.col("_next") - F.col("frame_id")
    own = x.select("video_id", "track_id", "frame_id", *CORNERS, "score", F.lit(0).alias("filled"))
    y = x.where((F.col("_n") > least_frames) & (gap > 1) & (gap < most_gap)).withColumn("f", F.explode(F.sequence(F.col("frame_id") + 1, F.col("_next") - 1)))
    share = (F.col("f") - F.col("frame_id")) / gap
    filled = y.select("video_id", "track_id", F.col("f").alias("frame_id"), *[(F.col(c) + (F.col(f"_{c}") - F.col(c)) * share).alias(c) for c in CORNERS], F.lit(1.0).alias("score"), F.lit(1).alias("filled"))
    return own.unionByName(filled)


def link_candidates(tracks: DataFrame, gap: tuple[int, int] = (0, 30), distance: float = 75.0) -> DataFrame:
    """first, second: tracks of a video of which the second starts soon after, and near, where the first ends."""
    b = tracks.groupBy("video_id", "track_id").agg(F.min(F.struct("frame_id", *CORNERS)).alias("s"), F.max(F.struct("frame_id", *CORNERS)).alias("e"))
    a, c = b.select("video_id", F.col("track_id").alias("first"), "e"), b.select("video_id", F.col("track_id").alias("second"), "s")
    d = F.sqrt(((F.col("s.x1") + F.col("s.x2") - F.col("e.x1") - F.col("e.x2")) / 2) ** 2 + ((F.col("s.y1") + F.col("s.y2") - F.col("e.y1") - F.col("e.y2")) / 2) ** 2)
    x = a.join(c, "video_id").where(F.col("first") != F.col("second")).withColumn("gap", F.col("s.frame_id") - F.col("e.frame_id")).withColumn("distance", d)
    return x.where((F.col("gap") > gap[0]) & (F.col("gap") < gap[1]) & (F.col("distance") < distance)).select("video_id", "first", "second", "gap", "distance")


def cosine(x: Column, y: Column) -> Column:
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(x, y), F.sqrt(dot(x, x) * dot(y, y)))


def _compared(batches):
    """Cosines of a block of queries with a block of keys."""
    for pdf in batches:
        for q, x, k, y in zip(pdf["q_ids"], pdf["q"], pdf["k_ids"], pdf["k"], strict=True):
            x, y = np.array(x.tolist(), float).reshape(len(q), -1), np.array(y.tolist(), float).reshape(len(k), -1)
            sizes = np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(y, axis=1)[None]
            c = np.divide(x @ y.T, sizes, out=np.full(sizes.shape, np.nan), where=sizes > 0)
            yield pd.DataFrame({"a_id": np.repeat(np.asarray(q), len(k)), "b_id": np.tile(np.asarray(k), len(q)), "cosine": c.ravel()})


def similarities(queries: DataFrame, keys: DataFrame, rows: int = 512) -> DataFrame:
    """a_id, b_id, cosine of each query (vec_id, embedding) with each key: blocks of ``rows`` rows meet blocks.

    Both sides are cut into blocks of about ``rows`` rows by hash, so no block grows with the data; the result has all
    pairs, as the queries are a stated set. A vector without length has a null cosine.
    """

    def blocks(t: DataFrame, name: str) -> tuple[DataFrame, int]:
        n = max(1, -(-t.count() // rows))
        x = t.where("embedding is not null").groupBy(F.pmod(F.xxhash64("vec_id"), F.lit(n)).alias(f"{name}_block"))
        return x.agg(F.collect_list(F.struct("vec_id", "embedding")).alias("b")).select(f"{name}_block", F.transform("b", lambda v: v["vec_id"]).alias(f"{name}_ids"), F.transform("b", lambda v: v["embedding"]).alias(name)), n

    (q, many), (k, _) = blocks(queries, "q"), blocks(keys, "k")
    sent = k.withColumn("q_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(many - 1).cast("long"))))  # each block to every block of queries
    out = sent.join(q, "q_block").select("q_ids", "q", "k_ids", "k").mapInPandas(_compared, "a_id long, b_id long, cosine double")
    return out.withColumn("cosine", F.when(F.isnan("cosine"), None).otherwise(F.col("cosine")))


#: Pairs of tracks that a video's counts take before they are summed.
PAIRS = 1 << 17


@dataclass
class Identity:
    """Counts of one video, frame by frame: matches, switches, and how long each pair of tracks goes together.

    A frame's pairs of the frame before are kept where they still overlap enough; the rest is matched by overlap. What it
    holds grows with the pairs of tracks that ever overlap (three numbers each), not with frames."""

    key: dict[str, object]
    threshold: float
    counts: dict[str, int] = field(default_factory=lambda: dict.fromkeys(("tp", "fp", "fn", "switches", "gt", "pred"), 0))
    together: np.ndarray = field(default_factory=lambda: np.zeros((3, 0), np.int64))
    lately: tuple[list[int], list[int]] = field(default_factory=lambda: ([], []))
    last: dict[int, int] = field(default_factory=dict)

    def step(self, rows: dict[str, np.ndarray]) -> None:
        order = np.argsort(rows["track_id"], kind="stable")
        side, track = rows["side"][order], rows["track_id"][order]
        boxes = np.stack([rows[c][order] for c in CORNERS], axis=1).astype(float)
        o = overlaps(boxes[side == 1], boxes[side == 0])
        near = np.nonzero(o >= self.threshold)
        self.count(track[side == 1].tolist(), track[side == 0].tolist(), *(v.tolist() for v in near), (1 - o[near]).tolist())

    def count(self, gi: list[int], pi: list[int], rows: list[int], cols: list[int], apart: list[float]) -> None:
        """A frame: tracks of both sides, and the places of pairs that overlap enough, with how much they do not."""
        last, edges = self.last, [[] for _ in gi]
        gts, preds = self.lately
        for r, c, d in zip(rows, cols, apart, strict=True):
            g, p = gi[r], pi[c]
            gts.append(g)
            preds.append(p)
            edges[r].append((d - NEVER - 1000 if last.get(g) == p else d - NEVER, c))  # as many pairs as there can be
        hits = pair_edges(edges)
        switches = 0
        for c, r in hits.items():
            g = gi[r]
            switches += last.get(g, pi[c]) != pi[c]
            last[g] = pi[c]
        n = self.counts
        n["tp"] += len(hits)
        n["fn"] += len(gi) - len(hits)
        n["fp"] += len(pi) - len(hits)
        n["switches"] += switches
        n["gt"] += len(gi)
        n["pred"] += len(pi)
        if len(gts) >= max(PAIRS, self.together.shape[1]):
            self._sum()

    def _sum(self) -> None:
        x = np.hstack([self.together, np.array([*self.lately, np.ones(len(self.lately[0]), np.int64)], np.int64).reshape(3, -1)])
        self.lately = ([], [])
        x = x[:, np.lexsort(x[1::-1])]
        starts = np.flatnonzero(np.r_[True, (x[:2, 1:] != x[:2, :-1]).any(0)]) if x.shape[1] else np.zeros(0, int)
        self.together = np.vstack([x[:2, starts], np.add.reduceat(x[2], starts)]) if len(starts) else x

    def end(self) -> pd.DataFrame:
        self._sum()
        (gids, g), (pids, p) = (np.unique(v, return_inverse=True) for v in self.together[:2])
        table = np.zeros((len(gids), len(pids)))
        table[g, p] = self.together[2]
        rows, cols = solve(-table)
        return pd.DataFrame([{**self.key, **self.counts, "idtp": int(table[rows, cols].sum()) if table.size else 0}])


COUNTS = ("tp", "fp", "fn", "switches", "idtp", "gt", "pred")


def identity_counts(pred: DataFrame, gt: DataFrame, threshold: float = 0.5, by: tuple[str, ...] = ()) -> DataFrame:
    """One row for each value of ``by`` (or one in all): ``COUNTS`` summed over videos, mota and idf1."""
    keys = [*by, "video_id"]
    cols = [*keys, "frame_id", "track_id", *CORNERS]
    x = pred.select(F.lit(0).alias("side"), *cols).unionByName(gt.select(F.lit(1).alias("side"), *cols))
    schema = ", ".join([f"{k} {x.schema[k].dataType.simpleString()}" for k in keys] + [f"{c} long" for c in COUNTS])
    per = walk_frames(x, keys, "frame_id", lambda key: Identity(dict(zip(keys, key, strict=True)), threshold), schema)
    return identity_ratios(per, by)


def identity_ratios(per: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """``COUNTS`` of videos summed by ``by``, mota and idf1."""
    s = per.groupBy(*by).agg(*[F.sum(c).alias(c) for c in COUNTS])
    return s.withColumn("mota", F.try_divide(F.col("tp") - F.col("fp") - F.col("switches"), F.col("gt"))).withColumn("idf1", F.try_divide(2 * F.col("idtp"), F.col("gt") + F.col("pred")))


def tracking_scores(pred: DataFrame, gt: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row: mota, idf1 and the counts behind them, over (video_id, frame_id, track_id, corners) tables."""
    return identity_counts(pred, gt, threshold)


#: Localisation thresholds of the higher-order score.
HOTA_THRESHOLDS = tuple(0.05 * i for i in range(1, 20))


def _higher_order(pdf: pd.DataFrame) -> pd.DataFrame:
    """tp, fn, fp and the sum of association accuracies of one video at each threshold."""
    gt, pr = pdf[pdf["side"] == 1], pdf[pdf["side"] == 0]
    gids, pids = np.unique(gt["track_id"]), np.unique(pr["track_id"])
    frames = []
    together = np.zeros((len(gids), len(pids)))
    gt, pr = gt.sort_values("frame_id", kind="stable"), pr.sort_values("frame_id", kind="stable")
    times = np.unique(pdf["frame_id"])
    ends = lambda x: np.searchsorted(x["frame_id"], times, "right").tolist()
    g_at, p_at, g_end, p_end = np.searchsorted(gids, gt["track_id"]), np.searchsorted(pids, pr["track_id"]), ends(gt), ends(pr)
    g_box, p_box = gt[list(CORNERS)].to_numpy(float), pr[list(CORNERS)].to_numpy(float)
    for a, b, c, d in zip([0, *g_end], g_end, [0, *p_end], p_end, strict=False):
        gi, pi = g_at[a:b], p_at[c:d]
        o = overlaps(g_box[a:b], p_box[c:d])
        frames.append((gi, pi, o))
        if o.size:  # how much of all overlap of a pair's boxes the pair itself has
            both = o.sum(0)[None] + o.sum(1)[:, None] - o
            together[gi[:, None], pi[None]] += np.where(both > 0, o / np.maximum(both, 1e-300), 0.0)
    n_g, n_p = np.bincount(np.searchsorted(gids, gt["track_id"]), minlength=len(gids)), np.bincount(np.searchsorted(pids, pr["track_id"]), minlength=len(pids))
    aligned = together / np.maximum(n_g[:, None] + n_p[None] - together, 1e-300)
    at_g, at_p, near = [], [], []
    for gi, pi, o in frames:
        rows, cols = solve(-(aligned[gi[:, None], pi[None]] * o) if o.size else o)
        at_g.append(gi[rows])
        at_p.append(pi[cols])
        near.append(o[rows, cols])
    at_g, at_p, near = (np.concatenate(x) if x else np.zeros(0) for x in (at_g, at_p, near))
    hits, ass = np.zeros(len(HOTA_THRESHOLDS), np.int64), np.zeros(len(HOTA_THRESHOLDS))
    for a, least in enumerate(HOTA_THRESHOLDS):
        ok = near >= least - 1e-12
        (g, p), n = np.unique(np.stack([at_g[ok], at_p[ok]]), axis=1, return_counts=True)
        g, p = g.astype(int), p.astype(int)
        hits[a], ass[a] = ok.sum(), (n * n / np.maximum(n_g[g] + n_p[p] - n, 1)).sum()
    return pd.DataFrame({"a": np.arange(len(hits)), "tp": hits, "fn": len(gt) - hits, "fp": len(pr) - hits, "ass": ass})


def higher_order_accuracy(pred: DataFrame, gt: DataFrame) -> DataFrame:
    """One row: hota, deta, assa (means over localisation thresholds) over tables as for ``tracking_scores``.

    A group is a video: its tracks are matched as a whole. Counts of videos add up before the ratios are taken.
    """
    cols = ["video_id", "frame_id", "track_id", *CORNERS]
    x = pred.select(F.lit(0).alias("side"), *cols).unionByName(gt.select(F.lit(1).alias("side"), *cols))
    s = x.groupBy("video_id").applyInPandas(_higher_order, "a int, tp long, fn long, fp long, ass double")
    s = s.groupBy("a").agg(*[F.sum(c).alias(c) for c in ("tp", "fn", "fp", "ass")])
    det, ass = F.col("tp") / F.greatest(F.col("tp") + F.col("fn") + F.col("fp"), F.lit(1)), F.col("ass") / F.greatest("tp", F.lit(1))
    return s.agg(F.avg(F.sqrt(det * ass)).alias("hota"), F.avg(det).alias("deta"), F.avg(ass).alias("assa"))
