"""Trackers: small scenes with known answers, costs against enumeration, walks against plain loops."""

from __future__ import annotations

import itertools
import math
import pickle
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.operators import assign
from tessera.operators import trackers as TT
from tessera.operators import tracking as T
from tessera.plans.catalog import videos
from tessera.queries import QUERIES

SF = "/root/testdata/sf0.001"
KINDS = {
    "observations": TT.ObservationTracker,
    "appearance": TT.AppearanceTracker,
    "motion": TT.AppearanceTracker.plain,
    "similarity": TT.SimilarityTracker,
    "weights": TT.WeightedTracker,
}


def box(x, y, w=40, h=80):
    return [x - w / 2, y - h / 2, x + w / 2, y + h / 2]


def run(tracker, frames, looks=None, scores=None, labels=None):
    """Ids by frame; frames: {frame: {name: (x, y)}}; names with None are hidden."""
    out = {}
    for f, objects in frames.items():
        seen = {k: v for k, v in objects.items() if v is not None}
        embeds = np.array([(looks or {}).get(k, [0.0]) for k in seen], float) if looks else None
        ids = tracker.step(f, np.array([box(*v) for v in seen.values()], float).reshape(-1, 4), np.array([(labels or {}).get(k, 0) for k in seen], int), np.array([(scores or {}).get(k, 0.95) for k in seen], float), embeds)
        out[f] = dict(zip(seen, ids.tolist(), strict=True))
    return out


def best_by_enumeration(cost, limit):
    n, m = cost.shape
    best = None
    for k in range(min(n, m) + 1):
        for rows in itertools.combinations(range(n), k):
            for cols in itertools.permutations(range(m), k):
                total = sum(cost[r, c] for r, c in zip(rows, cols, strict=True)) + limit / 2 * (n + m - 2 * k)
                if best is None or total < best - 1e-12:
                    best = total
    return best


@pytest.mark.parametrize("seed", range(12))
def test_pairs_within_a_limit_cost_least(seed):
    r = np.random.default_rng(seed)
    cost, limit = r.uniform(0, 1.4, r.integers(1, 5, 2)), 0.7
    got = TT.pair_within(cost, limit)
    assert len({a for a, _ in got}) == len(got) == len({b for _, b in got})
    total = sum(cost[a, b] for a, b in got) + limit / 2 * (sum(cost.shape) - 2 * len(got))
    assert total == pytest.approx(best_by_enumeration(cost, limit))


def test_pairs_never_take_a_missing_cost():
    cost = np.array([[np.nan, 0.9], [0.1, 0.2]])
    assert sorted(TT.pair_then_cut(cost, lambda x: x < 1)) == [(0, 1), (1, 0)]
    assert TT.pair_then_cut(np.full((2, 2), np.nan), lambda x: True) == []


def test_crossing_objects_keep_their_ids():
    """Two objects meet and part again; at the crossing both boxes overlap both tracks."""
    frames = {f: {"a": (100 + 8 * f, 200 + 5 * f), "b": (340 - 8 * f, 200 + 5 * f)} for f in range(30)}
    ids = run(TT.ObservationTracker(), frames)
    assert {x["a"] for x in ids.values()} == {0} and {x["b"] for x in ids.values()} == {1}


def test_the_direction_decides_between_equal_overlaps():
    """A walker to the right has two boxes at equal distance of its prediction; only the direction tells them apart."""

    def scene(momentum):
        t = TT.ObservationTracker(momentum=momentum, weigh=False)
        run(t, {f: {"a": (100 + 6 * f, 200)} for f in range(8)})
        here = T.to_box(t.kalman.predict(t.live[0]["m"], t.live[0]["c"])[0][:4])
        shifted = [here + np.array([0, dy, 0, dy]) + np.array([dx, 0, dx, 0]) for dx, dy in ((-9, 0), (9, 0))]
        return t.step(8, np.array(shifted), np.zeros(2, int), np.full(2, 0.9)).tolist()

    assert scene(0.5)[1] == 0 and scene(0.5)[0] != 0


def test_a_lost_track_is_found_where_it_was_seen_last():
    """The object stops behind another: its prediction has gone on, its last observation is where it comes back."""
    move = {f: {"a": (100 + 20 * f, 200)} for f in range(10)}
    hidden = {f: {"b": (1000, 600)} for f in range(10, 16)}
    back = {16: {"a": (100 + 20 * 9, 200)}}
    ids = run(TT.ObservationTracker(), move | hidden | back)
    assert ids[16]["a"] == ids[0]["a"]
    late = {f: {"b": (1000, 600)} for f in range(16, 45)} | {45: {"a": (280, 200)}}
    ids = run(TT.ObservationTracker(keep=30), move | hidden | late)
    assert ids[45]["a"] != ids[0]["a"]


def test_a_gap_is_corrected_along_a_straight_path():
    t = TT.ObservationTracker()
    run(t, {f: {"a": (100 + 4 * f, 200)} for f in range(6)})
    m, c, last = t.live[0]["m"], t.live[0]["c"], np.array(box(120, 200), float)
    run(t, {f: {"b": (900, 600)} for f in range(6, 9)})
    assert t.live[0]["gap"] == 3
    now = np.array(box(136, 204), float)
    t.step(9, now[None], np.zeros(1, int), np.array([0.9]))
    for k in (1, 2, 3):
        m, c = t.kalman.update(m, c, T.to_state(last + k * (now - last) / 4))
    m, c = t.kalman.update(m, c, T.to_state(now))
    assert np.allclose(t.live[0]["m"], m) and np.allclose(t.live[0]["c"], c) and t.live[0]["gap"] == 0


def test_every_detection_of_a_perfect_scene_is_tracked():
    """Identical boxes in two frames with scores of one: as many results as boxes, with the same ids."""
    frames = {f: {i: (60 * i, 100 * (i % 5)) for i in range(20)} for f in range(2)}
    for make in (TT.ObservationTracker, TT.AppearanceTracker, TT.AppearanceTracker.plain):
        ids = run(make(), frames, looks={i: np.eye(20)[i] for i in range(20)}, scores=dict.fromkeys(range(20), 1.0))
        assert ids[0] == ids[1] and sorted(ids[0].values()) == list(range(20))


def test_labels_are_never_mixed():
    frames = {f: {"a": (100, 200), "b": (104, 200)} for f in range(5)}
    for make in KINDS.values():
        ids = run(make(), frames, looks={"a": [1.0, 0.0], "b": [0.0, 1.0]}, labels={"a": 1, "b": 2})
        assert len({x["a"] for x in ids.values()} & {x["b"] for x in ids.values()} - {-1}) == 0


@pytest.mark.parametrize("make", [TT.AppearanceTracker, TT.AppearanceTracker.plain])
def test_appearance_finds_an_object_after_a_gap(make):
    looks = {"a": [5.0, 0, 0], "b": [0, 5.0, 0], "c": [0, 0, 5.0]}
    frames = {f: {"a": (100 + 2 * f, 200), "b": (400, 200)} for f in range(6)} | {f: {"b": (400, 200)} for f in range(6, 12)} | {12: {"a": (124, 200), "b": (400, 200)}}
    ids = run(make(), frames, looks)
    assert ids[12]["a"] == ids[0]["a"] and ids[12]["b"] == ids[0]["b"]
    other = run(make(), {k: v for k, v in frames.items() if k < 12} | {12: {"c": (124, 200), "b": (400, 200)}}, looks)
    assert other[12]["c"] not in {other[0]["a"], other[0]["b"]}


def test_average_appearance_and_noise_by_score():
    t = TT.AppearanceTracker(average=0.25)
    first, second = np.array([1.0, 0.0]), np.array([0.0, 1.0])
    one = np.array([box(100, 100)], float)
    t.step(0, one, np.zeros(1, int), np.array([0.9]), first[None])
    m, c = t.kalman.predict(t.live[0]["m"], t.live[0]["c"])
    t.step(1, one, np.zeros(1, int), np.array([0.8]), second[None])
    assert np.allclose(t.live[0]["look"][0], 0.75 * first + 0.25 * second)
    assert np.allclose(t.live[0]["c"], t.kalman.update(m, c, T.to_state(one[0]), 0.8)[1])


def test_similarity_follows_the_appearance_not_the_place():
    looks = {"a": [9.0, 0], "b": [0, 9.0]}
    frames = {0: {"a": (100, 100), "b": (400, 100)}, 1: {"a": (400, 100), "b": (100, 100)}}
    ids = run(TT.SimilarityTracker(), frames, looks)
    assert ids[0] == ids[1] == {"a": 0, "b": 1}


def test_similarity_is_softmax_both_ways():
    r = np.random.default_rng(1)
    a, b = r.normal(size=(3, 4)), r.normal(size=(5, 4))
    got = TT.SimilarityTracker()._likeness(a, b)
    for i in range(3):
        for j in range(5):
            dot = [[math.exp(a[p] @ b[q]) for q in range(5)] for p in range(3)]
            assert got[i, j] == pytest.approx((dot[i][j] / sum(dot[i]) + dot[i][j] / sum(row[j] for row in dot)) / 2)


def test_doubles_and_weak_detections_are_left_out():
    looks = {"a": [9.0, 0], "double": [9.0, 0.1], "weak": [0, 9.0]}
    ids = run(TT.SimilarityTracker(), {0: {"a": (100, 100), "double": (102, 100), "weak": (400, 100)}}, looks, {"a": 0.9, "double": 0.85, "weak": 0.4})
    assert ids[0] == {"a": 0, "double": -1, "weak": -1}


def test_weights_take_the_label_before_the_likeness():
    t = TT.WeightedTracker()
    run(t, {0: {"a": (100, 100), "b": (400, 100)}}, {"a": [1.0, 0], "b": [0, 1.0]}, labels={"a": 1, "b": 2})
    ids = run(t, {1: {"b": (104, 100)}}, {"b": [0.5, 0.5]}, labels={"b": 1})
    assert ids[1]["b"] == 0


@pytest.mark.parametrize("kind", KINDS)
def test_state_is_bounded_and_late_frames_get_nothing(kind):
    r = np.random.default_rng(3)
    t, sizes = KINDS[kind](), []
    for f in range(150):
        n = 6
        t.step(f, np.array([box(*r.uniform(0, 3000, 2)) for _ in range(n)]), np.zeros(n, int), r.uniform(0.3, 1, n), r.normal(size=(n, 4)))
        sizes.append(len(pickle.dumps(t)))
    assert max(sizes[110:]) < 1.6 * max(sizes[:110])
    assert t.step(100, np.array([box(10, 10)]), np.zeros(1, int), np.ones(1), np.ones((1, 4))).tolist() == [-1]


def plain_loop(rows, make, keys=("video_id",)):
    out = {}
    for _, video in rows.groupby(list(keys)):
        t = make()
        for f, part in video.sort_values(["frame_id", "det_id"]).groupby("frame_id"):
            for d, i in zip(part.det_id, t.step(int(f), *TT.columns(part)), strict=True):
                out[d] = int(i)
    return out


@pytest.mark.parametrize("kind", KINDS)
def test_a_walk_in_small_batches_equals_a_loop(spark, kind):
    det = videos._looks(spark, SF)
    rows, make = det.toPandas(), KINDS[kind]
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    spark.conf.set(size, "7")
    try:
        got = {r.det_id: r.track_id for r in TT.walk(det, lambda _: make()).collect()}
    finally:
        spark.conf.set(size, before)
    assert got == plain_loop(rows, make)
    assert len(set(got.values())) > 3


def test_walk_of_an_empty_table(spark):
    assert TT.walk(videos._frames(spark, SF).limit(0), lambda _: TT.ObservationTracker()).collect() == []


@pytest.mark.parametrize("kind", ["observations", "similarity"])
def test_streaming_equals_batch(spark, tmp_path, kind):
    from tessera.streaming.tracks import walk_stream

    make = KINDS[kind]
    det = videos._looks(spark, SF).where("video_id < 6")
    cuts = sorted(r.frame_id for r in det.select("frame_id").distinct().collect())
    for k in range(3):
        part = det.where(f"frame_id >= {cuts[k * len(cuts) // 3]}" + (f" AND frame_id < {cuts[(k + 1) * len(cuts) // 3]}" if k < 2 else ""))
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(det.schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "in"))
    q = walk_stream(stream, make).writeStream.format("memory").queryName(f"walk_{kind}").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
        got = {r.det_id: r.track_id for r in spark.sql(f"SELECT det_id, track_id FROM walk_{kind}").collect()}
    finally:
        q.stop()
    assert got == plain_loop(det.toPandas(), make)


def test_search_equals_separate_runs(spark):
    rows = {r.setting: r for r in QUERIES["tracker_search"](spark, SF).collect()}
    f = videos._frames(spark, SF)
    gt = f.withColumn("track_id", f.det_id % 7).dropDuplicates(["video_id", "frame_id", "track_id"])
    for s, m in ((0.6, 0.1), (0.8, 0.3)):
        pred = TT.walk(f, lambda _, s=s, m=m: TT.ObservationTracker(start=s, match=m)).where("track_id >= 0")
        one, got = T.tracking_scores(pred, gt).first(), rows[f"start {s} match {m}"]
        assert (got.tp, got.fp, got.fn, got.switches, got.idtp) == (one.tp, one.fp, one.fn, one.switches, one.idtp)
        assert got.mota == pytest.approx(one.mota, abs=1e-6)
    order = pd.DataFrame([r.asDict() for r in rows.values()]).sort_values("place")
    assert order.mota.is_monotonic_decreasing and len(rows) == 4


def best_map(cost):
    """Pairs of least total cost, by trying all."""
    n, m = cost.shape
    if n > m:
        return [(c, r) for r, c in best_map(cost.T)]
    return min(([*zip(range(n), cols, strict=True)] for cols in itertools.permutations(range(m), n)), key=lambda pairs: sum(cost[r, c] for r, c in pairs), default=[])


def test_identity_counts_equal_trying_all_pairs(spark):
    r, rows = np.random.default_rng(8), []
    for video in range(4):
        for frame in range(12):
            for side, n in (("gt", r.integers(0, 4)), ("pred", r.integers(0, 5))):
                for track in r.permutation(4)[:n]:
                    x, y = 60 * (track if r.random() < 0.8 else r.integers(0, 4)) + r.uniform(-8, 8), r.uniform(0, 8)
                    rows.append((side, video, frame * 2, int(track), x, y, x + 40, y + 40))
    frame = pd.DataFrame(rows, columns=["side", "video_id", "frame_id", "track_id", *T.CORNERS])
    want = dict.fromkeys(T.COUNTS, 0)
    for _, v in frame.groupby("video_id"):
        last, together = {}, np.zeros((4, 4))
        for _, part in v.groupby("frame_id"):
            g, p = (part[part.side == s].sort_values("track_id") for s in ("gt", "pred"))
            o = T.overlaps(g[list(T.CORNERS)].to_numpy(), p[list(T.CORNERS)].to_numpy())
            a, b = g.track_id.tolist(), p.track_id.tolist()
            for i, j in zip(*np.nonzero(o >= 0.5), strict=True):
                together[a[i], b[j]] += 1
            cost = np.array([[1 - o[i, j] - 1000 * (last.get(a[i]) == b[j]) if o[i, j] >= 0.5 else 1e6 for j in range(len(b))] for i in range(len(a))]).reshape(o.shape)
            hits = [(i, j) for i, j in best_map(cost) if o[i, j] >= 0.5]
            for i, j in hits:
                want["switches"] += a[i] in last and last[a[i]] != b[j]
                last[a[i]] = b[j]
            want["tp"] += len(hits)
            want["fn"] += len(a) - len(hits)
            want["fp"] += len(b) - len(hits)
            want["gt"] += len(a)
            want["pred"] += len(b)
        want["idtp"] += int(sum(together[i, j] for i, j in best_map(-together)))
    df = spark.createDataFrame(frame).repartition(3)
    got = T.tracking_scores(df.where("side = 'pred'"), df.where("side = 'gt'")).first()
    assert {c: got[c] for c in T.COUNTS} == want and want["switches"] > 0
    assert got.mota == pytest.approx((want["tp"] - want["fp"] - want["switches"]) / want["gt"])
    assert got.idf1 == pytest.approx(2 * want["idtp"] / (want["gt"] + want["pred"]))


def test_two_band_tracks_equal_a_loop(spark):
    det = videos._frames(spark, SF)
    got = {r.det_id: r.track_id for r in T.track(det).collect()}
    assert got == plain_loop(det.toPandas(), T.Tracker)


def paired(cost, limit):
    """``pair_within`` by one square table with places for those that stay alone."""
    n, m = cost.shape
    square = np.full((n + m, n + m), limit / 2)
    square[:n, :m], square[n:, m:] = cost, 0.0
    return [(int(r), int(c)) for r, c in zip(*assign.solve(square), strict=True) if r < n and c < m] if n and m else []


@dataclass
class PlainObservations(TT._Live):
    """The tracker by observations track by track, with whole covariances."""

    least: float = 0.3
    start: float = 0.7
    match: float = 0.3
    weigh: bool = True
    tentative: int = 3
    momentum: float = 0.2
    back: int = 3
    keep: int = 30
    kalman: T.Kalman = field(default_factory=T.Kalman)

    def _overlap(self, boxes: np.ndarray, ids: list[int], det: np.ndarray, labels: np.ndarray, scores: np.ndarray) -> np.ndarray:
        o = T.overlaps(boxes, det)
        return 1 - (o * scores[None] if self.weigh else o) + TT.foreign([self.live[i]["label"] for i in ids], labels)

    def _earlier(self, t: dict) -> np.ndarray:
        """The observation ``back`` frames before the track's last one; the last one there is, if that is missing."""
        then = t["seen"][-1 - self.back] if len(t["seen"]) > self.back else None
        return t["box"] if then is None else then

    @staticmethod
    def _direction(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Unit vectors (y, x) from the centres of ``a`` to those of ``b``."""
        way = np.stack([b[..., 1] + b[..., 3] - a[..., 1] - a[..., 3], b[..., 0] + b[..., 2] - a[..., 0] - a[..., 2]], axis=-1) / 2
        return way / (np.linalg.norm(way, axis=-1, keepdims=True) + 1e-6)

    def _by_motion(self, ids: list[int], det: np.ndarray, labels: np.ndarray, scores: np.ndarray) -> list[tuple[int, int]]:
        if not ids or not len(det):
            return []
        cost = self._overlap(T.to_box(np.array([self.live[i]["m"] for i in ids])), ids, det, labels, scores)
        moved = np.array([self.live[i]["way"] is not None for i in ids])
        own = np.array([np.zeros(2) if self.live[i]["way"] is None else self.live[i]["way"] for i in ids])
        to = self._direction(np.array([self._earlier(self.live[i]) for i in ids])[:, None], det[None])
        turn = np.arccos(np.clip((to * own[:, None]).sum(-1), -1, 1)) / np.pi - 0.5
        cost = cost + self.momentum * turn * moved[:, None]
        return [(ids[r], c) for r, c in paired(cost, 1 - self.match)]

    def _meet(self, i: int, frame: int, box: np.ndarray, label: int) -> None:
        t = self.live[i]
        if t["gap"]:  # from the state before the gap on, as if it had been seen on the straight path over it
            t["m"], t["c"] = t["kept"]
            for k in range(1, t["gap"] + 1):
                t["m"], t["c"] = self.kalman.update(t["m"], t["c"], T.to_state(t["box"] + k * (box - t["box"]) / (t["gap"] + 1)))
        t["seen"], t["box"], t["label"], t["last"], t["gap"], t["hits"] = [*t["seen"], box][-1 - self.back :], box, label, frame, 0, t["hits"] + 1
        t["sure"] = t["sure"] or t["hits"] >= self.tentative

    def _open(self, frame: int, box: np.ndarray, label: int) -> int:
        m, c = self.kalman.start(T.to_state(box))
        i = self.number()
        self.live[i] = {"m": m, "c": c, "kept": (m, c), "seen": [box], "box": box, "label": label, "last": frame, "gap": 0, "hits": 1, "sure": frame == 0, "way": None}
        return i

    def step(self, frame: int, boxes: np.ndarray, labels: np.ndarray, scores: np.ndarray, embeds: np.ndarray | None = None) -> np.ndarray:
        out = np.full(len(boxes), -1, np.int64)
        if not self.opens(frame):
            return out
        if not self.live:
            for d in np.flatnonzero(scores > self.start):
                out[d] = self._open(frame, boxes[d], labels[d])
            return out
        sure = [i for i, t in self.live.items() if t["sure"]]
        for i in sure:
            t = self.live[i]
            if t["last"] < frame - 1:
                t["m"] = np.where(np.arange(8) == 7, 0.0, t["m"])
            if not t["gap"]:
                t["kept"] = t["m"], t["c"]
        self.kalman.predict_all([self.live[i] for i in sure])
        free = np.flatnonzero(scores > self.least)

        def take(pairs: list[tuple[int, int]]) -> None:
            nonlocal free
            for i, d in pairs:
                out[free[d]] = i
            free = free[out[free] < 0]

        take(self._by_motion(sure, boxes[free], labels[free], scores[free]))
        take(self._by_motion([i for i, t in self.live.items() if not t["sure"]], boxes[free], labels[free], scores[free]))
        met = set(out[out >= 0].tolist())
        lost = [i for i in self.live if i not in met]
        if lost and len(free):  # where they were seen last
            cost = self._overlap(np.array([self.live[i]["box"] for i in lost]), lost, boxes[free], labels[free], scores[free])
            take([(lost[r], c) for r, c in paired(cost, 1 - self.match)])
        met = {int(i): d for d, i in enumerate(out) if i >= 0}
        for i, t in self.live.items():
            if i in met:
                self._meet(i, frame, boxes[met[i]], labels[met[i]])
            else:
                t["seen"], t["gap"] = [*t["seen"], None][-1 - self.back :], t["gap"] + 1
        if met:
            tracks, det = [self.live[i] for i in met], boxes[list(met.values())]
            self.kalman.update_all(tracks, T.to_state(det))
            for t, way in zip(tracks, self._direction(np.array([self._earlier(t) for t in tracks]), det), strict=True):
                t["way"] = way
        for d in free:
            out[d] = self._open(frame, boxes[d], labels[d])
        self.drop(frame)
        return out


def crowd(seed, frames=60, videos=1, labels=2):
    """Rows (video, frame, det) of walkers that meet, vanish and come back; some frames of some videos are left out."""
    r, out = np.random.default_rng(seed), []
    at, way = r.uniform(0, 300, (videos, 8, 2)), r.uniform(-6, 6, (videos, 8, 2))
    for f in range(frames):
        for v in range(videos):
            if r.random() < 0.1:
                continue
            for k in r.permutation(8)[: r.integers(1, 9)]:
                out.append((v, f + 3 * (f > 30), len(out), int(k % labels), float(r.uniform(0.2, 1)), *np.array(box(*(at[v, k] + f * way[v, k] + r.normal(0, 3, 2)))).tolist()))
    return pd.DataFrame(out, columns=["video_id", "frame_id", "det_id", "label", "score", *T.CORNERS])


SETTINGS = [{}, {"start": 0.4, "match": 0.1}, {"least": 0.5, "weigh": False, "momentum": 0.6}, {"keep": 5, "tentative": 1}, {"back": 1}, {"back": 0}]


@pytest.mark.parametrize("rules", SETTINGS)
def test_tracks_by_observations_equal_a_plain_tracker(rules):
    rows = crowd(5)
    want = plain_loop(rows, lambda: PlainObservations(**rules))
    assert plain_loop(rows, lambda: TT.ObservationTracker(**rules)) == want and len(set(want.values())) > 8


def test_lanes_side_by_side_equal_trackers_alone():
    rows, rules = crowd(6, videos=4), SETTINGS[:4]
    want = [plain_loop(rows, lambda x=x: PlainObservations(**x)) for x in rules]
    lanes, got = TT._Lanes([TT.ObservationTracker(**x) for x in rules]), [{} for _ in rules]
    for f, part in rows.sort_values(["frame_id", "video_id", "det_id"]).groupby("frame_id"):
        for x, ids in zip(got, lanes.step(int(f), part.video_id.to_numpy(), *TT.columns(part)[:3]), strict=True):
            x.update(zip(part.det_id, ids.tolist(), strict=True))
    assert got == want


@pytest.mark.parametrize("seed", range(30))
def test_pairs_of_edges_cost_least(seed):
    r = np.random.default_rng(seed)
    cost = np.where(r.random((5, 5)) < 0.6, np.round(r.uniform(0, 1, (5, 5)), 1 + seed % 2), 2.0)[: r.integers(1, 6)]
    pairs = TT.pair_edges([[(v - 0.8, c) for c, v in enumerate(row) if v < 2] for row in cost.tolist()])
    assert len(set(pairs.values())) == len(pairs)
    assert sum(cost[i, c] for c, i in pairs.items()) + 0.4 * (sum(cost.shape) - 2 * len(pairs)) == pytest.approx(best_by_enumeration(cost, 0.8))


def test_a_search_deals_detections_once(spark):
    """No row for each setting is made before the walk, and no setting's tracks are shuffled for their scores."""
    plan = QUERIES["tracker_search"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Generate explode" not in plan and plan.count("MapInArrow") == 1 and "MapInPandas" not in plan


def test_videos_are_dealt_evenly(spark):
    """As many videos for each of 4 tasks, whatever their hash."""
    x = QUERIES["track_by_observations"](spark, SF)
    tasks = [r.n for r in x.select("video_id", F.spark_partition_id().alias("task")).distinct().groupBy("task").agg(F.count("*").alias("n")).collect()]
    assert len(tasks) == 4 and max(tasks) - min(tasks) <= 1
    rows = {r.det_id: r.track_id for r in x.collect()}
    assert rows == plain_loop(videos._frames(spark, SF).toPandas(), TT.ObservationTracker)


@pytest.mark.parametrize(("few", "lanes"), [(3, 32), (4096, 2)])
def test_many_videos_and_small_batches(spark, monkeypatch, few, lanes):
    monkeypatch.setattr(TT, "FEW_VIDEOS", few)
    monkeypatch.setattr(TT, "LANES", lanes)
    rows = crowd(7, 20, 9)
    det = spark.createDataFrame(rows.sample(frac=1, random_state=1)).withColumn("video_id", F.when(F.col("video_id") < 8, F.col("video_id").cast("string")))
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    spark.conf.set(size, "7")
    try:
        got = {r.det_id: r.track_id for r in TT.walk_together(det, TT.ObservationTracker()).collect()}
    finally:
        spark.conf.set(size, before)
    assert got == plain_loop(rows, PlainObservations)


def test_search_of_other_trackers_and_odd_rows(spark):
    """Trackers with appearance, ground truth of a video without detections, detections of one without ground truth."""
    looks = videos._looks(spark, SF).where("video_id < 4")
    gt = looks.withColumn("track_id", looks.det_id % 7).dropDuplicates(["video_id", "frame_id", "track_id"]).where("video_id <> 1").drop("embedding")
    gt = gt.unionByName(gt.where("video_id = 2").withColumn("video_id", F.lit(77).cast("long")))
    settings = {"a": TT.AppearanceTracker, "o": TT.ObservationTracker}
    rows = {r.setting: r for r in TT.search(looks, gt, settings).collect()}
    for name, make in settings.items():
        pred = TT.walk(looks, lambda _, make=make: make()).where("track_id >= 0")
        one, got = T.tracking_scores(pred, gt).first(), rows[name]
        assert [got[c] for c in T.COUNTS] == [one[c] for c in T.COUNTS] and one.tp > 0 and one.fp > 0 and one.fn > 0


def test_pairs_that_go_together_are_summed_in_parts(monkeypatch):
    r, ends = np.random.default_rng(2), []
    frames = [(r.permutation(5)[:4].tolist(), r.permutation(6)[:5].tolist(), *(x.tolist() for x in np.nonzero(r.random((4, 5)) < 0.4))) for _ in range(50)]
    for most in (1, 7, 1 << 17):
        monkeypatch.setattr(T, "PAIRS", most)
        x = T.Identity({}, 0.5)
        for gi, pi, rows, cols in frames:
            x.count(gi, pi, rows, cols, [0.1 * (a + b) % 0.5 for a, b in zip(rows, cols, strict=True)])
        ends.append(x.end().to_dict("records"))
    assert ends[0] == ends[1] == ends[2] and ends[0][0]["idtp"] > 0
