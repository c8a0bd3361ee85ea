"""Further trackers, each a state that is walked frame by frame, and the search for their best settings.

A tracker has ``step(frame, boxes, labels, scores, embeds)``, which gives the track id of each detection (-1: none). What it
remembers of a track is of fixed size: a Kalman state, the last few observations, one appearance vector or a fixed number
of them. Tracks that have not been seen for ``keep`` frames go, so the state of a video is bounded by what was on screen
lately.

``walk`` deals detections by video, sorts them by frame and passes them in Arrow batches: no video is held as a whole. A
video is one sequence, so it stays in one task, whose memory is a batch and the state. ``tessera.streaming.tracks`` keeps
the same state between micro-batches. Frames without rows are frames without detections. Frames that come after a later one
get no ids.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .assign import pair_edges, solve
from .groups import _whole, dealt
from .matching import overlaps
from .tracking import CHI2_95, CORNERS, COUNTS, NEVER, Identity, Kalman, identity_ratios, to_state


def pair_within(cost: np.ndarray, limit: float) -> list[tuple[int, int]]:
    """Pairs (row, column) of least total cost, where a row and a column that stay alone cost ``limit`` together."""
    edges: list[list[tuple[float, int]]] = [[] for _ in range(cost.shape[1])]
    rows, cols = np.nonzero(cost < limit)
    for r, c, v in zip(rows.tolist(), cols.tolist(), (cost[rows, cols] - limit).tolist(), strict=True):
        edges[c].append((v, r))
    return sorted(pair_edges(edges).items())


def pair_then_cut(cost: np.ndarray, accept: Callable[[float], bool]) -> list[tuple[int, int]]:
    """Pairs of least total cost, as many as there can be, and of these the accepted ones; NaN is never paired if that can
    be helped, and never accepted."""
    if not cost.size:
        return []
    full = np.where(np.isnan(cost), 1e3 * NEVER, cost)
    return [(int(r), int(c)) for r, c in zip(*solve(full), strict=True) if np.isfinite(cost[r, c]) and accept(cost[r, c])]


def foreign(labels: list, others: np.ndarray) -> np.ndarray:
    """NEVER where a track's label is not the detection's."""
    return NEVER * (np.array(labels)[:, None] != others[None])


@dataclass
class _Live:
    """What trackers share: live tracks by id, the next id, and what happens between frames."""

    live: dict[int, dict] = field(default_factory=dict, kw_only=True)
    next_id: int = field(default=0, kw_only=True)
    last_frame: int = field(default=-1, kw_only=True)

    def opens(self, frame: int) -> bool:
        """False for a late frame. Frames left out since the last one end tentative and old tracks."""
        if frame <= self.last_frame:
            return False
        if frame > self.last_frame + 1:
            self.drop(frame - 1)
        self.last_frame = frame
        return True

    def drop(self, frame: int) -> None:
        self.live = {i: t for i, t in self.live.items() if frame - t["last"] < self.keep and (t["sure"] or t["last"] == frame)}

    def number(self) -> int:
        self.next_id += 1
        return self.next_id - 1


# ---------------------------------------------------------------- observation-centred

_DIAGONAL = np.arange(4)
#: Columns of a track's row: the Kalman state (4 positions and 4 speeds, then variances of the positions, their covariances with the
#: speeds, variances of the speeds), the state before a gap, the box seen last, ...
_STATE, _KEPT, _BOX = slice(0, 20), slice(20, 40), slice(40, 44)
#: ... the frame and the lane of it, frames without a match, hits, whether it is confirmed, its id, twice the centre (y, x) of the
#: observation that gives the direction, the direction; centres of the last observations follow.
_LAST, _LANE, _GAP, _HITS, _SURE, _ID, _FROM, _WAY, _SEEN = 44, 45, 46, 47, 48, 49, slice(50, 52), slice(52, 54), 54


def _centre(b: np.ndarray) -> np.ndarray:
    """Twice the centres (y, x) of boxes."""
    return b[:, 1::-1] + b[:, 3:1:-1]


class _Lanes:
    """Trackers by observations that walk side by side: a lane for each setting of each video. The tracks of all lanes are rows of one array, so a frame costs about as many calls for all of them as for one.

    The noise of ``Kalman`` is independent in each of the four positions, so a covariance is four pairs of a position and its
    speed: 12 numbers, with the same results."""

    def __init__(self, rules: list[ObservationTracker]) -> None:
        self.rules, self.settings, self.videos, self.back = rules, len(rules), 0, rules[0].back
        self.next_id, self.last_frame = [], np.zeros(0, int)
        self.rows, self.labels = np.zeros((0, _SEEN + 2 * (self.back + 1))), np.zeros(0, np.int64)
        p, v = rules[0].kalman.position, rules[0].kalman.velocity
        self.position, self.velocity = p, v
        self.grows, self.stays = np.array([p, p, 0, p, v, v, 0, v]) ** 2, np.array([0, 0, 1e-2, 0, 0, 0, 1e-5, 0]) ** 2
        self.seen_grows, self.seen_stays = np.array([p, p, 0, p]) ** 2, np.array([0, 0, 1e-1, 0]) ** 2
        self.grow(1)

    def grow(self, videos: int) -> None:
        """Lanes for as many videos."""
        more = (videos - self.videos) * self.settings
        self.videos, self.next_id, self.last_frame = videos, self.next_id + [0] * more, np.concatenate([self.last_frame, np.full(more, -1)])
        self.least, self.start, self.limit, self.weigh, self.tentative, self.momentum, self.keep = (np.array(v) for v in zip(*[(r.least, r.start, 1 - r.match, r.weigh, r.tentative, r.momentum, r.keep) for r in self.rules * videos], strict=True))
        self.video = np.repeat(np.arange(videos), self.settings)
        self._by_row()

    @staticmethod
    def alike(rules: list[object]) -> bool:
        """Whether trackers may share an array: the same motion, and as many observations."""
        return all(type(r) is ObservationTracker and type(r.kalman) is Kalman and r.back == rules[0].back for r in rules)

    def live(self, lane: int) -> dict[int, dict]:
        """A lane's tracks by id."""
        out = {}
        for x, label in zip(self.rows, self.labels, strict=True):
            if x[_LANE] == lane:
                c = np.diag(np.concatenate([x[8:12], x[16:20]]))
                c[_DIAGONAL, _DIAGONAL + 4] = c[_DIAGONAL + 4, _DIAGONAL] = x[12:16]
                out[int(x[_ID])] = {"m": x[:8].copy(), "c": c, "box": x[_BOX].copy(), "label": label, "last": int(x[_LAST]), "gap": int(x[_GAP]), "hits": int(x[_HITS]), "sure": bool(x[_SURE])}
        return out

    def _by_row(self) -> None:
        """What holds for the tracks between frames: rules of their lanes."""
        self.lane = lane = self.rows[:, _LANE].astype(int)
        self.row_limit, self.row_momentum, self.row_video = self.limit[lane][:, None], self.momentum[lane][:, None], self.video[lane]

    def _put(self, rows: np.ndarray, labels: np.ndarray) -> None:
        """More tracks, after the others of their lanes."""
        rows = np.concatenate([self.rows, rows])
        order = np.argsort(rows[:, _LANE], kind="stable")
        self.rows, self.labels = rows[order], (np.concatenate([self.labels, labels]) if len(self.labels) else labels)[order]
        self._by_row()

    def drop(self, frame: int, of: np.ndarray | bool = True) -> None:
        """Ends tentative and old tracks (of some rows)."""
        x = self.rows
        stay = (frame - x[:, _LAST] < self.keep[self.lane]) & ((x[:, _SURE] > 0) | (x[:, _LAST] == frame)) | ~np.asarray(of)
        if not stay.all():
            self.rows, self.labels = x[stay], self.labels[stay]
            self._by_row()

    def _predict(self, frame: int) -> np.ndarray:
        """Moves confirmed tracks on; gives the states before."""
        x = self.rows
        sure = x[:, _SURE] > 0
        x[sure & (x[:, _LAST] < frame - 1), 7] = 0.0
        before = x[:, _STATE].copy()
        after, h = before.copy(), before[:, 3:4]
        noise = self.grows * (h * h)
        noise += self.stays
        after[:, :4] += before[:, 4:8]
        after[:, 8:16] += before[:, 12:20]
        after[:, 8:12] += after[:, 12:16]
        after[:, 8:12] += noise[:, :4]
        after[:, 16:20] += noise[:, 4:]
        x[:, _STATE] = after if sure.all() else np.where(sure[:, None], after, before)
        return before

    def _costs(self, boxes: np.ndarray, labels: np.ndarray, scores: np.ndarray) -> np.ndarray:
        """Costs of tracks and their video's detections: by prediction and direction, and where they were seen last."""
        x, of = self.rows, self.row_video
        b = boxes[:, of]
        a = np.empty((4, 2, len(x), 1))
        a[:, 1, :, 0] = x[:, _BOX].T
        z = x[:, :4].T
        high = z[3] / 2
        wide = z[2] * high
        a[0, 0, :, 0], a[1, 0, :, 0], a[2, 0, :, 0], a[3, 0, :, 0] = z[0] - wide, z[1] - high, z[0] + wide, z[1] + high
        o, h = np.minimum(a[2], b[2]), np.minimum(a[3], b[3])
        o -= np.maximum(a[0], b[0])
        h -= np.maximum(a[1], b[1])
        o = np.maximum(o, 0, out=o) * np.maximum(h, 0, out=h)
        whole = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - o
        o /= np.maximum(whole, 1e-6, out=whole)
        if self.weigh.all():
            o *= scores[of]
        elif self.weigh.any():
            o = np.where(self.weigh[self.lane][:, None], o * scores[of], o)
        cost = np.subtract(1, o, out=o)
        other = self.labels[:, None] != labels[of]
        if other.any():
            cost += NEVER * other
        dy, dx = b[1] + b[3], b[0] + b[2]
        dy -= x[:, 50:51]
        dx -= x[:, 51:52]
        size = np.sqrt(dy * dy + dx * dx)
        size /= 2
        size += 1e-6
        dy *= x[:, 52:53] / 2
        dx *= x[:, 53:54] / 2
        turn = (dy + dx) / size
        np.minimum(np.maximum(turn, -1, out=turn), 1, out=turn)  # 0 without a direction: no cost
        cost[0] += self.row_momentum * (np.arccos(turn) / np.pi - 0.5)
        return cost

    def _correct(self, x: np.ndarray, z: np.ndarray) -> None:
        """States (5 rows of 4) after an observation (centre, ratio, height) each, in place."""
        h = x[:, 0, 3:4]
        noise = self.seen_grows * (h * h)
        noise += self.seen_stays
        noise += x[:, 2]
        noise = noise[:, None]
        gain = x[:, 2:4] / noise
        x[:, :2] += gain * (z - x[:, 0])[:, None]
        noise = gain * noise
        x[:, 2:4] -= noise[:, :1] * gain
        x[:, 4] -= noise[:, 1] * gain[:, 1]

    def _corrected(self, x: np.ndarray, boxes: np.ndarray) -> np.ndarray:
        """New states of tracks that are seen again; after a gap from the state before it on, as if a track had been seen on the
        straight path over it."""
        order = np.argsort(-x[:, _GAP], kind="stable")
        y, z = x[order], boxes[order]
        gaps = y[:, _GAP]
        many = int(np.count_nonzero(gaps))
        state = y[:, _STATE].reshape(-1, 5, 4)
        if many:
            state[:many] = y[:many, _KEPT].reshape(-1, 5, 4)
            step, which = np.nonzero(np.arange(1, int(gaps[0]) + 1)[:, None] <= gaps[None, :many])
            was = y[which, _BOX]
            path = to_state(was + (step + 1)[:, None] * (z[which] - was) / (gaps[which] + 1)[:, None])
            at = 0
            for n in np.bincount(step).tolist():  # tracks with long gaps come first
                self._correct(state[:n], path[at : at + n])
                at += n
        self._correct(state, to_state(z))
        out = np.empty((len(x), 20))
        out[order] = state.reshape(-1, 20)
        return out

    def _pairs(self, costs: np.ndarray, free: np.ndarray) -> tuple[list[int], list[int]]:
        """Rows and cells (lane, detection) that meet: confirmed tracks choose first, then tentative ones, then all that are left, where
        they were seen last. ``free``: detections of each lane; no pair is between lanes, so one call pairs all."""
        n, rest, met, taken = free.shape[1], np.ones(len(self.rows), bool), [], []
        sure = self.rows[:, _SURE] > 0
        costs -= self.row_limit
        for gain, who in ((costs[0], sure), (costs[0], ~sure), (costs[1], rest)):
            if not who.any():
                continue
            could = gain < 0
            could &= free[self.lane]
            could &= (rest & who)[:, None]
            rows, cols = np.nonzero(could)
            if not len(rows):
                continue
            edges: dict[int, list] = {}
            for cell, v, r in zip((self.lane[rows] * n + cols).tolist(), gain[rows, cols].tolist(), rows.tolist(), strict=True):
                if cell in edges:
                    edges[cell].append((v, r))
                else:
                    edges[cell] = [(v, r)]
            cells, got = list(edges), pair_edges(list(edges.values()))
            met += got
            taken += [cells[i] for i in got.values()]
            rest[met] = False
            free.reshape(-1)[taken] = False
        return met, taken

    def _meet(self, frame: int, before: np.ndarray, rows: list[int], boxes: np.ndarray, labels: np.ndarray) -> None:
        """Tracks that were seen take on their boxes; the others have a gap."""
        x, s = self.rows, _SEEN
        alone = np.ones(len(x), bool)
        alone[rows] = False
        fresh = alone & (x[:, _GAP] == 0)
        x[fresh, _KEPT] = before[fresh]
        x[:, s:-2] = x[:, s + 2 :]
        x[:, -2:] = np.nan
        if rows:
            new, centres = x[rows], _centre(boxes)
            new[:, _STATE], new[:, _BOX], new[:, _LAST], new[:, -2:] = self._corrected(new, boxes), boxes, frame, centres
            new[:, _HITS] += 1
            new[:, _SURE] = (new[:, _SURE] > 0) | (new[:, _HITS] >= self.tentative[self.lane[rows]])
            way = np.where(np.isnan(new[:, s : s + 2]), 0, (centres - new[:, s : s + 2]) / 2)
            new[:, _WAY] = way / (np.sqrt(way[:, :1] ** 2 + way[:, 1:] ** 2) + 1e-6)
            x[rows], self.labels[rows] = new, labels
        x[:, _GAP] += 1
        x[rows, _GAP] = 0
        x[:, _FROM] = x[:, s : s + 2]
        missing = np.flatnonzero(np.isnan(x[:, s]))
        if len(missing):
            x[missing, _FROM] = _centre(x[missing, _BOX])

    def _open(self, frame: int, lanes: list[int], boxes: np.ndarray, labels: np.ndarray) -> list[int]:
        """Ids of new tracks."""
        ids = []
        for k in lanes:
            ids.append(self.next_id[k])
            self.next_id[k] += 1
        x = np.zeros((len(lanes), self.rows.shape[1]))
        x[:, :4] = to_state(boxes)
        p, v = 2 * self.position * x[:, 3], 10 * self.velocity * x[:, 3]
        x[:, 8:12], x[:, 16:20] = (p * p)[:, None], (v * v)[:, None]
        x[:, 10], x[:, 18] = 1e-2**2, 1e-5**2
        x[:, _KEPT], x[:, _BOX], x[:, _LAST], x[:, _LANE], x[:, _HITS], x[:, _SURE], x[:, _ID] = x[:, _STATE], boxes, frame, lanes, 1, frame == 0, ids
        x[:, _SEEN:] = np.nan
        x[:, _FROM] = x[:, -2:] = _centre(boxes)
        self._put(x, labels)
        return ids

    def step(self, frame: int, videos: np.ndarray, boxes: np.ndarray, labels: np.ndarray, scores: np.ndarray) -> np.ndarray:
        """Track ids of a frame's detections (columns), which are sorted by video, by each setting (rows). Videos without detections do
        not take part."""
        if len(videos) and videos[-1] >= self.videos:
            self.grow(int(videos[-1]) + 1)
        many = np.bincount(videos, minlength=self.videos)
        goes = frame > self.last_frame
        if len(boxes):
            goes &= (many > 0)[self.video]
        apart = None
        if not goes.all():  # lanes that do not take part are put aside
            own = goes[self.lane]
            apart = self.rows[~own], self.labels[~own]
            self.rows, self.labels = self.rows[own], self.labels[own]
            self._by_row()
        if (frame > self.last_frame[goes] + 1).any():
            self.drop(frame - 1, (self.last_frame < frame - 1)[self.lane])
        self.last_frame[goes] = frame
        had = np.bincount(self.lane, minlength=len(goes)) > 0
        # a video's detections as a row of a table
        wide = int(many.max()) if len(many) else 0
        place = np.arange(len(boxes)) - np.repeat(np.cumsum(many) - many, many)
        b, kinds, s = np.zeros((4, self.videos, wide)), np.zeros((self.videos, wide), labels.dtype), np.zeros((self.videos, wide))
        b[:, videos, place], kinds[videos, place], s[videos, place] = boxes.T, labels, scores
        at = np.cumsum(many) - many  # the first detection of each video
        there = (np.arange(wide) < many[:, None])[self.video] & goes[:, None]
        lane_scores = s[self.video]
        over = there & (lane_scores > self.least[:, None])
        free = over.copy()
        ids = np.full(over.shape, -1, np.int64)
        if len(self.rows):
            before = self._predict(frame)
            rows, cells = self._pairs(self._costs(b, kinds, s), free) if wide else ([], [])
            lanes, cols = np.divmod(np.array(cells, int), max(wide, 1))
            ids[lanes, cols] = self.rows[rows, _ID]
            dets = at[self.video[lanes]] + cols
            self._meet(frame, before, rows, boxes[dets], labels[dets])
        opens = (ids < 0) & (over if had.all() else np.where(had[:, None], over, there & (lane_scores > self.start[:, None])))
        if opens.any():
            lanes, cols = np.nonzero(opens)
            dets = at[self.video[lanes]] + cols
            ids[lanes, cols] = self._open(frame, lanes.tolist(), boxes[dets], labels[dets])
        if had.any():
            self.drop(frame, True if had.all() else had[self.lane])
        if apart is not None:
            self._put(*apart)
        return ids.reshape(self.videos, self.settings, wide)[videos, :, place].T


@dataclass
class ObservationTracker:
    """Association by predicted overlap and by the direction of motion between observations; tracks without a match are
    looked for where they were seen last; a track that comes back is corrected along a straight path over the gap.

    least, start: scores that a detection has to pass to be matched, and to open a track in an empty scene; match: least
    overlap; weigh: overlap times score; tentative: hits that confirm a track; momentum: weight of the direction's angle;
    back: observations between the two that give a direction; keep: frames that a lost track lives.
    """

    least: float = 0.3
    start: float = 0.7
    match: float = 0.3
    weigh: bool = True
    tentative: int = 3
    momentum: float = 0.2
    back: int = 3
    keep: int = 30
    kalman: Kalman = field(default_factory=Kalman)
    _lanes: _Lanes | None = field(default=None, init=False, repr=False, compare=False)

    @property
    def live(self) -> dict[int, dict]:
        """Live tracks by id, as they are now."""
        return self._lanes.live(0) if self._lanes else {}

    @property
    def next_id(self) -> int:
        return self._lanes.next_id[0] if self._lanes else 0

    def step(self, frame: int, boxes: np.ndarray, labels: np.ndarray, scores: np.ndarray, embeds: np.ndarray | None = None) -> np.ndarray:
        self._lanes = self._lanes or _Lanes([replace(self)])
        return self._lanes.step(frame, np.zeros(len(boxes), int), boxes, labels, scores)[0]


# ---------------------------------------------------------------- motion and appearance


@dataclass
class AppearanceTracker(_Live):
    """Confirmed tracks by appearance within a gate of their motion, then all tracks of the frame before by overlap.

    least: score; measure: 'cosine' with an average of the appearance (``average``: weight of the new one), or 'euclidean'
    with the mean of the last ``samples`` ones; near: greatest distance; motion: share of the squared gate distance in the
    cost; gate: limit of that distance, on centres only if ``centres``; by_score: observation noise falls with the score;
    match: least overlap; tentative, keep: as above. Without embeddings only the overlap stage is left.
    """

    least: float = 0.6
    measure: str = "cosine"
    average: float = 0.1
    samples: int = 10
    near: float = 0.3
    motion: float = 0.02
    centres: bool = True
    by_score: bool = True
    match: float = 0.7
    tentative: int = 2
    keep: int = 100
    kalman: Kalman = field(default_factory=Kalman)

    @classmethod
    def plain(cls, **other) -> AppearanceTracker:
        """Euclidean distances over a few last appearances, motion as a gate only."""
        return cls(**{"least": 0.5, "measure": "euclidean", "near": 2.0, "motion": 0.0, "centres": False, "by_score": False, "match": 0.5, **other})

    def _distance(self, ids: list[int], embeds: np.ndarray) -> np.ndarray:
        x = np.array([self.live[i]["mean"] for i in ids])
        if self.measure == "euclidean":
            return np.linalg.norm(x[:, None] - embeds[None], axis=-1)
        unit = lambda v: v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
        return 1 - unit(x) @ unit(embeds).T

    def _remember(self, t: dict, embed: np.ndarray | None) -> None:
        if embed is None:
            return
        if self.measure == "euclidean":
            t["look"] = [*t["look"], embed][-self.samples :]
        else:
            t["look"] = [(1 - self.average) * t["look"][0] + self.average * embed] if t["look"] else [embed]
        t["mean"] = t["look"][0] if len(t["look"]) == 1 else np.mean(t["look"], axis=0)

    def step(self, frame: int, boxes: np.ndarray, labels: np.ndarray, scores: np.ndarray, embeds: np.ndarray | None = None) -> np.ndarray:
        out = np.full(len(boxes), -1, np.int64)
        if not self.opens(frame):
            return out
        some = np.flatnonzero(scores > self.least)
        ids = np.full(len(some), -1, np.int64)
        det, kinds, looks = boxes[some], labels[some], None if embeds is None else embeds[some]
        states = to_state(det)
        if self.live and len(some):
            self.kalman.predict_all(list(self.live.values()))
            sure = [i for i, t in self.live.items() if t["sure"]]
            if sure and looks is not None:
                gate = self.kalman.gate(np.array([self.live[i]["m"] for i in sure]), np.array([self.live[i]["c"] for i in sure]), states, self.centres)
                gate = np.where(gate > CHI2_95[1 if self.centres else 3], np.nan, gate)
                cost = (1 - self.motion) * np.where(np.isnan(gate), np.nan, self._distance(sure, looks)) + self.motion * gate
                cost = cost + foreign([self.live[i]["label"] for i in sure], kinds)
                for r, c in pair_then_cut(cost, lambda x: x <= self.near):
                    ids[c] = sure[r]
            met = set(ids.tolist())
            late = [i for i, t in self.live.items() if i not in met and t["last"] == frame - 1]
            free = np.flatnonzero(ids < 0)
            if late and len(free):
                cost = 1 - overlaps(np.array([self.live[i]["box"] for i in late]), det[free]) + foreign([self.live[i]["label"] for i in late], kinds[free])
                for r, c in pair_then_cut(cost, lambda x: x < 1 - self.match):
                    ids[free[c]] = late[r]
        old = np.flatnonzero(ids >= 0)
        self.kalman.update_all([self.live[int(i)] for i in ids[old]], states[old], scores[some[old]][:, None] if self.by_score else 0.0)
        for d in range(len(some)):
            i = int(ids[d])
            if i < 0:
                i = ids[d] = self.number()
                m, c = self.kalman.start(states[d])
                t = self.live[i] = {"hits": 1, "sure": False, "look": [], "m": m, "c": c}
            else:
                t = self.live[i]
                t["hits"] += 1
                t["sure"] = t["sure"] or t["hits"] >= self.tentative
            t.update(box=det[d], label=kinds[d], last=frame)
            self._remember(t, None if looks is None else looks[d])
        out[some] = ids
        self.drop(frame)
        return out


# ---------------------------------------------------------------- dense similarity


@dataclass
class SimilarityTracker(_Live):
    """Matching by similarity of appearance alone, both ways: softmax over the memory and over the detections.

    The memory has live tracks and the detections of the last ``backdrops`` frames that joined none; a detection that
    resembles one of those most follows no track. start, sure, match: scores that open a track, that may follow one, and that
    a match needs; doubtful: match of a weak detection that is no new object; keep: frames that a track lives; average:
    weight of a new appearance; twin, twin_weak: overlap over which a worse detection is a double, for sure and weak ones.
    """

    start: float = 0.8
    sure: float = 0.5
    match: float = 0.5
    keep: int = 10
    backdrops: int = 1
    average: float = 0.8
    doubtful: float = 0.5
    twin_weak: float = 0.3
    twin: float = 0.7
    by_label: bool = True
    metric: str = "bisoftmax"
    behind: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)

    def _likeness(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        def softmax(x: np.ndarray, axis: int) -> np.ndarray:
            e = np.exp(x - x.max(axis=axis, keepdims=True))
            return e / e.sum(axis=axis, keepdims=True)

        if self.metric == "cosine":
            return a @ b.T / np.maximum(np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(b, axis=1)[None], 1e-12)
        x = a @ b.T
        return (softmax(x, 1) + softmax(x, 0)) / 2 if self.metric == "bisoftmax" else softmax(x, 1)

    def step(self, frame: int, boxes: np.ndarray, labels: np.ndarray, scores: np.ndarray, embeds: np.ndarray) -> np.ndarray:
        out = np.full(len(boxes), -1, np.int64)
        if frame <= self.last_frame or not len(boxes):
            return out
        self.last_frame = frame
        order = np.argsort(-scores, kind="stable")
        o = np.triu(overlaps(boxes[order], boxes[order]), 1)  # with better ones only
        limit = np.where(scores[order] < self.sure, self.twin_weak, self.twin)
        order = order[~(o > limit[None]).any(0)]
        box, label, score, look = boxes[order], labels[order], scores[order], embeds[order]
        ids = np.full(len(order), -1, np.int64)
        if self.live:
            known = [*self.live, *[-1 for k, _ in self.behind for _ in k]]
            kinds = np.array([*[t["label"] for t in self.live.values()], *[x for k, _ in self.behind for x in k]])
            like = self._likeness(look, np.array([*[t["look"] for t in self.live.values()], *[x for _, e in self.behind for x in e]]))
            if self.by_label:
                like = like * (label[:, None] == kinds[None])
            for d in range(len(order)):
                best = int(like[d].argmax())
                if like[d, best] <= self.match or known[best] < 0:
                    continue
                if score[d] > self.sure:
                    ids[d], like[np.arange(len(order)) != d, best] = known[best], 0.0
                elif like[d, best] > self.doubtful:
                    ids[d] = -2
        for d in np.flatnonzero((ids == -1) & (score > self.start)):
            ids[d] = self.number()
        for d in np.flatnonzero(ids >= 0):
            t = self.live.get(int(ids[d]))
            fresh = look[d] if t is None else (1 - self.average) * t["look"] + self.average * look[d]
            self.live[int(ids[d])] = {"look": fresh, "label": label[d], "last": frame, "sure": True}
        rest = np.flatnonzero(ids == -1)
        alone = rest[~(np.triu(overlaps(box, box), 1)[:, rest] > self.twin_weak).any(0)]
        self.behind = [(label[alone], look[alone]), *self.behind][: self.backdrops]
        self.drop(frame)
        out[order] = np.maximum(ids, -1)
        return out


@dataclass
class WeightedTracker(_Live):
    """The best of all earlier objects, or none, by a sum of log similarity, log score, overlap and equal label.

    The similarity is a softmax over the products of appearances with all live tracks and a zero for a new object.
    Detections choose in order: one whose track was chosen by a better match before gets no id, and one that matches
    better than the earlier ones gets the same id as they.
    """

    by_score: float = 1.0
    by_overlap: float = 2.0
    by_label: float = 10.0
    keep: int = 20

    def step(self, frame: int, boxes: np.ndarray, labels: np.ndarray, scores: np.ndarray, embeds: np.ndarray) -> np.ndarray:
        out = np.full(len(boxes), -1, np.int64)
        if frame <= self.last_frame or not len(boxes):
            return out
        self.last_frame = frame
        known = list(self.live)
        if not known:
            out[:] = [self.number() for _ in boxes]
        else:
            x = np.hstack([np.zeros((len(boxes), 1)), embeds @ np.array([t["look"] for t in self.live.values()]).T])
            x = x - x.max(axis=1, keepdims=True)
            same = labels[:, None] == np.array([t["label"] for t in self.live.values()])[None]
            new = np.zeros((len(boxes), 1))
            match = x - np.log(np.exp(x).sum(axis=1, keepdims=True)) + self.by_score * np.log(np.maximum(scores, 1e-300))[:, None]
            match += self.by_overlap * np.hstack([new, overlaps(boxes, np.array([t["box"] for t in self.live.values()]))]) + self.by_label * np.hstack([new + 1, same])
            best = {i: -NEVER for i in known}
            for d, c in enumerate(match.argmax(axis=1)):
                if c == 0:
                    out[d] = self.number()
                elif match[d, c] > best[known[c - 1]]:
                    out[d], best[known[c - 1]] = known[c - 1], match[d, c]
        for d in np.flatnonzero(out >= 0):
            self.live[int(out[d])] = {"look": embeds[d], "box": boxes[d], "label": labels[d], "last": frame, "sure": True}
        self.drop(frame)
        return out


# ---------------------------------------------------------------- walking


def columns(part: pd.DataFrame) -> tuple:
    """What a tracker's step takes, from the rows of a frame."""
    embeds = np.array(part["embedding"].tolist(), float) if "embedding" in part else None
    return part[list(CORNERS)].to_numpy(float), part["label"].to_numpy(), part["score"].to_numpy(float), embeds


def _walk(make: Callable[[object], object], keys: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, tracker, rest = None, None, None

        def frames(rows: pd.DataFrame) -> pd.DataFrame:
            nonlocal now, tracker
            got, values = [], [rows[k].to_numpy() for k in (*keys, "frame_id")]
            boxes, labels, scores, embeds = columns(rows)
            new = np.ones(len(rows), bool)
            new[1:] = np.any([v[1:] != v[:-1] for v in values], axis=0)
            starts = np.flatnonzero(new).tolist()
            for a, b in zip(starts, [*starts[1:], len(rows)], strict=True):
                *video, frame = (v[a] for v in values)
                if video != now:
                    now, tracker = video, make(video[0])
                got.append(tracker.step(int(frame), boxes[a:b], labels[a:b], scores[a:b], None if embeds is None else embeds[a:b]))
            return rows.assign(track_id=np.concatenate(got))

        for batch in batches:
            rows = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            if not len(rows):
                continue
            last = (rows[[*keys, "frame_id"]] == rows[[*keys, "frame_id"]].iloc[-1]).all(axis=1)
            rest = rows[last]  # its frame may go on in the next batch
            if not last.all():
                yield frames(rows[~last])
        if rest is not None and len(rest):
            yield frames(rest)

    return run


def walk(det: DataFrame, make: Callable[[object], object], by: tuple[str, ...] = ("video_id",)) -> DataFrame:
    """``det`` (video_id, frame_id, det_id, label, score, corners; embedding where the tracker needs it) with track_id.

    ``make`` gives a new tracker for each group of ``by``; it is called with the value of the first column of ``by``."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in det.schema.fields) + ", track_id long"
    x = dealt(det, by).sortWithinPartitions(*by, "frame_id", "det_id")
    return x.mapInPandas(_walk(make, list(by)), schema)


#: Videos that are dealt one by one, the longest first; more of them are even enough when dealt by hash.
FEW_VIDEOS = 4096
#: Lanes that a task walks side by side, and the least number of tasks that videos are dealt to.
LANES, TASKS = 32, 8


def _dealt_videos(rows: DataFrame, det: DataFrame, settings: int) -> DataFrame:
    """``rows`` dealt by video, sorted by _turn, frame, video and the columns after these: videos of a turn walk side by side.

    The videos of ``det`` are counted, so that each task gets as many of them, and no more at once than ``LANES`` allows."""
    spark = rows.sparkSession
    many = int(spark.conf.get("spark.sql.shuffle.partitions"))
    few = det.groupBy("video_id").count().orderBy(F.desc("count"), "video_id").limit(FEW_VIDEOS + 1).collect()
    own = F.xxhash64("video_id")
    if len(few) > FEW_VIDEOS:
        x = rows.withColumns({"_task": F.pmod(own, F.lit(many)).cast("int"), "_turn": own})
    else:
        many, at_once = min(many, max(spark.sparkContext.defaultParallelism, TASKS)), max(1, LANES // settings)
        kind = det.schema["video_id"].dataType.simpleString()
        table = spark.createDataFrame([(r.video_id, i % many, i // many // at_once) for i, r in enumerate(few)], f"_video {kind}, _task int, _turn long")
        x = rows.join(F.broadcast(table), F.col("video_id").eqNullSafe(F.col("_video")), "left").drop("_video")
        x = x.withColumns({"_task": F.coalesce("_task", F.pmod(own, F.lit(many)).cast("int")), "_turn": F.coalesce("_turn", own)})
    order = ("side", "id") if "side" in rows.columns else ("det_id",)
    return x.repartitionById(many, F.col("_task")).drop("_task").sortWithinPartitions("_turn", "frame_id", "video_id", *order)


class _Slots:
    """Numbers of the videos of a turn, in the order of their first rows."""

    def __init__(self) -> None:
        self.videos: dict[object, int] = {}

    def of(self, videos: np.ndarray) -> np.ndarray:
        new = np.ones(len(videos), bool)
        new[1:] = videos[1:] != videos[:-1]
        numbers = [self.videos.setdefault(v, len(self.videos)) for v in videos[new].tolist()]
        return np.array(numbers)[np.cumsum(new) - 1]


def _array(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy(zero_copy_only=False)


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray, list[tuple[int, int, bool]]]]:
    """Tables of whole frames, their frames, and (start, end, whether a turn begins) of each."""
    turn = None
    for table, starts in _whole(batches, ("_turn", "frame_id")):
        turns, at = _array(table, "_turn"), starts.tolist()
        frames = []
        for a, b in zip(at, [*at[1:], table.num_rows], strict=True):
            frames.append((a, b, turns[a] != turn))
            turn = turns[a]
        yield table, _array(table, "frame_id"), frames


def _together(rules: ObservationTracker):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lanes = slots = None
        for table, frame, frames in _turns(batches):
            videos, labels, scores = (_array(table, c) for c in ("video_id", "label", "score"))
            boxes, got = np.stack([_array(table, c) for c in CORNERS], axis=1).astype(float), np.empty(table.num_rows, np.int64)
            for a, b, begins in frames:
                if begins:
                    lanes, slots = _Lanes([rules]), _Slots()
                of = slots.of(videos[a:b])
                order = a + np.argsort(of, kind="stable")
                got[order] = lanes.step(int(frame[a]), of[order - a], boxes[order], labels[order], scores[order])[0]
            yield from table.drop_columns(["_turn"]).append_column("track_id", pa.array(got)).to_batches()

    return run


def walk_together(det: DataFrame, rules: ObservationTracker) -> DataFrame:
    """As ``walk`` by video with trackers of these rules; the videos of a task walk side by side."""
    if not _Lanes.alike([rules]):
        return walk(det, lambda _: replace(rules))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in det.schema.fields) + ", track_id long"
    return _dealt_videos(det, det, 1).mapInArrow(_together(rules), schema)


class _Alone:
    """Trackers of any kind as ``_Lanes``: each video and setting has its own."""

    def __init__(self, settings: list[Callable[[], object]]) -> None:
        self.settings, self.trackers = settings, []

    def step(self, frame: int, videos: np.ndarray, boxes: np.ndarray, labels: np.ndarray, scores: np.ndarray, embeds: np.ndarray | None) -> np.ndarray:
        out = np.full((len(self.settings), len(boxes)), -1, np.int64)
        for v in np.unique(videos).tolist():
            while len(self.trackers) <= v:
                self.trackers.append([make() for make in self.settings])
            own = videos == v
            for k, t in enumerate(self.trackers[v]):
                out[k, own] = t.step(frame, boxes[own], labels[own], scores[own], None if embeds is None else embeds[own])
        return out


def _trials(settings: dict[str, Callable[[], object]], threshold: float):
    """Counts of each setting and video: detections (side 0) of a frame are tracked in all settings, then compared with its ground
    truth (side 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lanes = slots = None
        counts: list[list[Identity]] = []
        first = [make() for make in settings.values()]
        rules = first if _Lanes.alike(first) else None

        def ended() -> Iterator[pa.RecordBatch]:
            for of in counts:
                yield from (pa.RecordBatch.from_pandas(x.end()[["setting", *COUNTS]], preserve_index=False) for x in of)

        for table, frame, frames in _turns(batches):
            videos, sides, labels, scores, ids = (_array(table, c) for c in ("video_id", "side", "label", "score", "id"))
            boxes = np.stack([_array(table, c) for c in CORNERS], axis=1).astype(float)
            looks = table.column("embedding") if "embedding" in table.column_names else None
            for a, b, begins in frames:
                if begins:
                    yield from ended()
                    lanes, slots, counts = _Lanes(rules) if rules else _Alone(list(settings.values())), _Slots(), []
                of, side = slots.of(videos[a:b]), sides[a:b]
                while len(counts) < len(slots.videos):
                    counts.append([Identity({"setting": n}, threshold) for n in settings])
                order = np.lexsort((of, side))
                n = int(np.count_nonzero(side == 0))
                d, g = order[:n], order[n:]
                det, gt = boxes[a + d], boxes[a + g]
                embeds = () if rules else (None if looks is None else np.array(looks.take(pa.array(a + d)).to_pylist(), float),)
                got = lanes.step(int(frame[a]), of[d], det, labels[a + d], scores[a + d], *embeds) if n else np.zeros((len(settings), 0), np.int64)
                true, many = ids[a + g], np.bincount(of[d], minlength=len(counts))
                ends = np.cumsum(many)
                for v in np.unique(of).tolist():
                    own, at = np.flatnonzero(of[g] == v), slice(int(ends[v] - many[v]), int(ends[v]))
                    own = own[np.argsort(true[own], kind="stable")]
                    o = overlaps(gt[own], det[at])
                    near = np.nonzero(o >= threshold)
                    apart, gi, (rows, cols) = (1 - o[near]).tolist(), true[own].tolist(), (x.tolist() for x in near)
                    for k, pi in enumerate(got[:, at].tolist()):
                        _count(counts[v][k], gi, pi, rows, cols, apart)
        yield from ended()

    return run


def _count(x: Identity, gi: list[int], ids: list[int], rows: list[int], cols: list[int], apart: list[float]) -> None:
    """A frame whose detections have these ids; those without one are left out, the others come by id."""
    order = sorted((p, c) for c, p in enumerate(ids) if p >= 0)
    if len(order) < len(ids):
        has = [ids[c] >= 0 for c in cols]
        rows, cols, apart = ([v for v, h in zip(x, has, strict=True) if h] for x in (rows, cols, apart))
    place = {c: i for i, (_, c) in enumerate(order)}
    x.count(gi, [p for p, _ in order], rows, [place[c] for c in cols], apart)


def search(det: DataFrame, gt: DataFrame, settings: dict[str, Callable[[], object]], threshold: float = 0.5) -> DataFrame:
    """setting, counts, mota, idf1, place: scores of each setting of a tracker, the best (by mota, then idf1) first.

    Detections and ground truth are read and dealt once; a task tracks a frame in every setting and compares it at once, so
    no setting's tracks are shuffled."""
    kind, of = det.schema["label"].dataType.simpleString(), ["video_id", "frame_id"]
    looks = ["embedding"] if "embedding" in det.columns else []
    x = det.select(F.lit(0).alias("side"), *of, F.col("det_id").cast("long").alias("id"), "label", F.col("score").cast("double").alias("score"), *CORNERS, *looks)
    y = gt.select(F.lit(1).alias("side"), *of, F.col("track_id").cast("long").alias("id"), F.lit(0).cast(kind).alias("label"), F.lit(0.0).alias("score"), *CORNERS, *[F.lit(None).cast(det.schema[c].dataType).alias(c) for c in looks])
    schema = ", ".join(["setting string", *[f"{c} long" for c in COUNTS]])
    per = _dealt_videos(x.unionByName(y), det, len(settings)).mapInArrow(_trials(settings, threshold), schema)
    s = identity_ratios(per, ("setting",))
    return s.withColumn("place", F.row_number().over(Window.orderBy(F.desc("mota"), F.desc("idf1"), "setting")))  # a row for each setting
