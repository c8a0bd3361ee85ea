"""Tracking over a stream of frames: state is kept by video between micro-batches, late frames get no track."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.trackers import columns
from ..operators.tracking import CORNERS, Rules, Tracker

OUT = "video_id long, frame_id long, det_id long, label long, score double, x1 double, y1 double, x2 double, y2 double, track_id long"


def _advance(rules: Rules, idle: int | None):
    def run(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:  # the video has ended
            state.remove()
            return
        tracker = Tracker(rules)
        if state.exists:
            tracks, next_id, last = pickle.loads(state.get[0])
            tracker.tracks, tracker.next_id, tracker.last_frame = tracks, next_id, last
        out = []
        for frame, part in pd.concat(list(frames)).sort_values(["frame_id", "det_id"]).groupby("frame_id"):
            ids = tracker.step(int(frame), part[list(CORNERS)].to_numpy(float), part["label"].to_numpy(), part["score"].to_numpy(float))
            out.append(part.assign(track_id=ids))
        state.update((pickle.dumps((tracker.tracks, tracker.next_id, tracker.last_frame)),))
        if idle is not None:
            state.setTimeoutDuration(idle)
        yield pd.concat(out)[[c.split()[0] for c in OUT.split(", ")]]

    return run


def track_stream(det: DataFrame, rules: Rules | None = None, idle: int | None = 3_600_000) -> DataFrame:
    """A streaming ``det`` (video_id, frame_id, det_id, label, score, corners) with track_id.

    Frames of a batch are sorted; frames at or before the last one seen of their video count as late. The state of a video
    holds its live tracks only, and is removed when no frame has come for ``idle`` milliseconds; should the video go on after
    that, its tracks begin anew. With None it is kept; with a limit, Spark runs batches without data too, so
    ``processAllAvailable`` does not return."""
    return det.groupBy("video_id").applyInPandasWithState(_advance(rules or Rules(), idle), OUT, "tracker binary", "append", GroupStateTimeout.NoTimeout if idle is None else GroupStateTimeout.ProcessingTimeTimeout)


def _go_on(make: Callable[[], object], idle: int | None, names: list[str]):
    def run(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        tracker = pickle.loads(state.get[0]) if state.exists else make()
        out = []
        for frame, part in pd.concat(list(frames)).sort_values(["frame_id", "det_id"]).groupby("frame_id"):
            out.append(part.assign(track_id=tracker.step(int(frame), *columns(part))))
        state.update((pickle.dumps(tracker),))
        if idle is not None:
            state.setTimeoutDuration(idle)
        yield pd.concat(out)[names]

    return run


def walk_stream(det: DataFrame, make: Callable[[], object], idle: int | None = None) -> DataFrame:
    """A streaming ``det`` with track_id, by any tracker of ``tessera.operators.trackers``; ``make`` gives a new one.

    A video's state is its tracker. With ``idle`` milliseconds without frames it is removed (see ``track_stream``)."""
    out = T.StructType([*det.schema.fields, T.StructField("track_id", T.LongType())])
    timeout = GroupStateTimeout.NoTimeout if idle is None else GroupStateTimeout.ProcessingTimeTimeout
    return det.groupBy("video_id").applyInPandasWithState(_go_on(make, idle, out.names), out, "tracker binary", "append", timeout)
