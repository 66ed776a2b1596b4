"""The per-frame loop as one stateful stream: throttled reads, matching, validation and labels as they lock."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..schemas import BOX, DEFAULTS, Settings
from .validate import step

#: Pairs of boxes that are compared at once.
PAIRS = 1 << 20
OUTPUT = "frame_idx bigint, det_idx int, tracker_id int, number string"


def _pairs(frame: np.ndarray, idx: np.ndarray, box: np.ndarray, players: np.ndarray, numbers: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """(player's row, number's row) of the pairs of a frame that match, by frame, falling overlap and both indices.

    ``frame`` doesn't fall. Pairs are compared about ``PAIRS`` at once.
    """
    players, numbers = (k[frame[k] % s.read_every == 0] for k in (players, numbers))
    first, end = (np.searchsorted(frame[numbers], frame[players], side) for side in ("left", "right"))
    size, got = end - first, []
    cuts = np.unique(np.append(np.searchsorted(np.cumsum(size), np.arange(PAIRS, size.sum(), PAIRS)), [0, len(players)]))
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        p, n = np.repeat(players[lo:hi], size[lo:hi]), numbers[np.arange(size[lo:hi].sum()) + np.repeat(first[lo:hi] - (np.cumsum(size[lo:hi]) - size[lo:hi]), size[lo:hi])]
        ios = smaller_overlaps(box[p], box[n])
        on = ios > s.match_overlap
        got.append((p[on], n[on], ios[on]))
    if not got:
        return players[:0], players[:0]
    p, n, ios = (np.concatenate(x) for x in zip(*got))
    order = np.lexsort((idx[n], idx[p], -ios, frame[p]))
    return p[order], n[order]


def smaller_overlaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Intersection over the smaller area of each box of a and the one of b beside it."""
    w = np.minimum(a[:, 2], b[:, 2]) - np.maximum(a[:, 0], b[:, 0])
    h = np.minimum(a[:, 3], b[:, 3]) - np.maximum(a[:, 1], b[:, 1])
    size = lambda x: (x[:, 2] - x[:, 0]) * (x[:, 3] - x[:, 1])
    least = np.minimum(size(a), size(b))
    return np.where(least > 0, np.clip(w, 0, None) * np.clip(h, 0, None) / np.where(least > 0, least, 1), 0.0)


def _video(rows: pd.DataFrame, tracks: dict[str, list], s: Settings) -> pd.DataFrame:
    """The rows to emit of one video's frames, in order; ``tracks`` is carried on.

    A frame's reads count for the frame itself, so a track's number is there from the frame on that locks it: only reads are
    gone through one by one.
    """
    frame, idx, value = rows["frame_idx"].to_numpy(), rows["det_idx"].to_numpy(), rows["value"].to_numpy(object)
    box, track, kind = np.column_stack([rows[c].to_numpy(float) for c in BOX]), rows["tracker_id"].to_numpy(), rows["class_id"].to_numpy()
    player = np.isin(kind, s.player_classes)
    before = {k: v[2] for k, v in tracks.items() if v[2] is not None}
    for p, n in zip(*_pairs(frame, idx, box, np.flatnonzero(player), np.flatnonzero(kind == s.number_class), s)):
        key = str(int(track[p]))
        tracks[key] = list(step(tuple(tracks.get(key, (None, 0, None, None))), [int(frame[p])], [value[n]], s.number_streak))
    big = np.flatnonzero(player & ((box[:, 2] - box[:, 0]) * (box[:, 3] - box[:, 1]) > s.least_area))
    number = np.full(len(big), None, object)
    own = track[big]
    for key, (_, _, locked, at) in tracks.items():
        if locked is not None:
            here = own == int(key)
            number[here if key in before else here & (frame[big] >= at)] = locked
    return pd.DataFrame({"frame_idx": frame[big], "det_idx": idx[big], "tracker_id": own.astype(np.int32), "number": pd.Series(number, dtype=object)})


def identify_stream(boxes: DataFrame, s: Settings = DEFAULTS, key: str = "video_id") -> DataFrame:
    """(video_id, frame_idx, det_idx, tracker_id, number): each large enough player box with the number its track has by then.

    ``boxes``: (video_id, frame_idx, det_idx, class_id, tracker_id, value, box), players with a track and numbers with what was
    read. A video's frames come in order and whole: those of one micro-batch are put in order here, those of a later
    one must not be earlier. Numbers of every ``read_every``-th frame count. A video's state is four
    fields for each track; what is emitted is what ``identity.identify`` gives in its ``online`` mode.
    """

    def of(name: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tracks: dict[str, list] = json.loads(state.get[0]) if state.exists else {}
        rows = pd.concat(list(batches)).sort_values(["frame_idx", "det_idx"], kind="stable")
        got = _video(rows, tracks, s)
        state.update((json.dumps(tracks),))
        yield got.assign(**{key: name[0]})[[key, "frame_idx", "det_idx", "tracker_id", "number"]]

    kind = boxes.schema[key].dataType.simpleString()
    return boxes.groupBy(key).applyInPandasWithState(of, f"{key} {kind}, {OUTPUT}", "tracks string", "append", GroupStateTimeout.NoTimeout)
