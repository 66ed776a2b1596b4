"""Tracks through a video: the objects of the first frame, followed by greedy overlap.

A mask propagation model may be plugged in as ``propagate``; without one, boxes are followed. The object set is
fixed by the first frame, as a prompted segmenter's is. A video is sequential, so it is one group; videos are
spread over the cluster.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

OUTPUT = "video_id bigint, frame_idx bigint, det_idx int, tracker_id int, x1 double, y1 double, x2 double, y2 double"


def overlaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """IoU of each box of a with each of b."""
    w = np.minimum(a[:, None, 2], b[None, :, 2]) - np.maximum(a[:, None, 0], b[None, :, 0])
    h = np.minimum(a[:, None, 3], b[None, :, 3]) - np.maximum(a[:, None, 1], b[None, :, 1])
    part = np.clip(w, 0, None) * np.clip(h, 0, None)
    size = lambda x: (x[:, 2] - x[:, 0]) * (x[:, 3] - x[:, 1])
    return part / np.maximum(size(a)[:, None] + size(b)[None, :] - part, 1e-12)


def follow(last: np.ndarray, boxes: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Pairs (object, box), best overlap first; each object and box at most once."""
    got, used_a, used_b = [], set(), set()
    iou = overlaps(last, boxes)
    for k in np.argsort(-iou, axis=None, kind="stable"):
        a, b = divmod(int(k), len(boxes))
        if iou[a, b] < least:
            break
        if a not in used_a and b not in used_b:
            used_a.add(a)
            used_b.add(b)
            got.append((a, b))
    return got


class Tracker:
    def __init__(self, least: float = 0.1):
        self.least = least
        self.boxes: np.ndarray | None = None

    def prompt(self, boxes: np.ndarray) -> None:
        if not len(boxes):
            raise ValueError("no detection to prompt with")
        self.boxes = boxes.copy()

    def propagate(self, boxes: np.ndarray) -> list[tuple[int, int]]:
        if self.boxes is None:
            raise RuntimeError("prompt the tracker first")
        got = follow(self.boxes, boxes, self.least) if len(boxes) else []
        for a, b in got:
            self.boxes[a] = boxes[b]
        return got

    def reset(self) -> None:
        self.boxes = None


def track(detections: DataFrame, make: Callable[[], Tracker] = Tracker) -> DataFrame:
    """Detections (video_id, frame_idx, det_idx, box) that belong to an object of the video's first frame, with its id."""

    def of(video: pd.DataFrame) -> pd.DataFrame:
        video = video.sort_values(["frame_idx", "det_idx"], kind="stable")
        frame = video["frame_idx"].to_numpy()
        boxes = video[["x1", "y1", "x2", "y2"]].to_numpy(float)
        cut = np.append(np.flatnonzero(np.append(True, frame[1:] != frame[:-1])), len(frame))
        tracker, rows, ids = make(), [], []
        for lo, hi in zip(cut[:-1], cut[1:]):
            if lo == 0:
                tracker.prompt(boxes[lo:hi])
            for a, b in tracker.propagate(boxes[lo:hi]):
                rows.append(lo + b)
                ids.append(a + 1)
        return video.iloc[rows].assign(tracker_id=ids)[["video_id", "frame_idx", "det_idx", "tracker_id", "x1", "y1", "x2", "y2"]]

    boxes = detections.select("video_id", "frame_idx", "det_idx", "x1", "y1", "x2", "y2")
    return boxes.groupBy("video_id").applyInPandas(of, OUTPUT)
