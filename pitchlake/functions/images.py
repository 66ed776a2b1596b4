"""Raw pixels (height x width x channels bytes, row by row) as binary columns; a codec may be plugged in before."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CROP = "struct<width:int,height:int,pixels:binary>"


def crop_array(raw: bytes, width: int, height: int, box: tuple[float, float, float, float]) -> np.ndarray:
    """The pixels in a box, its corners cut to whole numbers and to the image; may be empty."""
    image = np.frombuffer(raw, np.uint8).reshape(height, width, -1)
    x1, y1, x2, y2 = (int(v) for v in box)
    return image[max(0, y1) : max(0, y2), max(0, x1) : max(0, x2)]


def resize_array(image: np.ndarray, width: int, height: int) -> np.ndarray:
    """To a new size by the nearest pixel."""
    h, w = image.shape[:2]
    if not h or not w:
        return np.zeros((height, width, image.shape[2]), np.uint8)
    return image[np.arange(height) * h // height][:, np.arange(width) * w // width]


def crop(image: Column, width: Column, height: Column, *box: Column, to: tuple[int, int] | None = None) -> Column:
    """The crop of each row's box, resized where ``to`` (width, height) is given; null where the image is."""

    @F.pandas_udf(CROP)
    def of(image: pd.Series, width: pd.Series, height: pd.Series, x1: pd.Series, y1: pd.Series, x2: pd.Series, y2: pd.Series) -> pd.DataFrame:
        rows = []
        for raw, w, h, *b in zip(image, width, height, x1, y1, x2, y2):
            got = None if raw is None else crop_array(raw, int(w), int(h), tuple(b))
            if got is not None and to:
                got = resize_array(got, *to)
            rows.append((None, None, None) if got is None else (got.shape[1], got.shape[0], got.tobytes()))
        return pd.DataFrame(rows, columns=["width", "height", "pixels"])

    return of(image, width, height, *box)


def map_frames(frames: DataFrame, callback: Callable[[bytes | None, int], bytes | None]) -> DataFrame:
    """Every frame's image through ``callback(image, frame_idx)``; all other columns stay."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(image=[callback(i, int(k)) for i, k in zip(b["image"], b["frame_idx"])])

    return frames.mapInPandas(of, frames.schema)


def write_frames(frames: DataFrame, path: str) -> None:
    """A folder for each video, its frames in order within each file."""
    frames.repartition("video_id").sortWithinPartitions("video_id", "frame_idx").write.mode("overwrite").partitionBy("video_id").parquet(path)
