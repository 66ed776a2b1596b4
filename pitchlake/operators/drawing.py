"""What a renderer would draw, as rows: (image_id, det_idx, kind, x, y, w, h, color, text, z)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G

KINDS = {"box": 0, "mask": 1, "label": 2, "vertex": 3, "path": 4}


def palette_color(number: Column, palette: list[str]) -> Column:
    """The color of an index or a track, going round the palette."""
    return F.element_at(F.array(*[F.lit(c) for c in palette]), (F.pmod(number, F.lit(len(palette))) + 1).cast("int"))


def box_commands(boxes: DataFrame, palette: list[str], by: str | Column = "class_id", text: Column | None = None) -> DataFrame:
    """A box and, where there is a text, a label at the bottom centre of each detection; colors go by a column or a lookup of one's own."""
    x, y, w, h = G.xyxy_to_xywh(*G.box())
    cx, low = G.bottom_center(*G.box())
    color = palette_color(F.col(by) if isinstance(by, str) else by, palette)
    shape = F.struct(F.lit("box").alias("kind"), x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"), F.lit(None).cast("string").alias("text"), F.lit(KINDS["box"]).alias("z"))
    made = [shape]
    if text is not None:
        nil = F.lit(0.0)
        made.append(F.struct(F.lit("label").alias("kind"), cx.alias("x"), low.alias("y"), nil.alias("w"), nil.alias("h"), text.alias("text"), F.lit(KINDS["label"]).alias("z")))
    got = boxes.select("image_id", "det_idx", color.alias("color"), F.explode(F.array(*made)).alias("c"))
    return got.select("image_id", "det_idx", "c.kind", "c.x", "c.y", "c.w", "c.h", "color", "c.text", "c.z")


def path_commands(runs: DataFrame, color: str) -> DataFrame:
    """A line command for each run of a path: (tracker_id, run_id, first, last, color, z)."""
    return runs.select("tracker_id", "run_id", "first", "last", F.lit(color).alias("color"), F.lit(KINDS["path"]).alias("z"))


def court_commands(vertices: DataFrame, edges: list[tuple[int, int]], color: str) -> DataFrame:
    """The lines of the court: (a, b, x, y, x2, y2, color, z) for each edge between two vertices."""
    pairs = vertices.sparkSession.createDataFrame(edges, "a int, b int")
    end = lambda v, x, y: vertices.select(F.col("kp_idx").alias(v), F.col("cx").alias(x), F.col("cy").alias(y))
    got = pairs.join(end("a", "x", "y"), "a").join(end("b", "x2", "y2"), "b")
    return got.select("a", "b", "x", "y", "x2", "y2", F.lit(color).alias("color"), F.lit(KINDS["vertex"]).alias("z"))


def vertex_commands(points: DataFrame, color: str) -> DataFrame:
    """A dot for each keypoint or court position: (frame_idx, x, y, color, z)."""
    return points.select("frame_idx", "x", "y", F.lit(color).alias("color"), F.lit(KINDS["vertex"]).alias("z"))


def mask_commands(masks: DataFrame, palette: list[str], by: str = "tracker_id") -> DataFrame:
    """A filled mask for each detection: (image_id, det_idx, mask, color, z)."""
    return masks.select("image_id", "det_idx", "mask", palette_color(F.col(by), palette).alias("color"), F.lit(KINDS["mask"]).alias("z"))
