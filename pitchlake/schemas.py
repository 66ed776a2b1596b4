"""Column names, class numbers and default settings."""

from __future__ import annotations

from dataclasses import dataclass

BOX = ("x1", "y1", "x2", "y2")

CLASS_NAMES = {0: "ball", 1: "goalkeeper", 2: "player", 3: "referee", 4: "number"}
BALL, GOALKEEPER, PLAYER, REFEREE, NUMBER = CLASS_NAMES

#: Schemas as DDL text: a worker can import them without a JVM.
DETECTIONS = (
    "image_id bigint, det_idx int, class_id int, confidence double, x1 double, y1 double, x2 double, y2 double, tracker_id int"
)
COCO = (
    "info struct<description string, version string, date_created string>,"
    "images array<struct<id bigint, file_name string, width int, height int, license int, date_captured string>>,"
    "annotations array<struct<id bigint, image_id bigint, category_id int, bbox array<double>, area double, segmentation array<array<double>>, iscrowd int, score double>>,"
    "categories array<struct<id int, name string, supercategory string>>"
)


@dataclass(frozen=True)
class Settings:
    """Thresholds of the analysis; all comparisons with them are strict."""

    player_classes: tuple[int, ...] = (GOALKEEPER, PLAYER)
    number_class: int = NUMBER
    detector_confidence: float = 0.4
    read_every: int = 5
    match_overlap: float = 0.9
    number_streak: int = 3
    team_streak: int = 1
    crop_scale: float = 0.4
    crop_padding: float = 10.0
    least_area: float = 100.0
    keypoint_confidence: float = 0.5
    least_keypoints: int = 4
    scoreboard_confidence: float = 0.5
    jersey_confidence: float = 0.4
    basic_confidence: float = 0.3
    suppression_overlap: float = 0.25
    jump_sigma: float = 3.5
    least_jump: float = 0.6
    longest_jump_run: int = 18
    run_padding: int = 2


DEFAULTS = Settings()
