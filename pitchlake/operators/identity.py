"""Who a track is: team, validated number, roster name and label."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..schemas import DEFAULTS, Settings
from . import filters, sequence, spatial

def with_players(rows: DataFrame, rosters: DataFrame) -> DataFrame:
    """Rows (team_id, number) with ``player`` of the roster, null where the number isn't listed."""
    return rows.join(rosters.select("team_id", "number", "player"), ["team_id", "number"], "left")


def with_team_colors(rows: DataFrame, teams: DataFrame) -> DataFrame:
    return rows.join(teams, "team_id", "left")


def number_reads(players: DataFrame, numbers: DataFrame, s: Settings = DEFAULTS, keys: tuple[str, ...] = ("video_id", "frame_idx")) -> DataFrame:
    """Reads on tracks from every ``read_every``-th frame: (keys, tracker_id, pair_rank, value).

    The frames are chosen before the join, so that no number of another frame is matched (or read by a model).
    """
    players, numbers = (filters.every(d, s.read_every) for d in (players, numbers))
    pairs = spatial.match(players, numbers, s.match_overlap, keys, keep=("tracker_id",))
    return pairs.join(numbers.select(*keys, F.col("det_idx").alias("n_idx"), "value"), [*keys, "n_idx"]).select(*keys, "tracker_id", "pair_rank", "value")


def identify(players: DataFrame, numbers: DataFrame, teams: DataFrame, rosters: DataFrame, s: Settings = DEFAULTS, mode: str = "final") -> DataFrame:
    """Every large enough player box with its number, roster name and label.

    ``players``: (video_id, frame_idx, det_idx, tracker_id, box); ``numbers``: (video_id, frame_idx, det_idx, value,
    box); ``teams``: (video_id, tracker_id, team_id). ``mode`` is that of ``sequence.with_validated``.
    """
    track = ("video_id", "tracker_id")
    reads = number_reads(players, numbers, s)
    locked = sequence.validated(reads, s.number_streak, track, ("frame_idx", "pair_rank"))
    rows = filters.larger(players, s.least_area).select("video_id", "frame_idx", "det_idx", "tracker_id")
    rows = sequence.with_validated(rows, locked, track, name="number", mode=mode)
    rows = with_players(rows.join(teams, list(track), "left"), rosters)
    label = F.when(F.col("team_id").isNotNull(), X.player_label(F.col("number"), F.col("player")))
    return rows.select("video_id", "frame_idx", "det_idx", "tracker_id", "team_id", "number", "player", label.alias("label"))
