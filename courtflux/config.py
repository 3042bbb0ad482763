"""Parameters of the analytics, with the values of the shipped configuration as defaults."""

from __future__ import annotations

from dataclasses import dataclass


#: Defaults.
@dataclass(frozen=True)
class Config:
    # detection
    conf: float = 0.1
    nms_threshold: float = 0.9
    max_players: int = 10
    max_referees: int = 5
    min_hits: int = 4
    ball_score: float = 0.5
    ocr_conf: float = 0.9
    vote_mode: str = "majority"
    track_number_min_share: float = 0.6
    pose_iou: float = 0.3
    # possession and passes
    expand_share: float = 0.05
    expand_least: int = 3
    possession_seconds: float = 0.5
    owner_share: float = 0.55
    other_max_share: float = 0.35
    strict_other_max_share: float = 0.2
    hand_distance: float = 100.0
    pass_gap_seconds: float = 0.75
    team_tolerance: int = 5
    # shots
    shot_back_seconds: float = 0.5
    shot_forward_seconds: float = 0.75
    # smoothing
    max_gap_frames: int = 20
    median_radius: int = 15
    outlier_px: float = 30.0
    ball_gap_frames: int = 50
    # tracking
    num_tracks: int = 10
    max_skip: int = 15
    max_occlusion: int = 45
    edge_margin: int = 5
    # court
    court_length: float = 28.65
    court_width: float = 15.24


DEFAULT = Config()
