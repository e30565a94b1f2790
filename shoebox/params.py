"""Typed thresholds of the operators. Values without a default are the caller's to choose."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Params:
    """The published thresholds that the operators use by default."""

    logit_scale: float = 100.0
    min_score: float = 0.16
    secondary_min_score: float = 0.16
    max_categories: int = 3
    sub_min_score: float = 0.4
    attr_min_score: float = 0.24
    dupe_similarity: float = 0.95
    burst_gap_sec: int = 30
    event_gap_hours: float = 3.0
    location_split_km: float = 30.0
    cover_count: int = 3
    cover_max_cosine: float = 0.9
    video_share: float = 0.4
    video_max_tags: int = 5
    frame_step_ms: int = 5000
    max_frames: int = 96
    scene_gap_ms: int = 10000
    relevance_window: float = 0.05
    relevance_max: int = 60
    close_limit: int = 120
    other_limit: int = 60
    scenes_per_video: int = 3
    personalise_alpha: float = 0.5
    personalise_min: int = 5
    small_day: int = 3
    day_gap: int = 3
    page_size: int = 300
    min_memory: int = 3
    min_folder: int = 3
    batch: int = 32
    max_attempts: int = 3
    encoder_stop: int = 8
    blur_threshold: float = 0.0


def patched(params: Params, patch: dict[str, float], allowed: frozenset[str] | None = None) -> Params:
    """params with the allowed names of patch, each kept whole or fractional as it was; other names are ignored."""
    kinds = {f.name: type(getattr(params, f.name)) for f in fields(params)}
    names = kinds.keys() if allowed is None else allowed & kinds.keys()
    return replace(params, **{k: kinds[k](v) for k, v in patch.items() if k in names})
