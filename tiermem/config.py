"""Parameters that change results, presets, and merging of nested mappings."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, fields, replace
from typing import Any


# fixed values: the parameters' defaults
@dataclass(frozen=True)
class Config:
    recent_capacity: int = 20
    baseline_recent_capacity: int | None = None
    episodic_capacity: int = 100
    novelty_threshold: float = 0.05
    episode_max_gap: float = 8.0
    episode_min_sim: float = 0.7
    episode_max_len: int | None = 8
    event_max_gap: float = 45.0
    event_min_episode_sim: float = 0.55
    episodic_merge_batch: int = 10
    sigma_center: float = 3.0
    sigma_time: float = 2.0
    lambda_center: float = 0.5
    mu_consistency: float = 0.5
    n_rep_windows: int = 2
    alpha: float = 0.7
    beta: float = 0.3
    top_m: int = 3
    top_k: int = 5
    baseline_top_k: int | None = None
    tau_fraction: float = 0.25
    neighbor_radius: int = 1
    recent_episodes: int = 5
    pin_recent_n: int | None = None
    max_frames: int = 8
    include_coarse: bool = True
    include_episodic: bool = True
    ground_archive: bool = True
    cut_on_query: bool = True
    late_query_time: str = "inf"

    @property
    def baseline_windows(self) -> int:
        return self.recent_capacity if self.baseline_recent_capacity is None else self.baseline_recent_capacity

    @property
    def baseline_k(self) -> int:
        return self.top_k if self.baseline_top_k is None else self.baseline_top_k

    @property
    def pin_n(self) -> int:
        return self.baseline_windows if self.pin_recent_n is None else self.pin_recent_n


# fixed values: the presets' parameters
PRESETS: dict[str, Config] = {
    "notebook": Config(),
    "streamingbench_tuned": Config(recent_capacity=30, baseline_recent_capacity=20, episodic_capacity=80, novelty_threshold=0.04, episode_max_gap=6, event_max_gap=40, event_min_episode_sim=0.58, episodic_merge_batch=8, top_m=2, top_k=6, baseline_top_k=5, tau_fraction=0.10, recent_episodes=8, pin_recent_n=20),
    "lvbench_tuned": Config(recent_capacity=30, baseline_recent_capacity=20, episodic_capacity=150, novelty_threshold=0.02, episode_max_gap=6, event_max_gap=30, event_min_episode_sim=0.62, episodic_merge_batch=15, top_m=2, top_k=8, baseline_top_k=5, tau_fraction=0.08, neighbor_radius=2, recent_episodes=8),
    "vlm_full": Config(max_frames=10),
    "vlm_streaming": Config(top_m=1, top_k=3, tau_fraction=0.10, neighbor_radius=0, recent_episodes=2, pin_recent_n=10, max_frames=6, include_coarse=False, include_episodic=False, ground_archive=False),
    "class_defaults": Config(baseline_recent_capacity=10, baseline_top_k=5, episodic_capacity=50, novelty_threshold=0.25, episode_max_gap=4, event_max_gap=15, tau_fraction=0.5, pin_recent_n=0),
    # the canonical test stream's
    "fixture": Config(novelty_threshold=0.12, episode_max_gap=12, episode_min_sim=0.5, event_max_gap=15, event_min_episode_sim=0.2, episodic_merge_batch=4, episodic_capacity=5, pin_recent_n=10, recent_episodes=2, baseline_recent_capacity=10),
}


# fixed values: names that configuration files use for some of the parameters above
ALIASES = {"reasoner_max_frames": "max_frames", "include_coarse_text": "include_coarse", "include_episodic_text": "include_episodic", "ground_episodic_archive": "ground_archive"}


def merged(raw: Mapping[str, Any], base: Config | None = None) -> Config:
    """A nested mapping over defaults: the sections memory, retrieval and reasoner, each over those before. Unknown keys are dropped."""
    known = {f.name for f in fields(Config)}
    flat: dict[str, Any] = {}
    for part in ("memory", "retrieval", "reasoner"):
        named = {ALIASES.get(k, k): v for k, v in dict(raw.get(part) or {}).items()}
        flat |= {k: v for k, v in named.items() if k in known}
    return replace(base or Config(), **flat)
