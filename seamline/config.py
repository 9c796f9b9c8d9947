"""Settings of the engine in one immutable place; every operator also takes them as parameters."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class EngineConfig:
    session_cap_ms: int = 5_000
    window_size: int = 12
    window_stride: int = 6
    min_events: int = 2
    structural_weights: tuple[float, float, float, float] = (0.30, 0.30, 0.30, 0.10)
    trimodal_weights: tuple[float, float, float] = (0.4, 0.4, 0.2)
    refiner_mean: float = 0.5
    hub_share: float = 0.05
    least_dependency: float = 0.12
    damping_alpha: float = 15.0
    threshold_quantile: float = 0.7
    threshold_cap: float = 0.02
    small_cluster: int = 3
    seed: int = 42
    #: A system's own weights come before these defaults.
    system_weights: dict[str, tuple[float, ...]] = field(default_factory=dict)
