"""Privacy parameters."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum


class CompositionMode(Enum):
    """How the key-selection budget is divided over a user's contributions."""

    DWORK_ANALYTICAL = "DWORK_ANALYTICAL"
    OPTIMAL_KOV = "OPTIMAL_KOV"
    ZCDP_LINEAR = "ZCDP_LINEAR"


@dataclass(frozen=True)
class DPParams:
    """Total budget and limits; epsilon is split in halves, delta two thirds to one for key selection."""

    epsilon: float = 6.0
    delta: float = 1e-9
    max_contributions: int = 32
    clamp: float = 1.0
    mu: int = 50
    max_time_steps: int = 100
    alpha: float = 0.5
    composition: CompositionMode = CompositionMode.ZCDP_LINEAR

    def __post_init__(self):
        if self.max_time_steps < 2:
            raise ValueError("with one time step the noise scale is zero: at least two are needed")
        if not (self.epsilon > 0 and 0 < self.delta < 1 and self.max_contributions > 0 and self.clamp > 0 and 0 < self.alpha < 1):
            raise ValueError("privacy parameters out of range")

    @property
    def epsilon_key(self) -> float:
        return self.epsilon / 2

    @property
    def epsilon_hist(self) -> float:
        return self.epsilon / 2

    @property
    def delta_key(self) -> float:
        return self.delta * 2 / 3

    @property
    def delta_hist(self) -> float:
        return self.delta / 3
