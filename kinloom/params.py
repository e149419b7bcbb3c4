"""Parameters with their defaults."""

from __future__ import annotations

import math
from dataclasses import dataclass


@dataclass(frozen=True)
class Smoothing:
    """Block length, least block width, gap sites, tolerated share of deviating alleles."""

    length: int = 20
    width: int = 20
    gap: int = 1
    rho: float = 0.05


@dataclass(frozen=True)
class Detection:
    """Thresholds of seeds and segments; lengths in centiMorgans, gaps in base pairs."""

    min_seed: float = 2.0
    max_gap: int = 1000
    min_extend: float | None = None
    min_markers: int = 100
    min_mac: int = 2
    min_output: float = 2.0
    #: Runs that reach the last site need one marker more.
    closeout_strict: bool = True

    @property
    def extend_cm(self) -> float:
        return min(1.0, self.min_seed) if self.min_extend is None else self.min_extend

    @property
    def extend_markers(self) -> int:
        """Markers after the first that an extension needs."""
        return math.floor(self.extend_cm / self.min_seed * self.min_markers) - 1
