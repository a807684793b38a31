"""Defaults of the analyses, as immutable values that the operators take theirs from."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Typicality:
    fraction: float = 0.01
    min_neighborhood: int = 15


@dataclass(frozen=True)
class Exemplars:
    neighborhood: int = 1000
    skip: int = 0
    wanted: int = 16
    alt_neighborhood: int = 500


@dataclass(frozen=True)
class Representatives:
    density: float = 0.01
    inclusion: float = 0.15


@dataclass(frozen=True)
class Items:
    alpha: float = 0.05
    max_monotony: float = 0.975
    significant_size: int = 20
    dbscan_neighbors: int = 3
    dbscan_percentile: float = 0.8
    bootstrap_cutoff: int = 15
    bootstrap_samples: int = 10_000


@dataclass(frozen=True)
class Manifold:
    error: float = 0.02
    scale_percentile: float = 75
    scale_multiplier: float = 1.5
    min_neighbors: int = 3
