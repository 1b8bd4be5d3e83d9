"""Every knob of the retail analytics in one place."""

from __future__ import annotations

from dataclasses import dataclass

# Cut-offs of the retail tables by role.
CUTOFFS = {"early": "1996-01-01", "validation": "2000-12-04", "test": "2001-01-01"}


@dataclass(frozen=True)
class Params:
    """Windows, thresholds and sizes of the analytics."""

    rfm_days: int = 180
    popular_days: int = 90
    future_days: int = 28
    least_buyers: int = 5
    neighbours: int = 50
    neighbour_choices: tuple[int, ...] = (50, 100)
    least_co_buyers: float = 2
    basket_block: int = 2000
    k: int = 10
    supporters: int = 3
    merchandise: str = "^[0-9]{5}[A-Z]?$"
    bootstraps: int = 1000
    least_share: float = 0.03
    least_ari: float = 0.80
    least_silhouette: float = 0.30
    sample: int = 2000
    ks: tuple[int, ...] = (3, 4, 5, 6)
    seeds: tuple[int, ...] = (42, 43, 44, 45, 46)
    kmeans_restarts: int = 20
    mixture_restarts: int = 5
    least_gain: float = 0.10
    median_alert: float = 0.25
    share_alert: float = 0.10
    jaccard_alert: float = 0.70
    fallback_alert: float = 0.10


DEFAULT = Params()
