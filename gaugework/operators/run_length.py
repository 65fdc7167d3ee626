"""Average run lengths of control charts from Markov chains of a few hundred states, in numpy on the driver."""

from __future__ import annotations

from functools import lru_cache
from math import erf, sqrt

import numpy as np


def _phi(z: np.ndarray) -> np.ndarray:
    return np.array([0.5 * (1 + erf(v / sqrt(2))) for v in np.ravel(z)]).reshape(np.shape(z))


def _mean_steps(stay: np.ndarray, start: int) -> float:
    return float(np.linalg.solve(np.eye(len(stay)) - stay, np.ones(len(stay)))[start])


@lru_cache(maxsize=256)
def one_sided_cusum(k: float, h: float, shift: float, states: int = 200) -> float:
    """Steps until a one-sided CUSUM that starts at 0 passes h, when the mean is off by ``shift`` sigma."""
    width = 2 * h / (2 * states - 1)
    centre = np.arange(states) * width
    upper = centre[None, :] + width / 2 - centre[:, None] + k - shift
    stay = _phi(upper) - _phi(upper - width)
    stay[:, 0] = _phi(upper[:, 0])
    return _mean_steps(stay, 0)


def two_sided_cusum(k: float, h: float, shift: float, states: int = 200) -> float:
    return 1 / (1 / one_sided_cusum(k, h, shift, states) + 1 / one_sided_cusum(k, h, -shift, states))


@lru_cache(maxsize=256)
def ewma(lam: float, width: float, shift: float, states: int = 201) -> float:
    """Steps until an EWMA with limits of ``width`` asymptotic sigma signals."""
    limit = width * sqrt(lam / (2 - lam))
    step = 2 * limit / states
    centre = -limit + step * (np.arange(states) + 0.5)
    upper = (centre[None, :] + step / 2 - (1 - lam) * centre[:, None]) / lam - shift
    lower = (centre[None, :] - step / 2 - (1 - lam) * centre[:, None]) / lam - shift
    return _mean_steps(_phi(upper) - _phi(lower), states // 2)


def shewhart(k: float, shift: float = 0.0) -> float:
    inside = 0.5 * (erf((k - shift) / sqrt(2)) - erf((-k - shift) / sqrt(2)))
    return 1 / (1 - inside)
