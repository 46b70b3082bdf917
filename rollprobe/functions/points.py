"""Test points on the unit sphere along a golden-angle spiral."""

from __future__ import annotations

import math
from functools import lru_cache

GOLDEN_ANGLE = math.pi * (3.0 - math.sqrt(5.0))


@lru_cache(maxsize=32)
def sphere_points(n: int) -> tuple[tuple[float, float, float], ...]:
    """``n`` points; height and longitude are accumulated, so that sums round alike everywhere they are used."""
    if n < 1:
        raise ValueError("at least one point is needed")
    step = 2.0 / n
    z, turn, out = 1.0 - step / 2.0, 0.0, []
    for _ in range(n):
        r = math.sqrt(max(0.0, 1.0 - z * z))
        out.append((math.cos(turn) * r, math.sin(turn) * r, z))
        z, turn = z - step, turn + GOLDEN_ANGLE
    return tuple(out)
