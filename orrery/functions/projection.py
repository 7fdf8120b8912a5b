"""Longitude and latitude (WGS 84) to UTM metres by the Krüger series, to a millimetre within a zone."""

from __future__ import annotations

import numpy as np

# The WGS 84 ellipsoid and the UTM scale and offsets.
A, FLATTENING, SCALE, EAST, SOUTH = 6378137.0, 1 / 298.257223563, 0.9996, 500_000.0, 10_000_000.0
_N = FLATTENING / (2 - FLATTENING)
_RADIUS = A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_ALPHA = (
    _N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180,
    13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440,
    61 * _N**3 / 240 - 103 * _N**4 / 140,
    49561 * _N**4 / 161280,
)


def to_utm(points: np.ndarray, epsg: int) -> np.ndarray:
    """Pairs of longitude and latitude in degrees -> easting and northing in zone 326nn or 327nn."""
    zone, south = epsg % 100, epsg // 100 == 327
    if epsg // 100 not in (326, 327) or not 1 <= zone <= 60:
        raise ValueError(f"EPSG:{epsg} is not a UTM zone of WGS 84")
    lon, lat = np.radians(points[:, 0] - (zone * 6 - 183)), np.radians(points[:, 1])
    e = 2 * np.sqrt(_N) / (1 + _N)
    t = np.sinh(np.arctanh(np.sin(lat)) - e * np.arctanh(e * np.sin(lat)))
    xi, eta = np.arctan2(t, np.cos(lon)), np.arctanh(np.sin(lon) / np.sqrt(1 + t * t))
    x = eta + sum(a * np.cos(2 * j * xi) * np.sinh(2 * j * eta) for j, a in enumerate(_ALPHA, 1))
    y = xi + sum(a * np.sin(2 * j * xi) * np.cosh(2 * j * eta) for j, a in enumerate(_ALPHA, 1))
    return np.stack([EAST + SCALE * _RADIUS * x, SCALE * _RADIUS * y + (SOUTH if south else 0.0)], axis=1)
