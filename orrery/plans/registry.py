"""Name -> query and name -> SQL for the analytics operators."""

from __future__ import annotations

from orrery.plans import choices, geometry, grids, scores, statistics, timing

_PARTS = (statistics, timing, scores, geometry, grids, choices)

QUERIES = {name: f for part in _PARTS for name, f in part.QUERIES.items()}
ORACLES = {name: sql for part in _PARTS for name, sql in part.ORACLES.items()}
