"""Every registered query of the core with its SQL equivalent."""

from __future__ import annotations

from weftgraph.queries import algebra, analytics, cookbook, semantic, stages, streams

_MODULES = (algebra, semantic, stages, analytics, cookbook, streams)

QUERIES = {name: run for m in _MODULES for name, run in m.R.queries.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.R.oracles.items()}
