"""All queries of the core and their SQL."""

from __future__ import annotations

from lodegraph.plans import code, derived, graphs, snapshots, structure

QUERIES = {**code.QUERIES, **structure.QUERIES, **graphs.QUERIES, **derived.QUERIES, **snapshots.QUERIES}
ORACLES = {**code.ORACLES, **structure.ORACLES, **graphs.ORACLES, **derived.ORACLES, **snapshots.ORACLES}
