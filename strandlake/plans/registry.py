"""All queries of the engine and their SQL, by name."""

from __future__ import annotations

from . import assembly, evidence, files, rounds, sequences, tables

_PLANS = [sequences, tables, evidence, rounds, files, assembly]

QUERIES: dict = {k: f for m in _PLANS for k, f in m.QUERIES.items()}
ORACLE: dict = {k: q for m in _PLANS for k, q in m.ORACLE.items()}
