"""All queries by name with the SQL that checks them."""

from __future__ import annotations

from wavequarry.plans import analysis, chunked, contract, evaluation, lookups, network, ordered, selection, signal

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _plan in (signal, lookups, ordered, contract, network, evaluation, chunked, selection, analysis):
    QUERIES |= _plan.QUERIES
    ORACLES |= _plan.ORACLES
