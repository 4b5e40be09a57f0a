"""All registered queries and their oracles, by name."""

from __future__ import annotations

from lexiscope.plans import curation, derived, evaluation, events, files, pairs, style, verdicts

QUERIES: dict = {}
ORACLES: dict = {}
for _area in (style, evaluation, verdicts, events, curation, pairs, derived, files):
    QUERIES |= _area.QUERIES
    ORACLES |= _area.ORACLES
