"""Registered queries over the driver's tables and their SQL."""

from __future__ import annotations

from . import composites, conversations, evidence, generic, masks, modelled, pools, reports, search, studies

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _part in (search, conversations, masks, generic, composites, studies, reports, pools, modelled, evidence):
    QUERIES |= _part.QUERIES
    ORACLES |= _part.ORACLES
