"""All queries of the engine by name, each with its SQL where SQL can express it."""

from __future__ import annotations

from strandline.plans import extraction, merging, metrics, sequencing

PARTS = (sequencing, extraction, merging, metrics)


def queries() -> dict:
    out: dict = {}
    for part in PARTS:
        out |= part.QUERIES
    return out


def oracle_sql() -> dict:
    out: dict = {}
    for part in PARTS:
        out |= part.SQL
    return out
