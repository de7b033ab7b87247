"""The column naming contract: measure, level suffix, audit triplet."""

from __future__ import annotations

import re

# The suffixes of processing levels and audit columns.
LEVELS = ["_P1", "_P2", "_P3"]
AUDIT = ["_qcApplied", "_qcResult", "_qcPhrase"]
DIMENSIONS = ["HarvestYear", "ID2", "Longitude", "Latitude", "SampleID", "Crop", "Comments"]
KEY = ["HarvestYear", "ID2"]

_LEVELLED = re.compile(r"^(?P<base>.+)_P(?P<level>[1-9])(?P<audit>_qc(?:Applied|Result|Phrase))?$")


def audit_names(column: str) -> list[str]:
    return [column + a for a in AUDIT]


def is_audit(column: str) -> bool:
    return column.endswith(tuple(AUDIT))


def level_of(column: str) -> int | None:
    """Processing level in a measure or audit column name, if it has one."""
    m = _LEVELLED.match(column)
    return int(m["level"]) if m else None


def base_of(column: str) -> str:
    """Measure name without level and audit suffix."""
    m = _LEVELLED.match(column)
    return m["base"] if m else column


def measure_of(column: str) -> str:
    """Column name without its audit suffix."""
    for a in AUDIT:
        if column.endswith(a):
            return column[: -len(a)]
    return column


def metric_columns(columns: list[str], dimensions: list[str] = DIMENSIONS) -> list[str]:
    """Columns that are neither dimensions nor audit columns, in table order."""
    return [c for c in columns if not is_audit(c) and c not in dimensions]
