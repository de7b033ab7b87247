"""Driver queries: the operators over the driver tables, each with its SQL counterpart."""

from stubble.queries import (  # noqa: F401  (importing registers the queries)
    calculation,
    distributions,
    filing,
    filling,
    harvest_years,
    harvesting,
    joining,
    positions,
    publishing,
    quality,
    replicating,
    spatial,
    streams,
    summaries,
    texts,
)
from stubble.queries.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
