"""All registered queries and their SQL oracles."""

from __future__ import annotations

from seqloom.plans import (
    delivering,
    ordering,
    planning,
    reporting,
    sequencing,
    streams,
    wiring,
)

_TOPICS = (sequencing, ordering, planning, wiring, delivering, reporting, streams)
QUERIES = {name: query for topic in _TOPICS for name, query in topic.QUERIES.items()}
ORACLES = {name: sql for topic in _TOPICS for name, sql in topic.ORACLES.items()}
